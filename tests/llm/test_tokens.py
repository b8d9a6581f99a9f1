import numpy as np

from cueloom.llm import tokens


def plain(word):
    base, mask = int(tokens._BASE), (1 << 64) - 1
    total, power = 0, 1
    for b in word:
        total = (total + int(tokens._BYTE[b]) * power) & mask
        power = power * base & mask
    return int(tokens.mix(np.array([(total + len(word)) & mask], np.uint64))[0])


def hashed(*words):
    data = np.frombuffer(b" ".join(words), np.uint8)
    return tokens.hash_words(data, np.array([0, len(data)]), tokens.blank_table())[0].tolist()


def test_hashes_by_definition():
    long = bytes(97 + i * i % 26 for i in range(3 * tokens.STRIDE + 17))
    assert hashed(b"a", b"xyz", long, b"end") == [plain(w) for w in (b"a", b"xyz", long, b"end")]


def test_far_bytes_of_one_word_are_told_apart():
    """Also bytes that are a whole number of tables, or of a million, apart."""
    for apart in (tokens.STRIDE, 1 << 20):
        one, other = bytearray(b"q" * (apart + 9)), bytearray(b"q" * (apart + 9))
        one[3], other[3 + apart] = ord("z"), ord("z")
        assert hashed(bytes(one)) != hashed(bytes(other))
