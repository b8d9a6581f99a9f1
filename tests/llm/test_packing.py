import zlib

import numpy as np
import pytest

from cueloom.llm import packing
from cueloom.llm.registry import tokenizer_path


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


TEXTS = ["Hello world, it's  two  spaces\n\n and\tlines ", " lead", "trail ", "a \n b", "été Ünïcode 日本 語 🙂 x", "x" * 5000,
         "word " * 3000, "<|endoftext|> inside <|endoftext|>", "don't  we'll 'S 12 34 --- ...", "nbsp here   wide  x", ""]


def test_round_trip(documents, tok, odd):
    rows = odd + [(i, t) for i, t in enumerate(TEXTS)]
    got = packing.pack(documents(rows), tokenizer_path(), with_ids=True).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [packing.END], "<u4") for _, t in rows]
    assert sum(r["length"] for r in got) == sum(map(len, want))
    for i, text in enumerate(TEXTS):
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        ids = [x for r in pieces for x in r["ids"]]
        assert ids == tok.encode(text, add_special_tokens=False).ids + [packing.END]
        assert [r["start"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
        assert all(r["doc_tokens"] == len(ids) and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in pieces)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= packing.LENGTH and r["offset"] == 0 for r in got)
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert [r["length"] for r in by_doc[9002]] == [1]


def test_forgetting_words_changes_nothing(tok, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 3)
    encode = packing._encoder(tokenizer_path())
    for text in TEXTS:
        assert np.frombuffer(encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000])
def test_lengths_are_the_binary_digits(n):
    lengths = packing.piece_lengths(n)
    assert sum(lengths) == n and sorted(lengths, reverse=True) == lengths
    assert len([x for x in lengths if x < 2048]) == bin(n % 2048).count("1")


def test_buckets_on_disk(spark, documents, tmp_path):
    packed = packing.pack(documents([(1, "a b c d e f g"), (2, "h")]), tokenizer_path(), with_ids=True)
    packing.write_buckets(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == packed.count() and all(len(r["ids"]) == r["length"] for r in back.collect())


def test_empty_table(documents):
    assert packing.pack(documents([]), tokenizer_path()).collect() == []


def test_the_fast_way_gives_the_tokenizers_ids(tok):
    """Over all texts of the second smallest tables, and over strings of the vocabulary's own tokens."""
    import random

    from pyarrow import parquet

    encode = packing._encoder(tokenizer_path())
    texts = [t or "" for t in parquet.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    rng = random.Random(2)
    words = [tok.decode([i]) for i in rng.sample(range(300, tok.get_vocab_size()), 4000)]
    texts += ["".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text[:200]
