"""Packing by power-of-two decomposition (operator 4).

A document of n tokens becomes as many pieces of ``LENGTH`` as fit, then one piece for each binary digit of the rest,
longest first. Every piece is a sequence of its own: its length is a power of two, so nothing is padded and no sequence
crosses documents. Sequences of equal length form a bucket; :func:`write_buckets` lays them out by length.

The plan is one scan without a shuffle. A sequence's number is given by its place in the scan, so a task that runs
again after a lost executor gives the same numbers.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END = 1
#: Words whose ids a Python worker remembers.
MEMORY = 400_000

_WORDS: dict[str, dict[str, bytes]] = {}


#: Fixed value: how byte-level BPE files of this kind split a text before they merge.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that every regular-expression library classes alike: printable ASCII, Latin letters, common blanks.
_PLAIN = re.compile("[\\t\\n\\r -~\u00c0-\u024f]*")


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level file: itself if it prints, else one from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _quick(path: str) -> Callable[[str], np.ndarray] | None:
    """A faster merger with the same ids, if the file is plain byte-level BPE whose tokens are numbered by merge order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and not spec.get("normalizer")
        and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    )
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    if not plain or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    byte = _byte_of()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merger = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: merger.encode_to_numpy(text, disallowed_special=())


def _segments(text: str) -> list[str]:
    """Cut a text in front of single spaces between visible characters; the tokenizer cuts there anyway."""
    parts = text.split(" ")
    out = [parts[0]]
    for a, b in zip(parts, islice(parts, 1, None)):
        if a and b and not a[-1].isspace() and not b[0].isspace():
            out.append(" " + b)
        else:
            out[-1] += " " + b
    return out


def _encoder(path: str):
    """Text to the tokenizer's ids (little-endian 32-bit).

    Plain texts go through a merger with the same ids that is several times faster (:func:`_quick`). Other texts are cut
    in words, which are remembered; words that are not plain, and texts with a special token's string, are the
    tokenizer's own.
    """
    tok, quick = _tokenizer(path), _quick(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    known = _WORDS.setdefault(path, {})

    def own(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(text: str) -> bytes:
        return quick(text).astype("<u4").tobytes() if quick and _PLAIN.fullmatch(text) else own(text)

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return own(text)
        if quick and _PLAIN.fullmatch(text):
            return one(text)
        segments = _segments(text)
        new = set(segments).difference(known)
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = set(segments)
        known.update((word, one(word)) for word in new)
        return b"".join(map(known.__getitem__, segments))

    return encode


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    """``length`` (a power of two) as often as it fits, then the binary digits of the rest from the top."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in reversed(range(length.bit_length())) if rest >> b & 1]


def _pieces(path: str, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        end = np.array([END], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        for batch in batches:
            docs, rows, size = batch.column(0).to_pylist(), [], 0
            for i, doc in enumerate(docs):
                text = batch.column(1)[i].as_py() or ""
                ids = encode(text) + end
                total, at = len(ids) // 4, 0
                for n in piece_lengths(total, length):
                    part = ids[4 * at : 4 * (at + n)]
                    rows.append((doc, at, n, zlib.crc32(part), total) + ((np.frombuffer(part, "<i4"),) if with_ids else ()))
                    at += n
                size += total
                if size > 4_000_000 or i == len(docs) - 1:
                    yield _batch(rows, names)
                    rows, size = [], 0

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of ``docs(doc_id, text)``.

    ``tokenizer`` is the path of a tokenizer file that all executors have. A null or empty text is the closing id
    alone. Rows that repeat a doc_id are packed one by one; a null doc_id stays null. ``with_ids`` adds the token ids.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _pieces(tokenizer, length, with_ids), schema
    )
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed sequences with one folder for each length; every task writes its share, nothing is shuffled."""
    pieces.write.partitionBy("length").parquet(path)
