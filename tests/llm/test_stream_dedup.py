"""Stateful stream dedup against a dictionary of whole texts."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from cueloom.llm import stream_dedup as sd

CLASH = ("_metadata", "digest", "at", "n", "stays", "file", "bits", "bucket", "source")


@pytest.fixture
def table(spark, tmp_path):
    """A folder of Parquet files, one for each list of (doc_id, text), added in turn."""
    number = itertools.count()

    def add(rows, path=tmp_path / "docs"):
        full = [(i, t, *["x"] * len(CLASH)) for i, t in rows]
        shape = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)
        spark.createDataFrame(full, shape).coalesce(1).write.mode("append").parquet(str(path / f"part={next(number)}"))
        return str(path)

    return add


def plain(rows):
    """Of each text: rows, largest id (None is smallest)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        stays = max((x for x in ids if x is not None), default=None)
        out.append((i, stays, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


ROWS = [(i, f"text {i % 7}") for i in range(60)] + [(100 + i, "hot") for i in range(40)] + [
    (None, "no id"), (None, None), (200, None), (201, ""), (202, "A"), (203, "a"), (204, "a "), (205, "x" * 200_000),
    (206, "x" * 200_000 + "y"), (207, "x" * 200_000), (208, "same"), (208, "same"), (208, "same"), (209, "é"), (210, "e\u0301"),
]


def one_char(text):
    return F.substring(sd.sha256(text), 1, 1)


@pytest.mark.parametrize("digest", [sd.sha256, one_char])
def test_against_dictionary(spark, table, digest):
    """With a digest of one character most groups are told apart by their bytes alone."""
    path = table(ROWS[:50])
    table(ROWS[50:])
    df = sd.deduplicate(spark, path, digest=digest)
    assert got(df) == plain(ROWS)
    kept = df.filter("kept")
    texts = {t or "" for _, t in ROWS}
    assert kept.count() == len(texts) and kept.select("text_sha256").distinct().count() == len(texts)
    rows = sd.kept_rows(spark, path, digest=digest)
    assert {r.text or "" for r in rows.collect()} == texts and rows.count() == len(texts)
    assert set(CLASH) <= set(rows.columns)


def test_locator_finds_the_content(spark, table):
    df = sd.deduplicate(spark, table(ROWS))
    at = spark.read.parquet(df.first().keep_file).select("text", F.col("doc_id").alias("id"))
    assert at.count() == len(ROWS)
    from pyarrow import parquet

    texts = parquet.read_table(df.first().keep_file.removeprefix("file:")).column("text").to_pylist()
    for r in df.collect():
        assert hashlib.sha256((texts[r.keep_row] or "").encode()).hexdigest() == r.text_sha256


def test_state_goes_on_with_new_files(spark, table, tmp_path):
    """The second call reads only the new file; the state remembers all before it."""
    where = str(tmp_path / "state")
    path = table(ROWS[:70])
    assert got(sd.deduplicate(spark, path, where)) == plain(ROWS[:70])
    table(ROWS[70:])
    assert got(sd.deduplicate(spark, path, where)) == plain(ROWS)
    changed = spark.read.parquet(f"{where}/changes")
    assert changed.select("batch_id").distinct().count() == 2
    second = changed.filter(F.col("batch_id") > 0)
    assert second.count() == len({t or "" for _, t in ROWS[70:]})
    # Nothing new: no further trigger, same answer.
    assert got(sd.deduplicate(spark, path, where)) == plain(ROWS)


def test_many_triggers_give_the_same(spark, table):
    for lo in range(0, len(ROWS), 20):
        path = table(ROWS[lo : lo + 20])
    assert got(sd.deduplicate(spark, path, per_trigger=1)) == plain(ROWS)


def test_empty_table(spark, table):
    path = table([])
    assert sd.deduplicate(spark, path).count() == 0 and sd.kept_rows(spark, path).count() == 0
