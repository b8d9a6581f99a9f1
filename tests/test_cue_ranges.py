"""Documents cut into ranges of lines give the cues of the whole."""

import random

import pytest

from cueloom.operators import cue_ranges as cr
from cueloom.operators import cues as cu
from cueloom.sources import files as fl

PIECES = ["", "", "00:00:0{}.239 --> x", "00:00:0{},119 --> x", "word{}", "7", "NOTE {}", "WEBVTT", " [00:0{}.50]hi ", "[00:00:0{}.07]",
          "\ufdd0mark\ufdd1{}", "\ufdd3x\ufdd3x", "00:0{} no stamp"]


def documents(n=60, seed=5):
    rng = random.Random(seed)
    for number in range(n):
        lines = [rng.choice(PIECES).format(rng.randrange(10)) for _ in range(rng.randrange(0, 24))]
        yield f"d{number}", ("vtt", "srt", "lrc", "txt")[number % 4], lines


COLUMNS = ("source_id", "line_start", "idx", "ts_text", "start_ms", "text", "source_version", "more")


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cut_anywhere(spark, end):
    rng = random.Random(9)
    whole, ranges = [], []
    for source, fmt, lines in documents():
        whole.append((source, fmt, end.join(lines), "1", "x"))
        lo, number = 0, 0
        while lo < len(lines) or not number:
            hi = lo + rng.choice((1, 1, 2, 3, 8))
            text = end.join(lines[lo:hi])
            ranges.append((source, number * 2, fmt, None if text == "" and hi - lo == 1 and lo < len(lines) else text, "1", "x"))
            lo, number = hi, number + 1
    docs = spark.createDataFrame(whole, "source_id string, format string, text string, source_version string, more string")
    cut = spark.createDataFrame(ranges, "source_id string, range_no int, format string, text string, source_version string, more string")
    want = got(cu.parse_timed_text(docs))
    assert len(want) > 100 and got(cr.parse_ranges(cut.repartition(5))) == want


def test_empty(spark):
    none = spark.createDataFrame([], "source_id string, range_no int, format string, text string, source_version string, more string")
    assert got(cr.parse_ranges(none)) == []


def test_files_of_many_ranges(spark, tmp_path):
    """Files read in stretches of a few hundred bytes, by many tasks."""
    folder = tmp_path / "subs"
    folder.mkdir()
    for source, fmt, lines in documents(12, 3):
        (folder / f"{source}.{fmt}").write_text("\ufeff" + "\n".join(lines * 9) + "\n", encoding="utf-8")
    (folder / "other.bin").write_text("00:00:01.239 --> x\nno\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        ranges = fl.line_ranges(spark, str(folder), range_lines=4)
        assert ranges.select("range_no").distinct().count() > 20
        cut = sorted(tuple(r) for r in cr.parse_ranges(ranges).drop("source_version").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    files = fl.timed_text_sources(fl.read_files(spark, str(folder)))
    whole = sorted(tuple(r) for r in cu.parse_timed_text(files).drop("source_version").collect())
    assert len(whole) > 50 and cut == whole
