"""Hand-worked cases of single operators."""

import datetime as dt
import math
import time

import pytest
from pyspark.sql import functions as F

from cueloom import constants as K
from cueloom import session
from cueloom.functions import sound as sd
from cueloom.functions import text as tx
from cueloom.operators import cues as cu
from cueloom.operators import enrich as en
from cueloom.operators import jobs as jb
from cueloom.operators import matching as ma
from cueloom.operators import signals as sg
from cueloom.operators import transitions as tr
from cueloom.sources import files as fl
from cueloom.sources import tables as tb


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return tuple(row)


def parse(spark, parser, lines):
    docs = spark.createDataFrame([("s", "\n".join(lines), "0")], "source_id string, text string, source_version string")
    rows = parser(docs).orderBy("idx").collect()
    return [(r.idx, r.ts_text, r.start_ms, r.text) for r in rows]


def test_lrc(spark):
    lines = [
        "[00:01.50]Hi", "[01:00:02.07] there ", "[00:03.500]x", "[00:04.00]", "[ar:name]", "[00:05.00][00:06.00]y",
    ]
    assert parse(spark, cu.parse_lrc, lines) == [
        (1, "00:00:01.50", 1500, "Hi"), (2, "01:00:02.07", 3602070, "there"), (3, "00:00:05.00", 5000, "[00:06.00]y"),
    ]


BLOCKS = [
    "", "00:00:01.239 --> 00:00:02.000", "hello", "world", "", "00:00:03.000 --> 00:00:04.000", "", "7",
    "00:00:05.009 --> 00:00:06.000", "bye",
]


def test_vtt_and_srt(spark):
    assert parse(spark, cu.parse_vtt, ["WEBVTT", *BLOCKS]) == [
        (1, "00:00:01.23", 1230, "hello world"), (2, "00:00:05.00", 5000, "7 bye"),
    ]
    srt = [x.replace(".", ",") if "-->" in x else x for x in BLOCKS]
    assert parse(spark, cu.parse_srt, srt) == [
        (1, "00:00:01.23", 1230, "hello world"), (2, "00:00:05.00", 5000, "bye"),
    ]


def test_clip_names(spark):
    names = [(1, "00:00:01.50", "Hi, 世界!"), (12345, "00:00:02.00", "!!!")]
    df = spark.createDataFrame(names, "i int, ts string, text string")
    name = tx.clip_name(F.col("i"), F.col("ts"), F.col("text"))
    rows = df.select(name.alias("n")).select(
        "n", tx.clip_parts(F.col("n")).alias("p"), tx.clip_parts(F.col("n"), exact=True).alias("e")
    ).collect()
    assert [r.n for r in rows] == ["0001_00-00-01.50_Hi.wav", "12345_00-00-02.00_无.wav"]
    assert [tuple(r.p) for r in rows] == [(1, 1500, "Hi"), (12345, 2000, "无")]
    assert rows[0].e is not None and rows[1].e is None


def test_natural_order(spark):
    names = ["Track10", "a", "10", "track2", "Track2b", "2"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(tx.natural_key(F.col("n"))).collect()]
    assert got == ["2", "10", "a", "track2", "Track2b", "Track10"]


def test_keys(spark):
    assert one(
        spark, tx.cache_key(F.lit("你好"), F.lit("m"), F.lit(0)), tx.voice_key(F.lit("hi"), F.lit("v"), F.lit(12)),
        tx.fingerprint(F.lit("abc")),
    ) == ("4fd67e20820916d65314313b48c4c967", "3e5dcd2c4c5905b06c70d791a26a92f6", "90015098")


@pytest.mark.parametrize("sec,text", [(3725, "1小时2分5秒"), (65, "1分5秒"), (5, "5秒"), (0, "计算中...")])
def test_eta(spark, sec, text):
    assert one(spark, tx.eta_text(F.lit(sec))) == (text,)


def test_gain_pan_limit(spark):
    got = one(
        spark, sd.db_to_linear(F.lit(-5.0)), *[f(F.lit(a)) for a in (155, 25, 135, 180) for f in (sd.pan_left, sd.pan_right)]
    )
    want = (0.562341, 0.21644, 0.976296, 0.976296, 0.21644, 0.382683, 0.92388, 0.0, 1.0)
    assert got == pytest.approx(want, abs=1e-5)
    limited = one(spark, *[sd.soft_limit(F.lit(float(x)), 2) for x in (30000, 32767, 40000, -40000)])
    assert limited == (29995, 31985, 32756, -32756)


def test_signal_level(spark):
    rows = [("a", i, x) for i, x in enumerate([1000.0, -1000.0] * 2)] + [("z", i, 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "signal_id string, at long, value double").withColumn("samples", F.array("value"))
    got = {r.signal_id: r.rms_db for r in sg.signal_level(df, ["signal_id"], 2).collect()}
    assert got["a"] == pytest.approx(-30.308999, abs=1e-6) and got["z"] == -100.0


def test_percents(spark):
    assert one(
        spark, tx.percent(F.lit(1), F.lit(3)), tx.percent_across(F.lit(50), F.lit(1), F.lit(4)),
        tx.percent_in_span(F.lit(50), F.lit(33), F.lit(33)),
    ) == (33, 37, 49)


def test_endpoints(spark):
    def pick(states, multi, current):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(states)], "pos int, status string")
        return [r.pos for r in en.available_endpoints(df, multi, current).collect()]

    assert pick(["failed", "success"], True, 0) == [1]
    assert pick(["failed", "failed"], True, 1) == [1]
    assert pick(["failed", "success"], False, 5) == [0]


@pytest.mark.parametrize("msg,level", [
    ("处理失败", "error"), ("失败 警告", "error"), ("WARN x", "warning"), ("完成", "success"), ("abc", "info"),
])
def test_severity(spark, msg, level):
    assert one(spark, tx.severity(F.lit(msg))) == (level,)


@pytest.mark.parametrize("msg,pct", [("45.5%", 45), ("3/4", 75), ("100%", 99), ("0/0", None), ("1/2 and 30%", 30)])
def test_progress_in_text(spark, msg, pct):
    assert one(spark, tx.progress_in_text(F.lit(msg))) == (pct,)


def inventory(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    name = tx.base_name(F.col("path"))
    return df.select(
        "path", tx.dir_name(F.col("path")).alias("dir"), name.alias("name"), tx.stem_of(name).alias("stem"),
        tx.ext_of(name).alias("ext"),
    )


def test_subtitle_match(spark):
    inv = inventory(spark, ["/d/a.srt", "/d/A.LRC", "/d/a.zh.vtt", "/d/ab.lrc", "/d/b.zh-CN.lrc", "/e/c.lrc"])
    media = inventory(spark, ["/d/a.mp4", "/d/b.mp4", "/d/c.mp4"])
    got = {r.stem: r.subtitle for r in ma.match_subtitles(media, inv).collect()}
    assert got == {"a": "/d/A.LRC", "b": "/d/b.zh-CN.lrc", "c": None}


def test_batch_outputs_stay_in_their_group(spark):
    tasks = spark.createDataFrame([(1, "g1", "01"), (2, "g2", "01"), (3, "g1", "x")], "task_id int, folder string, source_name string")
    out = spark.createDataFrame([("g1", "01.srt"), ("g1", "01.lrc"), ("g2", "a01b.lrc"), ("g2", "a01.lrc")], "folder string, name string")
    got = {r.task_id: r.output for r in ma.match_batch_outputs(tasks, out, formats=("lrc", "srt")).collect()}
    assert got == {1: "01.lrc", 2: "a01.lrc", 3: None}


def test_repaired_paths(spark):
    rows = spark.createDataFrame(
        [(1, "/m/x/1.mp4"), (2, "/m/双语-y/2.mp4"), (3, "/m/z/3.mp4"), (4, "/m/x/4.mp4")], "task_id int, source_path string"
    )
    inv = inventory(spark, ["/m/双语-x/1.mp4", "/m/y/2.mp4", "/m/x/4.mp4"])
    got = {r.task_id: (r.path_state, r.resolved_path) for r in ma.repair_paths(rows, inv).collect()}
    assert got == {
        1: ("repaired", "/m/双语-x/1.mp4"), 2: ("repaired", "/m/y/2.mp4"), 3: ("missing", None), 4: ("ok", "/m/x/4.mp4"),
    }


@pytest.mark.parametrize("onsets,want", [([1400, 1700, 2300], 1700), ([1400], 2000)])
def test_nearest_onset_picks(spark, onsets, want):
    # A level step after each onset: sample rate 1000, frames of 10 side by side.
    level, samples = 100.0, []
    for i in range(4200):
        if any(i == o + 10 for o in onsets):
            level += 1000.0
        samples.append(("s", i, level))
    frames = spark.createDataFrame(samples, "signal_id string, at long, value double").select(
        "signal_id", "at", F.array("value").alias("samples")
    )
    cue = spark.createDataFrame([("s", 1, 2000, 1000, 4000, 4200)], "signal_id string, seq int, start_ms long, lo_ms long, hi_ms long, duration_ms long")
    got = sg.nearest_onsets(cue, frames, 1000, 10, 10).first().aligned_ms
    assert got == want


STATES = [
    ("t1", "g1", "done", "done", "done"), ("t2", "g1", "done", "done", "skipped"),
    ("t3", "g2", "done", "failed", "pending"), ("t4", "g2", "running", "pending", "pending"),
]
SCHEMA = "task_id string, group_id string, s1_status string, s2_status string, s3_status string"


def test_rollups(spark):
    tasks = spark.createDataFrame(STATES, SCHEMA)
    groups = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "group_id string")
    per_task = {r.task_id: (round(r.p, 4), r.s) for r in tasks.select(
        "task_id", jb.task_progress().alias("p"), jb.task_status().alias("s")).collect()}
    assert per_task == {"t1": (1, "done"), "t2": (1, "pending"), "t3": (0.3333, "failed"), "t4": (0, "running")}
    roll = {r.group_id: (round(r.progress, 4), r.n_done, r.status) for r in jb.group_rollup(tasks, groups).collect()}
    assert roll == {"g1": (1, 1, "pending"), "g2": (0.1667, 0, "running"), "g3": (0, 0, "pending")}
    step3 = {r.group_id: r.status for r in jb.group_step_status(tasks).filter("step = 3").collect()}
    assert step3 == {"g1": "done", "g2": "pending"}


def test_outcomes(spark):
    rows = [
        ("A", "", "done", "done", "pending"), ("B", "", "done", "pending", "pending"),
        ("C", "", "done", "failed", "pending"), ("D", "", "done", "running", "pending"),
    ]
    tasks = spark.createDataFrame(rows, SCHEMA)

    def counts(steps, rule):
        out = jb.run_outcome(tasks, steps, rule, F.col("task_id") != "B", F.col("task_id") == "C")
        return tuple(jb.outcome_counts(out).first())

    assert counts([1, 2], "by_step") == (1, 2, 1)
    assert counts([1, 2], "by_task") == (1, 1, 2)
    done = jb.run_outcome(tasks, [1, 2, 3], "by_step", F.col("task_id") != "B", F.col("task_id") == "C")
    assert {r.task_id: r.outcome for r in done.collect()}["D"] == "fail"


def test_rerun(spark):
    cols = [f"s{s}_{k}" for k in ("status", "output", "error") for s in K.STEPS]
    df = spark.createDataFrame([("t", *["done"] * 3, *["o"] * 3, *["e"] * 3)], ["task_id", *cols])
    r = tr.rerun(df, 2).first()
    assert [r[c] for c in cols] == ["done", "pending", "pending", "o", "", "", "e", "", "e"]


def test_charsets(spark):
    rows = [(b"\xef\xbb\xbf\xe4\xbd\xa0",), ("你好".encode("gbk"),), (b"\xff\xff",)]
    df = spark.createDataFrame(rows, "content binary")
    assert [r.text for r in fl.decode_text(df).collect()] == ["你", "你好", None]
    lines = spark.createDataFrame([("你好".encode("gbk") + b"\xff",)], "b binary")
    assert lines.select(fl.decode_console_line("b").alias("x")).first().x == "你好�"


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "双语").mkdir()
    (tmp_path / "a.LRC").write_text("[00:01.00]hi\r\n[00:02.00]there", encoding="utf-8")
    (tmp_path / "双语" / "b.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\n你好\n".encode("gbk"))
    (tmp_path / "c.mp4").write_bytes(b"x")
    (tmp_path / "0001_00-00-01.50_Hi.wav").write_bytes(b"x")
    files = fl.read_files(spark, str(tmp_path))
    cues = cu.parse_timed_text(fl.timed_text_sources(files))
    assert sorted((r.text, r.start_ms) for r in cues.collect()) == [("hi", 1000), ("there", 2000), ("你好", 1000)]
    assert all(int(r.source_version) > 1_600_000_000 for r in cues.collect())
    inv = fl.inventory(files)
    assert sorted(r.name for r in fl.media_inventory(inv).collect()) == ["0001_00-00-01.50_Hi.wav", "c.mp4"]
    assert [(r.seq, r.start_ms) for r in fl.clip_inventory(inv).collect()] == [(1, 1500)]
    assert "content" not in inv.columns


def test_snapshot_fills_missing_fields(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"task_id": "1", "s1_status": "done"}\n')
    r = tb.read_task_snapshot(spark, str(tmp_path)).first()
    assert (r.task_id, r.s1_status, r.s2_status, r.group_id, r.from_folder) == ("1", "done", "pending", "", False)


def test_output_routes(spark):
    df = spark.createDataFrame(
        [("/m/x/1.mp4", "1", True), ("/m/双语-x/1.mkv", "1", True), ("/m/x/1.mp3", "1", False)],
        "source_path string, source_name string, from_folder boolean",
    )
    got = [r.out_path for r in tb.route_outputs(df, folder_prefix=True).collect()]
    assert got == ["/m/双语-x/1_mixed.mp4", "/m/双语-x/1_mixed.mp4", "/m/x/双语/1_mixed.mp3"]
    assert tb.route_outputs(df, custom_dir=" /o ", fmt="wav", add_suffix=False).first().out_path == "/o/1.wav"


def test_drop_actions(spark):
    df = spark.createDataFrame([("/a.wav", False), ("/b.lrc", False), ("/c", True), ("/d.pdf", False)], "path string, is_dir boolean")
    plain = {r.path: r.action for r in fl.plan_drop(df).collect()}
    assert plain == {"/a.wav": "add_task", "/b.lrc": "set_subtitle", "/c": "scan_folder", "/d.pdf": "ignore"}
    assert {r.path: r.action for r in fl.plan_drop(df, True, K.DONE).collect()}["/a.wav"] == "ignore"
    assert {r.path: r.action for r in fl.plan_drop(df, True).collect()}["/a.wav"] == "set_dub_folder"


def test_time_labels(spark):
    at = F.lit(dt.datetime(2024, 1, 2, 3, 4, 5))
    assert one(spark, tx.task_label(at, F.lit("v")), tx.group_label(at, F.lit(2)), tx.stamp_message(at, F.lit("m"))) == (
        "20240102_030405_v", "grp_20240102_030405_2", "[03:04:05] m",
    )


def test_pan_is_constant_power(spark):
    a = spark.range(181).select(sd.pan_left(F.col("id")).alias("l"), sd.pan_right(F.col("id")).alias("r"))
    assert all(math.isclose(x.l**2 + x.r**2, 1.0, abs_tol=1e-12) for x in a.collect())


def test_calls_are_rows_not_failures():
    def short(texts, model, endpoint):
        return texts[:1]

    def broken(texts, model, endpoint):
        raise ConnectionError("gone") if len(texts) > 1 else ValueError("bad")

    assert en.call_batch(short, ["a", "b"], "m", 1, 0, "any") == [
        ("a", True, K.MSG_BULK_DONE, 1), (None, False, K.MSG_NO_RESULT, 1),
    ]
    got = en.call_batch(broken, ["a", "b"], "m", 2, 0, "strict")
    assert [g[1] for g in got] == [False, False] and got[0][3] == 2 and "bad" in got[0][2]


def test_rows_of_an_answer_fail_alone():
    def holes(texts, model, endpoint):
        return ["a", None, ValueError("bad")][: len(texts)]

    got = en.call_batch(holes, ["x", "y", "z"], "m", 1, 0, "any")
    assert got == [("a", True, K.MSG_BULK_DONE, 1), (None, False, K.MSG_NO_RESULT, 1), (None, False, "bad", 1)]
    none = en.call_one(lambda texts, model, endpoint: [None], "x", "m", 2, 0)
    assert none[1] is False and none[3] == 2 and K.MSG_NO_RESULT in none[2]


def test_a_hanging_call_is_given_up():
    begun = time.time()
    got = en.call_one(lambda texts, model, endpoint: time.sleep(30), "x", "m", 2, 0, limit_s=0.2)
    assert got[1] is False and got[3] == 2 and "0.2" in got[2] and time.time() - begun < 5


def test_texts_may_hold_the_parsers_marks(spark):
    text = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nhello \ufdd0world\ufdd1 \ufdd2 \ufdd3b\nsecond\n"
    docs = spark.createDataFrame([("a", text, "0")], "source_id string, text string, source_version string")
    assert [r["text"] for r in cu.parse_vtt(docs).collect()] == ["hello \ufdd0world\ufdd1 \ufdd2 \ufdd3b second"]
    srt = docs.withColumn("text", F.translate("text", ".", ","))
    assert [r["text"] for r in cu.parse_srt(srt).collect()] == ["hello \ufdd0world\ufdd1 \ufdd2 \ufdd3b second"]


def test_merge_keeps_text_without_a_cap(spark):
    rows = [("s", i, i * 1000, i * 1000 + 900, f"t{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "source_id string, seg_no long, start_ms long, end_ms long, text string")
    free, capped = cu.merge_close_segments(df, 300, None), cu.merge_close_segments(df, 300, 10_000, chunk_rows=7)
    assert sorted(free.columns) == sorted(capped.columns)
    (one,) = free.collect()
    assert one["n_parts"] == 30 and one["text"] == " ".join(f"t{i}" for i in range(30))
    assert sorted(r["text"] for r in capped.collect()) == sorted(
        " ".join(f"t{i}" for i in part) for part in (range(0, 10), range(10, 20), range(20, 30)))


def test_last_frame_has_no_rise(spark):
    rows = [("s", at, [float(x) for x in range(at, at + n)]) for at, n in ((0, 3), (3, 1), (4, 4))]
    pieces = spark.createDataFrame(rows, "signal_id string, at long, samples array<double>")
    rises = {r["hop_no"]: r["rise"] for r in sg.energy_rises(pieces, ["signal_id"], 4, 2).collect()}
    assert rises[max(rises)] is None and all(v is not None for k, v in rises.items() if k != max(rises))


def test_tasks_without_a_group_are_in_none(spark):
    tasks = spark.createDataFrame(
        [("a", "g", "done", "done", "done"), ("b", "", "failed", "pending", "pending")],
        "task_id string, group_id string, s1_status string, s2_status string, s3_status string")
    assert {r["group_id"] for r in jb.group_step_status(tasks).collect()} == {"g"}
    assert {r["group_id"] for r in jb.progress_levels(tasks).collect()} == {"g", None}


def test_a_cluster_needs_the_shared_folder():
    assert session.is_local("local[8]") and session.is_local("local")
    assert not session.is_local("spark://host:7077") and not session.is_local("local-cluster[2,1,1024]")


def test_folder_of_a_path(spark):
    paths = ["a/b/c", "/x", "x", "", "/", "a/", "//x"]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", tx.dir_name(F.col("p")).alias("d"))
    assert [r["d"] for r in sorted(got.collect())] == ["a/b", "/", "", "", "/", "a", "/"]


def test_clips_without_an_onset(spark):
    rows = [("short", 0, [900.0] * 64), ("silent", 0, [0.0] * 900), ("loud", 0, [900.0] * 900)]
    pieces = spark.createDataFrame(rows, "clip_id string, at long, samples array<double>")
    got = {r["clip_id"]: r["onset_ms"] for r in sg.clip_onsets(pieces, 8000).collect()}
    assert got == {"short": 0.0, "silent": 0.0, "loud": 10.0}
