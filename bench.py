"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_RUNS`` (timed runs after one warm run,
default 3; the median counts), ``BENCH_QUERIES`` (comma-separated names, or ``all``).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from cueloom.plans import QUERIES
from cueloom.session import build_session, release

HEADLINE = (
    "flagship_reuse_by_source", "a1_timed_text_scan", "a7_cache_upsert", "c1_lrc_cues", "c2_vtt_cues", "c3_srt_cues",
    "c9_merge_with_cap", "d3_natural_keys", "e1_matching_subtitles", "e2_batch_outputs", "e5_cache_hits",
    "e6_cache_misses", "e8_mix_outputs", "e10_repaired_paths", "e11_nearest_onsets", "e16_renamed_paths",
    "f4_group_progress", "f9_outcome_by_step", "f17_voice_band_energy", "f19_overlay_add", "g2_envelope", "g7_eta",
    "h2_tree_order", "i2_merged_results", "k1_cached_enrichment", "l5_step_results", "m2_mix_matched_gain",
    "m3_mix_following_gain", "m5_clip_sides", "j5_live_rollup",
)


def once(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    spent = time.perf_counter() - start
    release(spark)
    return spent


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        first = once(spark, name, folder)
        times[name] = round(statistics.median([once(spark, name, folder) for _ in range(runs)]) if runs else first, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
    }))


if __name__ == "__main__":
    main()
