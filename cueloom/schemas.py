"""Schemas of the tables this package reads and writes."""

CUES = (
    "source_id string, line_start int, idx int, ts_text string, "
    "start_ms long, text string, source_version string"
)
INVENTORY = "path string, dir string, name string, stem string, ext string, length long, mtime timestamp"
CLIPS = "folder string, file_name string, seq long, start_ms long, short_text string"
RESULT_CACHE = (
    "cache_key string, text string, result_path string, model string, endpoint string, "
    "created_at timestamp, file_size long, use_count long"
)
TASKS = (
    "task_id string, source_path string, source_dir string, source_name string, created_at string, "
    "custom_subtitle string, custom_mix_folder string, "
    "s1_status string, s2_status string, s3_status string, "
    "s1_output string, s2_output string, s3_output string, "
    "s1_error string, s2_error string, s3_error string, "
    "from_folder boolean, import_folder string, group_id string"
)
ENDPOINTS = "pos int, name string, url string, model string, status string"
SIGNAL_BLOCKS = (
    "signal_id string, channel int, block_no long, sample_rate int, width int, samples array<float>"
)
JOB_EVENTS = (
    "event_id long, ts timestamp, task_id string, step int, kind string, ok boolean, pct int, msg string"
)
