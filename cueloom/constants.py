"""Fixed values that results depend on: formats, word lists, defaults."""

# File kinds, lower case, without the dot, in matching order.
CUE_FORMATS = ("lrc", "vtt", "srt", "txt")
SUBTITLE_EXTS = ("lrc", "srt", "vtt")
VIDEO_EXTS = ("mp4", "mkv", "avi", "mov", "flv", "wmv", "webm", "ts")
AUDIO_EXTS = ("wav", "mp3", "flac", "ogg", "m4a", "aac", "wma")
DUB_EXTS = ("wav",)
MIX_OUTPUT_EXTS = ("mp4", "mp3", "wav", "flac", "ogg", "m4a", "mkv")

# Step states.
PENDING = "pending"
RUNNING = "running"
DONE = "done"
FAILED = "failed"
SKIPPED = "skipped"
STATUSES = (PENDING, RUNNING, DONE, FAILED, SKIPPED)
FINISHED = (DONE, SKIPPED)
TERMINAL = (DONE, FAILED, SKIPPED)
STEPS = (1, 2, 3)

# Log words by severity, tested in this order.
ERROR_WORDS = ("失败", "错误", "异常", "中止", "不存在", "error", "failed")
WARNING_WORDS = ("警告", "warn")
SUCCESS_WORDS = ("完成", "成功", "done", "success")

# Directory names, name parts, cache labels and duration words.
BILINGUAL_DIR = "双语"
BILINGUAL_PREFIX = "双语-"
MIXED_SUFFIX = "_mixed"
NO_TEXT = "无"
VOICE_MODEL = "edge_tts"
ETA_UNKNOWN = "计算中..."
ETA_HOURS, ETA_MINUTES, ETA_SECONDS = "小时", "分", "秒"

# Export presets (name, bitrate, sample rate, channels).
PRESETS = (
    ("low", "128k", 44100, 2),
    ("standard", "192k", 44100, 2),
    ("high", "256k", 44100, 2),
    ("extreme", "320k", 48000, 2),
)
CUSTOM_PRESET = "custom"

# Side of the original voice -> angle of the added voice.
CHANNEL_MAP = {"left": 155, "right": 25, "both": 135}
DEFAULT_ANGLE = 180

# Result messages of the enrichment step.
MSG_REUSED = "缓存复用"
MSG_DONE = "完成"
MSG_BULK_DONE = "批量完成"
MSG_NO_RESULT = "服务器未返回音频"
MSG_FAILED = "失败(已重试{n}次): {error}"

# The characters Python's str.strip() removes; Spark's trim alone removes only U+0020.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
