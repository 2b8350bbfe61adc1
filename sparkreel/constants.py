"""Coordinates and thresholds of the frame pipeline, in one place.

Fixed values: results must agree with recordings that were judged by them.
"""

# rectangles and bands, as parts of width and height
AVATAR_X, AVATAR_Y = (0.06, 0.15), (0.145, 0.19)
BODY_Y = (0.28, 0.90)
DARK_TOP_Y, DARK_BOTTOM_Y = (0.10, 0.16), (0.92, 0.98)
STATUS_BAR = 0.055
OCR_TIMESTAMP = (0.55, 1.0, 0.13, 0.18)
OCR_SENDER = (0.17, 0.55, 0.14, 0.17)

# classification
NON_WHITE_PX, DARK_PX, SATURATION_SCALE = 240, 60, 5
LOADING_BM, LIST_BM, FULLSCREEN_DK, HEADER_HD = 0.02, 0.15, 0.5, 0.15
CATEGORIES = ("list", "loading", "detail", "fullscreen_image")

# sampling
FPS, ROUND_EPS = 6, 1e-4

# selection
STABLE_DISTANCE, DUP_DISTANCE, MAX_PENDING = 2, 6, 4

# stitching
MIN_RESPONSE, MAX_DX, MIN_DY = 0.7, 12, 2
FIXED_ROW_DIFF, FIXED_ROW_MAX, FIXED_ROW_RESPONSE = 1.0, 0.25, 0.8
CORR_SCALE, RECHECK_LOW, RECHECK_HIGH = 2, 0.55, 0.85
TILE_ROWS, MAX_STITCH_BYTES, PART_ROWS = 1024, 128 * 1024 * 1024, 8000

# OCR queue
OCR_ATTEMPTS, OCR_SPACING, OCR_WAITING, OCR_TOTAL, OCR_ERRORS = 8, 3, 8, 64, 3
OCR_UPSCALE = 2

# jobs
STALE_MS = 5 * 60 * 1000

# Patterns and formats of time stamps, senders and files. They must accept and give
# exactly these texts, so they are stated as they are.
TIMESTAMP = r"(20\d\d)-(\d\d)-(\d\d)\s*(\d\d):?(\d\d)"
TYPED_TIMESTAMP = r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})[\sT_]*(\d{1,2}):?(\d{2})\s*$"
STORED_TIMESTAMP = r"^(\d{4}-\d{2}-\d{2})_(\d{2})(\d{2})$"
JAPANESE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー々〆〇]"
NOISE_MARKS = r"|\/_~`^"
BLANKS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
EXTENSION = r"\.[^.]+$"
VIDEO_FILE = r"(?i)\.(mp4|mov|m4v)$"
MAIL_NAME, UNKNOWN_MAIL, IMAGE_NAME = "mail_", "mail_unknown_%02d", "image_%03d.png"
PROVISIONAL_MAIL, PART_SUFFIX, STITCHED_SUFFIX = "mail_%02d_seg%d_t%s", "_p%dof%d", "_stitched"
ARCHIVE_SUFFIX = "_rescue.zip"

# progress: below this share no remaining time is shown; without any for this long, work has stalled
ETA_FROM, STALL_WARN_MS, STALL_ABORT_MS = 0.02, 180_000, 600_000
