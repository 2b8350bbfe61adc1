"""Explicit schemas of the data model; nothing is inferred."""

FRAME_PTS = "video_id long, n long, ts_us long, dur_us long"
PIXELS = "video_id long, idx int, width int, height int, n_channels int, data binary"
FRAMES = "video_id long, idx int, t double, bm double, dk double, hd double, cat string, boundary boolean"
HASHED = FRAMES + ", h long"
SEGMENTS = "video_id long, seg int, idx_start int, idx_end int, t_start double, t_end double, n_list long, n_loading long, n_detail long, n_fullscreen_image long"
SELECTED = "video_id long, seg int, kind string, idx int, bm double, h long, from_stable boolean, event string, reason string"
PAIR_SHIFT = "video_id long, seg int, i int, dx double, dy double, response double, identical boolean"
DECISION = PAIR_SHIFT + ", accepted boolean, reason string, add_rows int, dst_row long"
OCR_ATTEMPT = "video_id long, seg int, idx int, attempt int, timestamp string, sender string, error boolean"
OUTPUTS = "key string, video_id long, seq int, kind string, seg int, included boolean, edited_ts string, part struct<index:int,total:int>"
JOBS = "id string, owner_id string, heartbeat_at long, status string, created_at long, updated_at long"
BOXES = "i int, type string, offset long, size long"
