"""The frame pipeline on streams: sampling, segmentation and selection with keyed state.

Frames of a video come in presentation order; there is no late data, so there are no
watermarks, and a frame out of order is an error of the source. The end of a video is an explicit
row (end = true), which flushes what the state still holds. sample(), segment() and select() are stateful
processors with a timer for each video: one that is silent for `silence_ms` of processing time
is flushed as if it had ended, once, and its state goes. Their state needs the RocksDB store, which they
choose if the session has named none. Timers need batches without data, so a query with the trigger availableNow
ends only with spark.sql.streaming.noDataMicroBatches.enabled set to false (and then leaves timers alone). State survives restarts by the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as K
from ..functions import pixels as P
from ..functions import stitch as S
from ..operators.ocr import Segment, Waiting
from ..operators.select import HashIndex, close_segments
from ..sources.images import rgb

#: Processing time after which a silent video counts as ended.
SILENCE_MS = 600_000
_STORE = "spark.sql.streaming.stateStore.providerClass"


class Video(StatefulProcessor):
    """State of one video, with a timer that flushes it after `silence_ms` without rows.

    Subclasses open their state, take a batch's rows in order, and flush; after a flush nothing is left.
    """

    columns: list[str] = []
    order = "idx"

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, key: int, rows: pd.DataFrame) -> list[tuple]:
        raise NotImplementedError

    def flush(self, key: int) -> list[tuple]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def _timer(self, now: int | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if now is not None:
            self.handle.registerTimer(now + self.silence_ms)

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.columns)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows))
        end = pdf["end"].fillna(False).astype(bool) if "end" in pdf else pd.Series(False, index=pdf.index)
        given = pdf[~end].sort_values(self.order)
        out = self.take(key[0], given) if len(given) else []
        if end.any():
            out += self.flush(key[0])
        self._timer(None if end.any() else timerValues.getCurrentProcessingTimeInMs())
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._frame(key, self.flush(key[0]))

    def close(self) -> None:
        pass


def _processed(frames: DataFrame, processor: Video, schema: str) -> DataFrame:
    spark = frames.sparkSession
    if spark.conf.get(_STORE, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(_STORE, ""):
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor.columns = [c.split()[0] for c in schema.split(", ")]
    return frames.groupBy("video_id").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


SLOTS = "video_id long, slot long, n long"


class Sampler(Video):
    """Holds a video's last frame: its number, its first slot and the slot where it ends."""

    order = "n"

    def __init__(self, fps: float, silence_ms: int):
        super().__init__(silence_ms)
        self.fps = fps

    def open(self, handle):
        self.last = handle.getValueState("last", "t0 long, n long, first long, until long")

    def _slots(self, us: np.ndarray) -> np.ndarray:
        return np.floor(us * self.fps / 1e6 + 0.5 + K.ROUND_EPS).astype(np.int64)

    def take(self, key, rows):
        ts, dur, n = (rows[c].to_numpy(np.int64) for c in ("ts_us", "dur_us", "n"))
        held = self.last.get()
        t0 = held[0] if held else int(ts[0])
        first = self._slots(ts - t0)
        if held:
            first, n = np.append(held[2], first), np.append(held[1], n)
        first = np.maximum.accumulate(first)
        self.last.update((t0, int(n[-1]), int(first[-1]), int(self._slots(ts[-1:] + dur[-1:] - t0)[0])))
        return self._spans(n[:-1], first[:-1], first[1:])

    def _spans(self, n, first, until) -> list[tuple]:
        """A frame stands in all slots from its own to the next frame's."""
        size = np.maximum(until - first, 0)
        slot = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return list(zip(slot.tolist(), np.repeat(n, size).tolist(), strict=True))

    def flush(self, key):
        held = self.last.get()
        self.last.clear()
        return self._spans(*(np.array([held[k]]) for k in (1, 2, 3))) if held else []


def sample(frames: DataFrame, fps: float = K.FPS, silence_ms: int = SILENCE_MS) -> DataFrame:
    """Fixed-rate slots of a stream of (video_id, n, ts_us, dur_us, end). One frame is held per video."""
    return _processed(frames, Sampler(fps, silence_ms), SLOTS)


SEGMENTED = "video_id long, idx int, cat string, seg int"


class Segmenter(Video):
    """Holds whether the last frame was a boundary, the segment, and whether it has frames."""

    def open(self, handle):
        self.last = handle.getValueState("last", "boundary boolean, seg int, filled boolean")

    def take(self, key, rows):
        before, seg, filled = self.last.get() or (False, 0, False)
        edge = rows["boundary"].to_numpy(bool)
        stays = (rows["cat"] != "loading").to_numpy()
        rise = np.flatnonzero(edge & ~np.append(before, edge[:-1]))
        # a rise opens a segment only if the one before it has frames; bounds cut the rows at the rises
        bounds, numbers = np.append(np.append(0, rise), len(rows)), np.empty(len(rows), np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a in rise and filled:
                seg, filled = seg + 1, False
            numbers[a:b] = seg
            filled = filled or bool(stays[a:b].any())
        self.last.update((bool(edge[-1]), int(seg), bool(filled)))
        return [(int(i), c, int(s)) for i, c, s in zip(rows["idx"][stays], rows["cat"][stays], numbers[stays], strict=True)]

    def flush(self, key):
        self.last.clear()
        return []


def segment(frames: DataFrame, silence_ms: int = SILENCE_MS) -> DataFrame:
    """Segments of a stream of classified frames (video_id, idx, cat, boundary and, if the source ends videos, end); loading frames go."""
    return _processed(frames, Segmenter(silence_ms), SEGMENTED)


EVENTS = "video_id long, seg int, kind string, idx int, bm double, h long, from_stable boolean, event string, reason string"


class _Cells(MutableMapping):
    """A map state as the cells of a HashIndex."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, cell):
        got = self.state.getValue(cell)
        if got is None:
            raise KeyError(cell)
        return list(got[0])

    def get(self, cell, default=None):
        got = self.state.getValue(cell)
        return default if got is None else list(got[0])

    def __setitem__(self, cell, hashes):
        self.state.updateValue(cell, (list(hashes),))

    def __delitem__(self, cell):
        self.state.removeKey(cell)

    def __iter__(self):
        return iter([tuple(k) for k in self.state.keys()])

    def __len__(self):
        return sum(1 for _ in self.state.keys())


class Selector(Video):
    """Holds the open segment's narrow rows as a list that is only added to, and the hashes selected as a
    map of their bands, of which a frame asks for a fixed number of cells."""

    order = "idx"

    def __init__(self, distance: int, limit: int, silence_ms: int):
        super().__init__(silence_ms)
        self.distance, self.limit = distance, limit

    def open(self, handle):
        self.open_segment = handle.getValueState("segment", "seg int")
        self.rows = handle.getListState("rows", "idx int, cat string, bm double, h long")
        self.cells = handle.getMapState("cells", "band int, bits int", "hashes array<long>")

    def take(self, key, rows):
        out, held = [], self.open_segment.get()
        seg = held[0] if held else None
        for s, part in rows.groupby("seg", sort=True):
            if seg is not None and s != seg:
                out += self._close(seg)
            seg = int(s)
            self.open_segment.update((seg,))
            self.rows.appendList([(int(i), c, float(b), int(h)) for i, c, b, h in zip(part["idx"], part["cat"], part["bm"], part["h"], strict=True)])
        return out

    def _close(self, seg: int) -> list[tuple]:
        rows = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        self.rows.clear()
        last: dict[str, int] = {}
        mail, images = None, []
        for idx, cat, bm, h in sorted(rows):
            stable = cat in last and ((h ^ last[cat]) & (1 << 64) - 1).bit_count() <= K.STABLE_DISTANCE
            last[cat] = h
            item = {"idx": idx, "bm": bm, "h": h, "from_stable": stable}
            if cat == "detail" and (mail is None or (stable, bm) > (mail["from_stable"], mail["bm"])):
                mail = item
            elif cat == "fullscreen_image" and stable:
                images.append(item)
        return close_segments([{"seg": seg, "mail": mail, "images": images}], self.distance, self.limit, HashIndex(self.distance, _Cells(self.cells)))

    def flush(self, key):
        held = self.open_segment.get()
        out = self._close(held[0]) if held else []
        self.open_segment.clear()
        self.cells.clear()
        return out


def select(frames: DataFrame, distance: int = K.DUP_DISTANCE, limit: int = K.MAX_PENDING, silence_ms: int = SILENCE_MS) -> DataFrame:
    """Select events of a stream of (video_id, seg, idx, cat, bm, h, end): a segment's are sent when it closes."""
    frames = frames.fillna({"seg": 0, "idx": 0, "h": 0})  # of end rows; a null would make pandas read hashes as floats
    return _processed(frames, Selector(distance, limit, silence_ms), EVENTS)


DECISIONS = "video_id long, seg int, idx int, i int, dx double, dy double, response double, accepted boolean, reason string, add_rows int, dst_row long, skip int"
_STITCHER = "seg int, i int, height int, width int, gray binary, header int, known boolean, placed long"


def stitch(frames: DataFrame, auto: bool = False, scale: int = 1) -> DataFrame:
    """Stitch decisions of a stream of detail frames (video_id, seg, idx, width, height, n_channels, data, end).

    State per video: the gray frame before, the header and the rows placed; spectra are made anew.
    A new segment starts a new canvas and, with auto, carries the header on. The end row removes
    the state.
    """

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seg, i, before, header, placed, ended, out = None, 0, None, S.Header(auto=auto), 0, False, []
        if state.exists:
            seg, i, h, w, gray, rows, known, placed = state.get
            before, header = np.frombuffer(gray, np.uint8).reshape(h, w), S.Header(rows, auto, known)
        spectra = S.Spectra()
        for f in pd.concat(list(parts)).sort_values(["end", "seg", "idx"]).itertuples(index=False):
            if f.end:
                ended = True
                continue
            if seg != f.seg:
                seg, i, before, placed, spectra = int(f.seg), 0, None, 0, S.Spectra()
                header = header if auto else S.Header()
            gray = P.gray_cv(rgb(f.data, f.height, f.width, f.n_channels)[int(f.height * K.STATUS_BAR) :])
            d = S.step(spectra, i, before, gray, header, scale, scale > 1)
            out.append((key[0], seg, int(f.idx), i, d["dx"], d["dy"], d["response"], d["accepted"], d["reason"], d["add_rows"], placed, d["skip"]))
            placed += d["add_rows"]
            before, i = gray, i + 1
        if ended:
            if state.exists:
                state.remove()
        elif before is not None:
            state.update((seg, i, *before.shape, before.tobytes(), header.rows, header.known, placed))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])

    return frames.groupBy("video_id").applyInPandasWithState(run, DECISIONS, _STITCHER, "append", GroupStateTimeout.NoTimeout)


ATTEMPTS = "video_id long, seg int, idx int, attempt int, timestamp string, sender string, error boolean"
_WAITING = "rows array<struct<seg:int,idx:int,crop:binary>>, segments array<struct<seg:int,tries:int,last:int,found:boolean,dropped:int>>, failures int, stopped boolean"


def recognition(frames: DataFrame, recognise: Callable[[bytes], tuple[str | None, str | None]], crop: Callable | None = None, per_batch: int = 8) -> DataFrame:
    """Recognises frames (video_id, seg, idx, crop or pixel columns, end) of a stream; one row per attempt.

    recognise takes a crop and gives (time stamp or None, sender or None); an exception is a failed
    attempt. Its answer goes back into the state at once, so a segment stops at its first time
    stamp. In every micro-batch at most per_batch frames of a video are tried, lowest segment first;
    at the end row all that wait are, and the state goes. crop makes the image of a frame (a row)
    and is called for frames that the state admits only; without it the rows bring a column `crop`.
    """

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = Waiting()
        if state.exists:
            rows, segments, w.failures, w.stopped = state.get
            w.rows = [tuple(r) for r in rows]
            w.segments = {s[0]: Segment(*s[1:]) for s in map(tuple, segments)}
        ended, out = False, []
        for f in pd.concat(list(parts)).sort_values(["end", "seg", "idx"]).itertuples(index=False):
            if f.end:
                ended = True
            else:
                w.offer(int(f.seg), int(f.idx), (lambda f=f: crop(f)) if crop else f.crop)
        while (ended or len(out) < per_batch) and (got := w.take()):
            seg, idx, image, attempt = got
            stamp = sender = None
            error = False
            try:
                stamp, sender = recognise(image)
            except Exception:  # a recogniser's failure is an outcome, not an end of the stream
                error = True
            w.told(seg, stamp is not None, error)
            out.append((key[0], seg, idx, attempt, stamp, sender, error))
        if not ended:
            state.update((w.rows, [(k, s.tries, s.last, s.found, s.dropped) for k, s in w.segments.items()], w.failures, w.stopped))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ATTEMPTS.split(", ")]).astype({"timestamp": object, "sender": object})

    return frames.groupBy("video_id").applyInPandasWithState(run, ATTEMPTS, _WAITING, "append", GroupStateTimeout.NoTimeout)
