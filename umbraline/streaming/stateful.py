"""Near-duplicate removal, running cost and labels over streams.

``deduplicated`` and ``running_cost`` keep one small state for a key (the row last kept, a sum),
and their rows must come in order from one micro-batch to the next; inside a micro-batch they
are put in order.  The labels of a video are a map with an entry for each track, of which a
micro-batch reads and writes only what it needs; ``labels_in_order`` also takes frames that come
out of order, and keeps those that must wait for others.

Maps as state need the state store in the session that ``with_map_state`` gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from ..model import DedupParams

#: Frames that wait are kept in blocks of so many numbers, of which so many are held at a time: each access to state is a call.
BLOCK = 64
BLOCKS_HELD = 256
#: Numbers of tracks that are read at once; of more, only those that are asked for.
READ_AT_ONCE = 1_000


def deduplicated(frames: DataFrame, params: DedupParams = DedupParams(), key: str = "video", hashes: tuple[str, ...] = ("hash",)) -> DataFrame:
    """``video, i`` and the hashes of the frames kept of a stream of such rows (64-bit hashes).

    A frame is kept if any of its hashes differs by more than the threshold from that of the
    frame kept before, or if that is too far back.
    """
    kind = frames.schema[key].dataType.simpleString()
    fields = ", ".join(f"`{h}` long" for h in hashes)

    def walk(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(parts)).sort_values("i")
        kept = []
        for row in zip(rows["i"].tolist(), *[rows[h].tolist() for h in hashes], strict=True):
            far = last is None or any(((x ^ y) & (2**64 - 1)).bit_count() > params.threshold for x, y in zip(row[1:], last[1:], strict=True))
            if far or row[0] - last[0] >= params.reach:
                last = row
                kept.append((keys[0], *row))
        state.update(last)
        yield pd.DataFrame(kept, columns=[key, "i", *hashes])

    return frames.select(key, "i", *hashes).groupBy(key).applyInPandasWithState(walk, f"`{key}` {kind}, i int, {fields}", f"i int, {fields}", "append", GroupStateTimeout.NoTimeout)


def letters(n: int) -> str:
    """0 is A, 25 is Z, 26 is AA."""
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def with_map_state(spark: SparkSession) -> SparkSession:
    """A session beside ``spark``, of the same application, whose streams may keep maps as state."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


class _Numbers:
    """Numbers of a video's tracks, from 0: few known ones are read at once, and new ones are written together."""

    def __init__(self, state: MapState, used: int) -> None:
        self.state, self.used, self.before = state, used, used
        self.known: dict[str, int] | None = None
        self.new: dict[str, int] = {}

    def of(self, track: str) -> int:
        if self.known is None:
            self.known = {t: n for (t,), (n,) in self.state.iterator()} if 0 < self.before <= READ_AT_ONCE else {}
        if track not in self.known:
            stored = self.state.getValue((track,)) if self.before > READ_AT_ONCE else None
            if stored is None:
                self.new[track] = self.used
                self.used += 1
            self.known[track] = stored[0] if stored is not None else self.new[track]
        return self.known[track]

    def write(self) -> None:
        for track, n in self.new.items():
            self.state.updateValue((track,), (n,))


class _Waiting:
    """A video's frames that wait, in blocks of the state: those in use are held, and written once they are many or at the end."""

    def __init__(self, state: MapState) -> None:
        self.state = state
        self.blocks: dict[int, dict[int, list[str]]] = {}
        self.stored: set[int] = set()
        self.changed: set[int] = set()

    def block(self, n: int) -> dict[int, list[str]]:
        if n not in self.blocks:
            if len(self.blocks) >= BLOCKS_HELD:
                self.write()
            kept = self.state.getValue((n,))
            if kept is not None:
                self.stored.add(n)
            self.blocks[n] = dict(zip(*kept, strict=True)) if kept is not None else {}
        return self.blocks[n]

    def put(self, frame: int, tracks: list[str]) -> None:
        if frame not in self.block(frame // BLOCK):
            self.blocks[frame // BLOCK][frame] = tracks
            self.changed.add(frame // BLOCK)

    def take(self, frame: int) -> list[str] | None:
        tracks = self.block(frame // BLOCK).pop(frame, None)
        if tracks is not None:
            self.changed.add(frame // BLOCK)
        return tracks

    def rest(self) -> Iterator[tuple[int, list[str]]]:
        """All frames that wait, in order."""
        for n in sorted(self.blocks.keys() | {n for (n,) in self.state.keys()}):
            yield from sorted(self.block(n).items())

    def write(self) -> None:
        for n in self.changed:
            if self.blocks[n]:
                self.state.updateValue((n,), (list(self.blocks[n]), list(self.blocks[n].values())))
            elif n in self.stored:
                self.state.removeKey((n,))
        for held in (self.blocks, self.stored, self.changed):
            held.clear()


class _Letters(StatefulProcessor):
    """A number for each track of a video, in order of first appearance: a map entry each, and their count."""

    def __init__(self, key: str) -> None:
        self.row = Row(key, "frame", "pos", "track", "label")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n int")
        self.numbers = handle.getMapState("numbers", "track string", "n int")

    def read(self) -> _Numbers:
        return _Numbers(self.numbers, (self.count.get() or (0,))[0])

    def keep(self, numbers: _Numbers) -> None:
        if numbers.new:
            numbers.write()
            self.count.update((numbers.used,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        numbers = self.read()
        for frame, pos, track in sorted((r["frame"], r["pos"], r["track"]) for r in rows):
            yield self.row(key[0], frame, pos, track, letters(numbers.of(track)))
        self.keep(numbers)

    def close(self) -> None:
        pass


class _LettersInOrder(_Letters):
    """The same for whole frames in any order, each of which waits for all frames before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.place = handle.getValueState("place", "next int, closed boolean")
        self.waiting = handle.getMapState("waiting", "block int", "frames array<int>, tracks array<array<string>>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        place = self.place.get()
        due, closed = place or (None, False)
        if closed:
            return
        numbers = self.read() if place is not None else _Numbers(self.numbers, 0)
        waiting, end = _Waiting(self.waiting), None
        for row in rows:
            if row["type"] == "frame":
                if due is None or row["frame"] >= due:
                    waiting.put(row["frame"], list(row["tracks"] or []))
            elif row["type"] == "start":
                due = row["frame"] if due is None else due
            elif row["type"] in ("done", "error"):
                end = "error" if "error" in (end, row["type"]) else "done"
            while due is not None and (tracks := waiting.take(due)) is not None:
                yield from self._frame(key, due, tracks, numbers)
                due += 1
        if end == "done":
            for frame, tracks in waiting.rest():
                yield from self._frame(key, frame, tracks, numbers)
        if end is not None:
            # A closed video needs nothing but the fact that it is closed.
            self.waiting.clear()
            self.numbers.clear()
            self.count.clear()
        else:
            waiting.write()
            self.keep(numbers)
        self.place.update((due, end is not None))

    def _frame(self, key: tuple, frame: int, tracks: list[str], numbers: _Numbers) -> Iterator[Row]:
        for pos, track in enumerate(tracks):
            if track:
                yield self.row(key[0], frame, pos, track, letters(numbers.of(track)))


def first_labels(boxes: DataFrame, key: str = "video") -> DataFrame:
    """``video, frame, pos, track, label`` of a stream of tracked boxes: a letter for each track, in order of first appearance.

    Frames come in order from one micro-batch to the next.  Boxes without a track are left out.
    """
    kind = boxes.schema[key].dataType.simpleString()
    tracked = boxes.select(key, "frame", "pos", "track").where("track <> ''")
    return tracked.groupBy(key).transformWithState(_Letters(key), f"`{key}` {kind}, frame int, pos int, track string, label string", "Append", "None")


def labels_in_order(events: DataFrame, key: str = "video") -> DataFrame:
    """``video, frame, pos, track, label`` of a stream of events ``video, type, frame, tracks``.

    A ``frame`` event is one frame with the tracks of its boxes, by position; frames come in any
    order.  A ``start`` event says which frame is the first.  From there each frame is given out as
    soon as all before it are, and so gets the letters that it would get in order; until
    then it waits as state.  ``done`` gives out what still waits, across frames that are missing,
    and ``error`` drops it (what was given out before stays); both close the video, and
    are obeyed after the frames of their own micro-batch.  Repeated frames, frames before the
    first one and events of a closed video change nothing.  Boxes without a track get no row.
    """
    kind = events.schema[key].dataType.simpleString()
    read = events.select(key, "type", F.col("frame").cast("int").alias("frame"), "tracks").where("type in ('start', 'done', 'error') or (type = 'frame' and frame is not null)")
    return read.groupBy(key).transformWithState(_LettersInOrder(key), f"`{key}` {kind}, frame int, pos int, track string, label string", "Append", "None")


def running_cost(calls: DataFrame, key: str = "run") -> DataFrame:
    """``run, seq, micro_usd, running_micro_usd`` of a stream of ``run, seq, micro_usd``."""
    kind = calls.schema[key].dataType.simpleString()

    def add(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("seq")[["seq", "micro_usd"]]
        total = rows["micro_usd"].cumsum() + before
        state.update((int(total.iloc[-1]),))
        yield pd.DataFrame({key: keys[0], "seq": rows["seq"], "micro_usd": rows["micro_usd"], "running_micro_usd": total})

    return calls.select(key, "seq", "micro_usd").groupBy(key).applyInPandasWithState(add, f"`{key}` {kind}, seq long, micro_usd long, running_micro_usd long", "total long", "append", GroupStateTimeout.NoTimeout)


def to_events(rows: DataFrame, path: str, checkpoint: str):
    """Start writing a stream as newline-delimited JSON, each micro-batch as it comes."""
    text = rows.select(F.to_json(F.struct(*[f"`{c}`" for c in rows.columns])).alias("value"))
    return text.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).start()
