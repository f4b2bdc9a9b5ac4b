from __future__ import annotations

import random

from pyspark.sql import functions as F

from umbraline.model import DedupParams
from umbraline.operators import sequence
from umbraline.streaming import stateful


def _stream(spark, rows, path, schema, batches):
    each = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * each : (k + 1) * each], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _all(query_frame, name, spark):
    query = query_frame.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return query_frame.sparkSession.table(name)


def test_stream_keeps_what_the_batch_keeps(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted(((v, i, rng.getrandbits(4)) for v in ("a", "b") for i in range(40)), key=lambda r: (r[1], r[0]))
    schema = "video string, i int, hash long"
    got = _all(stateful.deduplicated(_stream(spark, rows, tmp_path / "in", schema, 4), DedupParams(1, 1)), "kept_rows", spark)
    want = sequence.deduplicated(spark.createDataFrame(rows, schema), lambda a, b: F.bit_count(a["hash"].bitwiseXOR(b["hash"])) > 1, DedupParams(1, 1))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_cost_over_batches(spark, tmp_path):
    rows = [("r", n, n + 1) for n in range(10)] + [("s", 10, 5)]
    got = _all(stateful.running_cost(_stream(spark, rows, tmp_path / "in", "run string, seq long, micro_usd long", 3)), "cost_rows", spark)
    assert sorted((r["run"], r["seq"], r["running_micro_usd"]) for r in got.collect()) == [("r", n, (n + 1) * (n + 2) // 2) for n in range(10)] + [("s", 10, 5)]
    parts = spark.readStream.schema("run string, seq long, micro_usd long").parquet(str(tmp_path / "in"))
    query = stateful.to_events(parts, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.text(str(tmp_path / "out")).count() == 11


def test_two_hashes_and_first_labels(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted(((v, i, rng.getrandbits(4), rng.getrandbits(4)) for v in ("a", "b") for i in range(30)), key=lambda r: (r[1], r[0]))
    schema = "video string, i int, p long, q long"
    got = _all(stateful.deduplicated(_stream(spark, rows, tmp_path / "two", schema, 3), DedupParams(2, 1), hashes=("p", "q")), "two_rows", spark)
    far = lambda a, b, k: F.bit_count(a[k].bitwiseXOR(b[k])) > 2
    want = sequence.deduplicated(spark.createDataFrame(rows, schema), lambda a, b: far(a, b, "p") | far(a, b, "q"), DedupParams(2, 1))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    boxes = [("v", f, p, f"t{(f * 3 + p) % 30}") for f in range(20) for p in range(2)]
    got = _all(stateful.first_labels(_stream(stateful.with_map_state(spark), boxes, tmp_path / "labels", "video string, frame int, pos int, track string", 3)), "label_rows", spark)
    order = list(dict.fromkeys(b[3] for b in boxes))
    assert {(r["frame"], r["pos"]): r["label"] for r in got.collect()} == {(f, p): stateful.letters(order.index(t)) for _, f, p, t in boxes}


EVENTS = "video string, type string, frame int, tracks array<string>"


def _labels(spark, batches, path, name):
    session = stateful.with_map_state(spark)
    for k, rows in enumerate(batches):
        session.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{path}/{k}")
    read = session.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))
    return sorted((r["video"], r["frame"], r["pos"], r["track"], r["label"]) for r in _all(stateful.labels_in_order(read), name, spark).collect())


def _in_order(frames):
    """What labelling the frames one after the other gives."""
    out, known = [], {}
    for video, frame, tracks in sorted(frames):
        names = known.setdefault(video, {})
        for pos, track in enumerate(tracks):
            if track:
                out.append((video, frame, pos, track, stateful.letters(names.setdefault(track, len(names)))))
    return out


def test_labels_of_frames_that_come_out_of_order(spark, tmp_path):
    rng = random.Random(31)
    # Frame 7 of "b" never comes; "a" ends; both bear null, empty and repeated tracks.
    frames = [(v, f, [rng.choice(["", None, *(f"t{n}" for n in range(40))]) for _ in range(rng.randrange(4))]) for v in "ab" for f in range(3, 23) if (v, f) != ("b", 7)]
    events = [(v, "frame", f, t) for v, f, t in frames]
    rng.shuffle(events)
    events.insert(9, ("a", "start", 3, None))
    events.insert(30, ("b", "start", 3, None))
    batches = [events[k : k + 11] for k in range(0, len(events), 11)]
    batches.append([events[0], ("a", "frame", 1, ["early"]), ("a", "done", None, None), ("b", "done", None, None)])
    batches.append([("a", "frame", 99, ["late"]), ("b", "frame", 7, ["late"])])
    assert _labels(spark, batches, tmp_path / "ordered", "ordered_rows") == _in_order(frames)


def test_error_drops_what_waits_and_an_open_video_keeps_it(spark, tmp_path):
    batches = [
        [("a", "start", 1, None), ("a", "frame", 1, ["x"]), ("a", "frame", 3, ["z"]), ("b", "start", 1, None), ("b", "frame", 2, ["q"]), ("c", "frame", 1, ["m"])],
        [("a", "frame", 2, ["y", "x"]), ("a", "frame", 5, ["w"]), ("a", "error", None, None), ("b", "frame", 1, ["p"]), ("c", "other", 1, None)],
        [("a", "frame", 4, ["u"]), ("b", "frame", 4, ["r"])],
    ]
    got = _labels(spark, batches, tmp_path / "failed", "failed_rows")
    assert got == [("a", 1, 0, "x", "A"), ("a", 2, 0, "y", "B"), ("a", 2, 1, "x", "A"), ("a", 3, 0, "z", "C"), ("b", 1, 0, "p", "A"), ("b", 2, 0, "q", "B")]


class _State:
    """A value or map in memory that counts how often it is asked."""

    def __init__(self, calls):
        self.calls, self.data = calls, {}

    def _called(self, answer):
        self.calls[0] += 1
        return answer

    def get(self):
        return self._called(self.data.get(()))

    def exists(self):
        return self._called(() in self.data)

    def update(self, value):
        self._called(self.data.update({(): value}))

    def getValue(self, key):
        return self._called(self.data.get(key))

    def containsKey(self, key):
        return self._called(key in self.data)

    def updateValue(self, key, value):
        self._called(self.data.update({key: value}))

    def removeKey(self, key):
        self._called(self.data.pop(key))

    def keys(self):
        return self._called(iter(list(self.data)))

    def iterator(self):
        return self._called(iter(list(self.data.items())))

    def clear(self):
        self._called(self.data.clear())


class _Handle:
    def __init__(self):
        self.calls, self.states = [0], []

    def getValueState(self, name, schema):
        self.states.append(_State(self.calls))
        return self.states[-1]

    getMapState = lambda self, name, *schemas: self.getValueState(name, schemas)


def _labelled(batches):
    """Rows of one video's batches of ``type, frame, tracks``, what is left as state, and how often state was asked."""
    handle, processor = _Handle(), stateful._LettersInOrder("video")
    processor.init(handle)
    rows = [tuple(r) for batch in batches for r in processor.handleInputRows(("v",), iter([dict(zip(("type", "frame", "tracks"), e, strict=True)) for e in batch]), None)]
    return rows, handle.states, handle.calls[0]


def test_frames_cost_few_calls_to_state():
    frames = [("v", f, [f"t{(f * k) % 30}" for k in (1, 7)]) for f in range(300) if f % 50 != 49]
    events = [("frame", f, t) for _, f, t in frames]
    rows, _, calls = _labelled([events[::2], [("start", 0, None), *events[1::2]], [("done", None, None)]])
    assert rows == _in_order(frames)
    # Several for each frame and each track before: 1,511.
    assert calls < 100


def test_few_blocks_and_numbers_at_a_time(monkeypatch):
    monkeypatch.setattr(stateful, "BLOCK", 4)
    monkeypatch.setattr(stateful, "BLOCKS_HELD", 2)
    monkeypatch.setattr(stateful, "READ_AT_ONCE", 5)
    for seed in range(30):
        rng = random.Random(seed)
        frames = [("v", f, [rng.choice(["", None, *(f"t{n}" for n in range(40))]) for _ in range(rng.randrange(4))]) for f in range(-9, 60) if rng.random() < 0.9 or f == -9]
        events = [("frame", f, t) for _, f, t in frames] + [("frame", f, ["again"]) for f in range(-9, -5)]
        firsts, again = events[: len(frames)], events[len(frames) :]
        rng.shuffle(firsts)
        firsts.insert(rng.randrange(20), ("start", -9, None))
        batches = [firsts[k : k + 9] for k in range(0, len(firsts), 9)]
        held = {f for _, f, _ in frames}
        batches.insert(len(batches), [e for e in again if e[1] in held])
        rows, states, _ = _labelled([*batches, [("done", None, None)]])
        assert rows == _in_order(frames)
        assert [len(s.data) for s in states] == [0, 0, 1, 0]
        shown, states, _ = _labelled([*batches, [("error", None, None)], [("frame", 70, ["late"])]])
        assert shown == rows[: len(shown)] and [len(s.data) for s in states] == [0, 0, 1, 0]
