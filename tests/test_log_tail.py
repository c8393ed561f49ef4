"""Live logs: every line once, torn tails wait, ranges cut lines anywhere."""

import json

import pytest
from pyspark.errors import StreamingQueryException

from refrain.operators import votes as V
from refrain.sources.log_tail import LineRange, lines_of, stream_log_lines
from refrain.streaming.votes import stream_loop_votes


class Sink:
    """Collected rows by batch."""

    def __init__(self):
        self.batches = []

    def __call__(self, batch, batch_id):
        self.batches.append(sorted((r.seq.file.rsplit("/", 1)[-1], r.seq.byte, r.value) for r in batch.collect()))


def start(df, sink, tmp_path):
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ckpt").start()


def append(path, text):
    with open(path, "ab") as f:
        f.write(text.encode())


@pytest.mark.parametrize("range_bytes", [9000, 1 << 20])
def test_three_batches_and_a_restart(spark, tmp_path, range_bytes):
    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "a.jsonl", logs / "b.jsonl"
    append(a, "one\ntwö\n\nto")
    (logs / "_hidden").write_text("no\n")
    sink = Sink()
    q = start(stream_log_lines(spark, str(logs), range_bytes=range_bytes), sink, tmp_path)
    try:
        q.processAllAvailable()
        append(a, "rn\r\nfour\n")
        append(b, "x" * 70_000)  # no whole line yet
        q.processAllAvailable()
        append(b, "\nlast\n")
        q.processAllAvailable()
    finally:
        q.stop()
    append(a, "after\n")
    q = start(stream_log_lines(spark, str(logs), range_bytes=range_bytes), sink, tmp_path)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = [b for b in sink.batches if b]
    assert got == [
        [("a.jsonl", 0, "one"), ("a.jsonl", 4, "twö"), ("a.jsonl", 9, "")],
        [("a.jsonl", 10, "torn"), ("a.jsonl", 16, "four")],
        [("b.jsonl", 0, "x" * 70_000), ("b.jsonl", 70_001, "last")],
        [("a.jsonl", 21, "after")],
    ]


def test_every_cut_gives_every_line_once(tmp_path):
    path = tmp_path / "log"
    lines = [b"", b"a", b"bb", b"", b"c" * 20, b"d"]
    data = b"".join(x + b"\n" for x in lines)
    path.write_bytes(b"skipped\n" + data + b"torn")
    first, end = 8, 8 + len(data)
    for width in range(1, len(data) + 2):
        got = []
        for at in range(first, end, width):
            with open(path, "rb", buffering=0) as f:
                got += lines_of(f, LineRange("log", first, end, at, min(at + width, end)))
        assert [x for _, x in got] == lines and [at for at, _ in got] == sorted({at for at, _ in got})


def test_a_file_that_shrinks_ends_the_stream(spark, tmp_path):
    log = tmp_path / "log"
    append(log, "one\ntwo\n")
    q = start(stream_log_lines(spark, str(log)), Sink(), tmp_path)
    try:
        q.processAllAvailable()
        log.write_text("x\n")
        with pytest.raises(StreamingQueryException, match="shrank"):
            q.processAllAvailable()
    finally:
        q.stop()


def test_votes_of_a_live_log(spark, tmp_path):
    vote = {"at": "x", "sourceName": "s", "startSec": 0, "endSec": 8, "bars": 4, "bpm": 120}
    log = tmp_path / "votes.jsonl"
    append(log, json.dumps({**vote, "rating": "good"}) + "\n" + json.dumps({**vote, "rating": "bad"})[:30])
    state = {}

    def keep(batch, batch_id):
        state.update({r.start_units: r.rating for r in batch.collect()})

    df = V.rating_state(stream_loop_votes(spark, str(log)))
    q = df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ckpt").start()
    try:
        q.processAllAvailable()
        assert state == {0: "good"}
        append(log, json.dumps({**vote, "rating": "bad"})[30:] + "\n")
        q.processAllAvailable()
        assert state == {0: "bad"}
    finally:
        q.stop()
