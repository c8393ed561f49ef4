"""One file per row: retries replace their own files, failed jobs leave none."""

import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from refrain.plans.song_map import write_song_maps
from refrain.sources.file_sink import FileWriter, write_files, write_loops


def files(folder):
    """Visible files; a task that is killed late may leave a draft in the hidden folder."""
    found = {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file()}
    return {n: b for n, b in found.items() if not n.startswith("_temporary/")}


def test_a_file_per_loop(spark, tmp_path):
    rows = [(f"s{i % 7}", f"l{i}", bytearray([i, 0, 255])) for i in range(100)]
    write_loops(spark.createDataFrame(rows, "song_id string, cand_id string, content binary").repartition(5), str(tmp_path / "out"))
    got = files(tmp_path / "out")
    assert got.pop("_SUCCESS") == b"100"
    assert got == {f"{s}/{c}.wav": bytes(b) for s, c, b in rows}
    assert not (tmp_path / "out" / "_temporary").exists()


def test_a_retried_task_leaves_one_file_per_row(tmp_path):
    writer = FileWriter(str(tmp_path))
    rows = [{"name": f"a/{i}.wav", "content": b"x" * i} for i in range(4)]

    def broken():
        yield from rows[:2]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    _, second = writer.write(iter(rows)), writer.write(iter(rows))  # a retry, and a speculative copy
    writer.commit([second, None])
    got = files(tmp_path)
    assert got.pop("_SUCCESS") == b"4" and got == {r["name"]: r["content"] for r in rows}
    assert not (tmp_path / "_temporary").exists()
    later = FileWriter(str(tmp_path))
    later.abort([later.write(iter(rows)), None])
    assert got == {r["name"]: r["content"] for r in rows} and not (tmp_path / "_temporary").exists()


def test_a_failed_job_leaves_no_files(spark, tmp_path):
    df = spark.range(40, numPartitions=4).withColumn("c", F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")))
    with pytest.raises(PySparkException):
        write_files(df, str(tmp_path), F.concat(F.col("id").cast("string"), F.lit(".txt")), F.col("c"))
    assert files(tmp_path) == {}


@pytest.mark.parametrize("name", ["", "../x", "/x", "a//b", "_temporary/x", None])
def test_names_stay_below_the_folder(tmp_path, name):
    with pytest.raises(ValueError, match="no file name"):
        FileWriter(str(tmp_path)).write(iter([{"name": name, "content": b""}]))


def test_empty_and_null_contents(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", bytearray())], "name string, content binary")
    write_files(df, str(tmp_path), F.col("name"), F.col("content"))
    write_files(df.where("false"), str(tmp_path / "none"), F.col("name"), F.col("content"))
    assert files(tmp_path) == {"a": b"", "b": b"", "_SUCCESS": b"2", "none/_SUCCESS": b"0"}


def test_song_documents(spark, tmp_path):
    maps = spark.createDataFrame([("one", 1.5, [1, 2]), ("two", None, [])], "song_id string, durationSec double, beats array<int>")
    write_song_maps(maps, str(tmp_path))
    assert {n: json.loads(b) for n, b in files(tmp_path).items() if n != "_SUCCESS"} == {
        "one.json": {"song_id": "one", "durationSec": 1.5, "beats": [1, 2]}, "two.json": {"song_id": "two", "beats": []}
    }
