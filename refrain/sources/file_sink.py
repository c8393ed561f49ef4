"""One file per row: rendered loops, song documents.

Rows are (name, content).  A task attempt writes its files in a temporary folder of its own;
the job's commit renames those of one attempt per task, so readers see no torn file and a
retried or speculative attempt leaves nothing.  A job that fails removes its temporary files
and no others; one that succeeds says in ``_SUCCESS`` how many files it wrote.  Names are
unique; of rows that repeat a name one file stays.  A file of an earlier job with the same
name is replaced, other files are left alone.  The commit takes one rename per file.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from refrain.sources.files import at

FORMAT = "refrain_files"
SCHEMA = "name string, content binary"
_TEMPORARY = "_temporary"
#: Renames at a time.
_RENAMES = 16


@dataclass
class Written(WriterCommitMessage):
    """What an attempt wrote: ``names[i]`` as the file ``i`` of its folder."""

    folder: str
    names: list[str] = field(default_factory=list)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if schema.names != ["name", "content"]:
            raise ValueError(f"rows must be ({SCHEMA})")
        return FileWriter(self.options["path"])


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, base = at(self.path)
        done = Written(posixpath.join(base, _TEMPORARY, self.job, uuid.uuid4().hex))
        store.create_dir(done.folder, recursive=True)
        for row in iterator:
            name = checked(row["name"])
            with store.open_output_stream(posixpath.join(done.folder, str(len(done.names)))) as f:
                f.write(bytes(row["content"] or b""))
            done.names.append(name)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, base = at(self.path)
        moves = [(posixpath.join(m.folder, str(i)), posixpath.join(base, name)) for m in messages if m for i, name in enumerate(m.names)]
        for folder in {base, *(posixpath.dirname(target) for _, target in moves)}:
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(_RENAMES) as pool:
            for _ in pool.map(lambda move: store.move(*move), moves):
                pass
        self._clean(store, base)
        with store.open_output_stream(posixpath.join(base, "_SUCCESS")) as f:
            f.write(str(len(moves)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*at(self.path))

    def _clean(self, store: fs.FileSystem, base: str) -> None:
        folder = posixpath.join(base, _TEMPORARY, self.job)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)
        parent = posixpath.dirname(folder)
        if store.get_file_info(parent).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(parent)):
            store.delete_dir(parent)


def checked(name: str | None) -> str:
    """The name, if it stays below the folder and is no hidden file."""
    parts = (name or "").split("/")
    if any(p in ("", ".", "..") or p.startswith("_") for p in parts):
        raise ValueError(f"no file name: {name!r}")
    return name


def write_files(df: DataFrame, path: str, name: Column, content: Column) -> None:
    """Write ``content`` (binary or string) of each row as the file ``name`` below ``path``."""
    df.sparkSession.dataSource.register(FileSink)
    df.select(name.alias("name"), content.cast("binary").alias("content")).write.format(FORMAT).mode("append").option("path", path).save()


def write_loops(rendered: DataFrame, path: str) -> None:
    """Rendered loops as ``<song>/<loop>.wav``."""
    write_files(rendered, path, F.concat_ws("/", "song_id", F.concat("cand_id", F.lit(".wav"))), F.col("content"))


def write_documents(documents: DataFrame, path: str, id_col: str = "song_id") -> None:
    """Each row as the JSON file ``<id>.json``; nulls are left out."""
    write_files(documents, path, F.concat(F.col(id_col), F.lit(".json")), F.to_json(F.struct(*documents.columns)))
