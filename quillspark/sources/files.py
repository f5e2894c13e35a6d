"""A sink of one file a row: ``df.select("name", "body").write.format("quill_files").mode("append").save(path)``.

A task writes its files into a folder of its own below ``_pending``; the job's commit moves those folders, whole, to ``path``. So what a
lost or repeated task has written is never seen, and the driver handles one name a task, not one a file. Paths are any that Arrow's
file systems know; a path without a scheme is one that all executors share.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PENDING = "_pending"


def file_name(name: str, taken: set[str]) -> str:
    """``name`` as a file may be called, with a number where a file of the task has that name."""
    safe = re.sub(r"[^\w.\-]+", "_", name).strip(".") or "_"
    stem, dot, end = safe.rpartition(".") if "." in safe else (safe, "", "")
    out, n = safe, 1
    while out in taken:
        out, n = f"{stem}-{n}{dot}{end}", n + 1
    taken.add(out)
    return out


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, rows: Iterator) -> Written:
        system, root = self._system()
        context, taken = TaskContext.get(), set()
        folder = f"part-{context.partitionId():05d}-{self.job}"
        # Two attempts of one task have folders of their own.
        at = f"{root}/{PENDING}/{self.job}/{context.taskAttemptId()}/{folder}"
        for row in rows:
            if not taken:
                system.create_dir(at)
            body = row["body"]
            with system.open_output_stream(f"{at}/{file_name(str(row['name']), taken)}") as out:
                out.write(body.encode() if isinstance(body, str) else bytes(body or b""))
        return Written(f"{context.taskAttemptId()}/{folder}" if taken else "", len(taken))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._system()
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.type == fs.FileType.Directory and old.base_name.startswith("part-"):
                    system.delete_dir(old.path)
        for m in messages:
            if m is not None and m.folder:
                system.move(f"{root}/{PENDING}/{self.job}/{m.folder}", f"{root}/{m.folder.rpartition('/')[2]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = self._system()
        if system.get_file_info(f"{root}/{PENDING}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{PENDING}/{self.job}")
        pending = system.get_file_info(fs.FileSelector(f"{root}/{PENDING}", allow_not_found=True))
        if not pending and system.get_file_info(f"{root}/{PENDING}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{PENDING}")


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not {"name", "body"} <= set(schema.fieldNames()):
            raise ValueError("a file needs the columns name and body")
        return _Writer(self.options["path"], overwrite)


def write_documents(bodies: DataFrame, path: str, extension: str, id_col: str = "doc_id", overwrite: bool = False) -> None:
    """One file for each row of ``chunkset.export_documents``, called by its id; a null body is an empty file."""
    register(bodies.sparkSession)
    name = bodies[id_col].cast("string")
    rows = bodies.select(F.concat(F.coalesce(name, F.lit("null")), F.lit(f".{extension}")).alias("name"), F.coalesce("body", F.lit("")).alias("body"))
    rows.write.format("quill_files").mode("overwrite" if overwrite else "append").save(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesSink)
