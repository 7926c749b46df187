"""The library from SQL and from `spark.read`: a table function that joins runs, and a reader of a folder of texts.

    register(spark)
    spark.sql("SELECT * FROM bridged_runs(TABLE(runs) PARTITION BY (doc_id, source_id) ORDER BY (`start`, less, source_start), 2)")
    spark.read.format("inkwell_library").load("file:///texts").where("kind = 'md'")
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.functions import udtf

RUNS = "doc_id bigint, source_id bigint, `start` bigint, `end` bigint, source_start bigint, words bigint"


@udtf(returnType=RUNS)
class BridgedRuns:
    """Rows of one document and source, in order of (start, longest first, source_start): neighbours that go on in both texts
    after at most max_gap words become one run; runs inside the one before fall out. Holds one run at a time."""

    def __init__(self):
        self.last = None

    def eval(self, row, max_gap: int):
        run = [row["doc_id"], row["source_id"], row["start"], row["end"], row["source_start"], row["words"]]
        if self.last is None:
            self.last = run
            return
        _, _, start, end, source_start, words = self.last
        if 0 <= run[2] - end <= max_gap and 0 <= run[4] - (source_start + end - start) <= max_gap:
            self.last[3], self.last[5] = run[3], words + run[5]
        elif not (run[2] < end and run[3] <= end):
            yield tuple(self.last)
            self.last = run

    def terminate(self):
        if self.last is not None:
            yield tuple(self.last)


class Files(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class LibraryReader(DataSourceReader):
    """Texts of a folder of any store that pyarrow opens. Filters on kind and name leave files unread; files go to tasks by size."""

    KINDS = ("txt", "md", "tex")

    def __init__(self, options: dict):
        self.path = options["path"]
        self.task_bytes = int(options.get("taskBytes", 64 << 20))
        self.kinds, self.names = set(self.KINDS), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("kind",), ("name",)):
                yield f
            elif f.attribute == ("kind",):
                self.kinds &= values
            else:
                self.names = values if self.names is None else self.names & values

    def _store(self) -> tuple[pa.fs.FileSystem, str]:
        import pyarrow.fs as fs

        path = "file://" + self.path.removeprefix("file:") if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[Files]:
        import pyarrow.fs as fs

        store, path = self._store()
        found = [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_")) and not f.base_name.lower().startswith("readme")]
        found = [f for f in found if f.extension.lower() in self.kinds and (self.names is None or f.base_name in self.names)]
        out, size = [Files([])], 0
        for f in sorted(found, key=lambda f: f.path):
            if out[-1].paths and size + f.size > self.task_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        for p in partition.paths:
            with store.open_input_stream(p) as f:
                text = f.read().decode("utf-8", "replace")
            name = p.rsplit("/", 1)[-1]
            yield pa.RecordBatch.from_pydict({"path": [p], "name": [name], "kind": [name.rsplit(".", 1)[-1].lower()], "text": [text]})


class Library(DataSource):
    """path, name, kind, text of the text, Markdown and LaTeX files under a folder; options: path, taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "inkwell_library"

    def schema(self) -> str:
        return "path string, name string, kind string, text string"

    def reader(self, schema) -> LibraryReader:
        return LibraryReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the table function and the reader known to a session."""
    spark.udtf.register("bridged_runs", BridgedRuns)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Library)
