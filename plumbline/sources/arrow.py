"""Arrow IPC (Feather) files as a Spark data source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.session import InputError, cut, ship
from plumbline.sources.listing import headers, listed, merged, plain_path, tasks_for

ship(__name__)

BATCHES_PER_TASK = 64
LARGE_FILE = 256 * 1024 * 1024
SUFFIXES = (".feather", ".arrow")


def files_under(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the matching files of a folder."""
    from pyarrow import fs
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise InputError(f"there is nothing at '{path}'")
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffixes))


def open_file(path: str):
    from pyarrow import fs
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(root)


def create_file(path: str):
    """A new file, with its folders, wherever the path points."""
    from pyarrow import fs
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    system.create_dir(root.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(root)


def _header(path: str) -> tuple[bytes, int]:
    """The schema of a file as bytes, and its number of record batches."""
    import pyarrow as pa
    with open_file(path) as handle:
        reader = pa.ipc.open_file(handle)
        return reader.schema.remove_metadata().serialize().to_pybytes(), reader.num_record_batches


def _unified(headers: list[bytes]) -> bytes:
    """The columns of all schemas, in the order they are met; numbers of one column take the wider type."""
    import pyarrow as pa
    return pa.unify_schemas([pa.ipc.read_schema(pa.py_buffer(h)) for h in headers], promote_options="permissive").serialize().to_pybytes()


def _batches(path: str, first: int, last: int, schema) -> Iterator:
    """Record batches of a file with the columns of `schema`; those it lacks are missing."""
    import pyarrow as pa
    with open_file(path) as handle:
        reader = pa.ipc.open_file(handle)
        for i in range(first, last):
            batch = reader.get_batch(i)
            there = set(batch.schema.names)
            columns = [batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """All Arrow files under a path with the columns of all of them.

    Tasks read the schemas and then stretches of record batches; the driver
    sees neither a file nor the list of them."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    found = headers(listed(spark, path, SUFFIXES), _header, "arrow_headers")
    whole = merged(found, _unified)
    if whole is None:
        raise InputError(f"there are no Arrow files under '{path}'")
    schema = pa.ipc.read_schema(pa.py_buffer(whole))
    starts = F.when(F.col("parts") > 0, F.sequence(F.lit(0), F.col("parts") - 1, F.lit(BATCHES_PER_TASK))).otherwise(F.array().cast("array<bigint>"))
    pieces = cut(found.select("path", "parts", F.explode(starts).alias("first")), "arrow_pieces")

    def read(batches: Iterator) -> Iterator:
        for batch in batches:
            for at, parts, first in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _batches(plain_path(at), first, min(first + BATCHES_PER_TASK, parts), schema)

    tasks = tasks_for(spark, found, pieces.count())
    return pieces.repartition(tasks, "path", "first").mapInArrow(read, from_arrow_schema(schema))


class Stretch(InputPartition):
    def __init__(self, path: str, first: int, last: int | None):
        self.path, self.first, self.last = path, first, last


class ArrowReader(DataSourceReader):
    """One task per file; a large file is cut into stretches of record batches."""

    def __init__(self, path: str, schema):
        self.path, self.schema = path, schema

    def partitions(self):
        import pyarrow as pa
        parts = []
        for path, size in files_under(self.path, SUFFIXES):
            if size < LARGE_FILE:
                parts.append(Stretch(path, 0, None))
                continue
            with open_file(path) as handle:
                batches = pa.ipc.open_file(handle).num_record_batches
            parts += [Stretch(path, i, min(i + BATCHES_PER_TASK, batches)) for i in range(0, batches, BATCHES_PER_TASK)]
        return parts

    def read(self, part):
        last = _header(part.path)[1] if part.last is None else part.last
        yield from _batches(part.path, part.first, last, self.schema)


class ArrowFiles(DataSource):
    """The same files for `spark.read.format`; its schema is read on the driver, file by file."""

    @classmethod
    def name(cls):
        return "plumbline_arrow"

    def _union(self):
        """The columns of all files, in the order they are met; numbers of one column take the wider type."""
        import pyarrow as pa
        found = files_under(self.options["path"], SUFFIXES)
        if not found:
            raise InputError(f"there are no Arrow files under '{self.options['path']}'")
        return pa.ipc.read_schema(pa.py_buffer(_unified([_header(path)[0] for path, _ in found])))

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema
        return from_arrow_schema(self._union())

    def reader(self, schema):
        return ArrowReader(self.options["path"], self._union())
