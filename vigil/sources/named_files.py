"""Spark data sources for files that carry their own names.

``named_files`` writes rows (name, piece): the pieces of one name (a path below the target), which stand together in a partition,
make one file. Tasks write under
a folder of the attempt; ``commit`` moves finished files to their places, ``abort`` drops the folder, so a failed or repeated task
leaves nothing. ``bid_parts`` reads CSV parts under ``<root>/<client>/<date>/raw*``,
some folders to an input partition, and rejects an unreadable file as a whole inside the task.

Files are reached through ``pyarrow.fs``: local and shared folders, HDFS, S3 and GCS paths.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)

PIECES = "name string, piece binary"
BID_PARTS = ("client string, date string, product_id string, prediction double, file_path string, "
             "others map<string,string>")


def file_system(path: str):
    """(file system, path in it)."""
    from pyarrow import fs
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


# ------------------------------------------------------------------ writer

def runs_of_names(batch) -> Iterator[tuple]:
    """(name, bytes) of the rows (name, piece) of one name that stand together: their pieces lie side by side in the batch."""
    import numpy as np
    import pyarrow as pa
    names = batch.column(0)
    pieces = batch.column(1).cast(pa.large_binary())
    code = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[:len(code)])
    _, offsets, data = pieces.buffers()
    ends = np.frombuffer(offsets, np.int64)[pieces.offset:pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
    for a, b in zip(first.tolist(), np.append(first[1:], len(code)).tolist()):
        at, size = int(ends[a]), int(ends[b] - ends[a])
        yield names[a].as_py(), data.slice(at, size) if size else b""


@dataclass
class Attempt(WriterCommitMessage):
    folder: str


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator) -> WriterCommitMessage:
        fs, root = file_system(self.path)
        folder = f"{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(f"{root}/{folder}", recursive=True)
        name, out, done = None, None, set()
        for batch in iterator:
            for run, content in runs_of_names(batch):
                if out is None or run != name:
                    if out is not None:
                        out.close()
                    name = run
                    if name in done or any(p in ("", ".", "..") for p in (name or "").split("/")):
                        raise ValueError(f"not the name of one file: {name!r}")
                    done.add(name)
                    if "/" in name:
                        fs.create_dir(f"{root}/{folder}/{name.rsplit('/', 1)[0]}", recursive=True)
                    out = fs.open_output_stream(f"{root}/{folder}/{name}")
                out.write(content)
        if out is not None:
            out.close()
        return Attempt(folder)

    def commit(self, messages) -> None:
        from pyarrow import fs as pafs
        fs, root = file_system(self.path)
        if self.overwrite:   # what stood there before, when all tasks are done
            for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if info.base_name != self.job:
                    fs.delete_dir(info.path) if info.type == pafs.FileType.Directory else fs.delete_file(info.path)
        for m in messages:
            if m is None:
                continue
            for info in fs.get_file_info(pafs.FileSelector(f"{root}/{m.folder}", recursive=True)):
                name = info.path.split(f"{m.folder}/", 1)[1]
                target = f"{root}/{name}"
                if info.type == pafs.FileType.Directory:
                    fs.create_dir(target, recursive=True)
                    continue
                if fs.get_file_info(target).type != pafs.FileType.NotFound:
                    raise FileExistsError(f"two tasks wrote {name}, or it stands there already")
                fs.move(info.path, target)
        self._drop(fs, root)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        self._drop(*file_system(self.path))

    def _drop(self, fs, root: str) -> None:
        from pyarrow import fs as pafs
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows (name, at, line) as text files, a file's lines in the order of (at, line). One task writes a file."""
    rows = lines.repartition("name").sortWithinPartitions("name", "at", "line")
    write_files(rows.selectExpr("name", "cast(concat(line, '\\n') as binary) as piece"), path, mode)


def write_files(pieces: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows (name, piece) as files of their names in folder ``path``. Pieces of one name must lie in one partition, one after
    the other; a name written twice fails the job, and nothing of it stays."""
    pieces.sparkSession.dataSource.register(NamedFiles)
    pieces.write.format("named_files").mode(mode).save(path)


# ------------------------------------------------------------------ reader

FOLDERS = 8     # folders of an input partition
PART_ROWS = 1 << 16    # rows of a batch


@dataclass
class Folders(InputPartition):
    """(client, date, path) of some folders."""
    folders: list[tuple[str, str, str]]


def parse_part(content: bytes) -> tuple[list[str], list[list[str]]] | None:
    """(header, rows) of a CSV part, or None if it is not readable as a whole: empty, not text, or with a row of more fields
    than its first line. Short rows are filled up with nothing; blank lines are no rows."""
    try:
        rows = [r for r in csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")) if r]
    except (UnicodeDecodeError, csv.Error):
        return None
    if not rows or any(len(r) > len(rows[0]) for r in rows):
        return None
    wide = len(rows[0])
    return [c.strip() for c in rows[0]], [r if len(r) == wide else r + [""] * (wide - len(r)) for r in rows[1:]]


def number(text: str | None) -> float | None:
    try:
        x = float(text or "")
    except ValueError:
        return None
    return None if math.isnan(x) else x


def part_batch(client: str, date: str, path: str, header: list[str], rows: list[list[str]]):
    """``BID_PARTS`` rows of a part as a batch; of columns of one name the last counts, an empty field is none."""
    import numpy as np
    import pyarrow as pa
    n, at = len(rows), {c: i for i, c in enumerate(header)}
    rest = [c for c in at if c not in ("product_id", "prediction")]

    def column(name: str) -> list:
        return [r[at[name]] or None for r in rows] if name in at else [None] * n
    others = pa.MapArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * len(rest)), pa.array(rest * n, pa.string()),
        pa.array([r[at[c]] or None for r in rows for c in rest], pa.string()))
    text = [pa.repeat(pa.scalar(x, pa.string()), n) for x in (client, date, path)]
    return pa.RecordBatch.from_arrays(
        [*text[:2], pa.array(column("product_id"), pa.string()), pa.array([number(x) for x in column("prediction")], pa.float64()),
         text[2], others], ["client", "date", "product_id", "prediction", "file_path", "others"])


class BidPartsReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.client, self.date = options.get("client", "*"), options.get("date", "*")

    def partitions(self) -> list[InputPartition]:
        """Some <client>/<date> folders each; their files are listed in the task."""
        from pyarrow import fs as pafs
        fs, root = file_system(self.root)

        def folders(path: str, pattern: str):
            infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
            return sorted((i for i in infos if i.type == pafs.FileType.Directory and fnmatch.fnmatchcase(i.base_name, pattern)),
                          key=lambda i: i.path)
        found = [(c.base_name, d.base_name, d.path) for c in folders(root, self.client) for d in folders(c.path, self.date)]
        return [Folders(found[i:i + FOLDERS]) for i in range(0, len(found), FOLDERS)]

    def read(self, partition) -> Iterator:
        for client, date, path in partition.folders if partition else []:   # None: no folder at all
            yield from self._folder(client, date, path)

    def _folder(self, client: str, date: str, path: str) -> Iterator:
        from pyarrow import fs as pafs
        fs, _ = file_system(self.root)
        for info in sorted(fs.get_file_info(pafs.FileSelector(path, recursive=True)), key=lambda i: i.path):
            inside = info.path[len(path):].strip("/").split("/")
            if info.type != pafs.FileType.File or len(inside) > 2 or not inside[0].startswith("raw"):
                continue
            with fs.open_input_stream(info.path) as f:
                part = parse_part(f.read())
            if part is None:
                continue
            header, rows = part
            for i in range(0, len(rows), PART_ROWS):
                yield part_batch(client, date, info.path, header, rows[i:i + PART_ROWS])


class BidParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bid_parts"

    def schema(self) -> str:
        return BID_PARTS

    def reader(self, schema) -> DataSourceReader:
        return BidPartsReader(self.options)


def read_parts(spark: SparkSession, root: str, client: str = "*", date: str = "*") -> DataFrame:
    spark.dataSource.register(BidParts)
    return spark.read.format("bid_parts").option("client", client).option("date", date).load(root)


# ------------------------------------------------------------------ whole files

READ_BYTES = 8 << 20    # bytes of contents in a batch, about


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path) of the files that a glob names. Each level of folders is listed in tasks, from the folders of the level before; names
    that begin with ``_`` or a dot are hidden."""
    levels = pattern.split("/")
    at = next((i for i, x in enumerate(levels) if any(c in x for c in "*?[")), len(levels) - 1)
    root = "/".join(levels[:at])
    local = file_system(root)[0].type_name == "local"
    prefix = "file:" if local else root[:len(root) - len(file_system(root)[1])]
    found = spark.createDataFrame([(root,)], "path string")
    for i in range(at, len(levels)):
        # a folder of folders is one row; its children are dealt to all tasks
        found = found.mapInArrow(_listing(levels[i], i == len(levels) - 1, prefix), "path string")
        if i < len(levels) - 1:
            found = found.repartition(spark.sparkContext.defaultParallelism)
    return found


def _listing(name: str, last: bool, prefix: str):
    def listed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs as pafs
        kind = pafs.FileType.File if last else pafs.FileType.Directory
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                fs, path = file_system(folder)
                infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
                yield pa.RecordBatch.from_arrays([pa.array(
                    [prefix + i.path for i in infos if i.type == kind and not i.base_name.startswith(("_", "."))
                     and fnmatch.fnmatchcase(i.base_name, name)], pa.string())], ["path"])
    return listed


def read_contents(paths: DataFrame) -> DataFrame:
    """(doc_id, path, content) of rows (doc_id, path): the bytes of each file, read where the row lies."""
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in held], t) for j, t in enumerate(
                (pa.int64(), pa.string(), pa.binary()))], ["doc_id", "path", "content"])
        for batch in batches:
            held, size = [], 0
            for doc_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, inside = file_system(path)
                with fs.open_input_stream(inside) as f:
                    held.append((doc_id, path, f.read()))
                size += len(held[-1][2])
                if size >= READ_BYTES:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)
    return paths.mapInArrow(read, "doc_id long, path string, content binary")
