"""Folders with a file per key, on a local or mounted disk: written, listed and read
without Spark's work per file.

Spark's writer starts two processes a file there (``chmod`` of the file and of its
checksum, where Hadoop has no native library), and its commit moves every file
again, in the driver.  Its listing infers the types of the folder names by
exceptions, once for the listing and again for the files chosen from it.  Here
tasks open, write and close files themselves; all go to a hidden folder that
takes the place of the old one by a single rename, once every task has ended.  A
listing is a table, and what is chosen from it is opened by tasks.

Everything is as Spark has it: the names of folders, the files that do not count
(hidden, empty), the types of folder columns.  Where it is not plain that it is
(``list_folders`` returns None), Spark does the work.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import local_path, scratch_path

# What Spark escapes in the names of partition folders, and its name for no value.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _escaped(name: str) -> str:
    return _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name)


def on_disk(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system names it, or None where it is not on a
    disk of this machine (or mounted there)."""
    try:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    except Exception:  # no JVM access (e.g. Spark Connect): where a bare path leads is not known
        return None
    bare = not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path)
    return local_path(path) if path.startswith("file:") or bare and default.startswith("file:") else None


def write_folders(rows: DataFrame, key_col: str, order_col: str, value_col: str, path: str) -> None:
    """``value_col`` of ``rows``, one line a row in the order of ``order_col``, in a file
    per key; replaces the folder ``path`` (as the operating system names it).  A
    file is written row by row.  Until the end the old folder stays; after a
    failure, too.

    The rows of a key meet in a task by a hash of it.  A shuffle by the key itself
    Spark may leave out above a join by that key, and then deal a large partition
    of the join to several tasks."""
    job = uuid.uuid4().hex
    staging = os.path.join(os.path.dirname(path), f".writing-{job}")  # hidden from listings
    prefix = f"{_escaped(key_col)}="

    def run(batches):
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{job}.c000.txt"
        unfinished = f".{name}.{task.taskAttemptId()}"       # another attempt of the task may be writing, too
        files, key, folder, out = 0, None, None, None
        try:
            for b in batches:
                lines = b.column(1).cast(pa.large_binary())
                ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + len(lines) + 1].tolist()
                data = memoryview(lines.buffers()[2] or b"")
                runs = pc.run_end_encode(b.column(0).cast(pa.large_binary()), run_end_type=pa.int64())
                begin = 0
                for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    if out is None or value != key:
                        if out is not None:
                            out.close()
                            os.replace(os.path.join(folder, unfinished), os.path.join(folder, name))
                        key, files = value, files + 1
                        folder = os.path.join(staging, prefix + (_escaped((value or b"").decode("utf-8", "replace")) or _NO_VALUE))
                        try:
                            os.mkdir(folder)
                        except FileExistsError:
                            pass
                        out = open(os.path.join(folder, unfinished), "wb")
                    out.write(data[ends[begin]:ends[end]])
                    begin = end
            if out is not None:
                out.close()
                os.replace(os.path.join(folder, unfinished), os.path.join(folder, name))
        except BaseException:
            if out is not None and not out.closed:
                out.close()
                os.unlink(os.path.join(folder, unfinished))
            raise
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    os.makedirs(staging)
    try:
        line = F.concat(F.coalesce(F.col(value_col), F.lit("")), F.lit("\n"))
        tasks = (rows.select(key_col, order_col, line.alias("_line"))
                 .repartition(F.xxhash64(key_col)).sortWithinPartitions(key_col, order_col)
                 .select(F.col(key_col).cast("string"), "_line").mapInArrow(run, "files long").collect())
        if sum(t["files"] for t in tasks) != len(os.listdir(staging)):
            raise RuntimeError(f"{path}: not one file per {key_col}, or tasks write to another disk")
        open(os.path.join(staging, "_SUCCESS"), "wb").close()
        if os.path.isdir(path):
            shutil.rmtree(path)
        os.rename(staging, path)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise


# --- listing -----------------------------------------------------------------

_SCANNED, _THREADS = 10_000, 4  # folders looked into at a time, by so many threads (a mounted disk answers late)


def _unescaped(name: str) -> str:
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name)


def _counts(name: str) -> bool:
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


class _NotPlain(Exception):
    pass


class _Kind:
    """The type that Spark infers from the values of one folder column, where
    they are whole numbers or texts that are plainly nothing else."""

    WHOLE = re.compile(r"-?[0-9]{1,18}")
    TEXT = re.compile(r"(?!T[0-9]|nan$|inf|epoch$|now$|today$|tomorrow$|yesterday$)[A-Za-z][A-Za-z0-9_.-]*|[0-9]+(?:-[0-9]+)*_[0-9]+(?:-[0-9]+)*", re.IGNORECASE)

    def __init__(self):
        self.most, self.least, self.text = 0, 0, False

    def see(self, value: str) -> None:
        if self.WHOLE.fullmatch(value):
            self.most, self.least = max(self.most, int(value)), min(self.least, int(value))
        elif self.TEXT.fullmatch(value):
            self.text = True
        else:
            raise _NotPlain(value)

    def name(self) -> str:
        if self.text:
            return "string"
        return "int" if -2**31 <= self.least and self.most < 2**31 else "bigint"


def _scan(folder: str) -> tuple[list[str], list[str]]:
    """Folders and files that count, directly below ``folder``."""
    folders, files = [], []
    with os.scandir(folder) as found:
        for e in found:
            if e.name.startswith(("_metadata", "_common_metadata")):
                raise _NotPlain(e.name)
            if _counts(e.name):
                if e.is_dir():
                    folders.append(e.name)
                elif e.stat().st_size:
                    files.append(e.name)
    return folders, files


def _scan_all(folders: list[str]) -> list[tuple[list[str], list[str]]]:
    return [_scan(f) for f in folders]


def _files(root: str, names: list[str], kinds: list[_Kind]) -> Iterator[list[tuple[str, ...]]]:
    """``(file name, path, value of each folder column)`` in lists; ``names`` and
    ``kinds`` are of the columns met.  Folders of a part are looked into before the
    next part, so what is held is the folders below one part."""
    parts, files_at = [[(root, ())]], None
    with ThreadPoolExecutor(_THREADS) as pool:
        while parts:
            part = parts.pop()
            depth, paths, rows, below = len(part[0][1]), [f for f, _ in part], [], []
            scanned = pool.map(_scan_all, [paths[k::_THREADS] for k in range(_THREADS)])
            found = {f: x for k, xs in enumerate(scanned) for f, x in zip(paths[k::_THREADS], xs)}
            for folder, values in part:
                folders, files = found[folder]
                rows += [(f, f"file:{folder}/{f}", *values) for f in files]
                for name in folders:
                    key, is_column, value = name.partition("=")
                    key, value = _unescaped(key), _unescaped(value)
                    if depth == len(names):
                        names.append(key)
                        kinds.append(_Kind())
                    if not is_column or key != names[depth]:
                        raise _NotPlain(name)
                    kinds[depth].see(value)
                    below.append((f"{folder}/{name}", (*values, value)))
            parts += [below[k:k + _SCANNED] for k in range(0, len(below), _SCANNED)]
            if rows:
                files_at = depth if files_at is None else files_at
                if files_at != depth:
                    raise _NotPlain("files at several depths")
                yield rows
    if files_at is None or files_at != len(names):
        raise _NotPlain("folders without files")


def list_folders(spark: SparkSession, path: str) -> DataFrame | None:
    """Files below ``path``: name, path and folder columns; None where Spark has to list them."""
    root, table = on_disk(spark, path), on_disk(spark, scratch_path(spark, "listing"))
    if not root or not table or re.search(r"[*?\[\]{}\\]", root) or not os.path.isdir(root):
        return None
    names: list[str] = []
    kinds: list[_Kind] = []
    # The columns are known when the first files are met, in the innermost folders.
    writer, file = None, os.path.join(table, "part-0.parquet")
    os.makedirs(table)
    try:
        for rows in _files(root, names, kinds):
            if rows:
                if writer is None:
                    schema = pa.schema([(f"c{k}", pa.string()) for k in range(2 + len(names))])
                    writer = pq.ParquetWriter(file, schema)
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema))
    except (_NotPlain, UnicodeError):
        return None
    finally:
        if writer is not None:
            writer.close()
    if len({n.lower() for n in (*names, "file_name", "path")}) < len(names) + 2:
        return None
    listed = spark.read.parquet(f"file:{table}")
    return listed.select(F.col("c0").alias("file_name"), F.col("c1").alias("path"),
                         *[F.col(f"c{k}").cast(kind.name()).alias(n) for k, (n, kind) in enumerate(zip(names, kinds), 2)])


# --- reading -----------------------------------------------------------------

_SENT = 4 << 20  # bytes of text that leave a task at once


def read_files(chosen: DataFrame, keys: tuple[str, ...], tasks: int) -> DataFrame:
    """``keys`` of ``chosen``, and name and whole text of the file that its ``path`` names."""
    def run(batches):
        for b in batches:
            begin, size, texts = 0, 0, []
            paths = b.column(b.num_columns - 1).to_pylist()
            for k, path in enumerate(paths, 1):
                with open(local_path(path), "rb") as f:
                    texts.append(f.read())
                size += len(texts[-1])
                if size >= _SENT or k == len(paths):
                    names = [os.path.basename(p) for p in paths[begin:k]]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(begin, k - begin) for c in range(b.num_columns - 1)),
                                                      pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=out.names)
                    begin, size, texts = k, 0, []

    given = chosen.select(*keys, "path")
    out = T.StructType([*given.schema.fields[:-1], T.StructField("file_name", T.StringType()), T.StructField("text", T.BinaryType())])
    return given.repartition(tasks, "path").mapInArrow(run, out).withColumn("text", F.col("text").cast("string"))
