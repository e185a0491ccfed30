"""Shared helpers: tables in the cluster's shared folder, words, hashes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a per-task word cache before it is emptied. It bounds memory and never changes a result.
CACHE_ENTRIES = 400_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, unless PYTHONPATH has it there already."""
    package = Path(__file__).resolve().parents[1]
    application = spark.sparkContext.applicationId
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(":") or application in _SHIPPED:
        return
    target = f"{tempfile.mkdtemp()}/{package.name}.zip"  # Spark's own file server sends it on
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(application)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; below the warehouse where that is unset."""
    ship(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return folder.rstrip("/")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again, so that a lost executor costs a read, not a lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of its text column, so that a task holds few Python strings at once."""
    upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(upto // size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives freed memory back to the system at its end: Spark keeps idle Python workers, and what they hold
    counts against the executor in later stages."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library has it


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores added until no column has it; names are compared without case, as Spark does."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. Pure ASCII text takes the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` in UTF-8: bytes.split() splits at just these characters."""
    return text.encode().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's), elementwise."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words; of all words if there are fewer; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    value = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        value = mix(value * GOLDEN + hashes[j : n - width + 1 + j])
    return value
