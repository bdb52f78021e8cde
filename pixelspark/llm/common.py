"""What the corpus operators share: the cluster's folder, staged tables and table access."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: the space and the controls 0x09 to 0x0D.
SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Where that is unset, one is made if all runs on
    this machine; on a cluster executors would write to disks of their own, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pixelspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") if "://" in found else "file://" + found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii_bytes(raw: bytes) -> bytes:
    """The same for UTF-8 bytes: bytes.lower() changes A to Z alone."""
    return raw.lower()


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as decimal text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


#: Bits of a bitmap of keys: 4 MiB when all are set, whatever the input.
FILTER_BITS = 1 << 25


def flagged(rows: DataFrame, keys: DataFrame, own: Column, key: Column, out: str) -> DataFrame:
    """``rows`` with column ``out``: false only where no row of ``keys`` has the hash (``key``) that the row has
    (``own``). The hashes of ``keys`` are broadcast as a bitmap of fixed size; how full it is sets how many are true
    for no reason, so what must be exact is joined after that, without the bulk of the rows."""
    slot = F.pmod(key, F.lit(FILTER_BITS)) + 1
    marks = keys.select(slot.alias("__slot"))
    bitmap = marks.groupBy(F.bitmap_bucket_number("__slot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bitmap"))
    spot = F.pmod(own, F.lit(FILTER_BITS)) + 1
    position = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("__bitmap", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (position % 8 + 1).cast("int"))
    marked = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(spot) == F.col("__bucket"), "left")
    return marked.select(*[F.col(f"`{x}`") for x in rows.columns], F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False)).alias(out))


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short runs of rows, so that what Python holds of their texts at once is small. Where these are
    the work, nothing is kept from another's tasks."""
    drop_kept()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release_memory()


_kept: dict[Hashable, Any] = {}


def kept(name: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives: a worker process keeps it for its next tasks, until they ask for another or are of an
    operator that keeps nothing. Python workers live on, so what one stage has kept would burden all later ones."""
    if name not in _kept:
        drop_kept()
        _kept[name] = make()
    return _kept[name]


def drop_kept() -> None:
    """Lets go of what the worker process has kept, and gives its memory back."""
    if _kept:
        _kept.clear()
        release_memory()


def release_memory() -> None:
    """Gives what a task has freed back to the system: Python workers live on, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has no such call
