"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_BYTES = 3 << 20
#: Rows that Spark hands to Python at once. Rows here are whole documents, of which the default number
#: would take a worker's memory several times.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema with more fields, all nullable; a field of the same name is replaced."""
    new = {name for name, _ in fields}
    kept = [T.StructField(f.name, f.dataType, True) for f in schema if f.name not in new]
    return T.StructType(kept + [T.StructField(name, kind, True) for name, kind in fields])


def crc_fold(id_column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds


def in_arrow(rows: DataFrame, run, schema) -> DataFrame:
    """``rows.mapInArrow`` in batches of at most ``BATCH_ROWS``, which becomes the session's setting unless it is lower."""
    spark = rows.sparkSession
    now = int(spark.conf.get(BATCH_SETTING, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return rows.mapInArrow(run, schema)


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id, text (as string) and the named columns, so that others can have any name."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *more)


def same_row(a: Column, b: Column) -> Column:
    """Null-safe equality, which Spark can join and hash on."""
    return a.eqNullSafe(b)


def slices(batch: pa.RecordBatch, column: str, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch with at most ``limit`` bytes of text each, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # workers live on and share their machine's memory


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with null as empty text."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def list_offsets(lists: pa.Array) -> np.ndarray:
    """Offsets of the lists into ``lists.flatten()``, from 0."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(lengths)))


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values of each row, 0 for an empty one; exact for integers."""
    zero = np.zeros((1, *values.shape[1:]), dtype=values.dtype)
    running = np.concatenate((zero, np.cumsum(values, axis=0, dtype=values.dtype)))
    return running[offsets[1:]] - running[offsets[:-1]]


def mixed(keys: np.ndarray) -> np.ndarray:
    """64-bit finaliser of multiply and shift, so that close keys spread."""
    keys = keys.astype(np.uint64, copy=True)
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0x9E3779B97F4A7C15)
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(32)
    return keys


#: Bits of a hash filter: 2**24 bits are at most 2**18 words, 4 MB, however many keys it has taken.
FILTER_BITS = 24


def _slot(key: Column, bits: int) -> tuple[Column, Column, Column]:
    slot = key.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return F.shiftright(slot, 6).cast("int"), F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int")


def hash_filter(keys: DataFrame, key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """A bit for each hash, in words of 64: at most ``2**bits / 64`` rows, so it may be broadcast."""
    word, one, at = _slot(key, bits)
    return keys.select(word.alias("_word"), F.call_function("shiftleft", one, at).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def perhaps_in(rows: DataFrame, key: Column, filled: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose hash may be among the keys of the filter: all that are, and few others while the
    filter is not full. An exact join follows; this only keeps other rows out of its shuffle."""
    word, one, at = _slot(key, bits)
    hit = (word == F.col("_word")) & (F.col("_bits").bitwiseAND(F.call_function("shiftleft", one, at)) != 0)
    return rows.join(F.broadcast(filled), hit, "left_semi")


#: A group with this part of all rows or more is joined by broadcast; there can't be more such groups than this.
HOT_PART = 10_000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of their group: a left join on ``key``, which is unique in ``groups``.

    ``size`` counts the rows of a group. At most ``HOT_PART`` groups can hold one ``HOT_PART``-th of all counted rows, so
    these are broadcast; a key of the others brings less than that part of the rows to one task. Both sides
    are read several times and should be written tables.
    """
    total = groups.agg(F.sum(size).alias("n")).first()["n"] or 0
    hot = groups.where(F.col(size) * HOT_PART >= total).drop(size)
    rest = groups.where(F.col(size) * HOT_PART < total).drop(size)
    spread = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    return spread.unionByName(others)


def filter_bits(n_keys: int, least: int = 16, most: int = 26) -> int:
    """Bits of a hash filter with 16 places or more for each key; beyond ``most`` (2**20 words, so a broadcast has a bound) it
    passes more rows, and an exact step behind it has more to do."""
    return min(max(least, (16 * max(n_keys, 1) - 1).bit_length()), most)


def marked_in(rows: DataFrame, key: Column, filled: DataFrame, bits: int, name: str) -> DataFrame:
    """All rows with a flag: whether their hash may be among the keys of the filter (see :func:`perhaps_in`)."""
    word, one, at = _slot(key, bits)
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.call_function("shiftleft", one, at)) != 0, F.lit(False))
    return rows.join(F.broadcast(filled), word == F.col("_word"), "left").withColumn(name, hit).drop("_word", "_bits")


@contextlib.contextmanager
def unlimited_recursion(spark: SparkSession) -> Iterator[None]:
    """Lifts the limit on the rows of a recursive query, which here grow with the input, and puts it back."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with every column but the used ones renamed by its place, so that names like those an operator adds (or with dots) don't
    meet them, and the columns that give back the old names in the old order."""
    names = [c if c in used else f"column_{at}_" for at, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
