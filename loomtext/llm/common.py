"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a folder of its own;
    a cluster without it is an error, since executors cannot read a driver's folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: str = "8m"):
    """Arrow batches of at most ``rows`` rows and ``size`` bytes for the jobs that run inside."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(min(rows, int(before[0])) if int(before[0]) > 0 else rows))
    spark.conf.set(names[1], size)
    try:
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


#: Bytes of an Arrow batch that become Python objects at a time.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes, never less than a row."""
    rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
    if batch.num_rows <= rows:
        yield batch
        return
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


_RESIDENT: dict[str, object] = {}


def resident(name: str, make: Callable):
    """What a worker keeps between tasks: one operator's state, so stages do not add up."""
    if name not in _RESIDENT:
        _RESIDENT.clear()
        release()
        _RESIDENT[name] = make()
    return _RESIDENT[name]


def release() -> None:
    """Hand memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that reads bounded slices and frees its memory when a task ends."""

    def wrapped(batches):
        try:
            yield from run(part for batch in batches for part in slices(batch))
        finally:
            release()

    return wrapped


def map_arrow(
    df: DataFrame, columns: list[str], fn: Callable[..., Iterator[dict[str, list]]], schema: str, *, setup: Callable = None
) -> DataFrame:
    """``fn(state, *column_lists)`` yields dicts of output columns, once for each slice of an Arrow batch.

    ``setup()`` runs once in each task and its value is passed as ``state``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        state = setup() if setup else None
        for batch in batches:
            for out in fn(state, *(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip((out[n] for n in arrow_schema.names), arrow_schema)],
                    schema=arrow_schema,
                )

    return df.select(*columns).mapInArrow(tidy(run), schema)


#: Entries of an array that copies are counted out by.
_STEP = 4096


def copies(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``name``; in two steps, so no array has all of them."""
    high = rows.withColumn("__high", F.explode(F.expr(f"sequence(0L, (`{n}` - 1) DIV {_STEP})")))
    low = high.withColumn("__low", F.explode(F.expr(f"sequence(0L, least({_STEP - 1}L, `{n}` - 1 - __high * {_STEP}))")))
    return low.withColumn(name, F.col("__high") * _STEP + F.col("__low")).drop("__high", "__low")


#: Bits of the table that spares rows without a counterpart the way through a shuffle: 2 MB, whatever the corpus.
SIEVE_BITS = 1 << 24


def sieve(rows: DataFrame, ids: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose id may be in ``ids`` (one column of that name), and those whose id surely is not.

    A table of SIEVE_BITS hash bits is broadcast; beyond some 10**7 ids it spares little and loses nothing.
    """
    place = F.pmod(F.xxhash64(id, F.lit(17)), F.lit(SIEVE_BITS))
    bits = ids.select(place.alias("__place")).groupBy(F.expr("bitmap_bucket_number(__place)").alias("__part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(__place))").alias("__bits"))
    marked = rows.withColumn("__place", place).withColumn("__part", F.expr("bitmap_bucket_number(__place)")).join(F.broadcast(bits), "__part", "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, CAST(bitmap_bit_position(__place) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, F.expr("CAST(bitmap_bit_position(__place) % 8 AS INT)")) == 1, F.lit(False))
    return marked.where(may).select(*rows.columns), marked.where(~may).select(*rows.columns)


#: A hot key has more rows than LEAST_HOT and more than one in HOT_SHARE of all: there are HOT_SHARE of them at most.
LEAST_HOT, HOT_SHARE = 4096, 1024
SALTS = 32


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """(key, hot) of the hot keys in ``counts`` (key, size): at most HOT_SHARE rows by their share, so it may be broadcast."""
    total = counts.agg(F.sum("size").alias("total"))
    return counts.join(F.broadcast(total)).where((F.col("size") > LEAST_HOT) & (F.col("size") * HOT_SHARE > F.col("total"))).select(key, F.lit(True).alias("hot"))


def hot_join(left: DataFrame, right: DataFrame, key: str, spread: str, hot: DataFrame) -> DataFrame:
    """Inner join on ``key``; rows of a hot key are dealt over SALTS tasks by ``spread``, their few ``right`` rows repeated."""
    mark = F.broadcast(hot)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(spread, F.lit(3)), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    one = left.join(mark, key, "left").withColumn("salt", salt).drop("hot")
    two = right.join(mark, key, "left").withColumn("salt", F.explode(salts)).drop("hot")
    return one.join(two, [key, "salt"]).drop("salt")


def scored_rows(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, Callable]:
    """(the columns to send to Python, a function that gives the kept columns and the texts of a batch).

    ``text`` is a column, sent after the kept ones, or ``column.field`` of a kept struct, which then is sent once.
    """
    if "." in text:
        column, field = text.split(".")
        at = keep.index(column)
        return docs.select(*keep), lambda batch: (batch.columns, batch.schema.names, pc.struct_field(batch.column(at), field).to_pylist())
    return docs.select(*keep, F.col(text).alias("__text")), lambda batch: (batch.columns[:-1], batch.schema.names[:-1], batch.column(batch.num_columns - 1).to_pylist())


def held_out(column: str, modulus: int, remainder: int):
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder`` (a null id counts as the text '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder
