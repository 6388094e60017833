"""What the training-data operators share: scratch tables, Arrow helpers and components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import textkit

#: Text bytes that one numpy pass takes at a time; bounds the memory of a Python worker.
SLICE_BYTES = 2 << 20


def scratch_base(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is missing and Spark runs in one process, as in tests, a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or _local_base()).rstrip("/")


@lru_cache(maxsize=1)
def _local_base() -> str:
    return f"file://{tempfile.mkdtemp(prefix='docquarry-')}"


#: Where this is set, Spark removes the shuffle files of an execution as it ends, not when the driver collects garbage.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from files that survive lost executors.

    The shuffle files of the write are removed with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/docquarry/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*saved: DataFrame) -> None:
    """Delete what ``save`` has written, once nothing that is still to run reads it, and let Spark clean what made it."""
    for df in saved:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if saved:
        clean(saved[0].sparkSession)


def clean(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished plans.

    It does so once their plans are collected as garbage, which a driver with memory to spare seldom does.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of a filter of ids: 16 for each id, up to a table of 2^20 words, which bounds the broadcast (16 MB).
FILTER_BITS = 26


def maybe_in(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``rows`` with ``dq_maybe``: false only where ``column`` is certainly not in ``ids`` (a column of its name, without nulls).

    A broadcast bit table tells on the map side, so that rows which an exact join would drop or leave as they are need
    no shuffle. With more ids than it is made for it lets more through; the exact join that follows decides.
    """
    bits = max(10, min(FILTER_BITS, (16 * ids.count()).bit_length()))
    place = lambda c: F.shiftrightunsigned(F.xxhash64(F.col(c).cast("long")), 64 - bits)
    held = ids.select(place(column).alias("p")).select(F.expr("p div 64").alias("dq_word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit")).groupBy("dq_word").agg(F.bit_or("bit").alias("dq_bits"))
    keyed = rows.withColumn("dq_p", place(column)).withColumn("dq_word", F.expr("dq_p div 64"))
    test = F.expr("(shiftright(coalesce(dq_bits, 0L), cast(dq_p % 64 as int)) & 1L) = 1L")
    return keyed.join(F.broadcast(held), "dq_word", "left").withColumn("dq_maybe", test).drop("dq_p", "dq_word", "dq_bits")


def _bits_of(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each value in a table of 2^bits."""
    place = textkit.mix(values.astype(np.int64, copy=False).view(np.uint64)) >> np.uint64(64 - bits)
    return (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))


def bit_table(rows: DataFrame, column: str) -> np.ndarray:
    """A bit table of a long column without nulls, for ``in_bits`` inside tasks: 16 bits a row, 2^26 bits (8 MB) at most."""
    bits = max(10, min(FILTER_BITS, (16 * rows.count()).bit_length()))

    def run(batches):
        for batch in batches:
            word, bit = _bits_of(batch.column(0).to_numpy(), bits)
            order = np.argsort(word, kind="stable")
            head = np.flatnonzero(np.append(True, word[order][1:] != word[order][:-1])) if len(word) else order
            held = np.bitwise_or.reduceat(bit[order], head) if len(word) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[order][head]), pa.array(held.view(np.int64))], ["w", "b"])

    got = rows.select(column).mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return table


def in_bits(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """False only where a value is certainly not among those of the table."""
    word, bit = _bits_of(values, len(table).bit_length() + 5)
    return table[word] & bit != 0


#: Rows of the batches between Spark and its Python workers; texts have some kB, so a batch has some 16 MB on either side.
BATCH_ROWS = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. Batches of the session get ``BATCH_ROWS`` rows at most, half of Spark's default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Yield (first row, rows, bytes, offsets) over pieces of about ``most`` bytes; null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        end = min(end, n, at + 60_000)
        yield at, end - at, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def give_back() -> None:
    """Return free pages of this process to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


#: What this worker made last for its tasks, and its key.
_kept: list = [None, None]


def kept(key: tuple, make):
    """``make()``, kept in this worker until another key is asked for.

    Workers outlive the stage they serve, so what one operator keeps would lie beside the tables of all later ones.
    """
    if _kept[0] != key:
        _kept[:] = None, None  # goes before the next one is made
        _kept[:] = key, make()
    return _kept[1]


def released(batches):
    """``batches`` as they come; after each, free pages go back to the system, as workers hold them beside the executor's heap."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def ints(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.int64())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every vertex hangs its larger (or its smaller) neighbours on its least neighbour."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = both.join(low, "a")
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as rows (node, component = least node).

    Alternates large-star and small-star steps until every node hangs on one other that hangs on none. Each round is
    written to the shared folder and the one before it deleted; nothing but one row reaches the driver.
    """
    now = save(edges.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    while True:
        hangs = now.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not hangs.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").take(1):
            break
        before, now = now, save(_star(_star(now, True), False), tag)
        drop(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
