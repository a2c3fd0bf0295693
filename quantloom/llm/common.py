"""Small helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The model that the registered queries use; a parameter of the operators that need one.
MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of a text column that a Python function takes at once, a whole text at least.
PORTION = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the folder that the session names.

    Where ``spark.checkpoint.dir`` is unset, a temporary folder is chosen in local mode (tests, notebooks), where
    there is but one machine; on a cluster that is an error. What the optimizer has inferred of the columns
    is dropped with the lineage: a checkpoint keeps it, and round by round it would grow without end.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quantloom-"))
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def meeting_cells(rows: DataFrame, on: list[str], by: list[str], sizes: DataFrame, total: int) -> DataFrame:
    """``rows`` with a column ``cell``, so that any two rows of a key meet in some cell of it.

    A key with more than a fraction of a usual partition's rows is cut into k blocks by a hash of ``by``, and a
    row goes to the k cells that pair its block with another; other keys have one cell."""
    share = max(4096, total // (16 * partitions(rows.sparkSession)))
    many = F.broadcast(sizes.where(F.col("n") > share).select(*on, F.ceil(F.col("n") / share).cast("int").alias("__blocks")))
    own, blocks = F.pmod(F.xxhash64(*by), F.col("__blocks")).cast("int"), F.col("__blocks")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.least(own, other) * blocks + F.greatest(own, other))
    cells = F.when(blocks.isNull(), F.array(F.lit(0))).otherwise(cells)
    return rows.join(many, on, "left").withColumn("cell", F.explode(cells)).drop("__blocks")


#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to what all operators here can do with; they are never raised.

    Spark has no such bounds for one plan, and takes them when a plan runs; by default each task holds 64 MB in the
    JVM and again in Python, which executors with a few workers and little memory outside the heap don't have."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        n, unit = re.match(r"(-?\d+)\s*([kmgt]?)", spark.conf.get(key).lower()).groups()
        now = int(n) << " kmgt".index(unit or " ") * 10
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


#: Arrays of up to so many bytes are taken from memory that was freed before, of which so much is kept while a task runs.
REUSED, KEPT = 32 << 20, 64 << 20


def reuse() -> None:
    """Keep what is freed for the next array: else each one's pages are asked of the system and cleared anew, which
    takes longer than most operations on them."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, REUSED)
        libc.mallopt(-1, KEPT)


def release() -> None:
    """Hand memory that is no longer used back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A function of Arrow batches that reuses its memory, and releases it when its task ends. What it returns is cut
    into batches of ``BATCH_BYTES`` or single rows: the JVM holds each outside its heap, in blocks of powers of two."""

    def whole(batches):
        reuse()
        try:
            for out in run(batches):
                step = max(1, out.num_rows * BATCH_BYTES // max(1, out.nbytes))
                for at in range(0, out.num_rows, step):
                    yield out.slice(at, step)
        finally:
            release()

    return whole


def portions(batches: Iterator[pa.RecordBatch], column: int = 1, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text column has about ``PORTION`` bytes at most, or is a single row.

    Whatever the session's batch size, this bounds what is expanded into Python objects at once."""
    for batch in batches:
        at, sizes = 0, pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        while at < batch.num_rows:
            to, total = at + 1, sizes[at]
            while to < batch.num_rows and to - at < rows and total + sizes[to] <= PORTION:
                total += sizes[to]
                to += 1
            yield batch.slice(at, to - at)
            at = to


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the decimal id modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus
