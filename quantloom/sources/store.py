"""The panel store: per-symbol files or one partitioned dataset, merges, as-of joins and upserts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.durations import multiply_duration, shift_datetime
from ..panel import PanelSpec, require

#: How far before the range event tables are read, and how many bars times 20 continuous ones are.
EVENT_LOOKBACK, BAR_LOOKBACK = "150d", 20


def read_begin(begin: datetime, kind: str, shift_n: int = 0, freq: str = "1d") -> datetime:
    """Where reading starts so that the first date asked for has what it looks back on."""
    if kind == "discrete":
        return shift_datetime(begin, EVENT_LOOKBACK)
    if kind == "continuous":
        return shift_datetime(begin, multiply_duration(BAR_LOOKBACK * shift_n, freq)) if shift_n else begin
    if kind == "base":
        return begin
    raise ValueError(f"kind can be base, continuous or discrete, got {kind!r}")


def scan(spark: SparkSession, path: str, spec: PanelSpec, columns: list[str] | None = None, begin=None, end=None, symbols: list | None = None) -> DataFrame:
    """Rows of a store in a date range; columns, dates and symbols are pushed to the Parquet reader.

    No rows in the range give an empty frame; a missing store raises."""
    df = spark.read.parquet(path)
    require(df, spec.date, spec.symbol)
    if symbols is not None:
        df = df.where(F.col(spec.symbol).isin(list(symbols)))
    if begin is not None:
        df = df.where(F.col(spec.date) >= F.lit(begin))
    if end is not None:
        df = df.where(F.col(spec.date) <= F.lit(end))
    return df.select(spec.date, spec.symbol, *[c for c in columns if c not in (spec.date, spec.symbol)]) if columns else df


def shift_features(df: DataFrame, spec: PanelSpec, bars: int) -> DataFrame:
    """Features as of ``bars`` rows of the symbol before: each row's date becomes that of a later row."""
    if not bars:
        return df
    return df.withColumn(spec.date, F.lead(spec.date, bars).over(spec.history())).where(F.col(spec.date).isNotNull())


def merge_continuous(base: DataFrame, tables: list[DataFrame], spec: PanelSpec) -> DataFrame:
    """Left joins of feature tables on (date, symbol)."""
    return reduce(lambda a, b: a.join(b, [spec.date, spec.symbol], "left"), tables, base)


def merge_discrete(tables: list[DataFrame]) -> DataFrame:
    """Full outer joins of event tables on all columns they share."""

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        common = [c for c in a.columns if c in b.columns]
        if not common:
            raise ValueError("event tables have no column in common")
        return a.join(b, common, "full_outer")

    return reduce(both, tables)


def as_of(left: DataFrame, right: DataFrame, spec: PanelSpec, columns: list[str] | None = None) -> DataFrame:
    """For each row of ``left`` the latest row of ``right`` of its symbol, on or before its date.

    One shuffle by symbol: both sides in one sequence, the last event carried forward as a whole. Of several events
    of a symbol and date the one that is greatest, column by column, counts."""
    columns = columns or [c for c in right.columns if c not in (spec.date, spec.symbol)]
    events = right.select(spec.date, spec.symbol, F.struct(*columns).alias("__event"), F.lit(0).alias("__side"))
    rows = left.withColumns({"__event": F.lit(None).cast(events.schema["__event"].dataType), "__side": F.lit(1)})
    both = rows.unionByName(events, allowMissingColumns=True)
    past = Window.partitionBy(spec.symbol).orderBy(spec.date, "__side", "__event").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__event", F.last("__event", ignorenulls=True).over(past)).where("__side = 1")
    return both.select(*left.columns, *[F.col(f"__event.{c}").alias(c) for c in columns])


@dataclass(frozen=True)
class StoredTable:
    """A table of a store: where it is, its keys' names, and columns to take, by the names that they get."""

    path: str
    date: str
    symbol: str
    columns: dict[str, str]


@dataclass(frozen=True)
class PanelStore:
    """From stored tables to one panel.

    The base table gives the rows. Continuous tables, keyed by (date, symbol), are joined as they were ``shift_n``
    bars before; event tables are joined with each other, and the latest events on or before a date go with it.
    Each kind is read from as far before the range as it looks back, and no further."""

    spark: SparkSession
    spec: PanelSpec
    base: StoredTable
    continuous: tuple[StoredTable, ...] = ()
    discrete: tuple[StoredTable, ...] = ()
    shift_n: int = 0
    freq: str = "1d"

    def _read(self, t: StoredTable, kind: str, begin: datetime | None, end: datetime | None, symbols: list | None) -> DataFrame:
        own = PanelSpec(date=t.date, symbol=t.symbol)
        since = None if begin is None else read_begin(begin, kind, self.shift_n, self.freq)
        rows = scan(self.spark, t.path, own, list(t.columns), since, end, symbols)
        return rows.select(F.col(t.date).alias(self.spec.date), F.col(t.symbol).alias(self.spec.symbol), *[F.col(a).alias(b) for a, b in t.columns.items()])

    def load(self, begin: datetime | None = None, end: datetime | None = None, symbols: list | None = None) -> DataFrame:
        """The panel of a range, both ends included."""
        read = lambda t, kind: self._read(t, kind, begin, end, symbols)
        out = read(self.base, "base")
        out = merge_continuous(out, [shift_features(read(t, "continuous"), self.spec, self.shift_n) for t in self.continuous], self.spec)
        return as_of(out, merge_discrete([read(t, "discrete") for t in self.discrete]), self.spec) if self.discrete else out


def aligned(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with all columns of either; numbers that one lacks are null doubles."""

    def fill(df: DataFrame, other: DataFrame) -> DataFrame:
        missing = {c: F.lit(None).cast("double" if other.schema[c].dataType.simpleString() in ("float", "double") else other.schema[c].dataType) for c in other.columns if c not in df.columns}
        return df.withColumns(missing) if missing else df

    return fill(old, new), fill(new, old)


def upsert(old: DataFrame, new: DataFrame, spec: PanelSpec, mode: str = "append") -> DataFrame:
    """Old and new rows together. "append" adds keys that aren't there; "overwrite" replaces known values of
    keys that are there, and adds none."""
    keys = [spec.date, spec.symbol]
    old, new = aligned(old, new)
    if mode == "append":
        return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))
    if mode == "overwrite":
        values = [c for c in old.columns if c not in keys]
        fresh = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in values])
        return old.join(fresh, keys, "left").select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in values else F.col(c) for c in old.columns])
    raise ValueError(f"mode can be append or overwrite, got {mode!r}")


def save(df: DataFrame, path: str, spec: PanelSpec, mode: str = "append") -> None:
    """Upsert into a dataset partitioned by symbol; only the symbols at hand are read and written.

    The merged rows are written beside the store first, so that no file is read and replaced at once."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    writer = lambda d: d.repartition(spec.symbol).sortWithinPartitions(spec.symbol, spec.date).write.partitionBy(spec.symbol)
    if not fs.exists(target):
        if mode not in ("append", "overwrite"):
            raise ValueError(f"mode can be append or overwrite, got {mode!r}")
        writer(df).parquet(path)
        return
    old = spark.read.parquet(path)
    own = old.join(df.select(F.col(spec.symbol).cast(old.schema[spec.symbol].dataType)).distinct(), spec.symbol, "left_semi")
    merged = upsert(own, df.withColumn(spec.symbol, F.col(spec.symbol).cast(old.schema[spec.symbol].dataType)), spec, mode)
    beside = f"{path.rstrip('/')}.__new"
    merged.write.mode("overwrite").parquet(beside)
    writer(spark.read.parquet(beside)).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(beside), True)
