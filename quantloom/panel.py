"""The panel: rows keyed by (date, symbol) with a price, a factor and any other columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PanelSpec:
    """Names of a panel's columns."""

    date: str = "datetime"
    symbol: str = "symbol"
    price: str = "close"
    factor: str = "factor"

    def with_factor(self, name: str) -> PanelSpec:
        return replace(self, factor=name)

    def cross_section(self) -> WindowSpec:
        """All rows of a date. Consecutive steps that use it share one exchange."""
        return Window.partitionBy(self.date)

    def history(self) -> WindowSpec:
        """A symbol's rows in time."""
        return Window.partitionBy(self.symbol).orderBy(self.date)

    def trailing(self, rows: int) -> WindowSpec:
        return self.history().rowsBetween(-(rows - 1), 0)


def require(df: DataFrame, *columns: str) -> None:
    """ValueError for missing columns, before any plan is built."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def as_panel(spark: SparkSession, data, spec: PanelSpec) -> DataFrame:
    """A panel from a Spark or pandas frame; the date becomes a timestamp, NaN in pandas becomes null."""
    if isinstance(data, DataFrame):
        df = data
    else:
        import pyarrow as pa

        df = spark.createDataFrame(pa.Table.from_pandas(data, preserve_index=False))
    require(df, spec.date, spec.symbol)
    return df.withColumn(spec.date, F.col(spec.date).cast("timestamp"))


def bar_seconds(df: DataFrame, spec: PanelSpec) -> float | None:
    """Width of a bar: between the first two dates of the first symbol. None if it has but one. Runs a job."""
    first = df.agg(F.min(spec.symbol)).first()[0]
    when = F.col(spec.date).cast("timestamp")
    two = df.where(F.col(spec.symbol) == F.lit(first)).select(F.unix_micros(when).alias("at")).orderBy("at").limit(2).collect()
    return (two[1]["at"] - two[0]["at"]) / 1e6 if len(two) == 2 else None


def industry_table(spark: SparkSession, group_by, symbol_type: str) -> DataFrame | None:
    """(symbol, industry) of a mapping or of a frame whose first two columns are that; None without any."""
    if isinstance(group_by, DataFrame):
        symbol, industry = group_by.columns[:2]
        return group_by.select(F.col(symbol).cast(symbol_type).alias("__symbol"), F.col(industry).cast("string").alias("__industry")).dropDuplicates(["__symbol"])
    if not group_by:
        return None
    pairs = [(str(k), str(v)) for k, v in group_by.items()]
    return spark.createDataFrame(pairs, "__symbol string, __industry string").withColumn("__symbol", F.col("__symbol").cast(symbol_type))


def with_industry(df: DataFrame, symbol: str, group_by) -> DataFrame:
    """Rows with their symbol's ``industry``, ``Unlabeled`` if it has none; a join of tables, broadcast where small."""
    told = industry_table(df.sparkSession, group_by, df.schema[symbol].dataType.simpleString())
    if told is None:
        return df.withColumn("industry", F.lit("Unlabeled"))
    met = df.join(told, df[symbol] == F.col("__symbol"), "left")
    return met.withColumn("industry", F.coalesce("__industry", F.lit("Unlabeled"))).drop("__symbol", "__industry")


def lag_factor(df: DataFrame, spec: PanelSpec, bars: int | None) -> DataFrame:
    """The factor as it was ``bars`` bars ago, by symbol."""
    return df if not bars else df.withColumn(spec.factor, F.lag(spec.factor, bars).over(spec.history()))
