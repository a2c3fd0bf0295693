"""Streams of factor rows into a store. An addition of this library's own: complete dates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..panel import PanelSpec
from ..sources import store


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, spec: PanelSpec, mode: str = "append"):
    """Upsert every micro-batch of a stream into the store at ``path``; returns the running query.

    A batch that is done again gives the same store, since keys that are there aren't added twice."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.save(batch.dropDuplicates([spec.date, spec.symbol]), path, spec, mode)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_bars(ticks: DataFrame, spec: PanelSpec, delay: str = "1 day") -> DataFrame:
    """Mean price and count by symbol and day, given out once the watermark has passed the day."""
    day = F.window(spec.date, "1 day")
    return ticks.withWatermark(spec.date, delay).groupBy(day, spec.symbol).agg(F.avg(spec.price).alias(spec.price), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias(spec.date), spec.symbol, spec.price, "n")
