"""Driver tables seen as arrays, so that array operators have SQL to be compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators.views import ArrayView
from voxelith.sources.metadata import Axis

#: The event types in order: the c axis.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _length(df: DataFrame, column: str) -> int:
    """An axis' length from the file statistics: an aggregate that reads no rows."""
    return int(df.agg(F.max(column)).first()[0] or 0) + 1


def embeddings(spark: SparkSession, sf_dir: str) -> ArrayView:
    """EMB: float32 over y = vec_id and x = position."""
    t = table(spark, sf_dir, "embeddings")
    cells = t.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value")).select("y", F.col("x").cast("bigint").alias("x"), "value")
    return ArrayView(cells, (Axis("y", "space"), Axis("x", "space")), (_length(t, "vec_id"), 64), "float32", (50, 16), (0.5, 0.25), (0.0, 0.0))


def labels(spark: SparkSession, sf_dir: str) -> ArrayView:
    """LAB: int32 labels over y = vec_id."""
    t = table(spark, sf_dir, "embeddings")
    return ArrayView(t.select(F.col("vec_id").alias("y"), F.col("label").alias("value")), (Axis("y", "space"),), (_length(t, "vec_id"),), "int32", (50,), (0.5,), (0.0,))


def events(spark: SparkSession, sf_dir: str) -> ArrayView:
    """EVT: event counts over t = day - 1, c = type, z = hour, y = user div 10, x = user mod 10; sparse."""
    t = table(spark, sf_dir, "events")
    kinds = F.array(*[F.lit(k) for k in EVENT_TYPES])
    cells = (
        t.groupBy(
            (F.dayofmonth("ts") - 1).cast("bigint").alias("t"),
            (F.array_position(kinds, F.col("event_type")) - 1).cast("bigint").alias("c"),
            F.hour("ts").cast("bigint").alias("z"),
            F.expr("user_id div 10").alias("y"),
            (F.col("user_id") % 10).alias("x"),
        )
        .agg(F.count(F.lit(1)).alias("value"))
    )
    users = _length(t, "user_id")
    axes = (Axis("t", "time"), Axis("c", "channel"), *[Axis(n, "space") for n in "zyx"])
    return ArrayView(cells, axes, (30, 5, 24, -(-users // 10), 10), "int64", (1, 1, 24, 15, 10), (1.0, 1.0, 1.0, 0.5, 0.5), (0.0,) * 5)
