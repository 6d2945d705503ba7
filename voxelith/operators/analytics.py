"""Usual questions to an array: statistics, labels, brightest cells, levels and tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.operators.views import ArrayView


def stats(view: ArrayView, by: Sequence[str] = ()) -> DataFrame:
    """min, max, mean and number of values, overall or by axes. A store's chunks are aggregated where they are read."""
    if (partial := view.partials({n: 1 for n in by})) is not None:
        made = [F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"), (F.sum("sum_v") / F.sum("n")).alias("mean_v"), F.sum("n").alias("n")]
        return partial.groupBy(*by).agg(*made) if by else partial.agg(*made[:3], F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    made = [F.min("value").alias("min_v"), F.max("value").alias("max_v"), F.avg(F.col("value").cast("double")).alias("mean_v"), F.count("value").alias("n")]
    return view.cells.groupBy(*by).agg(*made) if by else view.cells.agg(*made)


def distinct_labels(view: ArrayView) -> DataFrame:
    """How many labels but 0 there are."""
    return view.cells.where("value <> 0").agg(F.countDistinct("value").alias("n_labels"))


def argmax(view: ArrayView) -> DataFrame:
    """The cell with the largest value, the first in order of those; the first cell of all if none is over zero."""
    best = F.max_by(F.struct(*view.names, "value"), F.struct(F.greatest(F.col("value"), F.lit(0).cast(dict(view.cells.dtypes)["value"])), -view.flat_index()))
    return view.cells.agg(best.alias("b")).select("b.*")


def crop_elsewhere(low: ArrayView, high: ArrayView, size: int) -> ArrayView:
    """A square of ``size`` cells of a finer level, centred on a coarser level's brightest cell; widths tell the scale."""
    at = argmax(low).first()
    factor = high.width // max(1, low.width)
    y, x = int(at["y"]) * factor, int(at["x"]) * factor
    rest = {n: 0 for n in ("t", "c", "z")}
    return high.tile(y=y - size // 2, x=x - size // 2, height=size, width=size, **rest)


def best_level(pixel_sizes: Sequence[float], target: float) -> int:
    """The level whose pixel size is nearest to the target; the first of equals."""
    return min(range(len(pixel_sizes)), key=lambda k: (abs(pixel_sizes[k] - target), k))


def best_level_rows(levels: DataFrame, target: float) -> DataFrame:
    """best_level of rows (lvl, ps)."""
    return levels.orderBy(F.abs(F.col("ps") - target), "lvl").limit(1).select("lvl")


def tile_sums(view: ArrayView, height: int, width: int) -> DataFrame:
    """The sum of each tile of y and x."""
    if (partial := view.partials({"y": height, "x": width})) is not None:
        return partial.groupBy(F.col("y").alias("ty"), F.col("x").alias("tx")).agg(F.sum("sum_v").alias("total"))
    ty, tx = F.expr(f"y div {height}").alias("ty"), F.expr(f"x div {width}").alias("tx")
    return view.cells.groupBy(ty, tx).agg(F.sum("value").alias("total"))


def masked_mean(image: ArrayView, labels: ArrayView) -> DataFrame:
    """The mean of the image under each label but 0, on the labels' axes. Both are read together, chunk by chunk, where they share a grid and a store."""
    if (sums := image.under(labels)) is not None:
        return sums.groupBy("label").agg((F.sum("sum_v") / F.sum("n")).alias("mean_v"))
    names = [n for n in labels.names if n in image.names]
    mask = labels.cells.where("value <> 0").select(*names, F.col("value").alias("label"))
    return image.cells.join(mask, names).groupBy("label").agg(F.avg(F.col("value").cast("double")).alias("mean_v"))


def channel_planes(view: ArrayView, t: int = 0, z: int = 0) -> DataFrame:
    """Statistics of every channel's plane at one t and z."""
    return stats(view.plane(t, None, z), by=["c"])


def any_nonzero(view: ArrayView) -> DataFrame:
    if (partial := view.partials({})) is not None:
        return partial.agg(F.coalesce(F.max((F.col("min_v") != 0) | (F.col("max_v") != 0)), F.lit(False)).alias("any_nonzero"))
    return view.cells.agg(F.coalesce(F.max(F.col("value") != 0), F.lit(False)).alias("any_nonzero"))


def first_values(view: ArrayView, n: int = 20) -> DataFrame:
    """The first n values in order: a top-k report."""
    return view.cells.select(view.flat_index().alias("flat_index"), "value").orderBy("flat_index").limit(n)


def by_roi(view: ArrayView, rois: DataFrame) -> DataFrame:
    """Count and sum of the cells in each of many boxes (roi_id, <axis>_start, <axis>_end, half-open).

    Boxes are cut by chunk, so that the join is on equal chunks and only then by range. A box
    without cells, an empty one or one outside of the array counts 0, its sum is null.
    """
    spans = rois.where(" AND ".join(f"{n}_start < {n}_end" for n in view.names))
    for n, c in zip(view.names, view.chunks, strict=True):
        spans = spans.withColumn(f"c{n}", F.explode(F.sequence(F.expr(f"{n}_start div {c}"), F.expr(f"({n}_end - 1) div {c}"))))
    cells = view.cells.select("*", *view.chunk_columns())
    inside = " AND ".join(f"{n} >= {n}_start AND {n} < {n}_end" for n in view.names)
    found = cells.join(spans, [f"c{n}" for n in view.names]).where(inside).groupBy("roi_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total"))
    return rois.select("roi_id").distinct().join(found, "roi_id", "left").select("roi_id", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), "total")
