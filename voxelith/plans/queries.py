"""The engine's queries by name, and the SQL that must give the same rows.

the SQL can say the same; tests run the operators over stores as well.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions.pixels import bgr24, bgra32, gray8, gray16
from voxelith.functions.transforms import PhysicalROI, PixelRegion, parse_unit, pixel_range_columns, pixel_to_physical, to_index, to_physical, unit_column
from voxelith.operators import analytics as A
from voxelith.operators.nodes import ome_type_column
from voxelith.plans.tables import embeddings, events, labels, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_EMB = "(SELECT vec_id AS y, CAST(i - 1 AS BIGINT) AS x, embedding[i] AS value FROM embeddings, range(1, 65) r(i))"
_EVT = """(SELECT CAST(day(ts) - 1 AS BIGINT) AS t, CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS BIGINT) AS c,
  CAST(hour(ts) AS BIGINT) AS z, CAST(user_id // 10 AS BIGINT) AS y, CAST(user_id % 10 AS BIGINT) AS x, count(*) AS value FROM events GROUP BY ALL)"""
_N = "(SELECT max(vec_id) + 1 FROM embeddings)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _rounded(column: str, name: str, places: int = 4):
    return (F.round(column, places) + F.lit(0.0)).alias(name)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: tile sums of the event image."""
    return E8_tile_sums(spark, sf_dir)


@query(f"SELECT * FROM {_EMB} WHERE y >= 100 AND y < 110 AND x >= 4 AND x < 12")
def A1_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).region((100, 4), (110, 12)).cells


@query(f"SELECT y // 50 AS cy, x // 16 AS cx, count(*) AS n_cells FROM {_EMB} WHERE y >= 40 AND y < 130 AND x >= 10 AND x < 40 GROUP BY ALL")
def A3_chunk_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).region((40, 10), (130, 40)).chunk_cells()


@query(f"SELECT y, x, y * 64 + x AS flat_index FROM {_EMB}")
def A9_flat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = embeddings(spark, sf_dir)
    return view.cells.select("y", "x", view.flat_index().alias("flat_index"))


@query(
    f"""SELECT t, c, z, y, x, coalesce(e.value, 0) AS value FROM (SELECT * FROM (SELECT CAST(range AS BIGINT) AS t FROM range(30)), (SELECT CAST(range AS BIGINT) AS c FROM range(5)), (SELECT CAST(range AS BIGINT) AS z FROM range(24)),
 (SELECT CAST(unnest(range(max(user_id) // 10 + 1)) AS BIGINT) AS y FROM events), (SELECT CAST(range AS BIGINT) AS x FROM range(10))) g LEFT JOIN {_EVT} e USING (t, c, z, y, x)"""
)
def A12_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).densify()


@query(
    """WITH r AS (SELECT l_orderkey AS roi, l_linenumber AS line, l_extendedprice / 100 - 50 AS o, l_quantity * 3.7 AS sz FROM lineitem),
 p AS (SELECT *, greatest(0, CAST(floor((o - 5.0) / 0.5) AS BIGINT)) AS s, least(1000, CAST(ceil((o + sz - 5.0) / 0.5) AS BIGINT)) AS e FROM r),
 w AS (SELECT *, CASE WHEN e <= s THEN least(s + 1, 1000) ELSE e END AS e2 FROM p)
SELECT roi, line, CASE WHEN e2 <= s THEN greatest(0, e2 - 1) ELSE s END AS px_start, e2 AS px_end FROM w"""
)
def T5_physical_to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rois = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("roi"), F.col("l_linenumber").alias("line"), (F.col("l_extendedprice") / 100 - 50).alias("o"), (F.col("l_quantity") * 3.7).alias("sz"))
    start, end = pixel_range_columns(F.col("o"), F.col("sz"), F.lit(0.5), F.lit(5.0), F.lit(1000))
    return rois.select("roi", "line", start.alias("px_start"), end.alias("px_end"))


@query(f"SELECT * FROM {_EMB} WHERE y >= floor(10.3 / 0.5) AND y < ceil((10.3 + 7.0) / 0.5) AND x >= floor(1.0 / 0.25) AND x < ceil((1.0 + 2.1) / 0.25)")
def T5_roi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).physical_roi(PhysicalROI((10.3, 1.0), (7.0, 2.1))).cells


@query(f"SELECT * FROM {_EMB} WHERE y = (SELECT max(vec_id) FROM embeddings) AND x = 0")
def T5_past_end_snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).physical_roi(PhysicalROI((1e6, -9.0), (1.0, 1.0))).cells


@query("SELECT l_orderkey AS roi, l_linenumber AS line, l_partkey * 0.65::DOUBLE + 1.5::DOUBLE AS position, (l_partkey * 0.65::DOUBLE + 1.5::DOUBLE - 1.5::DOUBLE) / 0.65::DOUBLE AS index_back FROM lineitem")
def T3_T4_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = to_physical(F.col("l_partkey"), F.lit(0.65), F.lit(1.5))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("roi"), F.col("l_linenumber").alias("line"), there.alias("position"), to_index(there, F.lit(0.65), F.lit(1.5)).alias("index_back"))


@query(f"SELECT 'y' AS axis, 5.0::DOUBLE AS origin, ({_N} - 10) * 0.5 AS size UNION ALL SELECT 'x', 1.0::DOUBLE, 15.0::DOUBLE")
def T6_pixel_to_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = embeddings(spark, sf_dir)
    roi = pixel_to_physical(PixelRegion((10, 4), view.shape), view.scale, view.translation)
    return spark.createDataFrame(list(zip(view.names, roi.origin, roi.size, strict=True)), "axis string, origin double, size double")


@query(f"SELECT 'y' AS axis, 0.0::DOUBLE AS origin, {_N} * 0.5 AS size, 0.5::DOUBLE AS pixel_size UNION ALL SELECT 'x', 0.0, 16.0, 0.25")
def T7_T8_P8_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = embeddings(spark, sf_dir)
    extent, sizes = view.physical_extent(), view.pixel_sizes()
    return spark.createDataFrame([(n, o, s, sizes[n]) for n, o, s in zip(view.names, extent.origin, extent.size, strict=True)], "axis string, origin double, size double, pixel_size double")


@query(f"SELECT * FROM {_EVT} WHERE t = 2 AND c = 1 AND z = 5")
def P1_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).plane(2, 1, 5).cells


@query(f"SELECT * FROM {_EVT} WHERE c = 1 AND z = 5")
def P4_plane_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).plane_4d(1, 5).cells


@query(f"SELECT * FROM {_EVT} WHERE z = 7")
def P4_plane_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).plane_3d(7).cells


@query(f"SELECT * FROM {_EMB}")
def P4_plane_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).plane_2d().cells


@query(f"SELECT * FROM {_EMB} WHERE y >= 30 AND y < 50 AND x >= 60")
def P2_tile_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).tile(y=30, x=60, height=20, width=20, mode="strict").cells


@query(f"SELECT * FROM {_EMB} WHERE y = (SELECT max(vec_id) FROM embeddings) AND x = 63")
def P3_tile_clamped_past_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).tile(y=1 << 40, x=1 << 40, height=4, width=4).cells


@query(f"SELECT * FROM {_EVT} WHERE t = 3 AND c = 2 AND z = 4 AND x >= 2 AND x < 8")
def P5_plane_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).plane_physical(t=3, c=2, z=4, x=1.0, width=3.0).cells


@query(f"SELECT * FROM {_EMB} WHERE y >= 5 AND y < 9 AND x >= 3 AND x < 7")
def P7_pixel_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).pixel_region(PixelRegion((5, 3), (9, 7))).cells


@query(f"SELECT y, list(value ORDER BY x) AS \"values\" FROM {_EMB} GROUP BY y")
def X1_as_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).as_2d()


@query(f"SELECT list(value ORDER BY y, x) AS \"values\" FROM {_EMB}")
def X2_as_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).as_1d()


_G8 = "CAST(trunc(least(greatest(value * CAST(255 AS FLOAT), 0), 255)) AS INTEGER)"


@query(f"SELECT y, x, {_G8} AS gray FROM {_EMB}")
def X5_gray8_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).to_pixels("gray8", "gray")


@query("SELECT p_partkey, CAST((p_partkey * 37 % 65536) >> 8 AS INTEGER) AS gray, CAST((p_partkey * 1000003 % 4294967296) >> 24 AS INTEGER) AS gray32, CAST(p_partkey % 256 AS INTEGER) AS gray_u8, 0 AS gray_i16 FROM part")
def X5_gray8_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", gray8(key * 37 % 65536, "uint16").alias("gray"), gray8(key * 1000003 % 4294967296, "uint32").alias("gray32"), gray8(key % 256, "uint8").alias("gray_u8"), gray8(key, "int16").alias("gray_i16"))


@query(f"SELECT y, x, CAST(trunc(least(greatest(value * CAST(65535 AS FLOAT), 0), 65535)) AS INTEGER) AS gray FROM {_EMB}")
def X6_gray16_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).to_pixels("gray16", "gray")


@query("SELECT p_partkey, CAST((p_partkey % 256) << 8 AS INTEGER) AS from_u8, CAST(p_partkey * 37 % 65536 AS INTEGER) AS from_u16, CAST((p_partkey * 1000003 % 4294967296) >> 16 AS INTEGER) AS from_u32 FROM part")
def X6_gray16_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", gray16(key % 256, "uint8").alias("from_u8"), gray16(key * 37 % 65536, "uint16").alias("from_u16"), gray16(key * 1000003 % 4294967296, "uint32").alias("from_u32"))


@query(f"SELECT y, x, [g, g, g] AS bgr, [g, g, g, 255] AS bgra FROM (SELECT y, x, {_G8} AS g FROM {_EMB})")
def X7_X8_colour_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = embeddings(spark, sf_dir)
    return view.cells.select("y", "x", bgr24(F.col("value"), view.dtype).alias("bgr"), bgra32(F.col("value"), view.dtype).alias("bgra"))


@query(f"SELECT min(value) AS min_v, max(value) AS max_v, round(avg(CAST(value AS DOUBLE)), 4) + 0.0 AS mean_v, count(*) AS n FROM {_EMB}")
def E1_plane_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stats(embeddings(spark, sf_dir)).select("min_v", "max_v", _rounded("mean_v", "mean_v"), "n")


@query("SELECT CAST(hour(ts) AS BIGINT) AS z, count(*) AS total FROM events GROUP BY ALL")
def E2_count_per_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).cells.groupBy("z").agg(F.sum("value").alias("total"))


@query(f"SELECT c, min(value) AS min_v, max(value) AS max_v, round(avg(CAST(value AS DOUBLE)), 4) + 0.0 AS mean_v, count(*) AS n FROM {_EVT} WHERE t = 4 AND z = 6 GROUP BY c")
def E3_channel_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.channel_planes(events(spark, sf_dir), 4, 6).select("c", "min_v", "max_v", _rounded("mean_v", "mean_v"), "n")


@query("SELECT count(DISTINCT label) AS n_labels FROM embeddings WHERE label <> 0")
def E4_distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_labels(labels(spark, sf_dir))


@query(f"SELECT y, x, value FROM {_EMB} ORDER BY value DESC, y, x LIMIT 1")
def E5_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.argmax(embeddings(spark, sf_dir))


@query("SELECT CAST(lvl AS BIGINT) AS lvl FROM (SELECT range AS lvl, 0.25 * pow(2, range) AS ps FROM range(5)) ORDER BY abs(ps - 0.75), lvl LIMIT 1")
def E6_best_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = spark.range(5).select(F.col("id").alias("lvl"), (F.lit(0.25) * F.pow(F.lit(2.0), F.col("id"))).alias("ps"))
    return A.best_level_rows(levels, 0.75)


@query(f"SELECT y // 4 AS ty, x // 4 AS tx, CAST(sum(value) AS BIGINT) AS total FROM {_EVT} GROUP BY ALL")
def E8_tile_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tile_sums(events(spark, sf_dir), 4, 4)


@query(f"SELECT coalesce(bool_or(value <> 0), false) AS any_nonzero FROM {_EMB}")
def E13_any_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.any_nonzero(embeddings(spark, sf_dir))


@query(f"SELECT y * 64 + x AS flat_index, value FROM {_EMB} ORDER BY 1 LIMIT 20")
def E13_first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_values(embeddings(spark, sf_dir), 20)


@query(f"SELECT label, round(avg(CAST(e.value AS DOUBLE)), 4) + 0.0 AS mean_v FROM {_EMB} e JOIN embeddings ON vec_id = y WHERE label <> 0 GROUP BY label")
def N8_label_masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.masked_mean(embeddings(spark, sf_dir), labels(spark, sf_dir)).select("label", _rounded("mean_v", "mean_v"))


@query(f"SELECT p_partkey AS roi_id, count(*) AS n_cells, round(sum(CAST(value AS DOUBLE)), 3) + 0.0 AS total FROM part, {_EMB} WHERE y >= p_partkey % 400 AND y < p_partkey % 400 + p_size AND x >= p_partkey % 50 AND x < p_partkey % 50 + 7 GROUP BY 1")
def A1_many_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rois = table(spark, sf_dir, "part").select(key.alias("roi_id"), (key % 400).alias("y_start"), (key % 400 + F.col("p_size")).alias("y_end"), (key % 50).alias("x_start"), (key % 50 + 7).alias("x_end"))
    view = embeddings(spark, sf_dir)
    wide = view.cells.withColumn("value", F.col("value").cast("double"))
    return A.by_roi(dataclasses.replace(view, cells=wide), rois).select("roi_id", "n_cells", _rounded("total", "total", 3))


@query(
    """SELECT event_id, CASE k % 7 WHEN 0 THEN 'plate' WHEN 1 THEN 'bioformats2raw' WHEN 2 THEN 'well' WHEN 3 THEN 'labels' WHEN 4 THEN 'label' WHEN 5 THEN 'image' ELSE 'unknown' END AS ome_type
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
)
def M6_node_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of each kind, with what ranks lower beside it, chosen by an event's number."""
    later = ['"plate":{}', '"bioformats2raw.layout":3', '"well":{}', '"labels":[]', '"multiscales":[],"image-label":{}', '"multiscales":[]', '"other":1']
    documents = F.array(*[F.lit("{" + ",".join(x for j, x in enumerate(later) if j >= k and (j != 5 or k == 5)) + "}") for k in range(7)])
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", ome_type_column(F.get(documents, (k % 7).cast("int"))).alias("ome_type"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'micrometer' WHEN 1 THEN 'nanometer' WHEN 2 THEN 'hour' WHEN 3 THEN 'dimensionless' ELSE 'unknown' END AS unit FROM nation")
def M17_axis_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    assert [parse_unit(u) for u in ("um", "NM", "hr", "", "furlong")] == ["micrometer", "nanometer", "hour", "dimensionless", "unknown"]
    unit = F.get(F.array(*[F.lit(u) for u in ("um", "NM", "hr", "", "furlong")]), F.col("n_nationkey") % 5)
    return table(spark, sf_dir, "nation").select("n_nationkey", unit_column(unit).alias("unit"))
