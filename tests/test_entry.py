import duckdb
import pytest

import __spark_entry__ as entry
from voxelith.plans import queries as engine
from voxelith.plans import stores

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(engine.ORACLE_SQL) == set(engine.QUERIES) and set(stores.ORACLE_SQL) == set(stores.QUERIES)


@pytest.mark.parametrize("name", ["A1_region", "A12_densify", "P5_plane_physical", "E5_argmax", "E8_tile_sums", "N8_label_masked_mean"])
def test_like_sql(spark, name):
    db = duckdb.connect()
    for t in ("embeddings", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(engine.ORACLE_SQL[name]).df()
    got = engine.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    order = list(want.columns)
    assert got.sort_values(order, ignore_index=True).astype(float).equals(want.sort_values(order, ignore_index=True).astype(float))


def test_colour_of_the_whole_image(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = {(y, x): (tuple(a), tuple(b)) for y, x, a, b in db.execute(engine.ORACLE_SQL["X7_X8_colour_image"]).fetchall()}
    got = {(r.y, r.x): (tuple(r.bgr), tuple(r.bgra)) for r in engine.QUERIES["X7_X8_colour_image"](spark, SF).collect()}
    assert got == want and len(got) == 64 * db.execute("SELECT count(*) FROM embeddings").fetchone()[0]


def plain(v):
    return round(float(v), 4) if isinstance(v, (float, int)) and not isinstance(v, bool) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in ("embeddings", "events", "customer", "region"):
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", list(stores.QUERIES))
def test_stores_like_sql(spark, db, name):
    """Every query over stores against the same SQL of the tables that were written."""
    found = db.execute(stores.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in stores.QUERIES[name](spark, SF).select(*columns).collect()), key=repr) == want
