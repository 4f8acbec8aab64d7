import duckdb
import pytest

from pixelweave.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame, cols):
    kept = frame[cols].astype(object).where(frame[cols].notna(), None)
    return sorted(str(tuple(int(v) if isinstance(v, float) and v == int(v) else v for v in r)) for r in kept.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    assert len(ours) and rows(ours, cols) == rows(theirs, cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_roundtrips(spark):
    lossless = {r["image"]: r for r in QUERIES["lossless_roundtrip"](spark, SF).collect()}
    assert all(r["max_error"] == 0 for r in lossless.values())
    for name in ("lossy_roundtrip", "legacy_roundtrip"):
        assert all(r["psnr"] > 35 for r in QUERIES[name](spark, SF).collect() if r["image"] != "rgba16")


def test_motion_searches_never_beat_full_search(spark):
    full = {(r["bx"], r["by"]): r["sad"] for r in QUERIES["motion_full_search"](spark, SF).collect()}
    for how in ("diamond", "hexagon", "step"):
        assert all(r["sad"] >= full[r["bx"], r["by"]] for r in QUERIES[f"motion_{how}"](spark, SF).collect())


def test_scan_keeps_filter_and_columns(spark):
    plan = QUERIES["animation_totals"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<user_id" in plan and "props" not in plan.split("== Physical Plan ==")[1]
