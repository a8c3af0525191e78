"""Every registered query against its DuckDB oracle (the driver's check),
on the smallest driver tables; rows-only queries must run and be stable."""
import pytest

import __spark_entry__ as E
from moldwatch import config
from moldwatch.plans import catalog, queries_eval
from moldwatch.plans import fixtures as fx
from moldwatch.plans import training
from tests.conftest import SF_MID, SF_SMALL
from tools.oracle_check import duck_connect, rows_of

E.queries()
NAMES = sorted(catalog.QUERIES)  # the optional packages bring their own tests

# Spark type name -> DuckDB type name of the same values
SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalog.ORACLES])
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for c, t in df.dtypes:
        assert SPARK_TO_DUCK.get(t, t) == duck_types[c], (c, t, duck_types[c])
    assert rows_of(df.columns, rows) == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", [n for n in NAMES if n not in catalog.ORACLES])
def test_query_without_sql_gives_the_same_rows_again(spark, monkeypatch, name):
    """With models of fewer rounds (the presets' own are in test_models).  Everything is computed anew
    but the fitted models, which the second run reads from where the first has saved them."""
    monkeypatch.setitem(config.BOOSTING_PRESETS, "retrain_v2", (6, *config.BOOSTING_PRESETS["retrain_v2"][1:]))
    for preset, (_, *rest) in list(config.FORECASTER_PRESETS.items()):
        monkeypatch.setitem(config.FORECASTER_PRESETS, preset, (2, *rest))

    def run():
        df = E.queries()[name](spark, SF_SMALL)
        exact = [c for c, t in df.dtypes if t != "double"]
        order = sorted(exact) + sorted(set(df.columns) - set(exact))
        return df.dtypes, exact, sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)

    types, exact, rows = run()
    training.clear_caches()
    again_types, _, again = run()
    assert rows and types == again_types and len(rows) == len(again)
    for a, b in zip(sorted(rows, key=lambda r: repr(r[:len(exact)])), sorted(again, key=lambda r: repr(r[:len(exact)]))):
        assert a[:len(exact)] == b[:len(exact)]
        assert a[len(exact):] == pytest.approx(b[len(exact):], abs=1e-6, nan_ok=True)


def test_machine_downsample_keeps_what_the_reference_keeps(spark):
    assert (queries_eval.MACHINE_ROWS, queries_eval.MACHINE_POS) == (250_000, 2_000)
    scored = fx.scored(spark, SF_MID).groupBy("machine_id").count().collect()
    assert 1000 < max(r["count"] for r in scored) <= 250_000  # so nothing is dropped
    got = E.queries()["stratified_downsample_machine"](spark, SF_MID).groupBy("machine_id").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, scored))


@pytest.mark.parametrize("quota", [(100, 20), (60, 1)])
def test_machine_downsample_small_quota(spark, duck, quota):
    """The bucket in which a quota ends, on tables that are smaller than the registered quota."""
    df = queries_eval.machine_downsample(spark, SF_SMALL, *quota)
    rows, rel = [tuple(r) for r in df.collect()], duck.sql(queries_eval.machine_downsample_sql(*quota))
    assert len(rows) < fx.scored(spark, SF_SMALL).count()
    assert rows_of(df.columns, rows) == rows_of(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["machine_id", "timestamp", "ml_risk_probability", "n_violations",
                          "violated", "alert_level", "decision_reason"]
