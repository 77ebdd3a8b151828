"""Every query against its SQL on the smallest tables, and properties of plans and datasets."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
import oracle
from stampcard.plans import catalog
from stampcard.plans.marts import Marts
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, connect

TRAINED = {"i7_train_model", "i8_propensity_scores", "i16_importance", "i18_campaign_predictions", "i18_audience_plan"}
#: These fit 500 trees; ``tests/oracle_check.py`` runs them.
SLOW = {"i7_training_facts", "i16_importance_facts", "i17_saved_model", "i18_campaign_rates"}


@pytest.fixture(scope="module")
def tables():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in TRAINED | SLOW])
def test_query_equals_sql(spark, tables, name):
    assert compare(entry.queries()[name](spark, SF_SMALL), tables, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(oracle.all_sql()))
def test_statement_is_sql(tables, name):
    """Also of the queries that are too slow to be run here."""
    tables.execute(f"EXPLAIN {oracle.all_sql()[name]}")


def test_only_model_queries_lack_sql():
    assert set(catalog.QUERIES) - set(entry.oracle_sql()) == TRAINED
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_inventory_is_covered():
    covered = {op for ops in catalog.COVERS.values() for op in ops.split()}
    wanted = (
        [f"A{i}" for i in (*range(1, 13), 15, 16)] + [f"B{i}" for i in range(1, 18)] + [f"C{i}" for i in range(1, 16)] + ["C12b"]
        + [f"D{i}" for i in range(1, 23)] + [f"E{i}" for i in (*range(1, 11), 12, 13)] + [f"F{i}" for i in range(1, 7)]
        + [f"G{i}" for i in range(1, 25)] + [f"H{i}" for i in range(1, 51)] + [f"I{i}" for i in range(1, 19)]
    )
    assert [op for op in wanted if op not in covered] == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["h1_customer_features", "h15_canjeador", "h21_measurement_identity", "h22_campaign_metrics", "h24_attribution_window", "h26_rfm_campaigns"])
def test_no_python_and_no_single_partition(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_SMALL))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|SinglePartition|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_range_reaches_the_scan(spark):
    plan = plan_of(entry.queries()["a1_range_scan"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(FECHA_ENVIO), GreaterThanOrEqual(FECHA_ENVIO,2000-03-01)" in plan


def test_snapshot_scan_prunes_partitions(spark):
    plan = plan_of(entry.queries()["a4_snapshot_scan"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(partition_date" in plan


def test_cube_totals(spark):
    marts = Marts(spark, SF_SMALL)
    matrix = entry.queries()["f3_transition_active"](spark, SF_SMALL).toPandas()
    cube = marts.metrics().toPandas()
    treated = cube[(cube["GMGC"] == "GM") & (cube["GRUPO_CANJE_PRE"] != "NO_CANJEADOR_HISTORICO")]
    assert matrix.filter(like="to_").to_numpy().sum() == treated["CLIENTES"].sum()
    assert marts.rfm_cube().toPandas()["CLIENTES"].sum() == marts.attributed().count()


def test_stored_tables_use_the_configured_folder(spark):
    files = Marts(spark, SF_SMALL).features().inputFiles()
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        assert all(folder.split(":")[-1].rstrip("/") in name for name in files)
