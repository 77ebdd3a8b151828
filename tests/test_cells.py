"""The cube and its bitmaps come from one set of cells, and campaigns are no join key of all sends."""

from __future__ import annotations

import datetime as dt

import pytest

from stampcard.operators import distinct, identity, metrics, pivots, reports
from stampcard.plans import marts

_ROWS = "FECHA_ENVIO date, NOMBRE_CAMPANHA string, TIPO_CLIENTE string, CANAL_CANJE string, GMGC string, FLAG_CANJE string, TIPO string, GRUPO_CANJE_PRE string, GRUPO_CANJE_POST string, rut_medicion bigint, canjes bigint, puntos bigint"


def _cube(spark):
    cell = (dt.date(2000, 1, 5), "c", None, "App", "GM", "CANJEO", "t", "a", "b")
    other = (*cell[:8], None)
    rows = [(*cell, 1, 2, -5), (*cell, 1, 2, -5), (*cell, 2, None, None), (*cell, None, 1, -1), (*other, 1, None, None), (*other, None, None, None)]
    return spark.createDataFrame(rows, _ROWS), {"b": (2, 5, 11), None: (1, None, None)}


def test_counted_cells_are_the_cube(spark):
    rows, wanted = _cube(spark)
    found = metrics.counted_cells(metrics.customer_cells(rows)).collect()
    assert {r.GRUPO_CANJE_POST: (r.CLIENTES, r.CANJES, r.PUNTOS_CANJEADOS) for r in found} == wanted and len(found) == 2


def test_cube_and_bitmaps_build_the_rows_once(spark, monkeypatch, tmp_path):
    rows, wanted = _cube(spark)
    built = []
    monkeypatch.setattr(metrics, "cube_rows", lambda *a: built.append(1) or rows)
    for name in ("sends", "redemptions", "snapshots", "mail_sent", "mail_job"):
        monkeypatch.setattr(marts.Marts, name, lambda self: None)
    m = marts.Marts(spark, str(tmp_path))
    cube = {r.GRUPO_CANJE_POST: r.CLIENTES for r in m.metrics().collect()}
    bitmaps = {r.GRUPO_CANJE_POST: r.CLIENTES for r in distinct.customers_by(m.cube_customers(), ["GRUPO_CANJE_POST"]).collect()}
    assert cube == bitmaps == {k: v[0] for k, v in wanted.items()}
    assert len(built) == 1


@pytest.fixture
def unbroadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_sends_of_a_campaign_are_not_gathered_for_its_spellings(spark, unbroadcast):
    day, end = dt.date(2000, 1, 5), dt.date(2000, 1, 25)
    sends = spark.createDataFrame(
        [(day, "Camp 1", "BANCO", "GM", day, end, k, f"c{k}@x") for k in range(4)],
        "fecha_envio date, nombre_campanha string, tipo_cliente string, gmgc string, inicio_vigencia date, fin_vigencia date, rut bigint, email_corporativo string",
    )
    mail = spark.createDataFrame([(1, day, day, "c1@x")], "id_jobenvio int, fecha_sent date, fecha_real date, email_cliente string")
    jobs = spark.createDataFrame([(1, day, "Camp 1"), (1, day, "Camp1")], "id_jobenvio int, fecha_real date, desc_emailname string")
    rows = identity.identity_rows(sends, mail, jobs, day, end)
    joins = [x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [nombre_campanha" in x and "LeftOuter" in x and "name_key" not in x]
    assert joins and all("BroadcastHashJoin" in x for x in joins)
    assert {(r.rut_medicion, r.weight) for r in rows.collect()} == {(0, 2), (1, 4), (2, 2), (3, 2)}


@pytest.fixture
def great_cells(spark):
    """Three customers of a cell whose sums pass 2^63, and a cell whose sums do not."""
    cell = (dt.date(2000, 1, 5), "c", "BANCO", "App", "GM", "CANJEO", metrics.KNOWN_REDEEMER, "FUGADOS", "NUEVO")
    rows = [(*cell, k, 2**61, -(2**62)) for k in range(3)] + [(*cell[:4], "GC", *cell[5:], 1, 2, -5), (*cell[:4], "GC", "NO CANJEO", *cell[6:], 2, None, None)]
    return metrics.customer_cells(spark.createDataFrame(rows, _ROWS))


def test_sums_beyond_bigint_are_whole(spark, great_cells):
    cube = metrics.counted_cells(great_cells)
    found = {(r.GMGC, r.FLAG_CANJE): (r.CLIENTES, r.CANJES, r.PUNTOS_CANJEADOS) for r in cube.collect()}
    assert found == {("GM", "CANJEO"): (3, 3 * 2**61, 3 * 2**62), ("GC", "CANJEO"): (1, 2, 5), ("GC", "NO CANJEO"): (1, None, None)}
    assert dict(cube.dtypes)["CANJES"] == "bigint" and dict(cube.dtypes)["PUNTOS_CANJEADOS"] == "decimal(38,0)"
    small = metrics.counted_cells(great_cells.where("GMGC = 'GC'"))
    assert dict(small.dtypes)["CANJES"] == dict(small.dtypes)["PUNTOS_CANJEADOS"] == "bigint"


def test_reports_add_up_points_beyond_bigint(spark, great_cells):
    cube = metrics.counted_cells(great_cells)
    assert {r.cell: r.points for r in pivots.segment_cells(cube).collect()} == {"BANCO_HIST_GM": float(3 * 2**62), "BANCO_HIST_GC": 5.0}
    block = reports.conversion_block(cube).first()
    assert (block.points_gm, block.redeemers_gm, block.incremental, block.incremental_points) == (3 * 2**62, 3, 1, 2**62)
    fitting = metrics.counted_cells(great_cells.where("rut_medicion < 1"))
    assert reports.conversion_block(fitting).first().points_gm == 2**62
