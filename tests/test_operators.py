from __future__ import annotations

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from stampcard.functions import dates, ratios, text
from stampcard.operators import attribution, features, identity, intervals, lifecycle, metrics, pivots, reports, rfm
from stampcard.schemas import schema
from stampcard.sources import filters, scans

D = dt.date


def rows(df, *columns):
    return sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)



# --- functions ---------------------------------------------------------------------------------


def test_spct_guards_and_rounds_half_up(spark):
    df = spark.createDataFrame([(1, 0), (0, 5), (None, 5), (1, 3), (1, 8), (1, -1), (1, None)], "a BIGINT, b BIGINT")
    got = [row.p for row in df.select(ratios.spct(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [0.0, 0.0, 0.0, 33.3, 12.5, 0.0, 0.0]


@pytest.mark.parametrize(
    "day, close, minus12, is_end",
    [
        (D(2024, 1, 31), D(2023, 12, 31), D(2023, 1, 31), True),
        (D(2024, 2, 29), D(2024, 1, 31), D(2023, 2, 28), True),
        (D(2023, 2, 28), D(2023, 1, 31), D(2022, 2, 28), True),
        (D(2024, 2, 28), D(2024, 1, 31), D(2023, 2, 28), False),
        (D(2024, 12, 31), D(2024, 11, 30), D(2023, 12, 31), True),
    ],
)
def test_month_ends(spark, day, close, minus12, is_end):
    row = spark.range(1).select(
        dates.prev_month_end(F.lit(day)), dates.months_before(day, 12), dates.is_month_end(F.lit(day)),
        dates.month_diff(F.lit(day), F.lit(D(2022, 12, 31))),
    ).first()
    assert tuple(row)[:3] == (close, minus12, is_end)
    assert row[3] == (day.year - 2022) * 12 + day.month - 12


def test_campaign_keys(spark):
    df = spark.createDataFrame([(" camp  nro 4_31121999 ",), ("x_1234567",), (None,)], "n STRING")
    key = text.norm_campaign(F.col("n"))
    got = [tuple(row) for row in df.select(key, text.base_key(key)).collect()]
    assert got == [("CAMPNRO4_31121999", "CAMPNRO4"), ("X_1234567", "X_1234567"), (None, None)]


# --- segments ----------------------------------------------------------------------------------


def test_all_rfm_triples(spark):
    triples = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(triples, "r_score INT, f_score INT, m_score INT")
    out = df.withColumns({"ref": rfm.rfm_segment(), "strict": rfm.rfm_segment("strict")}).toPandas()
    assert len(out) == 125 and "En Riesgo" not in set(out["ref"])
    for row in out.itertuples():
        loyal = row.f_score >= 3 and row.m_score >= 3
        if row.r_score >= 4 and row.f_score >= 4 and row.m_score >= 4:
            assert (row.ref, row.strict) == ("Champions", "Champions")
        elif loyal:
            assert (row.ref, row.strict) == ("Loyal", "En Riesgo" if row.r_score <= 2 else "Loyal")
        else:
            assert row.ref == row.strict
    with pytest.raises(ValueError):
        rfm.rfm_segment("other")


def test_entropy_bounds(spark):
    df = spark.createDataFrame([(0, 0, 0), (9, 0, 0), (5, 5, 5), (1, 2, 3)], "a BIGINT, b BIGINT, c BIGINT")
    got = [row[0] for row in df.select(features.channel_entropy(["a", "b", "c"])).collect()]
    assert got[0] == 0.0 and abs(got[1]) < 1e-4 and got[2] == pytest.approx(1.0986, abs=1e-4) and 0 < got[3] < got[2]


def test_features_count_transactions_once_and_window_is_half_open(spark):
    t0 = D(2001, 1, 1)
    buys = [
        (1, 10, D(2000, 12, 31), 5, "COMPRA", 1, "ch_a", "x CMR"),
        (1, 10, D(2000, 1, 1), 7, "COMPRA", 1, "CH_B", None),
        (1, 11, D(2001, 1, 1), 9, "COMPRA", 1, "CH_A", None),
        (1, 12, D(1999, 12, 31), 9, "COMPRA", 1, "CH_A", None),
        (1, None, D(2000, 6, 1), 3, "COMPRA", 1, "CH_B", None),
        (2, 13, D(2000, 6, 1), 3, "COMPRA", 0, "CH_B", None),
    ]
    out = features.purchase_features(spark.createDataFrame(buys, schema("transactions")), t0, ["CH_A", "CH_B"]).collect()
    assert len(out) == 1
    row = out[0]
    assert (row.frequency_total, row.monetary_total, row.spend_ch_a, row.spend_ch_b) == (1, 15, 5, 10)
    assert (row.earn_velocity_30, row.earn_velocity_90, row.pct_cmr_payments) == (1, 1, 1.0)


# --- lifecycle ---------------------------------------------------------------------------------


def expected_canjeador(row):
    """The state rules on plain values; comparisons with None are false."""
    fa, fa0, fc, fc0 = row["fa"], row["fa0"], row["fc"], row["fc0"]
    never_before = fc0 == 0 and row["uj0"] is None
    if ((fa0 == 0 or never_before) and fa == 1 and fc == 1 and row["uj"] is not None) or (
        fa == 1 and row["close"] is None and fc == 1 and fc0 is None
    ):
        return "NUEVO"
    if row["uc0"] is not None and row["uj0"] is not None and fc0 == 0 and fc == 1 and fa == 1:
        return "RECUPERADO"
    if fa0 == 1 and fc0 == 1 and (fa == 0 or fc == 0):
        return "FUGADOS"
    if row["uj"] is None:
        return "NO_CANJEADOR_HISTORICO"
    if fc0 == 0 and fc == 0:
        return "NO_CANJEADOR_FUNNEL"
    if fa == 0 and fc == 1:
        return "CANJEADOR_NO_PARTICIPANTE"
    if fa0 == 0 and fc0 == 1 and fc == 0:
        return "EX_CANJEADOR_NO_PARTICIPANTE"
    if fa == 1 and fa0 == 1 and fc == 1 and fc0 == 1 and row["uc"] is not None:
        return "RECURRENTE"
    return None


def expected_acumulador(row):
    fa, fa0 = row["fa"], row["fa0"]
    if (fa0 == 0 and row["uc0"] is None and fa == 1 and row["uc"] is not None) or (fa == 1 and row["close"] is None and fa0 is None):
        return "NUEVO"
    if row["uc0"] is not None and fa0 == 0 and fa == 1:
        return "RECUPERADO"
    if fa0 == 1 and fa == 0:
        return "FUGADOS"
    if row["uc"] is None:
        return "NO_PARTICIPANTE_HISTORICO"
    if fa0 == 0 and fa == 0:
        return "NO_PARTICIPANTE_ACTUAL"
    if fa == 1 and fa0 == 1:
        return "RECURRENTE"
    return None


def test_lifecycle_truth_table(spark):
    flags, seen = [None, 0, 1], [None, D(2000, 1, 1)]
    table = [
        dict(zip(["fa", "fa0", "fc", "fc0", "uc", "uc0", "uj", "uj0", "close"], values))
        for values in itertools.product(flags, flags, flags, flags, seen, seen, seen, seen, [None, D(2000, 5, 31)])
    ]
    ddl = (
        "i INT, flag_acumulador INT, flag_acumulador_cierre INT, flag_canjeador_12_24m INT, flag_canjeador_12_24m_cierre INT, "
        "ultima_compra DATE, ultima_compra_cierre DATE, ultimo_canje DATE, ultimo_canje_cierre DATE, partition_cierre DATE, partition_date DATE"
    )
    data = [(i, *row.values(), D(2000, 6, 15)) for i, row in enumerate(table)]
    base = spark.createDataFrame(data, ddl)
    out = lifecycle.acumulador(lifecycle.canjeador(base)).select("i", "tipo_canjeador", "tipo_acumulador").collect()
    for row in out:
        assert row.tipo_canjeador == expected_canjeador(table[row.i]), table[row.i]
        assert row.tipo_acumulador == expected_acumulador(table[row.i]), table[row.i]
    assert len({row.tipo_canjeador for row in out}) == 9


def test_previous_month_end_and_missing_close(spark):
    data = [
        (D(2024, 2, 29), 1, "Fan", 1, 1, D(2024, 1, 2), D(2024, 1, 3)),
        (D(2024, 3, 10), 1, "Fan", 1, 1, D(2024, 3, 2), D(2024, 3, 3)),
        (D(2024, 3, 10), 2, "Fan", 1, 1, D(2024, 3, 2), D(2024, 3, 3)),
    ]
    snaps = spark.createDataFrame(data, schema("funnel"))
    base = lifecycle.lifecycle_base(snaps, D(2024, 3, 1))
    assert rows(base, "cust_id", "partition_cierre") == [(1, D(2024, 2, 29)), (2, None)]
    assert rows(lifecycle.canjeador(base), "cust_id", "tipo_canjeador") == [(1, "RECURRENTE"), (2, "NUEVO")]


def test_detailed_state_is_one_way_for_redemptions(spark):
    """NORMAL to FAN keeps its class for both reasons, FAN to NORMAL only for purchases."""
    ddl = schema("funnel").add("partition_cierre", "date").add("loy_categoria_cierre", "string").add("flag_acumulador_cierre", "integer").add(
        "flag_canjeador_12_24m_cierre", "integer").add("ultima_compra_cierre", "date").add("ultimo_canje_cierre", "date")
    day, old = D(2024, 3, 10), D(2023, 3, 1)
    data = [
        (day, 1, "Fan", 0, 0, old, old, D(2024, 2, 29), "Normal", 1, 1, old, old),
        (day, 2, "Normal", 0, 0, old, old, D(2024, 2, 29), "Fan", 1, 1, old, old),
        (day, 3, "Normal", 0, 0, old, old, D(2024, 2, 29), "Elite", 1, 1, old, old),
    ]
    out = lifecycle.canjeador(spark.createDataFrame(data, ddl), detailed=True)
    assert rows(out, "cust_id", "tipo_canjeador_detallado") == [
        (1, "FUGADO_POR_CANJE"), (2, "FUGADO_POR_COMPRA"), (3, "FUGADO_POR_CATEGORIA"),
    ]


# --- attribution -------------------------------------------------------------------------------


def hot_sends(spark):
    """One customer holds a third of the sends and redemptions; two windows per send for some."""
    sends, redeems = [], []
    for i in range(300):
        rut = 1 if i % 3 == 0 else i
        day = D(2000, 1 + i % 6, 5)
        sends.append((day, f"c{i % 6}", rut, "GM" if i % 5 else "GC", "BANCO", "MAIL", "V", "M", f"{rut}@x", day, day + dt.timedelta(days=20)))
        if i % 4 == 0:
            sends.append((*sends[-1][:-1], day + dt.timedelta(days=40)))
        when = D(2000, 1, 1) + dt.timedelta(days=(i * 13) % 200)
        redeems.append((rut, i, when, when.replace(day=1), -100, False if i % 7 else None, "App" if i % 2 else None, "x"))
    return spark.createDataFrame(sends, schema("sends")), spark.createDataFrame(redeems, schema("redemptions"))


def test_attribution_matches_row_by_row(spark):
    sends, redeems = hot_sends(spark)
    start, end = D(2000, 1, 1), D(2000, 12, 31)
    s = sends.toPandas().drop_duplicates(["fecha_envio", "nombre_campanha", "gmgc", "rut", "inicio_vigencia", "fin_vigencia"])
    r = redeems.toPandas()
    valid = {}
    for row in r[r["return_flag"] == False].itertuples():  # noqa: E712
        valid.setdefault(row.cust_id, set()).add(row.redemption_date)
    strict, loose, fast = {}, {}, {}
    for row in s.itertuples():
        key = (row.fecha_envio, row.nombre_campanha, row.gmgc, row.rut)
        hit = any(row.inicio_vigencia <= d <= row.fin_vigencia for d in valid.get(row.rut, ()))
        strict[key] = strict.get(key, True) and hit
        loose[key] = loose.get(key, False) or hit
        soon = any(row.fecha_envio <= d <= row.fecha_envio + dt.timedelta(days=5) for d in valid.get(row.rut, ()))
        fast[key] = fast.get(key, False) or soon
    for mode, want in [("reference", strict), ("any", loose)]:
        got = attribution.attribute_redemptions(sends, redeems, start, end, mode).collect()
        assert {tuple(row)[:4]: row.flag_canje == "CANJEO" for row in got} == want
    got = attribution.attribute_redemptions_horizon(sends, redeems, start, end).collect()
    assert {tuple(row)[:4]: row.canjeo_5d for row in got} == fast
    assert strict != loose


def test_interval_join_finds_every_pair_once(spark):
    windows = [(i % 5, D(2000, 1, 1) + dt.timedelta(days=i), D(2000, 1, 1) + dt.timedelta(days=i + i % 90)) for i in range(120)]
    windows.append((1, D(2000, 3, 1), D(2000, 2, 1)))
    events = [(i % 5, D(2000, 1, 1) + dt.timedelta(days=(i * 11) % 250)) for i in range(80)]
    got = intervals.interval_join(
        spark.createDataFrame(windows, "k INT, a DATE, b DATE"), spark.createDataFrame(events, "k INT, d DATE"), "k", "a", "b", "d"
    )
    want = sorted((k, a, b, d) for k, a, b in windows for j, d in events if k == j and a <= d <= b)
    assert sorted(tuple(row) for row in got.select("k", "a", "b", "d").collect()) == want


def test_mid_month_start_keeps_or_drops_its_month(spark):
    _, redeems = hot_sends(spark)
    asked = scans.scan_month_column(redeems, D(2000, 3, 10), whole_month=False).agg(F.min("mes")).first()[0]
    whole = scans.scan_month_column(redeems, D(2000, 3, 10)).agg(F.min("mes")).first()[0]
    assert (asked, whole) == (D(2000, 4, 1), D(2000, 3, 1))


# --- identity and cube -------------------------------------------------------------------------


def shared_address_case(spark):
    """A third of the customers share one address; mails repeat, two windows repeat sends, some addresses and customers are null,
    one campaign is mailed under two spellings."""
    day, sends, mail = D(2000, 3, 5), [], []
    for rut in range(30):
        email = None if rut % 10 == 9 else "all@x" if rut % 3 == 0 else f"{rut}@x"
        for end in (20, 25) if rut % 4 == 0 else (20,):
            sends.append((day, "Camp 1", rut, [None, "GM", "GM", "GC"][rut % 4], "BANCO" if rut % 2 else None, "MAIL", "V", "M", email, day, day + dt.timedelta(days=end)))
        sends.append((day, "Camp 2", rut, "GM", "OMP", "MAIL", "V", "M", email, day, day + dt.timedelta(days=20)))
    for job, email in [(1, "all@x"), (1, "all@x"), (1, "1@x"), (1, "2@x"), (1, "2@x"), (2, "4@x"), (1, "7@x"), (1, None)]:
        mail.append((job, day, day, email))
    sends.append((day, "Camp 1", None, "GM", "OMP", "MAIL", "V", "M", "2@x", day, day + dt.timedelta(days=20)))
    sends.append((day, "Camp 1", None, "GM", "OMP", "MAIL", "V", "M", None, day, day + dt.timedelta(days=20)))
    jobs = [(1, day, "Camp1"), (1, day, "Camp 1"), (2, day, "Other")]
    return (
        spark.createDataFrame(sends, schema("sends")), spark.createDataFrame(mail, schema("mail_sent")),
        spark.createDataFrame(jobs, schema("mail_job")),
    )


def test_identity_matches_row_by_row(spark):
    """Each send, each spelling of its campaign that was mailed, each mail to its address, each send at that address."""
    from collections import Counter

    sends, mail, jobs = shared_address_case(spark)
    squeeze = lambda name: name.replace(" ", "")
    named = [(m.email_cliente, m.fecha_sent, j.desc_emailname) for m in mail.collect() for j in jobs.collect() if (m.id_jobenvio, m.fecha_real) == (j.id_jobenvio, j.fecha_real)]
    every, want = sends.collect(), Counter()
    for a in every:
        own = [n for n in named if (n[1], squeeze(n[2])) == (a.fecha_envio, squeeze(a.nombre_campanha))]
        to_address = [n for n in own if n[0] is not None and n[0] == a.email_corporativo]
        customers = [b.rut for b in every for _ in to_address if (b.email_corporativo, b.fecha_envio, squeeze(b.nombre_campanha)) == (a.email_corporativo, a.fecha_envio, squeeze(a.nombre_campanha))]
        for _ in range(max(1, len({n[2] for n in own}))):
            for rut in customers or [None]:
                want[a.nombre_campanha, a.tipo_cliente, a.gmgc, a.fin_vigencia, rut if rut is not None and a.gmgc == "GM" else a.rut] += 1
    got = identity.measurement_identity(sends, mail, jobs, D(2000, 1, 1), D(2000, 12, 31))
    found = {(r.nombre_campanha, r.tipo_cliente, r.gmgc, r.fin_vigencia, r.rut_medicion): r.weight for r in got.collect()}
    assert found == dict(want) and got.count() == len(want)
    single = identity.measurement_identity(sends, mail, jobs, D(2000, 1, 1), D(2000, 12, 31), dedupe=True)
    assert {row.weight for row in single.collect()} == {1} and single.count() == got.count()
    match = identity.campaign_mail_match(sends, mail, jobs, D(2000, 1, 1))
    assert rows(match, "nombre_campanha", "cruce_camp", "spellings") == [("Camp 1", 1, 2), ("Camp 2", 0, 1)]


def test_cube_of_a_hot_customer(spark):
    """Sums and distinct clients of the cube against pandas, without mails and snapshots."""
    sends, redeems = hot_sends(spark)
    empty = {name: spark.createDataFrame([], schema(name)) for name in ("funnel", "mail_sent", "mail_job")}
    cube = metrics.campaign_redemption_metrics(
        sends, redeems, empty["funnel"], empty["mail_sent"], empty["mail_job"], D(2000, 1, 1), D(2000, 12, 31)
    ).toPandas()
    s, r = sends.toPandas(), redeems.toPandas()
    r = r[r["return_flag"] == False]  # noqa: E712
    pairs = s.merge(r, left_on="rut", right_on="cust_id")
    pairs = pairs[(pairs["redemption_date"] >= pairs["inicio_vigencia"]) & (pairs["redemption_date"] <= pairs["fin_vigencia"])]
    assert cube["CANJES"].sum() == len(pairs)
    assert cube["PUNTOS_CANJEADOS"].sum() == 100 * len(pairs)
    assert set(cube["GRUPO_CANJE_PRE"]) == {"NO INFO"}
    per_channel = pairs.assign(c=pairs["bu_channel_name"].fillna("NO CANJE")).groupby(["nombre_campanha", "gmgc", "c"])["rut"].nunique()
    hit = cube[cube["FLAG_CANJE"] == "CANJEO"].groupby(["NOMBRE_CAMPANHA", "GMGC", "CANAL_CANJE", "TIPO"])["CLIENTES"].sum()
    assert hit.groupby(level=[0, 1, 2]).sum().tolist() == per_channel.tolist()


# --- reports -----------------------------------------------------------------------------------


def cube_of(spark, data):
    full = [(D(2000, 1, 5), name, "BANCO", "App", group, flag, "CANJEADOR HISTORICO", pre, post, n, 1, 10) for name, group, flag, pre, post, n in data]
    return spark.createDataFrame(full, schema("metrics"))


def test_email_match_exact_then_base_then_none(spark):
    feed = [
        (1, "Camp A_01012000", 5, D(2000, 1, 1), D(2000, 1, 2), 1, "", "", 100, 10, 1, 0, 0, 1.0),
        (2, "b camp_02022000", 5, D(2000, 1, 1), D(2000, 1, 2), 1, "", "", 50, 10, 1, 0, 0, 1.0),
        (3, "B CAMP_03032000", 5, D(2000, 1, 1), D(2000, 1, 2), 1, "", "", 20, 10, 1, 0, 0, 1.0),
        (4, "camp a_01012000", 5, D(2000, 1, 1), D(2000, 1, 2), 1, "", "", 300, 30, 1, 0, 0, 1.0),
    ]
    email = spark.createDataFrame(feed, schema("email_metrics"))
    campaigns = spark.createDataFrame([("Camp A_01012000",), ("B Camp_09092000",), ("Other",)], "campaign STRING")
    out = reports.match_email(campaigns, email)
    assert rows(out, "campaign", "sent") == [("B Camp_09092000", 20), ("Camp A_01012000", 100), ("Camp A_01012000", 300), ("Other", None)]
    single = reports.match_email(campaigns, email, dedupe=True)
    assert rows(single.where("campaign like 'Camp%'"), "campaign", "sent", "open_pct") == [("Camp A_01012000", 400, 10.0)]


def test_transition_shows_unknown_column_only_with_unknown_rows(spark):
    data = [("a", "GM", "CANJEO", "FUGADOS", "NO INFO", 3), ("a", "GM", "CANJEO", "FUGADOS", "NUEVO", 2), ("b", "GM", "CANJEO", "NO INFO", "NO INFO", 4)]
    cube = cube_of(spark, data)
    assert rows(pivots.transition_matrix(cube, all_states=False), "campaign", "pre", "to_nuevo", "to_no_info") == [("a", "FUGADOS", 2, 0), ("b", "NO INFO", 0, 4)]
    kept = pivots.transition_matrix(cube)
    assert rows(kept, "campaign", "to_no_info") == [("a", 3), ("b", 4)]


def test_incremental_uses_rounded_rates_and_floors(spark):
    data = [("a", "GM", "CANJEO", "FUGADOS", "NUEVO", 10), ("a", "GM", "NO CANJEO", "FUGADOS", "NUEVO", 990), ("a", "GC", "NO CANJEO", "FUGADOS", "NUEVO", 50)]
    row = reports.conversion_block(cube_of(spark, data)).first()
    assert (row.pct_gm, row.pct_gc, row.incremental, row.incremental_points, row.recovered) == (1.0, 0.0, 10, 10, 10)
    worse = [("a", "GM", "NO CANJEO", "FUGADOS", "NUEVO", 10), ("a", "GC", "CANJEO", "FUGADOS", "NUEVO", 5)]
    row = reports.conversion_block(cube_of(spark, worse)).first()
    assert (row.lift_pp, row.incremental, row.incremental_points) == (0.0, 0, 0)


def test_dominant_segment_tie_is_alphabetical(spark):
    data = [("a", D(2000, 1, 5), "GM", "Otros", "CANJEO", 2), ("a", D(2000, 1, 5), "GM", "Loyal", "NO CANJEO", 2)]
    cube = spark.createDataFrame(data, "NOMBRE_CAMPANHA STRING, FECHA_ENVIO DATE, GMGC STRING, rfm_segment STRING, FLAG_CANJE STRING, CLIENTES BIGINT")
    assert rows(reports.dominant_segment(cube), "top_segment", "top_segment_pct") == [("Loyal", 0.0)]


def test_filters_with_empty_lists_keep_all(spark):
    cube = cube_of(spark, [("a", "GM", "CANJEO", "FUGADOS", "NUEVO", 1)])
    assert filters.apply_filters(cube, filters.Filters()).count() == 1
    assert filters.apply_filters(cube, filters.Filters(client_types=["OMP"])).count() == 0
    assert filters.search_campaign(spark.createDataFrame([("x",), (None,)], "campaign STRING"), "X").count() == 1


def test_bad_values_become_null(spark):
    df = spark.createDataFrame([("1", "2000-01-02", "x"), ("z", "2000-13-01", "true")], "cust_id STRING, partition_date STRING, flag STRING")
    from pyspark.sql.types import StructType

    out = scans.normalize_types(df, StructType.fromDDL("cust_id BIGINT, partition_date DATE, flag BOOLEAN, other INT"))
    assert [tuple(row) for row in out.collect()] == [(1, D(2000, 1, 2), None), (None, None, True)]
