"""Final selects, one per query key. Trained-model queries have no SQL."""

from __future__ import annotations

_SPCT = "CASE WHEN {b} > 0 THEN round(({a}) * 100.0::DOUBLE / ({b}), 1) ELSE 0.0::DOUBLE END"


def _spct(a: str, b: str) -> str:
    return _SPCT.format(a=a, b=b)


def _clients(condition: str) -> str:
    return f"CAST(coalesce(sum(CLIENTES) FILTER ({condition}), 0) AS BIGINT)"


_UPLIFT_SUMS = f"""
  {_clients("GMGC = 'GM'")} AS total_gm, {_clients("GMGC = 'GM' AND FLAG_CANJE = 'CANJEO'")} AS redeemers_gm,
  {_clients("GMGC = 'GC'")} AS total_gc, {_clients("GMGC = 'GC' AND FLAG_CANJE = 'CANJEO'")} AS redeemers_gc
"""
_PCTS = f"{_spct('redeemers_gm', 'total_gm')} AS pct_gm, {_spct('redeemers_gc', 'total_gc')} AS pct_gc"
_LABEL = """CASE {c} WHEN 'NO_CANJEADOR_HISTORICO' THEN 'Sin historial de canje' WHEN 'FUGADOS' THEN 'Fugados'
  WHEN 'NUEVO' THEN 'Nuevo canjeador' WHEN 'RECUPERADO' THEN 'Recuperado' WHEN 'RECURRENTE' THEN 'Recurrente' ELSE {c} END"""
_STATES = "'NO_CANJEADOR_HISTORICO','FUGADOS','NUEVO','RECUPERADO','RECURRENTE'"


def _uplift_segments(where: str) -> str:
    return f"""
SELECT u.*, pct_base FROM (
  SELECT *, greatest(0.0::DOUBLE, round(pct_gm - pct_gc, 1)) AS lift_pp FROM (
    SELECT *, {_PCTS} FROM (
      SELECT rfm_segment, {_UPLIFT_SUMS} FROM rfm_cube WHERE rfm_segment <> 'Sin score RFM' AND {where} GROUP BY 1)
    WHERE total_gm > 0 OR total_gc > 0)) u
LEFT JOIN (SELECT rfm_segment, {_spct('count(*)', '(SELECT count(*) FROM rfm)')} AS pct_base FROM rfm GROUP BY 1) s
  ON s.rfm_segment = u.rfm_segment
"""


def _transition(where: str, no_info: str) -> str:
    columns = {s: "to_" + s.lower() for s in ["NO_CANJEADOR_HISTORICO", "FUGADOS", "NUEVO", "RECUPERADO", "RECURRENTE"]}
    sums = ", ".join(f"CAST(coalesce(sum(CLIENTES) FILTER (GRUPO_CANJE_POST = '{s}'), 0) AS BIGINT) AS {c}" for s, c in columns.items())
    return f"""
SELECT NOMBRE_CAMPANHA AS campaign, GRUPO_CANJE_PRE AS pre, {sums}, {no_info} AS to_no_info
FROM metrics m WHERE GMGC = 'GM' AND {where} GROUP BY 1, 2
"""


_NO_INFO = "CAST(coalesce(sum(CLIENTES) FILTER (GRUPO_CANJE_POST = 'NO INFO'), 0) AS BIGINT)"
_SEEN = "EXISTS (SELECT 1 FROM metrics x WHERE x.NOMBRE_CAMPANHA = m.NOMBRE_CAMPANHA AND x.GMGC = 'GM' AND x.GRUPO_CANJE_PRE = 'NO INFO')"

_CELLS = f"""
SELECT NOMBRE_CAMPANHA AS campaign, concat(TIPO_CLIENTE, '_', CASE WHEN TIPO = 'CANJEADOR HISTORICO' THEN 'HIST' ELSE 'NOHIST' END, '_', GMGC) AS cell,
  CAST(sum(CLIENTES) AS DOUBLE) AS clients, CAST({_clients("FLAG_CANJE = 'CANJEO'")} AS DOUBLE) AS redeemers,
  CAST({_clients("TIPO = 'NO CANJEADOR HISTORICO'")} AS DOUBLE) AS no_history,
  CAST({_clients("GRUPO_CANJE_POST = 'NUEVO'")} AS DOUBLE) AS new, CAST(coalesce(sum(PUNTOS_CANJEADOS), 0) AS DOUBLE) AS points
FROM metrics WHERE GMGC IN ('GM','GC') AND TIPO_CLIENTE IN ('BANCO','OMP') GROUP BY 1, 2
"""
_CELLS = f"SELECT *, {_spct('redeemers', 'clients')} AS redeem_pct, round(points * 0.01::DOUBLE, 2) AS value FROM ({_CELLS})"


def _pivot() -> str:
    cells = [f"{c}_{h}_{g}" for c in ("BANCO", "OMP") for h in ("HIST", "NOHIST") for g in ("GM", "GC")]
    metric = "CASE metric " + " ".join(
        f"WHEN '{m}' THEN {m}" for m in ("clients", "redeemers", "no_history", "new", "redeem_pct", "points", "value")
    ) + " END"
    sums = ", ".join(f"coalesce(sum(amount) FILTER (cell = '{c}'), 0.0::DOUBLE) AS {c}" for c in cells)
    return f"""
SELECT g.campaign, g.metric, {sums} FROM (
  SELECT campaign, metric FROM (SELECT DISTINCT NOMBRE_CAMPANHA AS campaign FROM metrics)
  CROSS JOIN (VALUES ('clients'),('redeemers'),('no_history'),('new'),('redeem_pct'),('points'),('value')) AS v(metric)) g
LEFT JOIN (SELECT campaign, cell, metric, {metric} AS amount FROM ({_CELLS})
  CROSS JOIN (VALUES ('clients'),('redeemers'),('no_history'),('new'),('redeem_pct'),('points'),('value')) AS v(metric)) c
  ON c.campaign = g.campaign AND c.metric = g.metric
GROUP BY 1, 2
"""


def _email_match(feed: str, fallback: str) -> str:
    return f"""
SELECT k.campaign, k.last_send AS send_date,
  CASE WHEN e.camp_key IS NULL THEN b.sent ELSE e.sent END AS sent,
  CASE WHEN e.camp_key IS NULL THEN b.open_pct ELSE e.open_pct END AS open_pct,
  CASE WHEN e.camp_key IS NULL THEN b.click_pct ELSE e.click_pct END AS click_pct,
  CASE WHEN e.camp_key IS NULL THEN b.bounce_pct ELSE e.bounce_pct END AS bounce_pct
FROM keyed_rollup k LEFT JOIN ({feed}) e ON e.camp_key = k.camp_key LEFT JOIN ({fallback}) b ON b.base_key = k.base_key
"""


_KEYED_FEED = "SELECT camp_key, CAST(mails AS BIGINT) AS sent, open_pct, click_pct, bounce_pct FROM feed_by_key"
_AUDIENCE = "rfm_segment IN ('Champions','Loyal','Nuevos') AND tier IN ('ELITE','PREMIUM')"
_PLAN_P = """(propensity_score / (1.0::DOUBLE - propensity_score + 1e-9::DOUBLE) * 0.25::DOUBLE)
  / (1.0::DOUBLE + propensity_score / (1.0::DOUBLE - propensity_score + 1e-9::DOUBLE) * 0.25::DOUBLE)"""
_FEATURES_OUT = "SELECT * FROM feat"

QUERIES: dict[str, str] = {
    "a1_range_scan": "SELECT * FROM metrics WHERE FECHA_ENVIO >= DATE '2000-03-01' AND FECHA_ENVIO <= DATE '2000-09-30'",
    "a2_email_scan": """
SELECT id_jobenvio, campaign_name, casos, inicio_vigencia, fin_vigencia, flag_vigencia, desc_emailname, desc_asunto, total_mails,
  total_opens, total_clicks, total_bounces, total_unsubs, porc_envio
FROM fx_email_metrics WHERE inicio_vigencia BETWEEN DATE '2000-02-05' AND DATE '2000-11-30'""",
    "a3_projected_scan": """
SELECT fecha_envio, nombre_campanha, tipo_cliente, canal, tipo_medicion, tipo_campanha, gmgc, inicio_vigencia, fin_vigencia
FROM fx_sends WHERE fecha_envio BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""",
    "a4_snapshot_scan": "SELECT * FROM fx_funnel WHERE partition_date = DATE '2000-07-31'",
    "a5_tolerant_read": "SELECT cust_id, tier, rfm_segment, propensity_score FROM rfm",
    "a6_campaign_read": """
SELECT cust_id, GMGC, rfm_segment, FLAG_CANJE = 'CANJEO' AS canjeo, round(CAST(CAST(propensity_score AS FLOAT) AS DOUBLE), 4) AS score
FROM attr_scored WHERE NOMBRE_CAMPANHA = 'Camp Nro 3_05032000'""",
    "a7_parquet_round_trip": "SELECT * FROM rfm_cube",
    "a8_individual_dataset": """
SELECT NOMBRE_CAMPANHA, GMGC, count(*) AS n, count(*) FILTER (FLAG_CANJE = 'CANJEO') AS redeemers,
  round(avg(CAST(CAST(propensity_score AS FLOAT) AS DOUBLE)), 4) AS mean_score FROM attr_scored GROUP BY 1, 2""",
    "a9_metrics_backfill": "SELECT * FROM metrics WHERE FECHA_ENVIO < (SELECT max(FECHA_ENVIO) FROM metrics)",
    "a10_csv_export": "SELECT * FROM metrics WHERE FECHA_ENVIO = DATE '2000-04-05' AND NOMBRE_CAMPANHA = 'Camp Nro 4_05042000'",
    "a11_normalize_types": """
SELECT o_orderkey AS tran_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS tran_date,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS valid FROM orders""",
    "a12_resolve_columns": "SELECT nombre_campanha AS campaign, count(DISTINCT rut) AS ruts FROM fx_sends GROUP BY 1",
    "a15_dataset_summary": """
SELECT count(*) AS n_rows, count(DISTINCT cust_id) AS n_customers, count(DISTINCT rfm_segment) AS n_segments,
  count(*) FILTER (rfm_segment <> 'Sin score RFM') AS n_scored FROM attr_scored""",
    "a16_month_scan": """
SELECT mes, count(*) AS n_whole, nullif(count(*) FILTER (mes >= DATE '2000-03-10'), 0) AS n
FROM fx_redemptions WHERE mes >= DATE '2000-03-01' GROUP BY 1""",
    "b2_defaults": "SELECT cust_id, t0, recency_days, monetary_total, days_since_last_redeem, avg_redeem_points FROM feat",
    "b6_text_matches": """
SELECT mes, count(*) FILTER (return_flag IS FALSE) AS not_returned, count(*) FILTER (return_flag IS NULL) AS unknown,
  count(*) FILTER (return_flag) AS returned,
  count(*) FILTER (lower(bu_channel_name) LIKE '%digital%' OR lower(bu_channel_name) LIKE '%online%' OR lower(bu_channel_name) LIKE '%app%') AS digital,
  count(*) FILTER (lower(price_type_desc) LIKE '%catalogo%') AS catalogue
FROM fx_redemptions GROUP BY 1""",
    "b8_drop_and_append": "SELECT * EXCLUDE (loy_categoria, loy_categoria_cierre), upper(loy_categoria) AS loy_categoria FROM life",
    "b10_purchase_filter": "SELECT * FROM buys12",
    "b11_redemption_filter": "SELECT cust_id, redemption_id_unico, redemption_date, redemption_points_amt FROM redeems12",
    "b12_report_filters": """
SELECT * FROM metrics WHERE FECHA_ENVIO BETWEEN DATE '2000-02-01' AND DATE '2000-10-31' AND TIPO_CLIENTE = 'BANCO'""",
    "b12_no_filters": "SELECT * FROM metrics",
    "b13_campaign_search": "SELECT * FROM history WHERE regexp_matches(campaign, 'NRO 1.?_', 'i')",
    "b14_drop_null_keys": "SELECT tier, gender, count(*) AS n FROM rfm WHERE tier IS NOT NULL AND gender IS NOT NULL GROUP BY 1, 2",
    "b15_client_type": """
SELECT cust_id, cust_stock_point_amt, coalesce(
    (SELECT max('BANCO') FROM (VALUES ('YN'), ('NY'), ('YY')) AS v(flags) WHERE flags = cust_active_cmr_flg || cust_active_deb_flg),
    if(cust_active_omp_flg = 'Y', 'OMP', NULL)) AS tipo_cliente
FROM fx_clients""",
    "b16_send_dates": "SELECT DISTINCT FECHA_ENVIO FROM metrics",
    "b16_campaign_names": "SELECT DISTINCT NOMBRE_CAMPANHA FROM rfm_cube WHERE NOMBRE_CAMPANHA IS NOT NULL",
    "b17_campaign_slice": "SELECT * FROM metrics WHERE FECHA_ENVIO = DATE '2000-07-05' AND NOMBRE_CAMPANHA = 'Camp Nro 7_05072000'",
    "c2_features_join": """
SELECT o.cust_id, fecha_envio, nombre_campanha, gmgc, canjeo_5d, tier, rfm_segment FROM outcome o JOIN rfm r ON r.cust_id = o.cust_id""",
    "c3_scores_to_sends": """
SELECT nombre_campanha AS NOMBRE_CAMPANHA, gmgc AS GMGC, a.cust_id, flag_canje AS FLAG_CANJE,
  coalesce(rfm_segment, 'Sin score RFM') AS rfm_segment, r_score
FROM attr a LEFT JOIN rfm r ON r.cust_id = a.cust_id""",
    "c4_interval_join": """
SELECT nombre_campanha, s.cust_id, fin_vigencia, redemption_date, bu_channel_name, canjes, puntos_canjeados
FROM (SELECT DISTINCT fecha_envio, nombre_campanha, gmgc, rut AS cust_id, inicio_vigencia, fin_vigencia FROM fx_sends
      WHERE fecha_envio BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') s
JOIN red_daily r ON r.cust_id = s.cust_id AND redemption_date BETWEEN inicio_vigencia AND fin_vigencia""",
    "c6_month_end_asof": "SELECT * FROM life",
    "c7_state_at": """
SELECT rut, inicio_vigencia, fin_vigencia, nombre_campanha, f.tipo_canjeador AS state_pre, g.tipo_canjeador AS state_post
FROM fx_sends LEFT JOIN state f ON rut = f.cust_id AND inicio_vigencia = f.partition_date
LEFT JOIN state g ON rut = g.cust_id AND fin_vigencia = g.partition_date""",
    "c6_from_intervals": "SELECT * FROM life",
    "c6_interval_sizes": """
SELECT (SELECT count(*) FROM fx_funnel) AS n_snapshots, count(*) AS n_intervals FROM fx_funnel f
WHERE NOT EXISTS (SELECT 1 FROM fx_funnel p WHERE p.cust_id = f.cust_id
  AND p.partition_date = (SELECT max(c.partition_date) FROM (SELECT DISTINCT partition_date FROM fx_funnel) c WHERE c.partition_date < f.partition_date)
  AND ROW(p.loy_categoria, p.tipo_cliente, p.flag_acumulador, p.flag_acumulador_dig_3p, p.flag_acumulador_ikea, p.flag_pos_canje_12_24m,
          p.flag_canjeador_12_24m, p.ultima_compra, p.ultima_fecha_pos_canje, p.ultimo_canje)
    IS NOT DISTINCT FROM ROW(f.loy_categoria, f.tipo_cliente, f.flag_acumulador, f.flag_acumulador_dig_3p, f.flag_acumulador_ikea, f.flag_pos_canje_12_24m,
          f.flag_canjeador_12_24m, f.ultima_compra, f.ultima_fecha_pos_canje, f.ultimo_canje))""",
    "c7_from_intervals": """
SELECT rut, inicio_vigencia, fin_vigencia, nombre_campanha, f.tipo_canjeador AS state_pre, g.tipo_canjeador AS state_post
FROM fx_sends LEFT JOIN state f ON rut = f.cust_id AND inicio_vigencia = f.partition_date
LEFT JOIN state g ON rut = g.cust_id AND fin_vigencia = g.partition_date""",
    "c7_last_state": """
SELECT nombre_campanha, rut, CAST(fecha_envio + INTERVAL 9 DAY AS DATE) AS on_day,
  (SELECT tipo_canjeador FROM state s WHERE s.cust_id = rut AND s.partition_date <= fecha_envio + INTERVAL 9 DAY ORDER BY s.partition_date DESC LIMIT 1) AS last_state
FROM fx_sends""",
    "c7_interval_sizes": """
SELECT (SELECT count(*) FROM state) AS n_snapshots, count(*) AS n_intervals FROM state f
WHERE NOT EXISTS (SELECT 1 FROM state p WHERE p.cust_id = f.cust_id AND p.tipo_canjeador IS NOT DISTINCT FROM f.tipo_canjeador
  AND p.partition_date = (SELECT max(c.partition_date) FROM (SELECT DISTINCT partition_date FROM fx_funnel) c WHERE c.partition_date < f.partition_date))""",
    "c8_needed_states": """
SELECT cust_id, partition_date, tipo_canjeador FROM state s
WHERE EXISTS (SELECT 1 FROM fx_sends WHERE rut = s.cust_id AND inicio_vigencia = s.partition_date)""",
    "c12_email_match": _email_match(
        "SELECT camp_key, total_mails AS sent, open_pct, click_pct, bounce_pct FROM feed_rates",
        "SELECT base_key, total_mails AS sent, open_pct, click_pct, bounce_pct FROM base_first",
    ),
    "c12_email_match_dedupe": _email_match(
        _KEYED_FEED,
        f"SELECT base_key, sent, open_pct, click_pct, bounce_pct FROM (SELECT *, row_number() OVER (PARTITION BY base_key ORDER BY camp_key) AS rk "
        f"FROM (SELECT *, regexp_replace(camp_key, '_[0-9]{{8}}$', '') AS base_key FROM ({_KEYED_FEED}))) WHERE rk = 1",
    ),
    "d3_customers_by_campaign": """
SELECT FECHA_ENVIO, NOMBRE_CAMPANHA, GMGC, FLAG_CANJE, CAST(sum(CLIENTES) AS BIGINT) AS CLIENTES_SUMADOS,
  (SELECT count(DISTINCT rut_medicion) FROM measured_hits h WHERE h.fecha_envio = m.FECHA_ENVIO AND h.nombre_campanha = m.NOMBRE_CAMPANHA
     AND h.gmgc IS NOT DISTINCT FROM m.GMGC AND if(h.redeemed, '', 'NO ') || 'CANJEO' = m.FLAG_CANJE) AS CLIENTES
FROM metrics m GROUP BY ALL""",
    "d3_customers_by_channel": "SELECT channel AS CANAL_CANJE, gmgc AS GMGC, count(DISTINCT rut_medicion) AS CLIENTES FROM measured_hits GROUP BY ALL",
    "d8_flag_modes": """
SELECT fecha_envio, nombre_campanha, gmgc, cust_id, max(CASE WHEN hit THEN 'CANJEO' ELSE 'NO CANJEO' END) AS flag_canje,
  CASE WHEN bool_or(hit) THEN 'CANJEO' ELSE 'NO CANJEO' END AS flag_any FROM attr_any GROUP BY 1, 2, 3, 4""",
    "d10_distinct_sends": "SELECT DISTINCT fecha_envio, nombre_campanha, gmgc, rut AS cust_id, inicio_vigencia, fin_vigencia FROM fx_sends",
    "d17_dominant_segment": "SELECT * FROM dom_seg",
    "d19_summary_kpis": """
SELECT count(*) AS campaigns, CAST(sum(sent) AS BIGINT) AS mails_sent, CAST(sum(redeemers_gm) AS BIGINT) AS redeemers_gm,
  CAST(sum(new_redeemers) AS BIGINT) AS new_redeemers, round(avg(pct_gm), 6) AS mean_pct_gm, round(avg(lift_pp), 6) AS mean_lift_pp FROM summary""",
    "d22_first_last_send": """
SELECT NOMBRE_CAMPANHA AS campaign, min(FECHA_ENVIO) AS first_send, max(FECHA_ENVIO) AS last_send FROM metrics GROUP BY 1""",
    "e1_global_rank": """
SELECT cust_id, frequency_total, row_number() OVER (ORDER BY frequency_total, cust_id) AS rn FROM feat""",
    "e2_quintiles": "SELECT cust_id, monetary_total, m_score FROM scored",
    "e3_deciles": "SELECT nombre_campanha, cust_id, decile FROM deciled",
    "e7_sorted_history": "SELECT campaign, send_date FROM history ORDER BY send_date DESC NULLS LAST, campaign",
    "e8_custom_order": """
SELECT rfm_segment, count(*) AS n, CAST(CASE rfm_segment WHEN 'Champions' THEN 0 WHEN 'Loyal' THEN 1 WHEN 'Nuevos' THEN 2
  WHEN 'En Riesgo' THEN 3 WHEN 'Perdidos' THEN 4 WHEN 'Otros' THEN 5 ELSE 99 END AS INT) AS position FROM rfm GROUP BY 1""",
    "e9_top_campaigns": "SELECT campaign, redeemers_gm, pct_gm, CAST(row_number() OVER (ORDER BY redeemers_gm DESC, campaign) AS INT) AS place FROM rollup",
    "e12_mean_bands": """
SELECT campaign,
  CASE WHEN pct_gm > (SELECT avg(pct_gm) FROM summary) * 1.1::DOUBLE THEN 'green' WHEN pct_gm < (SELECT avg(pct_gm) FROM summary) * 0.9::DOUBLE THEN 'red' ELSE 'yellow' END AS pct_gm_band,
  CASE WHEN conv_pct > (SELECT avg(conv_pct) FROM summary) * 1.1::DOUBLE THEN 'green' WHEN conv_pct < (SELECT avg(conv_pct) FROM summary) * 0.9::DOUBLE THEN 'red' ELSE 'yellow' END AS conv_pct_band,
  CASE WHEN top_segment_pct > (SELECT avg(top_segment_pct) FROM summary) * 1.1::DOUBLE THEN 'green' WHEN top_segment_pct < (SELECT avg(top_segment_pct) FROM summary) * 0.9::DOUBLE THEN 'red' ELSE 'yellow' END AS top_segment_pct_band,
  CASE WHEN lift_pp > 1 THEN 'green' WHEN lift_pp < -1 THEN 'red' END AS lift_band
FROM summary""",
    "e13_segment_shares": f"SELECT rfm_segment, count(*) AS n, {_spct('count(*)', '(SELECT count(*) FROM rfm)')} AS pct_base FROM rfm GROUP BY 1",
    "f1_rfm_breakdown": "SELECT r.campaign, " + ", ".join(
        f"(SELECT CASE WHEN sum(CLIENTES) > 0 THEN round(coalesce(sum(CLIENTES) FILTER (FLAG_CANJE = 'CANJEO'), 0) * 100.0::DOUBLE / sum(CLIENTES), 1) END "
        f"FROM rfm_cube c WHERE c.NOMBRE_CAMPANHA = r.campaign AND GMGC = 'GM' AND rfm_segment = '{s}') AS {s.lower().replace(' ', '_')}"
        for s in ("Champions", "Loyal", "Nuevos", "En Riesgo", "Perdidos", "Otros")
    ) + " FROM rollup r",
    "f2_segment_pivot": _pivot(),
    "f3_transition_matrix": _transition("true", _NO_INFO),
    "f3_transition_active": _transition("GRUPO_CANJE_PRE <> 'NO_CANJEADOR_HISTORICO'", _NO_INFO),
    "f4_tier_segment": "SELECT tier, " + ", ".join(
        f"count(*) FILTER (rfm_segment = '{s}') AS {s.lower().replace(' ', '_')}" for s in ("Champions", "Loyal", "Nuevos", "En Riesgo", "Perdidos", "Otros")
    ) + " FROM rfm WHERE tier IS NOT NULL GROUP BY tier",
    "g1_calendar_functions": """
SELECT o_orderkey, CAST(date_diff('day', d, DATE '2000-12-31') AS INT) AS days_to_t0, date_diff('month', d, DATE '2000-12-31') AS months_to_t0,
  d + 5 AS plus_5, CAST(d - INTERVAL 12 MONTH AS DATE) AS minus_12m, CAST(d + INTERVAL 1 MONTH AS DATE) AS plus_1m,
  CAST(date_trunc('month', d) AS DATE) AS month_start, last_day(d) AS month_end, CAST(date_trunc('month', d) - INTERVAL 1 DAY AS DATE) AS prev_close,
  CAST(date_trunc('month', d + 1) - INTERVAL 1 DAY AS DATE) = d AS is_close, CAST(month(d) AS INT) AS mes_envio,
  CAST(isodow(d) - 1 AS INT) AS dia_semana_envio, CAST(month(d) = 11 AS INT) AS es_cyber_month, CAST(month(d) = 12 AS INT) AS es_diciembre,
  strftime(d, '%Y-%m') AS ym
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "g11_name_functions": """
SELECT rut, fin_vigencia, replace(n, ' ', '') AS squashed, replace(upper(trim(n)), ' ', '') AS camp_key,
  regexp_replace(replace(upper(trim(n)), ' ', ''), '_[0-9]{8}$', '') AS base_key, upper(email_corporativo) AS upper_email
FROM (SELECT *, concat(' ', lower(nombre_campanha)) AS n FROM fx_sends)""",
    "g14_flags": """
SELECT cust_id, CASE WHEN upper(contact_push_flg) IN ('1','TRUE','SI','YES','Y') THEN 1 ELSE 0 END AS contact_push_flg,
  CASE WHEN upper(contact_email_flg) IN ('1','TRUE','SI','YES','Y') THEN 1 ELSE 0 END AS contact_email_flg,
  CASE WHEN upper(cust_active_cmr_flg) IN ('1','TRUE','SI','YES','Y') THEN 1 ELSE 0 END AS cust_active_cmr_flg FROM fx_clients""",
    "g15_guarded_arithmetic": """
SELECT cust_id, greatest(spend_ch_a, spend_ch_b, spend_ch_c) AS top3, nullif(stock_points, 0) AS stock_or_null,
  exp_points_next / nullif(stock_points, 0) AS pressure_next, redeem_rate FROM rfm""",
    "g17_rates_and_lift": "SELECT campaign, pct_gm, pct_gc, lift_pp FROM rollup",
    "g22_labels": f"""
SELECT GRUPO_CANJE_PRE, CAST(sum(CLIENTES) AS BIGINT) AS clients, {_LABEL.format(c='GRUPO_CANJE_PRE')} AS label FROM metrics GROUP BY 1""",
    "g24_bands": f"""
SELECT campaign, cell, redeem_pct, CASE WHEN redeem_pct >= 10 THEN 'green' WHEN redeem_pct >= 5 THEN 'yellow' WHEN redeem_pct > 0 THEN 'red' END AS band,
  CASE WHEN redeem_pct >= 10 THEN '4' WHEN redeem_pct >= 6 THEN '3' WHEN redeem_pct >= 3 THEN '2' WHEN redeem_pct > 0 THEN '1' END AS heat FROM ({_CELLS})""",
    "h1_customer_features": _FEATURES_OUT,
    "h5_channel_entropy": "SELECT cust_id, retailer_entropy FROM rfm",
    "h6_rfm_scores": "SELECT cust_id, recency_days, frequency_total, monetary_total, r_score, f_score, m_score FROM scored",
    "h7_rfm_segments": """
SELECT cust_id, rfm_segment, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
  WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'En Riesgo' WHEN f_score >= 3 AND m_score >= 3 THEN 'Loyal'
  WHEN r_score >= 4 AND f_score <= 2 THEN 'Nuevos' WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Perdidos' ELSE 'Otros' END AS rfm_strict,
  prioridad FROM rfm""",
    "h9_derived_features": """
SELECT cust_id, frequency_total, monetary_total, redeem_count_pre, stock_points, frequency_monthly_avg, monetary_monthly_avg, redeem_rate,
  stock_points_at_t0 FROM rfm""",
    "h43_segment_profile": f"""
SELECT rfm_segment, count(*) AS customers, round(avg(r_score), 4) AS mean_r_score, round(avg(f_score), 4) AS mean_f_score,
  round(avg(m_score), 4) AS mean_m_score, round(avg(recency_days), 4) AS mean_recency_days, round(avg(frequency_total), 4) AS mean_frequency_total,
  round(avg(monetary_total), 4) AS mean_monetary_total, round(avg(stock_points), 4) AS mean_stock_points,
  mode(prioridad) AS priority, {_spct('count(*)', '(SELECT count(*) FROM rfm)')} AS pct_base FROM rfm GROUP BY 1""",
    "h43_segment_kpis": "SELECT count(*) AS customers, count(DISTINCT rfm_segment) AS segments, median(recency_days) AS median_recency FROM rfm",
    "h13_acumulador": "SELECT partition_date, cust_id, tipo_acumulador, tipo_acumulador_detallado FROM life3",
    "h15_canjeador": "SELECT partition_date, cust_id, tipo_canjeador, tipo_canjeador_detallado FROM life3",
    "h12_close_counts": """
SELECT partition_date, partition_cierre, loy_categoria, loy_categoria_cierre, count(*) AS n, CAST(sum(flag_acumulador) AS BIGINT) AS buyers,
  CAST(sum(flag_acumulador_cierre) AS BIGINT) AS buyers_at_close, CAST(sum(flag_canjeador_12_24m_cierre) AS BIGINT) AS redeemers_at_close,
  max(ultima_compra_cierre) AS last_buy_at_close, max(ultimo_canje_cierre) AS last_redeem_at_close FROM life GROUP BY ALL""",
    "b8_upper_tier_counts": "SELECT partition_date, upper(loy_categoria) AS tier, count(*) AS n, count(DISTINCT cust_id) AS customers FROM life GROUP BY ALL",
    "h13_acumulador_counts": """
SELECT partition_date, loy_categoria, tipo_acumulador, tipo_acumulador_detallado, count(*) AS n, count(DISTINCT cust_id) AS customers FROM life3 GROUP BY ALL""",
    "h15_canjeador_counts": """
SELECT partition_date, loy_categoria, tipo_canjeador, tipo_canjeador_detallado, count(*) AS n, count(DISTINCT cust_id) AS customers FROM life3 GROUP BY ALL""",
    "h17_funnel_groups": """
SELECT partition_date, CASE WHEN tipo_canjeador IN ('NO_CANJEADOR_HISTORICO','NUEVO','RECUPERADO') THEN tipo_canjeador
    WHEN tipo_canjeador IN ('NO_CANJEADOR_FUNNEL','EX_CANJEADOR_NO_PARTICIPANTE','FUGADOS') THEN 'FUGADOS'
    WHEN tipo_canjeador IN ('RECURRENTE','CANJEADOR_NO_PARTICIPANTE') THEN 'RECURRENTE' ELSE 'NO INFO' END AS grupo, count(*) AS n
FROM life2 GROUP BY 1, 2""",
    "h10_first_redemption": "SELECT * FROM first_red",
    "h11_redemption_daily": "SELECT * FROM red_daily",
    "h18_mail_campaigns": "SELECT * FROM mails",
    "h19_campaign_mail_match": "SELECT nombre_campanha, fecha_envio, CAST(spelled > 0 AS INT) AS cruce_camp, greatest(spelled, 1) AS spellings FROM campaign_days",
    "h20_recipient_match": """
SELECT canal, tipo_medicion, tipo_campanha, fecha_envio, nombre_campanha, tipo_cliente, rut, email_corporativo AS email,
  CAST(sum(arrived) AS BIGINT) AS n_matches
FROM arrivals GROUP BY ALL HAVING sum(arrived) > 0""",
    "h21_measurement_identity": """
SELECT fecha_envio, nombre_campanha, tipo_cliente, gmgc, inicio_vigencia, fin_vigencia, rut_medicion, CAST(sum(weight) AS BIGINT) AS weight FROM measured GROUP BY ALL""",
    "h22_campaign_metrics": "SELECT * FROM metrics",
    "h22_campaign_metrics_dedupe": "SELECT * FROM metrics_single",
    "h24_attribution_window": "SELECT * FROM attr",
    "h25_attribution_horizon": "SELECT * FROM outcome",
    "h26_rfm_campaigns": "SELECT * FROM rfm_cube",
    "h27_campaign_summary": "SELECT * FROM summary",
    "h28_engagement": "SELECT campaign_name, casos, total_mails, total_opens, total_clicks, total_bounces, total_unsubs, open_pct, click_pct, bounce_pct FROM feed_rates",
    "h30_conversion_block": f"""
SELECT *, CAST(trunc(incremental * (points_gm / greatest(redeemers_gm, 1))) AS BIGINT) AS incremental_points,
  {_spct('incremental', 'total_gm')} AS incremental_pct FROM (
  SELECT campaign, total_gm, redeemers_gm, total_gc, redeemers_gc, new_redeemers, recovered, recurrent, points_gm, pct_gm, pct_gc, lift_pp,
    new_redeemers + recovered AS activated, {_spct('new_redeemers + recovered', 'total_gm')} AS activated_pct,
    greatest(0, CAST(trunc((pct_gm / 100 - pct_gc / 100) * total_gm) AS BIGINT)) AS incremental FROM rollup)""",
    "h32_uplift_by_state": f"""
SELECT *, greatest(0.0::DOUBLE, round(pct_gm - pct_gc, 2)) AS lift_pp, {_LABEL.format(c='GRUPO_CANJE_PRE')} AS label FROM (
  SELECT *, {_PCTS} FROM (
    SELECT g.campaign, g.state AS GRUPO_CANJE_PRE, coalesce(total_gm, 0) AS total_gm, coalesce(redeemers_gm, 0) AS redeemers_gm,
      coalesce(total_gc, 0) AS total_gc, coalesce(redeemers_gc, 0) AS redeemers_gc
    FROM (SELECT campaign, state FROM (SELECT DISTINCT NOMBRE_CAMPANHA AS campaign FROM metrics)
          CROSS JOIN (SELECT unnest([{_STATES}]) AS state)) g
    LEFT JOIN (SELECT NOMBRE_CAMPANHA AS campaign, GRUPO_CANJE_PRE AS state, {_UPLIFT_SUMS} FROM metrics GROUP BY 1, 2) u
      ON u.campaign = g.campaign AND u.state = g.state))""",
    "h33_uplift_by_segment": "SELECT * FROM uplift_seg",
    "h33_uplift_all_campaigns": _uplift_segments("true"),
    "h33_uplift_selected": _uplift_segments("NOMBRE_CAMPANHA IN ('Camp Nro 2_05022000', 'Camp Nro 5_05052000')"),
    "h34_predicted_by_segment": """
SELECT nombre_campanha AS campaign, rfm_segment, round(avg(p_5dias) * 100, 1) AS pred_pct FROM predicted WHERE gmgc = 'GM' GROUP BY 1, 2""",
    "h35_engagement_by_segment": """
SELECT u.campaign, u.rfm_segment, open_pct, click_pct, pct_gm, pct_gc, lift_pp, pred_pct FROM uplift_seg u
LEFT JOIN feed_by_key e ON e.camp_key = replace(upper(trim(u.campaign)), ' ', '')
LEFT JOIN (SELECT nombre_campanha, rfm_segment, round(avg(p_5dias) * 100, 1) AS pred_pct FROM predicted WHERE gmgc = 'GM' GROUP BY 1, 2) p
  ON p.nombre_campanha = u.campaign AND p.rfm_segment = u.rfm_segment""",
    "h36_who_redeemed": f"""
SELECT campaign, GRUPO_CANJE_PRE, {_LABEL.format(c='GRUPO_CANJE_PRE')} AS label, total, redeemers, {_spct('redeemers', 'total')} AS pct FROM (
  SELECT NOMBRE_CAMPANHA AS campaign, GRUPO_CANJE_PRE, CAST(sum(CLIENTES) AS BIGINT) AS total, {_clients("FLAG_CANJE = 'CANJEO'")} AS redeemers
  FROM metrics WHERE GRUPO_CANJE_PRE IN ({_STATES}) GROUP BY 1, 2)""",
    "h37_group_rates": "SELECT campaign, pct_gm, pct_gc, lift_pp FROM rollup",
    "h38_send_base_profile": """
SELECT nombre_campanha AS campaign, tipo_cliente, gmgc, canal, tipo_medicion, count(*) AS ruts FROM fx_sends
WHERE tipo_cliente IS NOT NULL AND gmgc IS NOT NULL GROUP BY ALL""",
    "h39_redeemers_by_channel": """
SELECT NOMBRE_CAMPANHA AS campaign, CANAL_CANJE AS channel, CAST(sum(CLIENTES) AS BIGINT) AS redeemers FROM metrics
WHERE FLAG_CANJE = 'CANJEO' GROUP BY 1, 2""",
    "h41_funnel_table": f"""
SELECT campaign, {_LABEL.format(c='pre')} AS state, GMGC, clients, redeemers, {_spct('redeemers', 'clients')} AS pct FROM (
  SELECT NOMBRE_CAMPANHA AS campaign, GRUPO_CANJE_PRE AS pre, GMGC, CAST(sum(CLIENTES) AS BIGINT) AS clients,
    {_clients("FLAG_CANJE = 'CANJEO'")} AS redeemers
  FROM metrics WHERE GRUPO_CANJE_PRE IN ({_STATES}) AND GMGC IN ('GM','GC') GROUP BY 1, 2, 3)""",
    "h45_calibration_by_segment": """
SELECT *, CASE WHEN abs(gap_pp) <= 5 THEN 'good' WHEN abs(gap_pp) <= 10 THEN 'fair' WHEN abs(gap_pp) > 10 THEN 'poor' END AS band FROM calib""",
    "h45_calibration_kpis": """
SELECT count(*) AS segments, round(avg(abs(gap_pp)), 1) AS mae_pp, round(avg(gap_pp), 1) AS bias_pp FROM calib WHERE real_gm_pct IS NOT NULL""",
    "h46_audience": f"SELECT count(*) AS audience FROM rfm WHERE {_AUDIENCE}",
    "h47_audience_plan": f"""
SELECT rfm_segment, audience, round(e, 4) AS expected_redeemers, round(e / audience * 100, 4) AS conv_pct, round(e * pts, 2) AS expected_points,
  round(e * pts * 0.01::DOUBLE, 4) AS expected_cost
FROM (SELECT rfm_segment, count(*) AS audience, sum({_PLAN_P}) AS e FROM rfm WHERE {_AUDIENCE} GROUP BY 1)
CROSS JOIN (SELECT median(monetary_monthly_avg) AS pts FROM rfm)""",
    "h47_plan_totals": f"""
SELECT audience, round(e, 4) AS expected_redeemers, round(e / audience * 100, 4) AS conv_pct, round(e * pts, 2) AS expected_points,
  round(e * pts * 0.01::DOUBLE, 4) AS expected_cost
FROM (SELECT count(*) AS audience, sum({_PLAN_P}) AS e FROM rfm WHERE {_AUDIENCE})
CROSS JOIN (SELECT median(avg_redeem_points) AS pts FROM rfm)""",
    "h48_send_history": "SELECT * FROM history",
    "h49_monthly_trend": """
SELECT strftime(send_date, '%Y-%m') AS month, count(campaign) AS campaigns, round(avg(pct_gm), 6) AS mean_pct_gm FROM history GROUP BY 1""",
    "i1_downsample_counts": """
SELECT canjeo_5d, CAST(CASE WHEN canjeo_5d THEN n ELSE least(n, 5 * pos) END AS BIGINT) AS n FROM (
  SELECT canjeo_5d, count(*) AS n FROM outcome GROUP BY 1)
CROSS JOIN (SELECT count(*) FILTER (canjeo_5d) AS pos FROM outcome)""",
    "e10_union_of_samples": """
SELECT CAST(pos + least(neg, 5 * pos) AS BIGINT) AS n, pos AS positives, CAST(pos + least(neg, 5 * pos) AS BIGINT) AS sends
FROM (SELECT count(*) FILTER (canjeo_5d) AS pos, count(*) FILTER (NOT canjeo_5d) AS neg FROM outcome)""",
    "i2_campaign_context": """
SELECT nombre_campanha, cust_id, CAST(month(fecha_envio) AS INT) AS mes_envio, CAST(isodow(fecha_envio) - 1 AS INT) AS dia_semana_envio,
  CAST(gmgc = 'GM' AS INT) AS es_gm, CAST(month(fecha_envio) = 11 AS INT) AS es_cyber_month, CAST(month(fecha_envio) = 12 AS INT) AS es_diciembre
FROM outcome""",
    "i3_prepared_features": """
SELECT nombre_campanha, o.cust_id, coalesce(tier, 'None') AS tier, coalesce(gender, 'None') AS gender, coalesce(CAST(city AS VARCHAR), 'None') AS city,
  coalesce(points_pressure, 0.0::DOUBLE) AS points_pressure,
  CAST(CASE WHEN upper(contact_push_flg) IN ('1','TRUE','SI','YES','Y') THEN 1 ELSE 0 END AS DOUBLE) AS contact_push_flg,
  CAST(CASE WHEN gmgc = 'GM' THEN 1 ELSE 0 END AS DOUBLE) AS es_gm, CAST(age AS DOUBLE) AS age
FROM outcome o JOIN rfm r ON r.cust_id = o.cust_id""",
    "i4_ordinal_codes": """
SELECT cust_id, CAST((SELECT count(*) FROM (SELECT DISTINCT coalesce(tier, 'None') AS t FROM rfm) WHERE t < coalesce(r.tier, 'None')) AS INT) AS tier_code,
  CAST((SELECT count(*) FROM (SELECT DISTINCT coalesce(dominant_retailer, 'None') AS t FROM rfm) WHERE t < coalesce(r.dominant_retailer, 'None')) AS INT) AS dominant_retailer_code
FROM rfm r""",
    "i6_temporal_split": """
SELECT CASE WHEN fecha_envio <= cutoff THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(*) FILTER (canjeo_5d) AS positives,
  max(fecha_envio) AS last_send
FROM outcome CROSS JOIN (SELECT last AS cutoff FROM (SELECT nombre_campanha, max(fecha_envio) AS last FROM outcome GROUP BY 1) ORDER BY last
  OFFSET (SELECT CAST(floor(count(DISTINCT nombre_campanha) * 0.8) AS BIGINT) FROM outcome) LIMIT 1) GROUP BY 1""",
    "e6_temporal_cutoff": """
SELECT last AS cutoff FROM (SELECT last, row_number() OVER (ORDER BY last) AS rn, count(*) OVER () AS n
  FROM (SELECT nombre_campanha, max(fecha_envio) AS last FROM outcome GROUP BY 1)) WHERE rn = CAST(floor(n * 0.8) AS BIGINT) + 1""",
    "i10_prior_correction": "SELECT nombre_campanha, cust_id, round(cal, 8) AS cal FROM eval_cal",
    "i11_rescaled_scores": "SELECT nombre_campanha AS NOMBRE_CAMPANHA, cust_id, round(p_5dias, 8) AS p_5dias FROM predicted",
    "i12_ranking_metrics": """
SELECT round(sum(pos * (neg_below + neg / 2)) / (max(all_pos) * max(all_neg)), 8) AS auc,
  round(sum(pos * (hits / (hits + alarms))) / max(all_pos), 8) AS average_precision
FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS neg_below,
    (sum(pos) OVER (ORDER BY p DESC))::DOUBLE AS hits, (sum(neg) OVER (ORDER BY p DESC))::DOUBLE AS alarms,
    (sum(pos) OVER ())::DOUBLE AS all_pos, (sum(neg) OVER ())::DOUBLE AS all_neg
  FROM (SELECT p, count(*) FILTER (canjeo_5d) AS pos, count(*) FILTER (NOT canjeo_5d) AS neg FROM eval_cal GROUP BY p))""",
    "i14_brier": "SELECT round(avg((cal - CAST(canjeo_5d AS INT)) * (cal - CAST(canjeo_5d AS INT))), 8) AS brier FROM eval_cal",
    "i15_decile_table": "SELECT * FROM deciles",
    "e5_top_decile_lift": "SELECT arg_max(lift, decile) AS top_lift FROM deciles",
    "i7_training_facts": """
SELECT CAST(pos + least(neg, 5 * pos) AS BIGINT) AS n_rows, camps AS n_campaigns, cutoff AS cutoff_date, round(rate, 8) AS base_rate_real
FROM (SELECT count(*) FILTER (canjeo_5d) AS pos, count(*) FILTER (NOT canjeo_5d) AS neg, avg(CAST(canjeo_5d AS INT)) AS rate,
  count(DISTINCT nombre_campanha) AS camps FROM outcome)
CROSS JOIN (SELECT last AS cutoff FROM (SELECT last, row_number() OVER (ORDER BY last) AS rn, count(*) OVER () AS n
  FROM (SELECT nombre_campanha, max(fecha_envio) AS last FROM outcome GROUP BY 1)) WHERE rn = CAST(floor(n * 0.8) AS BIGINT) + 1)""",
    # the fit at a score: the greatest, over starts up to it, of the least mean from the start to an end not before it
    "i9_isotonic": """
SELECT nombre_campanha, cust_id, round(p, 8) AS p, round(moved / (1 + moved), 8) AS cal FROM (
  SELECT nombre_campanha, cust_id, p, iso / (1 - iso + 1e-9) * ((0.02 / (1 - 0.02 + 1e-9)) / (avg_iso / (1 - avg_iso + 1e-9))) AS moved FROM (
    SELECT e.nombre_campanha, e.cust_id, e.p, iso, avg(iso) OVER () AS avg_iso FROM eval_cal e JOIN (
      SELECT k.p, max(m.least_mean) AS iso FROM (
        SELECT j.r AS j, i.r AS i, min((i.s - j.s + j.pos) / (i.c - j.c + j.n)) OVER (PARTITION BY j.r ORDER BY i.r DESC) AS least_mean
        FROM (SELECT *, row_number() OVER (ORDER BY p) AS r, sum(pos) OVER (ORDER BY p) AS s, sum(n) OVER (ORDER BY p) AS c
              FROM (SELECT p, count(*) FILTER (canjeo_5d)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM eval_cal GROUP BY p)) j
        JOIN (SELECT row_number() OVER (ORDER BY p) AS r, sum(pos) OVER (ORDER BY p) AS s, sum(n) OVER (ORDER BY p) AS c
              FROM (SELECT p, count(*) FILTER (canjeo_5d)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM eval_cal GROUP BY p)) i ON i.r >= j.r) m
      JOIN (SELECT p, row_number() OVER (ORDER BY p) AS r FROM (SELECT DISTINCT p FROM eval_cal)) k ON k.r = m.i GROUP BY k.p) f ON f.p = e.p))""",
    "i8_scored_customers": "SELECT count(*) AS n, count(DISTINCT cust_id) AS customers, count(*) AS in_range FROM rfm",
    "i16_importance_facts": "SELECT CAST(51 AS BIGINT) AS n_features, 1.0::DOUBLE AS total",
    "i17_saved_model": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_different, true AS same_facts FROM rfm",
    "i18_campaign_rates": """
SELECT nombre_campanha, count(*) AS n, round(avg(CAST(flag_canje = 'CANJEO' AS INT)), 8) AS rate, true AS keeps_rate, count(*) AS in_range FROM attr GROUP BY 1""",
}
