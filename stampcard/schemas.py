"""Column contracts of the input entities."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "clients": (
        "cust_id BIGINT, cat_cust_name STRING, cust_gender_desc STRING, cust_age_num INT, city_name STRING, "
        "cust_active_cmr_flg STRING, cust_active_deb_flg STRING, cust_active_omp_flg STRING, "
        "contact_email_flg STRING, contact_phone_flg STRING, contact_push_flg STRING, "
        "cust_stock_point_amt BIGINT, exp_point_current_month_amt BIGINT, exp_point_next_month_amt BIGINT, "
        "cust_enroll_date DATE, partition_date DATE"
    ),
    "transactions": (
        "cust_id BIGINT, tran_id BIGINT, tran_date DATE, tran_amt BIGINT, tran_type STRING, tran_valid_flg INT, "
        "channel_name STRING, payment_method_name STRING"
    ),
    "redemptions": (
        "cust_id BIGINT, redemption_id_unico BIGINT, redemption_date DATE, mes DATE, redemption_points_amt BIGINT, "
        "return_flag BOOLEAN, bu_channel_name STRING, price_type_desc STRING"
    ),
    "sends": (
        "fecha_envio DATE, nombre_campanha STRING, rut BIGINT, gmgc STRING, tipo_cliente STRING, canal STRING, "
        "tipo_medicion STRING, tipo_campanha STRING, email_corporativo STRING, inicio_vigencia DATE, fin_vigencia DATE"
    ),
    "mail_sent": "id_jobenvio INT, fecha_sent DATE, fecha_real DATE, email_cliente STRING",
    "mail_job": "id_jobenvio INT, fecha_real DATE, desc_emailname STRING",
    "email_metrics": (
        "id_jobenvio INT, campaign_name STRING, casos BIGINT, inicio_vigencia DATE, fin_vigencia DATE, "
        "flag_vigencia INT, desc_emailname STRING, desc_asunto STRING, total_mails BIGINT, total_opens BIGINT, "
        "total_clicks BIGINT, total_bounces BIGINT, total_unsubs BIGINT, porc_envio DOUBLE"
    ),
    "funnel": (
        "partition_date DATE, cust_id BIGINT, loy_categoria STRING, flag_acumulador INT, flag_canjeador_12_24m INT, "
        "ultima_compra DATE, ultimo_canje DATE"
    ),
    "metrics": (
        "FECHA_ENVIO DATE, NOMBRE_CAMPANHA STRING, TIPO_CLIENTE STRING, CANAL_CANJE STRING, GMGC STRING, "
        "FLAG_CANJE STRING, TIPO STRING, GRUPO_CANJE_PRE STRING, GRUPO_CANJE_POST STRING, CLIENTES BIGINT, "
        "CANJES BIGINT, PUNTOS_CANJEADOS BIGINT"
    ),
}


def schema(entity: str) -> StructType:
    return StructType.fromDDL(_DDL[entity])
