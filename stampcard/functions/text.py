"""Name normalisation, flags and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings accepted as "yes" by the model flags and by the redeemed flag.
MODEL_TRUE = ["1", "TRUE", "SI", "YES", "Y"]
REDEEMED_TRUE = ["CANJEO", "1", "TRUE", "SI", "S"]

# Lifecycle states in funnel order with their display labels.
FUNNEL_LABELS = {
    "NO_CANJEADOR_HISTORICO": "Sin historial de canje",
    "FUGADOS": "Fugados",
    "NUEVO": "Nuevo canjeador",
    "RECUPERADO": "Recuperado",
    "RECURRENTE": "Recurrente",
}
FUNNEL_ORDER = list(FUNNEL_LABELS)


def squash(name: Column) -> Column:
    """Remove spaces only; join key between send base and mail jobs."""
    return F.replace(name, F.lit(" "), F.lit(""))


def norm_campaign(name: Column) -> Column:
    """Trimmed, upper-cased, space-free campaign key of the reports."""
    return squash(F.upper(F.trim(name)))


def base_key(key: Column) -> Column:
    """Campaign key without a trailing ``_DDMMYYYY``."""
    return F.regexp_replace(key, r"_\d{8}$", "")


def truthy(value: Column, accepted: list[str]) -> Column:
    return F.coalesce(F.upper(value.cast("string")).isin(accepted), F.lit(False))


def is_redeemed(flag: Column) -> Column:
    return truthy(flag, REDEEMED_TRUE)


def mentions(value: Column, *needles: str) -> Column:
    """Case-insensitive substring test against any of ``needles``; null is not a match."""
    text = F.upper(value)
    found = F.lit(False)
    for needle in needles:
        found = found | F.coalesce(text.contains(needle.upper()), F.lit(False))
    return found


def label_of(value: Column, labels: dict[str, str]) -> Column:
    """Mapped label, or the value itself where no label is known."""
    out = value
    for key, label in labels.items():
        out = F.when(value == key, label).otherwise(out)
    return out


def position_in(value: Column, order: list[str], default: int = 99) -> Column:
    """Sort position of ``value`` in a fixed order."""
    out = F.lit(default)
    for index, item in enumerate(order):
        out = F.when(value == item, index).otherwise(out)
    return out
