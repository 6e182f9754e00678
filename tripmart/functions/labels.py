"""Category columns. The texts and limits are fixed values that results must carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripmart.functions.semantics import iso_weekday

# Payment codes with their labels.
PAYMENT_LABELS = {
    0: "flex fare/desconocido",
    1: "tarjeta",
    2: "efectivo",
    3: "sin cargo",
    4: "disputa",
    5: "desconocido",
    6: "anulado",
}
PAYMENT_LABEL_DEFAULT = "otro"

# The shorter list used by the yearly payment mix.
PAYMENT_GROUPS = {1: "tarjeta", 2: "efectivo", 3: "sin cargo", 4: "disputa"}
PAYMENT_GROUP_DEFAULT = "otro/desconocido"

# Upper limits in miles (exclusive) with their labels, and the open last band.
DISTANCE_BANDS = ((1, "0-1"), (3, "1-3"), (5, "3-5"), (10, "5-10"), (20, "10-20"))
DISTANCE_BAND_LAST = "20+"

# Day types.
WEEKEND, WORKDAY = "fin de semana", "laboral"

CARD = 1


def _lookup(code: Column, labels: dict[int, str], default: str) -> Column:
    chain = F
    for value, label in labels.items():
        chain = chain.when(code == value, F.lit(label))
    return chain.otherwise(F.lit(default))


def payment_label(code: Column) -> Column:
    return _lookup(code, PAYMENT_LABELS, PAYMENT_LABEL_DEFAULT)


def payment_group(code: Column) -> Column:
    return _lookup(code, PAYMENT_GROUPS, PAYMENT_GROUP_DEFAULT)


def distance_band_order(distance: Column) -> Column:
    """1-based position of the band that holds the distance."""
    chain = F
    for position, (limit, _) in enumerate(DISTANCE_BANDS, start=1):
        chain = chain.when(distance < limit, F.lit(position))
    return chain.otherwise(F.lit(len(DISTANCE_BANDS) + 1))


def distance_band_name(order: Column) -> Column:
    """Label of a band position; apply it after grouping, on a handful of rows."""
    names = {n: name for n, (_, name) in enumerate(DISTANCE_BANDS, start=1)}
    return _lookup(order, names, DISTANCE_BAND_LAST)


def day_type(ts: Column) -> Column:
    return F.when(iso_weekday(ts) >= 6, F.lit(WEEKEND)).otherwise(F.lit(WORKDAY))
