"""Row filters; all are plain predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Event types of a sample and of a visit, routes that no map shows.
SAMPLE_EVENTS = (15,)
VISIT_EVENTS = (10, 12, 14, 53, 63, 46)
HIDDEN_ROUTES = ("EMPLEADOS", "TRANSPORTADORA")


def valid_orders(df: DataFrame) -> DataFrame:
    """Active, not cancelled, authorised, without a pending discount, of document types 0 and 1."""
    return df.where(
        (F.col("estado_pedido") == 1)
        & (F.col("anulada") == 0)
        & F.col("autorizar").isin(1, 2)
        & (F.col("autorizacion_descuento") == 0)
        & (F.col("tipo_documento") < 2)
    )


def in_center(df: DataFrame, centre: int, column: str = "id_centroope") -> DataFrame:
    """Rows of an operating centre, by the fact's own column or by the city's (``column`` says which)."""
    return df.where(F.col(column) == centre)


def between_dates(df: DataFrame, column: str, start: str, end: str, end_mode: str = "closed") -> DataFrame:
    """Days start to end. ``closed`` ends at 23:59:59 of the last day, ``midnight`` at its first moment."""
    last = f"{end} 23:59:59" if end_mode == "closed" else f"{end} 00:00:00"
    lo, hi = (F.lit(f"{t}").cast("timestamp_ntz") for t in (f"{start} 00:00:00", last))
    return df.where(F.col(column).between(lo, hi))


def between_values(df: DataFrame, column: str, lo: Any, hi: Any) -> DataFrame:
    """Closed range; an end that is None is open."""
    if lo is not None:
        df = df.where(F.col(column) >= F.lit(lo))
    if hi is not None:
        df = df.where(F.col(column) <= F.lit(hi))
    return df


def open_balances(df: DataFrame, age_min: int, age_max: int) -> DataFrame:
    return df.where((F.col("saldo") > 0) & (F.col("anulada") == 0) & F.col("edad_factura").between(age_min, age_max))


def of_types(df: DataFrame, ids: Sequence[int], column: str = "id_evento_tipo") -> DataFrame:
    return df.where(F.col(column).isin(*ids))


def with_position(df: DataFrame, lat: str, lon: str, mode: str = "nonzero") -> DataFrame:
    """Rows whose coordinates are both not zero, not null, or finite numbers."""
    for c in (lat, lon):
        x = F.col(c)
        if mode == "nonzero":
            df = df.where(x != 0)
        elif mode == "notnull":
            df = df.where(x.isNotNull())
        elif mode == "finite":
            df = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        else:
            raise ValueError(f"unknown mode {mode}")
    return df


def optional_filter(df: DataFrame, column: str, wanted: Any = None) -> DataFrame:
    """Equality with a value or membership of a list; nothing wanted, no filter."""
    if not wanted and wanted != 0:
        return df
    return df.where(F.col(column).isin(*wanted) if isinstance(wanted, (list, tuple, set)) else F.col(column) == wanted)


def exclude_routes(df: DataFrame, column: str = "nom_ruta", names: Sequence[str] = HIDDEN_ROUTES) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*names))


def busy_days(daily: DataFrame, min_count: int, column: str = "cantidad") -> DataFrame:
    """Days with more than ``min_count``."""
    return daily.where(F.col(column) > min_count)


def known_estrato(df: DataFrame, column: str = "id_estrato") -> DataFrame:
    return df.where(F.col(column) != 0)
