"""The four base tables that maps and statistics start from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from fieldscope.operators.conform import copy_column, event_hour, first_per, flag_on_time
from fieldscope.operators.filters import (
    SAMPLE_EVENTS, VISIT_EVENTS, between_dates, in_center, of_types, open_balances, optional_filter, valid_orders,
    with_position,
)
from fieldscope.operators.joins import balances_with_routes, events_with_dims, orders_with_dims, with_coords
from fieldscope.operators.metrics import invoices
from fieldscope.sources.tables import Tables


@dataclass(frozen=True)
class Filter:
    """What a user picks; the same for maps and statistics. None picks everything."""

    centre: int | None = None
    start: str = "1900-01-01"
    end: str = "2100-12-31"
    route: str | None = None
    barrios: tuple[str, ...] | None = None
    age_min: int = 91
    age_max: int = 120


def _picked(df: DataFrame, f: Filter, route: str = "nom_ruta") -> DataFrame:
    return optional_filter(optional_filter(df, route, f.route), "barrio", f.barrios)


def orders_base(t: Tables, f: Filter) -> DataFrame:
    """Valid orders of a centre and period with dimensions, position and on-time flag, one row per order."""
    orders = between_dates(valid_orders(t.pedidos), "fecha_hora_pedido", f.start, f.end)
    orders = in_center(orders, f.centre) if f.centre is not None else orders
    orders = flag_on_time(orders, "fecha_hora_entrega", "promesa_entrega")
    columns = ("id", "id_contacto", "id_barrio", "id_centroope", "fecha_pedido", "fecha_hora_pedido", "pedido_a_tiempo")
    orders = first_per(orders.select(*columns), "id", ["fecha_hora_pedido", "id_barrio"])
    places = first_per(t.coords, "id_barrio", ["latitud", "longitud", "nom_ruta"])
    return _picked(with_coords(orders_with_dims(orders, t.barrios, t.ciudades), places), f)


def _events(t: Tables, f: Filter, types: tuple[int, ...], route: str) -> DataFrame:
    events = with_position(of_types(t.eventos, types), "coordenada_latitud", "coordenada_longitud", "nonzero")
    events = event_hour(between_dates(events, "fecha_evento", f.start, f.end), "fecha_evento")
    rows = events_with_dims(events, t.contactos, t.barrios, t.ciudades)
    rows = in_center(rows, f.centre) if f.centre is not None else rows
    return _picked(with_coords(rows, t.coords), f, route)


def samples_base(t: Tables, f: Filter) -> DataFrame:
    """Sample drops with a position, of a city's centre and a period; a route is a logistic one."""
    return _events(t, f, SAMPLE_EVENTS, "nom_ruta")


def visits_base(t: Tables, f: Filter) -> DataFrame:
    """Collection visits with a position, of a city's centre and a period; a route is a collection one."""
    return _events(t, f, VISIT_EVENTS, "ruta_cobro")


def debt_base(t: Tables, f: Filter, dedupe: str = "contact") -> DataFrame:
    """Overdue invoices with routes and position. One row per contact (its lowest invoice), or per invoice.

    Both keep the first collection route by id. Optional sale dates are the filter's start and end. Debts are
    grouped and picked by collection route, which stands in nom_ruta too.
    """
    rows = balances_with_routes(open_balances(t.saldos, f.age_min, f.age_max), t.barrios, t.rutas_cobro_zonas, t.rutas_cobro, t.ciudades)
    rows = invoices(in_center(rows, f.centre) if f.centre is not None else rows)
    rows = first_per(rows, "id_contacto" if dedupe == "contact" else "num_factura", ["num_factura", "id_ruta_cobro"])
    rows = rows.where(f"fecha_venta between date'{f.start}' and date'{f.end}'")
    return _picked(copy_column(with_coords(rows, t.coords), "ruta_cobro", "nom_ruta"), f, "ruta_cobro")
