"""Each map as its layer tables, each statistics page as its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.durable import cut
from fieldscope.operators.filters import (
    HIDDEN_ROUTES, SAMPLE_EVENTS, VISIT_EVENTS, between_dates, of_types, with_position,
)
from fieldscope.operators.layers import cluster, density_layer, event_layer, heat_layer, marker_layer
from fieldscope.operators.metrics import (
    POINT, agents, breaks, cuts, debt_kpis, debt_state, density_kpis, event_kpis, frequencies, on_map, order_kpis, point_state, shares, top_values,
)
from fieldscope.operators.sessions import PAUSE, day_legs, day_routes
from fieldscope.operators.spatial import misassigned
from fieldscope.operators.trends import daily_counts, overloaded, trend
from fieldscope.plans.bases import Filter, debt_base, orders_base, samples_base, visits_base
from fieldscope.sources.tables import Tables

EVENT_ATTRIBUTES = ("idEvento", "id_autor", "tipo_evento", "fecha_evento", "hora_evento")
ZOOMS = tuple(range(10, 16))
INDICATORS = ("cobertura", "contactabilidad", "efectividad")


def orders_map(t: Tables, f: Filter, alternative: bool = False) -> dict[str, DataFrame]:
    """Markers, heat, clusters and key figures of orders; the alternative has fewer figures and tighter clusters.

    As on every map with points, the facts are read once: all layers come from one written state by point.
    """
    state = cut(point_state(orders_base(t, f), a_tiempo=F.sum("pedido_a_tiempo")))
    at = on_map(state, "cantidad")
    radius, until = (80, 15) if alternative else (2000, 14)
    kpi = order_kpis(state.withColumnRenamed("a_tiempo", "pedido_a_tiempo"), f.start, f.end, on_time=not alternative, rows="cantidad")
    return {
        "markers": marker_layer(at, "cantidad"),
        "heat": heat_layer(at, "cantidad"),
        "clusters": cluster(at, "cantidad", ZOOMS, radius, points_from=until),
        "kpi": kpi,
    }


def visits_map(t: Tables, f: Filter, grouped: bool = True) -> dict[str, DataFrame]:
    base = visits_base(t, f)
    if not grouped:
        rows = with_position(base, "coordenada_latitud", "coordenada_longitud", "notnull")
        return {"events": event_layer(rows, EVENT_ATTRIBUTES), "kpi": event_kpis(base, f.start, f.end)}
    state = cut(point_state(base, POINT))
    at = on_map(state, "cantidad", POINT)
    return {
        "markers": at,
        "heat": heat_layer(at, "cantidad"),
        "clusters": cluster(at, "cantidad", ZOOMS, by=None),
        "kpi": event_kpis(state, f.start, f.end, rows="cantidad"),
    }


def samples_map(t: Tables, f: Filter) -> dict[str, DataFrame]:
    base = samples_base(t, f)
    return {"events": event_layer(base, EVENT_ATTRIBUTES), "kpi": event_kpis(base, f.start, f.end)}


def debt_map(t: Tables, f: Filter, dedupe: str = "contact") -> dict[str, DataFrame]:
    state = cut(debt_state(debt_base(t, f, dedupe)))
    at = on_map(state, "valor_mora")
    return {
        "markers": marker_layer(at, "valor_mora"),
        "heat": heat_layer(at, "valor_mora"),
        "clusters": cluster(at, "valor_mora", ZOOMS, 2000, points_from=14),
        "kpi": debt_kpis(state, summed=True),
    }


def _densities(t: Tables, centre: int | None = None) -> DataFrame:
    """The indicators of all neighbourhoods, or of those of a centre's cities."""
    if centre is None:
        return t.densidades
    cities = t.ciudades.where(F.col("id_centroope") == centre).select(F.col("id").alias("id_ciudad"))
    return t.densidades.join(t.barrios.join(cities, "id_ciudad", "left_semi").select("barrio"), "barrio", "left_semi")


def density_map(t: Tables, indicator: str, centre: int | None = None) -> dict[str, DataFrame]:
    """Coverage lifts small values by a root; the other indicators are put on [0, 1]. Facts are read once, too."""
    at = cut(_densities(t, centre))
    return {
        "points": density_layer(at, indicator),
        "heat": heat_layer(at, indicator, "power" if indicator == "cobertura" else "minmax"),
        "clusters": cluster(at, indicator, ZOOMS, by=None, how="avg"),
        "breaks": cuts(at, indicator) if indicator == "cobertura" else breaks(at, indicator),
        "kpi": density_kpis(at, indicator),
    }


def density_batch(t: Tables) -> DataFrame:
    """(ciudad, indicador, barrios, promedio): the key figures of every city's three density maps, in one pass over all."""
    of_city = t.barrios.join(t.ciudades.select(F.col("id").alias("id_ciudad"), "ciudad"), "id_ciudad").select("barrio", "ciudad").distinct()
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("indicador"), F.col(i).alias("v")) for i in INDICATORS])).alias("e")
    rows = t.densidades.join(of_city, "barrio").select("ciudad", "barrio", each).select("ciudad", "barrio", "e.indicador", "e.v")
    return rows.groupBy("ciudad", "indicador").agg(F.countDistinct("barrio").alias("barrios"), F.avg("v").alias("promedio"))


def agent_routes(t: Tables, f: Filter, pause: int = PAUSE) -> DataFrame:
    """Every agent's stops at samples and visits, day by day, split where the agent pauses."""
    stops = with_position(of_types(t.eventos, SAMPLE_EVENTS + VISIT_EVENTS), "coordenada_latitud", "coordenada_longitud", "nonzero")
    stops = between_dates(stops, "fecha_evento", f.start, f.end)
    return day_routes(stops, "id_autor", "fecha_evento", "idEvento", "coordenada_latitud", "coordenada_longitud", pause)


def agent_legs(t: Tables, f: Filter, pause: int = PAUSE) -> DataFrame:
    return day_legs(agent_routes(t, f, pause), "id_autor", "fecha_evento")


def zone_loads(t: Tables, f: Filter) -> dict[str, DataFrame]:
    """Each neighbourhood's daily visits and orders against its own recent past."""
    facts = {"visits": (visits_base(t, f), "fecha_evento"), "orders": (orders_base(t, f), "fecha_pedido")}
    daily = {k: df.groupBy("barrio", F.to_date(ts).alias("fecha")).agg(F.count("*").alias("cantidad")) for k, (df, ts) in facts.items()}
    return {k: overloaded(df, "barrio") for k, df in daily.items()}


def misassigned_contacts(t: Tables, f: Filter) -> DataFrame:
    """Contacts whose events lie nearer to another route's centre than to their own's.

    A contact is where its events of the period are on average; a route's centre is the mean of its contacts. Sums are of
    whole units of the fifth digit, so that no order of adding changes them.
    """
    unit = lambda c: F.round(F.col(c) * 100000).cast("long")
    mean = lambda c, n: F.round(F.sum(c) / F.sum(n) / 100000, 9)
    events = with_position(t.eventos, "coordenada_latitud", "coordenada_longitud", "nonzero")
    events = between_dates(events, "fecha_evento", f.start, f.end)
    per = events.groupBy("id_contacto").agg(
        F.sum(unit("coordenada_latitud")).alias("y"), F.sum(unit("coordenada_longitud")).alias("x"), F.count("*").alias("n")
    )
    routes = t.contactos.select(F.col("id").alias("id_contacto"), "id_barrio").join(t.coords.select("id_barrio", "nom_ruta"), "id_barrio")
    per = cut(per.join(routes.where("nom_ruta is not null"), "id_contacto"))
    places = per.groupBy("id_contacto", "nom_ruta").agg(mean("y", "n").alias("latitud"), mean("x", "n").alias("longitud"))
    centres = per.groupBy("nom_ruta").agg(mean("y", "n").alias("latitud"), mean("x", "n").alias("longitud"))
    return misassigned(places, centres, "id_contacto", "nom_ruta")


def _common(base: DataFrame, ts: str, min_count: int) -> dict[str, DataFrame]:
    return {
        "barrios": top_values(base, "barrio", 10),
        "trend": trend(daily_counts(base, ts), min_count),
        "estratos": shares(base, "id_estrato", exclude=(0,)),
    }


def stats_orders(t: Tables, f: Filter, min_count: int = 15) -> dict[str, DataFrame]:
    base = orders_base(t, f)
    out = _common(base, "fecha_pedido", min_count)
    return out | ({} if f.route else {"rutas": frequencies(base, "nom_ruta", exclude=HIDDEN_ROUTES)})


def stats_samples(t: Tables, f: Filter, min_count: int = 15) -> dict[str, DataFrame]:
    return _common(samples_base(t, f), "fecha_evento", min_count)


def stats_visits(t: Tables, f: Filter, min_count: int = 15) -> dict[str, DataFrame]:
    base = visits_base(t, f)
    out = _common(base, "fecha_evento", min_count) | {"tipos": frequencies(base, "tipo_evento")}
    return out | ({} if f.route else {"rutas": frequencies(base, "ruta_cobro")})


def agents_by_city(t: Tables, centre: int, start: str, end: str) -> DataFrame:
    """Distinct authors of events with a position in a city; the last day ends at its first moment."""
    events = of_types(t.eventos, SAMPLE_EVENTS + VISIT_EVENTS)
    events = with_position(events, "coordenada_latitud", "coordenada_longitud", "nonzero")
    events = between_dates(events, "fecha_evento", start, end, "midnight")
    cities = t.ciudades.where(F.col("id_centroope") == centre).select(F.col("id").alias("id_ciudad"))
    contacts = t.contactos.join(cities, "id_ciudad", "left_semi").select(F.col("id").alias("id_contacto"))
    return agents(events.join(contacts, "id_contacto", "left_semi"))
