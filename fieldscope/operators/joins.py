"""Left joins of facts with their dimensions. Sizes decide the strategy at run time; no side is forced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.scalar import normalise_city


def orders_with_dims(pedidos: DataFrame, barrios: DataFrame, ciudades: DataFrame) -> DataFrame:
    """Orders with barrio, id_estrato, ciudad."""
    b = barrios.select(F.col("id").alias("id_barrio"), "barrio", "id_estrato", "id_ciudad")
    c = ciudades.select(F.col("id").alias("id_ciudad"), "ciudad")
    return pedidos.join(b, "id_barrio", "left").join(c, "id_ciudad", "left")


def events_with_dims(eventos: DataFrame, contactos: DataFrame, barrios: DataFrame, ciudades: DataFrame) -> DataFrame:
    """Events with the contact's id_barrio, barrio, id_estrato, ciudad and the city's id_centroope."""
    k = contactos.select(F.col("id").alias("id_contacto"), "id_barrio", "id_ciudad")
    b = barrios.select(F.col("id").alias("id_barrio"), "barrio", "id_estrato")
    c = ciudades.select(F.col("id").alias("id_ciudad"), "ciudad", "id_centroope")
    return eventos.join(k, "id_contacto", "left").join(b, "id_barrio", "left").join(c, "id_ciudad", "left")


def balances_with_routes(
    saldos: DataFrame, barrios: DataFrame, zonas: DataFrame, rutas: DataFrame, ciudades: DataFrame
) -> DataFrame:
    """Balances with barrio, city and collection routes; a barrio in several zones gives several rows."""
    b = barrios.select(F.col("id").alias("id_barrio"), "barrio", "id_ciudad")
    r = rutas.select(F.col("id").alias("id_ruta_cobro"), F.col("ruta").alias("ruta_cobro"))
    c = ciudades.select(F.col("id").alias("id_ciudad"), "ciudad", "id_centroope")
    return (
        saldos.join(b, "id_barrio", "left").join(zonas, "id_barrio", "left").join(r, "id_ruta_cobro", "left")
        .join(c, "id_ciudad", "left")
    )


def with_coords(df: DataFrame, coords: DataFrame, columns: tuple[str, ...] = ("latitud", "longitud", "ruta_cobro", "nom_ruta")) -> DataFrame:
    """Position and routes by id_barrio; of columns that both have, the coordinates' value wins as it is."""
    return df.drop(*[c for c in columns if c in df.columns]).join(coords.select("id_barrio", *columns), "id_barrio", "left")


def for_city(df: DataFrame, cities: DataFrame, name: str, column: str = "id_centroope") -> DataFrame:
    """Rows of the operating centre of a city, whatever its accents and case; an unknown city gives no row."""
    wanted = cities.where(normalise_city(F.col("ciudad")) == normalise_city(F.lit(name)))
    return df.join(wanted.select(F.col("id_centroope").alias(column)), column, "left_semi")


def with_route_total(df: DataFrame, value: str, route: str = "nom_ruta", name: str = "total_ruta") -> DataFrame:
    """The route's total beside each row. Routes are few and their rows are grouped points: a window suffices."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(route)))


def keep_top(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of the k most frequent keys (ties by key)."""
    top = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)
    return df.join(top.select(key), key, "left_semi")
