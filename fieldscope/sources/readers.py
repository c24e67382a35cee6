"""Readers with explicit schemas: JDBC, CSV, and the two GeoJSON shapes of route zones."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.operators.ordering import quantile_bounds

COORDS = "id_barrio bigint, barrio string, latitud double, longitud double, ruta_cobro string, nom_ruta string"
DENSITY = "barrio string, latitud double, longitud double, cobertura double, contactabilidad double, efectividad double"
#: The menu files of a city and their one column.
MENUS = {"rutas_logistica": "nombre_ruta", "rutas_cobro": "ruta", "barrios": "barrio"}


#: Fixed value: what every feature has once, its type; files are cut here.
FEATURE_MARK = '"Feature"'
FEATURE = "properties map<string, string>, geometry struct<type: string, coordinates: string>"


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: int | None = None, upper: int | None = None,
    partitions: int = 8, **options: str,
) -> DataFrame:
    """A table read in parallel ranges of an integral column; filters and columns are pushed to the source.

    Without ``lower`` and ``upper`` the ranges hold about equally many rows, whatever gaps the column has: the
    source tells its least and greatest value, the column alone is read once in even ranges, and its quantiles
    bound the ranges of the table. Rows with a null there come with the first range.
    """
    reader = lambda: spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    ranged = lambda lo, hi: reader().options(partitionColumn=partition_column, lowerBound=lo, upperBound=hi, numPartitions=partitions).load()
    if lower is not None and upper is not None:
        return ranged(lower, upper)
    ends = reader().load().agg(F.min(partition_column).alias("lo"), F.max(partition_column).alias("hi")).first()
    if ends["lo"] is None or ends["lo"] == ends["hi"]:
        return reader().load()
    bounds = quantile_bounds(ranged(ends["lo"], ends["hi"]).select(partition_column), partition_column, partitions)
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(partition_column)
    over, under = [f"{name} >= {b}" for b in bounds], [f"{name} < {b}" for b in bounds]
    parts = [f"{under[0]} or {name} is null", *[f"{lo} and {hi}" for lo, hi in zip(over, under[1:], strict=False)], over[-1]] if bounds else ["1 = 1"]
    return spark.read.jdbc(url, table, predicates=parts, properties=options)


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COORDS).csv(path, header=True)


def read_density(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DENSITY).csv(path, header=True)


def read_menus(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The pick lists of a city; a missing or empty file gives an empty frame."""
    found = {}
    for name, column in MENUS.items():
        try:
            found[name] = spark.read.schema(f"{column} string").csv(f"{folder}/{name}.csv", header=True)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found[name] = spark.createDataFrame([], f"{column} string")
    return found


def features(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry): a row per feature of FeatureCollections, single Features, or Features line by line.

    Spark's text reader cuts files at each feature's type, so that many tasks read one file and no collection
    is held whole. A feature's type must be its first member, where writers put it, and no other value may be the
    word ``Feature``; anything else fails instead of losing features. Values of properties and coordinates come as
    JSON text.
    """
    parts = spark.read.option("lineSep", FEATURE_MARK).text(path)
    # The head of a file, up to its first feature, is all that may begin otherwise than the rest of a feature.
    rest = F.when(F.col("value").rlike(r"^\s*,"), F.col("value")).when(~F.col("value").rlike(r"^\x{FEFF}?\s*[\{\[]"), F.raise_error(F.lit("a feature whose type is not its first member")))
    whole = F.concat(F.lit('{"type": "Feature"'), rest)
    parts = parts.select(whole.alias("whole")).where("whole is not null")
    return parts.select(F.from_json("whole", FEATURE, {"mode": "FAILFAST"}).alias("f")).select("f.*")


def _name() -> Column:
    return F.coalesce(F.col("properties")["NOMBRE"], F.col("properties")["nombre"])


def read_features(spark: SparkSession, path: str, axis_order: str = "lonlat") -> DataFrame:
    """(name, ring, position, latitud, longitud): the vertices of every geometry of a FeatureCollection or Feature.

    axis_order says how the file orders a coordinate pair: ``lonlat`` (collections) or ``latlon`` (single files).
    Points and lines count as one ring; a file may mix kinds. A feature without a geometry has no row.
    """
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    wrapped = F.when(kind == "Point", F.concat(F.lit("[["), text, F.lit("]]"))).when(kind.isin("MultiPoint", "LineString"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    rings = F.when(kind == "MultiPolygon", F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))).otherwise(F.from_json(wrapped, "array<array<array<double>>>"))
    points = features(spark, path).select(_name().alias("name"), F.posexplode(rings).alias("ring", "points"))
    points = points.select("name", "ring", F.posexplode("points").alias("position", "pair"))
    lon, lat = (0, 1) if axis_order == "lonlat" else (1, 0)
    return points.select(
        "name", "ring", "position", F.col("pair")[lat].alias("latitud"), F.col("pair")[lon].alias("longitud")
    )


def route_zone_barrios(spark: SparkSession, path: str) -> DataFrame:
    """(barrio, ruta) from route zones whose features list their neighbourhoods; zones that only count them have no row."""
    listed = F.col("properties")["barrios"]
    found = features(spark, path).select(_name().alias("ruta"), F.when(listed.startswith("["), F.from_json(listed, "array<string>")).alias("barrios"))
    return found.select(F.explode("barrios").alias("barrio"), "ruta")
