"""Column functions of the field-operations domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented capitals and their plain forms; cluster radius in pixels up to each zoom.
ACCENTED, PLAIN = "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "AAAAAEEEEIIIIOOOOOUUUUNC"
ZOOM_RADIUS = ((11, 120), (12, 80), (13, 60), (14, 40))
LAST_RADIUS = 30


def normalise_city(name: Column) -> Column:
    """Upper case without accents, for comparing city names."""
    return F.translate(F.upper(name), ACCENTED, PLAIN)


def day_span(start: Column, end: Column, inclusive: bool = True) -> Column:
    return F.datediff(end, start) + (1 if inclusive else 0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0, negative or null."""
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(F.lit(0.0)).cast("double")


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column, wrap: bool = False) -> Column:
    """Angle of a step in degrees, counter-clockwise from east; in [0, 360) if wrapped."""
    angle = F.degrees(F.atan2(lat2 - lat1, lon2 - lon1))
    return F.pmod(angle, F.lit(360.0)) if wrap else angle


def bearing_class(angle: Column) -> Column:
    """up, left, down or right of an angle in degrees; right if null."""
    a = F.pmod(angle, F.lit(360.0))
    return (
        F.when((a >= 45) & (a < 135), "up").when((a >= 135) & (a < 225), "left").when((a >= 225) & (a < 315), "down")
    ).otherwise("right")


def zoom_radius(zoom: Column) -> Column:
    out = F.lit(LAST_RADIUS)
    for most, radius in reversed(ZOOM_RADIUS):
        out = F.when(zoom <= most, radius).otherwise(out)
    return out


def mercator_pixels(lat: Column, lon: Column, zoom: Column) -> tuple[Column, Column]:
    """Web-Mercator pixel coordinates at a zoom, to six digits so that cell edges do not depend on rounding."""
    size = F.pow(F.lit(2.0), zoom) * 256
    sine = F.sin(F.radians(lat))
    x = (lon + 180.0) / 360.0 * size
    y = (0.5 - F.log((1 + sine) / (1 - sine)) / (4 * F.lit(3.141592653589793))) * size
    return F.round(x, 6), F.round(y, 6)
