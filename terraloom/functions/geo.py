"""WGS84 to a local transverse Mercator frame, and back, by Krueger series of the third flattening."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257223563
_N = FLATTENING / (2 - FLATTENING)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
# The series to the fourth order.
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630]


def _forward(lat: Column, dlon: Column) -> tuple[Column, Column]:
    """(easting, northing) from the equator and the central meridian; radians."""
    s = F.sin(lat)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return _A * east, _A * north


def to_local(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of the origin; null without an origin."""
    east, north = _forward(F.radians(lat), F.radians(lon - lon0))
    known = lat0.isNotNull() & lon0.isNotNull()
    return F.when(known, east), F.when(known, north - _forward(F.radians(lat0), F.lit(0.0))[1])


def to_wgs84(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of a local place."""
    xi, eta = (y + _forward(F.radians(lat0), F.lit(0.0))[1]) / _A, x / _A
    for_xi, for_eta = xi, eta
    for k, b in enumerate(_BETA, 1):
        for_xi = for_xi - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        for_eta = for_eta - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(for_xi) / F.cosh(for_eta))
    phi = chi
    for k, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * k * chi)
    return F.degrees(phi), lon0 + F.degrees(F.atan2(F.sinh(for_eta), F.cos(for_xi)))


def wkt(lat0: Column, lon0: Column) -> Column:
    """Well-known text of the local frame."""
    text = (
        'PROJCS["Local Transverse Mercator",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],'
        'PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],'
        'PARAMETER["latitude_of_origin",%s],PARAMETER["central_meridian",%s],PARAMETER["scale_factor",1],'
        'PARAMETER["false_easting",0],PARAMETER["false_northing",0],UNIT["metre",1]]'
    )
    return F.format_string(text, lat0.cast("string"), lon0.cast("string"))
