"""Equal-area map projections as column expressions.

Closed forms from Snyder, "Map Projections - A Working Manual", USGS
Professional Paper 1395 (1987): the ellipsoidal cylindrical equal-area
projection (EPSG:6933, WGS 84, standard parallel 30 deg) and the
ellipsoidal oblique Lambert azimuthal equal-area projection (EPSG:3035,
GRS 80, origin 52 deg N 10 deg E, false origin 4321000 / 3210000).
Input is longitude/latitude in degrees; output metres.  Constants are
computed once on the driver and enter the plan as literals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (ellipsoids and projection parameters).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
EASE2_STD_PARALLEL = 30.0
LAEA_EUROPE_LAT0 = 52.0
LAEA_EUROPE_LON0 = 10.0
LAEA_EUROPE_FE = 4321000.0
LAEA_EUROPE_FN = 3210000.0


def _e2(f: float) -> float:
    return f * (2 - f)


def q_of(sin_phi: float, e: float) -> float:
    """Snyder's q (authalic function) for a given sin(latitude)."""
    e2 = e * e
    return (1 - e2) * (sin_phi / (1 - e2 * sin_phi ** 2)
                       - (1 / (2 * e)) * math.log((1 - e * sin_phi) / (1 + e * sin_phi)))


class CEA:
    """Constants of EPSG:6933."""
    a = WGS84_A
    e2 = _e2(WGS84_F)
    e = math.sqrt(e2)
    k0 = math.cos(math.radians(EASE2_STD_PARALLEL)) / math.sqrt(
        1 - e2 * math.sin(math.radians(EASE2_STD_PARALLEL)) ** 2)


class LAEA:
    """Constants of EPSG:3035."""
    a = GRS80_A
    e2 = _e2(GRS80_F)
    e = math.sqrt(e2)
    qp = q_of(1.0, e)
    phi0 = math.radians(LAEA_EUROPE_LAT0)
    lam0 = math.radians(LAEA_EUROPE_LON0)
    beta1 = math.asin(q_of(math.sin(phi0), e) / qp)
    rq = a * math.sqrt(qp / 2)
    d = a * (math.cos(phi0) / math.sqrt(1 - e2 * math.sin(phi0) ** 2)) / (rq * math.cos(beta1))
    sin_b1 = math.sin(beta1)
    cos_b1 = math.cos(beta1)


DEG = math.pi / 180.0


def _rad(c: Column) -> Column:
    """Degrees -> radians as one multiplication by a literal."""
    return c * F.lit(DEG)


def _q_col(sin_phi: Column, e: float) -> Column:
    e2 = e * e
    return F.lit(1 - e2) * (sin_phi / (F.lit(1.0) - F.lit(e2) * sin_phi * sin_phi)
                            - F.lit(1 / (2 * e)) * F.log((F.lit(1.0) - F.lit(e) * sin_phi)
                                                         / (F.lit(1.0) + F.lit(e) * sin_phi)))


def cea_6933(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:6933 easting, northing."""
    x = F.lit(CEA.a * CEA.k0) * _rad(lon)
    y = F.lit(CEA.a / (2 * CEA.k0)) * _q_col(F.sin(_rad(lat)), CEA.e)
    return x, y


def laea_3035(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3035 easting, northing."""
    beta = F.asin(_q_col(F.sin(_rad(lat)), LAEA.e) / F.lit(LAEA.qp))
    dlam = _rad(lon) - F.lit(LAEA.lam0)
    b = F.lit(LAEA.rq) * F.sqrt(F.lit(2.0) / (
        F.lit(1.0) + F.lit(LAEA.sin_b1) * F.sin(beta)
        + F.lit(LAEA.cos_b1) * F.cos(beta) * F.cos(dlam)))
    x = F.lit(LAEA_EUROPE_FE) + b * F.lit(LAEA.d) * F.cos(beta) * F.sin(dlam)
    y = F.lit(LAEA_EUROPE_FN) + (b / F.lit(LAEA.d)) * (
        F.lit(LAEA.cos_b1) * F.sin(beta) - F.lit(LAEA.sin_b1) * F.cos(beta) * F.cos(dlam))
    return x, y


PROJECTIONS = {6933: cea_6933, 3035: laea_3035}


def project_point(p: Column, srid: int) -> Column:
    """struct<x lon, y lat> -> struct<x, y> in the target CRS."""
    x, y = PROJECTIONS[srid](p["x"], p["y"])
    return F.struct(x.alias("x"), y.alias("y"))


def project_geometry(g: Column, srid: int) -> Column:
    """Nested geometry (parts > rings > points) reprojected vertex by
    vertex."""
    return F.transform(g, lambda part: F.transform(
        part, lambda ring: F.transform(ring, lambda p: project_point(p, srid))))
