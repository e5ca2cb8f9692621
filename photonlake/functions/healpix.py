"""HEALPix pixels in numpy, from the published definition of the equal-area pixelisation (Gorski et al. 2005).

The face-and-offset coordinates of the nested scheme are the common form; ring numbers are derived from them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ring of each face's southern corner, and longitude of its center in quarter turns of 45 degrees.
FACE_RING = np.array([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4])
FACE_PHI = np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])


def _spread(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for bit in range(29):
        out |= (x >> bit & 1) << 2 * bit
    return out


def _gather(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for bit in range(29):
        out |= (x >> 2 * bit & 1) << bit
    return out


def face_xy(lon: np.ndarray, lat: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Face and pixel coordinates in it of positions in degrees."""
    z = np.sin(np.radians(lat))
    tt = np.mod(lon, 360.0) / 90.0
    equatorial = np.abs(z) <= 2 / 3
    a, b = nside * (0.5 + tt), nside * (z * 0.75)
    up, down = np.floor(a - b).astype(np.int64), np.floor(a + b).astype(np.int64)
    fu, fd = up // nside, down // nside
    face = np.where(fu == fd, fu % 4 + 4, np.where(fu < fd, fu % 4, fd % 4 + 8))
    x, y = down % nside, nside - 1 - up % nside
    quarter = np.minimum(np.floor(tt), 3).astype(np.int64)
    tp = tt - quarter
    s = nside * np.sqrt(3 * np.maximum(1 - np.abs(z), 0))
    jp = np.minimum(np.floor(tp * s).astype(np.int64), nside - 1)
    jm = np.minimum(np.floor((1 - tp) * s).astype(np.int64), nside - 1)
    north = z >= 0
    pf = np.where(north, quarter, quarter + 8)
    px, py = np.where(north, nside - jm - 1, jp), np.where(north, nside - jp - 1, jm)
    return np.where(equatorial, face, pf), np.where(equatorial, x, px), np.where(equatorial, y, py)


def to_nest(lon, lat, nside: int) -> np.ndarray:
    face, x, y = face_xy(np.asarray(lon, float), np.asarray(lat, float), nside)
    return face * nside * nside + (_spread(x) | _spread(y) << 1)


def nest_parts(ipix: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    face, rest = np.divmod(np.asarray(ipix, np.int64), nside * nside)
    return face, _gather(rest), _gather(rest >> 1)


def _ring_place(face, x, y, nside):
    """Ring from the north pole, pixels in a quarter of it, position in it from 1, and whether it is shifted."""
    jr = FACE_RING[face] * nside - x - y - 1
    nr = np.where(jr < nside, jr, np.where(jr > 3 * nside, 4 * nside - jr, nside))
    shift = np.where((jr < nside) | (jr > 3 * nside), 0, (jr - nside) & 1)
    jp = (FACE_PHI[face] * nr + x - y + 1 + shift) // 2
    jp = np.where(jp > 4 * nr, jp - 4 * nr, np.where(jp < 1, jp + 4 * nr, jp))
    return jr, nr, jp, shift


def nest_to_ring(ipix, nside: int) -> np.ndarray:
    face, x, y = nest_parts(ipix, nside)
    jr, nr, jp, _ = _ring_place(face, x, y, nside)
    before = np.where(jr < nside, 2 * nr * (nr - 1), np.where(jr > 3 * nside, 12 * nside * nside - 2 * (nr + 1) * nr, 2 * nside * (nside - 1) + (jr - nside) * 4 * nside))
    return before + jp - 1


def to_ring(lon, lat, nside: int) -> np.ndarray:
    return nest_to_ring(to_nest(lon, lat, nside), nside)


def ring_to_nest(ipix, nside: int) -> np.ndarray:
    """By way of the pixel's center."""
    return to_nest(*ring_center(ipix, nside), nside)


def _ring_of(ipix: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray]:
    ipix, cap, n = np.asarray(ipix, np.int64), 2 * nside * (nside - 1), 12 * nside * nside
    pole = lambda p: ((1 + np.sqrt(1 + 2 * p.astype(float))) / 2).astype(np.int64)
    fix = lambda i, p: np.where(2 * i * (i - 1) > p, i - 1, np.where(2 * i * (i + 1) <= p, i + 1, i))
    up = fix(pole(np.maximum(ipix, 0)), ipix)
    rev = n - 1 - ipix
    low = fix(pole(np.maximum(rev, 0)), rev)
    ring = np.where(ipix < cap, up, np.where(ipix < n - cap, (ipix - cap) // (4 * nside) + nside, 4 * nside - low))
    start = np.where(ipix < cap, 2 * up * (up - 1), np.where(ipix < n - cap, cap + (ring - nside) * 4 * nside, n - 2 * low * (low + 1)))
    return ring, ipix - start + 1


def ring_center(ipix, nside: int) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat) of pixel centers."""
    ring, j = _ring_of(ipix, nside)
    nr = np.where(ring < nside, ring, np.where(ring > 3 * nside, 4 * nside - ring, nside))
    z = np.where(ring < nside, 1 - nr * nr / (3.0 * nside * nside), np.where(ring > 3 * nside, nr * nr / (3.0 * nside * nside) - 1, (2 * nside - ring) * 2 / (3.0 * nside)))
    half = np.where((ring < nside) | (ring > 3 * nside), 0.5, np.where((ring - nside) % 2 == 0, 0.5, 1.0))
    return 90.0 * (j - half) / nr, np.degrees(np.arcsin(np.clip(z, -1, 1)))


def nest_center(ipix, nside: int) -> tuple[np.ndarray, np.ndarray]:
    return ring_center(nest_to_ring(ipix, nside), nside)


def pixel_of(nside: int, nested: bool = False):
    """Arrow UDF from (lon, lat) to pixel numbers."""

    @F.pandas_udf(T.LongType())
    def f(lon: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series((to_nest if nested else to_ring)(lon.to_numpy(float), lat.to_numpy(float), nside))

    return f


def swap(nside: int, to_nested: bool):
    @F.pandas_udf(T.LongType())
    def f(ipix: pd.Series) -> pd.Series:
        return pd.Series((ring_to_nest if to_nested else nest_to_ring)(ipix.to_numpy(), nside))

    return f


def center_of(nside: int):
    @F.pandas_udf(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
    def f(ipix: pd.Series) -> pd.DataFrame:
        lon, lat = ring_center(ipix.to_numpy(), nside)
        return pd.DataFrame({"lon": lon, "lat": lat})

    return f


def pixel_sql(rows: str, lon: str, lat: str, nside: int) -> str:
    """A subquery: the columns of ``rows`` with the ring and nested numbers of the pixel that holds a position, and its center (c_lon, c_lat)."""
    n = nside
    bits = lambda c, shift: f"list_sum(list_transform(range(20), lambda k: ((({c}) >> k) & 1) << (2 * k + {shift})))"
    ring, phi = (f"{list(map(int, t))}[face + 1]" for t in (FACE_RING, FACE_PHI))
    return f"""(
  select * exclude (z, tt, up, down, quarter, s, face, x, y, jr, nr, shift, raw, jp),
    (case when jr < {n} then 2 * nr * (nr - 1) when jr > {3 * n} then {12 * n * n} - 2 * (nr + 1) * nr else {2 * n * (n - 1)} + (jr - {n}) * {4 * n} end + jp - 1)::bigint as ring,
    (face * {n * n} + {bits('x', 0)} + {bits('y', 1)})::bigint as nest, 90.0::double * (jp - (shift + 1) / 2.0::double) / nr as c_lon,
    degrees(asin(case when jr < {n} then 1 - nr * nr / {3.0 * n * n}::double when jr > {3 * n} then nr * nr / {3.0 * n * n}::double - 1 else ({2 * n} - jr) * 2 / {3.0 * n}::double end)) as c_lat
  from (select *, case when raw > 4 * nr then raw - 4 * nr when raw < 1 then raw + 4 * nr else raw end as jp
  from (select *, ({phi} * nr + x - y + 1 + shift) // 2 as raw
  from (select *, case when jr < {n} or jr > {3 * n} then 0 else (jr - {n}) & 1 end as shift
  from (select *, case when jr < {n} then jr when jr > {3 * n} then {4 * n} - jr else {n} end as nr
  from (select *, {ring} * {n} - x - y - 1 as jr
  from (select *,
    case when abs(z) <= 2 / 3.0::double then case when up // {n} = down // {n} then (up // {n}) % 4 + 4 when up // {n} < down // {n} then (up // {n}) % 4 else (down // {n}) % 4 + 8 end when z >= 0 then quarter else quarter + 8 end as face,
    case when abs(z) <= 2 / 3.0::double then down % {n} when z >= 0 then {n} - least(floor((1 - tt + quarter) * s)::bigint, {n - 1}) - 1 else least(floor((tt - quarter) * s)::bigint, {n - 1}) end as x,
    case when abs(z) <= 2 / 3.0::double then {n - 1} - up % {n} when z >= 0 then {n} - least(floor((tt - quarter) * s)::bigint, {n - 1}) - 1 else least(floor((1 - tt + quarter) * s)::bigint, {n - 1}) end as y
  from (select *, floor({n} * (0.5::double + tt) - {n} * z * 0.75::double)::bigint as up, floor({n} * (0.5::double + tt) + {n} * z * 0.75::double)::bigint as down,
    least(floor(tt), 3)::bigint as quarter, {n} * sqrt(3 * greatest(1 - abs(z), 0)) as s
  from (select *, sin(radians({lat})) as z, (({lon}) - 360 * floor(({lon}) / 360)) / 90 as tt from {rows})))))))))"""
