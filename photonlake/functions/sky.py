"""Sky geometry as Columns: separations, rotations, projections and region predicates. Angles are in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def separation(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance, in the form that is exact for small and for antipodal distances."""
    a1, d1, a2, d2 = (F.radians(_c(x)) for x in (lon1, lat1, lon2, lat2))
    d = a2 - a1
    x = F.cos(d2) * F.sin(d)
    y = F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(d)
    z = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(d)
    return F.degrees(F.atan2(F.sqrt(x * x + y * y), z))


#: The rotation from equatorial (ICRS) to Galactic axes.
GALACTIC = (
    (-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
    (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
    (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669),
)


def rotate(lon, lat, matrix) -> tuple[Column, Column]:
    """(lon, lat) after a rotation of the axes; longitudes from 0 to 360."""
    a, d = F.radians(_c(lon)), F.radians(_c(lat))
    v = (F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d))
    x, y, z = (sum((v[j] * float(row[j]) for j in range(1, 3)), v[0] * float(row[0])) for row in matrix)
    turned = F.degrees(F.atan2(y, x))
    return F.when(turned < 0, turned + 360.0).otherwise(turned), F.degrees(F.asin(F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0))))


def to_galactic(ra, dec) -> tuple[Column, Column]:
    return rotate(ra, dec, GALACTIC)


def from_galactic(lon, lat) -> tuple[Column, Column]:
    return rotate(lon, lat, tuple(zip(*GALACTIC, strict=True)))


def to_fov(lon, lat, lon0, lat0) -> tuple[Column, Column]:
    """Offsets in the field of view of a pointing; the longitude grows against the sky's."""
    a, d, a0, d0 = (F.radians(_c(x)) for x in (lon, lat, lon0, lat0))
    x = F.cos(d) * F.cos(a - a0) * F.cos(d0) + F.sin(d) * F.sin(d0)
    y = F.cos(d) * F.sin(a - a0)
    z = F.sin(d) * F.cos(d0) - F.cos(d) * F.cos(a - a0) * F.sin(d0)
    return -F.degrees(F.atan2(y, x)), F.degrees(F.asin(F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0))))


def from_fov(fov_lon, fov_lat, lon0, lat0) -> tuple[Column, Column]:
    """Inverse of ``to_fov``; longitudes from -180 to 180."""
    b, e, a0, d0 = F.radians(-_c(fov_lon)), F.radians(_c(fov_lat)), F.radians(_c(lon0)), F.radians(_c(lat0))
    x, y, z = F.cos(e) * F.cos(b), F.cos(e) * F.sin(b), F.sin(e)
    u, w = x * F.cos(d0) - z * F.sin(d0), x * F.sin(d0) + z * F.cos(d0)
    lon = F.degrees(F.atan2(y, u) + a0)
    wrapped = F.when(lon > 180.0, lon - 360.0).when(lon <= -180.0, lon + 360.0).otherwise(lon)
    return wrapped, F.degrees(F.asin(F.greatest(F.least(w, F.lit(1.0)), F.lit(-1.0))))


def position_angle(lon1, lat1, lon2, lat2) -> Column:
    """Direction of the second point seen from the first, east of north, 0 to 360."""
    a1, d1, a2, d2 = (F.radians(_c(x)) for x in (lon1, lat1, lon2, lat2))
    angle = F.degrees(F.atan2(F.sin(a2 - a1) * F.cos(d2), F.sin(d2) * F.cos(d1) - F.cos(d2) * F.sin(d1) * F.cos(a2 - a1)))
    return F.when(angle < 0, angle + 360.0).otherwise(angle)


def offset_by(lon, lat, angle, distance) -> tuple[Column, Column]:
    """The point at a direction and distance from another."""
    a, d, p, r = (F.radians(_c(x)) for x in (lon, lat, angle, distance))
    z = F.sin(d) * F.cos(r) + F.cos(d) * F.sin(r) * F.cos(p)
    turn = F.atan2(F.sin(p) * F.sin(r) * F.cos(d), F.cos(r) - F.sin(d) * z)
    return F.degrees(a + turn), F.degrees(F.asin(F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0))))


def rotate_about(lon, lat, lon0, lat0, angle) -> tuple[Column, Column]:
    """A point turned about a center: a mirrored region is turned by 180 degrees."""
    return offset_by(lon0, lat0, position_angle(lon0, lat0, lon, lat) + _c(angle), separation(lon0, lat0, lon, lat))


def car_pixel(lon, lat, lon0, lat0, size) -> tuple[Column, Column]:
    """Plate-carree pixel coordinates; integers are pixel centers, longitudes grow to the left."""
    return -(_c(lon) - _c(lon0)) / _c(size), (_c(lat) - _c(lat0)) / _c(size)


def car_world(px, py, lon0, lat0, size) -> tuple[Column, Column]:
    return _c(lon0) - _c(px) * _c(size), _c(lat0) + _c(py) * _c(size)


def tan_pixel(lon, lat, lon0, lat0, size) -> tuple[Column, Column]:
    """Tangent-plane pixel coordinates; null on the far side of the sky."""
    a, d, a0, d0 = (F.radians(_c(x)) for x in (lon, lat, lon0, lat0))
    w = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(a - a0)
    x = F.degrees(F.cos(d) * F.sin(a - a0) / w)
    y = F.degrees((F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(a - a0)) / w)
    return F.when(w > 0, -x / _c(size)), F.when(w > 0, y / _c(size))


def tan_world(px, py, lon0, lat0, size) -> tuple[Column, Column]:
    x, y = F.radians(-_c(px) * _c(size)), F.radians(_c(py) * _c(size))
    a0, d0 = F.radians(_c(lon0)), F.radians(_c(lat0))
    lon = a0 + F.atan2(x, F.cos(d0) - y * F.sin(d0))
    lat = F.atan2((F.sin(d0) + y * F.cos(d0)) * F.cos(lon - a0), F.cos(d0) - y * F.sin(d0))
    return F.degrees(lon), F.degrees(lat)


def car_solid_angle(py, lat0, size) -> Column:
    """Steradians of a plate-carree pixel: strip between its two latitudes times its width."""
    low, high = (F.radians(_c(lat0) + (_c(py) + s) * _c(size)) for s in (-0.5, 0.5))
    return (F.sin(high) - F.sin(low)) * F.radians(_c(size))


def in_circle(x, y, x0, y0, radius) -> Column:
    """Planar distance below the radius."""
    dx, dy = _c(x) - _c(x0), _c(y) - _c(y0)
    return F.sqrt(dx * dx + dy * dy) < _c(radius)


def in_annulus(x, y, x0, y0, inner, outer) -> Column:
    return in_circle(x, y, x0, y0, outer) & ~in_circle(x, y, x0, y0, inner)


def _turned(x, y, x0, y0, angle) -> tuple[Column, Column]:
    dx, dy, t = _c(x) - _c(x0), _c(y) - _c(y0), F.radians(_c(angle))
    return dx * F.cos(t) + dy * F.sin(t), dy * F.cos(t) - dx * F.sin(t)


def in_rectangle(x, y, x0, y0, width, height, angle=0.0) -> Column:
    u, v = _turned(x, y, x0, y0, angle)
    return (F.abs(u) < _c(width) / 2) & (F.abs(v) < _c(height) / 2)


def in_ellipse(x, y, x0, y0, width, height, angle=0.0) -> Column:
    u, v = _turned(x, y, x0, y0, angle)
    return (2 * u / _c(width)) * (2 * u / _c(width)) + (2 * v / _c(height)) * (2 * v / _c(height)) < 1


def in_polygon(x, y, corners: list[tuple[float, float]]) -> Column:
    """Odd number of edges crossed by a ray to the right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        spans = (F.lit(y1) > _c(y)) != (F.lit(y2) > _c(y))
        at = (x2 - x1) * (_c(y) - y1) / ((y2 - y1) or 1.0) + x1
        crossings = crossings + (spans & (_c(x) < at)).cast("int")
    return crossings % 2 == 1


def phase(time_s, reference_s, phi, f0, f1=0.0, f2=0.0) -> Column:
    """Fractional phase of a rotation with spin-down."""
    dt = _c(time_s) - _c(reference_s)
    full = _c(phi) + dt * (_c(f0) + dt / 2 * (_c(f1) + dt / 3 * _c(f2)))
    return full - F.floor(full)
