"""Column functions over points, vectors and courts. None runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyframe.config import CourtConfig


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def fixed(v: Column, places: int) -> Column:
    """Rounded by scaling, for values that are often exactly between two results: means of rounded values, and values that
    are rounded again. Every engine gives the same here."""
    return F.round(v * float(10**places)) / float(10**places)


def velocity(delta: Column, dt: Column, least: float) -> Column:
    """Change by second; 0 where the time step is too small."""
    return F.when(dt < least, F.lit(0.0)).otherwise(delta / F.when(dt < least, F.lit(1.0)).otherwise(dt))


def magnitude(vx: Column, vy: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy)


def direction_change(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two vectors (3 places); 0 if either has no length."""
    size = magnitude(ax, ay) * magnitude(bx, by)
    cosine = F.try_divide(ax * bx + ay * by, size)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))), 3))


def heading(dx: Column, dy: Column) -> Column:
    return F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(F.degrees(F.atan2(dy, dx)))


def wrapped_difference(a: Column, b: Column) -> Column:
    """Degrees between two headings of -180 to 180: 0 to 180."""
    d = F.abs(b - a)
    return F.least(d, 360.0 - d)


def kmh(meters: Column, seconds: Column, least_seconds: float, least_meters: float, most_kmh: float) -> Column:
    """Speed (3 places); 0 where the step is too short, too small or too fast to be real."""
    raw = meters / F.when(seconds < least_seconds, F.lit(1.0)).otherwise(seconds) * 3.6
    return F.when((seconds < least_seconds) | (meters < least_meters) | (raw > most_kmh), F.lit(0.0)).otherwise(F.round(raw, 3))


Matrix = tuple[tuple[float, float, float], tuple[float, float, float], tuple[float, float, float]]


def project(h: Matrix | Column, x: Column, y: Column, places: int | None = 4) -> tuple[Column, Column]:
    """A point through a homography: a literal matrix, or a column of rows. Null where the point is at infinity."""
    g = (lambda i, j: h[i][j]) if isinstance(h, Column) else (lambda i, j: F.lit(float(h[i][j])))
    w = g(2, 0) * x + g(2, 1) * y + g(2, 2)
    px, py = (F.try_divide(g(i, 0) * x + g(i, 1) * y + g(i, 2), w) for i in (0, 1))
    return (fixed(px, places), fixed(py, places)) if places is not None else (px, py)


def inverse(h: Matrix) -> Matrix:
    (a, b, c), (d, e, f), (g, i, k) = h
    det = a * (e * k - f * i) - b * (d * k - f * g) + c * (d * i - e * g)
    if det == 0:
        raise ValueError("the matrix has no inverse")
    adj = ((e * k - f * i, c * i - b * k, b * f - c * e), (f * g - d * k, a * k - c * g, c * d - a * f), (d * i - e * g, b * g - a * i, a * e - b * d))
    return tuple(tuple(v / det for v in row) for row in adj)


def inside(x: Column, y: Column, court: CourtConfig) -> Column:
    return x.between(0.0, court.width) & y.between(0.0, court.length)


def zone(x: Column, y: Column, court: CourtConfig) -> Column:
    """`out`, or the third of the court's length and the half of its width."""
    third = F.when(y < court.length / 3, "far_backcourt").when(y < 2 * court.length / 3, "midcourt").otherwise("near_backcourt")
    side = F.when(x < court.width / 2, "left").otherwise("right")
    return F.when(~inside(x, y, court), "out").otherwise(F.concat_ws("_", third, side))


def court_side(y: Column, court: CourtConfig) -> Column:
    return F.when(y < court.net_to_baseline, "near").otherwise("far")


def boundary_distances(x: Column, y: Column, court: CourtConfig) -> dict[str, Column]:
    """Signed distances to the four lines, positive inside (4 places)."""
    return {"left": F.round(x, 4), "right": F.round(court.width - x, 4), "far": F.round(y, 4), "near": F.round(court.length - y, 4)}


def nearest_boundary(distances: dict[str, Column]) -> Column:
    """name and distance of the nearest line; ties in the order given."""
    each = [F.struct(F.abs(d).alias("size"), F.lit(i).alias("place"), F.lit(k).alias("name"), d.alias("distance")) for i, (k, d) in enumerate(distances.items())]
    return F.array_min(F.array(*each))


def line_call(x: Column, y: Column, court: CourtConfig) -> dict[str, Column]:
    """call, strictly_inside and near_line; a ball within the tolerance outside a line is in."""
    tol = court.boundary_tolerance
    within = x.between(-tol, court.width + tol) & y.between(-tol, court.length + tol)
    near = within & ((F.abs(x) <= tol) | (F.abs(x - court.width) <= tol) | (F.abs(y) <= tol) | (F.abs(y - court.length) <= tol))
    return {"call": F.when(within, "IN").otherwise("OUT"), "strictly_inside": inside(x, y, court), "near_line": near}


def keypoints(court: CourtConfig) -> list[tuple[str, float, float]]:
    """Named points of a doubles court; the origin is the far left corner, y grows to the near baseline."""
    left, right = court.alley_width, court.doubles_width - court.alley_width
    net, middle = court.length / 2, court.doubles_width / 2
    far, near = net - court.service_line_from_net, net + court.service_line_from_net
    rows = [("far_baseline", 0.0), ("far_service", far), ("net", net), ("near_service", near), ("near_baseline", court.length)]
    out = []
    for name, y in rows:
        if name.endswith("baseline") or name == "net":
            out += [(f"{name}_left_doubles", 0.0, y), (f"{name}_right_doubles", court.doubles_width, y)]
        out += [(f"{name}_left_singles", left, y), (f"{name}_right_singles", right, y)]
        if name.endswith("service"):
            out.append((f"{name}_center", middle, y))
    return out
