"""Geometry of boxes and polygons as SQL expressions.

Boxes are columns x0, y0, x1, y1 under a prefix ("s." or "t_"); polygons are arrays of structs (x, y).
All functions return SQL text, so that they compose inside one projection.
"""


def _f(p: str) -> tuple[str, str, str, str]:
    return f"{p}x0", f"{p}y0", f"{p}x1", f"{p}y1"


def area(p: str) -> str:
    x0, y0, x1, y1 = _f(p)
    return f"(greatest(0.0, {x1} - {x0}) * greatest(0.0, {y1} - {y0}))"


def intersection(a: str, b: str) -> str:
    ax0, ay0, ax1, ay1 = _f(a)
    bx0, by0, bx1, by1 = _f(b)
    return f"(greatest(0.0, least({ax1}, {bx1}) - greatest({ax0}, {bx0})) * greatest(0.0, least({ay1}, {by1}) - greatest({ay0}, {by0})))"


def iou(a: str, b: str) -> str:
    """Intersection over union; 0 where the union is empty."""
    union = f"({area(a)} + {area(b)} - {intersection(a, b)})"
    return f"(CASE WHEN {union} > 0 THEN {intersection(a, b)} / {union} ELSE 0.0 END)"


def over_smaller(a: str, b: str) -> str:
    """Intersection over the smaller area; 0 where that is empty."""
    smaller = f"least({area(a)}, {area(b)})"
    return f"(CASE WHEN {smaller} > 0 THEN {intersection(a, b)} / {smaller} ELSE 0.0 END)"


def over_first(a: str, b: str) -> str:
    """Intersection over the area of the first box."""
    return f"(CASE WHEN {area(a)} > 0 THEN {intersection(a, b)} / {area(a)} ELSE 0.0 END)"


def over_smaller_floored(a: str, b: str) -> str:
    """Intersection over the smaller area, on whole pixels, areas being at least 1."""
    return f"({intersection(a, b)} / greatest(1.0, least(greatest(1.0, {area(a)}), greatest(1.0, {area(b)}))))"


def gap(a: str, b: str) -> str:
    """The distance between two boxes, 0 where they touch."""
    ax0, ay0, ax1, ay1 = _f(a)
    bx0, by0, bx1, by1 = _f(b)
    dx, dy = f"greatest(0.0, greatest({ax0}, {bx0}) - least({ax1}, {bx1}))", f"greatest(0.0, greatest({ay0}, {by0}) - least({ay1}, {by1}))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def centre(p: str) -> tuple[str, str]:
    x0, y0, x1, y1 = _f(p)
    return f"(({x0} + {x1}) / 2)", f"(({y0} + {y1}) / 2)"


def centre_distance(a: str, b: str, diagonal: str) -> str:
    """The distance of centres in diagonals of the page."""
    (ax, ay), (bx, by) = centre(a), centre(b)
    return f"(sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by})) / greatest(1.0, {diagonal}))"


def holds(box: str, x: str, y: str) -> str:
    """Whether a point is in a box, its edges included."""
    x0, y0, x1, y1 = _f(box)
    return f"({x0} <= {x} AND {x} <= {x1} AND {y0} <= {y} AND {y} <= {y1})"


def clip(x: str, low: str, high: str) -> str:
    """x between low and high; NaN becomes low."""
    return f"(CASE WHEN isnan({x}) THEN {low} ELSE greatest({low}, least({high}, {x})) END)"


# Polygons, in Spark SQL.


def polygon_box(p: str) -> str:
    return f"named_struct('x0', array_min(transform({p}, v -> v.x)), 'y0', array_min(transform({p}, v -> v.y)), 'x1', array_max(transform({p}, v -> v.x)), 'y1', array_max(transform({p}, v -> v.y)))"


def box_polygon(p: str) -> str:
    x0, y0, x1, y1 = _f(p)
    return f"array(named_struct('x', {x0}, 'y', {y0}), named_struct('x', {x1}, 'y', {y0}), named_struct('x', {x1}, 'y', {y1}), named_struct('x', {x0}, 'y', {y1}))"


def _moments(p: str) -> str:
    """(twice the signed area, first moments) of a polygon."""
    at, to = f"{p}[i]", f"{p}[(i + 1) % size({p})]"
    cross = f"({at}.x * {to}.y - {to}.x * {at}.y)"
    return (
        f"aggregate(sequence(0, size({p}) - 1), named_struct('a', 0.0D, 'x', 0.0D, 'y', 0.0D), "
        f"(m, i) -> named_struct('a', m.a + {cross}, 'x', m.x + ({at}.x + {to}.x) * {cross}, 'y', m.y + ({at}.y + {to}.y) * {cross}))"
    )


def polygon_area(p: str) -> str:
    """The area by the shoelace formula; 0 under three points."""
    return f"(CASE WHEN size({p}) < 3 THEN 0.0D ELSE abs({_moments(p)}.a) / 2 END)"


def polygon_centroid(p: str) -> str:
    """The centroid; the mean of the points where there are fewer than three or no area."""
    mean = f"named_struct('x', aggregate({p}, 0.0D, (s, v) -> s + v.x, s -> s / size({p})), 'y', aggregate({p}, 0.0D, (s, v) -> s + v.y, s -> s / size({p})))"
    m = _moments(p)
    return f"(CASE WHEN size({p}) >= 3 AND abs({m}.a) > 1e-12 THEN transform(array({m}), m -> named_struct('x', m.x / (3 * m.a), 'y', m.y / (3 * m.a)))[0] ELSE {mean} END)"


def transformed(p: str, m: str) -> str:
    """The points of a polygon under a 2x3 or 3x3 matrix (array of rows); points at infinity are divided by 1e-12."""
    w = f"(CASE WHEN size({m}) < 3 THEN 1.0D ELSE {m}[2][0] * v.x + {m}[2][1] * v.y + {m}[2][2] END)"
    safe = f"(CASE WHEN abs({w}) < 1e-12 THEN 1e-12D ELSE {w} END)"
    return f"transform({p}, v -> named_struct('x', ({m}[0][0] * v.x + {m}[0][1] * v.y + {m}[0][2]) / {safe}, 'y', ({m}[1][0] * v.x + {m}[1][1] * v.y + {m}[1][2]) / {safe}))"


def promoted(m: str) -> str:
    """A 2x3 matrix as a 3x3 one."""
    return f"(CASE WHEN size({m}) = 2 THEN concat({m}, array(array(0.0D, 0.0D, 1.0D))) ELSE {m} END)"


def clipped(p: str, width: str, height: str) -> str:
    return f"transform({p}, v -> named_struct('x', greatest(0.0D, least({width} - 1, v.x)), 'y', greatest(0.0D, least({height} - 1, v.y))))"
