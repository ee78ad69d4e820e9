"""Scalar functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score parameters and the three-letter residue codes.
RAMP, SOFT, POINT = 30.0, 0.01, 10.0
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
HELIX, STRAND = ("G", "H", "I", "h"), ("E", "B", "e")


def integer_suffix(s: Column) -> Column:
    return F.coalesce(F.regexp_extract(s, r"(\d+)$", 1).try_cast("long"), F.lit(0))


def int_or_all(s: Column) -> Column:
    """A number, or null for "all"."""
    return F.when(F.lower(F.trim(s)) == "all", F.lit(None).cast("int")).otherwise(F.trim(s).cast("int"))


def collapse_type(t: Column) -> Column:
    return F.when(t.isin(*HELIX), "H").when(t.isin(*STRAND), "E").otherwise(F.raise_error(F.concat(F.lit("unknown element type: "), F.coalesce(t, F.lit("null")))).cast("string"))


def hash_color(i: Column) -> Column:
    alpha = 0.25 + math.log(2) / 16
    return F.concat(F.lit("s"), F.lpad((F.floor(i * alpha * 1000) % 1000).cast("string"), 3, "0"))


def spectrum_hex(x: Column) -> Column:
    """A place on the spectrum 0..1 as RGB in hex: six sectors from red through green and blue back to red."""
    h = F.pmod(x * 6, F.lit(6.0))
    part = h - F.floor(h)
    up, down = F.floor(255 * part).cast("int"), F.floor(255 * (1 - part)).cast("int")
    full, none = F.lit(255), F.lit(0)
    sector = F.floor(h).cast("int")
    pick = lambda cells: F.element_at(F.array(*cells), sector + 1)
    red, green, blue = pick([full, down, none, none, up, full]), pick([up, full, full, down, none, none]), pick([none, none, up, full, full, down])
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in (red, green, blue)]))


def heat(v: Column) -> Column:
    """Share of the warm colour for a deviation: exp(-v / 50)."""
    return F.exp(-v / 50)


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0])))


def rounded(v: Column, digits: int) -> Column:
    """Halves of the binary value go away from zero, and what rounds to zero keeps its sign, as in C; F.round goes by the
    decimal text and loses the sign."""
    t = F.abs(v) * 10.0**digits
    near = F.when(t < 2.0**52, F.floor(t) + F.when(t - F.floor(t) >= 0.5, 1.0).otherwise(0.0)).otherwise(t)
    return F.when(t < float("inf"), F.signum(v) * near / 10.0**digits).otherwise(v)


def array_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def element_distance(start_a: list[Column], end_a: list[Column], start_b: list[Column], end_b: list[Column]) -> Column:
    return distance(start_a, start_b) + distance(end_a, end_b)


def linear_score(d: Column, same_type: Column) -> Column:
    return F.when(same_type, F.greatest(F.lit(0.0), RAMP - d)).otherwise(0.0)


def smoothed_ramp(d: Column) -> Column:
    a, b, c = RAMP * (1 - SOFT), d + RAMP * (2 * SOFT - 1), -RAMP * SOFT
    return (-b + F.sqrt(b * b - 4 * a * c)) / (2 * a)


def exp_score(d: Column) -> Column:
    return F.exp(-d / RAMP)


def point_distance(r: Column, wa: Column, wb: Column) -> Column:
    return (1 - F.exp(-r / POINT)) * F.least(wa, wb) + 0.5 * F.abs(wa - wb)


def point_score(r: Column, wa: Column, wb: Column) -> Column:
    return 0.5 * wa + 0.5 * wb - point_distance(r, wa, wb)


def one_letter(three: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.upper(three)), F.lit("X"))


def transform_point(rotation: list[list[float]], shift: list[float], point: list[Column]) -> list[Column]:
    return [sum((point[j] * rotation[i][j] for j in (1, 2)), point[0] * rotation[i][0]) + shift[i] for i in range(3)]


def hierarchy_prefixes(code: Column) -> Column:
    """All prefixes of a dotted code; those of fewer than four parts end in a dot."""
    parts = F.split(code, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "."), F.when(n < 4, ".").otherwise("")))


def refresh_after(elapsed: Column, ladder: tuple[int, ...] = (5, 10, 30, 60, 300, 600, 3600)) -> Column:
    """Seconds to wait: the first step of the ladder beyond the elapsed time, else the last."""
    steps = F.array(*[F.lit(x) for x in ladder])
    return F.coalesce(F.array_min(F.filter(steps, lambda x: x > elapsed)), F.lit(ladder[-1]))


def bounded_int(s: Column, low: int, high: int, default: int) -> Column:
    value = s.try_cast("int")
    return F.when(value.between(low, high), value).otherwise(default)


def z_to_log_p(z: Column) -> Column:
    """Natural log of the tail of an extreme-value distribution at z."""
    x = F.exp(-math.pi / math.sqrt(6) * z - 0.5772156649015329)
    return F.when(x < 1e-6, F.log(x)).otherwise(F.log(-F.expm1(-x)))


def cdf_polygon(steps: Column, height: float = 1.0) -> Column:
    """Outline of a distribution drawn to both sides of its axis, from array<struct<value, p>> in order: the share above
    each value there and back."""
    above = F.transform(steps, lambda s: F.array(s["value"].cast("double"), (1 - s["p"]) * height / 2))
    below = F.transform(F.reverse(steps), lambda s: F.array(s["value"].cast("double"), -(1 - s["p"]) * height / 2))
    return F.concat(F.array(F.array(F.lit(0.0), F.lit(height / 2))), above, below, F.array(F.array(F.lit(0.0), F.lit(-height / 2))))


#: Colours of a deviation, hottest first, over the shares 0, 1/2 and 1.
HEAT = ((255, 0, 0), (255, 200, 255), (0, 0, 255))


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """The value at x of a line through points (place, value) in order, level beyond its ends."""
    out = F.when(x < points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, ((x - x0) * y1 + (x1 - x) * y0) / (x1 - x0))
    return out.otherwise(F.lit(float(points[-1][1])))


def heat_color(v: Column, norm: float = 50.0) -> Column:
    """The colour of a deviation as RGB in hex, by its share of the warm colour."""
    x = F.exp(-v / norm)
    parts = [interpolate(x, [(i / 2, HEAT[i][c]) for i in range(3)]) for c in range(3)]
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(F.floor(p).cast("int")), 2, "0") for p in parts]))


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def element_length(start: Column, end: Column) -> Column:
    """Residues of an element, both ends included."""
    return end - start + 1


def square_score(squared: Column, match: float = 10.0) -> Column:
    """Score of a squared distance: 1 for none, negative beyond the match value."""
    return (match - squared) / match


def shape_score(a: Column, b: Column, points: int = 5, match: float = 2.0) -> Column:
    """Score of two shapes, arrays of coordinates of some points: by their deviation, 0 from the match value on."""
    return F.greatest(F.lit(0.0), (match - array_distance(a, b) / math.sqrt(points)) / match)


def split_transform(m: Column) -> tuple[Column, Column]:
    """(rotation, shift) of a flat 4 x 4 transform that shifts before (last row) and behind (last column) its rotation."""
    rotation = F.array(*[F.array(*[m[4 * i + j] for j in range(3)]) for i in range(3)])
    shift = F.array(*[sum((m[4 * i + j] * m[12 + j] for j in (1, 2)), m[4 * i] * m[12]) + m[4 * i + 3] for i in range(3)])
    return rotation, shift


def join_transform(rotation: Column, shift: Column) -> Column:
    """The flat 4 x 4 transform of a rotation and the shift behind it."""
    return F.array(*[x for i in range(3) for x in (*[rotation[i][j] for j in range(3)], shift[i])], *[F.lit(0.0)] * 3, F.lit(1.0))


def insert_after(entries: Column, after: Column, new: Column) -> Column:
    """An ordered map, as an array of entries (key, value), with an entry behind the key named; at the end without it."""
    at = F.array_position(F.transform(entries, lambda e: e["key"]), after).cast("int")
    cut = F.when(at > 0, at).otherwise(F.size(entries))
    return F.concat(F.slice(entries, F.lit(1), cut), F.array(new), F.slice(entries, cut + 1, F.size(entries)))


def length_extent(steps: Column) -> tuple[Column, Column]:
    """Least and largest positive value of a distribution's steps array<struct<value, p>>, 0 without any."""
    positive = F.filter(F.transform(steps, lambda x: x["value"]), lambda v: v > 0)
    return F.coalesce(F.array_min(positive), F.lit(0)), F.coalesce(F.array_max(positive), F.lit(0))


def bounded_float(s: Column, low: float, high: float, default: float, percent: bool = False) -> Column:
    """A number within bounds, else the default; with percent, "5%" is 0.05."""
    value = F.regexp_replace(F.trim(s), r"\s*%$", "").try_cast("double")
    if percent:
        value = value * F.when(s.contains("%"), 0.01).otherwise(1.0)
    return F.coalesce(F.when(value.between(low, high), value), F.lit(default))


def shown(value: Column) -> Column:
    """A number of ordinary size with six decimals at most and no zeros behind."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), r"(\.\d*?)0+$", "$1"), r"\.$", "")
