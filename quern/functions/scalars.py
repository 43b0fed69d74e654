"""Row-level expressions: geometry, rounding, seeded order keys, rules and text checks.  All are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go towards +infinity, for negative numbers too."""
    return F.floor(x + F.lit(0.5))


def clamp_box(box: Box, width: Column, height: Column) -> Box:
    """The box clipped to [0, width] x [0, height]."""
    clip = lambda v, most: F.least(F.greatest(v, F.lit(0)), most)
    return clip(box[0], width), clip(box[1], height), clip(box[2], width), clip(box[3], height)


def snap(v: Column, most: Column, tol: float = 1.0) -> Column:
    """Values at most ``tol`` outside [0, most] move to the border; others stay."""
    return F.when((v < 0) & (v >= -tol), F.lit(0.0)).when((v > most) & (v <= most + tol), most).otherwise(v)


def degenerate(box: Box) -> Column:
    return (box[0] >= box[2]) | (box[1] >= box[3])


def xywh(box: Box) -> Box:
    return box[0], box[1], box[2] - box[0], box[3] - box[1]


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def area(a: Box) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for disjoint or empty boxes."""
    i = intersection(a, b)
    union = area(a) + area(b) - i
    return F.when(union > 0, i / union).otherwise(F.lit(0.0))


def at_least_half(a: Box, b: Box) -> Column:
    """IoU >= 1/2 without division, and never without overlap: exact on integers."""
    i = intersection(a, b)
    return (i > 0) & (F.lit(2) * i >= area(a) + area(b) - i)


#: Decimals in which products of coordinates on a grid of 1e-6 (below a million) are exact.
EXACT = "decimal(18,6)"


def half_overlap(a: Box, b: Box, near: float = 1e-9) -> tuple[Column, Column]:
    """(IoU >= 1/2, whether it was judged anew) for boxes of doubles: close to the boundary in decimals, where 2 * i = union is exact."""
    i = intersection(a, b)
    union = area(a) + area(b) - i
    slack = 2 * i - union
    close = (i > 0) & (union > 0) & (F.abs(slack) <= near * F.greatest(F.lit(1.0), union))
    ad, bd = (tuple(v.cast(EXACT) for v in box) for box in (a, b))
    return (i > 0) & F.when(close, at_least_half(ad, bd)).otherwise(slack > 0), close


def band(total: Column, n: Column) -> Column:
    """Band of the mean total / n, on integers: 0, below 1.5, below 3.5, more."""
    return F.when(total == 0, "0").when(2 * total < 3 * n, "1").when(2 * total < 7 * n, "2-3").otherwise("4+")


def allocate(groups: Column, size: Column | int, population: Column) -> Column:
    """Groups to draw from a stratum: proportional, rounded half up, at least 2, at most all."""
    size = F.lit(size) if isinstance(size, int) else size
    share = F.floor((2 * size * groups + population) / (2 * population))
    return F.when(size >= population, groups).otherwise(F.least(groups, F.greatest(F.lit(2), share))).cast("long")


def order_key(seed: str, value: Column) -> Column:
    """A seeded order that any engine with SHA-256 reproduces."""
    return F.sha2(F.concat(F.lit(seed + "|"), value.cast("string")), 256)


def pick_index(value: Column, seed: int, n: int | Column) -> Column:
    """First 8 bytes of SHA-256 of value|seed as an unsigned number, modulo n."""
    hexes = F.substr(F.sha2(F.concat_ws("|", value.cast("string"), F.lit(str(seed))), 256), F.lit(1), F.lit(16))
    return (F.conv(hexes, 16, 10).cast("decimal(20,0)") % n).cast("long")


def origins(width: Column, tile: int, stride: int) -> Column:
    """Origins of tiles by stride; the last one sits at the border."""
    last = F.greatest(width - tile, F.lit(0))
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def id_number(value: Column) -> Column:
    """The number after the last colon."""
    return F.element_at(F.split(value, ":"), -1).cast("long")


def within(x: Column, lo: Column, hi: Column) -> Column:
    """lo <= x < hi; a null bound is open, a null x matches only two null bounds."""
    both = lo.isNull() & hi.isNull()
    return F.coalesce(both | ((lo.isNull() | (x >= lo)) & (hi.isNull() | (x < hi))), F.lit(False))


def matches_or_all(accepted: Column, value: Column, every: str = "ALL") -> Column:
    """An empty array matches any value; else it has the value or ``every``."""
    return (F.size(accepted) == 0) | F.array_contains(accepted, value) | F.array_contains(accepted, every)


def effective_limit(rule: Column, value: Column, factor: Column, cap: Column, basis: Column) -> Column:
    """The limit of a rule on the 0.01 grid; null for a rule that permits nothing."""
    prop = factor * basis
    raw = F.when(rule == "const", value).when(rule == "prop_t", prop).when(rule == "prop_t_cap", F.least(prop, cap))
    return F.round(raw.cast("decimal(30,8)"), 2).cast("decimal(18,2)")


def verdict(measured: Column, limit: Column, op: Column, rule: Column) -> Column:
    ok = F.when(op == "lt", measured < limit).otherwise(measured <= limit)
    return F.when(rule == "none_permitted", "FAIL").when(ok, "PASS").otherwise("FAIL")


def collapsed(text: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def numbers(text: Column) -> Column:
    """The distinct decimal numbers of a text, thousands separators removed, in order of value."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("decimal(38,4)"))))


def sentences(text: Column, shortest: int = 8) -> Column:
    """Split after . ! or ? and white space; what follows a piece of fewer than ``shortest`` characters is joined to it."""
    pieces = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")
    glue = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) < shortest),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), s))),
    ).otherwise(F.concat(acc, F.array(s)))
    return F.when(F.size(pieces) == 0, F.array().cast("array<string>")).otherwise(F.aggregate(pieces, F.array().cast("array<string>"), glue))


def fixed(v: Column, places: int) -> Column:
    """A number as text with ``places`` digits; a number exactly between two (an odd multiple of 2 ** -(places + 1)) goes to the even one."""
    v = v.cast("double")
    halves = v * F.lit(float(1 << (places + 1)))
    tie = (F.abs(halves) < 2.0**52) & (halves == F.floor(halves)) & (F.pmod(halves, F.lit(2.0)) == 1)
    return F.when(tie, F.bround(v.cast(f"decimal(38,{places + 1})"), places).cast(f"decimal(38,{places})").cast("string")).otherwise(F.format_string(f"%.{places}f", v))


def flag(c: Column) -> Column:
    """A flag whose null is false."""
    return F.coalesce(c, F.lit(False))


def fires(parse_ok: Column, codes: Column) -> Column:
    """Whether a record was read and names any code."""
    return flag(parse_ok) & (F.size(codes) > 0)


def fraction(f: float) -> float:
    """A share of 0 < f <= 1; anything else is an error."""
    if isinstance(f, bool) or not isinstance(f, (int, float)) or not 0 < f <= 1:
        raise ValueError(f"no share: {f!r}")
    return float(f)
