"""Column functions that all operators share. Everything stays on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_order(seed: str | int, *parts: ColumnLike) -> Column:
    """A 32-bit whole number from the md5 of seed and parts. All sampled choices order by it, so they replay anywhere."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def r6(c: ColumnLike) -> Column:
    """Rounded to six places, with negative zero made plain: the last bits of a sum depend on its order."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def safe_div(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(col(a), col(b))


# --- vectors as array<double> -----------------------------------------------


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: ColumnLike) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: ColumnLike, b: ColumnLike, null_if_flat: bool = False) -> Column:
    """Cosine; 0 (or null) where either norm is at most 1e-9."""
    flat = (norm(a) <= 1e-9) | (norm(b) <= 1e-9)
    return F.when(flat, F.lit(None).cast("double") if null_if_flat else F.lit(0.0)).otherwise(safe_div(dot(a, b), norm(a) * norm(b)))


def distance(a: ColumnLike, b: ColumnLike) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def minus(a: ColumnLike, b: ColumnLike) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def plus(a: ColumnLike, b: ColumnLike) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def scaled(a: ColumnLike, by: ColumnLike | float) -> Column:
    factor = F.lit(by) if isinstance(by, (int, float)) else col(by)
    return F.transform(col(a), lambda x: x * factor)


def reject(x: ColumnLike, g: ColumnLike) -> Column:
    """x without its part along g; x itself where g is flat."""
    share = F.coalesce(safe_div(dot(x, g), dot(g, g)), F.lit(0.0))
    return F.zip_with(col(x), col(g), lambda a, b: a - share * b)


def mean_of(a: ColumnLike) -> Column:
    return safe_div(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x), F.size(col(a)))


def pearson(a: ColumnLike, b: ColumnLike) -> Column:
    """Correlation of two arrays; null where either is constant."""
    ma, mb = mean_of(a), mean_of(b)
    ca, cb = F.transform(col(a), lambda x: x - ma), F.transform(col(b), lambda x: x - mb)
    return F.when((norm(ca) > 1e-9) & (norm(cb) > 1e-9), safe_div(dot(ca, cb), norm(ca) * norm(cb)))


def average_ranks(a: ColumnLike) -> Column:
    """Ranks from 1 with ties averaged, by one sort of the values."""
    s = F.array_sort(col(a))
    return F.transform(col(a), lambda x: (F.array_position(s, x) + (F.array_position(s, x) + F.size(F.filter(s, lambda y: y == x)) - 1)) / F.lit(2.0))


# --- guarded aggregates -----------------------------------------------------


def corr_agg(x: ColumnLike, y: ColumnLike) -> Column:
    """Pearson correlation as an aggregate by moments; null for constant input or fewer than two pairs."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    n = F.count(a)
    va, vb = F.sum(a * a) - safe_div(F.sum(a) * F.sum(a), n), F.sum(b * b) - safe_div(F.sum(b) * F.sum(b), n)
    return F.when((va > 1e-12) & (vb > 1e-12), safe_div(F.sum(a * b) - safe_div(F.sum(a) * F.sum(b), n), F.sqrt(va) * F.sqrt(vb)))


def jaccard(a: ColumnLike, b: ColumnLike) -> Column:
    """Jaccard of two arrays taken as sets; null if both are empty."""
    return safe_div(F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b))))


def energy_shares(residual: ColumnLike, generic: ColumnLike) -> Column:
    """Shares of residual, generic and cross energy in the shift residual + generic; null where the shift is flat."""
    whole = F.nullif(dot(plus(residual, generic), plus(residual, generic)), F.lit(0.0))
    return F.struct(
        safe_div(dot(residual, residual), whole).alias("residual"), safe_div(dot(generic, generic), whole).alias("generic"), safe_div(2 * dot(residual, generic), whole).alias("cross")
    )


def spearman_brown(r: ColumnLike) -> Column:
    """Full-length reliability of a half-length one; null outside (0, 1)."""
    x = col(r)
    return F.when((x > 0) & (x < 1), 2 * x / (1 + x))


def disattenuate(observed: ColumnLike, rel_a: ColumnLike, rel_b: ColumnLike) -> Column:
    """Observed correlation over the root of both reliabilities; null if that isn't possible or exceeds 1 in size."""
    v = safe_div(col(observed), F.sqrt(F.when((col(rel_a) > 0) & (col(rel_b) > 0), col(rel_a) * col(rel_b))))
    return F.when(F.abs(v) <= 1, v)


def tost(lo: ColumnLike, hi: ColumnLike, margin: float) -> Column:
    """Equivalence read from an interval."""
    inside, zero_out = (col(lo) > -margin) & (col(hi) < margin), ~((col(lo) <= 0) & (col(hi) >= 0))
    return F.when(inside & zero_out, "equivalent and excludes zero").when(inside, "equivalent").when(zero_out, "excludes zero").otherwise("inconclusive")


def dose_key(molar: ColumnLike, digits: int = 6) -> Column:
    """A positive dose on so many significant digits, so that unit conversions compare equal; 0 stays 0."""
    x = col(molar)
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.when(x != 0, x)))) - (digits - 1))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / power) * power)


def same_dose(a: ColumnLike, b: ColumnLike, tolerance: float = 1e-6) -> Column:
    """Whether two known doses agree within a relative tolerance; an unknown dose equals nothing."""
    return F.coalesce(F.abs(col(a) - col(b)) <= tolerance * F.greatest(F.abs(col(a)), F.abs(col(b))), F.lit(False))
