"""Column expressions of the domain; each takes columns and returns a column, so Catalyst sees plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-6


def canonical_subid(c: Column) -> Column:
    """B1: 'sub-' in front, underscores dropped; ids that have the prefix stay as they are."""
    return F.when(c.startswith("sub-"), c).otherwise(F.concat(F.lit("sub-"), F.replace(c, F.lit("_"), F.lit(""))))


def clean_id(c: Column) -> Column:
    """Brackets, quotes, commas and blanks dropped."""
    return F.regexp_replace(F.trim(c), r"[\[\]'\", ]", "")


def na_parse(c: Column, kind: str = "double") -> Column:
    """Number of a cell; blanks around it are allowed, anything that is not a number is NULL."""
    return F.nullif(F.trim(c), F.lit("")).try_cast(kind)


def months_to_years(c: Column) -> Column:
    """B7."""
    return c / 12


def recode(c: Column, codes: dict) -> Column:
    """Literal map of categories; others give NULL."""
    out = F.lit(None)
    for k, v in codes.items():
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def recode_strict(c: Column, codes: dict) -> Column:
    """As recode, but an unknown value is an error."""
    known = recode(c, codes)
    return F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown code: "), F.coalesce(c.cast("string"), F.lit("NULL")))))


def nan_to_zero(c: Column) -> Column:
    """NULL and NaN become 0."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def fisher_z(r: Column, clip: float = CLIP) -> Column:
    """Atanh of r kept within 1 - clip of zero; missing gives 0."""
    kept = F.greatest(F.lit(clip - 1), F.least(F.lit(1 - clip), nan_to_zero(r)))
    return F.atanh(kept)


def safe_ratio(a: Column, b: Column) -> Column:
    """0/0 is 0; x/0 is NULL (trap T21)."""
    return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.try_divide(a, b))


def log2_fold(a: Column, b: Column) -> Column:
    """log2(a / b), NULL where it has none."""
    q = F.try_divide(a, b)
    return F.when(q > 0, F.log2(q))


def t_to_z(t: Column, dof: Column) -> Column:
    """Bailey's transformation of t to z."""
    return (dof + 0.125) / (dof + 1.125) * F.sqrt((dof + 19 / 12) * F.log(1 + t / (dof + 1 / 12) * t)) * F.signum(t)


def stars(p: Column) -> Column:
    """*** ** * ns at 0.001, 0.01 and 0.05; NULL stays NULL."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def stars_plot(p: Column) -> Column:
    """** * ns at 0.001 and 0.05."""
    return F.when(p < 0.001, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; NULL where a side is constant or one row is left."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def seeded(seed: str, *keys: Column) -> Column:
    """Order key of a seed and ids, the same for every partitioning."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)))


def motion_valid(mean_fd: Column, low_ratio: Column, n_frames: Column | None = None, frames: tuple[int | None, int | None] = (None, None), max_fd: float = 0.5, min_ratio: float = 0.4) -> Column:
    """Run validity; both statistics are rounded to six places before the comparison (trap T7)."""
    ok = (F.round(mean_fd, 6) <= max_fd) & (F.round(low_ratio, 6) > min_ratio)
    least, exact = frames
    if least is not None:
        ok &= n_frames >= least
    if exact is not None:
        ok &= n_frames == exact
    return F.coalesce(ok, F.lit(False))


def framewise_displacement(d_trans: list[Column], d_rot: list[Column], radius: float = 50.0) -> Column:
    """Sum of absolute translations plus radius times absolute rotations (radians)."""
    total = F.lit(0.0)
    for c in d_trans:
        total = total + F.abs(c)
    for c in d_rot:
        total = total + radius * F.abs(c)
    return total


def r6(c: Column) -> Column:
    return F.round(c, 6)
