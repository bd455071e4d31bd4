"""Column expressions: identifiers, ranks' scalars, tails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("", "NA", "N/A", "NAN", "NONE", "NULL")  # fixed values: spellings of a missing identifier


def patient_of(barcode: Column) -> Column:
    """First 12 characters of a TCGA barcode; other ids pass through."""
    return F.when(barcode.rlike("^TCGA-"), F.substring(barcode, 1, 12)).otherwise(barcode)


def sample_type(barcode: Column) -> Column:
    """Two-digit sample code of a barcode; null for other ids."""
    code = F.regexp_extract(barcode, r"^TCGA-[^-]+-[^-]+-(\d{2})", 1)
    return F.when(code != "", code)


def canonical(ident: Column) -> Column:
    """Trimmed, upper case, without a version suffix; null for a missing token."""
    clean = F.regexp_replace(F.upper(F.trim(ident)), r"\.[0-9]+$", "")
    return F.when(~clean.isin(*MISSING), clean)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix:first 20 hex digits of the SHA-256 of the parts joined by |; a null part is empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(joined, 256), 1, 20))


def strict_bool(c: Column) -> Column:
    """true/false/1/0 in any case; null is false; anything else is null, to be counted by a check."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(c.isNull() | low.isin("false", "0"), F.lit(False)).when(low.isin("true", "1"), F.lit(True))


def pmid(c: Column) -> Column:
    """The first run of 6 to 9 digits."""
    found = F.regexp_extract(c, r"(?:^|[^0-9])([0-9]{6,9})(?:[^0-9]|$)", 1)
    return F.when(found != "", found)


def direction(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.rlike("^(up|pos|positive|increase|activat|a$)"), "positive").when(low.rlike("^(down|neg|negative|decrease|inhibit|repress|r$)"), "negative").otherwise("unknown")


def safe_corr(x, y) -> Column:
    """Pearson's correlation; null without variance, where the built-in raises under ANSI rules."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def minus_log10(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t for integer df, by the finite cosine series."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    cos2 = F.pow(F.cos(theta), F.lit(2.0))
    even, steps = df % 2 == 0, F.when(df > 1, F.floor((df - F.when(df % 2 == 0, 2).otherwise(3)) / 2)).otherwise(-1).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc, k):
        ratio = F.when(even, (2 * k - 1) / (2 * k)).otherwise(2 * k / (2 * k + 1))
        term = acc["term"] * cos2 * ratio
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, add, lambda a: a["sum"])).otherwise(F.when(steps == 0, 1.0).otherwise(0.0))
    inside = F.when(even, F.sin(theta) * series).otherwise(F.lit(2 / math.pi) * (theta + F.sin(theta) * F.cos(theta) * series))
    return F.when(df >= 1, F.greatest(1 - inside, F.lit(0.0)))


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail: erfc(|z|/sqrt 2) by a continued fraction for large z and a series for small."""
    x = F.abs(z) / math.sqrt(2)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(x.alias("t"), x.alias("s")),
        lambda a, n: F.struct((-a["t"] * x * x / n).alias("t"), (a["s"] - a["t"] * x * x / n / (2 * n + 1)).alias("s")),
        lambda a: 1 - 2 / math.sqrt(math.pi) * a["s"],
    )
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(0.0), lambda a, n: n / 2 / (x + a), lambda a: F.exp(-x * x) / math.sqrt(math.pi) / (x + a))
    return F.when(x < 2.5, series).otherwise(fraction)
