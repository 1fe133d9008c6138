"""Null-safe column expressions. Missing is NULL, never NaN; dividing by zero or a missing value is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def cdyn(power: Column, voltage: Column, frequency: Column) -> Column:
    """Dynamic capacitance in pF of a power in mW at a voltage and a frequency in GHz."""
    return ratio(power, voltage * voltage * frequency)


def fmax(period_ps: Column, wns_ps: Column) -> Column:
    delay = period_ps - wns_ps
    return F.when(delay > 0, 1000.0 / delay)


def natural_key(name: Column) -> Column:
    """Sort key under which B2 stands before B10: digit runs compare as numbers."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    number = lambda p: F.when(p.rlike(r"^\d+$"), p.cast("decimal(38,0)")).otherwise(F.lit(-1).cast("decimal(38,0)"))
    return F.transform(parts, lambda p: F.struct(number(p).alias("number"), F.when(p.rlike(r"^\d+$"), "").otherwise(p).alias("text")))


def pearson(x: Column, y: Column) -> Column:
    """Pairwise complete correlation as an aggregate; missing under three pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(a) >= 3, F.try_divide(F.covar_pop(a, b), spread))


def issue_list(*pairs: tuple[str, Column]) -> Column:
    """The codes whose conditions hold, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in pairs]))


def glob_regex(pattern: Column) -> Column:
    """A glob with * and ? as an anchored regular expression."""
    quoted = F.regexp_replace(pattern, r"([.\\+^$|(){}\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def ancestors(path: Column) -> Column:
    """A path and what it lies under, as an array that begins with the empty root: a join key for anything named by a prefix."""
    parts = F.split(path, "/")
    return F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def glob_base(pattern: Column) -> Column:
    """The whole path elements before a glob's first wildcard: every path that it matches lies under them."""
    return F.regexp_extract(pattern, r"^([^*?]*)/[^/]*[*?]", 1)
