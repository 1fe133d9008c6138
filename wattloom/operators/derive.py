"""Derived metrics and engineered features: pure projections, recomputed and never stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.expr import cdyn, fmax, ratio


def with_derived(df: DataFrame) -> DataFrame:
    """Errors (positive: the early estimate is too low), ratios, dynamic power, shares and capacitances."""
    be, leak = F.col("be_mw"), F.col("be_leakage_mw")
    out = {}
    for kind in ("logical", "physical"):
        fe = F.col(f"fe_{kind}_mw")
        out |= {f"{kind}_error_mw": be - fe, f"{kind}_error_pct": ratio(be - fe, be) * 100, f"{kind}_to_be_ratio": ratio(fe, be)}
    dynamic = F.when(be.isNotNull() & leak.isNotNull(), F.greatest(be - leak, F.lit(0.0)))
    out |= {
        "be_dynamic_mw": dynamic,
        "leakage_fraction": ratio(leak, be),
        "clock_fraction": ratio(F.col("be_clock_mw"), dynamic),
        "cdyn_pf": cdyn(dynamic, F.col("voltage_v"), F.col("frequency_ghz")),
        "fmax_ghz": fmax(F.col("clock_period_ps"), F.col("wns_ps")),
    }
    return df.withColumns(out)


def with_features(df: DataFrame) -> DataFrame:
    """Model terms; activity, voltage and frequency count as 1 where missing."""
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    wire, cell = F.col("wire_cap_pf"), F.col("cell_cap_pf")
    swing = one("voltage_v") * one("voltage_v") * one("frequency_ghz")
    total = wire + cell
    return df.withColumns(
        {
            "total_cap_pf": total,
            "wire_cap_fraction": F.when(total > 0, ratio(wire, total)),
            "dyn_term": one("activity") * total * swing,
            "leak_term": F.col("area") * one("voltage_v") * one("voltage_v") * one("voltage_v"),
            "cell_dyn_term": one("activity") * cell * swing,
            "wire_dyn_term": one("activity") * wire * swing,
            "move_term": F.col("bits_per_cycle") * F.col("avg_net_length_um") * swing,
        }
    )


#: Changes of these make an early estimate scale with the dynamic term.
TRIGGERS = ("wire_cap_pf", "cell_cap_pf", "activity", "voltage_v", "frequency_ghz")


def rescale_estimate(proposed: DataFrame, changed: set[str]) -> DataFrame:
    """fe_physical_mw times the ratio of dyn_term to cur_dyn_term, unless it was set itself; 1 where missing."""
    if "fe_physical_mw" in changed or not changed & set(TRIGGERS):
        return proposed
    by = F.coalesce(F.try_divide(F.col("dyn_term"), F.col("cur_dyn_term")), F.lit(1.0))
    return proposed.withColumn("fe_physical_mw", F.col("fe_physical_mw") * by)
