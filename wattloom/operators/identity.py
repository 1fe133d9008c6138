"""From report objects to blocks: name rules, resolution, lineage, and the pivot from long to wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.expr import ancestors, glob_base, glob_regex, issue_list, ratio

#: The unit that each metric is kept in, and factors into it.
CANONICAL = {
    "mw": ["fe_logical_mw", "fe_physical_mw", "be_mw", "be_leakage_mw", "fe_leakage_mw", "be_voltus_mw", "be_clock_mw", "be_register_mw", "be_comb_mw", "be_memory_mw", "profile_total_mw", "profile_dynamic_mw", "profile_leakage_mw"],
    "pf": ["wire_cap_pf", "cell_cap_pf"],
    "ps": ["clock_period_ps", "wns_ps", "tns_ps"],
    "um2": ["area"],
    "um": ["wire_length_um", "avg_net_length_um"],
    "ghz": ["frequency_ghz"],
    "v": ["voltage_v"],
    "count": ["cell_count", "fanout", "net_count", "violating_endpoints"],
    "ratio": ["activity", "cg_efficiency"],
    "bits": ["bits_per_cycle"],
    "ops/cycle": ["ipc"],
    "gops/s": ["throughput_gops"],
}
FACTORS = {
    "mw": {"w": 1e3, "mw": 1.0, "uw": 1e-3, "nw": 1e-6},
    "pf": {"f": 1e12, "pf": 1.0, "ff": 1e-3, "nf": 1e3},
    "ps": {"ps": 1.0, "ns": 1e3, "us": 1e6},
    "um2": {"um2": 1.0, "mm2": 1e6, "nm2": 1e-6},
    "um": {"um": 1.0, "mm": 1e3, "nm": 1e-3},
    "ghz": {"hz": 1e-9, "khz": 1e-6, "mhz": 1e-3, "ghz": 1.0},
    "v": {"v": 1.0, "mv": 1e-3},
    "count": {"count": 1.0, "1": 1.0},
    "ratio": {"ratio": 1.0, "%": 0.01, "1": 1.0},
    "bits": {"bits": 1.0, "1": 1.0},
    "ops/cycle": {"ops/cycle": 1.0, "1": 1.0},
    "gops/s": {"gops/s": 1.0, "mops/s": 1e-3, "gops": 1.0, "1": 1.0},
}
#: Fixed: how objects of one block combine (all others add), and what a metric varies by (all others by both keys).
MEAN = ["activity", "cg_efficiency", "fanout", "avg_net_length_um"]
LEAST = ["wns_ps"]
FIRST = ["clock_period_ps", "frequency_ghz", "voltage_v", "ipc", "throughput_gops"]
SCOPE = {
    "area": (), "cell_count": (), "fanout": (), "wire_cap_pf": (), "cell_cap_pf": (), "net_count": (), "wire_length_um": (), "avg_net_length_um": (),
    "activity": ("workload",), "bits_per_cycle": ("workload",),
    "clock_period_ps": ("operating_point",), "wns_ps": ("operating_point",), "tns_ps": ("operating_point",), "violating_endpoints": ("operating_point",), "frequency_ghz": ("operating_point",), "voltage_v": ("operating_point",),
}
FRONT, PHYSICAL = ["fe_logical_mw", "fe_physical_mw"], ["wire_cap_pf", "cell_cap_pf", "area"]
POWER = [m for m in CANONICAL["mw"] if not m.startswith("profile_")]


def convert_units(long: DataFrame) -> DataFrame:
    """value in the canonical unit; ``unit_error`` where a known metric has an unknown unit."""
    unit = {m: u for u, ms in CANONICAL.items() for m in ms}
    factor = {f"{m}/{u}": f for m, c in unit.items() for u, f in FACTORS[c].items()}
    table = F.create_map(*[F.lit(x) for pair in factor.items() for x in pair])
    known = F.create_map(*[F.lit(x) for pair in unit.items() for x in pair])
    by = F.try_element_at(table, F.concat_ws("/", "metric", F.lower("unit")))
    target = F.try_element_at(known, F.col("metric"))
    return long.withColumns({"unit_original": F.col("unit"), "unit_error": target.isNotNull() & by.isNull(), "value": F.when(target.isNull(), F.col("value")).otherwise(F.col("value") * by), "unit": F.coalesce(target, F.col("unit"))})


def normalize_name(path: Column, *, divider: str = "/", strip_top: bool = False, rules: list[tuple[str, str]] | None = None, lowercase: bool = False) -> Column:
    """Unescape, divider to /, drop the first element, rewrite in order, lower case."""
    out = F.replace(F.replace(path, F.lit("\\"), F.lit("")), F.lit(divider), F.lit("/"))
    if strip_top:
        out = F.when(out.contains("/"), F.regexp_replace(out, "^[^/]*/", "")).otherwise(out)
    for pattern, to in rules or []:
        out = F.regexp_replace(out, pattern, to)
    return F.lower(out) if lowercase else out


def _by_partition(objects: DataFrame, mapping: DataFrame) -> DataFrame:
    """Partition objects with their blocks: by the name behind part_, else by the last element of the path."""
    tail = F.element_at(F.split("object", "/"), -1)
    names = F.array(F.regexp_extract(tail, r"^part_(.+)$", 1), tail)
    asked = objects.where("object_kind = 'partition'").select("object", "object_kind", F.posexplode(names).alias("at_", "name_")).withColumn("name_", F.lower(F.trim("name_")))
    blocks = mapping.where("partition is not null").select(F.lower(F.trim("partition")).alias("name_"), "fub").distinct()
    hits = asked.join(blocks, "name_").withColumn("least_", F.min("at_").over(Window.partitionBy("object")))
    return hits.where("at_ = least_").select("object", "object_kind", "fub", F.lit(1.0).alias("share_"), F.lit(None).cast("string").alias("instance"))


def resolve_objects(long: DataFrame, mapping: DataFrame, per_instance: bool = True, equal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mapped, unmapped); without ``per_instance``, replicas add up to their block. mapping: (fub, fe_hier, be_hier, partition, be_share); be_hier may be a glob.

    Distinct objects are resolved once: exactly, by partition, or else by glob; only distinct
    objects that nothing else claims meet the globs. Objects that several blocks share weigh by
    share (evenly if ``equal``), replicas carry the text that the glob's star matched. Ancestors of mapped paths go silently.
    """
    objects = long.select("object", "object_kind").distinct()
    m = mapping.withColumn("share_", F.coalesce(F.col("be_share").cast("double"), F.lit(1.0)))
    is_glob = F.col("be_hier").rlike(r"[*?]")
    kinds = [("fe_hier", m.select("fub", F.col("fe_hier").alias("object"), "share_")), ("be_hier", m.where(~is_glob).select("fub", F.col("be_hier").alias("object"), "share_"))]
    exact = None
    for kind, names in kinds:
        part = objects.where(F.col("object_kind") == kind).join(names.where("object is not null").distinct(), "object").select("object", "object_kind", "fub", "share_", F.lit(None).cast("string").alias("instance"))
        exact = part if exact is None else exact.unionByName(part)
    exact = exact.unionByName(_by_partition(objects, m))
    rest = objects.where("object_kind = 'be_hier'").join(exact.select("object", "object_kind"), ["object", "object_kind"], "left_anti")
    globs = m.where(is_glob).select("fub", F.col("be_hier").alias("glob"), "share_").withColumns({"re": glob_regex(F.col("glob")), "under_": glob_base(F.col("glob"))})
    # an object meets only the globs whose literal path elements it lies under: an equality
    near = rest.withColumn("under_", F.explode(ancestors(F.col("object"))))
    by_glob = near.join(globs, "under_").where(F.rlike("object", F.col("re"))).select("object", "object_kind", "fub", "share_", F.substring_index(F.expr("substr(object, length(substring_index(glob, '*', 1)) + 1)"), "/", 1).alias("instance"))
    found = exact.unionByName(by_glob)
    design = objects.where("object_kind = 'design'").select("object", "object_kind", F.lit("*").alias("fub"), F.lit(1.0).alias("share_"), F.lit(None).cast("string").alias("instance"))
    n = Window.partitionBy("object", "object_kind")
    shared = (F.count("*").over(n) > 1) & (F.col("object_kind") == "be_hier")
    found = found.withColumn("share_", F.lit(1.0) if equal else F.col("share_"))
    total = F.sum("share_").over(n)
    found = found.withColumn("weight", F.when(shared, F.when(total > 0, F.col("share_") / total).otherwise(1.0)).otherwise(1.0)).drop("share_").unionByName(design.withColumnRenamed("share_", "weight"))
    found = found.withColumn("fub", F.when(F.lit(per_instance) & F.col("instance").isNotNull() & (F.col("instance") != "") & (F.col("weight") == 1), F.concat_ws("@", "fub", "instance")).otherwise(F.col("fub")))
    mapped = long.join(found, ["object", "object_kind"])
    paths = mapping.select(F.explode(F.array("fe_hier", "be_hier")).alias("p")).where("p is not null").withColumn("p", F.substring_index("p", "*", 1))
    above = paths.select(F.explode(ancestors(F.col("p"))).alias("object"), "p").where("object <> p").select("object").distinct()
    unmapped = long.join(found.select("object", "object_kind").distinct(), ["object", "object_kind"], "left_anti").join(above, "object", "left_anti")
    return mapped, unmapped


def aggregate_metrics(mapped: DataFrame) -> DataFrame:
    """One value a (design, build, fub, scope, metric): first report of an object counts; sums, weighted means, least or first."""
    scope = lambda k: F.when(F.col("metric").isin([m for m, s in SCOPE.items() if k not in s]), None).otherwise(F.col(k))
    rows = mapped.withColumns({"workload": scope("workload"), "operating_point": scope("operating_point")})
    keys = ["design", "build", "fub", "workload", "operating_point", "metric"]
    once = Window.partitionBy(*keys, "object", "source_file").orderBy("ordinal")
    rows = rows.withColumn("n_", F.row_number().over(once)).where("n_ = 1")
    v, w = F.col("value"), F.col("weight")
    weight = F.sum(F.when(v.isNotNull(), w))
    value = F.when(F.col("metric").isin(MEAN), F.when(weight > 0, ratio(F.sum(v * w), weight))).when(F.col("metric").isin(LEAST), F.min(v)).when(F.col("metric").isin(FIRST), F.min_by(v, F.when(v.isNotNull(), F.col("ordinal")))).otherwise(F.sum(v * w))
    return rows.groupBy(*keys).agg(value.alias("value"))


def pivot_wide(values: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows of the grid that power records span, other metrics broadcast over the keys they lack.

    One conditional aggregate a scope and at most three joins, not a join a metric.
    """
    base = ["design", "build", "fub"]
    grid = values.where(F.col("metric").isin(POWER)).select(*base, "workload", "operating_point").distinct()
    out = grid
    for scope in ((), ("workload",), ("operating_point",), ("workload", "operating_point")):
        own = [m for m in metrics if SCOPE.get(m, ("workload", "operating_point")) == scope]
        if own:
            side = values.where(F.col("metric").isin(own)).groupBy(*base, *scope).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in own])
            out = out.join(side, [*base, *scope], "left")
    return out


def share_modules(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Early metrics come once a module, signoff ones once an instance (name@i): each instance takes its share of ``metrics``.

    What adds up is divided by the number of instances, the rest is copied, at the same workload and
    operating point; the module's own row goes.
    """
    base, instance = F.split("fub", "@")[0], F.col("fub").contains("@")
    keys = ["design", "build", "base_"]
    rows = wide.withColumn("base_", base)
    counts = rows.where(instance).groupBy(*keys).agg(F.countDistinct("fub").alias("n_"))
    rows = rows.join(counts, keys, "left")
    corner = [*keys, "workload", "operating_point"]
    modules = rows.where(~instance & F.col("n_").isNotNull()).groupBy(*corner).agg(F.lit(True).alias("module_"), *[F.max(m).alias(f"module_{m}") for m in metrics])
    rows = rows.where(instance | F.col("n_").isNull()).join(modules, corner, "left")
    whole = lambda m: m not in MEAN and m not in LEAST and m not in FIRST
    shared = {m: F.when(F.col("module_") & instance, F.col(f"module_{m}") / F.col("n_") if whole(m) else F.col(f"module_{m}")).otherwise(F.col(m)) for m in metrics}
    return rows.withColumns(shared).select(*wide.columns)


def lineage(mapped: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per design, build and block (or instance of one): its chain, relationship, metrics and their sources, and what is missing."""
    seen = mapped.where("fub <> '*'").withColumn("base", F.split("fub", "@")[0])
    metrics = seen.groupBy("design", "build", "base", F.col("fub").alias("own")).agg(
        F.array_sort(F.collect_set("metric")).alias("metrics"),
        F.array_sort(F.collect_set(F.concat_ws(":", "metric", "source"))).alias("sources"),
        F.sum(F.when(F.col("metric") == "cell_count", F.col("value"))).alias("physical_instances"),
    )
    exact = mapping.where(~F.coalesce(F.col("be_hier").rlike(r"[*?]"), F.lit(False)))
    shared = exact.groupBy("be_hier").agg(F.countDistinct("fub").alias("n")).where("n > 1 and be_hier is not null")
    merged = exact.join(shared, "be_hier").select(F.col("fub").alias("merged_")).distinct()
    first = lambda c: F.min(c).alias(c) if c in mapping.columns else F.lit(None).cast("string").alias(c)
    blocks = mapping.groupBy("fub").agg(*[first(c) for c in ("partition", "fe_hier", "synth_object", "be_hier", "model_root")], F.count("*").alias("rows_"), F.max(F.coalesce(F.col("be_hier").rlike(r"[*?]"), F.lit(False))).alias("glob_"))
    blocks = blocks.join(merged, F.col("fub") == F.col("merged_"), "left")
    relation = F.concat_ws(";", F.when(F.col("rows_") > 1, "split"), F.when(F.col("merged_").isNotNull(), "merged"), F.when(F.col("glob_"), "replicated"))
    blocks = blocks.withColumn("relationship", F.when(relation != "", relation).otherwise("one-to-one"))
    runs = mapped.groupBy("design", "build").agg(F.max(F.col("object_kind") == "partition").alias("timed_"))
    grid = runs.crossJoin(blocks)  # runs x blocks is the table asked for
    out = grid.join(metrics.withColumnRenamed("base", "fub"), ["design", "build", "fub"], "left")
    has = lambda names: F.arrays_overlap(F.coalesce("metrics", F.array().cast("array<string>")), F.array(*[F.lit(m) for m in names]))
    every = F.size(F.array_intersect(F.coalesce("metrics", F.array().cast("array<string>")), F.array(*[F.lit(m) for m in PHYSICAL]))) == len(PHYSICAL)
    issues = issue_list(("fe_hier_not_in_reports", ~has(FRONT)), ("be_hier_not_in_reports", ~has(["be_mw"])), ("incomplete_physical_mapping", ~every), ("no_partition", F.col("partition").isNull()), ("partition_timing_missing", F.col("partition").isNotNull() & F.col("timed_") & ~has(["wns_ps"])))
    root = F.coalesce("model_root", F.concat_ws(".", "design", "partition", "fub"))
    instance = F.try_element_at(F.split("own", "@"), F.lit(2))
    out = out.withColumns({"lineage_issues": issues, "model_root": F.when(instance.isNotNull(), F.concat_ws("@", root, instance)).otherwise(root)})
    return out.withColumns({"lineage_ok": F.size("lineage_issues") == 0, "fub": F.coalesce("own", "fub")}).drop("own", "rows_", "glob_", "merged_", "timed_")


def intent_table(blocks: DataFrame, domains: DataFrame, points: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Blocks against power domains: which domain holds them, and whether its states' voltages are those of the operating points.

    blocks: (fub, be_hier, fe_hier), domains: a row a (domain, element, supply_net, state, voltage), points: (operating_point,
    voltage_v); each with design and build where they differ by run. A block is where its signoff path is, or else its early one;
    of several domains the first by name gives the voltages. A path's ancestors meet the elements by equality.
    """
    run = [c for c in ("design", "build") if c in blocks.columns and c in domains.columns]
    elements = domains.select(*run, "domain", "element").where("element is not null").distinct()
    elements = elements.withColumn("under_", F.rtrim(F.col("element"), F.lit("/")))
    keys = [*run, *[c for c in ("fub", "model_root", "partition") if c in blocks.columns]]
    paths = blocks.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("side_"), F.col(f"{s}_hier").alias("path_")) for s in ("be", "fe")])).alias("at_")).select(*keys, "at_.*")
    near = paths.distinct().withColumn("under_", F.explode_outer(ancestors(F.col("path_"))))
    hits = near.join(elements, [*run, "under_"], "left")
    inside = (F.col("path_") == F.col("element")) | F.col("path_").startswith(F.concat("under_", F.lit("/")))
    domains_of = lambda side: F.array_sort(F.collect_set(F.when(inside & (F.col("side_") == side), F.col("domain")))).alias(side)
    by = hits.groupBy(*keys).agg(domains_of("be"), domains_of("fe"))
    by = by.withColumn("domains", F.when(F.size("be") > 0, F.col("be")).otherwise(F.col("fe"))).drop("be", "fe").withColumn("power_domain", F.try_element_at("domains", F.lit(1)))
    states = domains.where("state is not null").groupBy(*run, F.col("domain").alias("power_domain")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("state", "voltage")))).alias("domain_states"))
    nets = domains.groupBy(*run, F.col("domain").alias("power_domain")).agg(F.min("supply_net").alias("supply_net"))
    out = by.join(states, [*run, "power_domain"], "left").join(nets, [*run, "power_domain"], "left")
    on = [c for c in run if c in points.columns]
    asked = points.groupBy(*on).agg(F.array_sort(F.collect_set(F.struct("operating_point", "voltage_v"))).alias("points_"))
    out = out.join(asked, on, "left") if on else out.crossJoin(F.broadcast(asked))  # one row
    known = F.coalesce("domain_states", F.create_map().cast("map<string, double>"))
    asked_points = F.coalesce("points_", F.array().cast("array<struct<operating_point: string, voltage_v: double>>"))
    in_domain = F.col("power_domain").isNotNull()
    lost = in_domain & F.exists(asked_points, lambda p: ~F.map_contains_key(known, p["operating_point"]))
    off = F.filter(asked_points, lambda p: F.coalesce(F.abs(F.try_element_at(known, p["operating_point"]) - p["voltage_v"]) > tolerance, F.lit(False)))
    n = F.size("domains")
    issues = issue_list(("no_power_domain", n == 0), ("multiple_power_domains", n > 1), ("domain_state_missing", lost), ("domain_voltage_mismatch", in_domain & (F.size(off) > 0)))
    said = F.array_join(F.transform(off, lambda p: F.concat(p["operating_point"], F.format_string(":%.3fV!=%.3fV", F.try_element_at(known, p["operating_point"]), p["voltage_v"]))), ";")
    out = out.withColumns({"intent_issues": issues, "voltage_mismatch": F.when(in_domain, said).otherwise("")})
    return out.withColumn("intent_ok", F.size("intent_issues") == 0).drop("points_")


def intent_summary(table: DataFrame) -> DataFrame:
    """Per design and build: domains, blocks, consistent ones, and those without a domain or off its voltage."""
    return table.groupBy("design", "build").agg(F.countDistinct("power_domain").alias("domains"), F.count("*").alias("fubs"), F.count_if("intent_ok").alias("consistent"), F.count_if(F.array_contains("intent_issues", "no_power_domain")).alias("no_domain"), F.count_if(F.array_contains("intent_issues", "domain_voltage_mismatch")).alias("voltage_mismatch"))
