"""The relational tables seen as power measurements: one text that Spark and DuckDB both read.

Sums are exact decimals before they become doubles, so that both engines see the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattloom.session import importable

WIDE = """
select *, design || '.' || partition || '.' || fub as model_root, 'rtl-' || partition as owner,
  cast(40 - (partition_number * 7 + build_number * 13 + case when operating_point = 'nom' then 0 else 29 end) % 80 as double) as wns_ps,
  make_date(1995 + cast(floor((build_number - 1) / 4.0) as int), 1 + 3 * ((build_number - 1) % 4), 1) as build_date,
  case when build_number <= 6 then 'rtl' when build_number <= 12 then 'synthesis' when build_number <= 18 then 'placement' when build_number <= 24 then 'route' else 'signoff' end as milestone
from (
  select r_name as design,
    'B' || cast((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) as varchar(9)) as build,
    cast((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) as int) as build_number,
    p_brand as fub, 'FE_BE' as stage,
    cast(substring(p_brand, 7) as int) % 5 as partition_number,
    'P' || cast(cast(substring(p_brand, 7) as int) % 5 as varchar(9)) as partition,
    case l_returnflag when 'A' then 'idle' when 'N' then 'typical' else 'compute' end as workload,
    case l_linestatus when 'F' then 'nom' else 'turbo' end as operating_point,
    case l_linestatus when 'F' then 0.75e0 else 0.85e0 end as voltage_v,
    case l_linestatus when 'F' then 1.0e0 else 1.25e0 end as frequency_ghz,
    case l_linestatus when 'F' then 1000e0 else 800e0 end as clock_period_ps,
    cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / 1000 as be_mw,
    cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) / 1000 as fe_physical_mw,
    cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) * (1 - cast(l_tax as decimal(4,2)))) as double) / 1000 as fe_logical_mw,
    cast(sum(cast(l_quantity as decimal(18,2))) as double) / 10 as be_leakage_mw,
    cast(sum(case when l_linenumber = 1 then cast(l_extendedprice as decimal(18,2)) else 0 end) as double) / 1000 as be_clock_mw,
    cast(sum(case when l_linenumber in (2, 3) then cast(l_extendedprice as decimal(18,2)) else 0 end) as double) / 1000 as be_register_mw,
    cast(sum(case when l_linenumber in (4, 5, 6) then cast(l_extendedprice as decimal(18,2)) else 0 end) as double) / 1000 as be_comb_mw,
    cast(sum(case when l_linenumber = 7 then cast(l_extendedprice as decimal(18,2)) else 0 end) as double) / 1000 as be_memory_mw,
    cast(sum(cast(l_quantity as decimal(18,2))) as double) as wire_cap_pf,
    cast(count(*) * 20 as double) as cell_cap_pf,
    cast(sum(p_size) as double) as area,
    cast(count(*) as double) as cell_count,
    abs(cast(sum(cast(l_discount as decimal(18,2))) as double)) * 5 / count(*) as activity,
    1 - abs(cast(sum(cast(l_tax as decimal(18,2))) as double)) * 5 / count(*) as cg_efficiency,
    case when count(*) > 1 then cast(sum(l_linenumber) as double) end as bits_per_cycle,
    cast(sum(p_size) as double) / count(*) as avg_net_length_um,
    cast(sum(cast(l_extendedprice as decimal(18,2))) as double) * 0.97e0 / 1000 + cast(substring(p_brand, 7) as int) as be_voltus_mw
  from {lineitem} lineitem join {orders} orders on l_orderkey = o_orderkey join {part} part on l_partkey = p_partkey
    join {supplier} supplier on l_suppkey = s_suppkey join {nation} nation on s_nationkey = n_nationkey
    join {region} region on n_regionkey = r_regionkey
  group by r_name, year(o_orderdate), quarter(o_orderdate), p_brand, l_returnflag, l_linestatus
) cells
"""

PERFORMANCE = """
select *, case operating_point when 'nom' then 0.75e0 else 0.85e0 end as voltage_v, case operating_point when 'nom' then 1.0e0 else 1.25e0 end as frequency_ghz
from (
  select r_name as design, 'B' || cast((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) as varchar(9)) as build,
    case o_orderstatus when 'F' then 'idle' when 'O' then 'typical' else 'compute' end as workload,
    case when o_orderkey % 2 = 0 then 'nom' else 'turbo' end as operating_point,
    cast(count(*) as double) as ipc, cast(sum(cast(o_totalprice as decimal(18,2))) as double) / 100000 as throughput_gops
  from {orders} orders join {customer} customer on o_custkey = c_custkey join {nation} nation on c_nationkey = n_nationkey
    join {region} region on n_regionkey = r_regionkey
  group by r_name, year(o_orderdate), quarter(o_orderdate), o_orderstatus, o_orderkey % 2
) runs
"""

PROFILE = """
select r_name as design, 'B' || cast(10 + user_id % 2 as varchar(9)) as build, event_type, case when event_type in ('click', 'view') then 'typical' else 'idle' end as workload,
  'nom' as operating_point, event_id, ts as t_start,
  lead(ts) over (partition by r_name, user_id % 2, case when event_type in ('click', 'view') then 'typical' else 'idle' end order by ts, event_id) as t_end,
  value as profile_total_mw
from {events} events join {region} region on r_regionkey = user_id % 5
"""

TABLES = {"wide": WIDE, "performance": PERFORMANCE, "profile": PROFILE}
SOURCES = ["lineitem", "orders", "part", "supplier", "nation", "region", "customer", "events"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of TABLES over the given Parquet files."""
    importable(spark)
    text = TABLES[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if "{" + t + "}" in text}
    return spark.sql(text.replace("varchar(9)", "string"), **used)


def sql(query: str, *tables: str) -> str:
    """DuckDB text of a query over the named TABLES."""
    ctes = ", ".join(f"{t} as ({TABLES[t].format(**{s: s for s in SOURCES})})" for t in tables or ["wide"])
    return f"with {ctes}{',' if query.lstrip().lower().startswith('with ') else ''} {query.lstrip()[5:] if query.lstrip().lower().startswith('with ') else query}"
