"""The jobs as queries over the given tables: run twice into a new folder, so that the second run must change nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import build_scorecard, text_intake
from wattloom import queries as engine
from wattloom.plans.fixture import sql
from wattloom.session import shared_dir


def _config(job) -> dict:
    with open(Path(job.__file__).with_suffix(".json")) as f:
        return json.load(f)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_text_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's catalogue row; the second run finds no new files."""
    root, config = _folder(spark, "job1"), _config(text_intake)
    for _ in range(2):
        out = text_intake.run(spark, sf_dir, f"{root}/out", f"{root}/checkpoint", config["tables"], config["files_per_batch"])
    return out.drop("batch")


def job2_build_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard of every build and partition."""
    root, config = _folder(spark, "job2"), _config(build_scorecard)
    for _ in range(2):
        out = build_scorecard.run(spark, sf_dir, root, config["rise_pct"], config["usable_pct"])
    return out.withColumns({c: F.round(c, 6) for c in ("power_mw", "dynamic_mw", "previous_mw", "change_pct")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_text_intake": job1_text_intake, "job2_build_scorecard": job2_build_scorecard}

_INTAKE = r"""
with t as (
  select 'documents' as "table", cast(source as varchar) as source, doc_id as id, coalesce(text, '') as text from documents
  union all select 'pages', null, page_id, coalesce(html, '') from pages
), d as (
  select "table", source, id, sha256(text) as sha256, cast(strlen(text) as bigint) as n_bytes, cast(length(text) - length(replace(text, chr(10), '')) + 1 as bigint) as n_lines,
    cast(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as bigint) as n_words,
    cast(len(regexp_extract_all(text, '[0-9]+([.][0-9]+)?')) as bigint) as n_figures
  from t
)
select *, min(id) over w as first_id, coalesce(id <> min(id) over w, min(id) over w is not null) as repeated from d window w as (partition by "table", sha256)
"""
# the blocking checks that rows of these tables can fail: no key repeats and no sum is negative in them
_USABLE = """u as (select *, not (coalesce(abs(be_mw) < 0.01, true) or wire_cap_pf is null or cell_cap_pf is null or area is null or coalesce(med > 0 and (be_mw / med > 50 or be_mw / med < 0.02), false) or date_diff('day', build_date, newest) > 120) as usable
  from (select *, median(be_mw) over (partition by design) as med, max(build_date) over (partition by design) as newest from d) m)"""
_RATE = "(power_mw - previous_mw) / nullif(previous_mw, 0) * 100"
_SCORES = f"""{engine.RANKED.rstrip()}, {_USABLE}, found as ({engine._ALL_SQL}),
fc as (select design, build, split_part(model_root, '.', 2) as partition, count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium from found group by 1, 2, 3),
qc as (select design, build, partition, count(*) as n_rows, count(*) filter (where usable) as n_usable from u group by 1, 2, 3),
pw as (select design, build, build_rank, partition, count(distinct fub) filter (where {engine.AT}) as n_blocks, cast(sum(cast(be_mw as decimal(28,9))) filter (where {engine.AT}) as double) as power_mw, cast(sum(cast(be_dynamic_mw as decimal(28,9))) filter (where {engine.AT}) as double) as dynamic_mw from r group by 1, 2, 3, 4),
pp as (select *, case when lag(build_rank) over w = build_rank - 1 then lag(power_mw) over w end as previous_mw from pw window w as (partition by design, partition order by build_rank)),
sc as (select pp.*, {_RATE} as change_pct, n_rows, n_usable, coalesce(high, 0) as high, coalesce(medium, 0) as medium from pp join qc using (design, build, partition) left join fc using (design, build, partition))
select design, build, partition, n_rows, n_usable, n_blocks, round(power_mw, 6) as power_mw, round(dynamic_mw, 6) as dynamic_mw, round(previous_mw, 6) as previous_mw, round(change_pct, 6) as change_pct, high, medium,
  case when high > 0 or coalesce(change_pct > 10, false) then 'red' when medium > 0 or n_usable * 100 < n_rows * 50 then 'amber' else 'green' end as grade from sc
"""
ORACLE_SQL: dict[str, str] = {"job1_text_intake": _INTAKE, "job2_build_scorecard": sql(_SCORES)}
