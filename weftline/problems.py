"""Queries of the general data-pipeline problems 1, 3, 4 and 5, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import hierarchy, intervals, shred
from .scratch import Scratch
from .session import table
from .streaming.compactor import compact_timing_files, timing_records


def _forest(spark, d, with_path=False, **more):
    return hierarchy.peel(table(spark, d, "prov_derivations"), "generated_entity", "used_entity", with_path, **more)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d).where("generated and (steps >= 25 or steps = -1)").select(F.col("node").alias("entity"), F.col("top").alias("top_entity"), F.col("steps").cast("int").alias("steps"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """In rounds over all executors down to 1,000 nodes, so that the SQL is compared with rounds at small scales too."""
    return _forest(spark, d, True, local_nodes=1_000).select(
        F.col("node").alias("entity"), "parent", F.col("top").alias("top_entity"), F.col("steps").cast("int").alias("steps"), "subtree_size", F.array_join("path", "/").alias("path")
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_forest(spark, d, True))


def p1_other_parents(spark: SparkSession, d: str) -> DataFrame:
    """Links that the hierarchy does not follow, of entities with several parents."""
    return hierarchy.other_parents(table(spark, d, "prov_derivations"), "generated_entity", "used_entity")


def _store(spark, d):
    work = Scratch(spark, "compact")
    return compact_timing_files(spark, f"{d}/timing_files.parquet", work.path("store"), work.path("log"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return timing_records(_store(spark, d))


def p3_store(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    r = shred.records(table(spark, d, "prov_json"), "prov_doc_id", "payload")
    return r.select(F.col("doc_id").alias("prov_doc_id"), "bundle_id", "rec_type", "rec_id", "rec_no")


def _shredded(name: str):
    """One of the flat tables of all payloads."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return shred.tables(table(spark, d, "prov_json"), "prov_doc_id", "payload")[name]

    return run


def p4_rejected(spark: SparkSession, d: str) -> DataFrame:
    return shred.rejected(table(spark, d, "prov_json"), "prov_doc_id", "payload")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merged_periods(table(spark, d, "timing_log"), ["run_id", "pe", "rank"], "t_start", "t_end")


def p5_utilisation(spark: SparkSession, d: str) -> DataFrame:
    """Busy and idle milliseconds of each entity."""
    x = p5_found(spark, d).withColumn("ms", F.col("to_ms") - F.col("from_ms"))
    return x.groupBy("run_id", "pe", "rank").agg(
        F.coalesce(F.sum(F.when(F.col("span") == "period", F.col("ms"))), F.lit(0)).alias("busy_ms"),
        F.coalesce(F.sum(F.when(F.col("span") == "gap", F.col("ms"))), F.lit(0)).alias("idle_ms"),
        F.count_if(F.col("span") == "period").alias("periods"),
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_hierarchy": p1_hierarchy,
    "p1_descendants": p1_descendants,
    "p1_other_parents": p1_other_parents,
    "p3_found": p3_found,
    "p3_store": p3_store,
    "p4_found": p4_found,
    "p4_documents": _shredded("documents"),
    "p4_bundles": _shredded("bundles"),
    "p4_prefixes": _shredded("prefixes"),
    "p4_records": _shredded("records"),
    "p4_attributes": _shredded("attributes"),
    "p4_values": _shredded("values"),
    "p4_stray": _shredded("stray"),
    "p4_rejected": p4_rejected,
    "p5_found": p5_found,
    "p5_utilisation": p5_utilisation,
}

_WALK = """
with recursive e as (select distinct nullif(trim(generated_entity), '') c, nullif(trim(used_entity), '') p from prov_derivations),
par as (select c, min(p) p from e where c is not null and p is not null group by c),
nodes as (select c from e where c is not null union select p from e where p is not null),
w(node, cur, steps, seen, looped) as (
  select c, c, 0, [c], false from nodes
  union all
  select w.node, par.p, w.steps + 1, list_append(w.seen, par.p), list_contains(w.seen, par.p) from w join par on par.c = w.cur where not w.looped),
fin as (
  select w.node, case when w.looped then list_min(list_slice(seen, list_position(seen, cur), len(seen))) else cur end top_entity,
    cast(case when w.looped then -1 else w.steps end as integer) steps, seen
  from w left join par on par.c = w.cur where w.looped or par.p is null)
"""

_PERIODS = """
with t as (select run_id, pe, rank, cast(round(t_start * 1000) as bigint) a, cast(round(t_end * 1000) as bigint) z from timing_log
  where run_id is not null and pe is not null and rank is not null and t_end > t_start),
m as (select *, case when a > max(z) over w or max(z) over w is null then 1 else 0 end f from t
  window w as (partition by run_id, pe, rank order by a, z rows between unbounded preceding and 1 preceding)),
g as (select *, sum(f) over (partition by run_id, pe, rank order by a, z rows between unbounded preceding and current row) g from m),
p as (select run_id, pe, rank, min(a) a, max(z) z from g group by run_id, pe, rank, g),
s as (select run_id, pe, rank, 'period' span, a from_ms, z to_ms from p
  union all select * from (select run_id, pe, rank, 'gap', z, lead(a) over (partition by run_id, pe, rank order by a) n from p) where n is not null)
"""

# every JSON value of every payload that counts, with the labels of a depth-first walk: the r-th value in
# depth-first order at depth h comes after r openings and r - h closings
NODES_SQL = """
with recursive u(doc_id, variant, x) as (
  select distinct prov_doc_id, md5(payload), regexp_replace(payload, '^[\\s\\x{FEFF}]+|[\\s\\x{FEFF}]+$', '', 'g') from prov_json where payload is not null and prov_doc_id is not null
  union all
  select doc_id, variant, regexp_replace(json_extract_string(x, '$'), '^[\\s\\x{FEFF}]+|[\\s\\x{FEFF}]+$', '', 'g') from u where json_valid(x) and json_type(x) = 'VARCHAR'),
docs as (select doc_id, variant, x from u where json_valid(x) and json_type(x) = 'OBJECT'),
tree as (select d.doc_id, d.variant, t.id, t.parent, t.key, t.value, t.type, row_number() over (partition by d.doc_id, d.variant order by t.id) - 1 r from docs d, json_tree(d.x) t),
place as (select *, row_number() over (partition by doc_id, variant, parent order by id) - 1 i from tree),
k(doc_id, variant, id, r, h, kind, name, rec_type, no, bundle_id, rec, above, value, type, up) as (
  select doc_id, variant, id, r, cast(0 as bigint), 'document', '', cast(null as varchar), cast(null as bigint), '', cast(null as bigint), cast(null as bigint), value, type, [id] from place where parent is null
  union all
  select p.doc_id, p.variant, p.id, p.r, k.h + 1,
    case when k.kind = 'document' then case when p.type = 'OBJECT' then 'section' else 'stray' end
      when k.kind = 'bundle' then case when p.type = 'OBJECT' and p.key <> 'bundle' then 'section' else 'stray' end
      when k.kind = 'section' then case when k.rec_type in ('bundle', 'prefix') then k.rec_type when p.type = 'ARRAY' then 'list' else 'record' end
      when k.kind = 'list' then case when k.rec is null then 'record' else 'attribute' end
      when k.kind = 'record' and k.type = 'OBJECT' then case when p.type = 'ARRAY' then 'list' else 'attribute' end
      else 'value' end,
    case when k.kind = 'list' then k.name when k.type = 'ARRAY' then '' else p.key end,
    case when k.kind in ('document', 'bundle') then p.key when k.kind in ('section', 'list') then k.rec_type end,
    case when k.type = 'ARRAY' then p.i when k.kind in ('section', 'record') then 0 end,
    case when k.kind = 'bundle' then k.name else k.bundle_id end,
    case when k.kind = 'record' then 2 * k.r - k.h else k.rec end, 2 * k.r - k.h,
    p.value, p.type, list_append(k.up, p.id)
  from place p join k on p.doc_id = k.doc_id and p.variant = k.variant and p.parent = k.id),
sizes as (select doc_id, variant, a id, count(*) n from (select doc_id, variant, unnest(up) a from k) group by all),
lit as (select *, case when type = 'OBJECT' then json_extract(value, '$."$"') end inner_value from k),
node as (select l.doc_id, l.variant, l.kind, cast(2 * r - h as integer) pre, cast(2 * r - h + 2 * n - 1 as integer) post, bundle_id, cast(rec as integer) rec_pre, l.name, rec_type, cast(no as integer) no, cast(h as integer) depth, cast(above as integer) parent_pre, l.type in ('OBJECT', 'ARRAY') nested,
  coalesce(inner_value, l.value) v, json_type(coalesce(inner_value, l.value)) vt,
  case when inner_value is not null then case when json_type(l.value, '$.type') = 'VARCHAR' then json_extract_string(l.value, '$.type') else 'literal' end end lt,
  case when inner_value is not null and json_type(l.value, '$.lang') = 'VARCHAR' then json_extract_string(l.value, '$.lang') end lang
  from lit l join sizes s on s.doc_id = l.doc_id and s.variant = l.variant and s.id = l.id),
n as (select doc_id, variant, kind, pre, post, bundle_id, rec_pre, name, rec_type, no, lang, depth, parent_pre, nested,
  case when vt = 'NULL' then null when vt = 'VARCHAR' then json_extract_string(v, '$') else cast(v as varchar) end as value,
  coalesce(lt, case when vt = 'NULL' then 'null' when vt = 'VARCHAR' then 'string' when vt = 'BOOLEAN' then 'boolean' when vt in ('OBJECT', 'ARRAY') then 'json' else 'number' end) value_type from node)
"""

ORACLE = {
    "p4_found": NODES_SQL + "select distinct doc_id prov_doc_id, bundle_id, rec_type, name rec_id, no rec_no from n where kind in ('record', 'prefix')",
    "p4_documents": NODES_SQL + "select doc_id, variant, pre, post from n where kind = 'document'",
    "p4_bundles": NODES_SQL + "select doc_id, variant, pre, post, name bundle_id from n where kind = 'bundle'",
    "p4_prefixes": NODES_SQL + "select doc_id, variant, pre, post, bundle_id, name prefix, value uri from n where kind = 'prefix'",
    "p4_records": NODES_SQL + "select doc_id, variant, pre, post, bundle_id, rec_type, name rec_id, no rec_no from n where kind = 'record'",
    "p4_attributes": NODES_SQL + "select doc_id, variant, pre, post, bundle_id, rec_pre, name, no attr_no, value, value_type, lang from n where kind = 'attribute'",
    "p4_values": NODES_SQL
    + "select doc_id, variant, pre, post, bundle_id, rec_pre, parent_pre, depth, name, no as place, case when not nested then value end as value, case when not nested then value_type end value_type from n where kind = 'value'",
    "p4_stray": NODES_SQL + "select doc_id, variant, pre, post, bundle_id, name, value, value_type from n where kind = 'stray'",
    "p4_rejected": NODES_SQL + "select distinct prov_doc_id doc_id from prov_json where prov_doc_id is not null and prov_doc_id not in (select doc_id from docs)",
    "p1_found": _WALK + "select node entity, top_entity, steps from fin where (steps >= 25 or steps = -1) and node in (select c from e)",
    "p1_hierarchy": _WALK
    + """, sizes as (select cur, count(*) n from w where not looped group by cur)
select f.node entity, par.p parent, f.top_entity, f.steps,
  case when f.node in (select list_extract(seen, 1) from w where looped and cur = w.node) then null else coalesce(s.n, 0) end subtree_size,
  case when f.steps >= 0 then array_to_string(list_reverse(f.seen), '/') end path
from fin f left join par on par.c = f.node left join sizes s on s.cur = f.node""",
    "p1_descendants": _WALK + "select w.cur ancestor, w.node descendant, cast(w.steps as integer) steps from w join fin on fin.node = w.node where fin.steps >= 0 and w.steps > 0",
    "p1_other_parents": "with e as (select distinct nullif(trim(generated_entity), '') node, nullif(trim(used_entity), '') parent from prov_derivations), "
    "m as (select *, min(parent) over (partition by node) used from e where node is not null and parent is not null) select node, parent, used from m where parent <> used",
    "p5_found": _PERIODS + "select * from s",
    "p5_utilisation": _PERIODS
    + """select run_id, pe, rank, cast(coalesce(sum(case when span = 'period' then to_ms - from_ms end), 0) as bigint) busy_ms,
  cast(coalesce(sum(case when span = 'gap' then to_ms - from_ms end), 0) as bigint) idle_ms, count(*) filter (span = 'period') periods from s group by run_id, pe, rank""",
}
