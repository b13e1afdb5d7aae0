"""The workflow engine's own query catalogue and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import patterns, prov, records, rules
from .lineage.capture import capture
from .monitor import timing
from .operators import aggregates as agg
from .operators import basic, combine, routing
from .plans.graph import Graph, Node
from .problems import NODES_SQL
from .session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


def _type(e: DataFrame, t: str) -> DataFrame:
    return e.where(F.col("event_type") == t)


def _graph(source: DataFrame, *nodes: Node) -> DataFrame:
    """Result of a linear graph fed with a table."""
    start = basic.source("source", lambda: source)
    g = Graph().chain(start, *nodes)
    return next(iter(g.compile().values()))


@query("select range+1 as n from range(100)")
def src_iterations(s, d):
    return basic.iterations(s, 100)


@query("select concat(a.range+1,':',b.range) v from range(5) a cross join range(10) b")
def src_number_producer(s, d):
    return basic.labelled_numbers(s, 5, 10)


@query("select event_id, unnest(range(10)) i from events")
def flatmap_multi_producer(s, d):
    return _graph(_events(s, d), basic.emit_range("emit", 10)).select("event_id", "i")


@query("select * from events")
def map_identity(s, d):
    return _graph(_events(s, d), basic.identity("one_in_one_out"))


@query("select event_id, (4*(2+value))/2-1 v from events")
def map_function_chain(s, d):
    steps = [(lambda x, by: x + by, {"by": 2}), (lambda x, by: x * by, {"by": 4}), lambda x: x / 2, lambda x: x - 1]
    chain = basic.expression_chain("v", steps)
    return next(iter(chain.compile({"step0": _events(s, d).select("event_id", F.col("value").alias("v"))}).values()))


@query("select event_id from events where event_id % 3 = 0")
def filter_divisible(s, d):
    return _graph(_events(s, d), basic.filter_node("keep", basic.divisible("event_id", 3))).select("event_id")


@query("select event_id from events where event_id % 3 <> 0")
def filter_not_divisible(s, d):
    return _graph(_events(s, d), basic.filter_node("keep", basic.divisible("event_id", 3, False))).select("event_id")


@query("select event_type, count(*) n from events where value > 50 group by event_type")
def filter_then_count(s, d):
    count = Node("count", lambda p: agg.one_shot(p["input"], {"n": agg.count()}, ["event_type"]))
    return _graph(_events(s, d), basic.filter_node("filter", F.col("value") > 50), count)


@query("select 'a' port, event_id from events union all select 'b', event_id from events")
def tee_copy(s, d):
    g = Graph()
    src = basic.source("source", lambda: _events(s, d).select("event_id"))
    for port in "ab":
        g.connect(src, "output", basic.map_node(port, F.lit(port).alias("port"), "event_id"), "input")
    a, b = g.compile().values()
    return a.unionByName(b)


@query("select case when event_id%2=0 then 'output0' else 'output1' end port, event_id from events")
def split_ports(s, d):
    g = Graph()
    src = basic.source("source", lambda: _events(s, d).select("event_id"))
    split = basic.split_node("split", {"output0": F.col("event_id") % 2 == 0, "output1": F.col("event_id") % 2 != 0})
    g.connect(src, "output", split, "input")
    ports = g.compile()
    return ports["split", "output0"].select(F.lit("output0").alias("port"), "event_id").unionByName(ports["split", "output1"].select(F.lit("output1").alias("port"), "event_id"))


@query("select cast(user_id as varchar) v from events union all select event_type from events")
def merge_union_str(s, d):
    g = Graph()
    src = basic.source("source", lambda: _events(s, d))
    merge = basic.merge_node("two_in_one_out", {"input0": "user_id", "input1": "event_type"})
    g.connect(src, "output", merge, "input0")
    g.connect(src, "output", merge, "input1")
    return next(iter(g.compile().values()))


@query("select count(*) n, count(distinct user_id) u from events")
def group_alltoone(s, d):
    return agg.one_shot(_events(s, d), {"n": agg.count(), "u": F.count_distinct("user_id")})


@query("select i.range inst, e.event_id from events e cross join range(3) i")
def group_onetoall(s, d):
    return routing.one_to_all(_events(s, d).select("event_id"), 3)


@query("select event_type, user_id, count(*) n from events group by event_type, user_id")
def group_by_count(s, d):
    return agg.one_shot(_events(s, d), {"n": agg.count()}, ["event_type", "user_id"])


@query("select event_type, event_id, count(*) over(partition by event_type order by ts,event_id rows between unbounded preceding and current row) n from events")
def running_word_count(s, d):
    run = Node("counter", lambda p: agg.continuous(p["input"], ["ts", "event_id"], {"n": ("count", "event_id")}, ["event_type"]))
    return _graph(_events(s, d).select("event_type", "ts", "event_id"), run).select("event_type", "event_id", "n")


@query(r"select w, count(*) n from (select unnest(string_split(trim(regexp_replace(text,'\s+',' ','g')),' ')) w from documents) group by w")
def word_count_documents(s, d):
    split = Node("words", lambda p: basic.words(p["input"], "text"))
    return _graph(table(s, d, "documents"), split, Node("count", lambda p: agg.one_shot(p["input"], {"n": agg.count()}, ["w"])))


@query("select count(*) n from lineitem")
def agg_count(s, d):
    return agg.one_shot(table(s, d, "lineitem"), {"n": agg.count()})


@query("select round(coalesce(sum(l_quantity),0),2) s from lineitem")
def agg_sum(s, d):
    return agg.one_shot(table(s, d, "lineitem"), {"s": F.round(agg.total("l_quantity"), 2)})


@query("select min(l_extendedprice) m from lineitem")
def agg_min(s, d):
    return agg.one_shot(table(s, d, "lineitem"), {"m": agg.smallest("l_extendedprice")})


@query("select greatest(0.0, max(-l_quantity)) m from lineitem")
def agg_max_floor0(s, d):
    return agg.one_shot(table(s, d, "lineitem").select((-F.col("l_quantity")).alias("x")), {"m": agg.largest("x", True)})


@query("select round(avg(l_quantity),6) a, count(l_quantity) n, round(sum(l_quantity),2) s from lineitem")
def agg_avg_triple(s, d):
    x = agg.average_row(table(s, d, "lineitem"), "l_quantity")
    return x.select(F.round("avg", 6).alias("a"), F.col("count").alias("n"), F.round("sum", 2).alias("s"))


@query("select round(stddev_samp(l_quantity),6) sd, count(*) n, round(sum(l_quantity),2) s, round(sum(l_quantity*l_quantity),2) ss from lineitem")
def agg_stddev_quad(s, d):
    x = agg.deviation_row(table(s, d, "lineitem"), "l_quantity")
    return x.select(F.round("stddev", 6).alias("sd"), F.col("count").alias("n"), F.round("sum", 2).alias("s"), F.round("squares", 2).alias("ss"))


@query("select round(sum(s)/sum(n),6) a, cast(sum(n) as bigint) n, round(sum(s),2) s from (select l_suppkey k, sum(l_quantity) s, count(*) n from lineitem group by l_suppkey) t")
def agg_partial_final_avg(s, d):
    parts = agg.partial(table(s, d, "lineitem"), "l_quantity", ["l_suppkey"])
    return agg.final(agg.merge(parts)).select(F.round("avg", 6).alias("a"), F.col("count").alias("n"), F.round("sum", 2).alias("s"))


@query(
    "select count(l_extendedprice) n, round(stddev_samp(l_extendedprice),6) sd, min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem"
)
def agg_parallel_std_dev_min_max(s, d):
    """Through states of each supplier, merged."""
    x = agg.final(agg.merge(agg.partial(table(s, d, "lineitem"), "l_extendedprice", ["l_suppkey"])))
    return x.select(F.col("count").alias("n"), F.round("stddev", 6).alias("sd"), F.col("min").alias("lo"), F.col("max").alias("hi"))


@query(
    "select l_returnflag, count(l_tax) n, round(sum(l_tax),4) s, round(stddev_samp(l_tax + 1e6),6) sd, min(l_tax + 1e6) lo, max(l_tax + 1e6) hi from lineitem group by l_returnflag"
)
def agg_parallel_grouped(s, d):
    """States of (flag, supplier) merged by flag, of values far from 0 with a small spread."""
    t = table(s, d, "lineitem").withColumn("far", F.col("l_tax") + 1e6)
    x = agg.final(agg.merge(agg.partial(t, "far", ["l_returnflag", "l_suppkey"]), ["l_returnflag"]), "l_returnflag")
    tax = agg.final(agg.merge(agg.partial(t, "l_tax", ["l_returnflag", "l_suppkey"]), ["l_returnflag"]), "l_returnflag").select("l_returnflag", F.round("sum", 4).alias("s"))
    return x.join(tax, "l_returnflag").select("l_returnflag", F.col("count").alias("n"), "s", F.round("stddev", 6).alias("sd"), F.col("min").alias("lo"), F.col("max").alias("hi"))


@query("select l_returnflag, l_linestatus, round(avg(l_quantity),6) a, count(*) n from lineitem group by l_returnflag, l_linestatus")
def agg_grouped_avg(s, d):
    x = agg.average_row(table(s, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"])
    return x.select("l_returnflag", "l_linestatus", F.round("avg", 6).alias("a"), F.col("count").alias("n"))


@query("select event_id, round(sum(value) over(order by event_id rows between unbounded preceding and current row),4) s from events")
def continuous_sum(s, d):
    x = agg.continuous(_events(s, d).select("event_id", "value"), ["event_id"], {"s": ("sum", "value")})
    return x.select("event_id", F.round("s", 4).alias("s"))


@query("select a.n_nationkey x, b.r_regionkey y from nation a cross join region b")
def join_cross_product(s, d):
    return combine.cross_product(table(s, d, "nation").select(F.col("n_nationkey").alias("x")), table(s, d, "region").select(F.col("r_regionkey").alias("y")))


@query("select a.n_nationkey x, b.r_regionkey y, cast(a.n_nationkey as double)/nullif(b.r_regionkey,0) q from nation a cross join region b where b.r_regionkey<>0")
def join_div(s, d):
    return join_cross_product(s, d).withColumn("q", combine.ratio(F.col("x"), F.col("y"))).where("q is not null")


@query(
    "with a as (select user_id, value v, row_number() over(partition by user_id order by event_id) rn from events where event_type='click'), "
    "b as (select user_id, value v, row_number() over(partition by user_id order by event_id) rn from events where event_type='view') "
    "select a.user_id, a.rn, a.v lv, b.v rv from a join b on a.user_id=b.user_id and a.rn=b.rn"
)
def join_lockstep_zip(s, d):
    e = _events(s, d)
    return combine.zip_join(_type(e, "click"), _type(e, "view"), ["event_id"], ["user_id"], {"lv": "value"}, {"rv": "value"})


@query(
    "with a as (select event_type, value v, row_number() over(partition by event_type order by event_id) rn from events where event_type in ('click','view','error')) "
    "select rn, round(sum(v),4) s, count(*) k from a group by rn having count(*)=3"
)
def merge_barrier(s, d):
    fold = {"s": lambda v: F.round(F.sum(v), 4), "k": lambda v: F.count(F.lit(1))}
    return combine.barrier(_events(s, d), "event_type", ["click", "view", "error"], ["event_id"], F.col("value"), fold)


@query(
    "with a as (select value v, row_number() over(order by event_id)-1 r from events where event_type='click'), b as (select value v, row_number() over(order by event_id)-1 r from events where event_type='view') "
    "select cast(floor(a.r/20) as bigint) batch, round(corr(a.v,b.v),6) rho from a join b on a.r=b.r group by 1 having count(*)=20"
)
def corr_batched(s, d):
    e = _events(s, d)
    x = combine.batched_correlation(_type(e, "click"), _type(e, "view"), ["event_id"], "value", 20)
    return x.select("batch", F.round("rho", 6).alias("rho"))


@query(
    "with a as (select event_type t, value v, row_number() over(partition by event_type order by event_id)-1 r from events), "
    "p as (select x.t i, y.t j, cast(floor(x.r/50) as bigint) batch, corr(x.v,y.v) rho from a x join a y on x.r=y.r and x.t<y.t group by 1,2,3 having count(*)=50), "
    "f as (select batch from p group by batch having count(*)=10) select p.batch, p.i, p.j, round(p.rho,6) rho from p join f on p.batch=f.batch"
)
def corr_matrix(s, d):
    cells = combine.complete_matrices(combine.correlations(_events(s, d), "event_type", ["event_id"], "value", 50), 5)
    return cells.select("batch", "i", "j", F.round("rho", 6).alias("rho"))


@query(
    "with a as (select event_type t, value v, row_number() over(partition by event_type order by event_id)-1 r from events), "
    "p as (select x.t i, y.t j, corr(x.v,y.v) rho from a x join a y on x.r=y.r and x.t<y.t group by 1,2) select i,j, case when rho < -0.01 then 0.0::double else round(rho,6) end w from p"
)
def threshold_graph(s, d):
    cells = combine.threshold(combine.correlations(_events(s, d), "event_type", ["event_id"], "value"), -0.01)
    return cells.select("i", "j", F.round("rho", 6).alias("w"))


@query("select event_id, count(*) over w n, min(event_id) over w lo from events window w as (partition by user_id order by event_id rows between 2 preceding and current row)")
def lineage_slide_window(s, d):
    x = patterns.slide(_events(s, d), ["user_id"], ["event_id"], "event_id", 3)
    return x.select("event_id", F.size("derived_from").cast("bigint").alias("n"), F.array_min("derived_from").alias("lo"))


@query(
    "with f as (select event_id, user_id, case when event_type='purchase' then 1 else 0 end e from events), "
    "g as (select *, coalesce(sum(e) over(partition by user_id order by event_id rows between unbounded preceding and 1 preceding),0) grp from f) "
    "select user_id, cast(grp as bigint) grp, count(*) n, min(event_id) lo, max(event_id) hi from g group by user_id, grp having max(e)=1"
)
def lineage_accumulate(s, d):
    return patterns.accumulate(_events(s, d), ["user_id"], ["event_id"], "event_id", F.col("event_type") == "purchase")


@query("select event_id from events where value = 6.55 or (value > 20 and value < 60)")
def lineage_selective_rule(s, d):
    e = _events(s, d)
    either = rules.keeps({"value": e["value"]}, {"value": {"$eq": 6.55}}) | rules.keeps({"value": e["value"]}, {"value": {"$gt": 20, "$lt": 60}})
    return e.where(either).select("event_id")


@query("select user_id, min(ts) s, max(ts) e, count(distinct event_type) k from events group by user_id")
def prov_cluster_summary(s, d):
    return records.cluster_summary(_events(s, d), ["user_id"], "ts", "ts", {"k": F.count_distinct("event_type")})


@query("select user_id id, string_agg(distinct event_type, ';' order by event_type) types from events group by user_id")
def prov_unified(s, d):
    kind = F.struct(F.lit("type").alias("name"), F.lit(0).alias("no"), F.col("event_type").alias("value"), F.lit("string").alias("type"), F.lit(None).cast("string").alias("lang"))
    n = _events(s, d).select(F.col("user_id").alias("id"), F.array(kind).alias("attrs"))
    return prov.unified(n, ["id"]).select("id", F.array_join(F.transform("attrs", lambda a: a["value"]), ";").alias("types"))


@query("select event_id, (value > 100) as transfer from events")
def transfer_rule_flag(s, d):
    e = _events(s, d)
    return e.select("event_id", rules.transfers({"value": e["value"]}, {"value": {"$gt": 100}}).alias("transfer"))


@query(
    "select event_type pe_id, count(*) total_count, round(sum(value),4) total_secs, round(avg(value),6) avg_secs, min(value) min_secs, "
    "round(quantile_cont(value,0.5),6) p50_secs, round(quantile_cont(value,0.95),6) p95_secs, max(value) max_secs from events group by event_type"
)
def monitor_pe_latency(s, d):
    x = timing.latency(_events(s, d).withColumnRenamed("event_type", "pe_id"), ["pe_id"], "value")
    digits = {"total_secs": 4, "avg_secs": 6, "p50_secs": 6, "p95_secs": 6}
    return x.withColumns({k: F.round(k, n) for k, n in digits.items()})


@query(
    "select user_id, round(avg(d),3) avg_gap from (select user_id, (epoch_us(ts)-lag(epoch_us(ts)) over(partition by user_id order by event_id))/1e6 d from events) t where d is not null group by user_id"
)
def monitor_interarrival(s, d):
    return timing.interarrival(_events(s, d), ["user_id"], ["event_id"], "ts").select("user_id", F.round("avg_gap", 3).alias("avg_gap"))


@query(
    "with a as (select p_partkey, row_number() over(order by p_partkey)-1 pos, count(*) over() n from part) "
    "select cast(floor(pos/ceil(n/3.0)) as bigint) chunk, count(*) k, min(p_partkey) lo, max(p_partkey) hi from a group by 1"
)
def chunk_split(s, d):
    return basic.chunk(table(s, d, "part").select("p_partkey"), ["p_partkey"], 3).groupBy("chunk").agg(F.count(F.lit(1)).alias("k"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))


@query(
    "with w as (select event_id+1 did, ts t from events where event_type='click'), r as (select event_id did, ts t, user_id from events where event_type='view') "
    "select r.user_id, count(*) n, count(w.did) matched from r left join w on r.did=w.did group by r.user_id"
)
def comm_time_join(s, d):
    e = _events(s, d)
    w = _type(e, "click").select((F.col("event_id") + 1).alias("wdid"))
    r = _type(e, "view").select(F.col("event_id").alias("did"), "user_id")
    return r.join(w, F.col("did") == F.col("wdid"), "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("wdid").alias("matched"))


# the same operators on the workflow tables themselves


_IO = "nullif(regexp_extract(io_data, '''(d[0-9]+)''', 1), '')"


@query(
    f"with l as (select run_id, pe, method, t_start s, t_end e, {_IO} did from timing_log where run_id is not null and t_start is not null and t_end is not null), "
    "w as (select * from l where method = 'write' and did is not null), r as (select * from l where method = 'read' and did is not null), "
    "p as (select r.run_id, r.did, r.pe reader, w.pe writer, greatest(r.e, w.e) - greatest(r.s, w.s) t from r left join w on r.run_id = w.run_id and r.did = w.did), "
    "g as (select run_id, did, reader, writer, max(t) t from p group by all) "
    "select reader, writer, round(max(t), 3) longest_secs, count(*) n from g group by 1, 2"
)
def communication_log(s, d):
    """Longest time between write and read of a datum in a run, by writer and reader node."""
    log = table(s, d, "timing_log").withColumn("did", F.nullif(F.regexp_extract("io_data", r"'(d[0-9]+)'", 1), F.lit("")))
    x = combine.communication_time(log, start="t_start", end="t_end", data="did", within=["run_id"])
    return x.select("reader", "writer", F.round("seconds", 3).alias("longest_secs"), F.col("data").alias("n"))


@query(
    "with t as (select trim(pe_id) pe_id, rank, iteration_secs x from iteration_timing where iteration_secs is not null and not isnan(iteration_secs) and iteration_secs >= 0) "
    "select pe_id, cast(count(distinct rank) as integer) rank_count, coalesce(array_to_string(list_sort(list(distinct rank) filter (rank is not null)), ';'), '') ranks, count(*) total_count, round(sum(x), 3) total_secs, round(quantile_cont(x, 0.95), 9) p95_secs, max(x) max_secs from t group by pe_id"
)
def monitor_pe_summary(s, d):
    t = table(s, d, "iteration_timing").withColumn("pe_id", F.trim("pe_id")).where("iteration_secs is not null and not isnan(iteration_secs) and iteration_secs >= 0")
    x = timing.pe_summary(t)
    return x.select("pe_id", "rank_count", "ranks", "total_count", F.round("total_secs", 3).alias("total_secs"), F.round("p95_secs", 9).alias("p95_secs"), "max_secs")


@query(
    "with t as (select trim(pe_id) pe_id, rank, iteration_secs x from iteration_timing where iteration_secs is not null and not isnan(iteration_secs) and iteration_secs >= 0) "
    "select pe_id, rank, count(*) total_count, round(avg(x), 9) avg_secs, min(x) min_secs, round(quantile_cont(x, 0.5), 9) p50_secs, max(x) max_secs from t group by pe_id, rank"
)
def monitor_instance_summary(s, d):
    x = timing.instance_summary(table(s, d, "iteration_timing").withColumn("pe_id", F.trim("pe_id")))
    return x.select("pe_id", "rank", "total_count", F.round("avg_secs", 9).alias("avg_secs"), "min_secs", F.round("p50_secs", 9).alias("p50_secs"), "max_secs")


def _formal() -> str:
    """SQL rows (kind, pos, attr, node): formal attributes in order, and the kind of node the ends are."""
    rows = [(k, i + 1, a, "") for k, v in prov.ELEMENTS.items() for i, a in enumerate(v)]
    rows += [(k, i + 1, a, (x, y)[i] if i < 2 else "") for k, (v, x, y) in prov.RELATIONS.items() for i, a in enumerate(v)]
    return ", ".join(f"('{k}', {i}, '{a}', '{n}')" for k, i, a, n in rows)


_PROV_SQL = (
    NODES_SQL
    + f""", formal(kind, pos, attr, node) as (values {_formal()}),
verbs as (select distinct kind from formal where node <> ''),
rec as (select doc_id, variant, pre, bundle_id bundle, rec_type kind, name id from n where kind = 'record'),
att as (select doc_id, variant, rec_pre pre, name, no, value, value_type, lang from n where kind = 'attribute'),
held as (select distinct doc_id, variant, pre, name, value from att where value is not null),
edge as (select r.*, a.value src, b.value dst from rec r
  join formal f on f.kind = r.kind and f.pos = 1 and f.node <> '' join formal g on g.kind = r.kind and g.pos = 2
  left join held a on a.doc_id = r.doc_id and a.variant = r.variant and a.pre = r.pre and a.name = f.attr
  left join held b on b.doc_id = r.doc_id and b.variant = r.variant and b.pre = r.pre and b.name = g.attr),
elem as (select * from rec where kind in ('entity', 'activity', 'agent'))
"""
)


@query(_PROV_SQL + "select distinct cast(doc_id as varchar) doc, bundle, kind, id, src, dst from edge")
def prov_edges(s, d):
    return prov.from_payloads(table(s, d, "prov_json"), "prov_doc_id", "payload")[1].select("doc", "bundle", "kind", "id", "src", "dst").distinct()


@query(
    _PROV_SQL
    + """, quoted as (select *, '"' || replace(replace(replace(replace(coalesce(value, ''), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r') || '"' q from att),
spelt as (select *, case when lang is not null then q || '@' || lang when value_type in ('string', 'literal', 'null', 'json') then q
  else q || ' %% ' || case value_type when 'number' then case when contains(value, '.') or contains(value, 'e') then 'xsd:double' else 'xsd:int' end when 'boolean' then 'xsd:boolean' else value_type end end l from quoted),
extra as (select r.doc_id, r.variant, r.pre, ', [' || string_agg(l.name || '=' || l.l, ', ' order by l.name, l.no) || ']' x
  from rec r join spelt l on l.doc_id = r.doc_id and l.variant = r.variant and l.pre = r.pre
  where not exists (select 1 from formal f where f.kind = r.kind and f.attr = l.name) group by all),
args as (select r.doc_id, r.variant, r.pre, string_agg(', ' || coalesce(a.value, '-'), '' order by f.pos) g
  from rec r join formal f on f.kind = r.kind and (f.pos > 2 or r.kind not in (select kind from verbs))
  left join att a on a.doc_id = r.doc_id and a.variant = r.variant and a.pre = r.pre and a.name = f.attr and a.no = 0 group by all),
rows as (select doc_id, variant, pre, bundle, kind, id as head from elem
  union all select doc_id, variant, pre, bundle, kind, case when id like '\\_:%' escape '\\' then '' else id || '; ' end || coalesce(src, '-') || ', ' || coalesce(dst, '-') from edge)
select cast(r.doc_id as varchar) doc, bundle, kind || '(' || head || coalesce(g, '') || coalesce(x, '') || ')' line from rows r
  left join args a on a.doc_id = r.doc_id and a.variant = r.variant and a.pre = r.pre left join extra e on e.doc_id = r.doc_id and e.variant = r.variant and e.pre = r.pre"""
)
def prov_n_lines(s, d):
    return prov.prov_n(*prov.from_payloads(table(s, d, "prov_json"), "prov_doc_id", "payload"))


@query(
    _PROV_SQL
    + """, known as (select distinct doc_id, id, kind from elem),
implied as (select distinct e.doc_id, case f.pos when 1 then src else dst end id, f.node kind from edge e join formal f on f.kind = e.kind and f.node <> '')
select cast(doc_id as varchar) doc, id, kind, false inferred from known
union all select cast(doc_id as varchar), id, kind, true from implied i where id is not null and not exists (select 1 from known k where k.doc_id = i.doc_id and k.id = i.id)"""
)
def prov_property_graph(s, d):
    n, e = prov.from_payloads(table(s, d, "prov_json"), "prov_doc_id", "payload")
    return prov.property_graph(n, e)[0]


@query(
    "with w as (select event_id, value, list(event_id) over (partition by user_id order by event_id rows between 2 preceding and current row) l from events) "
    "select 'run_window_' || event_id _id, 'window_' || event_id iteration, 'window' as name, 'run' run, 'anonymous' username, 'lineage' as type, 'window' prov_cluster, "
    "array_to_string(l, ';') derived_from, cast(event_id as varchar) stream, 'output' as port, cast(value as varchar) as value, cast(length(cast(value as varchar)) as bigint) size "
    "from w where value > 20 and value < 60"
)
def lineage_records(s, d):
    """Lineage records of a sliding-window node, with a selectivity rule, laid out flat; ids are those of the events."""
    cfg = records.LineageConfig("wf", "sliding window", run_id="run", rules={"window": {"rules": {"value": {"$gt": 20, "$lt": 60}}}})
    x = patterns.slide(_events(s, d), ["user_id"], ["event_id"], "event_id", 3)
    meta = F.create_map(F.lit("value"), F.col("value").cast("string"))
    r = records.lineage_of(x, cfg, "window", "event_id", F.col("derived_from"), meta, size=F.octet_length(F.col("value").cast("string")))
    one = F.element_at("streams", 1)
    return r.select(
        "_id", F.col("iterationId").alias("iteration"), "name", F.col("runId").alias("run"), "username", "type", "prov_cluster",
        F.array_join(F.transform("derivationIds", lambda x: x["DerivedFromDatasetID"]), ";").alias("derived_from"),
        one["id"].alias("stream"), one["port"].alias("port"), F.element_at(one["content"], 1)["value"].alias("value"), one["size"].alias("size"),
    )


def _lineage_counts(graph, cfg=None):
    """Of each output of a graph run with lineage: records, distinct data, derivations, origins."""
    got = capture(graph, cfg or records.LineageConfig("wf", "graph", run_id="run"))
    n = got.records.groupBy("name", "port").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("id").alias("data"))
    up = got.derivations.groupBy(F.col("name").alias("_n"), F.col("port").alias("_p")).agg(F.count(F.lit(1)).alias("derivations"), F.count_distinct("derived_from").alias("origins"))
    both = n.join(up, (F.col("name") == F.col("_n")) & (F.col("port") == F.col("_p")), "left")
    return both.select("name", "port", "records", "data", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("derivations", "origins")))


@query(
    "with e as (select event_id, event_type, value from events), k as (select * from e where value > 50), "
    "t as (select 'source' as name, count(*) n, 0 d, 0 o from e union all select 'keep', count(*), count(*), count(*) from k "
    "union all select 'double', count(*), count(*), count(*) from k union all select 'count', count(distinct event_type), count(*), count(*) from k "
    "union all select 'whole', 1, count(distinct event_type), count(distinct event_type) from k) "
    "select name, 'output' as port, cast(n as bigint) records, cast(n as bigint) as data, cast(d as bigint) derivations, cast(o as bigint) origins from t"
)
def lineage_graph(s, d):
    """A filter, a map, a count by key and one over all, each deriving from what went in."""
    g = Graph().chain(
        basic.source("source", lambda: _events(s, d).select("event_id", "event_type", "value")),
        basic.filter_node("keep", F.col("value") > 50),
        basic.map_node("double", "event_id", "event_type", (F.col("value") * 2).alias("value")),
        Node("count", lambda p: agg.one_shot(p["input"], {"n": agg.count()}, ["event_type"]), derives=["event_type"]),
        Node("whole", lambda p: agg.one_shot(p["input"], {"n": agg.total("n")}), derives=[]),
    )
    return _lineage_counts(g)


def _nway(s, d):
    """A table cut in three, each part doubled by a node of its own, and merged."""
    g = Graph()
    cut = basic.chunk(table(s, d, "part").select("p_partkey"), ["p_partkey"], 3)
    split = basic.split_node("split", {f"output{i}": F.col("chunk") == i for i in range(3)})
    merge = basic.merge_node("merge", {f"input{i}": "v" for i in range(3)})
    g.connect(basic.source("source", lambda: cut), "output", split, "input")
    for i in range(3):
        twice = basic.map_node(f"double{i}", (F.col("p_partkey") * 2).alias("v"))
        g.connect(split, f"output{i}", twice, "input")
        g.connect(twice, "output", merge, f"input{i}")
    return g


@query("select cast(p_partkey * 2 as varchar) v from part")
def topology_nway_split_merge(s, d):
    return next(iter(_nway(s, d).compile().values()))


@query(
    "with a as (select p_partkey, row_number() over (order by p_partkey) - 1 pos, count(*) over () n from part), c as (select cast(floor(pos / ceil(n / 3.0)) as bigint) k from a), "
    "g as (select k, count(*) m from c group by k), "
    "t as (select 'source' as name, 'output' as port, count(*) n, 0 d from c union all select 'split', 'output' || k, m, m from g "
    "union all select 'double' || k, 'output', m, m from g union all select 'merge', 'output', count(*), count(*) from c) "
    "select name, port, cast(n as bigint) records, cast(n as bigint) as data, cast(d as bigint) derivations, cast(d as bigint) origins from t"
)
def lineage_nway_split_merge(s, d):
    return _lineage_counts(_nway(s, d))


@query(
    "with a as (select user_id, event_id, row_number() over (partition by user_id order by event_id) rn from events where event_type = 'click'), "
    "b as (select user_id, event_id, row_number() over (partition by user_id order by event_id) rn from events where event_type = 'view'), z as (select * from a join b using (user_id, rn)), "
    "t as (select 'left' as name, count(*) n, 0 d from a union all select 'right', count(*), 0 from b union all select 'zip', count(*), 2 * count(*) from z) "
    "select name, 'output' as port, cast(n as bigint) records, cast(n as bigint) as data, cast(d as bigint) derivations, cast(d as bigint) origins from t"
)
def lineage_two_source_zip(s, d):
    """Two sources in lock step; an output derives from one datum of each."""
    g = Graph()
    hide = lambda p: combine.zip_join(p["a"], p["b"], ["event_id"], ["user_id"], {"x": "event_id", "_prov_a": basic.HIDDEN}, {"y": "event_id", "_prov_b": basic.HIDDEN})
    z = Node("zip", hide, inputs=("a", "b"))
    for name, kind, port in (("left", "click", "a"), ("right", "view", "b")):
        g.connect(basic.source(name, lambda kind=kind: _type(_events(s, d), kind).select("user_id", "event_id")), "output", z, port)
    return _lineage_counts(g)


@query("select event_id from events")
def topology_explicit_partitions(s, d):
    """Nodes of three and of two instances, the second fed by key."""
    spread = Node("three", lambda p: p["input"], grouping={"input": "shuffle"}, instances=3)
    keyed = Node("two", lambda p: p["input"], grouping={"input": ["user_id"]}, instances=2)
    return _graph(_events(s, d), spread, keyed).select("event_id")


@query("select event_type, event_id, count(*) over (partition by event_type order by ts, event_id rows between unbounded preceding and current row) n from events where value > 50 or value <= 50")
def topology_split_merge_by_key(s, d):
    """Two filters of one source meet again in a counter by key."""
    g = Graph()
    src = basic.source("source", lambda: _events(s, d).select("event_type", "ts", "event_id", "value"))
    count = Node("counter", lambda p: agg.continuous(p["input"], ["ts", "event_id"], {"n": ("count", "event_id")}, ["event_type"]), grouping={"input": ["event_type"]}, instances=4)
    for name, keep in (("high", F.col("value") > 50), ("low", F.col("value") <= 50)):
        f = basic.filter_node(name, keep)
        g.connect(src, "output", f, "input")
        g.connect(f, "output", count, "input")
    return next(iter(g.compile().values())).select("event_type", "event_id", "n")


@query("select event_id from events")
def topology_delayed(s, d):
    return _graph(_events(s, d).select("event_id"), basic.delay("delay", 0.0), basic.identity("sink"))


class _ClicksSoFar:
    """Of each user's views: how many clicks came before, from two inputs; and at the end both counts."""

    def __init__(self):
        self.clicks = self.views = 0

    def process(self, port, row):
        if port == "clicks":
            self.clicks += 1
            return None
        self.views += 1
        return [("views", {"event_id": row["event_id"], "clicks": self.clicks})]

    def postprocess(self):
        return [("totals", {"clicks": self.clicks, "views": self.views})]


def _two_ports(s, d):
    node = basic.ports_node("so_far", _ClicksSoFar, ["clicks", "views"], {"views": "event_id bigint, clicks bigint", "totals": "clicks bigint, views bigint"}, {"clicks": ["user_id"], "views": ["user_id"]}, {"clicks": "event_id", "views": "event_id"})
    g = Graph()
    for port, kind in (("clicks", "click"), ("views", "view")):
        g.connect(basic.source(port, lambda kind=kind: _type(_events(s, d), kind).select("user_id", "event_id")), "output", node, port)
    return g.compile()


@query("select event_id, c clicks from (select *, count(*) filter (event_type = 'click') over (partition by user_id order by event_id) c from events) t where event_type = 'view'")
def python_ports_keyed_state(s, d):
    return _two_ports(s, d)["so_far", "views"]


@query("select count(*) filter (event_type = 'click') clicks, count(*) filter (event_type = 'view') as views from events where event_type in ('click', 'view') group by user_id")
def python_ports_flush(s, d):
    return _two_ports(s, d)["so_far", "totals"]
