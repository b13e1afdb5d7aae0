"""Lineage of a whole workflow run: records and derivations of every node's output, beside its data.

Every row carries the id of its datum in a hidden column ``_prov_id`` (any column
whose name starts with ``_prov`` is hidden). A node that works row by row hands the
column on, as all nodes of :mod:`operators.basic` do; a node of several inputs may
hand on one such column from each, and its output then derives from all of them. A
node that drops them, as an aggregation does, says in ``Node.derives`` by which
columns its output belongs to its inputs; derivations are then rows of a join on
these columns, never lists gathered for a key. An empty list stands for one output
row that derives from all inputs; None for an output of unknown origin.

An id is the node's port and a hash of the parents' ids and the row, so equal rows
of equal origin are one datum. Where the rules of the run drop a record, its data
go on under the first parent's id, and what derives from them is marked incomplete.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.basic import HIDDEN, hidden, visible
from .records import LineageConfig
from .rules import keeps_map

RECORDS = "name string, port string, prov_cluster string, runId string, username string, id string, content map<string,string>, size bigint, incomplete boolean, initial boolean"
DERIVATIONS = "name string, port string, id string, derived_from string"


@dataclass
class Captured:
    """Outputs of a graph by (node, port), without hidden columns, and the lineage of all its nodes."""

    outputs: dict
    records: DataFrame
    derivations: DataFrame


def _content(df: DataFrame):
    pairs = [c for name in visible(df) for c in (F.lit(name), F.col(name).cast("string"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def capture(graph, cfg: LineageConfig, inputs: dict | None = None) -> Captured:
    """Compile ``graph`` with lineage; nothing runs until a result is asked for."""
    records: list[DataFrame] = []
    derivations: list[DataFrame] = []

    def around(node, given: dict) -> dict:
        given = {p: df if hidden(df) else df.withColumn(HIDDEN, F.concat(F.lit(f"{node.name}.{p}<"), F.sha2(F.to_json(F.struct(*df.columns)) if df.columns else F.lit(""), 256))).withColumn("_prov_partial", F.lit(False)) for p, df in given.items()}
        made = node(given)
        return {p: _record(node, p, df, given) for p, df in made.items()}

    def _record(node, port: str, df: DataFrame, given: dict) -> DataFrame:
        parents = [c for c in hidden(df) if not c.startswith("_prov_partial")]
        partial = reduce(lambda a, b: a | b, (F.coalesce(F.col(c), F.lit(False)) for c in hidden(df) if c.startswith("_prov_partial")), F.lit(False))
        content = _content(df)
        own = F.concat(F.lit(f"{node.name}.{port}:"), F.sha2(F.concat_ws("|", *parents, F.to_json(content)), 256))
        rules = cfg.rules.get(node.name, {}).get("rules", {})
        keep = F.coalesce(keeps_map(content, rules), F.lit(False)) if rules else F.lit(True)
        at = df.withColumns({"_prov_new": own, "_prov_keep": keep, "_prov_part": partial})
        cluster = cfg.clusters.get(node.name, node.name)
        kept = at.where("_prov_keep")
        records.append(
            kept.select(
                F.lit(node.name).alias("name"), F.lit(port).alias("port"), F.lit(cluster).alias("prov_cluster"), F.lit(cfg.run_id).alias("runId"), F.lit(cfg.user).alias("username"),
                F.col("_prov_new").alias("id"), content.alias("content"), F.octet_length(F.to_json(content)).cast("bigint").alias("size"), F.col("_prov_part").alias("incomplete"),
                F.lit(not parents and node.derives is None).alias("initial"),
            )
        )
        if parents:
            links = kept.select(F.col("_prov_new").alias("id"), F.explode(F.array(*parents)).alias("derived_from"))
        elif node.derives is not None and given:
            ins = [i.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(node.derives)), F.col(HIDDEN).alias("derived_from")) for i in given.values() if HIDDEN in i.columns]
            ins = reduce(DataFrame.unionByName, ins).distinct()
            outs = kept.select("_prov_new", *node.derives)
            same = [ins[f"_k{n}"].eqNullSafe(outs[k]) for n, k in enumerate(node.derives)]
            # without columns the output is one row
            links = (ins.join(outs, same) if same else ins.join(F.broadcast(outs))).select(F.col("_prov_new").alias("id"), "derived_from")
        else:
            links = None
        if links is not None:
            derivations.append(links.where("derived_from is not null").select(F.lit(node.name).alias("name"), F.lit(port).alias("port"), "id", "derived_from").distinct())
        first = F.coalesce(*parents, F.col("_prov_new")) if parents else F.col("_prov_new")
        return at.select(*visible(df), F.when(F.col("_prov_keep"), F.col("_prov_new")).otherwise(first).alias(HIDDEN), (~F.col("_prov_keep")).alias("_prov_partial"))

    out = graph.compile(inputs, around=around)
    spark = next(iter(out.values())).sparkSession
    none = lambda kind: spark.createDataFrame([], kind)
    return Captured(
        {k: df.drop(*hidden(df)) for k, df in out.items()},
        reduce(DataFrame.unionByName, records) if records else none(RECORDS),
        reduce(DataFrame.unionByName, derivations) if derivations else none(DERIVATIONS),
    )


def recorders(captured: Captured, sinks: dict, default=None) -> None:
    """Hand the records of each provenance cluster to its own sink, a function of a DataFrame; the rest to ``default``."""
    for cluster, sink in sinks.items():
        sink(captured.records.where(F.col("prov_cluster") == cluster))
    if default is not None:
        default(captured.records.where(~F.col("prov_cluster").isin(*sinks)) if sinks else captured.records)


def discard_in_flow(derivations: DataFrame, order: str, width: int, by: list[str]) -> DataFrame:
    """Only the newest ``width`` derivations of each datum (``by``), by the order of the inputs; state derivations (``lookupterm``) are kept."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.desc(order))
    ranked = derivations.withColumn("_n", F.sum(F.col("lookupterm").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where(F.col("lookupterm").isNotNull() | (F.col("_n") <= width)).drop("_n")


def discard_state(derivations: DataFrame, keep_newest: bool = True, by: list[str] = ("id",), order: str = "at") -> DataFrame:
    """Derivations without those from state; with ``keep_newest`` the latest state of each datum stays."""
    if not keep_newest:
        return derivations.where("lookupterm is null")
    newest = derivations.where("lookupterm is not null").groupBy(*by).agg(F.max(order).alias("_at"))
    met = derivations.join(newest.withColumnsRenamed({k: f"_{k}" for k in by}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by], "left")
    return met.where(F.col("lookupterm").isNull() | (F.col(order) == F.col("_at"))).drop("_at", *(f"_{k}" for k in by))
