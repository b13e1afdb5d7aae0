"""Queries of the corpus problems 2, 6, 7 and 8, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..session import table
from . import leakage, mixing, quantiles, spam, tokens

QS = [0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _timings(spark, d):
    t = table(spark, d, "iteration_timing")
    return t, {"pe_id": F.trim(t["pe_id"]), "rank": t["rank"]}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t, group = _timings(spark, d)
    p = quantiles.percentiles(t, group, "iteration_secs", [0.5, 0.99], nonnegative=True)
    both = p.groupBy("pe_id", "rank").agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("mid"), F.max(F.when(F.col("q") == 0.99, F.col("value"))).alias("high"))
    return both.where("high >= 20 * mid").select("pe_id", "rank")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    t, group = _timings(spark, d)
    p = quantiles.percentiles(t, group, "iteration_secs", QS, nonnegative=True)
    return p.select("pe_id", "rank", "n", "q", F.round("value", 9).alias("value"))


def p2_daily_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stored summaries of single days put together: median and 99th percentile within a relative 2**-16.

    Each day's histogram is written to a folder of its own; those of even and of odd
    days are read back as two tables, merged each for itself, and then with each other.
    """
    t, group = _timings(spark, d)
    day = F.coalesce(F.date_format("logged_at", "yyyyMMdd").cast("int"), F.lit(0))
    days = quantiles.digit_histogram(t, group | {"day": day}, "iteration_secs", nonnegative=True)
    path = Scratch(spark, "days").path("histograms")
    days.repartition("day").write.partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    parts = [quantiles.merge_histograms([stored.where(F.pmod("day", F.lit(2)) == k)], ["pe_id", "rank"]) for k in (0, 1)]
    whole = quantiles.merge_histograms(parts, ["pe_id", "rank"])
    p = quantiles.histogram_percentiles(whole, ["pe_id", "rank"], [0.5, 0.99])
    return p.select("pe_id", "rank", "n", "q", "lower", "upper")


def _leaks(f):
    def run(spark, d):
        return f(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")

    return run


p6_found = _leaks(leakage.shared_passages)


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items of each document: word for word in part, or reworded."""
    x = _leaks(leakage.leaks)(spark, d)
    kind = F.when(F.col("longest_run") >= leakage.RUN, "passage").otherwise("reworded")
    return x.select("doc_id", "item_id", kind.alias("kind"), "longest_run", "lcs", "item_words", "answer")


# fixed values: the top level of this project's source tree
DOMAINS = {
    "forge_main": "forges",
    "forge_mirror": "forges",
    "legacy_archive": "forges",
    "registry_tarballs": "packages",
    "snippets": "teaching",
    "course_repos": "teaching",
    "notebook_export": "teaching",
    "docs_sites": "documentation",
    "hardware_cores": "hardware",
    "firmware_dumps": "hardware",
}


def _mix(spark, d, total=None, factor=None):
    """Token table and leaves with budgets; ``factor``: a total as a multiple of the listed sources' tokens."""
    docs = table(spark, d, "documents")
    work = Scratch(spark, "mix")
    counted = tokens.token_counts(docs, "text", {"id": docs["doc_id"], "source": docs["source"], "lang": F.coalesce(docs["lang"], F.lit("unknown"))})
    held, _ = work.write(counted)
    sizes = held.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).limit(mixing.MAX_LEAVES + 1).collect()
    weights = table(spark, d, "source_weights").select("source", "target_share", "max_repeats").limit(mixing.MAX_LEAVES + 1).collect()
    if max(len(sizes), len(weights)) > mixing.MAX_LEAVES:
        raise ValueError("more leaves than MAX_LEAVES")
    leaves = mixing.weighted_leaves([tuple(r) for r in sizes], [tuple(r) for r in weights], DOMAINS)
    if factor is not None:
        total = int(factor * sum(x.tokens for x in leaves))
    return held, mixing.budgets(leaves, total), weights


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The largest mix in which every present source meets its share; one row per document."""
    held, leaves, _ = _mix(spark, d)
    return mixing.select(held, leaves).select(F.col("id").alias("doc_id"), "source", "lang", "n_tokens", "copies")


def _shares(factor=None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        held, leaves, weights = _mix(spark, d, factor=factor)
        used = mixing.select(held, leaves).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
        budget: dict = {}
        size: dict = {}
        for x in leaves:
            budget[x.path[-1]] = budget.get(x.path[-1], 0.0) + x.budget
            size[x.path[-1]] = size.get(x.path[-1], 0) + x.tokens
        plan = spark.createDataFrame(
            [(r["source"], r["target_share"], r["max_repeats"], size.get(r["source"], 0), float(budget.get(r["source"], 0.0))) for r in weights],
            "source string, target_share double, max_repeats int, tokens bigint, budget double",
        )
        whole = used.agg(F.sum("used").alias("whole"))
        return (
            plan.join(used, "source", "left")
            .join(F.broadcast(whole))  # one row
            .select(
                "source", "target_share", "max_repeats", "tokens", F.round("budget").cast("bigint").alias("budget"),
                *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("used", "documents", "most_copies")),
                F.round(F.coalesce("used", F.lit(0)) / F.col("whole"), 6).alias("actual_share"),
            )
        )

    return run


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"), "doc_id", "text", "repo").select(F.col("id").alias("doc_id"))


def _spam_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.scores(table(spark, d, "documents"), "doc_id", "text", "repo").withColumn("decided_by", spam.decided_by())


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _spam_scores(spark, d).select(
        F.col("id").alias("doc_id"), F.col("host").alias("repo"), "weak", F.round("own", 6).alias("own"), F.round("score", 6).alias("score"), "decided_by"
    )


def p8_decisions(spark: SparkSession, d: str) -> DataFrame:
    """How many pages a label, the trees and the hosts settled, either way."""
    return _spam_scores(spark, d).groupBy("decided_by", (F.col("score") >= spam.THRESHOLD).alias("spam")).agg(F.count(F.lit(1)).alias("pages"))


QUERIES = {
    "p2_found": p2_found,
    "p2_percentiles": p2_percentiles,
    "p2_daily_merge": p2_daily_merge,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p7_mix": p7_mix,
    "p7_shares": _shares(),
    "p7_shares_whole": _shares(1.0),
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_decisions": p8_decisions,
}

_CLEAN = """with t as (select trim(pe_id) pe_id, rank, iteration_secs x from iteration_timing
  where pe_id is not null and rank is not null and iteration_secs is not null and isfinite(iteration_secs) and iteration_secs >= 0) """

ORACLE = {
    "p2_found": _CLEAN + "select pe_id, rank from t group by pe_id, rank having quantile_cont(x, 0.99) >= 20 * quantile_cont(x, 0.5)",
    "p2_percentiles": _CLEAN
    + ", q as (select unnest([0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::double q, unnest([1, 2, 3, 4, 5, 6, 7]) i), "
    + "g as (select pe_id, rank, count(*) n, quantile_cont(x, [0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) v from t group by pe_id, rank) "
    + "select pe_id, rank, n, q.q, round(g.v[q.i], 9) as value from g cross join q",
    # a cell keeps 16 bits of the mantissa: the order statistic, cut to so many binary places
    "p2_daily_merge": _CLEAN
    + """, g as (select pe_id, rank, count(*) n, list_sort(list(x)) v from t group by pe_id, rank),
  q as (select unnest([0.5, 0.99])::double q),
  s as (select pe_id, rank, n, q, v[cast(floor((n - 1) * q) as bigint) + 1] a, v[cast(ceil((n - 1) * q) as bigint) + 1] z from g cross join q)
select pe_id, rank, n, q, case when a = 0 then 0.0 else floor(a * pow(2, 16 - floor(log2(a)))) * pow(2, floor(log2(a)) - 16) end as lower,
  case when z = 0 then 0.0 else floor(z * pow(2, 16 - floor(log2(z)))) * pow(2, floor(log2(z)) - 16) end as upper from s""",
    "p6_found": """
with d as (select doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) w from documents where text is not null and doc_id is not null),
  i as (select item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) w from eval_items where text is not null and item_id is not null),
  dw as (select doc_id, array_to_string(w[k:k + 19], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 18)) k from d where len(w) >= 20)),
  iw as (select item_id, array_to_string(w[k:k + 19], ' ') g from (select item_id, w, unnest(range(1, len(w) - 18)) k from i where len(w) >= 20))
select distinct doc_id, item_id from dw join iw on dw.g = iw.g""",
}
