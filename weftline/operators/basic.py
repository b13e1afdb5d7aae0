"""Sources, maps, filters, flat-maps, splits, tees and merges as graph nodes.

Bodies are Column expressions wherever the semantics allow, so that a chain of
nodes becomes one projection; :func:`python_node` and :func:`python_map` take
opaque Python functions, in Arrow batches. A null result of a mapped function
drops the row (nothing is emitted); falsy values are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from time import perf_counter, sleep

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.graph import Graph, Node


#: Column with a datum's id in a run with lineage; columns whose names start so are handed on unseen.
HIDDEN = "_prov_id"


def hidden(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_prov")]


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_prov")]


def source(name: str, make: Callable[[], DataFrame]) -> Node:
    return Node(name, lambda _: make(), inputs=())


def iterations(spark: SparkSession, n: int, column: str = "n") -> DataFrame:
    """1..n, a counter's values over n calls."""
    return spark.range(n).select((F.col("id") + 1).alias(column))


def integer_range(spark: SparkSession, start: int, limit: int, column: str = "n") -> DataFrame:
    """Half-open range."""
    return spark.range(start, limit).withColumnRenamed("id", column)


def labelled_numbers(spark: SparkSession, calls: int, per_call: int, column: str = "v") -> DataFrame:
    """Strings "k:i": for each call k from 1 the numbers i from 0."""
    each = F.explode(F.sequence(F.lit(0), F.lit(per_call - 1))) if per_call > 0 else F.explode(F.array().cast("array<int>"))
    return spark.range(1, calls + 1).select("id", each.alias("i")).select(F.concat_ws(":", F.col("id").cast("string"), F.col("i").cast("string")).alias(column))


def random_words(spark: SparkSession, n: int, words: list[str], seed: int = 0) -> DataFrame:
    """n seeded, evenly drawn words with a sequence number."""
    pick = (F.floor(F.rand(seed) * len(words)) + 1).cast("int")
    return spark.range(n).select(F.col("id").alias("seq"), F.element_at(F.array(*map(F.lit, words)), pick).alias("word"))


def uniform_values(spark: SparkSession, name: str, n: int, top: float = 100.0, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.lit(name).alias("src"), F.col("id").alias("seq"), (F.rand(seed) * top).alias("val"))


def descending(spark: SparkSession, start: int, step: int = 5) -> DataFrame:
    """start, start - step, ... while positive."""
    return spark.range(max(0, -(-start // step))).select((F.lit(start) - F.col("id") * step).alias("n"))


def map_node(name: str, *cols: str | Column, keep: bool = False) -> Node:
    def run(p):
        df = p["input"]
        return df.select("*", *cols) if keep else df.select(*cols, *hidden(df))

    return Node(name, run)


def filter_node(name: str, condition: Column) -> Node:
    return Node(name, lambda p: p["input"].where(condition))


def divisible(column: str, divisor: int, keep_multiples: bool = True) -> Column:
    """Both readings of the divisor filter; no row passes a divisor of 0."""
    rest = F.try_mod(F.col(column), F.lit(divisor))
    return rest == 0 if keep_multiples else rest != 0


def bernoulli(name: str, share: float = 0.5, seed: int = 0) -> Node:
    return Node(name, lambda p: p["input"].sample(False, share, seed))


def emit_range(name: str, n: int, column: str = "i") -> Node:
    """Every row gives n rows, numbered from 0."""
    return Node(name, lambda p: p["input"].select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(column)))


def split_node(name: str, conditions: dict[str, Column]) -> Node:
    """One output port for each condition."""
    return Node(name, lambda p: {port: p["input"].where(c) for port, c in conditions.items()}, outputs=tuple(conditions))


def merge_node(name: str, columns: dict[str, Column | str], output: str = "v") -> Node:
    """All inputs' values as text in one stream: arrivals are merged, not joined."""

    def run(p):
        out = None
        for port, df in p.items():
            c = columns[port]
            one = df.select((F.col(c) if isinstance(c, str) else c).cast("string").alias(output), *hidden(df))
            out = one if out is None else out.unionByName(one)
        return out

    return Node(name, run, inputs=tuple(columns))


def identity(name: str) -> Node:
    return Node(name, lambda p: p["input"])


def delay(name: str, seconds: float) -> Node:
    """Identity that sleeps for each row, to have something to time."""

    def run(p):
        def batches(it):
            for b in it:
                sleep(seconds * b.num_rows)
                yield b

        return p["input"].mapInArrow(batches, p["input"].schema)

    return Node(name, run)


def analysis(name: str, column: str, order: list[str]) -> Node:
    """Identity with a running index, from 0, as metadata column."""
    from .ordered import with_position

    return Node(name, lambda p: with_position(p["input"], order, column)[0])


def sink(name: str, write: Callable[[DataFrame], None]) -> Node:
    """A consumer: hands its input to ``write`` and has no output."""

    def run(p):
        write(p["input"])
        return {}

    return Node(name, run, outputs=())


def project(name: str, ports: dict[str, str]) -> Node:
    """Keep and rename ports: {port in: port out}."""
    return Node(name, lambda p: {ports[k]: v for k, v in p.items() if k in ports}, inputs=tuple(ports), outputs=tuple(ports.values()))


def expression_chain(column: str, steps: list, name_prefix: str = "step", name_suffix: str = "") -> Graph:
    """A chain of nodes, each replacing ``column`` by step(column, **params); null results are dropped.

    ``steps`` are functions of a Column, or (function, params) pairs.
    """
    g = Graph(name_prefix)
    last = None
    for i, s in enumerate(steps):
        fn, params = s if isinstance(s, tuple) else (s, {})

        def run(p, fn=fn, params=params):
            return p["input"].withColumn(column, fn(F.col(column), **params)).where(F.col(column).isNotNull())

        n = g.add(Node(f"{name_prefix}{i}{name_suffix}", run))
        if last is not None:
            g.connect(last, "output", n, "input")
        last = n
    return g


def python_map(name: str, fn: Callable, column: str, returns: str) -> Node:
    """Scalar Python function over one column, in Arrow batches; None drops the row."""

    def run(p):
        @F.pandas_udf(returns)
        def each(s: pd.Series) -> pd.Series:
            return s.map(fn)

        return p["input"].withColumn(column, each(F.col(column))).where(F.col(column).isNotNull())

    return Node(name, run)


def python_node(name: str, make: Callable[[], object], schema: str) -> Node:
    """An opaque node: ``make`` gives an object with process(row dict) -> iterable of dicts or None,
    and optionally preprocess() and postprocess() -> iterable; one object for each partition."""

    def run(p):
        def batches(it):
            pe = make()
            if hasattr(pe, "preprocess"):
                pe.preprocess()
            names = [f.split()[0] for f in schema.split(",")]
            for b in it:
                rows = [r for x in b.to_dict("records") for r in (pe.process(x) or ())]
                yield pd.DataFrame(rows, columns=names)
            if hasattr(pe, "postprocess"):
                yield pd.DataFrame(list(pe.postprocess() or ()), columns=names)

        return p["input"].mapInPandas(batches, schema)

    return Node(name, run)


def ports_node(name: str, make: Callable[[], object], inputs: list[str], outputs: dict[str, str], keys: dict[str, list[str]] | None = None, order: dict[str, str] | None = None, timed: bool = False) -> Node:
    """An opaque node of several inputs and outputs, with state.

    ``make`` gives an object with process(port, row dict) -> iterable of (port, dict)
    or None, and optionally preprocess() and postprocess() -> such pairs. With
    ``keys`` (columns of each input, as many for all) rows of equal keys meet one
    object, made for that key and ended after its last row; else there is one for
    each partition. ``order`` names each input's column that the rows, of all inputs
    together, are taken in; equal ones go by the inputs' names. ``outputs`` are
    schemas by port. With ``timed`` a further port ``timing`` has a row of seconds
    for each call: (pe_id, rank, instance_id, iteration_index, iteration_secs).

    Python runs for every row, in Arrow batches: for what Columns cannot say. A key's
    rows are in one task, in order, but never all in memory.
    """
    ports = dict(outputs) | ({"timing": "pe_id string, rank int, instance_id string, iteration_index bigint, iteration_secs double"} if timed else {})

    def run(p: dict[str, DataFrame]) -> dict[str, DataFrame]:
        depth = len(next(iter(keys.values()))) if keys else 0
        kinds = {q: p[q].select(*visible(p[q])).schema.simpleString() for q in inputs if q in p}
        whole = None
        for q in kinds:
            cols = [F.lit(q).alias("_port"), *(F.col(keys[q][i]).cast("string").alias(f"_k{i}") for i in range(depth)), (F.col(order[q]) if order else F.lit(0)).cast("double" if order is None else p[q].schema[order[q]].dataType).alias("_o")]
            one = p[q].select(*cols, *(F.struct(*visible(p[q])).alias(f"in_{r}") if r == q else F.lit(None).cast(k).alias(f"in_{r}") for r, k in kinds.items()))
            whole = one if whole is None else whole.unionByName(one)
        ks = [f"_k{i}" for i in range(depth)]
        if ks:
            whole = whole.repartition(*ks)
        if ks or order:
            whole = whole.sortWithinPartitions(*ks, *(["_o", "_port"] if order else []))
        schema = "_out string, " + ", ".join(f"out_{q} struct<{_fields(k)}>" for q, k in ports.items())
        kind = to_arrow_schema(whole.sparkSession.createDataFrame([], schema).schema)

        def batches(it):
            from pyspark import TaskContext

            rank = TaskContext.get().partitionId() if TaskContext.get() else 0
            pe, last, out, calls = None, None, [], 0

            def take(made):
                out.extend({"_out": q, f"out_{q}": row} for q, row in made or ())

            def end():
                if pe is not None and hasattr(pe, "postprocess"):
                    take(pe.postprocess())

            for b in it:
                for x in b.to_pylist():
                    key = tuple(x[k] for k in ks)
                    if pe is None or key != last:
                        end()
                        pe, last = make(), key
                        if hasattr(pe, "preprocess"):
                            pe.preprocess()
                    t = perf_counter()
                    take(pe.process(x["_port"], x["in_" + x["_port"]]))
                    if timed:
                        calls += 1
                        take([("timing", {"pe_id": name, "rank": rank, "instance_id": f"{name}@{rank}", "iteration_index": calls, "iteration_secs": perf_counter() - t})])
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out.clear()
            end()
            yield pa.RecordBatch.from_pylist(out, schema=kind)

        made = whole.mapInArrow(batches, schema)
        return {q: made.where(F.col("_out") == q).select(f"out_{q}.*") for q in ports}

    return Node(name, run, inputs=tuple(inputs), outputs=tuple(ports))


def _fields(schema: str) -> str:
    """Column definitions as the inside of a struct type."""
    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def words(df: DataFrame, text: str, column: str = "w") -> DataFrame:
    """Words between blanks, one row each; an empty or blank text gives one empty word, a null text none."""
    return df.select(F.explode(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")).alias(column))


def chunk(df: DataFrame, order: list[str], chunks: int, column: str = "chunk") -> DataFrame:
    """Rows in order, cut into chunks of ceil(count / chunks).

    Positions come from per-partition counts of a range-sorted table, so no task
    sees all rows.
    """
    from .ordered import with_position

    placed, total = with_position(df, order)
    return placed.withColumn(column, F.floor(F.col("pos") / F.ceil(F.lit(total) / F.lit(float(chunks)))).cast("bigint"))
