"""Parent-child rows to full hierarchies, by bottom-up leaf peeling.

Every round peels the leaves *together with the unbranched runs that end in
them*, so a round removes at least half of the leaves' branch points and the
number of rounds follows the logarithm of the forest's size, not its depth: a
chain of a million links goes in one round. Runs are ranked by pointer doubling
over one-to-one links (a node's only child), so no join key is ever hot there;
where many runs meet one node, or many nodes one run, the key is salted (``HOT``).
A peeled run sends its subtree size to the node above it. What can never be
peeled is exactly the nodes on cycles. Reverse peel order then hands depth,
root and path down, from each node to the runs that hung below it.

Results, one row per node:

``node, parent, generated, top, steps, subtree_size[, path]``

* ``top`` is the root; for nodes that lead into a cycle the smallest name, in
  byte order, on that cycle, and then ``steps`` is -1 and ``path`` null.
* ``subtree_size`` counts the node and all its descendants; null on a cycle.
* ``generated`` is true for nodes that occur as a child.

Null and empty names (after trimming blanks) are no names; a row with only one
name still makes that name a node. Repeated edges count once. Should a child
have several parents, the smallest name is used, ``n_parents`` says so, and
:func:`other_parents` lists the links not taken. An empty table gives no rows. Columns other than the two named are ignored, so
their names can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch, rows

#: Joins per written step of the pointer jumping; a step multiplies reach by HOPS + 1.
HOPS = 3

#: So few nodes left are peeled to the end in one task, some megabytes whatever
#: their shape; more go on in rounds over all executors. Both give the same rows.
LOCAL_NODES = 50_000
#: With paths that holds only while these have so few entries in all.
LOCAL_ENTRIES = 5_000_000
#: Nodes with more children, and runs of more nodes, are met by SALTS parts of their key.
HOT = 1_000_000
SALTS = 64


def clean_name(col):
    """A name less surrounding blanks; null if nothing is left."""
    return F.nullif(F.trim(col), F.lit(""))


def nodes_of(edges: DataFrame, child: str, parent: str) -> DataFrame:
    pair = edges.select(clean_name(edges[child]).alias("c"), clean_name(edges[parent]).alias("p"))
    ends = pair.select(
        F.explode(
            F.array(
                F.struct(F.col("c").alias("node"), F.col("p").alias("up"), F.lit(True).alias("made")),
                F.struct(F.col("p").alias("node"), F.lit(None).cast("string").alias("up"), F.lit(False).alias("made")),
            )
        ).alias("x")
    ).select("x.*")
    return (
        ends.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("up").alias("parent"),
            F.max("made").alias("generated"),
            (F.when(F.min("up").isNull(), 0).when(F.min("up") == F.max("up"), 1).otherwise(2)).alias("n_parents"),
        )
    )


def other_parents(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, parent, used): links of children with several parents that :func:`peel` does not follow, and the parent it uses."""
    pair = edges.select(clean_name(edges[child]).alias("node"), clean_name(edges[parent]).alias("parent")).dropna().distinct()
    used = pair.groupBy("node").agg(F.min("parent").alias("used"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return pair.join(used, "node").where("parent <> used")


def _meet(left: DataFrame, key, right: DataFrame, at: str, hot: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join where ``key`` of the left, of which many rows may hold one of the ``hot`` names, is ``at`` of the right, which is unique."""
    if not hot:
        return left.join(right, key == F.col(at), how)
    salt = F.when(key.isin(hot), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    parts = F.when(F.col(at).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a, b = left.withColumn("_salt", salt), right.withColumn("_part", F.explode(parts))
    return a.join(b, (key == F.col(at)) & (F.col("_salt") == F.col("_part")), how).drop("_salt", "_part")


def _runs(active: DataFrame, work: Scratch) -> tuple[DataFrame, int, list[DataFrame]]:
    """Rank all unbranched runs that end in a leaf, (node, parent, leaf, pos, size); count their nodes; name the tables read."""
    kids = active.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("only"))
    links = (
        active.join(kids.withColumnRenamed("parent", "k"), F.col("node") == F.col("k"), "left")
        .where("n is null or n = 1")
        .select("node", "parent", F.col("only").alias("nxt"), F.lit(1).cast("bigint").alias("pos"), F.col("w").alias("size"), F.when(F.col("only").isNull(), F.col("node")).alias("leaf"))
    )
    settled_live = {"live": F.count_if(F.col("nxt").isNotNull()), "done": F.count_if(F.col("nxt").isNull())}
    state, seen = work.write(links, **settled_live)
    settled, peeled, held = [], 0, [state]
    while True:
        settled.append(state.where("nxt is null").drop("nxt"))
        peeled += seen["done"]
        if not seen["live"]:
            return reduce(DataFrame.unionByName, settled), peeled, held
        live = state.where("nxt is not null")
        # what a pointer can land on: all rows still held, settled in this or any earlier step
        known = reduce(DataFrame.unionByName, [x.withColumn("nxt", F.lit(None).cast("string")) for x in settled] + [live])
        at = known.select(F.col("node").alias("b"), F.col("nxt").alias("nxt2"), F.col("pos").alias("pos2"), F.col("size").alias("size2"), F.col("leaf").alias("leaf2"))
        step = live
        for _ in range(HOPS):  # a settled row meets itself, so no null key gathers rows in one task
            fresh = F.col("nxt").isNotNull()
            step = step.join(at, F.coalesce("nxt", "node") == F.col("b")).select(
                "node",
                "parent",
                F.when(fresh, F.col("nxt2")).alias("nxt"),
                F.when(fresh, F.col("pos") + F.col("pos2")).otherwise(F.col("pos")).alias("pos"),
                F.when(fresh, F.col("size") + F.col("size2")).otherwise(F.col("size")).alias("size"),
                F.when(fresh, F.col("leaf2")).otherwise(F.col("leaf")).alias("leaf"),
            )
        before = seen["live"]
        state, seen = work.write(step, **settled_live)
        held.append(state)
        if seen["live"] == before:  # nothing reached a leaf, nothing fell away: only cycles go on
            return reduce(DataFrame.unionByName, settled), peeled, held


def _finish(batches, with_path: bool):
    """Leaf peeling of a small forest in one task; see LOCAL_NODES."""
    import pyarrow as pa

    up: dict = {}
    size: dict = {}
    for b in batches:
        for v, p, w in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            up[v], size[v] = p, w
    kids: dict = {}
    for p in up.values():
        kids[p] = kids.get(p, 0) + 1
    order = [v for v in up if v not in kids]
    for v in order:  # grows while it is walked: a node joins once its last child is peeled
        p = up[v]
        if p is not None:
            size[p] += size[v]
            kids[p] -= 1
            if not kids[p]:
                order.append(p)
    top: dict = {}
    steps: dict = {}
    peeled = set(order)
    for v in up:
        if v not in peeled and v not in top:
            ring = [v]
            while up[ring[-1]] != v:
                ring.append(up[ring[-1]])
            least = min(ring, key=lambda x: x.encode())
            for x in ring:
                top[x], steps[x], size[x] = least, -1, None
    for v in reversed(order):
        p = up[v]
        top[v] = v if p is None else top[p]
        steps[v] = 0 if p is None else steps[p] if steps[p] < 0 else steps[p] + 1
    names = ["node", "top", "steps", "size"] + ["path"] * with_path
    types = [pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.list_(pa.string())] * with_path
    out, held = [[] for _ in names], 0
    for v in up:
        row = [v, top[v], steps[v], size[v]]
        if with_path:
            path = None
            if steps[v] >= 0:
                path = [v]
                while up[path[-1]] is not None:
                    path.append(up[path[-1]])
                path.reverse()
            row.append(path)
        for c, x in zip(out, row, strict=True):
            c.append(x)
        held += 1 + (max(0, steps[v]) if with_path else 0)
        if held > 500_000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
            out, held = [[] for _ in names], 0
    yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def _cycles(residual: DataFrame, work: Scratch) -> DataFrame:
    """Smallest name on the cycle of each residual node: (node, top)."""
    state, _ = work.write(residual.select("node", F.col("parent").alias("nxt"), F.col("node").alias("top")))
    while True:
        at = state.select(F.col("node").alias("b"), F.col("nxt").alias("nxt2"), F.col("top").alias("top2"))
        step = state.join(at, F.col("nxt") == F.col("b")).select(
            "node", F.col("nxt2").alias("nxt"), F.least("top", "top2").alias("top"), (F.col("top2") < F.col("top")).alias("fell")
        )
        nxt, seen = work.write(step, fell=F.count_if("fell"))
        work.drop(state)
        state = nxt
        if not seen["fell"]:
            return state.select("node", "top")


def _chains(runs: DataFrame) -> DataFrame:
    """The top of each run and the subtree size it sends up."""
    top = runs.groupBy("leaf").agg(F.max_by(F.struct("node", "parent", "size", "pos"), "pos").alias("h"))
    return top.select("leaf", F.col("h.node").alias("head"), F.col("h.parent").alias("over"), F.col("h.size").alias("total"), F.col("h.pos").alias("length"))


def peel(edges: DataFrame, child: str, parent: str, with_path: bool = False, local_nodes: int = LOCAL_NODES, hot: int = HOT) -> DataFrame:
    """Full hierarchy of ``edges``; see the module for columns and edge cases."""
    work = Scratch(edges.sparkSession, "peel")
    nodes, seen = work.write(nodes_of(edges, child, parent), n=rows(edges))
    active, left = nodes.select("node", "parent", F.lit(1).cast("bigint").alias("w")), seen["n"]
    # at most one name in ``hot`` nodes
    hubs = [r["parent"] for r in nodes.where("parent is not null").groupBy("parent").count().where(F.col("count") > hot).collect()] if left > hot else []
    rounds: list[tuple[DataFrame, DataFrame, list[DataFrame], list[str]]] = []
    old = None
    local = None
    while left:
        if left <= local_nodes and local is None:
            local = _local(active, work, with_path)
            if local is not None:
                break
            local_nodes = 0
        runs, peeled, held = _runs(active, work)
        if not peeled:
            work.drop(*held)
            break
        chains, seen = work.write(_chains(runs), longest=F.max("length"))
        long = [r["leaf"] for r in chains.where(F.col("length") > hot).collect()] if seen["longest"] > hot else []
        rounds.append((runs, chains, held, long))
        gain = chains.where("over is not null").groupBy("over").agg(F.sum("total").alias("gain"))
        rest = (
            active.join(runs.select("node"), "node", "left_anti")
            .join(gain, F.col("node") == F.col("over"), "left")
            .select("node", "parent", (F.col("w") + F.coalesce("gain", F.lit(0))).alias("w"))
        )
        nxt, seen = work.write(rest, n=rows(rest))
        work.drop(old)
        active, old, left = nxt, nxt, seen["n"]

    null = F.lit(None)
    path0 = [null.cast("array<string>").alias("path")] if with_path else []
    known: list[DataFrame] = []
    if local is not None:
        known.append(local)
    elif left:  # what no peeling removes lies on cycles
        known.append(work.write(_cycles(active, work).select("node", "top", F.lit(-1).cast("bigint").alias("steps"), null.cast("bigint").alias("size"), *path0))[0])
    work.drop(old)
    # rounds shrink by a constant factor, so reading all later ones in each adds up to a few times all nodes
    for runs, chains, held, long in reversed(rounds):
        if known:
            above = reduce(DataFrame.unionByName, known).select(F.col("node").alias("u"), F.col("top").alias("utop"), F.col("steps").alias("usteps"), *([F.col("path").alias("upath")] if with_path else []))
            at = _meet(chains, F.coalesce("over", "head"), above, "u", hubs, "leaf", "left")
        else:
            at = chains.select("*", null.cast("string").alias("utop"), null.cast("bigint").alias("usteps"), *([null.cast("array<string>").alias("upath")] if with_path else []))
        at = at.select(
            F.col("leaf").alias("l"),
            F.coalesce("utop", "head").alias("top"),
            F.when(F.col("over").isNull(), F.lit(0)).when(F.col("usteps") < 0, F.lit(-1)).otherwise(F.col("usteps") + 1).cast("bigint").alias("base"),
            "length",
            *([F.coalesce("upath", F.array().cast("array<string>")).alias("upath")] if with_path else []),
        )
        cols = ["node", "top", F.when(F.col("base") < 0, F.lit(-1)).otherwise(F.col("base") + F.col("length") - F.col("pos")).cast("bigint").alias("steps"), "size"]
        below = runs
        if with_path:
            run = Window.partitionBy("leaf").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
            below = runs.withColumn("part", F.collect_list("node").over(run))
            cols.append(F.when(F.col("base") >= 0, F.concat("upath", "part")).alias("path"))
        known.append(work.write(_meet(below, F.col("leaf"), at, "l", long, "node").select(*cols))[0])
        work.drop(chains, *held)
    out = nodes.select("node", "parent", "generated", "n_parents")
    if not known:
        return out.select("*", null.cast("string").alias("top"), null.cast("bigint").alias("steps"), null.cast("bigint").alias("subtree_size"), *path0)
    return out.join(reduce(DataFrame.unionByName, known).withColumnRenamed("size", "subtree_size"), "node")


def _local(active: DataFrame, work: Scratch, with_path: bool) -> DataFrame | None:
    """The rest peeled in one task; None if paths would be more than LOCAL_ENTRIES entries."""
    one = active.coalesce(1)
    kind = "node string, top string, steps bigint, size bigint"
    plain, seen = work.write(one.mapInArrow(lambda it: _finish(it, False), kind), entries=F.sum(F.greatest("steps", F.lit(0)) + 1))
    if not with_path:
        return plain
    work.drop(plain)
    if seen["entries"] > LOCAL_ENTRIES:
        return None
    return work.write(one.mapInArrow(lambda it: _finish(it, True), kind + ", path array<string>"))[0]


def descendants(forest: DataFrame) -> DataFrame:
    """(ancestor, descendant, steps): every descendant of every node, one row each.

    Takes :func:`peel` with ``with_path=True``. A node's descendants are rows,
    never one list: the root of a tree that holds a third of all nodes has that
    many descendants, more than one task could hold. Nodes of endless chains
    have no path and give no rows.
    """
    up = forest.where("path is not null").select(F.col("node").alias("descendant"), F.posexplode("path").alias("at", "ancestor"), "steps")
    return up.where("at < steps").select("ancestor", "descendant", (F.col("steps") - F.col("at")).cast("int").alias("steps"))
