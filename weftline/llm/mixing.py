"""Mix sources to target weights by hierarchical budgeting.

The leaves of a tree of levels (domain, language, source) carry target weights,
sizes in tokens and a cap on repeats. Weights go down the tree as budgets; a
leaf that cannot hold its budget, even repeated as often as it may be, passes
the shortage to its siblings, and only what all of them cannot hold goes up to
their parent's siblings. Each leaf then takes whole epochs of its documents and
from the next epoch, ordered by a seeded hash of its own, the nearest prefix.

The prefix needs no sort of a leaf: token sums of hash buckets tell which bucket
the budget ends in, and only that bucket, one of ``BUCKETS``, is ordered. The
driver sees one row for each leaf, at most ``MAX_LEAVES``, never documents.

The last document is taken if that brings the leaf nearer to its budget, so a
source's tokens differ from its budget by at most half a document for each of
its leaves, more or less alike. Documents without tokens, or of sources without a weight, are not
mixed. Listed sources without documents, or that may not be repeated even once,
pass their whole share on. Shares are
taken relative to their sum; null or negative ones count 0, a null repeat cap 1.
Repeated rows are separate records. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 13
MAX_LEAVES = 100_000


@dataclass
class Leaf:
    path: tuple
    weight: float
    tokens: int
    repeats: int
    budget: float = 0.0

    @property
    def capacity(self) -> int:
        return self.tokens * self.repeats


@dataclass
class Node:
    children: dict = field(default_factory=dict)
    leaf: Leaf | None = None
    weight: float = 0.0
    capacity: float = 0.0


def tree_of(leaves: list[Leaf]) -> Node:
    root = Node()
    for x in leaves:
        at = root
        for part in (None, *x.path):
            if part is not None or at is not root:
                at = at.children.setdefault(part, Node())
            at.weight += x.weight
            at.capacity += x.capacity
        at.leaf = x
    return root


def allot(node: Node, budget: float) -> None:
    """Set the budgets of all leaves below ``node``."""
    if node.leaf is not None:
        node.leaf.budget = min(budget, node.capacity)
        return
    left, open_ = min(budget, node.capacity), list(node.children.values())
    given: dict[int, float] = {}
    while open_:
        weight = sum(c.weight for c in open_)
        part = {id(c): left * (c.weight / weight if weight else 1 / len(open_)) for c in open_}
        full = [c for c in open_ if c.capacity <= part[id(c)]]
        if not full:
            given |= part
            break
        for c in full:  # siblings take up what these cannot hold
            given[id(c)] = c.capacity
            left -= c.capacity
        open_ = [c for c in open_ if id(c) not in given]
    for c in node.children.values():
        allot(c, given[id(c)])


def fitting_total(leaves: list[Leaf]) -> int:
    """Largest total at which no leaf that can hold any tokens falls short of its share."""
    whole = sum(x.weight for x in leaves)
    return int(min((x.capacity / (x.weight / whole) for x in leaves if x.capacity > 0 and x.weight > 0), default=0))


def budgets(leaves: list[Leaf], total: int | None = None) -> list[Leaf]:
    allot(tree_of(leaves), fitting_total(leaves) if total is None else total)
    return leaves


def weighted_leaves(sizes: list[tuple], weights: list[tuple], domain: dict[str, str]) -> list[Leaf]:
    """Leaves (domain, language, source): a source's share split by its tokens in each language.

    ``sizes`` are (source, language, tokens), ``weights`` (source, share, repeats).
    """
    share: dict[str, list] = {}
    for s, w, r in weights:
        if s is not None:
            old = share.setdefault(s, [0.0, 0])
            old[0] += max(0.0, w or 0.0) if w == w else 0.0
            old[1] = max(old[1], 1 if r is None else max(0, r))
    whole = sum(w for w, _ in share.values()) or 1.0
    of: dict[str, dict] = {s: {} for s in share}
    for s, lang, n in sizes:
        if s in of and n:
            of[s][lang] = of[s].get(lang, 0) + n
    out = []
    for s, (w, r) in share.items():
        total = sum(of[s].values())
        for lang, n in of[s].items() if total else [("", 0)]:
            out.append(Leaf((domain.get(s, s), lang, s), w / whole * (n / total if total else 1.0), n, r))
    return out


def select(docs: DataFrame, leaves: list[Leaf], seed: int = 0) -> DataFrame:
    """Documents of the mix: ``docs`` columns and ``copies``.

    ``docs`` has columns id, lang, source and n_tokens.
    """
    spark = docs.sparkSession
    rows = []
    for x in leaves:
        if x.tokens and x.budget > 0:
            epochs = min(x.repeats, int(x.budget // x.tokens))
            rows.append((x.path[-1], x.path[-2], epochs, int(x.budget - epochs * x.tokens) if epochs < x.repeats else 0))
    plan = F.broadcast(spark.createDataFrame(rows, "source string, lang string, epochs int, rest bigint"))
    key = ["source", "lang"]
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("id"))
    placed = docs.where("n_tokens > 0").join(plan, key).withColumn("h", order).withColumn("bucket", F.pmod(F.col("h"), F.lit(BUCKETS)).cast("int"))
    # where each leaf's rest ends: a window over at most BUCKETS sums of a leaf
    sums = placed.where("rest > 0").groupBy(*key, "rest", "bucket").agg(F.sum("n_tokens").alias("s"))
    run = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        sums.withColumn("upto", F.sum("s").over(run))
        .where("upto > rest")
        .groupBy(*key)
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("s")).alias("before"))).alias("e"))
        .select(*key, F.col("e.bucket").alias("last"), F.col("e.before").alias("before"))
    )
    ended = placed.join(F.broadcast(ends), key, "left")  # one row for each leaf
    clear = ended.where("last is null or bucket <> last").withColumn("extra", ((F.col("rest") > 0) & (F.coalesce("last", F.lit(BUCKETS)) > F.col("bucket"))).cast("int"))
    fit = Window.partitionBy(*key).orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = ended.where("bucket = last").withColumn("extra", (F.sum("n_tokens").over(fit) + F.col("before") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    out = clear.unionByName(edge).withColumn("copies", F.col("epochs") + F.col("extra"))
    return out.where("copies > 0").select("id", "lang", "source", "n_tokens", "copies")
