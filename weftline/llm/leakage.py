"""Test passages inside a training corpus, by latent semantic retrieval and word checks.

1. Every text is cut into words once, on the JVM; a written table keeps each
   document as numbers of the test items' words (-1 for any other word), and the
   documents that hold each word are counted over the whole corpus.
2. A distributed randomised SVD of TF-IDF passages of ``WINDOW`` words gives a
   latent space of ``RANK`` dimensions. It is fitted on all passages of the items
   and on about ``FIT_PASSAGES`` passages of documents taken by the hash of their
   id: two passes add up X'(X Omega) and the Gram matrix of X Q; only those sums,
   sized by the items' vocabulary, reach the driver.
3. Every run of ``WINDOW`` words of every document, at every position, half of
   them or more words of the items, is projected and compared, in blocks, with
   the passages of the items that step 4 can keep for this document at all (a
   bound on what step 4 counts, so it loses nothing): cosine at least ``COSINE``
   makes it a candidate for the item. Words outside the items have no place in
   the latent space and no weight.
4. Candidates are checked on the whole texts and kept if they share RUN words in
   a row, or LCS_SHARE of the item as a common subsequence, or ANSWERED_SHARE of
   it and the item's ending (its answer), or, for passages reworded in part,
   PART_SHARE of some PART_WORDS consecutive words of the item.

Why no shared run of RUN words is missed: a document passage in it is word for
word a passage of the item; equal passages have equal vectors, so their cosine is
1 in any projection that keeps them. Rewordings are found as far as a passage of
theirs stays within the cosine.

Words are the longest runs of ASCII letters and digits, in lower case; after
step 1 they stand as 64-bit hashes. Texts that are null or have fewer than WINDOW
words, and such items, match nothing. Repeated rows and several copies of an id
give one row for each (document, item). Items too many for one index are taken in
blocks of about ``BLOCK_WORDS`` words, each against all documents; the table of
numbers serves ``GROUP_WORDS`` words of items. Empty tables give no rows.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..session import spread

RUN = 20
WINDOW = RUN // 2
LEAST_KNOWN = WINDOW // 2
RANK = 64
OVERSAMPLE = 10
COSINE = 0.7
#: An item's answer occurs if ANSWER_RUN of its last ANSWER_WORDS words stand in a row.
ANSWER_WORDS = 12
ANSWER_RUN = 9
#: A candidate without a run of RUN words holds if so much of the item is a common subsequence,
#: or the lesser share and the answer, or so much of a part of it.
LCS_SHARE = 0.65
ANSWERED_SHARE = 0.4
PART_WORDS = 40
PART_SHARE = 0.8
#: Document passages compared at a time; bounds the block of cosines.
BLOCK = 256
#: Bounds what one index sends to executors: about 50,000 passages of RANK floats, some 15 MB.
BLOCK_WORDS = 50_000
#: Bounds the vocabulary of one table of numbers, and so the sums of the fit: some 120 MB at most.
GROUP_WORDS = 200_000
FIT_PASSAGES = 200_000
FIT_PARTITIONS = 8

_WORD = re.compile(r"[a-z0-9]+")
_UPPER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str) -> list[str]:
    # ASCII letters only: str.lower() would turn some other letters into ASCII ones
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_UPPER))


def word_hashes(text):
    """The words of a text column, as :func:`words_of` gives them, hashed."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow list column."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.flatten()), offsets - offsets[0]


def _numbered(docs: DataFrame, vocab) -> DataFrame:
    """(doc_id, ids, known, n): documents with LEAST_KNOWN or more words of the vocabulary, as
    numbers; and for each task a row without id: ids and the number n of documents with each, -1 for all documents."""
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("known", pa.int32()), ("n", pa.list_(pa.int64()))])

    def run(batches):
        words = vocab.value
        v = len(words)
        seen, total = np.zeros(v, np.int64), 0
        for b in batches:
            flat, at = _lists(b.column(1))
            place = np.minimum(np.searchsorted(words, flat), v - 1)
            ids = np.where(words[place] == flat, place, -1).astype(np.int32)
            total += b.num_rows
            of = np.repeat(np.arange(b.num_rows), np.diff(at))
            here = ids >= 0
            seen += np.bincount(np.unique(of[here] * v + ids[here]) % v, minlength=v)
            known = np.bincount(of[here], minlength=b.num_rows).astype(np.int32)
            made = pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), pa.array(known), pa.nulls(b.num_rows, kind.field(3).type)], schema=kind)
            yield made.filter(pa.array(known >= LEAST_KNOWN))
        some = np.flatnonzero(seen).astype(np.int32)
        row = [[None], [[-1, *some.tolist()]], [0], [[total, *seen[some].tolist()]]]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(row, kind, strict=True)], schema=kind)

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>, known int, n array<bigint>")


def _windows(g: np.ndarray, v: int, stride: int = 1) -> np.ndarray:
    """Passages of a text, at least LEAST_KNOWN words of each known; unknown words become the number v."""
    if len(g) < WINDOW:
        return np.zeros((0, WINDOW), np.int64)
    x = np.lib.stride_tricks.sliding_window_view(g, WINDOW)[::stride]
    x = x[(x >= 0).sum(axis=1) >= LEAST_KNOWN]
    return np.where(x < 0, v, x)


def _fit(texts: DataFrame, weight: np.ndarray) -> np.ndarray:
    """Words to latent dimensions, by randomised SVD of passages; ``texts`` has ids and a stride."""
    spark, v = texts.sparkSession, len(weight)
    width = min(v, RANK + OVERSAMPLE)
    parts = texts.repartition(FIT_PARTITIONS)
    cols = [f"c{i}" for i in range(width)]
    schema = "j int, " + ", ".join(f"{c} double" for c in cols)
    idf = spark.sparkContext.broadcast(weight)

    def gathered(seed_or_q):
        """One pass: each task's share of X'(X M), or of the Gram matrix (XQ)'(XQ)."""

        def run(batches):
            first = isinstance(seed_or_q, int)
            w = np.append(idf.value, 0.0)
            m = np.random.default_rng(seed_or_q).standard_normal((v, width)) if first else seed_or_q.value
            m = np.vstack([m, np.zeros((1, width))]) * w[:, None]
            total = np.zeros((v + 1 if first else width, width))
            for b in batches:
                flat, at = _lists(b.column(0))
                strides = b.column(1).to_pylist()
                for i in range(b.num_rows):
                    x = _windows(flat[at[i] : at[i + 1]], v, strides[i])
                    for k in range(0, len(x), 4096):
                        part = x[k : k + 4096]
                        y = m[part].sum(axis=1)
                        if not first:
                            total += y.T @ y
                            continue
                        word = part.ravel()
                        turn = np.argsort(word, kind="stable")
                        word = word[turn]
                        starts = np.flatnonzero(np.diff(word, prepend=-1))
                        total[word[starts]] += np.add.reduceat(y[turn // WINDOW] * w[word][:, None], starts, axis=0)
            if first:
                total = total[:v]
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), *(pa.array(total[:, i]) for i in range(width))], ["j", *cols])

        sums = parts.mapInArrow(run, schema).groupBy("j").agg(*(F.sum(c).alias(c) for c in cols)).toPandas().set_index("j").sort_index()
        return sums[cols].to_numpy()

    q, _ = np.linalg.qr(gathered(7))
    if q.shape[1] < width:
        return q
    there = spark.sparkContext.broadcast(q)
    _, turn = np.linalg.eigh(gathered(there))
    return q @ turn[:, ::-1][:, : min(RANK, width)]


def _unit(z: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(z, axis=1, keepdims=True)
    return (z / np.where(n > 0, n, 1)).astype(np.float32)


def common_subsequence(a: list[int], masks: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence with the sequence of ``masks``, bit-parallel."""
    full = (1 << size) - 1
    s = full
    for w in a:
        m = masks.get(w)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


def places(seq: list[int]) -> dict[int, list[int]]:
    at: dict[int, list[int]] = {}
    for i, w in enumerate(seq):
        at.setdefault(w, []).append(i)
    return at


def common_run(a: list[int], at: dict[int, list[int]]) -> int:
    """Length of the longest common run with the sequence whose :func:`places` are given."""
    best, before = 0, {}
    for w in a:
        here = at.get(w)
        before = {p: before.get(p - 1, 0) + 1 for p in here} if here else {}
        if before:
            best = max(best, *before.values())
    return best


def passages_words(items: list[tuple], size: int = WINDOW) -> np.ndarray:
    rows = [seq[k : k + size] for _, seq in items for k in range(len(seq) - size + 1)]
    return np.array(rows, dtype=np.int64).reshape(-1, size)


def owners(items: list[tuple], size: int) -> np.ndarray:
    """Place in ``items`` of each row of :func:`passages_words`."""
    return np.concatenate([np.zeros(0, np.int64), *(np.full(max(0, len(s) - size + 1), k) for k, (_, s) in enumerate(items))])


def near(x: np.ndarray, latent: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Which item passages are near any of the document passages ``x``."""
    # equal passages, in any order of their words, are compared once
    uniq = np.unique(np.sort(x, axis=1), axis=0)
    hit = np.zeros(len(passages), dtype=bool)
    for k in range(0, len(uniq), BLOCK):
        hit |= (_unit(latent[uniq[k : k + BLOCK]].sum(axis=1)) @ passages.T).max(axis=0) >= COSINE
    return hit


class Runs:
    """Finds which of some word sequences share ``size`` consecutive words with a document."""

    def __init__(self, items: list[tuple], size: int):
        self.size = size
        self.coef = np.random.default_rng(3).integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1)
        rows, owner = passages_words(items, size), owners(items, size)
        h = self._hash(rows)
        turn = np.argsort(h, kind="stable")
        self.hashes, self.rows, self.owner = h[turn], rows[turn], owner[turn]

    def _hash(self, rows: np.ndarray) -> np.ndarray:
        return (rows.astype(np.uint64) * self.coef).sum(axis=1, dtype=np.uint64)

    def find(self, g: np.ndarray) -> set[int]:
        if len(g) < self.size or not len(self.hashes):
            return set()
        rows = np.lib.stride_tricks.sliding_window_view(g, self.size)
        rows = rows[(rows >= 0).all(axis=1)]
        h = self._hash(rows)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        # equal hashes are compared word by word
        return {int(self.owner[j]) for i in np.flatnonzero(hi > lo) for j in range(lo[i], hi[i]) if (rows[i] == self.rows[j]).all()}


class Checker:
    """Word checks of one index's items against one document at a time."""

    def __init__(self, items: list[tuple], vocabulary: int):
        self.items, self.vocabulary = items, vocabulary
        self.long = Runs(items, RUN)
        self.ending = Runs([(i, s[-ANSWER_WORDS:]) for i, s in items], ANSWER_RUN)
        self.flat = np.concatenate([np.zeros(0, np.int64), *(np.array(s, np.int64) for _, s in items)])
        self.sizes = np.array([len(s) for _, s in items], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.part_owner = owners(items, PART_WORDS)
        self.part_start = np.concatenate([np.zeros(0, np.int64), *(b + np.arange(max(0, n - PART_WORDS + 1)) for b, n in zip(self.starts, self.sizes, strict=True))]).astype(np.int64)
        self.masks: dict = {}

    def bounds(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of each item, and of each part of an item, that occur in the document at all."""
        here = np.zeros(self.vocabulary + 1, dtype=bool)
        here[g] = True
        here[-1] = False  # other words are -1
        sums = np.concatenate([[0], np.cumsum(here[self.flat])])
        return sums[self.starts + self.sizes] - sums[self.starts], sums[self.part_start + PART_WORDS] - sums[self.part_start]

    def possible(self, g: np.ndarray, occur: np.ndarray, parts: np.ndarray) -> set[int]:
        """Items that can hold: a common subsequence is no longer than the words that occur at all."""
        out = set(np.flatnonzero(occur >= LCS_SHARE * self.sizes).tolist())
        out |= set(self.part_owner[parts >= PART_SHARE * PART_WORDS].tolist())
        # runs need as many words of the items in a row
        known = int(np.diff(np.flatnonzero(np.concatenate([[True], g < 0, [True]]))).max()) - 1
        if known >= RUN:
            out |= self.long.find(g)
        if known >= ANSWER_RUN:
            out |= {k for k in self.ending.find(g) if occur[k] >= ANSWERED_SHARE * self.sizes[k]}
        return out

    def _of(self, k: int, at: int, size: int):
        key = (k, at, size)
        if key not in self.masks:
            m: dict = {}
            for i, w in enumerate(self.items[k][1][at : at + size]):
                m[w] = m.get(w, 0) | (1 << i)
            self.masks[key] = m
        return self.masks[key]

    def check(self, g: np.ndarray, candidates: set[int], occur: np.ndarray, parts: np.ndarray) -> list[tuple]:
        """(item id, longest run, lcs, item words, answer) of the candidates that hold."""
        out = []
        long, ended = self.long.find(g) & candidates, self.ending.find(g)
        words = g[g >= 0].tolist()  # words outside the items count for no subsequence
        for k in sorted(candidates):
            item_id, seq = self.items[k]
            mask = self._of(k, 0, len(seq))
            mine = [w for w in words if w in mask]
            lcs = common_subsequence(mine, mask, len(seq))
            if k in long or lcs >= (ANSWERED_SHARE if k in ended else LCS_SHARE) * len(seq) or self._part(mine, k, parts):
                out.append((item_id, common_run(g.tolist(), places(seq)), lcs, len(seq), k in ended))
        return out

    def _part(self, words: list[int], k: int, parts: np.ndarray) -> bool:
        """Whether PART_SHARE of some PART_WORDS words of the item are a common subsequence."""
        a, b = np.searchsorted(self.part_owner, [k, k + 1])
        least = PART_SHARE * PART_WORDS
        return any(common_subsequence(words, self._of(k, int(at), PART_WORDS), PART_WORDS) >= least for at in np.flatnonzero(parts[a:b] >= least))


def _search(numbered: DataFrame, index) -> DataFrame:
    """(doc_id, item_id, longest_run, lcs, item_words, answer) of the candidates that hold."""
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("longest_run", pa.int32()), ("lcs", pa.int32()), ("item_words", pa.int32()), ("answer", pa.bool_())])

    def run(batches):
        latent, items = index.value
        v = len(latent)
        words, owner = passages_words(items), owners(items, WINDOW)
        passages = _unit(latent[words].sum(axis=1))
        latent = np.vstack([latent, np.zeros((1, latent.shape[1]), latent.dtype)])
        checker = Checker(items, v)
        for b in batches:
            rows = []
            flat, at = _lists(b.column(1))
            for n, i in enumerate(b.column(0).to_pylist()):
                g = flat[at[n] : at[n + 1]]
                if len(g) < WINDOW:
                    continue
                occur, parts = checker.bounds(g)
                some = checker.possible(g, occur, parts)
                if some:
                    of = np.isin(owner, list(some))
                    found = set(owner[of][near(_windows(g, v), latent, passages[of])].tolist())
                    rows += [(i, *r) for r in checker.check(g, found, occur, parts)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(out)
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return numbered.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, item_id bigint, longest_run int, lcs int, item_words int, answer boolean")


def _group(corpus: DataFrame, tests: DataFrame, work: Scratch) -> list[DataFrame]:
    """Hits of one group of items, of at most about GROUP_WORDS words."""
    spark, sc = corpus.sparkSession, corpus.sparkSession.sparkContext
    rows = [(r["item_id"], np.array(r["ws"], np.int64)) for r in tests.sort("item_id", "ws").collect()]
    vocab = np.unique(np.concatenate([np.zeros(0, np.int64), *(w for _, w in rows)]))
    items = [(i, np.searchsorted(vocab, w).tolist()) for i, w in rows if len(w) >= WINDOW]
    if not items:
        return []
    numbered, seen = work.write(_numbered(corpus, sc.broadcast(vocab)), known=F.sum("known"))
    counts = numbered.where("doc_id is null").select(F.explode(F.arrays_zip("ids", "n")).alias("x")).groupBy("x.ids").agg(F.sum("x.n").alias("n"))
    n = {r["ids"]: r["n"] for r in counts.collect()}  # one row a word
    held = np.array([n.get(w, 0) for w in range(len(vocab))])
    weight = np.log((n.get(-1, 0) + 1) / (held + 1)) + 1e-3
    texts = numbered.where("doc_id is not null")
    share = min(1.0, FIT_PASSAGES * WINDOW / max(1, seen["known"] or 0))
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000 < share).select("ids", F.lit(WINDOW).alias("stride"))
    own = spark.createDataFrame([(s, 1) for _, s in items], "ids array<int>, stride int")
    latent = (_fit(own.unionByName(sample), weight) * weight[:, None]).astype(np.float32)
    out, block, size = [], [], 0
    for item in [*items, None]:
        if block and (item is None or size + len(item[1]) > BLOCK_WORDS):
            out.append(_search(texts, sc.broadcast((latent, block))))
            block, size = [], 0
        if item is not None:
            block.append(item)
            size += len(item[1])
    return out


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Pairs that hold, with their evidence; see the module."""
    spark = docs.sparkSession
    work = Scratch(spark, "leaks")
    corpus = spread(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text")).where("text is not null and doc_id is not null and text <> ''"))
    corpus = corpus.select("doc_id", word_hashes(F.col("text")).alias("ws"))
    tests = items.select(items[item_id].cast("bigint").alias("item_id"), word_hashes(items[item_text]).alias("ws")).where("ws is not null and item_id is not null").distinct()
    held, seen = work.write(tests, words=F.sum(F.size("ws")))
    groups = max(1, -(-int(seen["words"] or 0) // GROUP_WORDS))
    found = [hits for g in range(groups) for hits in _group(corpus, held.where(F.pmod(F.xxhash64("item_id", "ws"), F.lit(groups)) == g), work)]
    if not found:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, longest_run int, lcs int, item_words int, answer boolean")
    best = [F.max(c).alias(c) for c in ("longest_run", "lcs", "item_words", "answer")]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(*best)


def shared_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id) that share at least RUN consecutive words."""
    return leaks(docs, doc_id, text, items, item_id, item_text).where(F.col("longest_run") >= RUN).select("doc_id", "item_id")
