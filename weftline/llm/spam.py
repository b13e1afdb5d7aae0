"""Keyword-stuffed, link-list and tag pages: bagged trees on weak labels, smoothed by host.

1. One Arrow pass over whole texts gives each document content and link features
   (``FEATURES``), taken after a licence header is left out and with plain
   sentences set apart, so a few sentences or a thin shell around spam weigh
   little.
2. Labelling signals (:func:`weak_label`), each sure of the few pages it is about
   and silent on all others, mark under a fifth of the pages as spam or not; the
   rest stays without label and is for the trees to decide.
3. Bagged decision trees are fitted on a bounded sample of labelled rows,
   ``TRAIN_ROWS`` a class, score every document, and are fitted once more on such
   a sample of the labels and of what the first trees are sure of (``SURE``), which
   brings in kinds of pages that no signal speaks of.
4. Scores are smoothed by host (here the repository): the log-odds of a page move
   by ``HOST_WEIGHT`` times how far the log-odds of its host's spam rate are from
   those of all pages. A host's rate is its pages' mean score, drawn to the mean
   of all as if it had ``HOST_PRIOR`` more pages of that mean, so small hosts say
   little. What the host decides are doubtful pages.

Null and empty texts, and texts without any word or link, are never spam. Words
are runs of letters of any script. A null host is no host: such pages keep their
own score. Equal texts get equal own scores. If the labels hold only one class, or
none, the labels are the scores and pages without label are no spam. Several rows
of one id give one row a score. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..session import spread

TRAIN_ROWS = 4_000
TREES = 40
DEPTH = 6
#: Scores of the first trees at least so far from a half are labels for the second ones.
SURE = 0.3
HOST_WEIGHT = 0.3
HOST_PRIOR = 20
THRESHOLD = 0.4
SALTS = 16

# fixed values: English function words, which sentences are full of and tag lists lack
FUNCTION_WORDS = frozenset(
    "a an the this that these those it its he she they them we you i is are was were be been being am do does did has have had "
    "will would can could may might must shall should not no nor and or but if so than then as at by for from in into of off on "
    "onto out over to up with without when while where why how which who what each every any some all both few more most other "
    "such only own same too very just once before after until because their our your his her my one two".split()
)

_LICENCE = re.compile(r"copyright|licen[sc]e|permission|warrant|notice is kept|all rights|SPDX|COPYING", re.I)
_MARK = re.compile(r"[ \t]*(/\*|<!--|\"\"\"|'''|//|#|--|;|%|>|\*)")
# fixed values: what ends the comments that have an end
_CLOSE = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
# fixed values: top-level domains that make a bare name a link, reserved ones included
_TLD = "com|org|net|io|info|biz|shop|test|example|invalid"
_URL = re.compile(r"(?:https?:)?//[^\s\"'<>)\]/]+\.[^\s\"'<>)\]]+")
_BARE = re.compile(rf"(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]++\.)+?(?:{_TLD})\b(?![(\w-])(?:/[^\s\"'<>)\]]*)?")
_ANY_TLD = re.compile(rf"\.(?:{_TLD})\b(?!\()")
_TAG = re.compile(r"<[A-Za-z/!][^<>]*>")
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\d+(?:\.\d+)?")
_BREAK = re.compile(r"(?<=[a-z][.!?])\s+|\n+")
_HASHTAG = re.compile(r"(?<![^\s,;])#[^\W\d_]\w+")
_PRICE = re.compile(r"\d[.,]\d\d\b\W*$")
_CODE_END = re.compile(r"[{};(),:\[\]\\][ \t\r]*$", re.M)
_BLANKS = re.compile(r"\n[ \t\r]*\n")
_LEAD = " \t-/*#>;%\"'"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

FEATURES = [
    "links", "anchors", "md_links", "hashtags", "tags", "function_words", "sentences", "code", "numbers", "unique", "top10",
    "repeat2", "distinct3", "keyed", "commas", "line_words", "short_lines", "capitals", "link_chars", "top_pair", "prices", "even_commas",
]


def body_of(text: str) -> str:
    """The text less a licence header: the leading comments or paragraphs, however
    long, that speak of a licence in something like sentences."""
    at = 0
    while True:
        start = at + len(text[at:]) - len(text[at:].lstrip())
        gap = _BLANKS.search(text, start)
        end = gap.start() if gap else len(text)
        mark = _MARK.match(text, start)
        if mark and mark[1] in _CLOSE:
            close = text.find(_CLOSE[mark[1]], mark.end())
            stop = close + len(_CLOSE[mark[1]]) if close >= 0 else start
        else:
            lines = text[start:end].split("\n")
            if mark:
                n = next((i for i, x in enumerate(lines) if not x.lstrip().startswith(mark[1])), len(lines))
            else:
                n = max((i + 1 for i, x in enumerate(lines) if _LICENCE.search(x)), default=0)
            stop = start + len("\n".join(lines[:n]))
        head = text[start:stop]
        if not head or not _LICENCE.search(head):
            return text[at:]
        words = _WORD.findall(head.lower())
        if "SPDX" not in head and sum(w in FUNCTION_WORDS for w in words) * 8 < len(words):
            return text[at:]
        at = stop


def look(text: str) -> tuple[list[float], float | None] | None:
    """Values of FEATURES and the weak label, or None for a text without a word or link."""
    body = body_of(text)
    anchors = body.count("href=")
    md = body.count("](")
    flat, links, tags = body, 0, 0
    if "//" in flat:
        flat, links = _URL.subn(" ", flat)
    if _ANY_TLD.search(flat):
        flat, more = _BARE.subn(" ", flat)
        links += more
    if "<" in flat:
        flat, tags = _TAG.subn(" ", flat)
    hashtags = len(_HASHTAG.findall(flat)) if "#" in flat else 0
    words: list[str] = []
    in_prose = parts = short = keyed = 0
    for part in _BREAK.split(flat):
        w = _WORD.findall(part.lower())
        if not w:
            continue
        lead = part.lstrip(_LEAD)
        # a plain sentence: a capital, an end, and function words in it
        if len(w) > 3 and part.rstrip(" \t*/\"'")[-1:] in (".", "!", "?") and lead[:1].isupper() and sum(x in FUNCTION_WORDS for x in w) * 8 >= len(w):
            in_prose += len(w)
            continue
        parts += 1
        words += w
        if len(w) < 6:
            short += 1
            keyed += (":" in part or "=" in part) and len(w) < 5
    n = len(words)
    tokens = n + links + in_prose
    if not tokens:
        return None
    each = max(1, n)
    seen = Counter(words)
    top = sorted(seen.values(), reverse=True)
    pairs = Counter(zip(words, words[1:], strict=False))
    plain = flat.encode("ascii", "ignore")
    count = lambda chars: len(plain) - len(plain.translate(None, chars))
    lines = [x for x in body.split("\n") if x.strip()]
    height = max(1, len(lines))
    commas = Counter(x.count(",") for x in lines) if height > 3 else {}
    brackets = count(b"{}()=[]")
    f = [
        links / tokens,
        anchors / tokens,
        md / tokens,
        hashtags / each,
        tags / tokens,
        sum(seen[w] for w in seen.keys() & FUNCTION_WORDS) / each,
        in_prose / tokens,
        max(0, brackets + plain.count(b";\n") - 4 * md) / (tokens + 1),
        len(_NUMBER.findall(flat)) / (n + links + 1),
        len(seen) / each,
        sum(top[:10]) / each,
        sum(c for c in pairs.values() if c > 2) / each,
        len(set(zip(words, words[1:], words[2:], strict=False))) / each,
        keyed / max(1, parts),
        count(b",") / each,
        n / max(1, parts),
        short / max(1, parts),
        count(_CAPITALS) / max(1, len(plain)),
        (len(body) - len(flat)) / max(1, len(body)),
        max(pairs.values(), default=0) / each,
        sum(1 for x in lines if _PRICE.search(x)) / height,
        max((c for k, c in commas.items() if k > 1), default=0) / height,
    ]
    code_ends = len(_CODE_END.findall(body)) / height
    link_lines = sum(1 for x in lines if "//" in x or _ANY_TLD.search(x)) / height if links else 0.0
    bare = not links and code_ends < 0.05 and brackets + plain.count(b";") < 0.01 * len(plain)
    pieces = body.split() if hashtags else []
    return f, weak_label(dict(zip(FEATURES, f, strict=True)), n, len(seen), sum(top[:5]), height, links, code_ends, link_lines, bare, sum(p[0] == "#" for p in pieces), len(pieces))


def weak_label(v, words, distinct, top5, height, links, code_ends, link_lines, bare, tags, pieces) -> float | None:
    """1.0 where a signal is sure of spam, 0.0 of other text, None where none speaks.

    Spam: a page of link lines only; of hashtags only; bare of any punctuation of
    code and made of five words or of one phrase; lines of a few words that all end
    in a price. Other: nearly all sentences; nearly all lines ending as code or data
    does; settings of one key a line; a table of as many commas in each line.
    """
    if link_lines >= 0.8 and height >= 5 and code_ends < 0.2 and v["sentences"] == 0:
        return 1.0
    if pieces and tags > 0.8 * pieces:
        return 1.0
    if bare and words >= 40 and v["function_words"] < 0.08 and top5 > 0.5 * words and v["sentences"] == 0 and distinct < 0.2 * words:
        return 1.0
    if bare and words >= 30 and v["top_pair"] > 0.15 and v["sentences"] < 0.3:
        return 1.0
    if v["prices"] > 0.8 and code_ends < 0.05 and words >= 30 and words > 3 * height and distinct < 0.3 * words:
        return 1.0
    if links:
        return None
    if v["sentences"] > 0.9 or code_ends > 0.98:
        return 0.0
    if v["keyed"] > 0.6 and 0.3 < code_ends < 0.6:
        return 0.0
    if v["even_commas"] > 0.95 and v["prices"] < 0.1:
        return 0.0
    return None


def extract(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """(id, host, f array, weak) of every document with a word or link in it."""
    out = pa.schema([("id", pa.int64()), ("host", pa.string()), ("f", pa.list_(pa.float64())), ("weak", pa.float64())])

    def run(batches):
        for b in batches:
            ids, hosts, fs, ws = [], [], [], []
            for i, h, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                seen = look(t)
                if seen is not None:
                    ids.append(i)
                    hosts.append(h)
                    fs.append(seen[0])
                    ws.append(seen[1])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(fs, pa.list_(pa.float64())), pa.array(ws, pa.float64())], schema=out)

    page = docs.select(docs[doc_id].cast("bigint").alias("id"), docs[host].cast("string").alias("host"), docs[text].alias("t")).where("t is not null and id is not null")
    return spread(page).mapInArrow(run, "id bigint, host string, f array<double>, weak double")


def _trees(labelled: DataFrame, spam: int, ham: int):
    """Bagged trees fitted on a repeatable sample of about TRAIN_ROWS rows a class; ``labelled`` has id, f, label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    share = F.when(F.col("label") == 1.0, F.lit(TRAIN_ROWS / spam)).otherwise(F.lit(TRAIN_ROWS / ham))
    picked = labelled.where(F.pmod(F.xxhash64("id", "f"), F.lit(1_000_000)) / 1_000_000 < share)
    # the limit bounds what repeated rows of one id could add; else it holds nothing back
    train = picked.limit(4 * TRAIN_ROWS).select(array_to_vector("f").alias("features"), "label").coalesce(4).persist()
    trees = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", bootstrap=True, seed=7, minInstancesPerNode=3, cacheNodeIds=False)
    model = trees.fit(train).copy()  # the copy is without the training summary, which cannot be sent to executors
    train.unpersist()
    return model


def _scored(model, table: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    given = model.transform(table.select("*", array_to_vector("f").alias("features")))
    return given.select("id", "host", "f", "weak", vector_to_array("probability")[1].alias("own"))


def _classes(column):
    return {"spam": F.count_if(column == 1.0), "ham": F.count_if(column == 0.0)}


def scores(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """(id, host, weak, own, score): weak label, own score of the trees, and the smoothed one."""
    work = Scratch(docs.sparkSession, "spam")
    table, seen = work.write(extract(docs, doc_id, text, host), **_classes(F.col("weak")))
    if seen["spam"] and seen["ham"]:
        first = _trees(table.where("weak is not null").withColumn("label", F.col("weak")), **seen)
        own = F.col("own")
        sure = F.coalesce("weak", F.when(own >= 0.5 + SURE, F.lit(1.0)).when(own <= 0.5 - SURE, F.lit(0.0)))
        grown, more = work.write(_scored(first, table).withColumn("label", sure), **_classes(F.col("label")))
        second = _trees(grown.where("label is not null"), **more)
        own = _scored(second, table).select("id", "host", "weak", "own")
    else:
        own = table.select("id", "host", "weak", F.coalesce("weak", F.lit(0.0)).alias("own"))
    own, mean = work.write(own, mean=F.avg("own"))
    every = F.lit(mean["mean"] or 0.0)
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-3)) / F.greatest(1 - p, F.lit(1e-3)))
    # the host's rate, in two steps so that no host's pages meet in one task
    salted = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    rate = own.where("host is not null").groupBy("host").agg(((F.sum("own") + every * HOST_PRIOR) / (F.count(F.lit(1)) + HOST_PRIOR)).alias("rate"))
    rate = rate.select("host", "rate", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    smooth = 1 / (1 + F.exp(-(odds(F.col("own")) + HOST_WEIGHT * (odds(F.col("rate")) - odds(every)))))
    hosted = salted.where("host is not null").join(rate, ["host", "salt"]).select("id", "host", "weak", "own", smooth.alias("score"))
    return hosted.unionByName(own.where("host is null").select("id", "host", "weak", "own", F.col("own").alias("score")))


def decided_by(threshold: float = THRESHOLD):
    """Who settled a page of :func:`scores`: its host, if smoothing turned the trees' decision, a label the trees agree with, or the trees alone."""
    spam = F.col("score") >= threshold
    return F.when(spam != (F.col("own") >= threshold), F.lit("host")).when(F.col("weak") == spam.cast("double"), F.lit("label")).otherwise(F.lit("trees"))


def spam_pages(docs: DataFrame, doc_id: str, text: str, host: str, threshold: float = THRESHOLD) -> DataFrame:
    """Ids of spam pages."""
    return scores(docs, doc_id, text, host).where(F.col("score") >= threshold).select("id").distinct()
