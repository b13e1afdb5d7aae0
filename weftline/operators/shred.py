"""Deeply nested JSON documents to flat tables, linked by interval labels.

One depth-first walk of each payload numbers every JSON value in it, object, array
or scalar, on the way in (``pre``) and on the way out (``post``). A node lies below
another of the same document if and only if its labels lie between the other's, so
tables of all kinds can be joined at any level by containment (:func:`inside`).
The walk holds the enclosing nodes anyway, so it also notes the labels of the
parent, the bundle and the record around each node: the common links need no join.

A payload counts if, less a byte-order mark and blanks, it is a JSON object, or a
JSON string that holds one, wrapped and nested however deep. All others - null,
empty, broken, arrays, scalars - give no nodes and are listed by :func:`rejected`.
Repeated rows of one document are walked once for each distinct payload
(``variant`` is its MD5). Of a key repeated in one object the last value holds.

Node kinds: ``document``; ``section``, what stands under one key of a document or
bundle; ``bundle``, ``prefix``, ``record``, ``attribute``; ``list``, an array of
records or attribute values; ``value``, anything nested deeper; ``stray``, members
that the model has no place for: sections that are no objects, bundles in bundles.
Scalars come out as text with their type, nested attribute values as JSON text too.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

NODES = (
    "doc_id bigint, variant string, kind string, pre int, post int, depth int, parent_pre int, bundle_pre int, bundle_id string, rec_pre int, "
    "name string, rec_type string, rec_no int, attr_no int, value string, value_type string, lang string"
)
_ARROW = pa.schema(
    [(n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (x.split() for x in NODES.split(", "))]
)
_BLANK = "\ufeff \t\r\n\v\f\x85\xa0"
_TOKEN = re.compile(r"[ \t\r\n]*(?:([{}\[\],:])|(\"(?:[^\"\\]|\\.)*\"|[^ \t\r\n{}\[\],:\"]+))", re.S)


def parse_deep(text: str):
    """``json.loads`` without its bound on nesting."""
    top: list = []
    stack: list = [top]
    keys: list = [None]
    at, state = 0, "value"  # what may come: value, first (value or end), key, firstkey, colon, next, end
    text = text.rstrip(" \t\r\n")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("not JSON")
        at = m.end()
        mark, atom = m.groups()
        here = stack[-1]
        if state in ("key", "firstkey") and atom and atom[0] == '"':
            keys[-1], state = json.loads(atom), "colon"
            continue
        if state == "colon" and mark == ":":
            state = "value"
            continue
        if state == "next" and mark == ",":
            state = "key" if isinstance(here, dict) else "value"
            continue
        if mark in ("}", "]") and (state == "next" or state == ("firstkey" if mark == "}" else "first")) and len(stack) > 1 and isinstance(here, dict) == (mark == "}"):
            stack.pop()
            keys.pop()
            state = "next" if len(stack) > 1 else "end"
            continue
        if state not in ("value", "first") or mark in ("}", "]", ",", ":"):
            raise ValueError("not JSON")
        new = {} if mark == "{" else [] if mark == "[" else json.loads(atom)
        if isinstance(here, dict):
            here[keys[-1]] = new
        else:
            here.append(new)
        if mark:
            stack.append(new)
            keys.append(None)
            state = "firstkey" if mark == "{" else "first"
        else:
            state = "next" if len(stack) > 1 else "end"
    if state != "end":
        raise ValueError("not JSON")
    return top[0]


def unwrap(payload: str | None) -> dict | None:
    """The JSON object in a payload, or None."""
    while isinstance(payload, str):
        text = payload.strip(_BLANK)
        try:
            payload = json.loads(text)
        except RecursionError:
            try:
                payload = parse_deep(text)
            except ValueError:
                return None
        except ValueError:
            return None
    return payload if isinstance(payload, dict) else None


def dump(v) -> str:
    """Compact JSON text, however deep the value."""
    try:
        return json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        out: list[str] = []
        todo: list = [v]
        while todo:
            x = todo.pop()
            if isinstance(x, _Raw):
                out.append(x)
            elif isinstance(x, dict):
                parts: list = [_Raw("{")]
                for i, (k, y) in enumerate(x.items()):
                    parts += [_Raw("," * (i > 0) + json.dumps(k, ensure_ascii=False) + ":"), y]
                todo += [*parts, _Raw("}")][::-1]
            elif isinstance(x, list):
                parts = [_Raw("[")]
                for i, y in enumerate(x):
                    parts += [_Raw("," * (i > 0)), y]
                todo += [*parts, _Raw("]")][::-1]
            else:
                out.append(json.dumps(x, ensure_ascii=False))
        return "".join(out)


class _Raw(str):
    pass


def text_of(v) -> tuple[str | None, str, str | None]:
    """Text, type and language of one value; a typed literal has its own type."""
    while isinstance(v, dict) and "$" in v:
        kind, lang = v.get("type"), v.get("lang")
        if isinstance(v["$"], dict) and "$" in v["$"]:
            v = v["$"]
            continue
        return text_of(v["$"])[0], kind if isinstance(kind, str) else "literal", lang if isinstance(lang, str) else None
    if v is None:
        return None, "null", None
    if isinstance(v, bool):
        return str(v).lower(), "boolean", None
    if isinstance(v, str):
        return v, "string", None
    if isinstance(v, (int, float)):
        return json.dumps(v), "number", None
    return dump(v), "json", None


def _below(v) -> list[tuple]:
    """(name, place, value) of the values in an object or array."""
    return [(k, None, x) for k, x in v.items()] if isinstance(v, dict) else [("", i, x) for i, x in enumerate(v)] if isinstance(v, list) else []


def walk(doc: dict) -> list[list]:
    """Rows of one document: the columns of NODES from ``kind`` on, in depth-first order."""
    out: list[list] = []
    clock = 0
    # (value, kind, name, rec_type, rec_no, attr_no, depth, parent, bundle's pre and id, record's pre); an int closes that row
    todo: list = [(doc, "document", "", None, None, None, 0, None, None, "", None)]
    while todo:
        step = todo.pop()
        if isinstance(step, int):
            out[step][2] = clock
            clock += 1
            continue
        v, kind, name, rec_type, rec_no, attr_no, depth, parent, b_pre, b_id, r_pre = step
        pre = clock
        clock += 1
        text = (None, None, None)
        if kind in ("attribute", "prefix", "stray") or kind == "value" and not isinstance(v, (dict, list)):
            text = text_of(v)
        out.append([kind, pre, 0, depth, parent, b_pre, b_id, r_pre, name, rec_type, rec_no, attr_no, *text])
        todo.append(len(out) - 1)
        inner: list[tuple] = []
        if kind in ("document", "bundle") and isinstance(v, dict):
            if kind == "bundle":
                b_pre, b_id = pre, name
            for k, x in v.items():
                fits = isinstance(x, dict) and (k != "bundle" or kind == "document")
                inner.append((x, "section" if fits else "stray", k, k, None, None))
        elif kind == "section":
            for k, x in v.items():
                if rec_type in ("bundle", "prefix"):
                    inner.append((x, rec_type, k, rec_type, 0 if rec_type == "prefix" else None, None))
                else:
                    inner.append((x, "list", k, rec_type, None, None) if isinstance(x, list) else (x, "record", k, rec_type, 0, None))
        elif kind == "list":
            what = "record" if r_pre is None else "attribute"
            inner = [(x, what, name, rec_type, i, None) if what == "record" else (x, what, name, None, None, i) for i, x in enumerate(v)]
        elif kind == "record" and isinstance(v, dict):
            r_pre = pre
            inner = [(x, "list", k, None, None, None) if isinstance(x, list) else (x, "attribute", k, None, None, 0) for k, x in v.items()]
        else:
            if kind == "record":
                r_pre = pre
            inner = [(x, "value", k, None, None, i) for k, i, x in _below(v)]
        for x in reversed(inner):
            todo.append((*x, depth + 1, pre, b_pre, b_id, r_pre))
    return out


def payloads(df: DataFrame, doc_id: str, payload: str, once: bool = True) -> DataFrame:
    """(doc_id, variant, payload), each payload of a document once."""
    text = df[payload].cast("string")
    rows = df.select(df[doc_id].cast("bigint").alias("doc_id"), F.md5(text).alias("variant"), text.alias("payload")).where("payload is not null and doc_id is not null")
    return rows.dropDuplicates(["doc_id", "variant"]) if once else rows


def nodes(df: DataFrame, doc_id: str, payload: str, kinds: tuple[str, ...] | None = None, once: bool = True) -> DataFrame:
    """Node table of all payloads; ``kinds`` keeps only some, after numbering all."""
    keep = frozenset(kinds) if kinds else None

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in _ARROW]
            for d, v, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                doc = unwrap(text)
                if doc is None:
                    continue
                for row in walk(doc):
                    if keep is None or row[0] in keep:
                        cols[0].append(d)
                        cols[1].append(v)
                        for c, x in zip(cols[2:], row, strict=True):
                            c.append(x)
                if len(cols[0]) > 50_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)
                    cols = [[] for _ in _ARROW]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    return payloads(df, doc_id, payload, once).mapInArrow(run, NODES)


def inside(table: DataFrame, kind: str, into: str) -> DataFrame:
    """Add the name of the enclosing node of one kind, by interval containment.

    ``into`` is '' where no such node encloses the row. Nodes of a kind that
    never nests in itself (bundles; records) make the nearest one before a row
    the only candidate, so one ordered pass per document decides containment.
    """
    before = Window.partitionBy("doc_id", "variant").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("kind") == kind, F.struct("name", "pre", "post"))
    near = F.last(own, ignorenulls=True).over(before)
    return table.withColumn("_near", near).withColumn(into, F.when((F.col("_near.pre") < F.col("pre")) & (F.col("_near.post") > F.col("post")), F.col("_near.name")).otherwise(F.lit(""))).drop("_near")


_KEY = ["doc_id", "variant", "pre", "post"]
#: The flat tables: the kind of node each holds, and its columns after the labels.
TABLES = {
    "documents": ("document", []),
    "bundles": ("bundle", [("name", "bundle_id")]),
    "prefixes": ("prefix", ["bundle_id", ("name", "prefix"), ("value", "uri")]),
    "records": ("record", ["bundle_id", "rec_type", ("name", "rec_id"), "rec_no"]),
    "attributes": ("attribute", ["bundle_id", "rec_pre", "name", "attr_no", "value", "value_type", "lang"]),
    "values": ("value", ["bundle_id", "rec_pre", "parent_pre", "depth", "name", ("attr_no", "place"), "value", "value_type"]),
    "stray": ("stray", ["bundle_id", "name", "value", "value_type"]),
}


def tables(df: DataFrame, doc_id: str, payload: str, work: Scratch | None = None) -> dict[str, DataFrame]:
    """The flat tables TABLES, by name, all keyed by ``doc_id``, ``variant`` and ``pre``.

    Each parses the payloads by itself when it is run; with ``work`` all nodes are
    parsed once, written by kind, and the tables read what was written.
    """
    made = None
    if work is not None:
        path = work.path("nodes")
        nodes(df, doc_id, payload).write.partitionBy("kind").option("compression", "zstd").parquet(path)
        made = df.sparkSession.read.schema(NODES).parquet(path)
    out = {}
    for name, (kind, cols) in TABLES.items():
        n = nodes(df, doc_id, payload, (kind,)) if made is None else made.where(F.col("kind") == kind)
        out[name] = n.select(*_KEY, *(F.col(c) if isinstance(c, str) else F.col(c[0]).alias(c[1]) for c in cols))
    return out


def records(df: DataFrame, doc_id: str, payload: str) -> DataFrame:
    """(doc_id, bundle_id, rec_type, rec_id, rec_no), each record once, prefixes included."""
    n = nodes(df, doc_id, payload, ("prefix", "record"), once=False)
    return n.select("doc_id", "bundle_id", "rec_type", F.col("name").alias("rec_id"), "rec_no").distinct()


def rejected(df: DataFrame, doc_id: str, payload: str) -> DataFrame:
    """Ids of documents none of whose payloads counts."""
    good = nodes(df, doc_id, payload, ("document",)).select("doc_id").distinct()
    return df.select(df[doc_id].cast("bigint").alias("doc_id")).where("doc_id is not null").distinct().join(good, "doc_id", "left_anti")


RECORDS = (
    "doc string, bundle string, kind string, id string, no int, attrs array<struct<name:string,no:int,value:string,type:string,lang:string>>"
)


def whole_records(df: DataFrame, doc_id: str, payload: str) -> DataFrame:
    """One row a record with all its attributes, typed, in one walk: (doc, bundle, kind, id, no, attrs)."""
    attr = pa.struct([("name", pa.string()), ("no", pa.int32()), ("value", pa.string()), ("type", pa.string()), ("lang", pa.string())])
    out = pa.schema([("doc", pa.string()), ("bundle", pa.string()), ("kind", pa.string()), ("id", pa.string()), ("no", pa.int32()), ("attrs", pa.list_(attr))])

    def run(batches):
        for b in batches:
            rows: list[dict] = []
            for d, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                doc = unwrap(text)
                for row in walk(doc) if doc is not None else ():
                    if row[0] == "record":
                        rows.append({"doc": str(d), "bundle": row[6], "kind": row[9], "id": row[8], "no": row[10], "attrs": []})
                    elif row[0] == "attribute":
                        rows[-1]["attrs"].append({"name": row[8], "no": row[11], "value": row[12], "type": row[13], "lang": row[14]})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return payloads(df, doc_id, payload).mapInArrow(run, RECORDS)
