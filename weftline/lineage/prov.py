"""Provenance documents as tables: records, nodes and edges, their algebra and formats.

records(doc, bundle, kind, id, no, attrs)   attrs: array of (name, no, value, type, lang)
edges(doc, bundle, kind, id, src, dst, attrs)

Attributes keep their XSD type and language; ``no`` is the place of a value in an array.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shred import RECORDS, tables, whole_records
from ..scratch import Scratch

ATTRS = "array<struct<name:string,no:int,value:string,type:string,lang:string>>"
NODES = f"doc string, bundle string, kind string, id string, attrs {ATTRS}"
EDGES = f"doc string, bundle string, kind string, id string, src string, dst string, attrs {ATTRS}"

# fixed values: the record kinds of the PROV data model; of relations the formal attributes in
# their order, the first two naming the ends, and the kinds of node these ends are
ELEMENTS = {"entity": (), "activity": ("prov:startTime", "prov:endTime"), "agent": ()}
RELATIONS = {
    "wasGeneratedBy": (("prov:entity", "prov:activity", "prov:time"), "entity", "activity"),
    "used": (("prov:activity", "prov:entity", "prov:time"), "activity", "entity"),
    "wasInformedBy": (("prov:informed", "prov:informant"), "activity", "activity"),
    "wasStartedBy": (("prov:activity", "prov:trigger", "prov:starter", "prov:time"), "activity", "entity"),
    "wasEndedBy": (("prov:activity", "prov:trigger", "prov:ender", "prov:time"), "activity", "entity"),
    "wasInvalidatedBy": (("prov:entity", "prov:activity", "prov:time"), "entity", "activity"),
    "wasDerivedFrom": (("prov:generatedEntity", "prov:usedEntity", "prov:activity", "prov:generation", "prov:usage"), "entity", "entity"),
    "wasAttributedTo": (("prov:entity", "prov:agent"), "entity", "agent"),
    "wasAssociatedWith": (("prov:activity", "prov:agent", "prov:plan"), "activity", "agent"),
    "actedOnBehalfOf": (("prov:delegate", "prov:responsible", "prov:activity"), "agent", "agent"),
    "wasInfluencedBy": (("prov:influencee", "prov:influencer"), "entity", "entity"),
    "specializationOf": (("prov:specificEntity", "prov:generalEntity"), "entity", "entity"),
    "alternateOf": (("prov:alternate1", "prov:alternate2"), "entity", "entity"),
    "mentionOf": (("prov:specificEntity", "prov:generalEntity", "prov:bundle"), "entity", "entity"),
    "hadMember": (("prov:collection", "prov:entity"), "entity", "entity"),
}
# fixed values: derivation subtypes, and the type of a collection
SUBTYPES = {"revision": "prov:Revision", "quotation": "prov:Quotation", "primary_source": "prov:PrimarySource"}
COLLECTION = "prov:Collection"
# fixed values: XSD literal types that have a Spark type
XSD = {"xsd:string": "string", "xsd:double": "double", "xsd:float": "float", "xsd:long": "bigint", "xsd:int": "int", "xsd:integer": "bigint", "xsd:boolean": "boolean", "xsd:dateTime": "timestamp", "xsd:anyURI": "string"}
# fixed values: namespaces that need no declaration
NAMESPACES = {"prov": "http://www.w3.org/ns/prov#", "xsd": "http://www.w3.org/2001/XMLSchema#"}


def literal(value: Column, kind: str) -> Column:
    """A literal of an XSD type as a Spark value; null if malformed or of another type."""
    return value.try_cast(XSD[kind]) if kind in XSD else F.lit(None)


def first_value(name: Column | str, attrs: str = "attrs") -> Column:
    """The first value of an attribute; null where there is none."""
    name = F.lit(name) if isinstance(name, str) else name
    hit = F.filter(F.col(attrs), lambda a: (a["name"] == name) & (a["no"] == 0))
    return F.try_element_at(hit, F.lit(1))["value"]


# reading


def from_json(df: DataFrame, doc_id: str, payload: str) -> DataFrame:
    """Records of PROV-JSON payloads, through the shredder, in one walk of each payload."""
    return whole_records(df, doc_id, payload)


def prefixes_of(df: DataFrame, doc_id: str, payload: str) -> DataFrame:
    """(doc, bundle, prefix, uri) declared in the payloads."""
    p = tables(df, doc_id, payload)["prefixes"]
    return p.select(F.col("doc_id").cast("string").alias("doc"), F.col("bundle_id").alias("bundle"), "prefix", "uri").distinct()


def detect(payload: Column) -> Column:
    """Format of a document's text: json (wrapped or not), xml, provn; null if none of these."""
    t = F.regexp_replace(payload, "^[\\s\\x{FEFF}]+", "")
    return F.when(t.startswith("{") | t.startswith('"'), "json").when(t.startswith("<"), "xml").when(t.startswith("document"), "provn")


def read(df: DataFrame, doc_id: str, payload: str) -> DataFrame:
    """Records of documents in any format that can be read, JSON or XML, told apart by their text."""
    kind = detect(df[payload])
    return from_json(df.where(kind == "json"), doc_id, payload).unionByName(from_xml(df.where(kind == "xml"), doc_id, payload))


def elements(records: DataFrame) -> DataFrame:
    return records.where(F.col("kind").isin(*ELEMENTS)).select("doc", "bundle", "kind", "id", "attrs")


def relations(records: DataFrame) -> DataFrame:
    """Edges; a relation whose end is an array gives one edge for each value, or pair of values, of its ends."""
    end = lambda i: F.coalesce(*(F.when(F.col("kind") == k, F.lit(r[0][i])) for k, r in RELATIONS.items()))
    ends = records.where(F.col("kind").isin(*RELATIONS)).withColumns({"_a": end(0), "_b": end(1)})
    values = lambda c: F.array_distinct(F.filter(F.transform(F.filter("attrs", lambda e: e["name"] == F.col(c)), lambda e: e["value"]), lambda v: v.isNotNull()))
    pairs = ends.select("*", F.explode_outer(values("_a")).alias("src")).select("*", F.explode_outer(values("_b")).alias("dst"))
    # an edge's attributes name its own ends alone
    mine = F.filter("attrs", lambda e: ~((e["name"] == F.col("_a")) & ~e["value"].eqNullSafe(F.col("src"))) & ~((e["name"] == F.col("_b")) & ~e["value"].eqNullSafe(F.col("dst"))))
    return pairs.select("doc", "bundle", "kind", "id", "src", "dst", mine.alias("attrs"))


def from_payloads(df: DataFrame, doc_id: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of PROV-JSON payloads, which are parsed once and written for both."""
    r, _ = Scratch(df.sparkSession, "prov").write(from_json(df, doc_id, payload))
    return elements(r), relations(r)


# making records


@dataclass
class Builder:
    """Records of one small document, made one by one: ``b.entity("e"); b.used("a", "e"); b.records(spark)``."""

    doc: str
    bundle: str = ""
    rows: list = field(default_factory=list)

    def add(self, kind: str, ident: str | None, attrs: dict) -> str:
        ident = ident or f"_:id{len(self.rows) + 1}"
        each = []
        for k, v in attrs.items():
            for i, x in enumerate(v if isinstance(v, list) else [v]):
                if x is not None:
                    kind_of = x[1] if isinstance(x, tuple) else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string"
                    x = x[0] if isinstance(x, tuple) else x
                    each.append((k, i, json.dumps(x) if isinstance(x, (bool, int, float)) else str(x), kind_of, None))
        self.rows.append((self.doc, self.bundle, kind, ident, 0, each))
        return ident

    def entity(self, ident: str, **attrs) -> str:
        return self.add("entity", ident, attrs)

    def collection(self, ident: str, **attrs) -> str:
        return self.add("entity", ident, {"prov:type": (COLLECTION, "prov:QUALIFIED_NAME")} | attrs)

    def activity(self, ident: str, start: str | None = None, end: str | None = None, **attrs) -> str:
        return self.add("activity", ident, {"prov:startTime": start, "prov:endTime": end} | attrs)

    def agent(self, ident: str, **attrs) -> str:
        return self.add("agent", ident, attrs)

    def relate(self, kind: str, *formal, ident: str | None = None, **attrs) -> str:
        """A relation by its verb and formal values in their order; None leaves one out."""
        names = RELATIONS[kind][0]
        if len(formal) > len(names):
            raise ValueError(f"{kind} has {len(names)} formal attributes")
        return self.add(kind, ident, dict(zip(names, formal, strict=False)) | attrs)

    def __getattr__(self, name: str):
        if name in RELATIONS:
            return lambda *formal, **more: self.relate(name, *formal, **more)
        if name in SUBTYPES:
            return lambda *formal, **more: self.relate("wasDerivedFrom", *formal, **({"prov:type": (SUBTYPES[name], "prov:QUALIFIED_NAME")} | more))
        raise AttributeError(name)

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, RECORDS)


# algebra


def of_kind(table: DataFrame, kind: str) -> DataFrame:
    return table.where(F.col("kind") == kind)


def by_id(table: DataFrame, ident: str) -> DataFrame:
    return table.where(F.col("id") == ident)


def uri(name: Column, prefixes: DataFrame, table: DataFrame) -> DataFrame:
    """``table`` with a column ``uri``: a name ``prefix:local`` spelled out by its bundle's prefixes, else its document's, else the fixed ones.

    Null where the prefix is declared nowhere. ``prefixes`` is small beside the records; a name without a prefix takes the prefix ``default``.
    """
    p = F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1)).otherwise("default")
    local = F.regexp_replace(name, "^[^:]*:", "")
    # the innermost declaration of a prefix stands first
    own = prefixes.select(F.col("doc").alias("_d"), F.col("bundle").alias("_b"), F.col("prefix").alias("_p"), F.col("uri").alias("_own"))
    outer = prefixes.where("bundle = ''").select(F.col("doc").alias("_d2"), F.col("prefix").alias("_p2"), F.col("uri").alias("_outer"))
    fixed = F.coalesce(*(F.when(F.col("_px") == k, F.lit(v)) for k, v in NAMESPACES.items()))
    at = table.withColumn("_px", p).withColumn("_local", local)
    at = at.join(own, (F.col("doc") == F.col("_d")) & (F.col("bundle") == F.col("_b")) & (F.col("_px") == F.col("_p")), "left")
    at = at.join(outer, (F.col("doc") == F.col("_d2")) & (F.col("_px") == F.col("_p2")), "left")
    return at.withColumn("uri", F.concat(F.coalesce("_own", "_outer", fixed), "_local")).drop("_px", "_local", "_d", "_b", "_p", "_own", "_d2", "_p2", "_outer")


def unified(nodes: DataFrame, by: list[str] = ("doc", "bundle", "kind", "id")) -> DataFrame:
    """Records of equal identifier merged: the distinct values of their attributes, in order, numbered by name."""
    each = nodes.select(*by, F.explode_outer("attrs").alias("a"))
    merged = each.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct(F.col("a.name").alias("name"), F.col("a.value").alias("value"), F.col("a.type").alias("type"), F.col("a.lang").alias("lang")))).alias("s"))
    some = F.filter("s", lambda a: a["name"].isNotNull())
    place = lambda a, i: (i - F.array_position(F.transform("_s", lambda b: b["name"]), a["name"]) + 1).cast("int")
    numbered = F.transform("_s", lambda a, i: F.struct(a["name"].alias("name"), place(a, i).alias("no"), a["value"].alias("value"), a["type"].alias("type"), a["lang"].alias("lang")))
    return merged.withColumn("_s", some).withColumn("attrs", numbered).drop("s", "_s")


def flattened(table: DataFrame) -> DataFrame:
    """All bundles' records in the document itself."""
    return table.withColumn("bundle", F.lit(""))


def update(table: DataFrame, other: DataFrame) -> DataFrame:
    """Records of both."""
    return table.unionByName(other)


def add_bundle(table: DataFrame, other: DataFrame, bundle: str) -> DataFrame:
    return table.unionByName(other.withColumn("bundle", F.lit(bundle)))


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Same records, each as often, in any order; a record's attributes too in any order."""
    plain = lambda t: t.select(*sorted(t.columns)).withColumn("attrs", F.array_sort("attrs"))
    x, y = plain(a), plain(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def property_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph for each document, its bundles' records included: (doc, id, kind, inferred) and the edges.

    Every end of an edge is a node; one that the document does not declare has the kind its place implies.
    An id declared, or implied, as several kinds has a row for each.
    """
    implies = lambda i: F.coalesce(*(F.when(F.col("kind") == k, F.lit(r[i])) for k, r in RELATIONS.items()))
    known = nodes.select("doc", "id", "kind", F.lit(False).alias("inferred")).distinct()
    end = lambda c, i: F.struct(F.col(c).alias("id"), implies(i).alias("kind"))
    ends = edges.select("doc", F.explode(F.array(end("src", 1), end("dst", 2))).alias("x")).select("doc", "x.*").where("id is not null")
    implied = ends.distinct().join(known.select("doc", "id").distinct(), ["doc", "id"], "left_anti")
    return known.unionByName(implied.withColumn("inferred", F.lit(True))), edges


def to_edges(lineage: DataFrame) -> DataFrame:
    """W3C view of lineage records: wasGeneratedBy, used, wasDerivedFrom, wasAssociatedWith."""
    each = lineage.select(F.col("runId").alias("doc"), "iterationId", "username", F.explode("streams").alias("s"), "derivationIds")
    cols = lambda kind, src, dst: F.struct(F.lit(kind).alias("kind"), src.cast("string").alias("src"), dst.cast("string").alias("dst"))
    fixed = F.array(cols("wasGeneratedBy", F.col("s.id"), F.col("iterationId")), cols("wasAssociatedWith", F.col("iterationId"), F.col("username")))
    used = F.transform("derivationIds", lambda d: cols("used", F.col("iterationId"), d["DerivedFromDatasetID"]))
    derived = F.transform("derivationIds", lambda d: cols("wasDerivedFrom", F.col("s.id"), d["DerivedFromDatasetID"]))
    return each.select("doc", F.explode(F.concat(fixed, used, derived)).alias("e")).select("doc", "e.*").distinct()


# writing


def _value(a: dict):
    """One attribute value as PROV-JSON."""
    kind, text, lang = a["type"], a["value"], a["lang"]
    if kind in ("null", "boolean", "number", "json") and lang is None:
        return None if text is None else json.loads(text)
    if kind == "string" and lang is None:
        return text
    return {"$": text} | ({"type": kind} if kind not in ("literal", "string") else {}) | ({"lang": lang} if lang is not None else {})


def document_json(records: list[dict], prefixes: list[dict] = ()) -> str:
    """PROV-JSON text of one document's records."""
    doc: dict = {}
    place = lambda b: doc.setdefault("bundle", {}).setdefault(b, {}) if b else doc
    for p in prefixes:
        place(p["bundle"]).setdefault("prefix", {})[p["prefix"]] = p["uri"]
    for r in sorted(records, key=lambda r: (r["bundle"], r["kind"], r["id"], r.get("no") or 0)):
        attrs: dict = {}
        for a in sorted(r["attrs"] or [], key=lambda a: a["no"]):
            attrs.setdefault(a["name"], []).append(_value(a))
        members = place(r["bundle"]).setdefault(r["kind"], {})
        members.setdefault(r["id"], []).append({k: v[0] if len(v) == 1 else v for k, v in attrs.items()})
    for at in [doc, *doc.get("bundle", {}).values()]:
        for kind, members in at.items():
            if kind not in ("bundle", "prefix"):
                for k, v in members.items():
                    members[k] = v[0] if len(v) == 1 else v
    return json.dumps(doc, ensure_ascii=False)


def to_json(records: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """(doc, json): PROV-JSON text of every document, made where the document is."""
    return _documents(records, prefixes, "json", document_json)


def to_xml(records: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """(doc, xml): PROV-XML text of every document."""
    return _documents(records, prefixes, "xml", document_xml)


def _documents(records: DataFrame, prefixes: DataFrame | None, name: str, make) -> DataFrame:
    rows = records.groupBy("doc").agg(F.collect_list(F.struct("bundle", "kind", "id", "no", "attrs")).alias("r"))
    if prefixes is None:
        rows = rows.withColumn("p", F.array().cast("array<struct<bundle:string,prefix:string,uri:string>>"))
    else:
        rows = rows.join(prefixes.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("bundle", "prefix", "uri"))).alias("p")), "doc", "left")

    def run(batches):
        for b in batches:
            made = [make(r, p or []) for r, p in zip(b.column("r").to_pylist(), b.column("p").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(made, pa.string())], ["doc", name])

    return rows.mapInArrow(run, f"doc string, {name} string")


def document_xml(records: list[dict], prefixes: list[dict] = ()) -> str:
    """PROV-XML text of one document: an element a record, an element an attribute, ends as references."""
    from xml.sax.saxutils import escape, quoteattr

    formal = {k: set(r[0]) for k, r in RELATIONS.items()}
    spaces = NAMESPACES | {p["prefix"]: p["uri"] for p in prefixes if not p["bundle"]}

    def one(r: dict) -> str:
        ident = "" if r["id"].startswith("_:") else f" prov:id={quoteattr(r['id'])}"
        inner = []
        for a in sorted(r["attrs"] or [], key=lambda a: (a["name"] not in formal.get(r["kind"], ()), a["name"], a["no"])):
            if a["value"] is None:
                continue
            tag = a["name"] if ":" in a["name"] else f"prov:{a['name']}"
            if a["name"] in formal.get(r["kind"], ()) and a["name"] != "prov:time":
                inner.append(f"<{tag} prov:ref={quoteattr(a['value'])}/>")
            else:
                more = (f" xsi:type={quoteattr(a['type'])}" if a["type"] not in ("string", "literal") else "") + (f" xml:lang={quoteattr(a['lang'])}" if a["lang"] else "")
                inner.append(f"<{tag}{more}>{escape(a['value'])}</{tag}>")
        return f"<prov:{r['kind']}{ident}>{''.join(inner)}</prov:{r['kind']}>"

    def many(bundle: str) -> str:
        return "".join(one(r) for r in sorted(records, key=lambda r: (r["kind"], r["id"], r.get("no") or 0)) if r["bundle"] == bundle)

    bundles = sorted({r["bundle"] for r in records} - {""})
    declared = "".join(f" xmlns:{k}={quoteattr(v or '')}" for k, v in sorted(spaces.items()) if k != "default")
    inner = many("") + "".join(f"<prov:bundleContent prov:id={quoteattr(b)}>{many(b)}</prov:bundleContent>" for b in bundles)
    return f'<?xml version="1.0" encoding="UTF-8"?><prov:document xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"{declared}>{inner}</prov:document>'


def xml_records(text: str) -> list[dict]:
    """Records of one PROV-XML text; [] if it is not well formed."""
    from xml.etree import ElementTree

    names = {v: k for k, v in NAMESPACES.items()}
    try:
        parser = ElementTree.XMLPullParser(["start-ns", "start", "end"])
        parser.feed(text.strip("\ufeff \t\r\n"))
        parser.close()
        root = None
        for event, x in parser.read_events():
            if event == "start-ns":
                names.setdefault(x[1], x[0])
            elif event == "start" and root is None:
                root = x
    except ElementTree.ParseError:
        return []
    if root is None:
        return []

    def short(tag: str) -> str:
        space, _, local = tag[1:].rpartition("}") if tag.startswith("{") else ("", "", tag)
        return f"{names[space]}:{local}" if names.get(space) else local

    given = lambda x, name: next((v for k, v in x.attrib.items() if short(k) == name), None)
    out: list[dict] = []
    seen: dict = {}

    def take(parent, bundle: str) -> None:
        for x in parent:
            kind = short(x.tag).removeprefix("prov:")
            ident = given(x, "prov:id")
            if kind == "bundleContent":
                take(x, ident or "")
                continue
            ident = ident or f"_:id{len(out) + 1}"
            attrs: list[dict] = []
            for a in x:
                name, ref = short(a.tag), given(a, "prov:ref")
                no = sum(1 for b in attrs if b["name"] == name)
                kind_of = next((v for k, v in a.attrib.items() if k.endswith("}type")), None)
                lang = next((v for k, v in a.attrib.items() if k.endswith("}lang")), None)
                attrs.append({"name": name, "no": no, "value": ref if ref is not None else a.text or "", "type": kind_of or ("literal" if lang else "string"), "lang": lang})
            no = seen[bundle, kind, ident] = seen.get((bundle, kind, ident), -1) + 1
            out.append({"bundle": bundle, "kind": kind, "id": ident, "no": no, "attrs": attrs})

    take(root, "")
    return out


def from_xml(df: DataFrame, doc_id: str, payload: str) -> DataFrame:
    """Records of PROV-XML payloads; texts that are not well formed give none."""
    rows = df.select(df[doc_id].cast("string").alias("doc"), df[payload].alias("t")).where("doc is not null and t is not null").distinct()
    kind = pa.schema([("doc", pa.string()), ("bundle", pa.string()), ("kind", pa.string()), ("id", pa.string()), ("no", pa.int32()),
                      ("attrs", pa.list_(pa.struct([("name", pa.string()), ("no", pa.int32()), ("value", pa.string()), ("type", pa.string()), ("lang", pa.string())])))])

    def run(batches):
        for b in batches:
            made = [{"doc": d} | r for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in xml_records(t)]
            yield pa.RecordBatch.from_pylist(made, schema=kind)

    return rows.mapInArrow(run, RECORDS)


def _quoted(text: Column) -> Column:
    escapes = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")]
    return F.concat(F.lit('"'), reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), escapes, text), F.lit('"'))


def _literal_n(a: Column) -> Column:
    """A value as PROV-N: text in quotes, with its language or type."""
    text = _quoted(F.coalesce(a["value"], F.lit("")))
    plain = a["type"].isin("string", "literal", "null", "json")
    kind = F.when(a["type"] == "number", F.when(F.contains(a["value"], F.lit(".")) | F.contains(a["value"], F.lit("e")), "xsd:double").otherwise("xsd:int")).when(a["type"] == "boolean", "xsd:boolean").otherwise(a["type"])
    return F.when(a["lang"].isNotNull(), F.concat(text, F.lit("@"), a["lang"])).when(plain, text).otherwise(F.concat(text, F.lit(" %% "), kind))


def prov_n(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, bundle, line): a PROV-N expression for each element and edge.

    Formal attributes stand in their places, a dash for one that is missing; all
    others in brackets, by name and place. Identifiers of blank nodes are left out.
    """
    formal = {k: list(v) for k, v in ELEMENTS.items()} | {k: list(r[0]) for k, r in RELATIONS.items()}
    names = F.coalesce(*(F.when(F.col("kind") == k, F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")) for k, v in formal.items()))

    def line(table: DataFrame, ends: list[str]) -> DataFrame:
        t = table.withColumn("_names", names)
        rest = F.filter("attrs", lambda a: ~F.array_contains("_names", a["name"]))
        extra = F.array_join(F.transform(F.array_sort(rest), lambda a: F.concat(a["name"], F.lit("="), _literal_n(a))), ", ")
        tail = F.when(F.size(rest) > 0, F.concat(F.lit(", ["), extra, F.lit("]"))).otherwise("")
        one = lambda n: F.coalesce(F.try_element_at(F.filter("attrs", lambda a: (a["name"] == n) & (a["no"] == 0)), F.lit(1))["value"], F.lit("-"))
        if ends:
            args = F.concat(F.array(*(F.coalesce(F.col(c), F.lit("-")) for c in ends)), F.transform(F.slice("_names", F.lit(3), F.size("_names")), one))
            ident = F.when(F.col("id").startswith("_:"), "").otherwise(F.concat("id", F.lit("; ")))
            head = F.concat(ident, F.array_join(args, ", "))
        else:
            head = F.array_join(F.concat(F.array("id"), F.transform("_names", one)), ", ")
        return t.select("doc", "bundle", F.concat("kind", F.lit("("), head, tail, F.lit(")")).alias("line"))

    return line(nodes, []).unionByName(line(edges, ["src", "dst"]))


def prov_n_text(lines: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """(doc, text): whole PROV-N documents of :func:`prov_n` lines, with prefixes and bundles."""
    if prefixes is not None:
        lines = lines.unionByName(prefixes.select("doc", "bundle", F.concat(F.lit(" prefix "), "prefix", F.lit(" <"), "uri", F.lit(">")).alias("line")))
    per = lines.groupBy("doc", "bundle").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("b"))  # " prefix" sorts first
    whole = F.when(F.col("bundle") == "", F.col("b")).otherwise(F.concat(F.lit("bundle "), "bundle", F.lit("\n"), "b", F.lit("\nendBundle")))
    text = per.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("bundle", whole.alias("w")))).alias("x"))
    return text.select("doc", F.concat(F.lit("document\n"), F.array_join(F.transform("x", lambda e: e["w"]), "\n"), F.lit("\nendDocument")).alias("text"))


def dot(nodes: list[tuple[str, str]], edges: list[tuple[str, str, str]]) -> str:
    """Graphviz text of a small graph: (id, kind) and (src, dst, kind)."""
    shape = {"entity": "ellipse", "activity": "box", "agent": "house"}
    q = json.dumps
    return "\n".join(["digraph prov {", *(f" {q(i)} [shape={shape.get(k, 'plain')}];" for i, k in nodes), *(f" {q(a)} -> {q(b)} [label={q(k)}];" for a, b, k in edges), "}"])
