"""Lineage and run records, filters on derivations, sinks and summaries."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DERIVATION = "struct<port:string,DerivedFromDatasetID:string,TriggeredByProcessIterationID:string,prov_cluster:string,iterationIndex:bigint,lookupterm:string,assertionType:string>"
STREAM = "struct<content:array<map<string,string>>,id:string,format:string,location:string,port:string,annotations:array<string>,size:bigint,immediateAccess:boolean,firstKnownDestination:string>"
LINEAGE = (
    "_id string, iterationId string, actedOnBehalfOf string, instanceId string, worker string, pid string, errors string, name string, runId string, username string, "
    "type string, mapping string, prov_cluster string, creator string, iterationIndex bigint, stateful boolean, feedbackIteration boolean, startTime timestamp, endTime timestamp, "
    f"parameters map<string,string>, annotations map<string,string>, derivationIds array<{DERIVATION}>, streams array<{STREAM}>"
)
RUN = (
    "_id string, runId string, sessionId string, username string, workflowId string, description string, system_id string, workflowName string, mapping string, type string, "
    "prov_type string, status string, startTime timestamp, endTime timestamp, input array<map<string,string>>, modules array<string>, source map<string,string>, ns map<string,string>"
)


@dataclass
class LineageConfig:
    """Settings of a run with lineage. ``user`` defaults to anonymous; the save mode follows from what is given."""

    workflow_id: str
    workflow_name: str
    user: str = "anonymous"
    run_id: str = ""
    session_id: str = ""
    description: str = ""
    path: str | None = None
    bulk_size: int = 1000
    rules: dict = field(default_factory=dict)
    transfer_rules: dict = field(default_factory=dict)
    clusters: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.workflow_id or not self.workflow_name:
            raise ValueError("lineage needs a workflow id and a workflow name")
        self.user = self.user or "anonymous"
        self.run_id = self.run_id or f"run-{uuid.uuid4()}"

    @property
    def save_mode(self) -> str:
        return "file" if self.path else "frame"


# fixed values: keys of a lineage configuration file
CONFIG_KEYS = {
    "s-prov:workflowId": "workflow_id",
    "s-prov:workflowName": "workflow_name",
    "s-prov:description": "description",
    "s-prov:run-id": "run_id",
    "s-prov:sel-rules": "rules",
    "s-prov:transfer-rules": "transfer_rules",
    "provone:User": "user",
}


def load_config(source: str | dict, **more) -> LineageConfig:
    """From a mapping, JSON text or a JSON file; unknown keys are ignored."""
    if isinstance(source, str):
        source = json.loads(Path(source).read_text() if Path(source).is_file() else source)
    found = {CONFIG_KEYS[k]: v for k, v in source.items() if k in CONFIG_KEYS}
    return LineageConfig(**(found | {k: v for k, v in more.items() if v is not None}))


def run_record(spark: SparkSession, cfg: LineageConfig, graph=None, status: str = "active") -> DataFrame:
    """The run's one row."""
    modules = [n.name for n in graph.flatten().nodes] if graph is not None else []
    row = (
        cfg.run_id, cfg.run_id, cfg.session_id or None, cfg.user, cfg.workflow_id, cfg.description or None, None, cfg.workflow_name, "spark",
        "workflow_run", None, status, datetime.now(UTC), None, [], modules, {m: "node" for m in modules}, {},
    )
    return spark.createDataFrame([row], RUN)


def update_run(run: DataFrame, status: str) -> DataFrame:
    """The run's row with another status, and its end if it has ended; written beside the first, the later row counts."""
    ended = F.lit(status).isin("terminated", "failed")
    return run.withColumn("status", F.lit(status)).withColumn("endTime", F.when(ended, F.current_timestamp()))


def lineage_of(df: DataFrame, cfg: LineageConfig, node: str, ident: str, derived: Column, metadata: Column | None = None, index: Column | None = None, port: str = "output", skip: Column | None = None, input_port: str = "input", fmt: str | None = None, location: Column | None = None, size: Column | None = None, started: Column | None = None, ended: Column | None = None, state: Column | None = None) -> DataFrame:
    """Lineage rows of a node's output: one for each datum whose metadata the node's rules keep.

    ``derived`` is an array of the ids it derives from; ``metadata`` a map<string,string>.
    Where ``skip`` holds nothing is recorded. ``state`` is an array of (term, id)
    structs, the state entities it derives from besides.
    """
    from .rules import keeps_map

    meta = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    keep = keeps_map(meta, cfg.rules.get(node, {}).get("rules", {})) if cfg.rules.get(node) else F.lit(True)
    if skip is not None:
        keep = keep & ~F.coalesce(skip, F.lit(False))
    null = lambda t: F.lit(None).cast(t)
    did = F.col(ident).cast("string")
    each = F.transform(
        derived,
        lambda d: F.named_struct(
            F.lit("port"), F.lit(input_port), F.lit("DerivedFromDatasetID"), d.cast("string"), F.lit("TriggeredByProcessIterationID"), null("string"), F.lit("prov_cluster"), F.lit(cfg.clusters.get(node, node)),
            F.lit("iterationIndex"), null("bigint"), F.lit("lookupterm"), null("string"), F.lit("assertionType"), null("string"),
        ),
    )
    if state is not None:
        states = F.transform(
            state,
            lambda d: F.named_struct(
                F.lit("port"), null("string"), F.lit("DerivedFromDatasetID"), d["id"].cast("string"), F.lit("TriggeredByProcessIterationID"), null("string"), F.lit("prov_cluster"), F.lit(cfg.clusters.get(node, node)),
                F.lit("iterationIndex"), null("bigint"), F.lit("lookupterm"), d["term"].cast("string"), F.lit("assertionType"), F.lit("past_flow"),
            ),
        )
    stream = F.named_struct(
        F.lit("content"), F.array(meta), F.lit("id"), did, F.lit("format"), F.lit(fmt).cast("string"), F.lit("location"), (null("string") if location is None else location.cast("string")), F.lit("port"), F.lit(port),
        F.lit("annotations"), null("array<string>"), F.lit("size"), (null("bigint") if size is None else size.cast("bigint")), F.lit("immediateAccess"), F.lit(False), F.lit("firstKnownDestination"), null("string"),
    )
    values = {
        "_id": F.concat_ws("_", F.lit(cfg.run_id), F.lit(node), did), "iterationId": F.concat_ws("_", F.lit(node), did), "name": F.lit(node), "runId": F.lit(cfg.run_id),
        "username": F.lit(cfg.user), "type": F.lit("lineage"), "mapping": F.lit("spark"), "prov_cluster": F.lit(cfg.clusters.get(node, node)), "creator": F.lit(cfg.user),
        "instanceId": F.lit(node), "iterationIndex": (index if index is not None else null("bigint")).cast("bigint"), "feedbackIteration": F.lit(False),
        "derivationIds": each if state is None else F.concat(each, states), "streams": F.array(stream), "stateful": F.lit(state is not None),
        "startTime": null("timestamp") if started is None else started, "endTime": null("timestamp") if ended is None else ended,
    }
    cols = []
    for part in df.sparkSession.createDataFrame([], LINEAGE).schema:
        cols.append(values.get(part.name, F.lit(None)).cast(part.dataType).alias(part.name))
    return df.where(keep).select(*cols)


def package(derivations: Column, ignore_inputs: Column, ignore_past_flow: Column, ignore_state: Column) -> Column:
    """The derivations that a record keeps: none of the inputs, none of the past flow, none of the state, or all, in this priority."""
    kind = lambda x: F.coalesce(x["assertionType"], F.lit(""))
    return (
        F.when(ignore_inputs, F.filter(derivations, lambda d: d["lookupterm"].isNotNull()))
        .when(ignore_past_flow, F.filter(derivations, lambda d: kind(d) != "past_flow"))
        .when(ignore_state, F.filter(derivations, lambda d: d["lookupterm"].isNull()))
        .otherwise(derivations)
    )


def envelope(df: DataFrame, own: str, parent: str, recorded: Column) -> DataFrame:
    """Ids carried beside data: the own one, or the first parent's marked incomplete where nothing was recorded."""
    return df.withColumn("prov_id", F.when(recorded, F.col(own)).otherwise(F.coalesce(parent, own))).withColumn("incomplete", ~recorded)


def write_lineage(records: DataFrame, path: str, fmt: str = "json", files: int | None = None) -> None:
    """Record sink: bulk files by run, JSON or Parquet."""
    out = records if files is None else records.coalesce(files)
    out.write.mode("append").partitionBy("runId").format(fmt).save(path)


def cluster_summary(records: DataFrame, keys: list[str], start: str, end: str, aggregates: dict[str, Column]) -> DataFrame:
    """First start, last end and more, for each provenance cluster and run."""
    return records.groupBy(*keys).agg(F.min(start).alias("s"), F.max(end).alias("e"), *(c.alias(k) for k, c in aggregates.items()))


def prune(m: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(m, lambda _, v: v.isNotNull() & (F.length(v) > 0))


def number(text: Column) -> Column:
    """Text as a number; null where it is none."""
    return text.try_cast("double")


def safe_call(fn):
    """A Python function that gives (value, error) instead of failing its row."""

    def run(x):
        try:
            return fn(x), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    return run
