"""Checkpointed streaming compactor for far too many small files.

A file-source stream discovers each input once and hands over what is there in
batches. A batch is parsed, cut to one row per record key, freed of keys that
earlier batches hold, and written to a folder named by its batch number. The
number and what belongs to it are in the stream's checkpoint before any work
starts, so a batch that is tried again - after a lost executor or driver - does
the same work on the same files and replaces its folder: no record is lost or
doubled. Nothing is ever appended to a folder.

Each batch leaves as few files as its size asks for: ``target_bytes`` of what is
written, which is ``packed`` times smaller than what was read. Within a batch the
earliest copy of a record (by the order columns) is kept; a key that an earlier
batch holds keeps that batch's copy.

The store is its own memory of keys. Files are sorted by key and carry a Bloom
filter of its first column, and a batch asks earlier ones only for the values of
that column it holds itself (a run delivers its files together), so of a long
history just the row groups that may hold such keys are read. A batch with more
than ``MOST_VALUES`` of them reads all keys; the result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, exists, folders, is_file

TARGET_BYTES = 128 << 20
FILES_PER_BATCH = 4096
#: Bytes of text in small files for a byte of the store, as measured on timing files.
PACKED = 8.0
#: So many values of the first key column are pushed down to the scan of earlier batches.
MOST_VALUES = 2_000


def _batch_path(store: str, batch: int) -> str:
    return f"{store}/batch={batch:09d}"


def compact(
    spark: SparkSession,
    source: str,
    store: str,
    checkpoint: str,
    parse: Callable[[DataFrame], DataFrame],
    key: list[str],
    order: list[str],
    weight: Callable[[DataFrame], object],
    target_bytes: int = TARGET_BYTES,
    files_per_batch: int = FILES_PER_BATCH,
    packed: float = PACKED,
) -> DataFrame:
    """Take in what ``source`` holds and hasn't been taken; return the whole store.

    ``parse`` turns a batch of input rows into records; ``weight`` is the
    aggregate that gives a batch's size in bytes. Null key parts are equal to
    each other. Call it again, with the same folders, whenever files have come.
    """
    schema = spark.read.parquet(source).schema
    probe = parse(spark.createDataFrame([], schema)).schema
    work = Scratch(spark, "compact")

    def take(batch: DataFrame, number: int) -> None:
        size = batch.agg(weight(batch).alias("b")).first()["b"] or 0
        found = parse(batch)
        values = [c for c in found.columns if c not in key]
        first = found.groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*key, "_v.*")
        old = [f"{store}/{n}" for n in folders(spark, store) if n.startswith("batch=") and int(n[6:]) < number]
        if old:
            held = spark.read.schema(probe).parquet(*old).select(*(F.col(k).alias(f"_{k}") for k in key))
            first, _ = work.write(first)
            values = [r[0] for r in first.select(key[0]).distinct().limit(MOST_VALUES + 1).collect()]
            if len(values) <= MOST_VALUES:
                lead = F.col(f"_{key[0]}")
                held = held.where(lead.isin([v for v in values if v is not None]) | (lead.isNull() if None in values else F.lit(False)))
            first = first.join(held, [first[k].eqNullSafe(held[f"_{k}"]) for k in key], "left_anti")
        files = max(1, math.ceil(size / packed / target_bytes))
        out = first.select(probe.names).coalesce(files).sortWithinPartitions(*key).write.mode("overwrite").option("compression", "zstd")
        out.option(f"parquet.bloom.filter.enabled#{key[0]}", "true").parquet(_batch_path(store, number))
        work.clear()

    if is_file(spark, source):  # a stream's source is a folder or a pattern
        source = f"{source[:-1]}[{source[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not exists(spark, store):
        return spark.createDataFrame([], probe)
    # reading by the folder's root would add the batch number as a column; it is dropped
    return spark.read.schema(probe).option("recursiveFileLookup", "true").parquet(store)


def compact_timing_files(spark: SparkSession, source: str, store: str, checkpoint: str, **more) -> DataFrame:
    """Timing CSV files (``timing_files`` rows) to one table that holds each record once."""
    from ..sources.timing_csv import parse

    return compact(
        spark,
        source,
        store,
        checkpoint,
        parse=lambda b: parse(b, "file_name", "content", ["run_id", "file_id", "modified_at"]),
        key=["run_id", "pe_id", "rank", "layout", "iteration_index"],
        order=["modified_at", "file_id"],
        weight=lambda b: F.sum(F.length(b["content"])),
        **more,
    )


def timing_records(store: DataFrame) -> DataFrame:
    """(run_id, pe_id, rank, iteration_index) of a store; index 0 for per-instance records."""
    index = F.when(F.col("layout") == "instance", F.lit(0)).otherwise(F.expr("try_cast(iteration_index as bigint)")).cast("bigint")
    return store.select("run_id", "pe_id", "rank", index.alias("iteration_index")).distinct()
