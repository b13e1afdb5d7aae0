"""Records of tiny timing CSV files whose text stands in a column.

Everything is Column expressions: no Python runs per file. A file's separator
is the first of the candidates that splits its first line in five; its first
line is a header if its names are those of a layout, in any order. Header lines
repeated further down are skipped. Without a header the file's name decides the
layout. A record is any other line with exactly five fields; short lines (files
cut off) and long ones are none. Fields lose surrounding blanks, and quotes with
doubled quotes inside; a byte-order mark is dropped. Null, empty and blank texts
hold no record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the two layouts of timing files
INSTANCE_LAYOUT = ["pe_id", "rank", "count", "total_secs", "avg_secs"]
ITERATION_LAYOUT = ["pe_id", "rank", "instance_id", "iteration_index", "iteration_secs"]
ITERATION_PREFIX = "timing_iterations_"
SEPARATORS = [",", ";", "\t", "|"]


def split_fields(line, sep: str):
    """Fields of one CSV line as an array, less quotes and surrounding blanks."""
    c = "\\" + sep if sep == "|" else sep
    raw = F.regexp_extract_all(line, F.lit(rf'(?:^|{c})([ \t]*"(?:[^"]|"")*"[ \t]*(?=$|{c})|[^{c}]*)'), 1)

    def clean(x):
        t = F.trim(F.regexp_replace(x, r"[\t]", " "))
        inner = F.trim(F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"')))
        return F.when(t.startswith('"') & t.endswith('"') & (F.length(t) >= 2), inner).otherwise(t)

    return F.transform(raw, clean)


def _is_header(fields, layout: list[str]):
    return F.array_sort(F.transform(fields, lambda x: F.lower(x))) == F.array(*(F.lit(x) for x in sorted(layout)))


def parse(files: DataFrame, name: str, content: str, keep: list[str]) -> DataFrame:
    """One row per record: ``keep`` columns, ``layout`` and the fields of both layouts as text."""
    text = F.regexp_replace(files[content], "^[\\s﻿]+", "")
    base = files.select(
        *(files[k] for k in keep),
        F.regexp_extract(files[name], r"([^/\\]*)$", 1).startswith(ITERATION_PREFIX).alias("_named"),
        F.filter(F.split(text, "\r\n|\n|\r"), lambda x: F.length(F.trim(F.regexp_replace(x, r"\s", " "))) > 0).alias("_lines"),
    ).where(F.size("_lines") > 0)
    first = F.element_at("_lines", 1)
    sep = F.coalesce(*(F.when(F.size(split_fields(first, s)) == 5, F.lit(s)) for s in SEPARATORS), F.lit(SEPARATORS[0]))
    split = lambda line: reduce(lambda rest, s: F.when(F.col("_sep") == s, split_fields(line, s)).otherwise(rest), SEPARATORS[1:], split_fields(line, SEPARATORS[0]))
    head = base.withColumn("_sep", sep).withColumn("_head", split(first))
    known = _is_header(F.col("_head"), INSTANCE_LAYOUT) | _is_header(F.col("_head"), ITERATION_LAYOUT)
    default = F.when(F.coalesce("_named", F.lit(False)), F.array(*map(F.lit, ITERATION_LAYOUT))).otherwise(F.array(*map(F.lit, INSTANCE_LAYOUT)))
    lines = (
        head.withColumn("_order", F.when(known, F.transform("_head", lambda x: F.lower(x))).otherwise(default))
        .select(*keep, "_sep", "_order", F.explode("_lines").alias("_line"))
        .withColumn("_f", split(F.col("_line")))
        .where((F.size("_f") == 5) & ~_is_header(F.col("_f"), INSTANCE_LAYOUT) & ~_is_header(F.col("_f"), ITERATION_LAYOUT))
        .withColumn("_m", F.map_from_arrays("_order", "_f"))
    )
    names = list(dict.fromkeys(INSTANCE_LAYOUT + ITERATION_LAYOUT))
    return lines.select(*keep, F.when(F.array_contains("_order", "iteration_index"), F.lit("iteration")).otherwise(F.lit("instance")).alias("layout"), *(F.try_element_at("_m", F.lit(n)).alias(n) for n in names))
