"""Small scalar functions used by workflows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(text: str) -> str:
    """A file name from any text: runs of other characters become one underscore."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", text).strip("_")


def safe_name_col(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def digits(text: Column) -> Column:
    """The first run of digits as a number; null without one."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint")


def double_items(numbers: Column) -> Column:
    return F.transform(numbers, lambda x: x * 2)


def stable_hash(*cols: Column) -> Column:
    """The same in every process and run."""
    return F.xxhash64(*cols)


def size_of(text: Column) -> Column:
    return F.octet_length(text)


def to_payload(*cols: str) -> Column:
    return F.to_json(F.struct(*cols))


def from_payload(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def first_chars(text: Column, n: int = 300) -> Column:
    return F.substring(text, 1, n)
