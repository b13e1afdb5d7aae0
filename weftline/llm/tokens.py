"""Token counts with a public tokenizer, in Arrow batches.

The vocabulary file's path is a parameter; the driver reads it and sends its text
along, so executors need no file of their own. It is loaded once for each Python worker.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that belongs to the vocabulary's merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this are encoded in pieces, so that no single call grows without bound. They are cut
#: only after a letter before something else, where the pattern always starts anew: counts are the same.
PIECE = 1 << 20


@lru_cache(maxsize=4)
def encoding(path: str):
    with open(path, "rb") as f:
        return _encoding(f.read())


@lru_cache(maxsize=4)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not (text[end - 1].isalpha() and not text[end].isalpha()):
            end += 1
        out.append(text[at:end])
        at = end
    return out


def count_tokens(text: str, enc) -> int:
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    return sum(len(enc.encode_ordinary(x)) for x in pieces(text))


def token_counts(df: DataFrame, text: str, keep: dict, path: str = VOCABULARY) -> DataFrame:
    """Columns of ``keep`` (name to column) and ``n_tokens``; null texts have 0 tokens."""
    plain = df.select(*(c.alias(k) for k, c in keep.items()), df[text].alias("_text"))

    names = [*keep, "n_tokens"]
    with open(path, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())  # under a megabyte

    def run(batches):
        enc = _encoding(vocabulary.value)
        for b in batches:
            n = [count_tokens(t, enc) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(n, pa.int64())], names)

    schema = plain.drop("_text").withColumn("n_tokens", F.lit(0).cast("bigint")).schema
    return spread(plain).mapInArrow(run, schema)
