"""Sizes of texts in tokens of a public tokenizer, for problems 6 and 7."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pattern that splits texts before byte-pair merges; fixed with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def tokenizer_path(spark: SparkSession) -> str:
    """Path of the vocabulary file on all machines; spark.meshwright.tokenizer names another."""
    return spark.conf.get("spark.meshwright.tokenizer", DEFAULT_TOKENIZER)


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    """Sources compare trimmed and ignoring case; null and blank are the source ''."""
    return F.coalesce(F.lower(F.trim(source)), F.lit(""))


def token_sizes(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n_tokens of all documents whose text is not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), sizes], ["doc_id", "source", "n_tokens"])

    texts = documents.filter("text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), "text")
    return texts.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")
