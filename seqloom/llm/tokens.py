"""Token counts through a cache of content digests.

The cache is a parquet table of (content digest, tokenizer digest, count). Texts are looked
up by digest, one text of each missing digest is encoded, and the new counts are appended.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from seqloom.session import materialise

#: Texts encoded in one call.
BATCH = 64
CACHE = "content binary, tokenizer string, n_tokens long"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """Names the vocabulary file's content and the library's version."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + f"{library} {version(library)}".encode()).hexdigest()


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of whole texts without added special tokens; once per worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of rows (content, text)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for batch in batches:
            column = batch.column("text")
            found = np.empty(batch.num_rows, np.int64)
            for start in range(0, batch.num_rows, BATCH):
                part = column.slice(start, BATCH).to_pylist()
                found[start : start + len(part)] = count(part)
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(found)], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(apply, "content binary, n_tokens long")


def read_cache(spark, cache: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer; an unwritten cache is empty."""
    try:
        table = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], CACHE)
    own = table.filter(F.col("tokenizer") == tokenizer)
    # appends of runs side by side may repeat a digest, always with the same count
    return own.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, path: str, limit: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit; fills the cache.

    Counts are the library's own for whole texts without added special tokens, truncation
    or padding; special strings inside a text are handled as its default. Null is empty.
    Only the null-for-empty change is made before the digest, as any other would change
    counts. ``cache`` is a folder all executors share. Further columns are ignored.
    """
    spark, tokenizer = docs.sparkSession, tokenizer_digest(path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    content = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content")
    known = read_cache(spark, cache, tokenizer)
    # copies meet before the shuffle, so a text that a third of all rows hold stays one row a task
    distinct = rows.select(content, "text").groupBy("content").agg(F.first("text").alias("text"))
    missing = distinct.join(known, "content", "left_anti")
    added = encode_counts(missing, path).select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens")
    added.write.mode("append").parquet(cache)
    # written, so that the join reads plain tables and Spark can split a hot digest
    counts = materialise(read_cache(spark, cache, tokenizer), "counts")
    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content)
    return sized.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
