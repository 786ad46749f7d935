"""Token counts by a two-tier lookup on the map side."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, slices, table, utf8, worker_state
from .pretokens import Cache, runs

TOKENIZER = "word_bpe_49k.json"


def n_ids(ids: bytes) -> int:
    return len(ids) // 4


def _summary(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                seen.update(runs(text))
            if len(seen) > 64 * most:
                seen = Counter(dict(seen.most_common(16 * most)))
        top = seen.most_common(most)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())],
            ["pretoken", "n"],
        )

    return run


def frequent_pretokens(documents: DataFrame, text: str = "text", entries: int = 4096) -> list[bytes]:
    """The most frequent pre-tokens over all texts, ``entries`` at most.

    Each task sums up its own texts and hands on its ``entries`` most frequent pre-tokens, so what
    is moved does not grow with the texts of a task. The choice affects speed, never a count.
    """
    summaries = documents.select(utf8(text).alias("text")).mapInArrow(
        _summary(entries), "pretoken binary, n bigint"
    )
    top = summaries.groupBy("pretoken").agg(F.sum("n").alias("n"))
    rows = top.orderBy(F.desc("n"), "pretoken").limit(entries).collect()
    return [bytes(r.pretoken) for r in rows]


def token_counts(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    tokenizer: str = TOKENIZER,
    limit: int = 2048,
    entries: int = 4096,
) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it exceeds ``limit`` tokens.

    Tier one is a broadcast hash table with the lengths of the corpus's most frequent pre-tokens
    (``entries`` of them, a fixed size); tier two is a bounded cache in each Python worker, filled
    by encoding only pre-tokens not met before. No pre-token is ever shuffled.

    Null and empty texts have 0 bytes and 0 tokens; a null key stays null; repeated rows are each
    counted; an empty table gives an empty result. Other columns are not read.
    """
    first = frequent_pretokens(documents, text, entries)
    lengths = dict.fromkeys(first, 0)
    lengths.update(zip(first, map(Cache(tokenizer, n_ids).of([first]), first)))
    spark = documents.sparkSession
    frequent, name = spark.sparkContext.broadcast(lengths), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state((name, tokenizer), lambda: Cache(tokenizer, n_ids, frequent.value))
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            split = [runs(t) for t in texts]
            length = cache.of(split)
            tokens = [sum(map(length, words)) for words in split]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["key", "n_bytes", "n_tokens", "over_limit"],
            )

    source = documents.select(F.col(key).alias("key"), utf8(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    counted = source.mapInArrow(
        run, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
    return counted.withColumnRenamed("key", key)


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
