"""Exact top-k by inner product, pruned with segment statistics of several resolutions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, stored, table

LEVELS = (4, 16)  # segments per vector, coarse to fine
QUERIES_AT_ONCE = 256
DENSE = 8  # with one pair in so many left, a whole product costs less than picking pairs
EXACT = float(1 << 53)


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, times the root of its length.

    For two vectors the squared distance is at least the squared distance of these rows, because in
    each segment the parts around the means differ by at least the difference of their deviations.
    So the inner product is at most the inner product of these rows.
    """
    cuts = np.array_split(np.arange(vectors.shape[1]), min(segments, vectors.shape[1]))
    columns = []
    for cut in cuts:
        part = vectors[:, cut]
        root = np.sqrt(len(cut))
        columns += [part.mean(1) * root, part.std(1) * root]
    return np.stack(columns, 1)


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), infinite where that is beyond a double."""
    with np.errstate(over="ignore"):
        return np.floor(scale * vectors)


def whole(x: float, scale: int) -> int:
    """floor(scale * x) in full; from 2**53 on a double is a whole number itself."""
    product = scale * float(x)
    return int(np.floor(product)) if abs(product) < float("inf") else scale * int(x)


def exact_scores(a: np.ndarray, b: np.ndarray, scale: int = 1) -> np.ndarray:
    """Row by row inner products of whole numbers, or of floor(scale * x). Beyond 2**53 in exact whole
    numbers, and beyond 64 bits held at the limits of a long."""
    x, y = scaled(a, scale), scaled(b, scale)
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
    out = np.zeros(len(a), np.int64)
    small = size < EXACT
    out[small] = np.einsum("ij,ij->i", x[small], y[small]).astype(np.int64)
    for i in np.flatnonzero(~small):
        total = sum(whole(v, scale) * whole(w, scale) for v, w in zip(a[i], b[i]))
        out[i] = max(-(1 << 63), min((1 << 63) - 1, total))
    return out


class Best:
    """The k best (score, id) of each query so far: higher scores, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)  # a query's k-th score, once it has k

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.isin(self.query, query)
        q = np.concatenate((self.query[touched], query))
        i = np.concatenate((self.id[touched], ids))
        s = np.concatenate((self.score[touched], score))
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, without overflow
        q, i, s = q[order], i[order], s[order]
        start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
        kept = place < self.k
        last = place == self.k - 1
        self.least[q[last]] = s[last]
        self.query = np.concatenate((self.query[~touched], q[kept]))
        self.id = np.concatenate((self.id[~touched], i[kept]))
        self.score = np.concatenate((self.score[~touched], s[kept]))


class Searcher:
    """Finds the best of some queries among candidates that come in batches.

    For every batch the candidates with the greatest coarse bounds are scored first, which gives each
    query a k-th score; the bounds, coarse to fine, then meet that score. ``asked`` and ``left``
    count pairs, and those that no bound ruled out.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, scale: int = 1):
        self.ids, self.raw, self.scale = ids, vectors, scale
        self.vectors = scaled(vectors, scale)
        self.asked = self.left = 0
        with np.errstate(over="ignore", invalid="ignore"):
            self.statistics = [segment_statistics(self.vectors, n) for n in LEVELS]
        self.blocks = [
            (at, Best(min(QUERIES_AT_ONCE, len(ids) - at), k))
            for at in range(0, len(ids), QUERIES_AT_ONCE)
        ]

    def _score(self, best: Best, at: int, q, c, ids, vectors, raw) -> None:
        """Exact scores of pairs (query, candidate), a bounded number at a time."""
        finite = np.isfinite(vectors).all() and np.isfinite(self.vectors).all()
        for begin in range(0, len(q), 1 << 16):
            qs, cs = q[begin : begin + (1 << 16)], c[begin : begin + (1 << 16)]
            if finite:
                scores = exact_scores(self.vectors[at + qs], vectors[cs])
            else:
                scores = exact_scores(self.raw[at + qs], raw[cs], self.scale)
            good = scores >= best.least[qs]
            if good.any():
                best.add(qs[good], ids[cs[good]], scores[good])

    def see(self, ids: np.ndarray, raw: np.ndarray) -> None:
        # Sums beyond a double become infinite or undefined, and such a bound rules nothing out.
        with np.errstate(over="ignore", invalid="ignore"):
            self._see(ids, raw, scaled(raw, self.scale))

    def _see(self, ids: np.ndarray, raw: np.ndarray, vectors: np.ndarray) -> None:
        statistics = [segment_statistics(vectors, n) for n in LEVELS]
        sizes = np.sqrt((vectors * vectors).sum(1))
        for at, best in self.blocks:
            to = at + len(best.least)
            own, k = self.vectors[at:to], best.k
            own_sizes = np.sqrt((own * own).sum(1))
            # Room for rounding in the bounds; the scores themselves are exact.
            slack = 1e-9 * own_sizes.max(initial=0) * sizes.max(initial=0) + 1e-6
            alive = self.ids[at:to, None] != ids[None, :]
            self.asked += np.count_nonzero(alive)
            if alive.shape[1] > k:
                coarse = np.where(alive, self.statistics[0][at:to] @ statistics[0].T, -np.inf)
                c = np.argpartition(coarse, -k, axis=1)[:, -k:].ravel()
                q = np.repeat(np.arange(len(own)), k)
                q, c = q[alive[q, c]], c[alive[q, c]]
                self._score(best, at, q, c, ids, vectors, raw)
                alive[q, c] = False
                self.left += len(q)
            floor = best.least - slack
            for mine, theirs in zip(self.statistics, statistics):
                if np.count_nonzero(alive) * DENSE < alive.size:
                    # Few pairs are left: bound each of them on its own.
                    q, c = np.nonzero(alive)
                    below = np.einsum("ij,ij->i", mine[at:to][q], theirs[c]) < floor[q]
                    alive[q[below], c[below]] = False
                else:
                    alive &= ~(mine[at:to] @ theirs.T < floor[:, None])
            left = np.count_nonzero(alive)
            self.left += left
            if left * DENSE >= alive.size and own_sizes.max() * sizes.max() < EXACT:
                # Whole numbers below 2**53: the product of the matrices is exact.
                scores = own @ vectors.T
                scores[~alive] = -np.inf
                least = best.least
                if scores.shape[1] > k:
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                q, c = np.nonzero((scores >= least[:, None]) & alive)
                best.add(q, ids[c], scores[q, c].astype(np.int64))
                continue
            self._score(best, at, *np.nonzero(alive), ids, vectors, raw)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (
            np.concatenate([self.ids[at:][b.query] for at, b in self.blocks]),
            np.concatenate([b.id for _, b in self.blocks]),
            np.concatenate([b.score for _, b in self.blocks]),
        )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 64,
    block: int = 16_384,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest integer inner product, for each query row.

    Components become floor(scale * x). One row per result: query_id, rank, vec_id, score; ties go to
    the smaller key. Vectors that are null or hold null or non-finite components, and rows without a
    key, take no part. Only vectors of equal length are compared. A row is never its own result, nor
    are others with its key; repeated candidates count each, repeated queries once (with the smaller
    vector). Empty tables give no rows. Scores beyond a long are held at its limits;
    components whose product with ``scale`` is beyond a double count in full, as whole numbers.

    Queries go in blocks of about ``block`` rows, each broadcast to one pass over all candidates;
    every task keeps k results per query and those are merged. Pruning only skips candidates whose
    bound is below a query's k-th score, so results are exact.
    """
    spark = vectors.sparkSession

    def usable(frame: DataFrame) -> DataFrame:
        finite = F.forall(
            "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        )
        return frame.select(
            F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector")
        ).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite)

    candidates = usable(vectors)
    asked = usable(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = stored(asked)
    blocks = -(-asked.count() // block)
    found: DataFrame | None = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        by_length: dict[int, list] = {}
        for r in rows:
            by_length.setdefault(len(r["vector"]), []).append((r["id"], r["vector"]))
        sent = spark.sparkContext.broadcast(
            {
                n: (
                    np.array([i for i, _ in group], np.int64),
                    np.array([v for _, v in group], float).reshape(-1, n),
                )
                for n, group in by_length.items()
            }
        )

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searchers = {n: Searcher(*group, k, scale) for n, group in sent.value.items() if n}
            for batch in batches:
                lists, ids = batch.column("vector"), batch.column("id").to_numpy()
                lengths = pa.compute.list_value_length(lists).to_numpy()
                for n, searcher in searchers.items():
                    at = np.flatnonzero(lengths == n)
                    for begin in range(0, len(at), 2048):
                        chosen = at[begin : begin + 2048]
                        flat = lists.take(pa.array(chosen)).flatten().to_numpy()
                        searcher.see(ids[chosen], flat.reshape(-1, n))
            for searcher in searchers.values():
                for column in [searcher.rows()]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in column], ["query_id", "vec_id", "score"]
                    )

        part = candidates.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        part = _first(part, k)
        if blocks > 1:
            part = stored(part)
        found = part if found is None else found.unionByName(part)
    if found is None:
        schema = "query_id bigint, rank int, vec_id bigint, score bigint"
        return spark.createDataFrame([], schema)
    return found


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op5_exact_top_k", TOP_K_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))
