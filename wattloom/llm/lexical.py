"""Exact ranked lexical search: sparse ball trees with centroid-radius bounds, searched best-first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, slices, stored, table, utf8
from .spans import Texts, lookup, numbered

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IN_TERM = ~lookup(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
IN_TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SCALE, SATURATION, FLAT, SLOPE = 1_000_000_000, 20, 50, 50  # the score's fixed whole numbers
TREE_DOCS, TREE_CELLS, LEAF = 1024, 1 << 22, 16
GROUP = 4  # terms that share a radius
LARGEST = (1 << 63) - 1


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# --- documents over the terms of the items -------------------------------------------------------


def _projected(batches: Iterator[pa.RecordBatch], terms: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Each document's length and its counts of ``terms``; last, the task's sums over all documents.

    A row with ``docs`` set holds such sums: documents with terms, all their terms, and documents by
    term.
    """
    place = {term: i for i, term in enumerate(terms)}
    docs = length = 0
    holding = np.zeros(len(terms), np.int64)
    for batch in slices(batches, "body"):
        texts = Texts(batch.column("body"))
        inside = IN_TERM[texts.data]
        begin, end = texts.words(inside)
        owners = texts.owner(begin)
        ids = numbered(LOWER[texts.data[inside]], end - begin)
        known = np.array([place.get(t, -1) for t in ids.dictionary.to_pylist()], np.int64)
        at = known[ids.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        sizes = np.bincount(owners, minlength=len(texts))
        docs, length = docs + int((sizes > 0).sum()), length + len(owners)
        cells, counts = np.unique(
            owners[at >= 0] * len(terms) + at[at >= 0], return_counts=True
        )
        rows, columns = np.divmod(cells, max(1, len(terms)))
        holding += np.bincount(columns, minlength=len(terms))
        ends = np.cumsum(np.bincount(rows, minlength=len(texts)))
        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        held = np.diff(np.concatenate(([0], ends))) > 0
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(texts), pa.int64()),
                batch.column("key"),
                pa.array(sizes.astype(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(columns.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
            ],
            ["docs", "key", "n", "term", "tf"],
        ).filter(pa.array(held))
    some = np.flatnonzero(holding)
    one = pa.array([0, len(some)], pa.int32())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([docs]),
            pa.nulls(1, pa.int64()),
            pa.array([length]),
            pa.ListArray.from_arrays(one, pa.array(some.astype(np.int32))),
            pa.ListArray.from_arrays(one, pa.array(holding[some])),
        ],
        ["docs", "key", "n", "term", "tf"],
    )


# --- trees ---------------------------------------------------------------------------------------


class BallTree:
    """Documents as whole-number rows in tree order; a node is a run of them.

    A node holds the centroid of its rows and, for each group of terms, the radius around it. For a
    query whose weights are ones, no row's inner product exceeds the sum over the groups of the
    centroid's part and the radius times the root of the number of the query's terms in the group.
    """

    def __init__(self, rows: np.ndarray, groups: np.ndarray):
        self.starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        self.order = np.arange(len(rows))
        self.nodes: list[tuple[int, int]] = []  # runs of rows
        self.children: list[tuple[int, int] | None] = []
        self.centroids: list[np.ndarray] = []
        self.radii: list[np.ndarray] = []
        self._grow(rows.astype(float), 0, len(rows))
        self.rows = rows[self.order]
        self.centre, self.radius = np.array(self.centroids), np.array(self.radii)

    def _grow(self, rows: np.ndarray, start: int, end: int) -> int:
        """Add the node of a run; ``rows`` are its rows, in order."""
        centre = rows.mean(0)
        squares = (rows - centre) ** 2
        self.nodes.append((start, end))
        self.children.append(None)
        self.centroids.append(centre)
        self.radii.append(np.sqrt(np.add.reduceat(squares, self.starts, axis=1).max(0)))
        node = len(self.nodes) - 1
        far = squares.sum(1)
        if end - start > LEAF and far.max() > 0:
            # Halves by how much nearer a row is to one of two rows far apart.
            a = rows[far.argmax()]
            b = rows[((rows - a) ** 2).sum(1).argmax()]
            side = np.argsort(rows @ (a - b), kind="stable")
            self.order[start:end] = self.order[start:end][side]
            half = len(side) // 2
            left = self._grow(rows[side[:half]], start, start + half)
            right = self._grow(rows[side[half:]], start + half, end)
            self.children[node] = (left, right)
        return node

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """By node and query (columns of zeros and ones), a whole number that no score exceeds.

        Rounding errors of sums of so many terms stay below the share added.
        """
        counts = np.add.reduceat(asked, self.starts, axis=0)
        most = self.centre @ asked + self.radius @ np.sqrt(counts)
        return np.ceil(most * (1 + (asked.shape[0] + 64) * 2.0**-50)) + 1


class Best:
    """The k best documents of one query so far: higher scores, ties to smaller keys."""

    def __init__(self, k: int):
        self.k, self.least = k, 1  # only scores above zero count
        self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        scores = np.concatenate((self.scores, scores[good]))
        keys = np.concatenate((self.keys, keys[good]))
        order = np.lexsort((keys, -scores))[: self.k]
        self.scores, self.keys = scores[order], keys[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


class Search:
    """Queries over trees that come one after the other; ``seen`` counts exact scores."""

    def __init__(self, queries: list[np.ndarray], k: int):
        self.queries = queries
        self.best = [Best(k) for _ in queries]
        self.seen = self.all = 0

    def see(self, keys: np.ndarray, rows: np.ndarray, terms: np.ndarray, groups: np.ndarray) -> None:
        """Documents (whole-number rows over ``terms``, ascending) of one tree."""
        places = [np.searchsorted(terms, q) for q in self.queries]
        places = [
            p[terms[np.minimum(p, len(terms) - 1)] == q] for p, q in zip(places, self.queries)
        ]
        tree = BallTree(rows, groups)
        asked = np.zeros((len(terms), len(self.queries)))
        for i, p in enumerate(places):
            asked[p, i] = 1
        keys = keys[tree.order]
        bounds = tree.bounds(asked)
        self.all += len(keys) * len(places)
        for i, (p, best) in enumerate(zip(places, self.best)):
            if len(p) and bounds[0, i] >= best.least:
                self._descend(tree, keys, p, bounds[:, i].tolist(), best)

    def _descend(self, tree: BallTree, keys, places, bounds: list[float], best: Best) -> None:
        waiting = [(-bounds[0], 0)]
        while waiting:
            bound, node = heapq.heappop(waiting)
            if -bound < best.least:
                return  # best first: all others are lower still
            if tree.children[node]:
                for child in tree.children[node]:
                    if bounds[child] >= best.least:
                        heapq.heappush(waiting, (-bounds[child], child))
            else:
                start, end = tree.nodes[node]
                self.seen += end - start
                best.add(tree.rows[start:end, places].sum(1), keys[start:end])


def _dense(held: list[pa.RecordBatch], weights: np.ndarray, n_docs: int, length: int):
    """Rows of one tree: documents by the terms they hold, each cell a term's part of the score."""
    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    sizes = batch.column("n").to_numpy()
    counts = pa.compute.list_value_length(batch.column("term")).to_numpy()
    columns = batch.column("term").flatten().to_numpy()
    tf = batch.column("tf").flatten().to_numpy()
    m = 100 - FLAT + (SLOPE * sizes * n_docs) // length
    row = np.repeat(np.arange(len(sizes)), counts)
    terms, at = np.unique(columns, return_inverse=True)
    rows = np.zeros((len(sizes), len(terms)), np.int64)
    rows[row, at] = weights[columns] * ((SCALE * tf) // (1000 * tf + SATURATION * m[row]))
    return batch.column("key").fill_null(LARGEST).to_numpy(), rows, terms


def _groups_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches cut and gathered into groups of ``most`` rows; the last may be smaller."""
    held, count = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most - count)
            held.append(part)
            at, count = at + part.num_rows, count + part.num_rows
            if count == most:
                yield held
                held, count = [], 0
    if held:
        yield held


def _searched(
    batches: Iterator[pa.RecordBatch], k, ids, queries, weights, groups, n_docs, length
) -> Iterator[pa.RecordBatch]:
    search = Search(queries, k)
    most = max(64, min(TREE_DOCS, TREE_CELLS // max(1, len(weights))))
    for held in _groups_of(batches, most):
        keys, rows, terms = _dense(held, weights, n_docs, length)
        search.see(keys, rows, terms, groups[terms])
    for item, best in zip(ids, search.best):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(best.keys), item)), pa.array(best.keys), pa.array(best.scores)],
            ["item", "key", "score"],
        )


def vocabulary(items: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """Terms in the order in which the items bring them, and their groups.

    Terms that come with one item share groups of at most ``GROUP``, so that a radius speaks of the
    terms that one query asks for together.
    """
    terms: dict[str, int] = {}
    for i, item in enumerate(items):
        new = [term for term in item if term not in terms]
        terms.update((term, (i << 32) + n // GROUP) for n, term in enumerate(new))
    return list(terms), np.array(list(terms.values()), np.int64)


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_terms: int = 32_768,
) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` for each item: item, rank, key, score.

    Terms are runs of ASCII letters and digits and of all other code points above U+007F, with A-Z in
    lower case. N documents hold a term, L terms in all with repeats; a term that df documents hold
    weighs floor(1000 * ln((2N + 2) / (2df + 1))). A document of n terms scores, for each distinct term
    of the item that it holds tf times, the weight times (10**9 * tf) div (1000 * tf + 20 * m), with
    m = 50 + (50 * n * N) div L. Only scores above 0 are returned; ties go to the smaller key. A null
    or empty text has no term; a null key is the largest; rows that share a key each count; items that
    share a key are one item with the terms of all, items without a key or term are left out. Empty
    tables give no rows. Columns of other names are ignored.

    Only terms of the items can add to a score, so a document is stored as a sparse vector over them.
    Each task builds ball trees over about a thousand such vectors at a time and searches them
    best-first for every item; a subtree is left out only where its bound, rounded upwards, is below
    the item's k-th score so far, so results are exact. Items go in blocks of about ``block_terms`` terms,
    whose vocabulary is sent to the tasks; a task returns at most ``k`` rows an item.
    """
    spark = docs.sparkSession
    lower = F.translate(F.coalesce(F.col(item_text), F.lit("")), "".join(map(chr, range(65, 91))),
                        "".join(map(chr, range(97, 123))))
    found_terms = F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))
    asked = stored(
        items.select(F.col(item_key).cast("bigint").alias("item"), found_terms.alias("terms"))
        .where("item IS NOT NULL")
        .groupBy("item")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
        .where("size(terms) > 0")
    )
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // block_terms)
    body = docs.select(F.col(key).cast("bigint").alias("key"), utf8(text).alias("body"))
    found: DataFrame | None = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item").collect()
        if rows:
            part = _ranked_block(body, [r["item"] for r in rows], [r["terms"] for r in rows], k)
            part = stored(part) if blocks > 1 else part
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item bigint, rank int, key bigint, score bigint")
    missing = F.when(F.col("key") != LARGEST, F.col("key"))
    return found.select(
        F.col("item").alias(item_key), "rank", missing.alias(key), F.col("score")
    )


def _ranked_block(body: DataFrame, ids: list[int], texts: list[list[str]], k: int) -> DataFrame:
    terms, groups = vocabulary(texts)
    place = {term: i for i, term in enumerate(terms)}
    queries = [np.sort(np.array([place[t] for t in text], np.int64)) for text in texts]
    context = body.sparkSession.sparkContext
    sent = context.broadcast([t.encode() for t in terms])
    parts = stored(body.mapInArrow(
        lambda batches: _projected(batches, sent.value),
        "docs bigint, key bigint, n bigint, term array<int>, tf array<bigint>",
    ))
    sums = parts.where("docs IS NOT NULL")
    n_docs, length = sums.agg(F.sum("docs"), F.sum("n")).first()
    weights = np.full(len(terms), term_weight(n_docs or 0, 0), np.int64)
    pair = F.explode(F.arrays_zip("term", "tf")).alias("p")
    for row in sums.select(pair).groupBy("p.term").agg(F.sum("p.tf").alias("df")).collect():
        weights[row["term"]] = term_weight(n_docs, row["df"])
    query = context.broadcast((ids, queries, weights, groups, n_docs, length))
    best = parts.where("docs IS NULL").select("key", "n", "term", "tf").mapInArrow(
        lambda batches: _searched(batches, k, *query.value), "item bigint, key bigint, score bigint"
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), "key")
    ranks = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranks.select("item", "rank", "key", "score")


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RANKED_SQL = rf"""
WITH q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER_SQL}, '{TERM}')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER_SQL}, '{TERM}') AS w FROM documents
), l AS (
  SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS length FROM d
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, l WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs
), s AS (
  SELECT item_id, r, sum(weight.w * ((1000000000 * tf) // (1000 * tf + 20 *
           (100 - 50 + (50 * len(d.w) * n_docs) // length))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN d USING (r), l GROUP BY item_id, r
), ranks AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM s JOIN d USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 50
"""


@query("op12_ball_tree_search", RANKED_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
