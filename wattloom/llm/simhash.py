"""SimHash near-duplicate groups, searched with BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, query, slices, stored, table, utf8

RUN = 1 << 16


def simhash(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: ASCII case folded, word shingles, repeats included.

    A text of fewer words is one shingle; a text without words is 0.
    """
    split = text.lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    take = min(words, len(split))
    starts, ends = starts[: len(split) - take + 1], ends[take - 1 :] - 1
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), RUN):
        spans = zip(starts[at : at + RUN].tolist(), ends[at : at + RUN].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(
    documents: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3
) -> DataFrame:
    """Key and signed 64-bit ``fp`` of every whole text; null texts count as empty. A key is a whole
    number, or a struct."""
    kind = documents.schema[key].dataType
    kind = kind.simpleString() if isinstance(kind, T.StructType) else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [simhash(t, words) for t in batch.column("text").to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(signed)], ["key", "fp"])

    source = documents.select(F.col(key).cast(kind).alias("key"), utf8(text).alias("text"))
    return source.mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


class BKTree:
    """Burkhard-Keller tree of integers: children keyed by Hamming distance to the parent."""

    def __init__(self, values: Iterable[int]):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for value in values:
            at, new = 0, len(self.values)
            while self.values:
                far = (self.values[at] ^ value).bit_count()
                follow = self.children[at].setdefault(far, new)
                if follow == new:
                    break
                at = follow
            self.values.append(value)
            self.children.append({})

    def near(self, values: list[int], radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, queries within the radius of it) pairs; all queries walk the tree together and
        a query follows only the edges whose distance lies within the radius of its own."""
        if not self.values:
            return
        asked = np.array(values, np.uint64)
        stack = [(0, np.arange(len(values)))]
        while stack:
            node, at = stack.pop()
            far = np.bitwise_count(asked[at] ^ np.uint64(self.values[node])).astype(np.int64)
            hit = at[far <= radius]
            if len(hit):
                yield node, hit
            for edge, child in self.children[node].items():
                follow = at[np.abs(far - edge) <= radius]
                if len(follow):
                    stack.append((child, follow))


def shard_links(tree: list[int], asked: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smaller value of its group) pairs that join all values linked in this shard.

    ``tree`` and ``asked`` are both members of the shard (equal lists, or two parts of it). Groups
    are united inside, so a dense shard yields a pair per value and not a pair per link.
    """
    owner = {v: v for v in tree} | {v: v for v in asked}

    def root(v: int) -> int:
        while owner[v] != v:
            owner[v] = v = owner[owner[v]]
        return v

    for node, hits in BKTree(tree).near(asked, radius):
        a = root(tree[node])
        for i in hits.tolist():
            b = root(asked[i])
            if a != b:
                a, b = min(a, b), max(a, b)
                owner[b] = a
    return [(v, r) for v in owner if (r := root(v)) != v]


def shard_keys(fp: Column, radius: int = 3) -> Column:
    """Shards such that any two fingerprints within the radius share one.

    Of four 16-bit blocks, two fingerprints that differ in at most 3 bits agree on one; of the
    other 48 bits cut into four 12-bit blocks they again agree on one. A shard is a block, its
    value, a second block and its value: 28 bits, so shards stay small for tens of billions of
    different fingerprints. Each fingerprint is in 16 shards.
    """
    if radius > 3:
        raise ValueError("four blocks find at most 3 differing bits")
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 48 - 16 * i).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << (48 - 16 * i)) - 1)
        high = F.shiftleft(F.shiftrightunsigned(fp, 64 - 16 * i), 48 - 16 * i) if i else F.lit(0)
        rest = high.bitwiseOR(low)  # the 48 bits outside the block
        for j in range(4):
            part = F.shiftrightunsigned(rest, 36 - 12 * j).bitwiseAND(0xFFF)
            keys.append(
                F.lit(4 * i + j).cast("bigint") * F.lit(1 << 28)
                + block * F.lit(1 << 12)
                + part
            )
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = 3, part: int = 4096) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect all linked ones; ``distinct`` has ``fp``.

    A shard with more than ``part`` members is dealt into parts; each pair of parts is a task's
    work of its own, so no group is unbounded and no link is lost.
    """
    members = distinct.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("shard"))
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = members.join(sizes, "shard")
    n_parts = F.ceil(F.col("n") / F.lit(part)).cast("int")
    own = F.pmod(F.xxhash64("fp"), n_parts).cast("int")
    # In the work of parts (p, q), p <= q, part q asks the tree of part p.
    dealt = shared.select("shard", "fp", n_parts.alias("parts"), own.alias("own")).select(
        "shard",
        "fp",
        "own",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"),
    )
    work = dealt.select(
        "shard",
        F.least("own", "other").alias("p"),
        F.greatest("own", "other").alias("q"),
        "own",
        "fp",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        tree: list[int] = []
        asked: list[int] = []
        out: list[tuple[int, int]] = []

        def flush() -> None:
            if held:
                if held[1] == held[2]:
                    out.extend(shard_links(tree, tree, radius))
                elif tree and asked:
                    out.extend(shard_links(tree, asked, radius))

        def emit() -> pa.RecordBatch:
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "p", "q", "own")]
            values = batch.column("fp").to_numpy().view(np.uint64).tolist()
            for shard, p, q, own_part, value in zip(*columns, values):
                if held != (shard, p, q):
                    flush()
                    held, tree, asked = (shard, p, q), [], []
                (tree if own_part == p else asked).append(value)
            if len(out) > 10_000:
                yield emit()
        flush()
        yield emit()

    grouped = work.repartition("shard", "p", "q").sortWithinPartitions("shard", "p", "q")
    return grouped.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes with edges (a, b); a component is named by its smallest node.

    Alternating large and small stars: each round links every node to the smallest neighbour of
    its neighbours, until nothing changes. Rounds grow with the logarithm of the longest path.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )

    def state(frame: DataFrame) -> tuple:
        return tuple(
            frame.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
            ).first()
        )

    seen = state(now)
    while seen[0]:
        both = now.select("a", "b").union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        following = stored(small.select("e.a", "e.b").where("a <> b").distinct())
        found = state(following)
        discard(now)
        now = following
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    words: int = 3,
    radius: int = 3,
) -> DataFrame:
    """Key, ``fingerprint`` (16 hex digits) and ``component_id`` of every document.

    Fingerprints that differ in at most ``radius`` bits are linked; the component is the smallest
    key reachable over links, the document's own included. Texts without words have fingerprint 0
    and link like any other. Null texts count as empty. A row without a key takes the smallest key
    of its group, and null where the group has none. Repeated rows are kept. Other columns are not
    read; an empty table gives no rows.

    Equal fingerprints are one node from the start, so exact copies cost nothing further, and links
    inside a dense group are united in its shard rather than listed.
    """
    marked = stored(fingerprints(documents, text, key, words))
    nodes = stored(marked.groupBy("fp").agg(F.min(key).alias("least")))
    pairs = links(nodes.select("fp"), radius)
    groups = components(pairs)
    # Node names are fingerprints; a component's name is its smallest document.
    roots = nodes.join(groups, nodes["fp"] == groups["node"]).select(
        "fp", "least", F.col("component").alias("root")
    )
    all_roots = roots.unionByName(
        nodes.join(groups.select(F.col("component").alias("fp")).distinct(), "fp").select(
            "fp", "least", F.col("fp").alias("root")
        )
    )
    names = all_roots.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = all_roots.join(names, "root").select("fp", "component_id")
    named = nodes.join(linked, "fp", "left").select(
        F.col("fp").alias("node"), F.coalesce("component_id", "least").alias("component_id")
    )
    return marked.join(named, marked["fp"] == named["node"]).select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op9_simhash_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
