"""Language-model scores from a probabilistic suffix tree over words.

The corpus is encoded once into chunks: the distinct words of a chunk as sorted 64-bit hashes, and its
tokens as positions among them. Every later step works on whole arrays. The tree grows level by level.
Counts meet by ranges of a hash: a chunk sends each range its distinct (context, next word) pairs once,
and gets the corpus totals back in the same order; sums of gains meet the same way. A pair's hash
covers both parts, so what follows or precedes one frequent word is spread over all ranges, and a key
comes at most once from a chunk. No table of words or contexts is broadcast or held in one place.

A context one word longer is a pair of the level before it, so its count is known where the token before
was open then; others are asked for with the pairs. Tokens behind rare contexts close before anything is
sent. Chunks and their states lie in the same buckets, so only questions and replies are shuffled.
When few tokens are left open, chunks are narrowed to these and some words before each, so that late
levels do not read the corpus again. All that grows from one context needs only the tokens behind it, so
these then meet by ranges of the context's hash, each with the words before it, and a range grows its
contexts by several words at once. Contexts with too many tokens for that go on level by level. Tokens
still open behind the last word sent wait until all are there; then wider chunks are cut anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, query, shuffles_removed, slices, stored, stored_folder, table, utf8

CHUNK_TOKENS = 1 << 19
TOKENS_PER_RANGE = 2 << 20
NARROW_AT = 5
#: Words sent to one range of subtrees, and the most that one context may send there.
SUBTREE_WORDS = 1 << 21
CONTEXT_WORDS = 1 << 19
MOST_WORDS_AHEAD = 64


def squeezed(array: np.ndarray) -> bytes:
    """Compressed byte by byte: all first bytes, all second bytes and so on, of which high ones repeat."""
    array = np.ascontiguousarray(array)
    size, numbers = array.itemsize, array.view("u1").reshape(-1, array.itemsize)
    used = size
    if array.dtype.kind in "iu" and len(array) and array.min() >= 0:
        used = (int(array.max()).bit_length() + 7) // 8
    planes = np.zeros((size, len(array)), "u1")
    for k in range(used):
        planes[k] = numbers[:, k]
    return zstandard.compress(planes.tobytes(), 1)


def loosened(blob: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), "u1").reshape(np.dtype(kind).itemsize, -1)
    numbers = np.zeros(planes.shape[::-1], "u1")
    for k, plane in enumerate(planes):
        if plane.any():
            numbers[:, k] = plane
    return numbers.view(kind).ravel()


def squeezed_rising(array: np.ndarray) -> bytes:
    """Rising 64-bit numbers as the steps between them."""
    return squeezed(np.diff(array.astype("<u8"), prepend=np.uint64(0)))


def loosened_rising(blob: bytes) -> np.ndarray:
    return np.cumsum(loosened(blob, "<u8"), dtype=np.uint64)


def squeezed_shares(p: np.ndarray) -> bytes:
    """Numbers to 10 digits: the 48 high bits of each."""
    numbers = np.ascontiguousarray(p, "<f8").view("u1").reshape(-1, 8)
    planes = np.empty((6, len(numbers)), "u1")
    for k in range(6):
        planes[k] = numbers[:, k + 2]
    return zstandard.compress(planes.tobytes(), 1)


def loosened_shares(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), "u1").reshape(6, -1)
    p = np.zeros((planes.shape[1], 8), "u1")
    for k in range(6):
        p[:, k + 2] = planes[k]
    return p.view("<f8").ravel()


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the place of every key among them.

    Numbers made of a key's high bits and its position sort several times faster than positions by key.
    Where keys that differ have the same high bits and come out of order, positions are sorted after all.
    """
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    least = keys.min()
    room = min(63, 64 - int(keys.max() - least).bit_length())
    bits = np.uint64(len(keys).bit_length())
    order = (keys - least) << np.uint64(room) >> bits << bits
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= (np.uint64(1) << bits) - np.uint64(1)
    order = order.view(np.int64)
    rising = keys[order]
    if (rising[1:] < rising[:-1]).any():
        return np.unique(keys, return_inverse=True)
    first = np.r_[True, rising[1:] != rising[:-1]]
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(first) - 1
    return rising[first], of


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts, A-Z lower-cased, one after the other, and how many each text has."""
    _, offsets, data = texts.buffers()
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    texts = pa.Array.from_buffers(
        kind, len(texts), [None, offsets, data], offset=texts.offset
    )  # the ASCII functions used below do not look at other bytes
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    words, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    some = pc.greater(pc.binary_length(words), 0)
    n = np.bincount(of[some.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return words.filter(some), n


def encoded(documents: DataFrame, text: str, key: str, held_out: Column) -> DataFrame:
    """The corpus as chunks of documents, see above. Every text ends with one end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = count(TaskContext.get().partitionId() << 32)
        keys: list = []
        held: list[bool] = []
        lengths: list[int] = []
        hashes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        size = 0

        def emit() -> pa.RecordBatch:
            nonlocal size
            known, place = grouped(np.concatenate(hashes))
            cuts = np.cumsum([0, *map(len, hashes)])
            tokens = [place[a:b][part] for a, b, part in zip(cuts, cuts[1:], parts)]
            sizes = np.array(lengths, np.int64)
            row = [
                [next(serial)],
                [list(keys)],
                [list(held)],
                [list(lengths)],
                [squeezed(known)],
                [squeezed(np.concatenate(tokens).astype("<u4"))],
                [int(sizes.sum())],
                [int(sizes[~np.array(held, bool)].sum())],
            ]
            size = 0
            for part in (keys, held, lengths, hashes, parts):
                part.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, _ENCODED.types)], schema=_ENCODED
            )

        for batch in slices(batches, "text"):
            words, n = _words(batch.column("text"))
            words = words.dictionary_encode()
            spelt = words.dictionary.cast(pa.binary()).to_pylist()
            spelt = np.fromiter(map(xxhash.xxh64_intdigest, [*spelt, b"\n"]), np.uint64, len(spelt) + 1)
            words, ends = words.indices.to_numpy(), np.cumsum(n)
            first = 0
            for i, k in enumerate(batch.column("key").to_pylist()):
                keys.append(k)
                lengths.append(int(n[i]) + 1)
                size += int(n[i]) + 1
                if size <= CHUNK_TOKENS and i + 1 < len(n):
                    continue
                held += batch.column("held")[first : i + 1].to_pylist()
                begun = ends[first] - n[first]
                part = words[begun : ends[i]]
                place = np.zeros(len(spelt), np.uint32)
                place[part] = place[-1] = 1
                used = np.flatnonzero(place)
                place[used] = np.arange(len(used), dtype=np.uint32)
                hashes.append(spelt[used])
                parts.append(np.insert(place[part], ends[first : i + 1] - begun, place[-1]))
                first = i + 1
                if size > CHUNK_TOKENS:
                    yield emit()
        if keys:
            yield emit()

    source = documents.select(
        F.col(key).cast("bigint").alias("key"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
        utf8(text).alias("text"),
    )
    return source.mapInArrow(
        run,
        "chunk bigint, keys array<bigint>, held array<boolean>, lengths array<int>, words binary, "
        "tokens binary, n bigint, n_train bigint",
    )


_ENCODED = pa.schema(
    [
        ("chunk", pa.int64()),
        ("keys", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())),
        ("lengths", pa.list_(pa.int32())),
        ("words", pa.binary()),
        ("tokens", pa.binary()),
        ("n", pa.int64()),
        ("n_train", pa.int64()),
    ]
)


class Chunk:
    """The arrays of one encoded row. A narrowed one has only some of the tokens, at ``place``."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        value = lambda name: batch.column(name)[i].as_py()
        self.id = value("chunk")
        self.words = loosened(value("words"), "<u8")
        self.tokens = loosened(value("tokens"), "<u4").astype(np.int64)
        self.lengths = batch.column("lengths")[i].values.to_numpy().astype(np.int64)
        self.held = batch.column("held")[i].values.to_numpy(zero_copy_only=False).astype(bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        if "place" in batch.schema.names:
            self.place = loosened_rising(value("place")).astype(np.int64)
            self.text = np.searchsorted(self.starts, self.place, "right") - 1
        else:
            self.place = np.arange(len(self.tokens))
            self.text = np.repeat(np.arange(len(self.lengths)), self.lengths)

    @cached_property
    def train(self) -> np.ndarray:
        return ~self.held[self.text]

    @cached_property
    def spelt(self) -> np.ndarray:
        """The hash of every token's word."""
        return self.words[self.tokens]


def _range(keys: np.ndarray, n: int) -> np.ndarray:
    """Range of every hash: hashes cut evenly, so a range is a run of sorted keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _stored_by_chunk(rows: DataFrame, n: int) -> DataFrame:
    """Like :func:`stored`, in ``n`` buckets by chunk, so that joins of such tables move nothing."""
    spark = rows.sparkSession
    path = stored_folder(spark)
    name = f"stored_{path.rsplit('-', 1)[1]}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet "  # the columns are compressed and differ by row
        "OPTIONS (compression 'none', 'parquet.enable.dictionary' 'false') "
        f"CLUSTERED BY (chunk) INTO {n} BUCKETS LOCATION '{path}'"
    )
    rows.write.insertInto(name)  # an insert's shuffle files can be removed when it ends
    frame = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, as the table is external
    return frame


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ word
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _contexts(chunk: Chunk, at: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``level`` words before each token, and of these words with the token."""
    if level == 1:
        h = _behind(chunk.words, np.arange(1, len(chunk.words) + 1), 1)[chunk.tokens[at - 1]]
    else:
        h = _behind(chunk.spelt, at, level)
    return h, _mixed(~h, chunk.spelt[at])


def _behind(words: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    h = np.full(len(at), level, np.uint64)
    for back in range(1, level + 1):
        h = _mixed(h, words[at - back])
    return h


def _context_groups(chunk: Chunk, at: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    if level > 1:
        return grouped(_behind(chunk.spelt, at, level))
    word = chunk.tokens[at - 1]
    number = np.bincount(word, minlength=len(chunk.words))
    used = np.flatnonzero(number)
    keys, number[used] = grouped(_mixed(np.full(len(used), 1, np.uint64), chunk.words[used]))
    return keys, number[word]


def _inside(chunk: Chunk, at: np.ndarray, level: int) -> np.ndarray:
    """Tokens with ``level`` words before them in their text."""
    return (chunk.place - chunk.starts[chunk.text])[at] >= level


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i


_ASK = pa.schema(
    [("range", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())]
)
_ASK_SQL = "range bigint, chunk bigint, keys binary, values binary"
_REPLY_SQL = "range bigint, chunk bigint, values binary, different bigint"


def _ask(chunk: int, keys: np.ndarray, values: np.ndarray, n_ranges: int, squeeze=squeezed) -> pa.RecordBatch:
    """Sorted keys and their values, by range of the key."""
    of = _range(keys, n_ranges)
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    bounds = [*cuts.tolist(), len(of)]
    parts = list(zip(bounds, bounds[1:]))
    row = (
        of[cuts],
        [chunk] * len(cuts),
        [squeezed_rising(keys[a:b]) for a, b in parts],
        [squeeze(values[a:b]) for a, b in parts],
    )
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _ASK.types)], schema=_ASK)


def _counts(blob: bytes) -> np.ndarray:
    return loosened(blob, "<u4")


def _meet(loosen, answer):
    """Add up a range's values by key and answer each chunk in the order of its keys."""

    def run(group: pa.Table) -> pa.Table:
        keys = [loosened_rising(b) for b in group["keys"].to_pylist()]
        values = [loosen(b) for b in group["values"].to_pylist()]
        known, of = grouped(np.concatenate(keys))
        total = np.bincount(of, weights=np.concatenate(values), minlength=len(known))
        reply = answer(total)
        ends = np.cumsum([0, *map(len, keys)])
        r = group["range"][0].as_py()
        return pa.table(
            {
                "range": pa.array([r] * (len(keys) + 1), pa.int64()),
                "chunk": pa.array([*group["chunk"].to_pylist(), None], pa.int64()),
                "values": pa.array(
                    [*(squeezed(reply[of[a:b]]) for a, b in zip(ends, ends[1:])), None], pa.binary()
                ),
                "different": pa.array([*[None] * len(keys), int((total > 0).sum())], pa.int64()),
            }
        )

    return run


def _by_chunk(replies: DataFrame) -> DataFrame:
    return (
        replies.where("chunk is not null")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("range", "values")).alias("replies"))
    )


def _answers(batch: pa.RecordBatch, i: int) -> list[bytes]:
    replies = batch.column("replies")[i].as_py() or []
    return [r["values"] for r in sorted(replies, key=lambda r: r["range"])]


def _answered(batch: pa.RecordBatch, i: int, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(loosened(b, kind) for b in _answers(batch, i))])


def _ask_words(n_ranges: int):
    """A chunk's distinct words with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in _rows(batches):
            chunk = Chunk(batch, i)
            n = np.bincount(chunk.tokens[chunk.train], minlength=len(chunk.words))
            yield _ask(chunk.id, chunk.words, n.astype("<u4"), n_ranges)

    return run


_STATE = pa.schema(
    [
        ("chunk", pa.int64()),
        ("at", pa.binary()),
        ("p", pa.binary()),
        ("own", pa.binary()),
        ("seen", pa.binary()),
        ("rare", pa.binary()),
        ("gain", pa.binary()),
        ("known", pa.binary()),
        ("base", pa.binary()),
        ("score", pa.binary()),
        ("alive", pa.int64()),
        ("later_at", pa.binary()),
        ("later_p", pa.binary()),
        ("waiting", pa.int64()),
    ]
)
_STATE_SQL = (
    "chunk bigint, at binary, p binary, own binary, seen binary, rare binary, gain binary, "
    "known binary, base binary, score binary, alive bigint, later_at binary, later_p binary, "
    "waiting bigint"
)


class State:
    """Where a chunk stands: its tokens still open, their probability so far, the training count of the
    level's context before each (``own``; below 0: not known, but at most -1 - own), and the texts' finished sums.
    In level 1 probability and count are functions of one word and kept by word.

    ``rare`` marks tokens behind a context with too few training tokens. While a level is open,
    ``seen`` has the training counts of the tokens behind their contexts and ``gain`` the chunk's part
    of the gain of its contexts, by hash. ``later`` are tokens that wait for a level further on, and
    their probability.
    """

    def __init__(self, batch: pa.RecordBatch, i: int, chunk: Chunk, level: int, size: int | None = None):
        self.blob = lambda name: batch.column(name)[i].as_py()
        self.chunk, self.level, self.size = chunk, level, len(chunk.tokens) if size is None else size

    @cached_property
    def at(self) -> np.ndarray:
        return loosened_rising(self.blob("at")).astype(np.int64)

    @cached_property
    def kept_p(self) -> np.ndarray:
        return loosened_shares(self.blob("p"))

    @cached_property
    def kept_own(self) -> np.ndarray:
        return loosened(self.blob("own"), "<i8")

    @cached_property
    def p(self) -> np.ndarray:
        return self.kept_p[self.chunk.tokens[self.at]] if self.level == 1 else self.kept_p

    @cached_property
    def own(self) -> np.ndarray:
        return self.kept_own[self.chunk.tokens[self.at - 1]] if self.level == 1 else self.kept_own

    @cached_property
    def seen(self) -> np.ndarray:
        return loosened(self.blob("seen"), "<i8")

    @cached_property
    def rare(self) -> np.ndarray:
        return np.unpackbits(loosened(self.blob("rare"), "u1"), count=self.size).astype(bool)

    @cached_property
    def gain(self) -> np.ndarray:
        return loosened_shares(self.blob("gain"))

    @cached_property
    def known(self) -> np.ndarray:
        return loosened(self.blob("known"), "<i8")

    @cached_property
    def base(self) -> np.ndarray:
        return loosened(self.blob("base"), "<f8")

    @cached_property
    def score(self) -> np.ndarray:
        return loosened(self.blob("score"), "<f8")

    @cached_property
    def later(self) -> tuple[np.ndarray, np.ndarray]:
        at = loosened_rising(self.blob("later_at")).astype(np.int64)
        return at, loosened_shares(self.blob("later_p"))


_NOBODY = np.zeros(0, np.int64), np.zeros(0)


def _state(chunk: Chunk, at, p, own, seen, rare, gain, known, base, score, later=_NOBODY) -> pa.RecordBatch:
    blobs = [squeezed_rising(at), squeezed_shares(p), squeezed(own.astype("<i8"))]
    blobs += squeezed(seen.astype("<i8")), squeezed(np.packbits(rare)), squeezed_shares(gain)
    blobs += map(squeezed, (known, base, score))
    row = [chunk.id, *blobs, len(at), squeezed_rising(later[0]), squeezed_shares(later[1]), len(later[0])]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], t) for v, t in zip(row, _STATE.types)], schema=_STATE
    )


def _unchanged(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
    """The state of a chunk without open tokens."""
    return batch.slice(i, 1).select(_STATE.names)


def _finish(chunk: Chunk, score: np.ndarray, at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The texts' sums with tokens whose probability is final."""
    return score + np.bincount(chunk.text[at], weights=np.log10(p), minlength=len(chunk.lengths))


def _begin(tokens: int, different: int, least: float):
    """Unigram probabilities; open are all tokens with a word before them that is no rare one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in _rows(batches):
            chunk = Chunk(batch, i)
            own = _answered(batch, i, "<i8")
            by_word = (own + 1) / (tokens + different + 1)
            p = by_word[chunk.tokens]
            add = lambda v: np.add.reduceat(v, chunk.starts)
            every = np.arange(len(p))
            inside = _inside(chunk, every, 1) & (tokens > 0)
            use = inside & (own[chunk.tokens[every - 1]] >= least)
            score = _finish(chunk, np.zeros(len(chunk.lengths)), every[~use], p[~use])
            none = np.zeros(0)
            yield _state(
                chunk, every[use], by_word, own, none, inside & ~use, none,
                add((own > 0).astype(np.int64)[chunk.tokens]), add(np.log10(p)), score,
            )

    return run


def smoothed(n: np.ndarray, of: np.ndarray, parent: np.ndarray, prior: float) -> np.ndarray:
    """Next-symbol probability of a state: its counts, and its suffix's distribution as a prior."""
    return (n + prior * parent) / (of + prior)


def _questions(chunk: Chunk, state: State, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts whose count is not known, then (context, next word) of all open tokens; and which
    tokens the former are."""
    context, item = _contexts(chunk, state.at, level)
    unknown = np.flatnonzero(state.own < 0)
    return *grouped(np.concatenate((context[unknown], item))), unknown


def _ask_counts(level: int, n_ranges: int):
    """Training counts of the open tokens' (context, next word), and of contexts not known yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in _rows(batches):
            chunk = Chunk(batch, i)
            state = State(batch, i, chunk, level)
            keys, of, unknown = _questions(chunk, state, level)
            train = chunk.train[state.at]
            n = np.bincount(of[np.r_[train[unknown], train]], minlength=len(keys))
            yield _ask(chunk.id, keys, n.astype("<u4"), n_ranges)

    return run


def _count(level: int, least: float, prior: float):
    """Open stay the tokens behind contexts with ``least`` training tokens. A context's gain is the
    leave-one-out log likelihood of its own tokens against its suffix's distribution: the divergence
    between the two, without credit for having seen the token itself.

    The count of a token's next longer context is that of the token before it with its own context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in _rows(batches):
            if batch.column("alive")[i].as_py() == 0:
                yield _unchanged(batch, i)
                continue
            chunk = Chunk(batch, i)
            state = State(batch, i, chunk, level)
            _, of, unknown = _questions(chunk, state, level)
            total = _answered(batch, i, "<i8")[of]
            own, n = state.own.copy(), total[len(unknown) :]
            own[unknown] = total[: len(unknown)]
            use = own >= least
            rare = state.rare
            rare[state.at[~use]] = True
            score = _finish(chunk, state.score, state.at[~use], state.p[~use])
            at, p, own, n = state.at[use], state.p[use], own[use], n[use]
            seen = chunk.train[at]
            without = smoothed(n[seen] - 1, own[seen] - 1, p[seen], prior)
            keys, of = _context_groups(chunk, at, level)
            gain = np.bincount(of[seen], weights=np.log(without / p[seen]), minlength=len(keys))
            kept = (state.kept_p, state.kept_own) if level == 1 else (p, own)
            yield _state(chunk, at, *kept, n, rare, gain, state.known, state.base, score, state.later)

    return run


def _ask_gains(level: int, n_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in _rows(batches):
            chunk = Chunk(batch, i)
            state = State(batch, i, chunk, level)
            keys = _context_groups(chunk, state.at, level)[0]
            yield _ask(chunk.id, keys, state.gain, n_ranges, squeezed_shares)

    return run


def _retain(level: int, last: bool, least: float, prior: float):
    """Tokens behind retained contexts take the longer context's probability and stay open, but for
    those whose next longer context is known to have less than ``least`` training tokens.

    That context's count is the count of the token before behind its own context of this level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0)
        for batch, i in _rows(batches):
            if batch.column("alive")[i].as_py() == 0:
                yield _unchanged(batch, i)
                continue
            chunk = Chunk(batch, i)
            state = State(batch, i, chunk, level)
            of = _context_groups(chunk, state.at, level)[1]
            kept = _answered(batch, i, "<u1")[of] > 0
            p = np.where(kept, smoothed(state.seen, state.own, state.p, prior), state.p)
            after = np.where(state.rare, 0, -1)
            after[state.at] = state.seen
            own = after[state.at - 1]
            own = np.where(own < 0, -1 - state.own, own)  # no more than those of its suffix
            inside = kept & _inside(chunk, state.at, level + 1) & (not last)
            use = inside & ((own < 0) | (own >= least))
            rare = state.rare
            rare[state.at[inside & ~use]] = True
            score = _finish(chunk, state.score, state.at[~use], p[~use])
            yield _state(
                chunk, state.at[use], p[use], own[use], none, rare, none,
                state.known, state.base, score, state.later,
            )

    return run


_SUBTREES = pa.schema(
    [
        ("range", pa.int64()),
        ("chunk", pa.int64()),
        ("contexts", pa.binary()),
        ("sizes", pa.binary()),
        ("words", pa.binary()),
        ("places", pa.binary()),
        ("train", pa.binary()),
        ("p", pa.binary()),
    ]
)
_SUBTREES_SQL = (
    "range bigint, chunk bigint, contexts binary, sizes binary, words binary, places binary, "
    "train binary, p binary"
)


def _sent(chunk: Chunk, state: State, level: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which open tokens are sent to their context's range, in what order, and their contexts then."""
    sent = np.where(state.own < 0, -1 - state.own, state.own) <= most
    at = state.at[sent]
    context = _behind(chunk.spelt, at, level)
    order = np.lexsort((chunk.tokens[at], context))
    return sent, order, context[order]


def _ask_subtrees(level: int, reach: int, n_ranges: int, most: int):
    """Tokens by range of the context: its next word, and the words before the context."""
    backs = [0, *range(level + 1, reach + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in _rows(batches):
            chunk = Chunk(batch, i)
            state = State(batch, i, chunk, level)
            sent, order, context = _sent(chunk, state, level, most)
            every, p = state.at[sent][order], state.p[sent][order]
            of = _range(context, n_ranges)
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(of)]):
                at = every[a:b]
                before = chunk.place[at] - chunk.starts[chunk.text[at]]
                words = np.zeros((len(backs), b - a), np.uint64)  # 0: the text begins before
                for k, back in enumerate(backs):
                    inside = before >= back
                    words[k, inside] = chunk.tokens[at[inside] - back] + 1
                used, places = grouped(np.r_[np.uint64(0), words.ravel()])
                first = np.flatnonzero(np.r_[True, context[a + 1 : b] != context[a : b - 1]])
                rows.append(
                    [
                        int(of[a]),
                        chunk.id,
                        squeezed_rising(context[a:b][first]),
                        squeezed(np.diff(first, append=b - a).astype("<u4")),
                        squeezed_rising(chunk.words[used[1:].astype(np.int64) - 1]),
                        squeezed(places[1:].astype("<u4")),
                        squeezed(np.packbits(chunk.train[at])),
                        squeezed_shares(p[a:b]),
                    ]
                )
            columns = zip(*rows) if rows else [[]] * len(_SUBTREES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(columns, _SUBTREES.types)], schema=_SUBTREES
            )

    return run


def _grow_subtrees(level: int, reach: int, least: float, prior: float, least_gain: float):
    """Grow a range's contexts from ``level`` to ``reach`` words. Answered is each token's probability,
    below 0 if its longest context is still open."""

    def run(group: pa.Table) -> pa.Table:
        blobs = {name: group[name].to_pylist() for name in group.column_names}
        words = [loosened_rising(b) for b in blobs["words"]]
        known, number = grouped(np.concatenate(words))
        cuts, many = np.cumsum([0, *map(len, words)]), np.uint64(len(known) + 1)
        sizes = [loosened(b, "<u4") for b in blobs["sizes"]]
        ends = np.cumsum([0, *(int(n.sum()) for n in sizes)])
        word = np.empty((reach - level + 1, ends[-1]), np.int32)
        for i, places in enumerate(blobs.pop("places")):
            mine = np.r_[0, number[cuts[i] : cuts[i + 1]] + 1].astype(np.int32)
            word[:, ends[i] : ends[i + 1]] = mine[loosened(places, "<u4").reshape(len(word), -1)]
        del words, known, number
        contexts = [loosened_rising(b) for b in blobs["contexts"]]
        of = grouped(np.concatenate(contexts))[1]
        of = np.repeat(of, np.concatenate(sizes))
        train = np.concatenate(
            [np.unpackbits(loosened(t, "u1"), count=b - a) for t, a, b in zip(blobs["train"], ends, ends[1:])]
        ).astype(bool)
        p = np.concatenate([loosened_shares(b) for b in blobs["p"]])
        at = np.arange(len(p))
        del blobs, contexts, sizes
        for k in range(reach - level + 1):
            if k:
                before = word[k, at]
                at, of, before = at[before > 0], of[before > 0], before[before > 0]
                of = grouped(of.astype(np.uint64) * many + before.astype(np.uint64))[1]
            own = np.bincount(of[train[at]], minlength=of.max(initial=-1) + 1)[of]
            use = own >= least
            at, of, own = at[use], of[use], own[use]
            if len(at) == 0:
                break
            seen, item = train[at], grouped(of.astype(np.uint64) * many + word[0, at].astype(np.uint64))[1]
            n = np.bincount(item[seen], minlength=item.max() + 1)[item]
            shorter = p[at]
            without = smoothed(n[seen] - 1, own[seen] - 1, shorter[seen], prior)
            gain = np.bincount(of[seen], weights=np.log(without / shorter[seen]), minlength=of.max() + 1)
            kept = (gain >= least_gain)[of]
            p[at[kept]] = smoothed(n, own, shorter, prior)[kept]
            at, of = at[kept], of[kept]
        p[at] *= -1
        return pa.table(
            {
                "range": group["range"],
                "chunk": group["chunk"],
                "values": pa.array([squeezed_shares(p[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()),
                "different": pa.nulls(group.num_rows, pa.int64()),
            }
        )

    return run


def _after_subtrees(level: int, reach: int, most: int):
    """Tokens sent are final, or wait for the level after ``reach``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in _rows(batches):
            if batch.column("alive")[i].as_py() == 0:
                yield _unchanged(batch, i)
                continue
            chunk = Chunk(batch, i)
            state = State(batch, i, chunk, level)
            sent, order, _ = _sent(chunk, state, level, most)
            answer = np.empty(len(order))
            answer[order] = np.concatenate([np.zeros(0), *map(loosened_shares, _answers(batch, i))])
            at, p = state.at[sent], np.abs(answer)
            wait = (answer < 0) & _inside(chunk, at, reach + 1)
            score = _finish(chunk, state.score, at[~wait], p[~wait])
            later = np.r_[state.later[0], at[wait]]
            rising = np.argsort(later)
            later = later[rising], np.r_[state.later[1], p[wait]][rising]
            seen, gain = state.seen, state.gain
            if len(seen):
                keys, of = _context_groups(chunk, state.at, level)
                seen, gain = seen[~sent], gain[np.bincount(of[~sent], minlength=len(keys)) > 0]
            yield _state(
                chunk, state.at[~sent], state.p[~sent], state.own[~sent], seen, state.rare, gain,
                state.known, state.base, score, later,
            )

    return run


_NARROWED = pa.schema(
    [
        *(_ENCODED.field(name) for name in ("chunk", "held", "lengths", "words", "tokens")),
        ("place", pa.binary()),
        *list(_STATE)[1:],
    ]
)
_NARROWED_SQL = (
    "chunk bigint, held array<boolean>, lengths array<int>, words binary, tokens binary, place binary, "
    + _STATE_SQL.removeprefix("chunk bigint, ")
)


def _narrowed(level: int, reach: int):
    """Of a whole chunk only the open tokens and ``reach`` words before each, with the state to match;
    tokens that have waited for this level are open from now on.

    ``was`` is the place of the tokens that the state has been about so far, null: all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in _rows(batches):
            chunk = Chunk(batch, i)
            was = batch.column("was")[i].as_py()
            was = chunk.place if was is None else loosened_rising(was).astype(np.int64)
            state = State(batch, i, chunk, level, len(was))
            at, size = np.r_[state.at, state.later[0]], len(chunk.tokens)
            rising = np.argsort(at)
            at, p = was[at[rising]], np.r_[state.p, state.later[1]][rising]
            own = np.r_[state.own, np.full(len(state.later[0]), -1 - (1 << 62))][rising]
            begin = np.maximum(at - reach, chunk.starts[chunk.text[at]])
            open_at = np.bincount(begin, minlength=size + 1) - np.bincount(at + 1, minlength=size + 1)
            inside = np.cumsum(open_at)[:size] > 0
            place, rare = np.flatnonzero(inside), np.zeros(size, bool)
            rare[was[state.rare]] = True
            used = np.zeros(len(chunk.words), bool)
            used[chunk.tokens[place]] = True
            tokens = (np.cumsum(used) - 1)[chunk.tokens[place]]
            after = _state(
                chunk, (np.cumsum(inside) - 1)[at], p, own, state.seen, rare[place],
                state.gain, state.known, state.base, state.score,
            )
            blobs = squeezed(chunk.words[used]), squeezed(tokens.astype("<u4")), squeezed_rising(place)
            columns = [batch.column(name).slice(i, 1) for name in ("chunk", "held", "lengths")]
            columns += [pa.array([b], pa.binary()) for b in blobs]
            yield pa.RecordBatch.from_arrays([*columns, *after.columns[1:]], names=_NARROWED.names)

    return run


def _emit(tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in _rows(batches):
            value = lambda name, kind: pa.array(loosened(batch.column(name)[i].as_py(), kind))
            lengths = batch.column("lengths")[i].values
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("keys")[i].values,
                    batch.column("held")[i].values,
                    lengths.cast(pa.int64()),
                    value("known", "<i8"),
                    pa.array(np.full(len(lengths), tokens, np.int64)),
                    value("base", "<f8"),
                    value("score", "<f8"),
                ],
                ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def _grown(
    chunks: DataFrame, share: float | None, prior: float, least_gain: float, least: float
) -> tuple[DataFrame, DataFrame, int]:
    """The stored chunks, their state after the last level, and the number of training tokens."""
    spark = chunks.sparkSession
    longest = None if share is None else 2
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = _stored_by_chunk(chunks.repartition(n_buckets, "chunk"), n_buckets)
    work = chunks.drop("keys", "n", "n_train")
    n, tokens = chunks.agg(F.sum("n"), F.sum("n_train")).first()
    n, tokens = int(n or 0), int(tokens or 0)
    n_ranges = max(1, n // TOKENS_PER_RANGE)

    def least_at(level: int) -> float:
        return least if share is None else max(1.0 if level == 1 else 2.0, share * tokens)

    whole = lambda total: total.astype("<i8")
    asks = work.mapInArrow(_ask_words(n_ranges), _ASK_SQL)
    replies = stored(asks.groupBy("range").applyInArrow(_meet(_counts, whole), _REPLY_SQL))
    different = int(replies.agg(F.sum("different")).first()[0] or 0)
    begun = work.join(_by_chunk(replies).hint("merge"), "chunk")
    begun = begun.mapInArrow(_begin(tokens, different, least_at(1)), _STATE_SQL)
    state = _stored_by_chunk(begun, n_buckets)
    discard(replies)
    level, reach, shared = 1, None, False  # shared: the state's table is also that of the narrowed chunks
    while longest is None or level <= longest:
        alive, waiting = (int(v or 0) for v in state.agg(F.sum("alive"), F.sum("waiting")).first())
        if not alive and not waiting:
            break
        if not alive:
            level = reach + 1
        if level > 1 and (NARROW_AT * alive < n if reach is None else level > reach):
            alive, reach = alive + waiting, level + min(level, MOST_WORDS_AHEAD)
            was = F.col("place") if "place" in work.columns else F.lit(None).cast("binary")
            both = chunks.join(state, "chunk").join(work.select("chunk", was.alias("was")), "chunk")
            both = _stored_by_chunk(both.mapInArrow(_narrowed(level, reach), _NARROWED_SQL), n_buckets)
            discard(state)
            if "place" in work.columns:
                discard(work)
            state = both.select(*_STATE.names)
            work = both.select("chunk", "held", "lengths", "words", "tokens", "place")
            shared = True
        n_ranges = max(1, 2 * alive // TOKENS_PER_RANGE)
        counts = _meet(_counts, whole)
        update = _count(level, least_at(level), prior)
        steps = [(_ask_counts(level, n_ranges), ("at", "own"), _ASK_SQL, counts, update)]
        if reach is not None and longest is None:
            width = reach - level + 1
            most = CONTEXT_WORDS // width
            ask = _ask_subtrees(level, reach, 1 + alive * width // SUBTREE_WORDS, most)
            grow = _grow_subtrees(level, reach, least, prior, least_gain)
            update = _after_subtrees(level, reach, most)
            steps.append((ask, ("at", "own", "p"), _SUBTREES_SQL, grow, update))
            if not waiting:  # else nothing is known about the contexts yet
                steps.insert(0, steps[-1])
        gains = _meet(loosened_shares, lambda total: (total >= least_gain).astype("<u1"))
        retain = _retain(level, level == longest, least_at(level + 1), prior)
        steps.append((_ask_gains(level, n_ranges), ("at", "gain"), _ASK_SQL, gains, retain))
        for i, (ask, used, asked, meet, update) in enumerate(steps):
            if i and not state.where("alive > 0").take(1):
                break
            both = work.join(state.hint("merge"), "chunk")
            some = both.where("alive > 0").select(*work.columns, *used)
            asks = some.mapInArrow(ask, asked)
            replies = asks.groupBy("range").applyInArrow(meet, _REPLY_SQL)
            answers = both.join(_by_chunk(replies).hint("merge"), "chunk", "left")
            after = _stored_by_chunk(answers.mapInArrow(update, _STATE_SQL), n_buckets)
            if not shared:
                discard(state)
            state, shared = after, False
        level += 1
    return chunks, state, tokens


def suffix_tree_scores(
    documents: DataFrame,
    held_out: Column,
    text: str = "text",
    key: str = "doc_id",
    share: float | None = None,
    prior: float = 3000.0,
    least_gain: float = 10.0,
    least: int = 10,
) -> DataFrame:
    """Score every whole text by a suffix tree learnt from the rows that are not ``held_out``.

    Candidate states are words, and runs of words of any length, with at least ``least`` training
    tokens behind them. A state is retained if its suffix is and its next-word distribution diverges
    from that of its suffix: left-one-out, its own training tokens must gain at least ``least_gain``
    nats over the suffix. The tree grows by one word a level until nothing more is retained. Each token
    is scored by the longest retained state before it within its text, smoothed by the suffix's
    distribution with the weight of ``prior`` tokens, down to the add-one unigram distribution.

    With ``share`` the tree is a small one instead: words and pairs of words that make up at least this
    share of the training tokens.

    Returns key, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (unigrams)
    and score, both in log10. A null or empty text is its end token alone; a null ``held_out`` counts as
    training; repeated rows count and are scored each; without training rows all words are unknown; an
    empty table gives no rows. Other columns are not read.
    """
    with shuffles_removed(documents.sparkSession):
        chunks, state, tokens = _grown(
            encoded(documents, text, key, held_out), share, prior, least_gain, least
        )
    scored = chunks.join(state, "chunk").mapInArrow(
        _emit(tokens),
        "key bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double",
    )
    return scored.withColumnRenamed("key", key)


@query("op4_suffix_tree_scores")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return suffix_tree_scores(table(spark, sf_dir, "documents"), held_out)
