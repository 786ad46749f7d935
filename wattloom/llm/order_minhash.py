"""Order MinHash fingerprints with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, stored, table

#: A symbol is a run of at most eight characters other than space: long unspaced texts have symbols.
SYMBOL = r"[^\x20\x09-\x0D]{1,8}"
POSITION_BITS = 24
POSITIONS = (1 << POSITION_BITS) - 1


def _changes(array: Column, of) -> Column:
    """Indexes at which ``of`` of a sorted array starts a new value."""
    return F.when(
        F.size(array) > 0,
        F.filter(
            F.sequence(F.lit(0), F.size(array) - 1),
            lambda i: (i == 0) | (of(F.get(array, i)) != of(F.get(array, i - 1))),
        ),
    ).otherwise(F.array().cast("array<int>"))


def with_fingerprint(
    frame: DataFrame,
    text: str,
    out: str,
    k: int = 3,
    tuple_size: int = 2,
    bits: int = 6,
    digits: int = 4,
) -> DataFrame:
    """Add column ``out``: 2**bits tuple hashes of ``digits`` hex digits each.

    A k-mer is a run of ``k`` symbols (a shorter text is one k-mer). Each k-mer gets its occurrence
    number within the text; the hash of both orders the numbered k-mers. Of that order each
    fingerprint part takes the ``tuple_size`` minimal ones from its own starting point on, round
    the end, which for hashed values is a random order of its own per part. The chosen k-mers are
    put back into text order and their hashes are hashed together, so moving text changes parts
    even where the set of k-mers stays the same. Likeness is the share of equal parts.

    Hash values and positions share one 64-bit number, so both sorts are plain sorts of longs. A text
    without symbols has the same fingerprint as any other such text. Null text counts as empty.
    """
    parts, shift = 1 << bits, 64 - bits
    hash_of = lambda x: F.shiftrightunsigned(x, POSITION_BITS)
    place_of = lambda x: x.bitwiseAND(F.lit(POSITIONS))
    packed = lambda h, p: F.shiftleft(hash_of(h), POSITION_BITS).bitwiseOR(
        place_of(p.cast("bigint"))
    )
    part_of = lambda x: F.shiftright(x, shift).cast("int") + parts // 2
    s, v, r, g, b, c = (f"__{out}_{i}" for i in range(6))
    S, V, R, G, B, C = map(F.col, (s, v, r, g, b, c))
    frame = frame.withColumn(
        s, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOL), F.lit(0))
    )
    kmers = F.slice(S, F.lit(1), F.greatest(F.size(S) - (k - 1), F.least(F.size(S), F.lit(1))))
    frame = frame.withColumn(
        v,
        F.sort_array(
            F.transform(
                kmers,
                lambda x, i: packed(F.xxhash64(x, *(F.get(S, i + j) for j in range(1, k))), i),
            )
        ),
    )
    frame = frame.withColumn(r, _changes(V, hash_of))
    frame = frame.withColumn(
        g,
        F.sort_array(
            F.flatten(
                F.transform(
                    R,
                    lambda at, i: F.transform(
                        F.slice(V, at + 1, F.coalesce(F.get(R, i + 1), F.size(V)) - at),
                        lambda x, n: packed(
                            F.xxhash64(hash_of(x), n.cast("bigint")), place_of(x)
                        ),
                    ),
                )
            )
        ),
    )
    frame = frame.withColumn(b, _changes(G, part_of))
    frame = frame.withColumn(
        c,
        F.when(F.size(B) == parts, B).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.lit(parts - 1)),
                lambda p: F.coalesce(
                    F.get(F.filter(B, lambda at: part_of(F.get(G, at)) >= p), F.lit(0)), F.lit(0)
                ),
            )
        ),
    )

    def part(at: Column) -> Column:
        chosen = [
            F.get(G, F.pmod(at + j, F.greatest(F.size(G), F.lit(1)))) for j in range(tuple_size)
        ]
        in_text_order = F.sort_array(
            F.array(
                *(
                    F.shiftleft(place_of(x), 64 - POSITION_BITS).bitwiseOR(hash_of(x))
                    for x in chosen
                )
            )
        )
        hashes = F.transform(
            in_text_order, lambda x: x.bitwiseAND(F.lit((1 << (64 - POSITION_BITS)) - 1))
        )
        return F.right(F.lpad(F.hex(F.xxhash64(hashes)), 16, "0"), F.lit(digits))

    return frame.withColumn(out, F.lower(F.array_join(F.transform(C, part), ""))).drop(
        s, v, r, g, b, c
    )


def likeness(a: str, b: str, digits: int = 4) -> Column:
    """Share of equal parts of two fingerprints, 0 to 1."""
    parts = F.length(a) / digits
    same = F.filter(
        F.sequence(F.lit(0), parts.cast("int") - 1),
        lambda i: F.substr(F.col(a), i * digits + 1, F.lit(digits))
        == F.substr(F.col(b), i * digits + 1, F.lit(digits)),
    )
    return F.size(same) / parts


def _edited(frame: DataFrame, next_text: str, next_fingerprint: str) -> DataFrame:
    """The digest columns of rows that hold their text and the next document's."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    text = F.concat(
        F.substr(F.col("text"), F.lit(1), n - half),
        F.substr(F.col(next_text), F.lit(1), half),
    )
    kept = [c for c in frame.columns if c != next_fingerprint]
    frame = with_fingerprint(frame.withColumn("edited", text), "edited", "edited_fingerprint")
    return frame.select(
        *kept,
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", next_fingerprint).alias("near_next"),
    )


def edit_sensitivity(
    documents: DataFrame, text: str = "text", key: str = "doc_id", bucket_rows: int = 250
) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of
    the next document's, in descending key order; the last row's next is the first. Rows with equal
    keys follow in text order and a null key comes last; null text is empty; a lone row is its own
    next; an empty table gives no rows. Other columns are not read.

    Texts move once, into key ranges of about ``bucket_rows`` rows. Only the first and the last row
    of a range also take part in the small join that finds the next row across ranges.
    """
    source = documents.select(
        F.col(key).cast("bigint").alias("key"), F.coalesce(text, F.lit("")).alias("text")
    )
    low, high, rows = source.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    buckets = max(1, rows // bucket_rows)
    width = max(1.0, (float(high or 0) - float(low or 0) + 1) / buckets)
    bucket = F.floor((F.col("key").cast("double") - F.lit(float(low or 0))) / F.lit(width))
    marked = with_fingerprint(
        source.withColumn("bucket", F.coalesce(bucket, F.lit(-1))), "text", "fingerprint"
    )
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("key"), "text")
    linked = marked.select(
        "*",
        F.lead("text").over(order).alias("next_text"),
        F.lead("fingerprint").over(order).alias("next_fingerprint"),
        (F.row_number().over(order) == 1).alias("first"),
    )
    inner = _edited(linked, "next_text", "next_fingerprint")
    last = F.col("next_text").isNull()
    done = stored(
        inner.withColumn("end_text", F.when(F.col("first") | last, F.col("text")))
        .withColumn("last", last)
        .drop("text", "next_text")
    )
    firsts = done.where("first").select(
        "bucket",
        F.col("end_text").alias("first_text"),
        F.col("fingerprint").alias("first_fingerprint"),
    )
    across = Window.orderBy(F.desc("bucket"))  # one narrow row per range
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select(
        "bucket",
        F.coalesce(F.lead("bucket").over(across), F.max("bucket").over(whole)).alias("following"),
    )
    ends = (
        done.where("last")
        .select("bucket", "key", F.col("end_text").alias("text"), "fingerprint")
        .join(following, "bucket")
        .join(firsts.withColumnRenamed("bucket", "following"), "following")
    )
    names = [
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    ]
    return (
        done.where("not last")
        .select(*names)
        .unionByName(_edited(ends, "first_text", "first_fingerprint").select(*names))
    )


@query("op1_order_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_sensitivity(table(spark, sf_dir, "documents"))
