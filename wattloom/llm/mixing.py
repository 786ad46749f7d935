"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, stored, table

WORD = r"[^\x20\x09-\x0D]+"
TREE = ("domain", "lang", "source")
#: A leaf's epoch order is cut into this many ranges of the order key; one of them is sorted.
RANGES = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def default_domain(source: Column) -> Column:
    """A source's domain where no table of domains is given: one of four, by a checksum."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)
    return F.concat(F.lit("domain"), F.conv(digit, 16, 10).cast("int") % 4)


def default_weights(domain: Column, lang: Column, source: Column) -> tuple[Column, Column, Column]:
    """Whole-number target weights at the three levels: English counts double."""
    return F.lit(1), F.when(lang == "en", 2).otherwise(1), F.lit(1)


def order_key(key: Column, epoch: Column, seed: int) -> Column:
    """60 bits that order the rows of a leaf anew in every epoch."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide each parent's ``budget`` among its children by ``weight``, up to their ``capacity``.

    What a full child cannot take goes to its siblings in proportion to their weights; only when all
    siblings are full is a budget left over. Children are visited by capacity per weight: the full
    ones come first, so running sums find them without iteration. Shares are rounded down. A child of
    weight 0 gets nothing; its capacity must be 0.
    """
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.try_divide("capacity", "weight")
    before = siblings.orderBy(ratio, name).rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    nodes = nodes.select(
        "*",
        (F.col("budget") - seen("capacity")).alias("open"),
        (F.sum("weight").over(siblings) - seen("weight")).alias("open_weight"),
    )
    full = F.col("capacity") * F.col("open_weight") <= F.col("weight") * F.col("open")
    nodes = nodes.withColumn("full", full)
    taken = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(siblings)
    weighing = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(siblings)
    nodes = nodes.select("*", (F.col("budget") - taken).alias("rest"), weighing.alias("weighing"))
    given = F.when(F.col("full"), F.col("capacity")).otherwise(
        F.expr("(weight * rest) div weighing")
    )
    return nodes.withColumn("given", given).drop(
        "open", "open_weight", "full", "rest", "weighing", "budget"
    )


def budgets(leaves: DataFrame, budget: int) -> DataFrame:
    """``given`` tokens of every leaf; ``leaves`` has the tree columns, tokens, capacity and the
    weights w_domain, w_lang, w_source.

    Budgets go from the root down. A node's capacity is that of all its leaves, so a shortage of a
    source is met by its siblings, then by other languages of the domain, then by other domains.
    """
    level: DataFrame | None = None
    for depth, name in enumerate(TREE):
        path = list(TREE[: depth + 1])
        nodes = leaves.groupBy(*path).agg(
            F.sum("capacity").alias("capacity"), F.max(f"w_{name}").cast("bigint").alias("weight")
        )
        if level is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("bigint"))
        else:
            nodes = nodes.join(level.withColumnRenamed("given", "budget"), path[:-1])
        level = share_out(nodes, path[:-1], name).select(*path, "given")
    return level.join(leaves, list(TREE))


def plan(
    rows: DataFrame, budget_share: float, max_epochs: int, weights, seed: int
) -> DataFrame:
    """Per leaf: ``epochs`` taken whole, and the last order key and key of the prefix of the next.

    ``rows`` has key, the tree columns and tokens. The prefix is found from token sums by range of the
    order key; only the range in which the budget ends is sorted, so no leaf, however large, meets in
    one task.
    """
    leaves = rows.groupBy(*TREE).agg(F.sum("tokens").alias("tokens"))
    w = dict(zip(TREE, weights(*(F.col(c) for c in TREE))))
    leaves = leaves.withColumns({f"w_{c}": w[c] for c in TREE})
    least = F.least(*(F.col(f"w_{c}") for c in TREE))
    negative = F.raise_error(F.lit("weights must not be negative")).cast("bigint")
    leaves = leaves.withColumn(
        "capacity", F.when(least > 0, F.col("tokens") * max_epochs).when(least < 0, negative).otherwise(0)
    )
    leaves = stored(leaves)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = budgets(leaves, int(total * budget_share)).select(
        *TREE,
        "tokens",
        "given",
        F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(0).alias("epochs"),
    )
    given = stored(given.withColumn("part", F.col("given") - F.col("epochs") * F.col("tokens")))
    ordered = rows.join(given.where("part > 0").select(*TREE, "epochs", "part"), list(TREE)).select(
        *TREE, "part", "tokens", "key", order_key(F.col("key"), F.col("epochs"), seed).alias("at")
    )
    ordered = ordered.withColumn("range", F.shiftright("at", 48).cast("int"))
    sums = ordered.groupBy(*TREE, "part", "range").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy(*TREE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = sums.where("before <= part and before + n > part").select(*TREE, "range", "before")
    last = ordered.join(ends, [*TREE, "range"])
    last = last.groupBy(*TREE, "range", "part", "before", "at", "key").agg(
        F.sum("tokens").alias("n")
    )
    running = Window.partitionBy(*TREE).orderBy("at", F.col("key").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    inside = last.withColumn("upto", F.col("before") + F.sum("n").over(running))
    kept = inside.where("upto <= part").groupBy(*TREE).agg(
        F.max(F.struct("at", "key")).alias("last")
    )
    cut = ends.select(*TREE, F.col("range").alias("end_range")).join(kept, list(TREE), "left")
    return given.select(*TREE, "epochs", "part").join(cut, list(TREE), "left")


def mix(
    documents: DataFrame,
    budget_share: float = 1.0,
    max_epochs: int = 2,
    text: str = "text",
    key: str = "doc_id",
    lang: str = "lang",
    source: str = "source",
    domain=default_domain,
    weights=default_weights,
    seed: int = 7,
) -> DataFrame:
    """All columns of the chosen rows of ``documents``, and a struct ``mixed`` with domain, lang,
    source, tokens (words), epoch and order_key. A row is returned once for each epoch it is in.

    The budget is ``budget_share`` of all tokens, divided by :func:`budgets`. A leaf may be repeated up
    to ``max_epochs`` times: whole epochs first, then the longest prefix of the next epoch's seeded
    order that its budget holds. A weight of 0 leaves a node out, and its siblings take its share;
    negative weights raise an error. Rows with equal keys in a leaf go together. Null language, source and
    text count as empty, and a null key as a key of its own that comes first among equal order keys.
    Rows without tokens come with whole epochs and with a prefix that reaches them; a leaf without any
    tokens is never taken. An empty table gives no rows. A column already called ``mixed`` is replaced.
    """
    tree = {
        "domain": domain(F.col(source)),
        "lang": F.coalesce(lang, F.lit("")),
        "source": F.coalesce(source, F.lit("")),
    }
    narrow = stored(
        documents.select(
            F.col(key).alias("key"),
            *(c.alias(n) for n, c in tree.items()),
            n_words(F.col(text)).alias("tokens"),
        )
    )
    chosen = plan(narrow, budget_share, max_epochs, weights, seed)
    chosen = stored(chosen.select(*(F.col(c).alias(f"__{c}") for c in chosen.columns)))
    names = [F.col(f"`{c}`") for c in documents.columns if c != "mixed"]
    rows = documents.select(*names, *(c.alias(f"__own_{n}") for n, c in tree.items()))
    same = [F.col(f"__own_{n}") == F.col(f"__{n}") for n in TREE]
    rows = rows.join(chosen, same)
    at = order_key(F.col(key), F.col("__epochs"), seed)
    place = F.shiftright(at, 48)
    # A leaf without an end range takes the whole part or, with nothing left over, none of it.
    in_part = (F.col("__part") > 0) & (
        F.coalesce(place < F.col("__end_range"), F.lit(False))
        | (
            (place == F.col("__end_range"))
            & F.col("__last").isNotNull()
            & (
                (at < F.col("__last.at"))
                | (
                    (at == F.col("__last.at"))
                    & (F.col(key).isNull() | F.coalesce(F.col(key) <= F.col("__last.key"), F.lit(False)))
                )
            )
        )
    )
    epochs = F.col("__epochs") + F.coalesce(in_part, F.lit(False)).cast("int")
    rows = rows.withColumn("__taken", epochs).where("__taken > 0")
    rows = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__taken") - 1)))
    return rows.select(
        *names,
        F.struct(
            *(F.col(f"__own_{n}").alias(n) for n in TREE),
            n_words(F.col(text)).alias("tokens"),
            F.col("__epoch").cast("int").alias("epoch"),
            order_key(F.col(key), F.col("__epoch"), seed).alias("order_key"),
        ).alias("mixed"),
    )


def _level(name: str, path: list[str], weight: str, source: str) -> str:
    """Shares at one level, for an independent engine."""
    over = f"PARTITION BY {', '.join(path[:-1])}" if path[:-1] else ""
    keys = ", ".join(path)
    budget = f"(SELECT {', '.join(path[:-1])}, given AS budget FROM {source})" if source else ""
    join = f"JOIN {budget} b USING ({', '.join(path[:-1])})" if source else "CROSS JOIN total b"
    return f"""{name}_n AS (
  SELECT n.*, b.budget FROM (
    SELECT {keys}, sum(capacity)::BIGINT AS capacity, max({weight})::BIGINT AS weight
    FROM leaves GROUP BY {keys}) n {join}
), {name}_o AS (
  SELECT *, budget - coalesce(sum(capacity) OVER w, 0) AS open,
         sum(weight) OVER ({over}) - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM {name}_n
  WINDOW w AS ({over} ORDER BY capacity::DOUBLE / weight, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), {name}_f AS (
  SELECT *, capacity * open_weight <= weight * open AS is_full FROM {name}_o
), {name} AS (
  SELECT {keys}, CASE WHEN is_full THEN capacity ELSE
    (weight * (budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({over})))
    // sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({over}) END AS given
  FROM {name}_f
)"""


MIXING_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS tokens FROM documents
), docs AS (SELECT *, 'domain' || (('0x' || substr(md5(source), 1, 1))::INTEGER % 4) AS domain FROM d
), leaves AS (
  SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * 2 AS capacity,
         1 AS w_domain, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS w_lang, 1 AS w_source
  FROM docs GROUP BY ALL
), total AS (SELECT sum(tokens)::BIGINT AS budget FROM leaves
), {_level("by_domain", ["domain"], "w_domain", "")}
, {_level("by_lang", ["domain", "lang"], "w_lang", "by_domain")}
, {_level("by_source", ["domain", "lang", "source"], "w_source", "by_lang")}
, cut AS (
  SELECT domain, lang, source, given::BIGINT // tokens AS epochs, given::BIGINT % tokens AS part
  FROM by_source JOIN leaves USING (domain, lang, source) WHERE tokens > 0
), placed AS (
  SELECT docs.*, epochs, part, ('0x' || substr(md5('7:' || epochs || ':' || doc_id), 1, 15))::BIGINT AS place
  FROM docs JOIN cut USING (domain, lang, source)
), taken AS (
  SELECT *, epochs + (part > 0 AND sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id) <= part)::BIGINT AS n
  FROM placed
), rows AS (SELECT *, unnest(range(n)) AS epoch FROM taken)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, epoch::INTEGER AS epoch,
       ('0x' || substr(md5('7:' || epoch || ':' || doc_id), 1, 15))::BIGINT AS order_key
FROM rows
"""


@query("op8_hierarchical_mixing", MIXING_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "mixed.*")
