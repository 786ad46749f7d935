"""Isolation forest over hour of day, weekday and activity (Liu, Ting and Zhou, 2008).

The feature space has 24 x 7 x 2 = 336 cells, so the training data is first reduced to
one count per cell by a hash aggregate: any number of readings, however skewed, becomes
at most 336 rows. Each tree draws its sample of readings without replacement from those
counts, trees grow in parallel tasks, and every cell is scored once. Scoring readings is
then a broadcast join with the 336-row score table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..functions.severity import severity
from .scaling import FEATURES, detector_features, fit_standard

# Fixed values.
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.05
JOB_CONTAMINATION = 0.01
SEED = 42
EULER = 0.5772156649
SHAPE = (24, 7, 2)

TREE_SCHEMA = (
    "tree_id INT, node INT, feature INT, threshold DOUBLE, "
    "left_node INT, right_node INT, depth INT, size INT"
)
PATH_SCHEMA = "tree_id INT, hour_of_day INT, day_of_week INT, is_active INT, path DOUBLE"


def cell_counts(readings: DataFrame) -> DataFrame:
    """Readings per feature cell (at most 336 rows)."""
    return detector_features(readings).groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"))


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def chance(seed: int, tree: int, what: str) -> float:
    """A number from 0 up to 1 that depends on nothing but its name, in any language."""
    return int(hashlib.md5(f"{seed}:{tree}:{what}".encode()).hexdigest()[:13], 16) / (1 << 52)


def _draw(counts: np.ndarray, size: int, seed: int, tree: int) -> np.ndarray:
    """Rows drawn per cell: ``size`` distinct reading positions out of the total, drawn in turn."""
    total = int(counts.sum())
    picked: dict[int, None] = {}
    turn = 0
    while len(picked) < min(size, total):
        picked[int(chance(seed, tree, f"draw:{turn}") * total)] = None
        turn += 1
    cells = np.searchsorted(np.cumsum(counts), np.array(list(picked), np.int64), side="right")
    return np.bincount(cells, minlength=len(counts))


def _tree_grower(sample: int, seed: int):
    """Nodes are numbered from the root, 1, on: the children of n are 2n and 2n + 1."""

    def grow(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(FEATURES)
        tree = int(cells["tree_id"].iloc[0])
        drawn = _draw(cells["n"].to_numpy(), sample, seed, tree)
        points = cells[FEATURES].to_numpy()[drawn > 0]
        weights = drawn[drawn > 0]
        limit = math.ceil(math.log2(max(int(weights.sum()), 2)))
        rows, todo = [], [(1, np.arange(len(points)), 0)]
        while todo:
            node, members, depth = todo.pop()
            low, high = points[members].min(axis=0), points[members].max(axis=0)
            varying = np.flatnonzero(high > low)
            size = int(weights[members].sum())
            if depth >= limit or len(varying) == 0:
                rows.append((tree, node, -1, 0.0, -1, -1, depth, size))
                continue
            feature = varying[int(chance(seed, tree, f"feature:{node}") * len(varying))]
            share = chance(seed, tree, f"cut:{node}")
            cut = float(low[feature] + share * (high[feature] - low[feature]))
            below = points[members, feature] <= cut
            rows.append((tree, node, int(feature), cut, 2 * node, 2 * node + 1, depth, size))
            todo += [
                (2 * node, members[below], depth + 1),
                (2 * node + 1, members[~below], depth + 1),
            ]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in TREE_SCHEMA.split(", ")])

    return grow


def grow_trees(
    counts: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """Tree nodes as rows, one grouped task per tree over the cell counts."""
    ids = F.sequence(F.lit(0), F.lit(trees - 1))
    per_tree = counts.select(F.explode(ids).alias("tree_id"), *FEATURES, "n")
    return _by_tree(per_tree, trees).applyInPandas(_tree_grower(sample, seed), TREE_SCHEMA)


def _by_tree(frame: DataFrame, trees: int) -> GroupedData:
    """Group by tree over a fixed number of tasks; AQE would merge such small data
    into one task, although the work per row is large."""
    tasks = min(trees, frame.sparkSession.sparkContext.defaultParallelism)
    return frame.repartition(tasks, "tree_id").groupBy("tree_id")


def _cell_paths(tree: pd.DataFrame) -> pd.DataFrame:
    """Normalised path length of each of the 336 cells in one tree."""
    tree = tree.sort_values("node")
    place = {int(node): i for i, node in enumerate(tree["node"])}
    feature, cut = tree["feature"].to_numpy(), tree["threshold"].to_numpy()
    left, right = tree["left_node"].to_numpy(), tree["right_node"].to_numpy()
    depth, size = tree["depth"].to_numpy(), tree["size"].to_numpy()
    grid = np.stack(np.meshgrid(*[np.arange(k) for k in SHAPE], indexing="ij"), -1)
    points = grid.reshape(-1, len(SHAPE))
    norm = average_path(int(size[0])) or 1.0
    path = np.zeros(len(points))
    todo = [(1, np.arange(len(points)))]
    while todo:
        node, members = todo.pop()
        at = place[int(node)]
        if feature[at] < 0:
            path[members] = (depth[at] + average_path(int(size[at]))) / norm
            continue
        below = points[members, feature[at]] <= cut[at]
        todo += [(left[at], members[below]), (right[at], members[~below])]
    frame = pd.DataFrame(points, columns=FEATURES)
    frame.insert(0, "tree_id", int(tree["tree_id"].iloc[0]))
    frame["path"] = path
    return frame


def score_cells(
    trees: DataFrame, counts: DataFrame, contamination: float = CONTAMINATION
) -> DataFrame:
    """Score of every cell: raw score minus the training data's contamination quantile."""
    paths = _by_tree(trees, TREES).applyInPandas(_cell_paths, PATH_SCHEMA)
    raw = paths.groupBy(*FEATURES).agg((-F.pow(F.lit(2.0), -F.avg("path"))).alias("raw"))
    # At most 336 rows from here on.
    weighted = raw.join(counts, FEATURES)
    up_to = Window.orderBy("raw", *FEATURES).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    position = (F.sum("n").over(everything) - 1) * F.lit(float(contamination))
    ranked = weighted.withColumns({"cum": F.sum("n").over(up_to), "pos": position})
    at = lambda rank: F.min(F.when(F.col("cum") > rank, F.col("raw")))
    low, high = at(F.floor("pos")), at(F.ceil("pos"))
    share = F.max(F.col("pos") - F.floor("pos"))
    offset = ranked.agg((low + (high - low) * share).alias("offset")).scalar()
    return raw.select(*FEATURES, (F.col("raw") - offset).alias("score"))


def detect(readings: DataFrame, cells: DataFrame) -> DataFrame:
    """Score and severity of every reading.

    ``cells`` holds at most 336 rows by construction, so it is broadcast.
    """
    scored = detector_features(readings).join(F.broadcast(cells), FEATURES, "left")
    return scored.select(
        "node_id",
        "timestamp",
        F.bround("score", 6).alias("anomaly_score"),
        severity("score").alias("severity"),
    )


def fit_and_save(
    readings: DataFrame,
    path: str,
    model_ts: int,
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    seed: int = SEED,
) -> None:
    """Train and store a model version. The readings are scanned once, for the cell
    counts; each table is written and read back before the next one uses it.

    The ``cells`` table is written last and names the version a reader may use.
    """
    store = lambda frame, table: _write(frame, path, table, model_ts)
    counts = store(cell_counts(readings), "counts")
    store(fit_standard(counts, weight="n"), "scaler")
    grown = store(grow_trees(counts, trees=trees, seed=seed), "trees")
    store(score_cells(grown, counts, contamination), "cells")


def _write(frame: DataFrame, path: str, table: str, model_ts: int) -> DataFrame:
    target = f"{path}/{table}/model_ts={model_ts}"
    frame.coalesce(1).write.mode("overwrite").parquet(target)
    return frame.sparkSession.read.parquet(target)


def load(spark: SparkSession, path: str, table: str = "cells") -> DataFrame:
    """A table of the newest stored model; an unfitted model is an error."""
    try:
        stored = spark.read.parquet(f"{path}/cells").select("model_ts")
        tables = spark.read.parquet(f"{path}/{table}")
    except AnalysisException as error:
        raise RuntimeError(f"no model is stored under {path}") from error
    newest = stored.agg(F.max("model_ts")).scalar()
    return tables.where(F.col("model_ts") == newest).drop("model_ts")
