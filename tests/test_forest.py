import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.functions.timecols import DAY_MS, HOUR_MS
from wattloom.operators import isolation_forest as forest
from wattloom.schemas import READING

MONDAY = 1_704_067_200_000


def daytime(spark, n=300, hours=range(8, 23)):
    """Readings in the given hours only, over two weeks."""
    rng = random.Random(42)
    rows = []
    for i in range(n):
        ms = MONDAY + (i % 14) * DAY_MS + rng.choice(list(hours)) * HOUR_MS
        rows.append((f"plug-{i % 5:02d}", ms, 230.0, 0.3, 60.0, 5.0))
    return spark.createDataFrame(rows, READING)


def at_hour(spark, hour, power=60.0):
    return spark.createDataFrame(
        [("main-03", MONDAY + hour * HOUR_MS, 230.0, 0.3, power, 5.0)], READING
    )


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("forest") / "model")
    forest.fit_and_save(daytime(spark), path, model_ts=1)
    return path


def test_unfitted_model_is_an_error(spark, folder):
    with pytest.raises(RuntimeError):
        forest.load(spark, folder + "/nothing")


def test_three_in_the_morning_is_flagged(spark, model):
    cells = forest.load(spark, model)
    night = forest.detect(at_hour(spark, 3), cells).first()
    day = forest.detect(at_hour(spark, 14), cells).first()
    assert night["severity"] != "normal"
    assert night["anomaly_score"] < day["anomaly_score"]
    assert (night["node_id"], night["timestamp"]) == ("main-03", MONDAY + 3 * HOUR_MS)


def test_contamination_share_of_training_data(spark, model):
    scored = forest.detect(daytime(spark), forest.load(spark, model))
    share = scored.where("severity <> 'normal'").count() / 300
    assert 0.03 <= share <= 0.10
    assert scored.where("anomaly_score IS NULL").count() == 0


def test_every_cell_is_scored_once(spark, model):
    cells = forest.load(spark, model)
    assert cells.count() == 336
    assert cells.select("hour_of_day", "day_of_week", "is_active").distinct().count() == 336


def test_idle_device_scores(spark, model):
    row = forest.detect(at_hour(spark, 14, power=0.0), forest.load(spark, model)).first()
    assert isinstance(row["anomaly_score"], float)


def test_training_is_reproducible_on_any_partitioning(spark):
    def trees(n):
        counts = forest.cell_counts(daytime(spark).repartition(n))
        return sorted(map(tuple, forest.grow_trees(counts, trees=10).collect()))

    assert trees(1) == trees(6)


def test_a_new_version_replaces_the_old(spark, folder):
    forest.fit_and_save(daytime(spark), folder + "/m", 1, trees=5)
    forest.fit_and_save(daytime(spark, hours=range(0, 5)), folder + "/m", 2, trees=5)
    cells = forest.load(spark, folder + "/m")
    assert cells.count() == 336
    day = forest.detect(at_hour(spark, 14), cells).first()["anomaly_score"]
    night = forest.detect(at_hour(spark, 3), cells).first()["anomaly_score"]
    assert day < night


def test_trees_partition_the_sample(spark):
    counts = forest.cell_counts(daytime(spark))
    trees = forest.grow_trees(counts, trees=8)
    leaves = trees.where("feature < 0").groupBy("tree_id").agg(F.sum("size").alias("n"), F.max("depth").alias("d"))
    rows = leaves.collect()
    assert len(rows) == 8
    assert all(r["n"] == 256 and r["d"] <= 8 for r in rows)


def test_drawing_is_without_replacement_and_proportional():
    counts = np.array([1, 10_000_000_000, 5_000_000_000])
    total = np.zeros(3)
    for seed in range(50):
        drawn = forest._draw(counts, 256, 42, seed)
        assert drawn.sum() == 256 and drawn[0] <= 1
        total += drawn
    assert total[1] / total.sum() == pytest.approx(2 / 3, abs=0.02)
    small = np.array([3, 2])
    assert forest._draw(small, 256, 42, 0).tolist() == [3, 2]


def test_average_path_constants():
    assert forest.average_path(1) == 0.0
    assert forest.average_path(2) == 1.0
    assert forest.average_path(256) == pytest.approx(10.244770, abs=1e-5)


def test_scores_match_an_independent_walk(spark):
    """Path lengths recomputed one cell at a time from the stored tree rows."""
    counts = forest.cell_counts(daytime(spark))
    trees = forest.grow_trees(counts, trees=6).persist()
    by_tree = {}
    for row in trees.collect():
        by_tree.setdefault(row["tree_id"], {})[row["node"]] = row
    cells = {
        (r["hour_of_day"], r["day_of_week"], r["is_active"]): r["score"]
        for r in forest.score_cells(trees, counts, 0.05).collect()
    }
    raw = {}
    for cell in cells:
        paths = []
        for nodes in by_tree.values():
            node = nodes[1]
            while node["feature"] >= 0:
                side = "left_node" if cell[node["feature"]] <= node["threshold"] else "right_node"
                node = nodes[node[side]]
            paths.append((node["depth"] + forest.average_path(node["size"])) / forest.average_path(256))
        raw[cell] = -(2.0 ** -np.mean(paths))
    training = []
    for r in counts.collect():
        training += [raw[(r["hour_of_day"], r["day_of_week"], r["is_active"])]] * r["n"]
    offset = np.percentile(training, 5)
    for cell, score in cells.items():
        assert score == pytest.approx(raw[cell] - offset, abs=1e-9)
    trees.unpersist()
