"""Training of the pair MLP: gradients, checkpoints, resuming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import training
from kindred.operators.score import PairMLP


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    model = PairMLP.random(5, 4, seed=2)
    a, b, t = rng.normal(size=(30, 5)), rng.normal(size=(30, 5)), rng.integers(0, 2, 30)
    loss, grad = training.gradient(model, a, b, t, 2.5)
    row = training.flat(model.layers)
    for i in range(row.size):
        step = np.zeros_like(row)
        step[i] = 1e-6
        up, down = (training.gradient(PairMLP(training.shaped(row + s, model.layers)), a, b, t, 2.5)[0] for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        a = rng.normal(size=6)
        same = int(rng.random() < 0.3)
        b = a + 0.1 * rng.normal(size=6) if same else rng.normal(size=6)
        rows.append((i, i + 1000, same, a.tolist(), b.tolist()))
    rows.append((5000, 5001, 1, None, rows[0][3]))
    return spark.createDataFrame(rows, "left_id long, right_id long, target int, left_v array<double>, right_v array<double>").repartition(6)


def test_cut_and_resumed_equals_uncut(spark, labelled, tmp_path):
    start = PairMLP.random(6, 8, seed=1, column="v")
    batches = lambda: training.Batches.write(labelled, "v", size=150, parts=3)
    whole, state = training.train(start, batches(), spark, 14, rate=0.02, decay=0.01)
    assert sum(n for _, n in batches().counts) == 600
    folder = str(tmp_path / "cp")
    training.train(start, batches(), spark, 6, rate=0.02, decay=0.01, folder=folder, every=4)
    resumed, again = training.train(start, batches(), spark, 14, rate=0.02, decay=0.01, folder=folder, every=4)
    assert again.step == 14 and again.losses == state.losses
    assert (training.flat(whole.layers) == training.flat(resumed.layers)).all()
    assert training.falls(state.losses)
    scores = whole.score_pairs(labelled.filter("left_v is not null")).groupBy("target").agg(F.avg("score").alias("s")).collect()
    by = {r["target"]: r["s"] for r in scores}
    assert by[1] > by[0] + 0.2
    with pytest.raises(ValueError, match="another network"):
        training.train(PairMLP.random(6, 9, column="v"), batches(), spark, 20, folder=folder)


def test_batches_without_positives_are_passed_over(spark, labelled):
    batches = training.Batches.write(labelled.filter("target = 0"), "v", size=100)
    start = PairMLP.random(6, 8, seed=1, column="v")
    model, state = training.train(start, batches, spark, 3)
    assert state.step == 3 and not state.losses and (training.flat(model.layers) == training.flat(start.layers)).all()
