import numpy as np

from voxmill.llm import logistic


def test_learns_and_calibrates_what_two_features_say():
    rng = np.random.default_rng(1)
    n = 4000
    x = rng.random((n, 3))
    true = 1 / (1 + np.exp(-(6 * x[:, 0] - 4 * x[:, 1] - 1)))
    y = (rng.random(n) < true).astype(float)
    rows, features = np.repeat(np.arange(n), 3), np.tile([5, 9, 12], n)
    train = rows < 3000
    model = logistic.fit(rows[train], features[train], x.ravel()[train], y[:3000], 16, rounds=400)
    sums = (x * model.weights[[5, 9, 12]]).sum(1)
    p = logistic.calibrate(model, sums[3000:], y[3000:]).score(sums)
    assert abs(p - true).mean() < 0.05 and model.weights[0] == 0
    # entries that repeat count as their sum
    twice = logistic.fit(np.repeat(rows[train], 2), np.repeat(features[train], 2), np.repeat(x.ravel()[train] / 2, 2), y[:3000], 16, rounds=400)
    assert np.allclose(twice.weights, model.weights)


def test_without_rows_or_with_one_class_only():
    none = np.zeros(0, np.int64)
    model = logistic.fit(none, none, np.zeros(0), np.zeros(0), 4)
    assert model.score(np.zeros(2)).tolist() == [0.5, 0.5]
    assert logistic.calibrate(model, np.zeros(3), np.ones(3)) is model
