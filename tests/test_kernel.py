import numpy as np
import pytest
from test_trees import predictions, table

from lotwise.operators import kernel, models
from lotwise.operators.kernel import KernelModel, KernelRegressor, loss, waves


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 3))
    return x, np.sin(2 * x[:, 0]) + 0.3 * x[:, 1] + rng.normal(0, 0.1, 400) + 7


@pytest.fixture(scope="module")
def fitted(spark, sample):
    """Models by cost and epsilon, each fitted once."""
    x, y = sample
    have = {}

    def fit(cost, epsilon):
        if (cost, epsilon) not in have:
            made = KernelRegressor(size=60, C=cost, epsilon=epsilon)._set(labelCol="log_target")
            have[cost, epsilon] = made.fit(table(spark, x, y))
        return have[cost, epsilon]

    return fit


@pytest.mark.parametrize("cost,epsilon", [(10.0, 0.01), (2.0, 0.5)])
def test_solution_meets_its_conditions(fitted, sample, cost, epsilon):
    """Weights are the sum of the columns, each row counting between -C and C, and not at all inside the tube."""
    x, y = sample
    model = fitted(cost, epsilon)
    v = np.array(model.getOrDefault(model.weights))
    z = waves(x, 42, 60, model.getOrDefault(model.gamma))
    e = y - z @ v[:-1] - v[-1]
    delta = kernel.STAGES[-1] * y.std()
    counts = cost * loss(e, epsilon, delta)[1]
    assert np.allclose(z.T @ counts, v[:-1], atol=0.02 * np.abs(v).max()) and abs(counts.sum()) < 0.02 * cost * len(y) ** 0.5
    assert (counts[np.abs(e) <= epsilon] == 0).all()

    def objective(w):
        return 0.5 * w[:-1] @ w[:-1] + cost * np.maximum(np.abs(y - z @ w[:-1] - w[-1]) - epsilon, 0).sum()

    rng = np.random.default_rng(1)
    best = objective(v)
    assert all(objective(v + size * rng.normal(0, 1, len(v))) > best * 0.999 for size in (1e-3, 1e-2, 0.1) for _ in range(20))


def test_epsilon_changes_the_fit(spark, sample, fitted):
    x, y = sample
    frame = table(spark, x, y)
    narrow, wide = (y - predictions(fitted(*k), frame) for k in ((10.0, 0.01), (2.0, 0.5)))
    assert np.mean(np.abs(narrow)) < 0.9 * np.mean(np.abs(wide))
    assert np.mean(np.abs(wide) <= 0.52) > 0.9


def test_saved_and_refused(spark, sample, fitted, tmp_path):
    x, y = sample
    frame = table(spark, x, y)
    model = fitted(10.0, 0.01)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert np.array_equal(predictions(model, frame), predictions(KernelModel.load(str(tmp_path / "m")), frame))
    assert model.transform(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        models.build_model("svr").fit(frame.limit(0))
