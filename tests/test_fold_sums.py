import math

import numpy as np
import pytest

from lotwise.operators import fold_sums, models, tuning
from lotwise.operators.fold_sums import FoldSums


@pytest.mark.parametrize("name", ["linear_regression", "ridge", "lasso", "elasticnet"])
def test_scores_equal_those_of_fits(prepared, name):
    one_pass = tuning.fold_scores(models.build_model(name), prepared.train, 2, with_train=True)
    fitted = tuning.fold_scores(lambda: models.build_model(name), prepared.train, 2, with_train=True)
    for a, b in zip(one_pass, fitted):
        assert a[0] == b[0] and all(math.isclose(x, y, rel_tol=2e-4) for x, y in zip(a[1:], b[1:]))


def test_a_search_and_a_curve_are_one_pass(prepared, monkeypatch):
    passes = []
    of = FoldSums.of.__func__

    def counted(cls, *args, **named):
        passes.append(args)
        return of(cls, *args, **named)

    monkeypatch.setattr(FoldSums, "of", classmethod(counted))
    trials = tuning.random_search("elasticnet", prepared.train, n_iter=8).collect()
    assert len(trials) == 8 and len(passes) == 1
    curve = tuning.learning_curve(lambda: models.build_model("ridge"), prepared.train).collect()
    assert [r["share"] for r in curve] == tuning.LEARNING_SHARES and len(passes) == 2
    assert curve[0]["validation_rmse"] > curve[-1]["validation_rmse"]
    tuning.validation_curve("ridge", "alpha", tuning.GRIDS["ridge"]["alpha"], prepared.train)
    assert len(passes) == 3


def test_other_models_and_wide_tables_are_fitted(prepared, monkeypatch):
    assert tuning.linear_scores([models.build_model("decision_tree")], prepared.train, 2) is None
    monkeypatch.setattr(fold_sums, "MAX_BYTES", 1000)
    assert tuning.linear_scores([models.build_model("ridge")], prepared.train, 2) is None
    assert len(tuning.fold_scores(models.build_model("ridge"), prepared.train, 2)) == 2


def test_solutions_meet_their_conditions():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 12)) + 5
    x[:, 3] = x[:, 2]  # twice the same column
    y = x[:, 0] - 2 * x[:, 5] + rng.normal(0, 0.3, 300)
    z = np.column_stack([np.ones(300), x, y])
    for l1, l2 in ((0.0, 0.0), (0.0, 0.4), (0.05, 0.0), (0.02, 0.3)):
        fit = fold_sums.solve(z.T @ z, l1, l2)
        e = y - fit[0] - x @ fit[1:]
        slope = (x - x.mean(axis=0)).T @ e / 300 - l2 * fit[1:]
        on = fit[1:] != 0
        assert abs(e.mean()) < 1e-9 and np.allclose(slope[on], l1 * np.sign(fit[1:][on]), atol=1e-7)
        assert (np.abs(slope[~on]) <= l1 + 1e-7).all()
        assert math.isclose(fold_sums.rmse(z.T @ z, fit), np.sqrt((e**2).mean()), rel_tol=1e-9)
