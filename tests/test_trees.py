import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lotwise.operators import boosting, explain, extra_trees, models, tree_values
from lotwise.operators.boosting import BoostedTrees, Tree, TreeSumModel


def table(spark, x, y):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    made = spark.createDataFrame(rows, "Id long, x array<double>, log_target double")
    return made.select("Id", array_to_vector("x").alias("features"), "log_target").repartition(3)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(0, 12, 600), rng.normal(0, 1, 600), rng.integers(0, 2, 600), np.full(600, 3.0)], axis=1)
    y = np.where(x[:, 0] > 5, 2.0, 0.0) + x[:, 1] * x[:, 2] + rng.normal(0, 0.1, 600)
    return x, y


def predictions(model, frame):
    return np.array([r[1] for r in sorted(model.transform(frame).select("Id", "prediction").collect())])


def plain_boosting(x, y, cuts, rounds, depth, rate, lam, alpha, gamma):
    """Level by level, every row and cut looked at."""
    soft = lambda g: math.copysign(max(abs(g) - alpha, 0), g)
    score = lambda g, h: soft(g) ** 2 / (h + lam)
    now = np.full(len(y), y.mean())
    for _ in range(rounds):
        g = now - y

        def grow(rows, level):
            here = score(g[rows].sum(), len(rows))
            best = (max(gamma, 1e-6), None)
            for j in range(x.shape[1]):
                for c in cuts[j]:
                    low = x[rows, j] <= c
                    if 0 < low.sum() < len(rows):
                        gain = score(g[rows][low].sum(), low.sum()) + score(g[rows][~low].sum(), (~low).sum()) - here
                        if gain > best[0] + 1e-12:
                            best = (gain, (j, c))
            if level == depth or best[1] is None:
                now[rows] += rate * -soft(g[rows].sum()) / (len(rows) + lam)
                return
            low = x[rows, best[1][0]] <= best[1][1]
            grow(rows[low], level + 1)
            grow(rows[~low], level + 1)

        grow(np.arange(len(y)), 0)
    return now


def test_level_boosting_equals_brute_force(spark, sample):
    x, y = sample
    frame = table(spark, x, y)
    made = BoostedTrees(rounds=11, maxDepth=2, learningRate=0.2, regLambda=1.5, regAlpha=0.7, gamma=0.05, maxBins=20)
    model = made._set(labelCol="log_target").fit(frame)
    cuts = boosting.cut_points(frame, "features", 4, 20)
    assert len(cuts[3]) == 0 and cuts[2].tolist() == [0.0]
    want = plain_boosting(x, y, cuts, 11, 2, 0.2, 1.5, 0.7, 0.05)
    assert np.allclose(predictions(model, frame), want, atol=1e-7)


@pytest.mark.parametrize("name", ["xgboost", "lightgbm", "catboost", "extra_trees"])
def test_learns_repeats_and_saves(spark, sample, tmp_path, name):
    x, y = sample
    frame = table(spark, x, y)
    few = {"n_estimators": 3, "max_depth": 4, **({} if name == "extra_trees" else {"learning_rate": 0.6})}
    model = models.build_model(name, **few).fit(frame)
    first = predictions(model, frame)
    assert np.mean((first - y) ** 2) < 0.4 * y.var()
    again = models.build_model(name, **few).fit(frame.repartition(7))
    assert np.array_equal(first, predictions(again, frame))
    model.write().overwrite().save(str(tmp_path / name))
    loaded = TreeSumModel.load(str(tmp_path / name))
    assert np.allclose(first, predictions(loaded, frame))


def test_the_three_ways_differ(spark, sample):
    x, y = sample
    frame = table(spark, x, y)
    shapes = {}
    for how in ("level", "leaf", "oblivious"):
        made = BoostedTrees(how=how, rounds=2, maxDepth=4, numLeaves=6, maxBins=32)._set(labelCol="log_target")
        shapes[how] = made.fit(frame)
    assert all(sum(f < 0 for f in t.feature) == 6 for t in shapes["leaf"].trees)
    for t in shapes["oblivious"].trees:
        levels, nodes = [], [0]
        while t.feature[nodes[0]] >= 0:
            levels.append({(t.feature[n], t.cut[n]) for n in nodes})
            nodes = [c for n in nodes for c in (t.low[n], t.high[n])]
        assert len(nodes) == 16 and all(len(x) == 1 for x in levels)
    assert len({tuple(predictions(m, frame).round(9)) for m in shapes.values()}) == 3


def test_leaf_queue_takes_the_largest_gains(spark, sample):
    """A tree without a depth: a leaf that is left has no better split than the last one taken."""
    x, y = sample
    frame = table(spark, x, y)
    small = BoostedTrees(how="leaf", rounds=1, maxDepth=-1, numLeaves=5, learningRate=1.0, regLambda=0.0, maxBins=16)
    large = small.copy({small.numLeaves: 6})
    errors = [np.mean((predictions(m._set(labelCol="log_target").fit(frame), frame) - y) ** 2) for m in (small, large)]
    assert errors[1] < errors[0]


def test_models_that_grow_together_equal_those_alone(spark, sample, monkeypatch):
    monkeypatch.setattr(boosting, "REBASE", 2)
    frame = table(spark, *sample).withColumn("part", F.when(F.col("Id") % 50 > 0, F.col("Id") % 3))
    few = {"xgboost": {"n_estimators": 3}, "lightgbm": {"n_estimators": 5, "max_depth": None}, "catboost": {"n_estimators": 4, "max_depth": 3}}
    made = [models.build_model(n, max_bins=9 + i, **{"max_depth": 4, **c}) for i, (n, c) in enumerate(few.items())]
    wanted = [(m, held) for held in (0, 1, 2, None) for m in made]
    together, passes = boosting.fit_together(wanted, frame, F.col("part"))
    held_out = sorted(tuple(r) for r in passes.held_out(["a", "b", "c"]).collect())
    alone = [m.fit(frame if held is None else frame.where(F.col("part") != held)) for m, held in wanted]
    for one, two in zip(together, alone):
        for a, b in zip(one.trees, two.trees, strict=True):
            assert (a.feature, a.threshold, a.low, a.high, a.cover) == (b.feature, b.threshold, b.low, b.high, b.cover)
            assert np.allclose(a.value, b.value, rtol=1e-6, atol=1e-9)
    want = []
    for held in range(3):
        rows = frame.where(F.col("part") == held)
        found = [predictions(m, rows) for m in alone[3 * held : 3 * held + 3]]
        want += zip([r[0] for r in rows.orderBy("Id").select("log_target").collect()], *found)
    assert len(held_out) == 588 and np.allclose(held_out, sorted(want), atol=1e-9)


def test_stacked_boosting_shares_its_passes(spark, sample, monkeypatch):
    frame = table(spark, *sample)
    bases = [models.build_model(n, n_estimators=2, max_depth=2) for n in models.ENSEMBLE_PREFERENCE[:3]]
    asked, best = [], boosting.Passes._best_splits
    monkeypatch.setattr(boosting.Passes, "_best_splits", lambda self, asks: asked.append(len(asks)) or best(self, asks))
    model = models.Stacking(bases).fit(frame)
    assert asked[0] == 12 and len(asked) <= 6  # alone each of the 12 fits has passes of its own
    monkeypatch.setattr(models.Stacking, "_boosted", models.Stacking._fitted)
    assert np.allclose(predictions(model, frame), predictions(models.Stacking(bases).fit(frame), frame), atol=1e-6)


def test_few_values_are_counted_and_many_sketched(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 2, 900), rng.integers(0, 33, 900), rng.integers(0, 30, 900) / 7, np.full(900, np.nan)], axis=1)
    x[::9, 2] = np.nan
    frame = table(spark, x, rng.normal(0, 1, 900)).withColumn("_part", F.when(F.col("Id") % 50 > 0, F.col("Id") % 2).cast("int"))
    cells = frame.select("_part", vector_to_array("features").alias("x"))
    few = boosting._few_valued(cells, 4, [0, None])
    assert sorted(few) == [0, 2]
    part = np.array([i % 2 if i % 50 else -1 for i in range(900)])
    for j in (0, 2):
        values, counts = few[j]
        for held, rows in ((0, x[part == 1, j]), (None, x[:, j])):
            there, n = np.unique(rows[~np.isnan(rows)], return_counts=True)
            assert dict(zip(values[counts[held] > 0], counts[held][counts[held] > 0])) == dict(zip(there, n))
    cuts = boosting.cuts_of_parts(frame, "features", 4, {0: [5, 40], None: [40]})
    for (held, bins), found in cuts.items():
        for j in range(4):
            v = np.sort(x[part == 1, j] if held == 0 else x[:, j])
            v = v[~np.isnan(v)]
            want = np.unique(v[[math.ceil(k / bins * len(v)) - 1 for k in range(1, bins)]]) if len(v) else v
            assert np.array_equal(found[j], want[want < v[-1]] if len(v) else v)


def test_rows_are_placed_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    tree, x = random_tree(rng, 6, 7), rng.normal(0, 1, (500, 6))
    x[::7, 2] = np.nan
    monkeypatch.setattr(boosting, "MANY_ROWS", 10**9)
    alone = tree.place(x)
    for rows in (1, 20, 256):
        monkeypatch.setattr(boosting, "MANY_ROWS", rows)
        assert np.array_equal(tree.place(x), alone) and len(tree.place(x[:0])) == 0


def test_missing_values_and_no_rows(spark):
    x = np.array([[1.0], [2.0], [np.nan], [np.nan]] * 10)
    y = np.array([0.0, 0.0, 5.0, 5.0] * 10)
    frame = table(spark, x, y)
    for name in ("xgboost", "lightgbm", "catboost", "extra_trees"):
        settings = {"n_estimators": 2} if name == "extra_trees" else {"n_estimators": 2, "learning_rate": 1.0}
        model = models.build_model(name, **settings).fit(frame)
        found = predictions(model, frame)
        assert np.isfinite(found).all()
        assert model.transform(frame.limit(0)).count() == 0
        with pytest.raises(ValueError):
            models.build_model(name, **settings).fit(frame.limit(0))


def test_drawn_thresholds_lie_between_the_bounds(spark, sample):
    x, y = sample
    model = models.build_model("extra_trees", n_estimators=4, max_depth=5).fit(table(spark, x, y))
    for tree in model.trees:
        open_ = [(0, np.arange(len(y)))]
        while open_:
            node, rows = open_.pop()
            assert math.isclose(tree.value[node], y[rows].mean(), abs_tol=1e-9) and tree.cover[node] == len(rows)
            if tree.feature[node] >= 0:
                own = x[rows, tree.feature[node]]
                assert own.min() <= tree.threshold[node] < own.max()
                low = own <= tree.threshold[node]
                open_ += [(tree.low[node], rows[low]), (tree.high[node], rows[~low])]
    u = extra_trees.drawn(42, np.arange(50)[:, None, None], np.arange(1, 20)[:, None], np.arange(30))
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01
    flat = u.reshape(-1, 30)
    assert np.abs(np.corrcoef(flat.T) - np.eye(30)).max() < 0.15


def plain_shapley(predict, x, background):
    """The sum over all subsets of features."""
    p = len(x)

    def value(subset):
        mixed = background.copy()
        mixed[:, list(subset)] = x[list(subset)]
        return predict(mixed).mean()

    out = np.zeros(p)
    for j in range(p):
        rest = [k for k in range(p) if k != j]
        for size in range(p):
            weight = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
            for s in itertools.combinations(rest, size):
                out[j] += weight * (value((*s, j)) - value(s))
    return out


def random_tree(rng, p, depth):
    tree = Tree()

    def grow(level):
        node = tree.add(float(rng.normal()), 0.0)
        if level < depth and rng.random() > 0.15:
            feature, cut = int(rng.integers(p)), float(rng.normal())
            low, high = grow(level + 1), grow(level + 1)
            tree.split(node, feature, -1, cut, low, high)
        return node

    grow(0)
    return tree


def test_tree_values_equal_the_sum_over_subsets():
    rng = np.random.default_rng(7)
    weighted = [(float(rng.normal()), random_tree(rng, 8, 5)) for _ in range(4)]
    background, x = rng.normal(0, 1, (9, 8)), rng.normal(0, 1, (3, 8))

    def predict(rows):
        return sum(w * t.predict(rows) for w, t in weighted)

    found = tree_values.shapley(weighted, x, background)
    for row, values in zip(x, found):
        assert np.allclose(values, plain_shapley(predict, row, background), atol=1e-10)
    assert np.allclose(found.sum(axis=1) + predict(background).mean(), predict(x))


@pytest.mark.parametrize(
    "name", ["decision_tree", "random_forest", "gradient_boosting", "extra_trees", "xgboost", "lightgbm", "catboost", "voting", "stacking"]
)
def test_values_of_every_kind_add_up(prepared, name):
    few = {"decision_tree": {}, "extra_trees": {"n_estimators": 4, "max_depth": 5}, "random_forest": {"n_estimators": 4, "max_depth": 5}}
    if name in ("voting", "stacking"):
        bases = [models.build_model("xgboost", n_estimators=2), models.build_model("decision_tree", max_depth=3)]
        model = {"voting": models.Voting, "stacking": models.Stacking}[name](bases).fit(prepared.train)
    else:
        model = models.build_model(name, **few.get(name, {"n_estimators": 2})).fit(prepared.train)
    cells, base = explain.row_cells(model, explain.background(prepared.train), prepared.slots)
    rows = model.transform(prepared.test).select("Id", "prediction", "features", cells.alias("cells"))
    total = F.aggregate("cells", F.lit(base), lambda a, c: a + c["contribution"])
    assert rows.agg(F.max(F.abs(total - F.col("prediction")))).first()[0] < 1e-9
    one = rows.first()
    assert [c["feature"] for c in one["cells"]] == list(prepared.slots)
    assert [c["x"] for c in one["cells"]] == one["features"].toArray().tolist()


def test_paths_of_sampled_values_end_at_the_prediction(prepared):
    """A model that is neither linear nor made of trees: each row starts at its own base."""
    from lotwise.plans.reports import explanation_tables
    from lotwise.plans.training import Prepared

    model = models.build_model("svr").fit(prepared.train)
    few = Prepared(prepared.train, prepared.test.limit(3), prepared.names, prepared.slots, prepared.before_model)
    tables = explanation_tables(few, model, 3, permutations=2)
    ends = {r["Id"]: r["prediction"] for r in model.transform(few.test).select("Id", "prediction").collect()}
    for name in ("waterfall", "decision"):
        rows = tables[name].collect()
        for key, want in ends.items():
            last = max((r for r in rows if r["Id"] == key), key=lambda r: r["position"])
            assert math.isclose(last["running_total"], want, abs_tol=1e-9)


def test_parsed_trees_predict_the_same(prepared):
    model = models.build_model("random_forest", n_estimators=3, max_depth=6).fit(prepared.train)
    trees = tree_values.parsed(model.toDebugString)
    assert len(trees) == 3
    rows = model.transform(prepared.test).select(vector_to_array("features").alias("x"), "prediction").collect()
    x = np.array([r["x"] for r in rows])
    assert np.allclose(sum(t.predict(x) for t in trees) / 3, [r["prediction"] for r in rows])
