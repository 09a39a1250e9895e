import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lotwise.operators import encoding, explain, knn, models, selection, splits, tuning


def test_feature_types(spark):
    df = spark.createDataFrame([(1, 2.0, 3, "RL"), (2, 3.0, 4, "RM")], "Id int, SalePrice double, LotArea int, MSZoning string")
    assert encoding.split_feature_types(df) == (["LotArea"], ["MSZoning"])


def test_unseen_category_is_an_all_zero_block(engineered):
    encoder = encoding.fit_encoder(engineered, ["LotArea"], ["Neighborhood"])
    row = engineered.limit(1).withColumn("Neighborhood", F.lit("NeverSeenBefore"))
    out = encoder.transform(row).select(vector_to_array("features").alias("x")).collect()
    assert len(out) == 1 and sum(out[0]["x"][1:]) == 0
    assert len(encoding.encoded_names(encoder)) == len(out[0]["x"])


def test_scaling_uses_the_population_deviation(engineered):
    encoder = encoding.fit_encoder(engineered, ["LotArea", "YrSold"], [])
    x = np.array([r["x"] for r in encoder.transform(engineered).select(vector_to_array("features").alias("x")).collect()])
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0), 1)


def test_linear_models_share_the_pass_of_their_folds(prepared, monkeypatch):
    from lotwise.operators.fold_sums import FoldSums
    from lotwise.plans.training import train_and_evaluate

    zoo = {n: models.build_model(n) for n in ("ridge", "elasticnet", "lasso")}
    alone = {n: tuning.mean_std([s[2] for s in tuning.fold_scores(e, prepared.train, 2)]) for n, e in zoo.items()}
    passes, of = [], FoldSums.of
    monkeypatch.setattr(FoldSums, "of", lambda *args: passes.append(args) or of(*args))
    _, board, failures = train_and_evaluate(prepared, zoo, folds=2)
    assert len(passes) == 1 and not failures
    for row in board.collect():
        assert (row["cv_rmse_mean"], row["cv_rmse_std"]) == pytest.approx(alone[row["name"]], rel=1e-9, abs=1e-12)


def test_folds_of_prepared_rows_need_no_digest(prepared):
    def plan(c):
        return prepared.train.select(c.alias("f"))._jdf.queryExecution().optimizedPlan().toString()

    own, digest = splits.fold_of(prepared.train, 3), splits.hash_bucket(F.col("Id"), 3, splits.FOLD_SEED)
    assert "md5" not in plan(own) and "md5" in plan(digest)
    assert prepared.train.where(~own.eqNullSafe(digest)).isEmpty()
    assert "md5" in plan(splits.fold_of(prepared.train, 3, seed=7))


def test_a_failed_shared_pass_leaves_every_model_its_own(prepared, monkeypatch):
    from lotwise.plans import training

    def fail(*_):
        raise RuntimeError("no")

    monkeypatch.setattr(training, "shared_fold_scores", fail)
    _, board, failures = training.train_and_evaluate(prepared, {"ridge": models.build_model("ridge")}, folds=2)
    assert not failures and math.isfinite(board.first()["cv_rmse_mean"])


class Broken(models.PenalizedLinear):
    """Fails to learn from ``most`` rows or fewer."""

    most = 10**9

    def copy(self, extra=None):
        out = super().copy(extra)
        out.most = self.most
        return out

    def _fit(self, df):
        if df.count() <= self.most:
            raise RuntimeError("no memory left")
        return super()._fit(df)


@pytest.mark.parametrize("where", ["fit", "folds", "numbers"])
def test_a_failure_is_no_result(prepared, monkeypatch, tmp_path, where):
    from lotwise.plans import training

    broken = Broken(alpha=1.0)._set(featuresCol="features", labelCol=splits.LOG_TARGET)
    if where == "folds":
        broken.most = prepared.train.count() - 1  # the whole table can be learned from, its folds cannot
        monkeypatch.setattr(tuning, "linear_scores", lambda *args: None)
    if where == "numbers":
        broken.most = -1
        monkeypatch.setattr(training, "shared_fold_scores", lambda *args: {"broken": [(0, None, math.nan), (1, None, 0.1)]})
    zoo = {"broken": broken, "decision_tree": models.build_model("decision_tree", max_depth=2)}
    fitted, board, failures = training.train_and_evaluate(prepared, zoo, folds=2)
    assert [r["name"] for r in board.collect()] == [*fitted] == ["decision_tree"]
    assert len(failures) == 1 and "broken" in [*failures][0]
    monkeypatch.setattr(training, "prepare", lambda *args: prepared)
    with pytest.raises(RuntimeError, match="broken"):
        training.run_training(None, str(tmp_path / "saved"), zoo, folds=2)
    assert not (tmp_path / "saved").exists()


def test_the_comparison_is_of_the_whole_zoo(prepared, monkeypatch):
    from lotwise.plans.catalog import comparing

    asked = []

    def recorded(data, zoo, folds=5):
        asked.append((zoo, folds))
        return {}, data.spark.createDataFrame([("a", 1.0)], "name string, train_time_seconds double"), {}

    monkeypatch.setattr(comparing, "stored_listing", lambda *args: None)
    monkeypatch.setattr(comparing, "prepare", lambda *args: prepared)
    monkeypatch.setattr(comparing, "train_and_evaluate", recorded)
    comparing.compare_models(None, "")
    [(zoo, folds)] = asked
    assert [*zoo] == models.model_names() and folds == 5
    for name, settings in models.SETTINGS.items():
        own = {p.name: v for p, v in zoo[name].extractParamMap().items()}
        assert own == {p.name: v for p, v in models.build_model(name, **settings).extractParamMap().items()}


def test_registry():
    assert len(models.model_names()) == 15
    assert models.build_model("ridge").getOrDefault("alpha") == 10.0
    assert models.get_model("random_forest", seed=7).getSeed() == 7
    with pytest.raises(ValueError):
        models.get_model("nothing")


def test_ridge_equals_the_normal_equations(prepared):
    rows = prepared.train.select(vector_to_array("features").alias("x"), splits.LOG_TARGET).collect()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 10 * np.eye(x.shape[1]), xc.T @ yc)
    model = models.build_model("ridge").fit(prepared.train)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-8)


def test_elastic_net_meets_its_conditions(prepared):
    rows = prepared.train.select(vector_to_array("features").alias("x"), splits.LOG_TARGET).collect()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    w = models.build_model("elasticnet").fit(prepared.train).coefficients.toArray()
    xc, yc = x - x.mean(axis=0), y - y.mean()
    slope = xc.T @ (yc - xc @ w) / len(y) - 0.0005 * w
    on = np.abs(w) > 1e-7
    assert np.allclose(slope[on], 0.0005 * np.sign(w[on]), atol=2e-5) and (np.abs(slope[~on]) <= 0.0005 + 2e-5).all()


@pytest.mark.parametrize("name", ["decision_tree", "random_forest", "extra_trees", "gradient_boosting", "svr"])
def test_models_beat_the_mean_and_repeat(prepared, name):
    few = {"random_forest": {"n_estimators": 10, "max_depth": 6}, "extra_trees": {"n_estimators": 10, "max_depth": 8}}
    few["gradient_boosting"] = {"n_estimators": 15, "learning_rate": 0.2}
    runs = []
    for _ in range(2):
        model = models.build_model(name, **few.get(name, {})).fit(prepared.train)
        error = F.col(splits.LOG_TARGET) - F.col("prediction")
        runs.append(model.transform(prepared.test).agg(F.avg(error * error), F.var_pop(splits.LOG_TARGET)).first())
    assert runs[0][0] < runs[0][1] * 0.8
    assert math.isclose(runs[0][0], runs[1][0], rel_tol=1e-6)


def test_stacking_and_voting(prepared):
    bases = [models.build_model("ridge"), models.build_model("decision_tree", max_depth=4)]
    test = prepared.test
    truth = F.col(splits.LOG_TARGET)
    for model in (models.Stacking(bases).fit(prepared.train), models.Voting(bases).fit(prepared.train)):
        out = model.transform(test)
        assert out.agg(F.avg((truth - F.col("prediction")) ** 2)).first()[0] < test.agg(F.var_pop(truth)).first()[0] * 0.5
    means = out.select(F.abs(F.col("prediction") - (F.col("base_0") + F.col("base_1")) / 2).alias("d"))
    assert means.agg(F.max("d")).first()[0] < 1e-12


@pytest.mark.parametrize("block", [7, 512])
def test_neighbors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "LEAST_PIVOTS", 8)
    monkeypatch.setattr(knn, "BLOCKS_PER_TASK", 3)
    rng = np.random.default_rng(3)
    refs = np.concatenate([rng.normal(0, 1, (200, 3)), np.zeros((100, 3)), rng.normal(9, 0.5, (50, 3))])
    queries = np.concatenate([rng.normal(0, 2, (30, 3)), np.zeros((3, 3))])
    r = spark.createDataFrame([(i, [float(a) for a in v], float(i)) for i, v in enumerate(refs)], "Id long, features array<double>, y double")
    q = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(queries)], "Id long, features array<double>")
    got = {(x["query_key"], x["rank"]): (x["neighbor_key"], x["distance"], x["y"]) for x in knn.nearest_neighbors(q, r, 5, payload=["y"]).collect()}
    assert len(got) == 33 * 5
    for i, v in enumerate(queries):
        d = np.sqrt(((refs - v) ** 2).sum(axis=1))
        for place, j in enumerate(sorted(range(len(refs)), key=lambda j: (d[j], j))[:5]):
            key, distance, y = got[(i, place + 1)]
            assert math.isclose(distance, d[j], abs_tol=1e-9) and y == key
            assert key == j or math.isclose(d[key], d[j], abs_tol=1e-9)


def test_neighbors_at_distance_zero_decide_alone(spark):
    near = spark.createDataFrame([(1, 0.0, 4.0), (1, 0.0, 6.0), (1, 2.0, 100.0), (2, 1.0, 1.0), (2, 2.0, 4.0)], "query_key long, distance double, y double")
    got = {r[0]: r[1] for r in knn.weighted_mean(near, "y").collect()}
    assert got[1] == 5.0 and math.isclose(got[2], 2.0)


def test_splits_and_folds_cover_every_row_once(houses):
    train, test = splits.train_test_split(houses)
    assert train.count() + test.count() == houses.count()
    assert train.join(test, "Id", "left_semi").count() == 0
    share = test.count() / houses.count()
    assert 0.15 < share < 0.25
    sizes = splits.with_fold(houses, 5).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in sizes) == [0, 1, 2, 3, 4]


def test_search_draws_within_the_grid(prepared):
    trials = tuning.random_search("ridge", prepared.train, n_iter=2, folds=2).collect()
    assert len(trials) == 2 and sum(t["is_best"] for t in trials) == 1
    assert all(float(t["params"]["alpha"]) in tuning.GRIDS["ridge"]["alpha"] for t in trials)
    with pytest.raises(ValueError):
        tuning.random_search("linear_regression", prepared.train)


def test_permuted_rows_are_a_permutation(spark):
    rows = spark.range(500).select(F.col("id").alias("Id"), F.col("id").alias("features"))
    pairs = selection.permuted_pairs(rows, 2, "Id", 42, per_bucket=50)
    for repeat in (0, 1):
        part = pairs.where(F.col("repeat") == repeat).collect()
        assert sorted(p["other"] for p in part) == list(range(500))
        assert sum(p["other"] == p["Id"] for p in part) < 25


def test_sampled_contributions_add_up(prepared):
    model = models.build_model("decision_tree", max_depth=3).fit(prepared.train)
    rows = prepared.test.limit(5)
    names = [str(i) for i in range(model.numFeatures)]
    phi, base = explain.sampled_contributions(rows, model, prepared.train, names, permutations=3)
    total = phi.groupBy("Id").agg(F.sum("contribution").alias("s")).join(base, "Id")
    both = model.transform(rows).select("Id", "prediction").join(total, "Id").collect()
    assert len(both) == 5
    for r in both:
        assert math.isclose(r["s"] + r["base_value"], r["prediction"], abs_tol=1e-9)


def test_linear_contributions_add_up(prepared):
    model = models.build_model("ridge").fit(prepared.train)
    sample = explain.background(prepared.train)
    base = explain.linear_base_value(model, sample)
    phi = explain.vector_contributions(prepared.test, model, sample, prepared.slots)
    total = phi.groupBy("Id").agg(F.sum("contribution").alias("s"))
    gap = model.transform(prepared.test).join(total, "Id").select(F.abs(F.col("prediction") - F.col("s") - base).alias("d"))
    assert gap.agg(F.max("d")).first()[0] < 1e-9
    cells = prepared.test.select("Id", explain.vector_cells(model, sample, prepared.slots).alias("cells"))
    top = explain.explanations(cells, F.lit(base), top=12).first()["contributions"]
    sizes = [abs(c["value"]) for c in top]
    assert len(top) == 12 and sizes == sorted(sizes, reverse=True)


def test_knn_for_any_keys(spark):
    """Repeated, missing, text and absent keys, and no rows: every row gets its own prediction."""
    points = [(i, float(i)) for i in range(8)]
    as_vector = array_to_vector(F.array("x")).alias("features")
    train = spark.createDataFrame([(i, x, 10 * x) for i, x in points], "Id long, x double, log_target double").select("Id", as_vector, "log_target")
    model = models.build_model("knn", n_neighbors=1).fit(train)
    rows = [(5, 0.0), (5, 4.0), (None, 7.0), (None, 7.0)]
    for kind, make in (("long", lambda k: k), ("string", lambda k: None if k is None else f"k{k}")):
        asked = spark.createDataFrame([(make(k), x) for k, x in rows], f"Id {kind}, x double").select("Id", as_vector)
        out = model.transform(asked)
        assert out.columns == ["Id", "features", "prediction"]
        assert sorted((r["features"][0], r["prediction"]) for r in out.collect()) == [(0.0, 0.0), (4.0, 40.0), (7.0, 70.0), (7.0, 70.0)]
        assert model.transform(asked.drop("Id")).count() == 4
        assert model.transform(asked.where("false")).count() == 0
    named = train.withColumn("Id", F.concat(F.lit("k"), "Id"))
    assert models.build_model("knn", n_neighbors=1).fit(named).transform(asked).agg(F.sum("prediction")).first()[0] == 180.0


def test_search_fits_each_meaning_once(prepared):
    grid = {"C": [1.0, 10.0], "epsilon": [0.001, 0.01, 0.1]}
    assert len(tuning.distinct_points("svr", tuning.grid_points(grid))) == 6
    forest = {"max_depth": [2, 3], "min_samples_split": [2, 5, 10]}
    assert tuning.distinct_points("random_forest", tuning.grid_points(forest)) == [{"max_depth": 2}, {"max_depth": 3}]
    deep = tuning.distinct_points("lightgbm", tuning.grid_points(tuning.GRIDS["lightgbm"]))
    assert len(deep) == len(tuning.grid_points(tuning.GRIDS["lightgbm"])) and {p["max_depth"] for p in deep} == {3, 4, 6, 8, None}
    trials = tuning.random_search("random_forest", prepared.train, 30, 2, grid={"n_estimators": [2], "max_depth": [2, 3], "min_samples_split": [2, 5]}).collect()
    assert len(trials) == 2 and all(t["void"] == ["min_samples_split"] for t in trials)


def test_no_tree_without_depth(prepared):
    for name in ("xgboost", "catboost", "extra_trees", "random_forest"):
        with pytest.raises(ValueError, match="max_depth"):
            models.build_model(name, max_depth=None)
        assert tuning.effective(name, {"max_depth": None})["max_depth"] == models.DEEPEST
    # Trees grown leaf by leaf end by their number of leaves.
    assert tuning.effective("lightgbm", {"max_depth": None, "n_estimators": 1})["max_depth"] is None
    model = models.build_model("lightgbm", max_depth=None, n_estimators=1).fit(prepared.train)
    assert sum(f < 0 for f in model.trees[0].feature) <= 31


def test_boosting_ranges_are_run(prepared):
    small = {k: (("int", 1, 2) if k == "n_estimators" else v) for k, v in tuning.BOOSTING_RANGES.items()}
    trials = tuning.range_search("xgboost", prepared.train, small, n_trials=2, folds=2).collect()
    assert all(set(t["params"]) == set(tuning.BOOSTING_RANGES) for t in trials)


def test_a_tree_is_explained_with_the_score(spark, prepared, houses):
    from lotwise.operators.explain import Explainer
    from lotwise.operators.scoring import score

    model = models.build_model("decision_tree", max_depth=3).fit(prepared.train)
    rows = prepared.test.limit(6).select("Id", "features", (F.col("Id") % 2 == 0).alias("explain"))
    rows = rows.unionByName(rows.limit(1).withColumn("explain", F.lit(True)))  # a key twice
    explainer = Explainer(model, explain.background(prepared.train).select("features"), prepared.slots, permutations=4)
    out = score(rows, model, "tree", 1.0, "Id", explainer).collect()
    assert len(out) == 7 and any(r["explanation"] for r in out) and any(r["explanation"] is None for r in out)
    for r in out:
        if r["explanation"] is not None:
            sizes = [abs(c["value"]) for c in r["explanation"]["contributions"]]
            log_price = r["explanation"]["base_value"] + sum(c["value"] for c in r["explanation"]["contributions"])
            assert sizes == sorted(sizes, reverse=True) and len(sizes) == len(prepared.slots)
            assert math.isclose(math.expm1(log_price), r["predicted_price"], abs_tol=0.01)


def test_too_many_labels_are_refused(houses):
    from lotwise.operators.encoding import fit_encoder

    with pytest.raises(ValueError, match="Id"):
        fit_encoder(houses.withColumn("Id", F.col("Id").cast("string")), ["LotArea"], ["Id"], max_labels=10)


def test_neighbours_of_few_columns_meet_few_rows(spark, monkeypatch):
    """Boxed leaves: the answer of brute force, with ties, copies and rows that cannot be near, from few pairs."""
    monkeypatch.setattr(knn, "BLOCK", 64)
    rng = np.random.default_rng(5)
    r = np.concatenate([rng.integers(0, 25, (3000, 3)), np.full((400, 3), 7)]).astype(float)
    q = np.concatenate([rng.integers(-4, 29, (600, 3)), np.full((300, 3), 7)]).astype(float)
    refs = spark.createDataFrame([(i, x.tolist(), float(i)) for i, x in enumerate(r)], "Id long, x array<double>, y double")
    odd = spark.createDataFrame([(9000, [math.nan, 0.0, 0.0], 1.0), (9001, [None, 1.0, 1.0], 1.0)], refs.schema)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "Id long, x array<double>")
    near = knn.nearest_neighbors(rows, refs.unionByName(odd), 10, "Id", "x", ["y"]).collect()
    found = {(n.query_key, n["rank"]): (n.neighbor_key, n.distance, n.y) for n in near}
    assert len(found) == len(near) == 10 * len(q)
    for i, x in enumerate(q):
        d = np.sqrt(((r - x) ** 2).sum(axis=1))
        for rank, j in enumerate(np.argsort(d, kind="stable")[:10], 1):
            key, distance, y = found[i, rank]
            assert (key, y) == (j, float(j)) and distance == pytest.approx(d[j])
    few = knn.nearest_neighbors(rows.limit(5), refs.limit(4), 10, "Id", "x")
    assert few.count() == 20
    # A row far from the cuts meets its own leaf only, and no leaf holds many distinct rows.
    even = rng.uniform(0, 1, (20000, 3))
    assert np.bincount(knn._leaf_udf(*knn._cuts(even, 64)).func(pa.array(list(even))).to_numpy()).max() <= 2 * len(even) // 64


def test_swapped_columns_are_priced_like_probes(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=800), rng.integers(0, 2, 800), rng.normal(size=800), np.zeros(800)])
    y = 2 * x[:, 0] + x[:, 1] + 0.1 * rng.normal(size=800)
    table = spark.createDataFrame([(i, float(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "Id long, log_target double, x array<double>")
    rows = table.select("Id", "log_target", array_to_vector("x").alias("features"))
    model = selection._forest(5, 4, 1).fit(rows)
    pairs = selection.permuted_pairs(rows, 2, "Id", 42, per_bucket=100)
    pairs = pairs.select("log_target", "repeat", vector_to_array("features").alias("x"), vector_to_array("other").alias("z"))
    plain = {(r["repeat"], r["slot"]): r["r2"] for r in selection._probed(pairs, model, 4).collect()}
    spread = rows.agg(F.var_pop("log_target")).first()[0]
    fast = {(r["repeat"], r["slot"]): r["r2"] for r in selection._swapped(pairs, selection.tree_sum_of(model), 4, spread).collect()}
    assert fast.keys() == plain.keys() and len(fast) == 10
    assert all(fast[k] == pytest.approx(plain[k], abs=1e-9) for k in fast)
    assert fast[0, 3] == fast[0, -1] and fast[0, 0] < fast[0, -1] - 0.1
