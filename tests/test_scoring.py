import json

import pytest
from pyspark.sql import functions as F

from lotwise.operators import models, scoring
from lotwise.plans.training import load_explainer, load_scorer, run_training
from lotwise.session import work_path
from lotwise.sources import files
from lotwise.streaming.scoring import read_request_stream, score_stream


@pytest.fixture(scope="module")
def winner(spark, houses):
    path = work_path(spark, "winner")
    best, _ = run_training(houses, path, {"ridge": models.build_model("ridge"), "lasso": models.build_model("lasso")}, folds=2)
    pipeline, board = load_scorer(spark, path)
    return pipeline, best, scoring.best_rmse(board, best), path


def scores(spark, winner, rows):
    pipeline, best, rmse, _ = winner
    scored, bad = scoring.score_requests(files.records(spark, rows), pipeline, best, rmse, "row_index")
    return {r["row_index"]: r for r in scored.collect()}, {r["row_index"]: r["errors"] for r in bad.collect()}


def test_interval_and_batch(spark, winner, request_row):
    good, bad = scores(spark, winner, [request_row] * 3)
    assert len(good) == 3 and not bad
    for r in good.values():
        assert 0 <= r["confidence_interval_low"] <= r["predicted_price"] <= r["confidence_interval_high"]
    assert len({r["predicted_price"] for r in good.values()}) == 1


def test_better_quality_costs_more(spark, winner, request_row):
    low = {**request_row, "OverallQual": 3, "ExterQual": "Fa", "KitchenQual": "Fa"}
    high = {**request_row, "OverallQual": 9, "ExterQual": "Ex", "KitchenQual": "Ex"}
    good, _ = scores(spark, winner, [low, high])
    assert good[1]["predicted_price"] > good[0]["predicted_price"]


def test_bad_rows_are_named_and_do_not_shift_others(spark, winner, request_row):
    rows = [{**request_row, "OverallQual": 99}, request_row, {**request_row, "YearRemodAdd": 1990}, {k: v for k, v in request_row.items() if k != "LotArea"}]
    good, bad = scores(spark, winner, rows)
    assert list(good) == [1]
    assert bad == {0: ["OverallQual: out of range"], 2: ["YearRemodAdd: before YearBuilt"], 3: ["LotArea: missing"]}


def test_alias_and_own_name_score_alike(spark, winner, request_row):
    own = {k: v for k, v in request_row.items() if k not in ("FirstFlrSF", "SecondFlrSF")}
    own.update({"1stFlrSF": 900.0, "2ndFlrSF": 800.0})
    good, _ = scores(spark, winner, [request_row, own])
    assert good[0]["predicted_price"] == good[1]["predicted_price"]


def test_json_bodies(spark, request_row):
    body = json.dumps({"properties": [request_row, {**request_row, "GarageCars": 77}]})
    rows = files.parse_batches(spark.createDataFrame([(body,)], "value string"))
    errors = {r["row_index"]: r["errors"] for r in scoring.validated(rows).collect()}
    assert errors == {0: [], 1: ["GarageCars: out of range"]}


def test_stream_equals_batch(spark, winner, houses):
    pipeline, best, rmse, _ = winner
    rows = houses.drop("SalePrice").withColumn("HouseStyle", F.lit("1Story"))
    arriving, out, bad, check = (work_path(spark, n) for n in ("in", "out", "bad", "check"))
    rows.repartition(3).write.json(arriving)
    stream = score_stream(read_request_stream(spark, arriving, files_per_trigger=1), pipeline, best, rmse, out, bad, check, once=True)
    stream.awaitTermination()
    batch, quarantine = scoring.score_requests(rows, pipeline, best, rmse, "Id")
    got = spark.read.parquet(out).drop("batch")
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()
    assert spark.read.parquet(bad).count() == quarantine.count()
    assert got.count() + quarantine.count() == houses.count()


def test_artifacts(spark, winner):
    _, best, rmse, path = winner
    board = files.read_leaderboard(spark, f"{path}/leaderboard")
    assert board.where("is_best").first()["name"] == best and board.count() == 2 and rmse > 0
    runs = files.read_runs(spark, f"{path}/runs").collect()
    assert {r["model"] for r in runs} == {"ridge", "lasso"} and all(r["metrics"]["rmse"] > 0 for r in runs)
    assert len(files.read_feature_list(spark, f"{path}/feature_names")) == 54
    assert scoring.best_rmse(board, "nothing") == 0.0


def test_a_training_column_that_requests_lack(spark, houses, request_row):
    path = work_path(spark, "wider")
    wider = houses.withColumn("Distance", F.col("Id") % 13).withColumn("Zone", F.concat(F.lit("z"), F.col("Id") % 3))
    best, _ = run_training(wider, path, {"ridge": models.build_model("ridge")}, folds=2)
    pipeline, board = load_scorer(spark, path)
    explainer = load_explainer(spark, path, pipeline)
    asked = files.records(spark, [{**request_row, "explain": True}, request_row])
    out, bad = scoring.score_requests(asked, pipeline, best, scoring.best_rmse(board, best), "row_index", explainer)
    rows = {r["row_index"]: r for r in out.collect()}
    assert bad.count() == 0 and rows[0]["predicted_price"] == rows[1]["predicted_price"] > 0
    assert rows[1]["explanation"] is None
    names = [c["feature"] for c in rows[0]["explanation"]["contributions"]]
    assert "Distance" in names and len(names) == len(set(names)) == len(explainer.names)


def test_csv_tokens(spark, tmp_path):
    (tmp_path / "h.csv").write_text("SalePrice,Id,LotFrontage,GarageCars,Fence,extra\n100.5,1,nan,2.0,None,a\nbad,2,7,NA,GdPrv,N/A\n")
    rows = files.read_house_csv(spark, str(tmp_path / "h.csv")).orderBy("Id").collect()
    assert [tuple(r) for r in rows] == [(100.5, 1, None, 2, None, "a"), (None, 2, 7.0, None, "GdPrv", None)]


def test_source_order(spark, tmp_path, houses):
    real, cache = str(tmp_path / "real"), str(tmp_path / "cache")
    files.write_table(houses.limit(5), real)
    assert files.resolve_source(spark, cache, [str(tmp_path / "no"), real]).count() == 5
    files.write_table(houses.limit(3), real)
    assert files.resolve_source(spark, cache, [real]).count() == 5
    assert files.resolve_source(spark, cache, [real], force=True).count() == 3
    with pytest.raises(RuntimeError):
        files.resolve_source(spark, str(tmp_path / "c2"), [str(tmp_path / "no")])


def test_broken_cells_end_nothing(spark, winner, request_row):
    rows = [{**request_row, "OverallQual": "abc"}, request_row, {**request_row, "LotArea": 3_000_000_000},
            {**request_row, "OverallQual": 7.9}, {**request_row, "GrLivArea": float("nan")}, {**request_row, "BsmtQual": None}]
    good, bad = scores(spark, winner, rows)
    assert sorted(good) == [1, 5]
    assert bad == {0: ["OverallQual: not a number"], 2: ["LotArea: out of range"], 3: ["OverallQual: not a whole number"],
                   4: ["GrLivArea: not a number"]}


def test_defaults_only_where_absent(spark, request_row):
    given = {**request_row, "BsmtQual": None}
    absent = {k: v for k, v in request_row.items() if k != "BsmtQual"}
    rows = scoring.validated(files.records(spark, [given, absent])).orderBy("row_index").collect()
    assert [r["BsmtQual"] for r in rows] == [None, "TA"]


def test_broken_lines_keep_their_text(spark, winner, houses):
    pipeline, best, rmse, _ = winner
    arriving, out, bad, check = (work_path(spark, n) for n in ("in", "out", "bad", "check"))
    rows = houses.drop("SalePrice").withColumn("HouseStyle", F.lit("1Story")).limit(20)
    lines = [*rows.toJSON().collect(), "{ not json", "[1", json.dumps({"Id": "x", "OverallQual": 5})]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(arriving)
    score_stream(read_request_stream(spark, arriving), pipeline, best, rmse, out, bad, check, once=True).awaitTermination()
    lost = spark.read.parquet(bad).where("corrupt IS NOT NULL").collect()
    assert sorted(r["corrupt"] for r in lost) == sorted(lines[-3:])
    assert all(r["errors"] == ["body: not readable"] and r["file"].endswith(".txt") for r in lost)
    assert spark.read.parquet(out).count() + spark.read.parquet(bad).count() == 23


def test_csv_quotes_tokens_and_column_order(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Id,Fence,Alley\n1,"a ""b"", c",x\n2,#N/A N/A,-1.#IND\n')
    rows = files.read_house_csv(spark, str(tmp_path / "q.csv")).orderBy("Id").collect()
    assert [tuple(r) for r in rows] == [(1, 'a "b", c', "x"), (2, None, None)]
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("Id,Fence\n1,x\n")
    (folder / "b.csv").write_text("Fence,Id\ny,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_house_csv(spark, str(folder)).collect()


def test_request_files_use_all_cores(spark, sf, tmp_path, monkeypatch):
    from lotwise.plans.catalog import scoring as queries

    monkeypatch.setattr(queries, "work_path", lambda _, name: str(tmp_path / name))
    scored = queries.score_as_stream(spark, sf)
    files = [f for f in (tmp_path / "requests").iterdir() if f.name.endswith(".json")]
    assert len(files) >= spark.sparkContext.defaultParallelism
    assert len([d for d in (tmp_path / "scored").iterdir() if d.name.startswith("batch=")]) == 2
    assert scored.count() > 0


def test_saved_winner_scores_joins_the_rows_once(spark, sf, monkeypatch):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    from lotwise.plans import training
    from lotwise.plans.catalog import storing

    board = spark.createDataFrame([("ridge", 1.0)], "name string, rmse double")
    pipeline = PipelineModel([SQLTransformer(statement="SELECT *, 12.0D AS prediction FROM __THIS__")])
    monkeypatch.setattr(storing, "run_training", lambda *a, **k: ("ridge", board))
    monkeypatch.setattr(training, "load_scorer", lambda *a: (pipeline, board))
    out = storing.saved_winner_scores(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert not [f for f in out.inputFiles() if f.endswith(("orders.parquet", "lineitem.parquet"))]
