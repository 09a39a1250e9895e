"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from lotwise.operators import models
from lotwise.plans.catalog import QUERIES
from lotwise.plans.training import prepare
from lotwise.session import local_session
from lotwise.sources.listing import stored_listing

HEADLINE = """
dedupe_line_numbers hist_lines box_lines group_box_lines hash_split broken_cells batch_broken_bodies score_explained log_target group_mean_back
clean_medians clean_modes clean_dataset engineer_features cleaned_market_view corr_rank corr_matrix mi_binned
scale_standard regression_metrics leaderboard linear_contrib waterfall_running validate_requests score_batch
""".split()
FITS = ("linear_regression", "ridge", "lasso", "elasticnet", "decision_tree", "svr")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cpus, "bench", os.environ.get("BENCH_MEMORY", "16g"))
        spark.sparkContext.setLogLevel("ERROR")
        QUERIES["market_view"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        seconds: dict[str, float] = {}
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        start = time.perf_counter()
        data = prepare(stored_listing(spark, sf_dir))
        seconds["prepare_encoded"] = round(time.perf_counter() - start, 3)
        rows = data.train.count()
        for name in FITS:
            start = time.perf_counter()
            models.build_model(name).fit(data.train)
            seconds[f"fit_{name}"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
                "rows_per_fit": rows,
                "milliseconds_per_1000_rows": {n: round(1e6 * seconds[f"fit_{n}"] / rows, 3) for n in FITS},
            }
        )
    )


if __name__ == "__main__":
    main()
