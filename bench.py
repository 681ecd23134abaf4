"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from typetrace.plans import REGISTRY  # noqa: E402
from typetrace.session import build_session  # noqa: E402

HEADLINE = (
    "match_requests", "match_marks", "match_marks_coarse_only", "grid_search_unpruned", "grid_search",
    "request_reports", "accuracy", "otsu_thresholds_large", "ink_bounds", "column_segments",
    "wide_segments_split", "fragments_merged", "normalised_crops", "template_index", "signed_distance",
    "orientation_histograms", "character_coverage", "first_box_hit", "candidate_metadata",
    "verdicts_per_window",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.typetrace.spread": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "20g"})
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code paths and the Python workers before the clock runs.
    warm = REGISTRY["template_index"].build(spark, sf_dir)
    warm.write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
