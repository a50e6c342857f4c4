"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). BENCH_ONLY names queries to run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from placeloom.plans import load  # noqa: E402
from placeloom.session import build_session  # noqa: E402

HEADLINE = [
    "distance_features", "radius_count", "nearest_distance", "article_category_features", "house_article_weights",
    "k_nearest_articles", "near_duplicates", "weighted_terms", "weighted_tf_idf", "weighted_vector_sum",
    "nearest_vector_sum", "similar_vectors", "term_counts", "vocabulary", "article_importance", "xml_articles",
    "article_records", "category_points", "html_links", "clean_houses", "describe", "box_stats", "histogram",
    "map_heat_2d", "error_measures", "cross_validation", "district_validation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_ONLY", "").split() or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    # the first query of a session also pays for its start
    queries["value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
