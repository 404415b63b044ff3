"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from loomery.plans import registry
from loomery.session import local_session

HEADLINE = (
    "host_summary url_normalize url_category filter_comprehensive score_comprehensive record_profile price_by_group price_histogram entity_counts sentiment_share data_quality "
    "frequency_table anomaly_zscore trend_halves compare_datasets tool_performance tool_percentiles daily_tool_performance tool_transitions sliding_rate sustained_alerts moving_average "
    "page_structure page_links page_technology text_patterns vector_nearest text_similarity graph_breadth_first graph_in_links content_statistics "
    "rank_agreement rate_limit near_strings performance_report plan_issues page_cards first_successes competitive_results tool_keyword_matches paragraph_clusters "
    "page_elements page_path_items page_repeating_structures page_product_patterns text_tool_matches vector_lookup page_walks document_entities event_structure running_mean"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
