"""Time the headline queries on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larkspan.plans import QUERIES  # noqa: E402
from larkspan.session import build_session  # noqa: E402

HEADLINE = [
    "below_market_listings",
    "below_market_listings_narrowed",
    "c2_comparable_filter",
    "e1_group_statistics",
    "e2_inlier_median",
    "b14_strict_clean_name",
    "b20_checksums",
    "b33_card_extraction",
    "b34_token_chunks",
    "a3_json_lines",
    "e3_duplicate_groups",
    "f5_duplicate_keeper",
    "d4_missing_outputs",
    "d5_content_sync",
    "d6_exact_match",
    "d7_nearest_target",
    "f8_unique_names",
    "e6_ingest_funnel",
    "g2_upsert",
    "g3_insert_absent",
    "f3_last_messages",
    "f4_newest_first_merge",
    "h2_periodic_merge",
    "i1_text_search",
    "i2_vector_search",
    "i3_cited_sources",
    "d7_tolerance_match",
    "e2_narrowed_median",
    "a1_offer_feed",
    "b31_document_text",
    "h1_live_logs",
    "i1_text_search_indexed",
    "i2_vector_search_indexed",
    "g2_upsert_in_place",
    "d3_unknown_links_stored",
    "h4_backfill_then_live",
    "b8_leaf_columns",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # The first run of each query loads classes and generates code; the second is timed.
    seconds = {}
    for name in names:
        run(name)
        seconds[name] = run(name)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
