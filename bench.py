"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and then ``BENCH_RUNS`` times to the ``noop`` sink;
the median counts. Session start is not included.
"""

import json
import os
import statistics
import sys
import time

from checks import CHECKS
from vitrine.session import build_session

HEADLINE = [
    "popularity_scores",
    "popularity_payload",
    "interactions_to_ratings",
    "row_counts",
    "catalog_to_product",
    "first_per_sku",
    "new_skus",
    "accept_limit",
    "coupon_to_deal",
    "unpublished_videos",
    "feed_page",
    "next_post",
    "video_captions",
    "match_post",
    "match_keywords",
    "match_keywords_documents",
    "answer_comments",
    "direct_story",
    "gallery",
    "first_image",
    "product_category_documents",
    "planned_scenes",
    "planned_scripts",
    "accept_until_mock",
    "scene_status",
    "resume_state",
    "seeded_ratings",
    "latest_changes",
    "upsert",
    "train_als",
    "recommend_all",
    "write_upsert",
    "scan_catalog_pages",
    "hashtags",
]


def seconds(run):
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", 8, {"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    timings, spread = {}, {}
    for name in names:
        query = CHECKS[name][0]

        def run(query=query):
            query(spark, folder).write.format("noop").mode("overwrite").save()

        run()
        taken = sorted(seconds(run) for _ in range(runs))
        timings[name] = round(statistics.median(taken), 3)
        spread[name] = [round(taken[0], 3), round(taken[-1], 3)]
    total = round(sum(timings.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "min_max": spread,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
