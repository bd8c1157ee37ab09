"""Headline plans on one machine: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
Each plan runs to a no-op sink, so every output row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a1_accepted_by_language", "p1_normalise", "p3_text_hash", "p5_stable_id", "p7_first_match", "p10_title", "p12_court_from_span",
    "p18_html_text", "p25_span_text", "c1_text_type", "s1_strict_scan", "s8_page_blocks", "f5_triage", "j1_known_keys", "j2_exact_copies",
    "j3_waterfall", "j4_declared_physical", "j8_asymmetric_collisions", "j10_star_counts", "j13_child_pages", "a5_symmetric_collisions",
    "a6_title_groups", "a10_batch_manifest", "w1_first_wins", "w2_spans", "w4_prior_members", "w6_greedy_dedup", "w8_batch_numbers",
    "w9_split_documents", "w10_first_seen", "u2_difference", "v4_page_range", "v6_orphans_and_edges", "t1_token_index",
    "t1_conjunctive_search", "k5_guarded_update", "k7_upsert", "r3_budget_admission", "r4_binary_dedup", "r9_run_status",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from quire.plans import PLANS, Tables
    from quire.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    chosen = sys.argv[1:] or HEADLINE
    PLANS["a1_counts_by_type"].build(tables).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in chosen:
        begin = time.perf_counter()
        PLANS[key].build(tables).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "archive_plans_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
