"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each query is
computed in full into a sink that discards rows, after one warm-up on the
smallest tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "coverage",
    "diagnostics_report",
    "entity_priority",
    "order_priority",
    "enrich_offers",
    "ambiguity_report",
    "ambiguous_names",
    "known_groups",
    "silver_positives",
    "hard_negatives",
    "random_negatives",
    "audit_sample",
    "candidate_blocking",
    "rank_candidates",
    "best_match",
    "dedup_entities",
    "provider_chain",
    "consortium_resolve",
    "resolve_offers",
    "name_norm",
    "parse_address",
    "split_consortium",
    "sim_levenshtein",
    "sim_jaro_winkler",
    "sim_token_set",
    "sim_cosine",
    "roc_auc",
    "average_precision",
    "write_register_partitioned",
    "flatten_establishment",
    "stream_register",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    from nomenlink.checks import QUERIES
    from nomenlink.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
        # Test tables are small in bytes but not in work; keep all cores busy.
        spark__sql__adaptive__coalescePartitions__minPartitionSize="64k",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in ("diagnostics_report", "best_match", "silver_positives"):
            run(name, small)
    seconds = {name: run(name, sf_dir) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
