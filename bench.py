"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every result is computed in full and sent to the no-op sink. Graph queries include building the
graph; model queries include reading and preparing the tables.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from riskspark.plans import catalog  # noqa: E402
from riskspark.session import build  # noqa: E402

HEADLINES = [
    "quote_features", "claim_features", "vehicle_override_join", "quote_snapshot_rows",
    "person_dedup", "address_dedup", "phone_dedup", "policy_claim_check",
    "graph_nodes", "graph_edges", "shared_attribute_count", "claim_attorney_centrality",
    "fraud_hop_distance", "graph_features", "claims_enriched",
    "quality_quotes", "quality_claims", "quality_spine", "quality_checks",
    "auc_gini", "ece", "risk_distribution", "reason_codes_given_weights", "psi",
    "latest_per_key", "burst_windows", "train_frequency", "train_severity", "stream_quote_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINES
    spark = build("riskspark-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in chosen:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf_dir.rstrip("/").rsplit("sf", 1)[-1]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
