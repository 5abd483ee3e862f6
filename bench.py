"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

HEADLINE = ("edge_merge", "statement_counts", "most_depended_on", "rollup_depth1", "dependency_ranking", "path_owner", "declared_membership", "loaded_dependencies", "transitive_closure", "component_cycles", "co_change_top", "code_by_component", "snapshot_merge", "page_links", "redact_tokens")


def main() -> None:
    from tessera.plans.catalogue import QUERIES
    from tessera.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(int(cpus) if cpus.isdigit() else cpus)
    QUERIES["most_depended_on"](spark, sf_dir).collect()  # the first query also pays for the session
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
