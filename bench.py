"""Times the headline queries and prints one line of JSON."""

import json
import os
import time

from codestrata.plans import catalogue
from codestrata.session import get_session

HEADLINE = (
    "ast_functions", "complexity_score", "bug_findings", "security_score", "dead_code_counts", "naming_violations", "docstring_issues",
    "debt_markers", "coupling", "impact_bfs", "connected_components", "hotspot_rank", "commit_scores", "dependency_findings", "environment_findings", "scan_text",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["scan_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
