"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from maskwright.plans.queries import QUERIES
from maskwright.session import local_session

HEADLINES = (
    "redact_documents",
    "redact_corpus",
    "resolve_spans",
    "mapping_audit",
    "redaction_counts",
    "run_summary",
    "block_redaction_count",
    "detect_distinct_blocks",
    "detect_known_joined",
    "residual_leaks",
    "redact_runs_multi",
    "evaluation_run",
    "stream_redact",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g")
    # class loading, JIT and the rule expressions, as in a session that has run before
    run(spark, "redact_documents", folder)
    seconds = {name: round(run(spark, name, folder), 3) for name in HEADLINES}
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
