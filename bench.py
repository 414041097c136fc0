"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sondage.plans.catalog import QUERIES  # noqa: E402
from sondage.session import local_session  # noqa: E402

HEADLINE = [
    "responses_upsert", "matched_panel", "wasserstein_shift", "js_shift", "shift_flags", "jaccard_shift",
    "redundancy_flags", "irt_posterior_step", "irt_discrimination", "audience_match_counts", "panel_build",
    "quota_feasibility", "persona_prompt", "variant_gate", "probe_plan", "skip_logic_flags", "inject_fanout",
    "calibration_f1", "question_severity", "spend_rollup", "spend_cap_breach", "rolling_failure", "report_card", "report_findings", "skip_cycles", "rule_contradictions", "quota_share", "stream_shift",
    "transition_audit", "best_run_per_survey",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
