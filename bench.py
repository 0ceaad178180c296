"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from demo import q_reports, q_scoring, q_tables, q_texts
from demo.registry import views
from demo.views import AS_OF
from tierline.operators import dedup, matching, notice_flow
from tierline.plans import lists, profiles
from tierline.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = local_session("bench", cores=CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    v = views(spark, SF_DIR)
    t = q_reports.tables
    headline = {
        "opportunity_scores": lambda: q_scoring.mart(v),  # computed and stored; the reports below read it
        "sectionise": lambda: q_texts.sections(v),
        "extract_findings": lambda: q_texts.found(v),
        "match_mentions": lambda: matching.match_mentions(v.documents, v.institutions, "doc_id", "text", per_article=3),
        "match_by_name": lambda: matching.match_by_name(v.external_names, v.institutions, "external_name"),
        "survivorship": lambda: dedup.survivorship(v.parties, dedup.id_map(v.parties)),
        "apply_snapshot": lambda: notice_flow.apply_snapshot(
            v.notices, notice_flow.register_notices(q_tables._register(v), v.institutions, AS_OF), AS_OF
        ),
        "evidence_coverage": lambda: profiles.evidence_coverage(t(v)),
        "landscape": lambda: profiles.landscape(t(v), "2001-01-01"),
        "cohort_critical": lambda: lists.cohort_ranking(t(v), "critical"),
        "opportunity_list": lambda: lists.opportunity_list(t(v)),
        "opportunity_export": lambda: lists.opportunity_export(t(v)),
    }
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()  # start the workers
    seconds = {}
    for name, build in headline.items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
