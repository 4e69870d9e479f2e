"""Bench: run the headline queries (all registered ones with BENCH_ALL=1)
on `local[$BENCH_CPUS]` over `$BENCH_SF_DIR` (default /root/testdata/sf0.1)
and print one JSON line.

Each query is forced in full with the `noop` sink (no driver collect);
the time is wall-clock per query in a JVM warmed up on a tiny input
(`$BENCH_WARMUP_DIR`, default sf0.001), and the output row count is
observed during the same run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from askbatch.plans.catalog import QUERIES  # noqa: E402
from askbatch.session import local_session  # noqa: E402

HEADLINE = [
    "prepare_answers",
    "retrieve_topk",
    "extract_passages",
    "html_to_markdown",
    "extract_links",
    "find_pdf_links",
    "distinct_links",
    "scan_search_responses",
    "fetch_join",
    "parse_responses",
    "collect_page_answers",
    "build_requests_final",
    "finish_answers",
    "memo_hits",
    "memo_store",
    "stage_counts",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or (list(QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE)
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    # warm-up of the JVM (class loading, JIT, code generation), not timed:
    # every query once on a different, tiny input. Indexes are keyed by
    # table, so nothing computed here is reused at the bench scale.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if Path(warm).is_dir() and Path(warm).resolve() != Path(root).resolve():
        for name in names:
            try:
                QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
            except Exception:
                pass
    else:
        QUERIES["html_to_markdown"](spark, root).write.format("noop").mode("overwrite").save()
    times, rows, errors = {}, {}, {}
    for name in names:
        t0 = time.time()
        try:
            # output rows are counted during the same run (no extra job)
            obs = Observation(name)
            df = QUERIES[name](spark, root).observe(obs, F.count(F.lit(1)).alias("rows"))
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
            rows[name] = obs.get["rows"]
        except Exception as e:  # record and go on: one failure must not hide the rest
            times[name] = None
            errors[name] = str(e)[:500]
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = Path(root).name.replace("sf", "")
    out = {"metric": "total_query_time",
           "value": round(sum(t for t in times.values() if t is not None), 3),
           "unit": "sec", "queries": times, "sf": sf, "rows": rows}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
