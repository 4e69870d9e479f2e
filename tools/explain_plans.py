"""Write the physical operator tree of every registered query to PLANS.md.

    python tools/explain_plans.py [/root/testdata/sf0.01]

Each query is run once (noop sink) first, so eager steps (index writes,
checkpoints) are done; only the operator tree is kept.
"""

from __future__ import annotations

import contextlib
import io
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from askbatch.plans.catalog import QUERIES  # noqa: E402
from askbatch.session import local_session  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    plan = buf.getvalue()
    lines = plan.split("\n\n")[0].splitlines()
    keep = [ln for ln in lines if ln.strip() and not ln.startswith("== ")]
    return "\n".join(re.sub(r" \(\d+\)$", "", ln) for ln in keep)


def main() -> None:
    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, shuffle_partitions=16)
    out = ["# Physical plans", "",
           f"Physical plans of the registered queries on `{root}` as planned before "
           "adaptive re-planning (`tools/explain_plans.py`); AQE may still turn a shuffle "
           "join into a broadcast one at run time. Explicit broadcasts come from size "
           "checks in the operators. Lineage cuts show as parquet scans of the checkpoint folder.", ""]
    for name, q in QUERIES.items():
        df = q(spark, root)
        df.write.format("noop").mode("overwrite").save()
        out += [f"## {name}", "", "```", tree(df), "```", ""]
    Path(__file__).resolve().parents[1].joinpath("PLANS.md").write_text("\n".join(out))


if __name__ == "__main__":
    main()
