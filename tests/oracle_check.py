"""Run every registered query in Spark and its oracle in DuckDB; compare
column names, row counts and the multiset of rows.

    python tests/oracle_check.py [/root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import json
import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from askbatch.session import local_session  # noqa: E402
from askbatch.sources.tables import TABLES  # noqa: E402


EXACT = os.environ.get("ORACLE_EXACT_FLOATS") == "1"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def run(root: str, names: list[str]) -> dict:
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        p = Path(root) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = E.queries(), E.oracle_sql()
    report = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, root)
            cols = sorted(df.columns)
            rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
            t_spark = time.time() - t0
            if name not in sqls:
                report[name] = {"rows": len(rows), "oracle": None}
                print(name, "rows", len(rows), "(no oracle)", f"{t_spark:.1f}s", flush=True)
                continue
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            drows_raw = res.fetchall()
            idx = {c: i for i, c in enumerate(dcols)}
            ok_cols = sorted(dcols) == cols
            drows = [tuple(norm(r[idx[c]]) for c in cols) for r in drows_raw] if ok_cols else []
            same = ok_cols and Counter(rows) == Counter(drows)
            report[name] = {"rows": len(rows), "oracle_rows": len(drows_raw), "cols_match": ok_cols,
                            "match": same, "spark_sec": round(t_spark, 2)}
            print(name, "MATCH" if same else "DIFF", len(rows), len(drows_raw),
                  "" if ok_cols else f"cols spark={cols} oracle={sorted(dcols)}", f"{t_spark:.1f}s", flush=True)
            if ok_cols and not same:
                a, b = Counter(rows), Counter(drows)
                for r in list((a - b).elements())[:2]:
                    print("  spark only:", str(r)[:600])
                for r in list((b - a).elements())[:2]:
                    print("  oracle only:", str(r)[:600])
        except Exception as e:  # keep going, report the error
            report[name] = {"error": str(e)[:2000]}
            print(name, "ERROR", str(e)[:1500], flush=True)
    return report


if __name__ == "__main__":
    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    rep = run(root, sys.argv[2:])
    bad = [k for k, v in rep.items() if not v.get("match", v.get("oracle", 1) is None)]
    print(json.dumps({"total": len(rep), "bad": bad}))
