"""The mix moves texts twice: for its copies, and into its order."""

import re
from collections import Counter

from askbatch.llm import mixing


def _mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, lang string")


def test_mix_deals_copies_in_one_shuffle_of_the_texts(spark):
    df = _mixed(spark, [(i, f"s{i % 3}", f"a b c {i}", "en") for i in range(60)] + [(None, None, "x y", None)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mix_documents(df)._jdf.queryExecution().executedPlan().treeString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above, exchanges = [], []
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:+-]*", line).group())
        above = [x for x in above if x[0] < depth]
        if "Exchange" in line:
            above.append((depth, line))
        if "Scan" in line and "text" in line:
            exchanges.append([x for _, x in above])
    assert [len(x) for x in exchanges] == [2], plan


def test_mix_deals_copies_of_rows_that_share_a_key(spark):
    same = [(1, "s", "b b", "x"), (1, "s", "a a", "y"), (1, "s", "c c", None), (None, "s", "d d", "z"), (None, "s", "e e", "z"),
            (None, None, "f f", "n"), (2, None, "", "n"), (3, None, None, "n")]
    df = _mixed(spark, same + [(i, "t", "u v w", "en") for i in range(10, 30)])
    copies = Counter()
    for r in mixing.weighted_fair_schedule(df).collect():
        copies[r["doc_id"], r["source"], r["size"]] += r["copies"]
    mixed = mixing.mix_documents(df).collect()
    got = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in mixed)
    assert got == +copies
    # shared copies are dealt out in turn, texts ascending
    for key in {k for k in copies if copies[k]}:
        rows = sorted(r[2] for r in df.collect() if (r[0], r[1], len((r[2] or "").split())) == key)
        dealt = Counter(r["text"] for r in mixed if (r["doc_id"], r["source"], len((r["text"] or "").split())) == key)
        turns = Counter(rows[n % len(rows)] for n in range(copies[key]))
        assert dealt == turns
