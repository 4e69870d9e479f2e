"""Memo store (F6, F7, F13, F16), documents (F15), invariants."""

import json

from pyspark.sql import functions as F

from askbatch.operators import memo as M
from askbatch.operators.documents import assemble_document
from askbatch.session import scratch_path

MEMO = "question string, answer string, stored_at timestamp"


def _memo(spark, rows):
    return spark.createDataFrame(rows, "question string, answer string, ts long") \
        .select("question", "answer", F.timestamp_seconds("ts").alias("stored_at"))


def test_f6_f7_lookup_and_exists(spark):
    memo = _memo(spark, [("test_key", "test_value", 1)])
    qs = spark.createDataFrame([(1, "test_key"), (2, "other")], "question_id long, question string")
    hits, misses = M.memo_lookup(qs, memo)
    assert [(r.question, r.answer) for r in hits.collect()] == [("test_key", "test_value")]
    assert [r.question for r in misses.collect()] == ["other"]
    ex = {r.question: r.exists for r in M.memo_exists(qs, memo).collect()}
    assert ex == {"test_key": True, "other": False}


def test_f13_last_write_wins_empty_answer_and_delete(spark):
    memo = _memo(spark, [("k", "old", 1), ("k", "new", 2), ("e", "", 1)])
    qs = spark.createDataFrame([(1, "k"), (2, "e"), (3, " k")], "question_id long, question string")
    hits, misses = M.memo_lookup(qs, memo)
    assert [(r.question, r.answer) for r in hits.collect()] == [("k", "new")]
    # an empty answer is a miss but exists; keys are not trimmed
    assert sorted(r.question for r in misses.collect()) == [" k", "e"]
    ex = {r.question: r.exists for r in M.memo_exists(qs, memo).collect()}
    assert ex == {"k": True, "e": True, " k": False}
    keys = spark.createDataFrame([("k",), ("unknown",)], "question string")
    assert sorted(r.question for r in M.memo_delete(memo, keys).collect()) == ["e"]
    # keys repeat in a raw memo
    assert M.memo_size(memo).first().n_keys == 2
    assert M.memo_size(M.latest(memo), unique_store=True).first().n_keys == 2
    merged = M.memo_merge(memo, spark.createDataFrame([("z", "a")], "question string, answer string"))
    assert sorted(r.question for r in merged.collect()) == ["e", "k", "z"]
    # invariant: hits + misses = questions
    assert hits.count() + misses.count() == qs.count()


def _files(spark, root):
    """Name and size of every data file of a table, by partition."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    found, it = {}, p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    while it.hasNext():
        f = it.next().getPath()
        if f.getName().endswith(".parquet"):
            found.setdefault(f.getParent().getName(), set()).add(f.getName())
    return found


def test_store_replaces_the_partitions_of_its_keys(spark):
    root = scratch_path(spark, "memo-table")
    store = M.MemoTable(spark, root, partitions=8)
    assert store.read().count() == 0 and store.size() == 0 and store.flush() == (0, 0)
    ans = spark.createDataFrame([(f"q{i}", f"a{i}") for i in range(100)], "question string, answer string")
    assert store.store(ans, F.timestamp_seconds(F.lit(100))) == 8
    once = sorted((r.question, r.answer) for r in store.read().collect())
    store.store(ans, F.timestamp_seconds(F.lit(100)))
    assert sorted((r.question, r.answer) for r in store.read().collect()) == once and len(once) == 100
    before = _files(spark, root)
    new = spark.createDataFrame([("q1", "b1"), ("q1", "c1"), (None, "x")], "question string, answer string")
    assert store.store(new, F.timestamp_seconds(F.lit(200))) == 1
    after = _files(spark, root)
    assert sum(after[p] != before[p] for p in before) == 1 and set(after) == set(before)
    assert dict((r.question, r.answer) for r in store.read().collect()) == dict(once) | {"q1": "c1"}
    # an older write does not win; the number of partitions is the table's
    again = M.MemoTable(spark, root, partitions=3)
    assert again.partitions == 8
    again.store(spark.createDataFrame([("q1", "old")], "question string, answer string"), F.timestamp_seconds(F.lit(1)))
    assert {r.answer for r in again.read().filter("question = 'q1'").collect()} == {"c1"}


def test_lookup_reads_the_partitions_of_its_batch(spark):
    import contextlib
    import io
    store = M.MemoTable(spark, scratch_path(spark, "memo-table"), partitions=8)
    store.store(spark.createDataFrame([(f"q{i}", "" if i == 7 else f"a{i}") for i in range(50)],
                                      "question string, answer string"))
    qs = spark.createDataFrame([(1, "q3"), (2, "q7"), (3, "none"), (4, None)], "question_id long, question string")
    hits, misses = store.lookup(qs)
    assert [(r.question_id, r.answer) for r in hits.collect()] == [(1, "a3")]
    assert sorted(r.question_id for r in misses.collect()) == [2, 3, 4]
    assert {r.question: r.exists for r in store.exists(qs).collect()} == {"q3": True, "q7": True, "none": False, None: False}
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        store.lookup(qs.filter("question_id = 1"))[0].explain("formatted")
    assert any(line.startswith("PartitionFilters:") and "part#" in line for line in buf.getvalue().splitlines())


def test_delete_and_flush_leave_empty_partitions(spark):
    store = M.MemoTable(spark, scratch_path(spark, "memo-table"), partitions=4)
    store.store(spark.createDataFrame([(f"q{i}", f"a{i}") for i in range(20)], "question string, answer string"))
    store.delete(spark.createDataFrame([(f"q{i}",) for i in range(19)] + [("unknown",), (None,)], "question string"))
    assert [r.question for r in store.read().collect()] == ["q19"] and store.size() == 1
    assert store.flush() == (1, 0)
    store.store(spark.createDataFrame([("q1", "again")], "question string, answer string"))
    assert [(r.question, r.answer) for r in store.read().collect()] == [("q1", "again")]


def test_f16_keyed_entries(spark):
    people = spark.createDataFrame([(0, "Ann Lee", "1 Oak St", "555-1"), (7, "Bob", None, "555-2")],
                                   "id long, name string, address string, phone string")
    rows = M.keyed_entries(people, *[F.col(c) for c in people.columns]).orderBy("question").collect()
    assert [r.question for r in rows] == ["user:0", "user:7"]
    assert json.loads(rows[0].answer) == {"name": "Ann Lee", "email": "ann.lee@example.com", "address": "1 Oak St",
                                          "phone_number": "555-1"}
    assert M.keyed_entries(people.limit(0), *[F.col(c) for c in people.columns]).count() == 0


def test_f15_assemble_document_in_page_order(spark):
    pages = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, ""), (2, 0, "x")],
                                  "doc_id long, page_no long, text string")
    got = {r.doc_id: (r.text, r.n_pages) for r in assemble_document(pages).collect()}
    assert got == {1: ("ac", 3), 2: ("x", 1)}


def test_assemble_document_across_chunks(spark):
    rows = [(1, p, f"<{p}>") for p in range(25)] + [(1, 30, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no long, text string")
    r = assemble_document(pages, chunk_pages=4).first()
    assert r.text == "".join(f"<{p}>" for p in range(25)) and r.n_pages == 26
