"""Ranked retrieval (BM25) and passage selection over a corpus table.

An index is written once and read by every query batch:

* `docs`: per document its token count and (term, tf) runs, computed inside
  the row (sort the tokens, count runs), without a shuffle.
* `postings`: one row per document and term with the query-independent part of
  its score. The table is partitioned by language and by whether the term is
  frequent, and bucketed by block, a fixed share of the documents (by hash), so
  everything known of a document lies in one bucket.
* `tops`: per language, block and frequent term the largest part, bucketed alike.
* `terms`: the lexicon (document frequency, frequent or not, largest part).

A batch is answered by one plan at every size. The query terms are broadcast
(batches beyond the limit are answered in blocks of queries), the postings are
never shuffled: those that the batch asks for are put together block by block
inside the buckets, and a task scores them as matrices (`scoring`). No row per
query and document is formed; the only exchange carries k rows per query and
Arrow batch of a bucket.

With `prune`, late terms are met by fewer documents, for one more pass over the
postings. First the k documents best by rare terms are scored in full; the
least of these scores is a threshold that the k-th best of all cannot fall
below. The terms of a query whose largest parts together stay under half the
threshold are late: no document reaches it by them alone. The other terms are
scored for every document; what late terms can add is bounded by the maxima of
the document's block, and only documents that may still reach the threshold
meet the late terms. Nothing is capped, and the ranking equals the exhaustive
one.

A query with a market reads the partitions of its language only (dynamic
partition pruning) and is never paired with a document of another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import BROADCAST_BYTES, COMPRESSION, checkpointed, ensure_parallelism, fits_broadcast, scratch_path, ship_package
from . import scoring

# BM25 parameters (Robertson / Lucene defaults).
K1 = 1.2
B = 0.75

DEFAULT_BROADCAST_ROWS = 2_000_000
# a term is frequent when it occurs in more than this share of documents
HOT_DF_SHARE = 0.01
# documents of a block, on average
BLOCK_DOCS = 256
# forward index bytes of a bucket; the number of buckets has a floor, so the
# same layout runs at every size
BUCKET_BYTES = 16 << 20
MIN_BUCKETS, MAX_BUCKETS = 8, 100_000
# blocks of a bucket at least, so that buckets come out even
BUCKET_BLOCKS = 8
# partition of documents without a language (an empty one reads back as null)
NO_LANG = "_"
# late terms of a query stay together under this share of its threshold
LATE_SHARE = 0.5
# ranks compare scores rounded to this many digits
DIGITS = 6


def with_term_runs(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Add (doc_len, runs: array<struct<term, tf>>) computed in-row.

    Sorted tokens and run starts are materialised as columns before the
    lambdas read them: a lambda that referred to the expression itself would
    re-evaluate it per element.
    """
    sorted_toks = df.select(*keep, F.sort_array(tokens(F.col(text_col))).alias("_toks"))
    n = F.size("_toks")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    with_starts = sorted_toks.select(
        *keep, "_toks",
        F.filter(idx, lambda i: (i == 0) | (F.get(F.col("_toks"), i) != F.get(F.col("_toks"), i - 1)))
         .alias("_starts"))
    runs = F.transform(
        "_starts",
        lambda st, j: F.struct(
            F.get(F.col("_toks"), st).alias("term"),
            (F.coalesce(F.get(F.col("_starts"), j + 1), F.size("_toks")) - st).cast("long").alias("tf"),
        ),
    )
    return with_starts.select(*keep, F.size("_toks").cast("long").alias("doc_len"), runs.alias("runs"))


def _folder_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


POSTINGS = "term string, block long, doc_id {id_type}, part double, lang string, hot boolean"
TOPS = "term string, block long, top double, lang string"


@dataclass
class CorpusIndex:
    """An index over a corpus: `doc_terms` only until `materialize` wrote it."""

    doc_terms: DataFrame
    id_col: str = "doc_id"
    postings: DataFrame | None = None
    tops: DataFrame | None = None
    terms: DataFrame | None = None
    langs: tuple[str, ...] = (NO_LANG,)
    n_docs: int = 0
    path: str | None = None

    @property
    def has_lang(self) -> bool:
        return "lang" in self.doc_terms.columns

    def materialize(self, path: str | None = None, block_docs: int = BLOCK_DOCS,
                    buckets: int | None = None) -> "CorpusIndex":
        """Write the index (one tokenising pass) and read it back."""
        spark = self.doc_terms.sparkSession
        path = (path or scratch_path(spark, "index")).rstrip("/")
        self.doc_terms.write.mode("overwrite").parquet(f"{path}/docs", compression=COMPRESSION)
        docs = spark.read.parquet(f"{path}/docs")
        lang = F.coalesce(F.nullif("lang", F.lit("")), F.lit(NO_LANG)) if self.has_lang else F.lit(NO_LANG)
        # corpus statistics are fixed from here on: one aggregate
        per_lang = docs.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("len")).collect()
        n_docs, length = sum(r["n"] for r in per_lang), sum(r["len"] or 0 for r in per_lang)
        avg_len = length / n_docs if n_docs else 0.0
        if buckets is None:
            buckets = max(MIN_BUCKETS, min(MAX_BUCKETS, -(-_folder_bytes(spark, f"{path}/docs") // BUCKET_BYTES)))
        blocks = max(BUCKET_BLOCKS * buckets, -(-n_docs // block_docs))
        # explode_outer + explicit filter: a plain explode lets the optimizer
        # push `size(runs) > 0` below the projection that tokenises
        runs = docs.select(F.col(self.id_col).alias("doc_id"), "doc_len", lang.alias("lang"),
                           F.explode_outer("runs").alias("r")).filter(F.col("r").isNotNull())
        tf, doc_len = F.col("r.tf").cast("double"), F.col("doc_len").cast("double")
        norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * doc_len / F.lit(avg_len))
        part = tf * F.lit(K1 + 1.0) / (tf + norm)
        # frequent terms keep a partial count per task, so the lexicon costs
        # one row per term and task
        lexicon = runs.groupBy("r.term").agg(F.count(F.lit(1)).alias("df"), F.max(part).alias("most"))
        hot = F.col("df") > F.lit(HOT_DF_SHARE) * F.lit(n_docs)
        lexicon.withColumn("hot", hot).write.mode("overwrite").parquet(f"{path}/terms")
        terms = spark.read.parquet(f"{path}/terms")
        # at most (distinct terms of a document) / HOT_DF_SHARE terms are
        # frequent, whatever the corpus: a proven bound, so they are broadcast
        frequent = F.broadcast(terms.filter("hot").select(F.col("term").alias("_t"), F.lit(True).alias("hot")))
        # whole documents are exchanged by block, then taken apart: the files of
        # the buckets follow from it
        block = F.pmod(F.xxhash64(F.col(self.id_col)), F.lit(blocks))
        # the runs travel as one text of terms (a term holds no space) and an
        # array of counts, a fraction of the bytes of an array of structs
        dealt = (docs.filter(F.size("runs") > 0)
                 .select(F.col(self.id_col).alias("doc_id"), "doc_len", lang.alias("lang"), block.alias("block"),
                         F.array_join("runs.term", " ").alias("term"), F.col("runs.tf").cast("array<int>").alias("tf"))
                 .repartition(buckets, "block"))
        rows = (dealt.withColumn("term", F.split("term", " "))
                .select("lang", "block", "doc_id", "doc_len", F.explode(F.arrays_zip("term", "tf")).alias("r"))
                .select("lang", "block", F.col("r.term").alias("term"), "doc_id", part.alias("part"))
                .join(frequent, F.col("term") == F.col("_t"), "left")
                .select("term", "block", "doc_id", "part", "lang", F.coalesce("hot", F.lit(False)).alias("hot")))
        id_type = docs.schema[self.id_col].dataType.simpleString()
        _write_bucketed(rows, f"{path}/postings", buckets, ["lang", "hot"])
        postings = _bucketed(spark, f"{path}/postings", POSTINGS.format(id_type=id_type), buckets, "lang, hot")
        # read back by bucket: no exchange
        tops = postings.filter("hot").groupBy("lang", "block", "term").agg(F.max("part").alias("top"))
        _write_bucketed(tops.select("term", "block", "top", "lang"), f"{path}/tops", buckets, ["lang"])
        spark.createDataFrame([(self.id_col, n_docs, buckets, sorted(r["lang"] for r in per_lang))],
                              "id_col string, n_docs long, buckets int, langs array<string>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return CorpusIndex.load(spark, path)

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        """Written in full: the meta table is written last."""
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/meta/_SUCCESS")
        return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CorpusIndex":
        """An index written by `materialize`."""
        path = path.rstrip("/")
        meta = spark.read.parquet(f"{path}/meta").first()
        docs = spark.read.parquet(f"{path}/docs")
        postings = POSTINGS.format(id_type=docs.schema[meta["id_col"]].dataType.simpleString())
        return cls(docs, meta["id_col"], _bucketed(spark, f"{path}/postings", postings, meta["buckets"], "lang, hot"),
                   _bucketed(spark, f"{path}/tops", TOPS, meta["buckets"], "lang"), spark.read.parquet(f"{path}/terms"),
                   tuple(meta["langs"]) or (NO_LANG,), int(meta["n_docs"]), path)


def _table_name() -> str:
    return f"askbatch_postings_{uuid.uuid4().hex[:12]}"


def _write_bucketed(rows: DataFrame, path: str, buckets: int, partitions: list[str]) -> None:
    name = _table_name()
    (rows.write.mode("overwrite").format("parquet").option("compression", COMPRESSION).partitionBy(*partitions).bucketBy(buckets, "block")
     .option("path", path).saveAsTable(name))
    rows.sparkSession.sql(f"DROP TABLE {name}")         # external: the files stay


def _bucketed(spark: SparkSession, path: str, columns: str, buckets: int, partitions: str) -> DataFrame:
    """The rows of a folder with their partitions and buckets: an external
    table of the session's catalog that names the files in place."""
    name = _table_name()
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({partitions}) "
              f"CLUSTERED BY (block) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def market_lang(mkt: Column) -> Column:
    """`en-us` -> `en`; null stays null."""
    return F.lower(F.substring_index(mkt, "-", 1))


def build_index(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                mkt: str | None = None, lang_col: str = "lang") -> CorpusIndex:
    """Index a corpus table; `mkt` (`en-us`) keeps one language (`en`).

    When the corpus has `lang_col`, a language code per document, the postings
    are partitioned by it and queries can carry their own market."""
    if mkt:
        corpus = corpus.filter(F.col(lang_col) == market_lang(F.lit(mkt)))
    keep = [id_col] + (["lang"] if lang_col in corpus.columns else [])
    cols = [F.col(id_col)] + ([F.lower(F.col(lang_col)).alias("lang")] if len(keep) > 1 else [])
    corpus = ensure_parallelism(corpus.select(*cols, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)))
    return CorpusIndex(with_term_runs(corpus, text_col, keep), id_col)


def query_terms(queries: DataFrame, qid_col: str, text_col: str,
                mkt_col: str | None = None) -> DataFrame:
    """Distinct (qid, term[, q_lang]) rows; a term counts once per query."""
    extra = [market_lang(F.col(mkt_col)).alias("q_lang")] if mkt_col else []
    return (queries.select(F.col(qid_col).alias("qid"), *extra,
                           F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
            .dropDuplicates(["qid", "term"]))


def _weighted_terms(queries: DataFrame, index: CorpusIndex, qid_col: str, text_col: str,
                    mkt_col: str | None, broadcast_rows: int, by_lang: bool = True) -> DataFrame:
    """(qid, term, lang, idf, hot, most, key): a row per language that a query
    may read (without `by_lang` one row for all); `most` is the largest score
    that the term gives any document, `key` a number for term and language.
    Written as a table: it is measured once and broadcast several times."""
    if mkt_col and not index.has_lang:
        raise ValueError("per-query markets need an index built from a corpus with a language column")
    qt = query_terms(queries, qid_col, text_col, mkt_col)
    vocabulary = qt.select("term").distinct()
    if fits_broadcast(vocabulary, broadcast_rows):
        vocabulary = F.broadcast(vocabulary)
    df = F.col("df").cast("double")
    idf = F.log(F.lit(1.0) + (F.lit(float(index.n_docs)) - df + F.lit(0.5)) / (df + F.lit(0.5)))
    known = (index.terms.join(vocabulary, "term", "left_semi")
             .select("term", idf.alias("idf"), "hot", (idf * F.col("most")).alias("most"),
                     F.monotonically_increasing_id().alias("key")))
    # the numbers hold from here on
    known = checkpointed(known, "query-vocabulary")
    langs = index.langs if by_lang or mkt_col else (NO_LANG,)
    every = F.array(*[F.lit(x) for x in langs])
    lang = F.when(F.col("q_lang").isNull(), every).otherwise(F.array("q_lang")) if mkt_col else every
    nth = F.coalesce(F.array_position(every, F.col("lang")), F.lit(0))     # 0: a language without documents
    return checkpointed(qt.join(known, "term").select("qid", "term", F.explode(lang).alias("lang"), "idf", "hot", "most", "key")
                        .withColumn("key", F.col("key") * F.lit(len(langs) + 1) + nth), "query-terms")


def _vocabulary(terms: DataFrame, by_lang: bool) -> DataFrame:
    """(term, key) of a batch, with `by_lang` (lang, term, key); a table."""
    return checkpointed(terms.select(*(["lang"] if by_lang else []), "term", "key").distinct(), "query-keys")


def _held(postings: DataFrame, vocabulary: DataFrame, *more: str) -> DataFrame:
    """(block, held) with the postings of a block that a batch asks for: blocks
    are put together inside the buckets."""
    on = [c for c in ("lang", "term") if c in vocabulary.columns]
    asked = postings.join(F.broadcast(vocabulary.filter(F.col("term") != "")), on)
    return asked.groupBy(*more, "block").agg(F.collect_list(F.struct("doc_id", "key", "part")).alias("held"))


def _shipped(terms: DataFrame, *columns: str) -> Broadcast:
    """A block of query terms for the tasks; it fits a broadcast."""
    ship_package(terms.sparkSession)
    return terms.sparkSession.sparkContext.broadcast(
        scoring.Queries(terms.select("qid", "key", "idf", *columns).toArrow()))


def _found(rows: DataFrame, task: Callable, terms: DataFrame, postings: DataFrame, more: str = "") -> DataFrame:
    """What a task finds in its buckets: k rows per query and Arrow batch."""
    qid, doc_id = (df.schema[c].dataType.simpleString() for df, c in ((terms, "qid"), (postings, "doc_id")))
    return rows.mapInArrow(task, f"qid {qid}, doc_id {doc_id}, score double{more}")


def _query_blocks(weighted: DataFrame, rows: int) -> list[DataFrame]:
    """The query terms in blocks of whole queries that fit a broadcast."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in weighted.columns])))
    got = weighted.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    n = max(-(-got["n"] // max(1, rows)), -(-int(got["b"] or 0) // BROADCAST_BYTES), 1)
    if n == 1:
        return [weighted]
    of = F.pmod(F.xxhash64("qid"), F.lit(n))
    return [weighted.filter(of == i) for i in range(n)]


def _co_located(spark: SparkSession) -> None:
    """Let a join on (lang, block, term) use buckets of `block` alone: without
    this, Spark exchanges both sides although the buckets hold the keys."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def _sums(hits: DataFrame, *more: str) -> DataFrame:
    """Scores per query and document, within the buckets of `block`."""
    return hits.groupBy("qid", "block", "doc_id", *more).agg(F.sum(F.col("idf") * F.col("part")).alias("score"))


def _paired(postings: DataFrame, terms: DataFrame) -> DataFrame:
    # the comparison is always true; it marks the side as filtered, which is
    # what dynamic partition pruning asks for
    return postings.join(F.broadcast(terms.filter(F.col("term") != "")), ["lang", "term"])


def _threshold(postings: DataFrame, terms: DataFrame, k: int, vocabulary: DataFrame) -> DataFrame:
    """(qid, floor): the least full score of the k documents that are best by
    rare terms alone; the k-th best of all cannot be below it. Only for
    queries that have k such documents."""
    task = scoring.threshold_task(_shipped(terms, "hot"), k)
    rare = _found(_held(postings, vocabulary, "lang"), task, terms, postings, ", full double")
    best = top_k(rare, k).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("full").alias("floor"))
    return best.filter(F.col("n") == k).select("qid", "floor")


def _split_terms(postings: DataFrame, terms: DataFrame, k: int, vocabulary: DataFrame) -> DataFrame:
    """The terms with the query's `floor` and whether they are `late`, which
    only frequent terms are. Written as a table, so the threshold is computed
    once."""
    floor = _threshold(postings, terms, k, vocabulary)      # a row per query
    upto = Window.partitionBy("qid", "lang", "hot").orderBy("most", "term")
    late = F.col("hot") & F.coalesce(F.sum("most").over(upto) <= F.col("floor") * F.lit(LATE_SHARE), F.lit(False))
    return checkpointed(terms.join(F.broadcast(floor), "qid", "left").withColumn("late", late), "query-terms-split")


def _essential(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, lang, block, floor, doc_id, score) by the terms that are not late."""
    mine = terms.filter("NOT late").select("qid", "lang", "term", "idf", "floor")
    return (_paired(postings, mine).groupBy("qid", "lang", "block", "floor", "doc_id")
            .agg(F.sum(F.col("idf") * F.col("part")).alias("score")))


def _late_rows(postings: DataFrame, tops: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, lang, block, term, found): the scores of the documents that may
    reach the threshold, by each late term, and with a null term by all others."""
    late = terms.filter("late")
    bound = (_paired(tops, late.select("qid", "lang", "term", "idf"))
             .groupBy("qid", "lang", "block").agg(F.sum(F.col("idf") * F.col("top")).alias("bound")))
    slack = F.lit(4 * 10.0 ** -DIGITS)          # scores are ranked rounded
    may = (_essential(postings, terms).join(bound, ["qid", "lang", "block"], "left")
           .filter(F.col("floor").isNull() | (F.col("score") + F.coalesce("bound", F.lit(0.0)) >= F.col("floor") - slack)))
    # at most the documents of a block
    held = may.groupBy("qid", "lang", "block").agg(F.collect_list(F.struct("doc_id", F.col("score").alias("part"))).alias("held"))
    mine = F.broadcast(late.groupBy("qid", "lang").agg(F.collect_list(F.struct("term", "idf")).alias("late")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1.0).alias("idf")))
    asked = (held.join(mine, ["qid", "lang"], "left")
             .withColumn("t", F.explode(F.concat(none, F.coalesce("late", F.array().cast("array<struct<term:string,idf:double>>")))))
             .select("qid", "lang", "block", "held", "t.term", "t.idf"))
    lists = postings.filter("hot").select("lang", "block", "term", "doc_id", "part")
    found = asked.hint("shuffle_hash").join(lists, ["lang", "block", "term"], "left")
    mine = F.array_contains(F.transform("held", lambda h: h["doc_id"]), F.col("doc_id"))
    one = F.array(F.struct("doc_id", (F.col("part") * F.col("idf")).alias("part")))
    return found.select("qid", "lang", "block", "term",
                        F.when(F.col("term").isNull(), F.col("held")).when(mine, one).alias("found"))


def _best(postings: DataFrame, tops: DataFrame, terms: DataFrame, k: int, vocabulary: DataFrame) -> DataFrame:
    split = _split_terms(postings, terms, k, vocabulary)
    # the maxima of a block meet its postings in their bucket
    on = [c for c in ("lang", "term") if c in vocabulary.columns]
    maxima = (tops.join(F.broadcast(vocabulary.filter(F.col("term") != "")), on)
              .groupBy("lang", "block").agg(F.collect_list(F.struct("key", "top")).alias("tops")))
    rows = _held(postings, vocabulary, "lang").hint("shuffle_hash").join(maxima, ["lang", "block"], "left")
    task = scoring.pruned_task(_shipped(split, "late", "floor"), k)
    return top_k(_found(rows, task, terms, postings), k)


def score_pairs(queries: DataFrame, index: CorpusIndex, qid_col: str = "qid", text_col: str = "query",
                broadcast_rows: int = DEFAULT_BROADCAST_ROWS, mkt_col: str | None = None) -> DataFrame:
    """(qid, doc_id, score) of every query and document that share a term,
    without pruning. Corpus statistics are corpus-wide, also with a market."""
    index = index if index.postings is not None else index.materialize()
    weighted = _weighted_terms(queries, index, qid_col, text_col, mkt_col, broadcast_rows)
    out = None
    for terms in _query_blocks(weighted, broadcast_rows):
        scored = _sums(_paired(index.postings, terms)).select("qid", "doc_id", "score")
        out = scored if out is None else out.unionByName(scored)
    return out


def top_k(scored: DataFrame, k: int, group_col: str = "qid", score_col: str = "score",
          id_col: str = "doc_id", digits: int = DIGITS) -> DataFrame:
    """Keep the k best rows per group: score (rounded to `digits` so float
    summation order cannot reorder near-ties) desc, then id asc."""
    w = Window.partitionBy(group_col).orderBy(F.round(F.col(score_col), digits).desc(),
                                              F.col(id_col).asc())
    return (scored.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def retrieve_topk(queries: DataFrame, corpus: DataFrame | CorpusIndex, k: int = 5,
                  mkt: str | None = None, qid_col: str = "qid", text_col: str = "query",
                  doc_id_col: str = "doc_id", doc_text_col: str = "text",
                  broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                  mkt_col: str | None = None, prune: bool = False) -> DataFrame:
    """Top-k documents per query by BM25: (qid, rank, doc_id, score).

    `mkt` restricts the whole batch (an index of one language); `mkt_col`
    names a per-query market column instead. `prune` changes the plan, never
    the result."""
    index = corpus if isinstance(corpus, CorpusIndex) else \
        build_index(corpus, doc_id_col, doc_text_col, mkt=mkt)
    if index.postings is None:
        index = index.materialize()
    if prune:
        _co_located(index.doc_terms.sparkSession)
    weighted = _weighted_terms(queries, index, qid_col, text_col, mkt_col, broadcast_rows, by_lang=False)
    vocabulary = _vocabulary(weighted, bool(mkt_col))
    out = None
    for terms in _query_blocks(weighted, broadcast_rows):
        if prune:
            best = _best(index.postings, index.tops, terms, k, vocabulary)
        else:
            task = scoring.topk_task(_shipped(terms), k)
            best = top_k(_found(_held(index.postings, vocabulary), task, terms, index.postings), k)
        out = best if out is None else out.unionByName(best)
    return out.select(F.col("qid").alias(qid_col), F.col("rank").cast("long").alias("rank"),
                      "doc_id", F.round("score", 4).alias("score"))


def relaxed_search(queries: DataFrame, index: CorpusIndex, k: int = 5, rounds: int = 12, qid_col: str = "qid",
                   text_col: str = "query", mkt_col: str | None = None,
                   broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(qid, rank, doc_id, score, round): search for pages that hold every term
    of the query; while there is none, drop the term of lowest idf and search
    again, at most `rounds` times; then (round `rounds` + 2) any page with a
    term will do. Terms that no document holds are dropped beforehand.

    The rounds share one scan of the postings: a document keeps what each term
    gave it, in order of idf, and the leading terms that it holds without a gap
    say in which round it comes up and with which score."""
    index = index if index.postings is not None else index.materialize()
    weighted = _weighted_terms(queries, index, qid_col, text_col, mkt_col, broadcast_rows, by_lang=False)
    vocabulary = _vocabulary(weighted, bool(mkt_col))
    out = None
    for terms in _query_blocks(weighted, broadcast_rows):
        by_idf = Window.partitionBy("qid", "lang").orderBy(F.col("idf").desc(), "term")
        placed = terms.withColumn("nth", F.row_number().over(by_idf))
        task = scoring.relaxed_task(_shipped(placed, "nth", *(["lang"] if mkt_col else [])), k, rounds, whole=not mkt_col)
        scored = _found(_held(index.postings, vocabulary, "lang"), task, terms, index.postings, ", round long")
        first = Window.partitionBy("qid").orderBy("round", F.round("score", DIGITS).desc(), "doc_id")
        best = scored.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        best = best.withColumn("_first", F.min("round").over(Window.partitionBy("qid"))).filter("round = _first")
        out = best if out is None else out.unionByName(best)
    return out.select(F.col("qid").alias(qid_col), F.col("rank").cast("long").alias("rank"), "doc_id",
                      F.round("score", 4).alias("score"), "round")


def rows_per_hot_term(queries: DataFrame, index: CorpusIndex, k: int = 5, qid_col: str = "qid",
                      text_col: str = "query", mkt_col: str | None = None) -> DataFrame:
    """(term, df, pairs, pairs_read): for each frequent query term the (query,
    document) pairs that hold it, and how many of them a top-k search forms."""
    _co_located(index.doc_terms.sparkSession)
    weighted = _weighted_terms(queries, index, qid_col, text_col, mkt_col, DEFAULT_BROADCAST_ROWS)
    # a key per term and language, as the rows of `weighted`
    vocabulary = _vocabulary(weighted, by_lang=True)
    out = None
    for terms in _query_blocks(weighted, DEFAULT_BROADCAST_ROWS):
        sized = F.count(F.lit(1)).alias("n")
        split = _split_terms(index.postings, terms, k, vocabulary)
        hot = split.filter("hot").select("qid", "term", "lang", "late")
        every = _paired(index.postings.filter("hot"), hot).groupBy("term", "late").agg(sized)
        late = (_late_rows(index.postings, index.tops, split).filter("term IS NOT NULL AND found IS NOT NULL")
                .groupBy("term").agg(sized))
        part = (every.select("term", "n", F.lit("pairs").alias("kind"))
                .unionByName(every.filter("NOT late").select("term", "n", F.lit("read").alias("kind")))
                .unionByName(late.select("term", "n", F.lit("read").alias("kind"))))
        out = part if out is None else out.unionByName(part)
    total = out.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(name)
                                      for kind, name in (("pairs", "pairs"), ("read", "pairs_read"))])
    hot = index.terms.filter("hot").select("term", "df")
    return total.join(hot, "term").select("term", "df", "pairs", "pairs_read")


def extract_passages(pairs: DataFrame, queries: DataFrame, n: int = 1,
                     qid_col: str = "qid", query_col: str = "query",
                     doc_col: str = "doc_id", text_col: str = "text",
                     broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """The `n` lines of each (query, document) pair that share the most
    distinct terms with the query (ties: earlier line first).

    `pairs` holds (qid, doc_id, text), normally the retrieved pages only.
    Returns (qid, doc_id, line_no, overlap, passage); lines sharing no term
    are not passages.
    """
    qtok = queries.select(F.col(qid_col).alias("qid"),
                          F.array_distinct(tokens(F.col(query_col))).alias("q_terms"))
    if fits_broadcast(qtok, broadcast_rows):
        qtok = F.broadcast(qtok)
    lines = (pairs.select(F.col(qid_col).alias("qid"), F.col(doc_col).alias("doc_id"),
                          F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
             .join(qtok, "qid")
             .select("qid", "doc_id", "line_no", "line",
                     F.size(F.array_intersect(F.array_distinct(tokens(F.col("line"))), F.col("q_terms")))
                      .alias("overlap"))
             .filter(F.col("overlap") > 0))
    w = Window.partitionBy("qid", "doc_id").orderBy(F.col("overlap").desc(), F.col("line_no").asc())
    return (lines.withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") <= n)
            .select(F.col("qid").alias(qid_col), F.col("doc_id").alias(doc_col),
                    F.col("line_no").cast("long").alias("line_no"),
                    F.col("overlap").cast("long").alias("overlap"),
                    F.col("line").alias("passage")))
