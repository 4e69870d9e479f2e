"""The answer store (ops 3, 4, 9, 10, 11, 15, 19).

`memo(question, answer, stored_at)`: the raw question is the key (no trimming
or case folding), last write wins. The functions take any such frame, keys
repeated or not. `MemoTable` is the store on disk: a plain parquet table
partitioned by the hash of the question, where a write replaces the partitions
of its own keys (dynamic partition overwrite) and a lookup reads the partitions
of its batch only.

Lookups do not shuffle the store while the question batch fits the
broadcast limit: the batch is the small side, it is broadcast after a size
check and the store is streamed past it; only the matched rows, at most one
per question, move on. A larger batch falls back to a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MEMO
from ..session import checkpointed, fits_broadcast

DEFAULT_BROADCAST_ROWS = 2_000_000
MEMO_COLUMNS = MEMO.names


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def latest(memo: DataFrame) -> DataFrame:
    """One row per question: the newest `stored_at` wins, ties go to the
    larger answer. A grouped max_by, so a hot key is reduced map-side before
    the shuffle instead of landing whole in one task."""
    win = F.max_by(F.struct("answer", "stored_at"), F.struct("stored_at", "answer"))
    return (memo.groupBy("question").agg(win.alias("_w"))
            .select("question", "_w.answer", "_w.stored_at"))


def memo_merge(memo: DataFrame, answers: DataFrame, stored_at: Column | None = None,
               unique_store: bool = False, broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Union the new answers into the store, last write wins (op 3).

    Every key is resolved. With `unique_store` (a frame that is known to hold
    one row per key) only keys of the new batch can conflict: those old rows
    are pulled out with a semi join against the (size-checked, broadcast)
    batch keys and resolved with the batch; the rest of the store streams
    through an anti join, with no shuffle and no sort of the whole store.
    """
    new = answers.select("question", "answer",
                         (stored_at if stored_at is not None else
                          F.col("stored_at") if "stored_at" in answers.columns else
                          F.current_timestamp()).alias("stored_at"))
    old = memo.select("question", "answer", "stored_at")
    if not unique_store:
        return latest(old.unionByName(new))
    keys = _small(new.select("question").distinct(), broadcast_rows)
    untouched = old.join(keys, "question", "left_anti")
    touched = old.join(keys, "question", "left_semi")
    return untouched.unionByName(latest(touched.unionByName(new)))


def _matched(questions: DataFrame, memo: DataFrame, col: str, limit: int) -> DataFrame:
    keys = questions.select(F.col(col).alias("question")).distinct()
    return latest(memo.join(_small(keys, limit), "question", "left_semi"))


def memo_lookup(questions: DataFrame, memo: DataFrame, col: str = "question",
                broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(hits with `answer`, misses) of a question batch (op 9).

    An empty stored answer counts as a miss, as does a null question."""
    found = _matched(questions, memo, col, broadcast_rows).filter(F.col("answer") != "")
    found = found.select(F.col("question").alias(col), "answer")
    looked = questions.join(found, col, "left")
    hits = looked.filter(F.col("answer").isNotNull())
    misses = looked.filter(F.col("answer").isNull()).drop("answer")
    return hits, misses


def memo_exists(keys: DataFrame, memo: DataFrame, col: str = "question",
                broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Add `exists`: the key is stored, even with an empty answer (op 10)."""
    found = (_matched(keys, memo, col, broadcast_rows)
             .select(F.col("question").alias(col), F.lit(True).alias("exists")))
    return keys.join(found, col, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def memo_delete(memo: DataFrame, keys: DataFrame, col: str = "question",
                broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """The store without the given keys; unknown keys are ignored (op 11)."""
    drop = keys.select(F.col(col).alias("question")).distinct()
    return memo.join(_small(drop, broadcast_rows), "question", "left_anti")


def memo_size(memo: DataFrame, unique_store: bool = False) -> DataFrame:
    """One row: the number of stored keys (op 15). With `unique_store` a plain
    count suffices (partial per task, no shuffle of keys)."""
    n = F.count(F.lit(1)) if unique_store else F.count_distinct("question")
    return memo.select(n.cast("long").alias("n_keys"))


# Fixed value: key of a generated entry.
ENTRY_KEY_PREFIX = "user:"


def keyed_entries(people: DataFrame, key: Column, name: Column, address: Column, phone: Column) -> DataFrame:
    """One keyed JSON row per person (op 4): key `user:{key}`, value
    `{"name","email","address","phone_number"}`; the mail address is the name
    in lower case with dots for what is no letter or digit."""
    email = F.concat(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", ".")), F.lit("@example.com"))
    value = F.to_json(F.struct(name.alias("name"), email.alias("email"), address.alias("address"),
                               phone.alias("phone_number")))
    return people.select(F.concat(F.lit(ENTRY_KEY_PREFIX), key.cast("string")).alias("question"), value.alias("answer"))


DEFAULT_PARTITIONS = 256


class MemoTable:
    """The store at `root` (shared storage): one row per key, partitioned by
    `part`, the hash of the question modulo the number of partitions, which is
    fixed when the table is made.

    A write reads and replaces the partitions of its keys and no other. The
    rows to write are a table in the shared checkpoint folder first, so a
    writer that dies leaves either the old partitions or all it needs to write
    again. One writer at a time. A partition whose last key goes keeps a row
    without a question, since an overwrite cannot leave a partition empty.
    """

    def __init__(self, spark: SparkSession, root: str, partitions: int = DEFAULT_PARTITIONS):
        self.spark, self.root = spark, root.rstrip("/")
        if self._exists("/_layout/_SUCCESS"):
            self.partitions = int(spark.read.json(f"{self.root}/_layout").first()["partitions"])
        else:
            self.partitions = partitions
            spark.createDataFrame([(partitions,)], "partitions int").coalesce(1).write.mode("overwrite").json(f"{self.root}/_layout")

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root + name)
        return bool(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p))

    def is_new(self) -> bool:
        """Nothing was ever written to it."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/part=*")
        return len(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p) or []) == 0

    def _part(self, question: Column) -> Column:
        return F.pmod(F.xxhash64(question), F.lit(self.partitions)).cast("int")

    def _rows(self) -> DataFrame:
        # the schema is given, so a table without files reads as empty
        return self.spark.read.schema(T.StructType([*MEMO.fields, T.StructField("part", T.IntegerType())])).parquet(self.root)

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The stored rows, of all partitions or of the given ones."""
        rows = self._rows()
        if parts is not None:
            rows = rows.filter(F.col("part").isin(parts))
        return rows.filter(F.col("question").isNotNull()).select(*MEMO_COLUMNS)

    def parts_of(self, keys: DataFrame, col: str = "question") -> list[int]:
        """Partitions of the keys: at most `partitions` small numbers."""
        return sorted(r.part for r in keys.filter(F.col(col).isNotNull()).select(self._part(F.col(col)).alias("part")).distinct().collect())

    def _replace(self, rows: DataFrame, parts: list[int]) -> None:
        marks = self.spark.createDataFrame([(p,) for p in parts], "part int")
        kept = rows.select(*MEMO_COLUMNS, self._part(F.col("question")).alias("part"))
        empty = marks.join(kept.select("part").distinct(), "part", "left_anti").select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in MEMO.fields], "part")
        (kept.unionByName(empty).repartition("part").write.mode("overwrite").partitionBy("part")
         .option("partitionOverwriteMode", "dynamic").parquet(self.root))

    def store(self, answers: DataFrame, stored_at: Column | None = None) -> int:
        """Merge the answers (last write wins); returns the partitions written."""
        when = stored_at if stored_at is not None else (
            F.col("stored_at") if "stored_at" in answers.columns else F.current_timestamp())
        new = checkpointed(answers.filter(F.col("question").isNotNull())
                           .select("question", "answer", when.alias("stored_at")), "memo-new")
        parts = self.parts_of(new)
        if parts:
            self._replace(checkpointed(latest(self.read(parts).unionByName(new)), "memo-merged"), parts)
        return len(parts)

    def delete(self, keys: DataFrame, col: str = "question") -> int:
        """Remove keys, unknown ones ignored; returns the partitions written."""
        held = checkpointed(keys.select(F.col(col).alias("question")).distinct(), "memo-keys")
        parts = self.parts_of(held)
        if parts:
            self._replace(checkpointed(memo_delete(self.read(parts), held), "memo-kept"), parts)
        return len(parts)

    def flush(self) -> tuple[int, int]:
        """Empty the store; (keys before, keys after) (op 19)."""
        before = self.size()
        parts = sorted(r.part for r in self._rows().select("part").distinct().collect())
        if parts:
            self._replace(self.spark.createDataFrame([], MEMO), parts)
        return before, self.size()

    def size(self) -> int:
        return memo_size(self.read(), unique_store=True).first()["n_keys"]

    def lookup(self, questions: DataFrame, col: str = "question") -> tuple[DataFrame, DataFrame]:
        """(hits, misses) from the partitions of the batch."""
        return memo_lookup(questions, self.read(self.parts_of(questions, col)), col)

    def exists(self, keys: DataFrame, col: str = "question") -> DataFrame:
        return memo_exists(keys, self.read(self.parts_of(keys, col)), col)
