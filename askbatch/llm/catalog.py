"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .common import ship_package
from .conversation_repair import repair_audit
from .embed_dedup import embedding_classes
from .exact_dedup import exact_dedup
from .jaccard import jaccard_components
from .langid import languages
from .merkle_manifest import manifest
from .mixing import weighted_fair_schedule
from .quality import quality
from .substring_dedup import repeated_passages
from .token_codes import token_digests
from .vantage_ann import nearest_neighbours
from .warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def _documents(spark, root):
    return _table(spark, root, "documents")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_substring_dedup(spark, root):
    return repeated_passages(_documents(spark, root))


def op2_token_codes(spark, root):
    return token_digests(_documents(spark, root), vocabulary(), end_id=0)


def op3_quality(spark, root):
    return quality(_documents(spark, root), _table(spark, root, "labels"))


def op4_exact_dedup(spark, root):
    return exact_dedup(_documents(spark, root), keep="largest")


def op5_embeddings(spark, root):
    return embedding_classes(_table(spark, root, "embeddings"), cosine=0.98)


def op6_jaccard(spark, root):
    return jaccard_components(_documents(spark, root), shingle=3, percent=90)


def op7_weighted_mix(spark, root):
    plan = weighted_fair_schedule(_documents(spark, root))
    return plan.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).alias("taken"))


def op8_bpe(spark, root):
    return bpe_round_trip(_documents(spark, root), vocabulary())


def op9_warc(spark, root):
    return archive_round_trip(_table(spark, root, "pages"), min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language(spark, root):
    return languages(_documents(spark, root))


def op11_vantage_ann(spark, root):
    return nearest_neighbours(_table(spark, root, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_conversation_repair(spark, root):
    return repair_audit(_table(spark, root, "conversations"))


def op13_merkle_manifest(spark, root):
    return manifest(_documents(spark, root), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_codes": op2_token_codes,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_embeddings": op5_embeddings,
    "op6_jaccard": op6_jaccard,
    "op7_weighted_mix": op7_weighted_mix,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
    "op11_vantage_ann": op11_vantage_ann,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# levels of the Merkle statement: 16^6 leaves a source, and as many sources
_LEVELS = 6


def _tree_sql(name: str, nodes: str) -> str:
    """Levels `name`0.. of the nodes (tree, pos, n, d), the roots `name`_r
    (tree, d) and the digests beside every node, `name`_s0.. ."""
    ctes = [f"{name}0 AS ({nodes})"]
    for k in range(_LEVELS):
        if k:
            ctes.append(f"""{name}{k} AS (SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, sha256(string_agg(d, '' ORDER BY pos)) AS d
                FROM {name}{k - 1} WHERE n > 1 GROUP BY tree, pos // 16, n)""")
        ctes.append(f"""{name}_s{k} AS (SELECT tree, pos,
                coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM {name}{k} WHERE n > 1 WINDOW w AS (PARTITION BY tree, pos // 16 ORDER BY pos))""")
    roots = " UNION ALL ".join(f"SELECT tree, d FROM {name}{k} WHERE n = 1" for k in range(_LEVELS))
    return ",\n        ".join([*ctes, f"{name}_r AS ({roots})"])


def _up_sql(name: str, source: str, tree: str, pos: str, folded: str, out: str, carried: str) -> str:
    """Fold `folded` up the tree and collect the digests beside the path."""
    joins = " ".join(f"LEFT JOIN {name}_s{k} s{k} ON s{k}.tree = {tree} AND s{k}.pos = {pos} // {16 ** k}"
                     for k in range(_LEVELS))
    inner = f"SELECT {source}.*, {', '.join(f's{k}.l AS l{k}, s{k}.r AS r{k}' for k in range(_LEVELS))} FROM {source} {joins}"
    fold = folded
    for k in range(_LEVELS):
        inner = f"SELECT *, CASE WHEN l{k} IS NULL THEN {fold} ELSE sha256(l{k} || {fold} || r{k}) END AS f{k} FROM ({inner})"
        fold = f"f{k}"
    beside = " || ".join(f"coalesce(l{k} || r{k}, '')" for k in range(_LEVELS))
    return f"{out} AS (SELECT {carried}, {fold} AS folded_{name}, {beside} AS beside_{name} FROM ({inner}))"


def _manifest_sql() -> str:
    def field(x: str) -> str:
        return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                      lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))))"""
    return f"""
        WITH leaves AS (
          SELECT doc_id, source, {leaf('text')} AS leaf,
                 CASE WHEN {crc} % 5 = 0 THEN {leaf(f'translate(text, {_AZ})')} END AS changed FROM documents),
        src AS (SELECT source, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree
                FROM leaves GROUP BY source),
        placed AS (SELECT l.*, s.tree, s.n, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
                   FROM leaves l JOIN src s ON l.source IS NOT DISTINCT FROM s.source),
        {_tree_sql('a', 'SELECT tree, pos, n, leaf AS d FROM placed')},
        {_tree_sql('b', 'SELECT 0 AS tree, tree AS pos, (SELECT count(*) FROM src) AS n, d FROM a_r')},
        placed2 AS (SELECT *, coalesce(changed, leaf) AS f FROM placed),
        {_up_sql('a', 'placed2', 'placed2.tree', 'placed2.pos', 'f', 'up1', 'doc_id, leaf, tree')},
        {_up_sql('b', 'up1', '0', 'up1.tree', 'folded_a', 'up2', 'doc_id, leaf, tree, beside_a')}
        SELECT doc_id, leaf, a_r.d AS subroot, b_r.d AS root, sha256(beside_a || beside_b) AS proof_sha256,
               folded_b AS folded_root, folded_b = b_r.d AS verified
        FROM up2 JOIN a_r ON a_r.tree = up2.tree CROSS JOIN b_r"""


SQL: dict[str, str] = {
    "op11_vantage_ann": """
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
          SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
                 row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC,
                                    c.vec_id) AS rank
          FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        WHERE rank <= 20""",
    "op13_merkle_manifest": _manifest_sql(),
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY norm)""",
    # base32: the 160 bits of the SHA-1 in groups of five
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS sha FROM p),
        b AS (SELECT *, array_to_string([
                substr('0000000100100011010001010110011110001001101010111100110111101111',
                       (strpos('0123456789abcdef', substr(sha, i, 1)) - 1) * 4 + 1, 4)
                for i in range(1, 41)], '') AS bits, min(page_id) OVER (PARTITION BY sha) AS first FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string([
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                        1 + list_sum([CAST(substr(bits, i * 5 + j, 1) AS BIGINT) * (1 << (5 - j)) for j in range(1, 6)])::BIGINT, 1)
                 for i in range(0, 32)], '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM b""",
    "op7_weighted_mix": r"""
        WITH d AS (
          SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS u,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
          FROM documents),
        s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS rank
          FROM d GROUP BY source),
        w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                     2.0::DOUBLE * source_size AS cap,
                     1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
        v AS (SELECT *, (budget - coalesce(sum(cap) OVER e, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) AS v
              FROM w WINDOW e AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT *, least(cap, weight * max(v) FILTER (WHERE v <= cap / weight) OVER ()) AS target FROM v),
        q AS (
          SELECT d.doc_id, d.size, t.rank, t.weight, t.source_size, t.target, t.budget,
                 sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.u, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT *, e * source_size + cum AS total, (e * source_size + cum)::DOUBLE / weight AS finish
              FROM q, (VALUES (0), (1)) AS epochs(e) WHERE size > 0),
        r AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, total ROWS UNBOUNDED PRECEDING) AS upto FROM c),
        k AS (SELECT doc_id, sum(size) AS taken FROM r WHERE upto <= budget GROUP BY doc_id)
        SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
        FROM q LEFT JOIN k ON q.doc_id = k.doc_id""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
