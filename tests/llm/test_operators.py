"""The training-data operators against brute force, and on odd inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from askbatch.llm import (bpe, catalog, common, embed_dedup, exact_dedup, jaccard, langid, learning, mixing, quality,
                          substring_dedup, token_codes, warc)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string, h string, "
          "id string, rank string, kept string, _salt string, score string, component string")
ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def llm_spark(spark):
    common.ship_package(spark)
    return spark


@pytest.fixture(scope="module")
def odd(llm_spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated
    rows, clashing names."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    prose = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(12)]
    long = " ".join(rng.choices(vocabulary, k=30000))
    near = prose[0].split()
    near[60] = "CHANGED"
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = [None, None, "", "   \n\t ", "one", "ONE", "Émile", "émile", "12 345 !!", long, long, *prose, " ".join(near),
             prose[3].upper(), f"{prose[4]} {passage}", f"{passage} {prose[5]}", "x" * 50000, "<|endoftext|>  a \n b", "  a"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 3}", len(t or ""), *["z"] * 9)
            for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "one", None, None, None, *[None] * 9), (None, prose[1], "en", "s1", 1, *["z"] * 9)]
    return llm_spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def fold_az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(odd, empty):
    rows = [(r.doc_id, fold_az(r.text)) for r in odd.collect()]
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_dedup(odd, keep=keep).collect()
        assert len(got) == len(rows)
        by = {}
        for d, t in rows:
            by.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(d)
        for r in got:
            group = by[r.text_sha256]
            assert r.group_size == len(group)
            assert r.keep_id == best((d for d in group if d is not None), default=None)
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(by, 1))
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_meets_in_the_sort(llm_spark, odd):
    """Ordinary copies are one run of the sort; salted groups are merged."""
    rows = [(r.doc_id, fold_az(r.text)) for r in odd.collect()]
    sizes = Counter(t for _, t in rows)
    runs = exact_dedup.content_runs(odd).collect()
    assert all(r._parts is None for r in runs)
    assert sorted(r._run_n for r in runs if r._rn == 1) == sorted(sizes.values())
    hot = llm_spark.range(900).selectExpr("if(id % 9 = 0, null, id % 700) as doc_id",
                                          "if(id % 3 = 0, 'Copy', if(id % 3 = 1, 'cOpy', concat('t', id))) as text")
    plain = sorted(map(str, exact_dedup.exact_dedup(hot).collect()))
    for groups in (100, 0):
        cut = exact_dedup.content_runs(hot, large=50, broadcast_groups=groups).collect()
        assert len({r._salt for r in cut if r._parts is not None}) > 4 and any(r._parts is None for r in cut)
        assert sorted(map(str, exact_dedup.exact_dedup(hot, large=50, broadcast_groups=groups).collect())) == plain
    assert sum("kept=True" in r for r in plain) == 301


def test_mixing(odd, empty):
    got = mixing.weighted_fair_schedule(odd).collect()
    assert len(got) == odd.count()
    total = sum(r["size"] for r in got)
    taken = sum(r["size"] * r["copies"] for r in got)
    assert 0 < taken <= 1.5 * total
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * total)
    assert all(0 <= r["copies"] <= 2 for r in got)
    largest = max(r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 2 * largest
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.weighted_fair_schedule(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_bpe_and_token_files(odd, empty, tmp_path):
    from tokenizers import Tokenizer
    path = catalog.vocabulary()
    t = Tokenizer.from_file(path)
    rows = odd.collect()
    want = Counter()
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
              hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.bpe_round_trip(odd, path).collect())) == want
    assert bpe.bpe_round_trip(empty, path).count() == 0

    got = token_codes.token_digests(odd, path, str(tmp_path / "t"), shard_ids=500).collect()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, expected = 0, []
    for r in order:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == expected
    assert token_codes.token_digests(empty, path, str(tmp_path / "e")).count() == 0


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    ids = np.r_[rng.integers(0, 50257, 3000), [0, 255, 256, 65535, 65536, 2**32 - 1]].astype(np.uint32)
    shard = token_codes.TokenShard(b"".join(token_codes.shard_bytes([5, None], [1000, len(ids) - 1000], ids)))
    assert shard.doc_ids == [5, None]
    assert [shard.get(int(i)) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    for a, b in ((0, len(ids)), (513, 2049), (7, 7), (len(ids) - 3, len(ids))):
        assert (shard.read(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        token_codes.TokenShard(b"".join(token_codes.shard_bytes([5], [len(ids)], ids))[:-1])


def test_warc(llm_spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>", "z"), (2, None, "<p>é</p>", "z"), (3, "u", None, "z"), (4, "u", "", "z"),
            (5, "u", "x" * 300000, "z"), (5, "u", "x" * 300000, "z"), (None, "u", "<p>é</p>", None), (9, "u", "WARC/1.1\r\n\r\n", "z")]
    pages = llm_spark.createDataFrame(rows, "page_id long, url string, html string, _key string")
    got = warc.read_archives(warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=1000), with_payload=True).collect()
    assert len(got) == len(rows)
    seen = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert seen == Counter({(1, "response", None, 9): 1, (2, "revisit", 1, 9): 1, (None, "revisit", 1, 9): 1, (3, "response", None, 0): 1,
                            (4, "revisit", 3, 0): 1, (5, "response", None, 300000): 1, (5, "revisit", 5, 300000): 1,
                            (9, "response", None, 12): 1})
    for r in got:
        if r.payload is not None:
            assert warc.payload_digest(bytes(r.payload)) == r.payload_digest
    assert warc.archive_round_trip(pages.filter("false"), str(tmp_path / "e")).count() == 0
    with pytest.raises(ValueError):
        warc.parse_record(warc.record(1, 1, "u", b"abc", "response", None, "d")[:-5])


def test_warc_dictionary(llm_spark, tmp_path):
    pages = llm_spark.read.parquet(f"{ROOT}/pages.parquet")
    assert warc.train_dictionary(pages) is not None
    html = {r.page_id: r.html for r in pages.collect()}
    for r in warc.read_archives(warc.write_archives(pages, str(tmp_path / "w")), with_payload=True).collect():
        assert r.payload is None or bytes(r.payload).decode() == (html[r.page_id] or "")


def test_quality(llm_spark, odd, empty):
    docs, labels = (llm_spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    some = odd.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    scored = quality.quality(odd, some).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.quality(odd, some.filter("quality = 1")).filter("predicted = 0").count() == 0
    assert quality.quality(odd, some.filter("false")).count() == odd.count()
    assert quality.quality(empty, some).count() == 0


def test_factorisation_identity():
    m = quality.FactorisationMachine(dims=20, rank=3)
    m.w = np.arange(20, dtype=np.float32)
    idx, val = np.array([1, 5, 9]), np.array([0.5, 2.0, -1.0], np.float32)
    pairs = sum(float(m.v[a] @ m.v[b]) * x * y for i, (a, x) in enumerate(zip(idx, val, strict=True))
                for b, y in list(zip(idx, val, strict=True))[i + 1:])
    assert m.raw(idx, val, np.array([0]))[0][0] == pytest.approx(float(m.w[idx] @ val) + pairs, rel=1e-5)


def test_languages(llm_spark, odd, empty):
    docs = llm_spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in langid.languages(docs).collect() if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    got = langid.languages(odd).collect()
    letters = Counter((r.doc_id, any(map(str.isalpha, r.text or ""))) for r in odd.collect())
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == letters
    assert {r.lang_pred for r in langid.languages(odd.withColumn("lang", odd.lang.substr(9, 1)).filter("false")).collect()} == set()
    assert langid.languages(empty).count() == 0
    assert all(r.lang_pred == "und" for r in langid.identify_languages(odd, None).collect())


def brute_components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard(llm_spark, odd, empty, size, percent):
    rng = random.Random(size)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(80)] for _ in range(4)]
    texts = []
    for i in range(60):
        w = list(base[i % 4])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "n" * rng.randint(1, 9)
        texts.append(" ".join(w))
    df = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[j:j + size]) for j in range(len(w) - size + 1)} for w in (t.split() for t in texts)]
    linked = [(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = brute_components(60, linked)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, size, percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(60)}
    rows = jaccard.jaccard_components(odd, size, percent).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert all(r.component_id == r.doc_id for r in rows if not r.n_shingles)
    assert jaccard.jaccard_components(empty, size, percent).count() == 0


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    sets = [np.unique(np.r_[base[:rng.integers(120, 200)], rng.integers(0, 1 << 60, int(rng.integers(0, 40)), dtype=np.uint64)])
            for _ in range(90)]
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    bits = np.stack([np.frombuffer(jaccard.bitmap(s).tobytes(), np.uint64) for s in sets])
    sizes = np.array([len(s) for s in sets])
    found = set()
    for p, q in jaccard.SignatureTree(sizes, bits, np.arange(len(sets))).pairs(80):
        found |= set(zip(p.tolist(), q.tolist(), strict=True))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in found


@pytest.mark.parametrize("percent", [88, 90, 95])
def test_parts_lose_no_pair(percent):
    rng = np.random.default_rng(percent)
    parts, close = jaccard.Parts(percent), 0
    for n in [*range(1, 60), *rng.integers(60, 3000, 150).tolist()]:
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        gone, new = rng.integers(0, max(2, n * (100 - percent) // 100), 2)
        b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**64, new, np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
            close += 1
            assert len(np.intersect1d(parts(a), parts(b)))
    assert close > 20


@pytest.mark.parametrize("piece", [4, 2048])
def test_jaccard_large_blocks(llm_spark, monkeypatch, piece):
    # one block of many rows in several components: variants that share a
    # long part but are too far apart, each with near copies
    monkeypatch.setattr(jaccard, "PIECE", piece)
    rng = random.Random(piece)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for i in range(40):
        own = [f"v{i % 5}-{j}" for j in range(14)]
        if i >= 5:
            own[rng.randrange(14)] = f"x{rng.randrange(3)}"
        texts.append(" ".join(common + own))
    df = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, percent in ((3, 90), (5, 80), (5, 70)):
        sets = [{tuple(w[j:j + size]) for j in range(len(w) - size + 1)} for w in (t.split() for t in texts)]
        linked = [(a, b) for a in range(40) for b in range(a)
                  if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = brute_components(40, linked)
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, size, percent).collect()}
        assert got == dict(enumerate(want))


def test_embeddings(llm_spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 20] + rng.normal(scale=0.04, size=16))], i % 2) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 1), (302, None, 0), (303, [0.0] * 16, 0), (304, [1.0, None] * 8, 0),
             (305, [float("nan")] * 16, 0), (306, rows[0][1], None), (307, [], 1), (308, [1.0, 2.0], 1)]
    df = llm_spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, label int, w string")
    want = Counter()
    linked = []
    for i, (a, x, k) in enumerate(rows):
        for b, y, m in rows[:i]:
            if k is None or k != m or not x or not y or len(x) != len(y) or None in x or None in y:
                continue
            u, v = np.array(np.float32(x), float), np.array(np.float32(y), float)
            if np.isfinite(u).all() and np.isfinite(v).all() and u.any() and v.any() \
                    and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                want[a] += 1
                want[b] += 1
                linked.append((a, b))
    got = {r.vec_id: r for r in embed_dedup.embedding_classes(df).collect()}
    assert len(got) == len(rows) and linked
    assert all(got[i].n_links == want[i] for i in got)
    component = brute_components(309, linked)
    assert all(got[i].component_id == component[i] for i in got)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(302, 309))
    assert embed_dedup.embedding_classes(df.filter("false")).count() == 0
    assert embed_dedup.embedding_classes(df.filter("vec_id > 301")).count() == 7


@pytest.mark.parametrize("chunk", [64, 1024])
@pytest.mark.parametrize("spread", [0.02, 0.15, 1.0])
def test_embeddings_with_a_common_direction(llm_spark, monkeypatch, spread, chunk):
    """Every link is found from tight cones to no common direction at all, with
    wide vectors, visits and several chunks a block."""
    monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embed_dedup, "BUCKET", 8)
    rng = np.random.default_rng(5)
    x = np.eye(32)[0] + spread * rng.normal(size=(400, 32))
    x[200:] = x[:200] + 0.02 * np.linalg.norm(x[:200], axis=1, keepdims=True) * rng.normal(size=(200, 32))
    x = np.float32(x)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.98
    np.fill_diagonal(linked, False)
    df = llm_spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embed_dedup.embedding_classes(df).collect()}
    assert [got[i].n_links for i in range(400)] == linked.sum(axis=1).tolist()
    component = brute_components(400, [(int(a), int(b)) for a, b in zip(*np.nonzero(linked)) if a < b])
    assert [got[i].component_id for i in range(400)] == [component[i] for i in range(400)]


def test_embeddings_of_one_identifier_keep_their_links(llm_spark):
    near = [[1.0, 0.0, 0.0, 0.01 * k] for k in range(3)]
    rows = [(1, [0.0, 1.0, 0.0, 0.0]), (1, near[0]), (2, [0.0, 1.0, 0.0, 0.01]), (3, near[1]), (4, near[2])]
    df = llm_spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")
    got = embed_dedup.embedding_classes(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_substring_dedup(odd, empty):
    rows = odd.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).collect()
    holders = {}
    words = {r.doc_id: fold_az(r.text).split() for r in rows}
    for d, w in words.items():
        for j in range(len(w) - 49):
            holders.setdefault(tuple(w[j:j + 50]), set()).add(d)
    repeated = {d for s in holders.values() if len(s) > 1 for d in s}
    got = substring_dedup.repeated_passages(odd).collect()
    assert repeated and repeated <= {r.doc_id for r in got}
    for r in got:
        a = words[r.doc_id][r.start_word:r.end_word]
        b = words[r.other_doc_id][r.other_start_word:r.other_start_word + len(a)]
        assert len(a) >= 50 and sum(x == y for x, y in zip(a, b, strict=True)) >= 0.8 * len(a)
    assert substring_dedup.repeated_passages(empty).count() == 0


@pytest.mark.parametrize("least, edit", [(50, "add"), (50, "add two"), (60, "add"), (60, "drop")])
def test_passages_with_added_or_dropped_words(least, edit):
    rng = np.random.default_rng(least)
    words = rng.integers(0, 10**6, least).tolist()
    half = least // 2
    edited = {"add": [*words[:half], -1, *words[half:]], "add two": [*words[:half], -1, -2, *words[half:]],
              "drop": words[:half] + words[half + 1:]}[edit]
    a, b = ([hash(tuple(w[k:k + 5])) & 2**62 - 1 for k in range(len(w) - 4)] for w in (words, edited))
    both = len(set(a) & set(b))
    similar = both >= 0.8 * len(set(a) | set(b)) and min(len(a), len(b)) >= 46
    pad = [rng.integers(2**62, 2**63, 30).tolist() for _ in range(4)]
    x, y = np.array([*pad[0], *a, *pad[1]], np.uint64), np.array([*pad[2][:7], *b, *pad[3]], np.uint64)
    got = substring_dedup.verified_stretches(x, y, [23], 46, 80)
    assert bool(got) == similar
    for s, e, other_s, other_e in got:
        assert s <= 34 and e >= 30 + len(a) - 4 and other_s <= 11 and other_e >= 7 + len(b) - 4
    repeated = np.full(300, 5, np.uint64)
    assert substring_dedup.verified_stretches(repeated, repeated, [0], 46, 80) == [(0, 300, 0, 300)]


@pytest.mark.parametrize("piece", [2048, 16])
def test_passages_over_a_frequent_line(llm_spark, monkeypatch, piece):
    """Pairs share a passage around a line that many other documents hold."""
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    rng = random.Random(11)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, docs, pairs = word(36), [], {}
    docs += [[*word(80), *line, *word(80)] for _ in range(60)]
    for i in range(20):
        passage = [*word(11), *line, *word(11)]
        edited = list(passage)
        if i % 2:
            edited[5] = "changed"
        pairs[60 + 2 * i] = 61 + 2 * i
        docs += [[*word(70), *passage, *word(70)], [*word(65), *edited, *word(75)]]
    docs += [[*word(80), *line, *word(80)] for _ in range(60)]
    df = llm_spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    rows = substring_dedup.repeated_passages(df).collect()
    found = {(r.doc_id, r.other_doc_id) for r in rows}
    assert found == {p for a, b in pairs.items() for p in ((a, b), (b, a))}
    assert all(r.class_id == min(r.doc_id, r.other_doc_id) for r in rows)


def test_windows_of_edited_passages_meet():
    """Passages of the least length with one word of 50 changed."""
    rng = np.random.default_rng(21)
    tokens, missed = substring_dedup.ShingleSequence(5), 0
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    for _ in range(1000):
        passage = word(50)
        edited = [*passage[:25], "changed", *passage[26:]]
        sides = [tokens(" ".join([*word(60), *x, *word(60)]).encode()) for x in (passage, edited)]
        minima = []
        for x in sides:
            hs = [substring_dedup.function(x, k) for k in range(substring_dedup.HASHES)]
            minima.append({(k, int(h[c])) for k, h in enumerate(hs) for _, c, _ in substring_dedup.compact_windows(h, 46)})
        missed += len(minima[0] & minima[1]) < substring_dedup.ENOUGH
    print("missed", missed)
    assert missed <= 5


def test_compact_windows_are_the_tree_nodes():
    def nodes(h, lo, hi, least):
        if hi - lo < least:
            return []
        c = lo + int(h[lo:hi].argmin())
        return [(lo, c, hi - 1), *nodes(h, lo, c, least), *nodes(h, c + 1, hi, least)]
    rng = np.random.default_rng(8)
    for n in [*range(20), 64, 333, 900]:
        for top in (2, 9, 2**63):       # with and without ties
            h = rng.integers(0, top, n).astype(np.uint64)
            for least in (1, 2, 5, 16, 46):
                assert sorted(substring_dedup.compact_windows(h, least)) == sorted(nodes(h, 0, n, least))


def test_meeting_diagonals():
    keys = np.array(sorted([4 * 10, 4 * 12 + 1, 4 * 30, 4 * 38 + 1, -4 * 3 + 2, -4 * 2 + 2, -4 * 9 + 1]))
    assert substring_dedup.meeting_diagonals(keys, 2).tolist() == [-9, -3, -2, 10, 12]
    assert substring_dedup.meeting_diagonals(keys[:0], 2).tolist() == []


def test_compact_windows_cover_every_sequence():
    h = np.random.default_rng(5).permutation(60).astype(np.uint64)
    windows = list(substring_dedup.compact_windows(h, 10))
    for i in range(60):
        for j in range(i + 9, 60):
            c = i + int(h[i:j + 1].argmin())
            assert sum(lo <= i and w == c and j <= r for lo, w, r in windows) == 1


def test_sample_weights_stand_for_the_table(llm_spark):
    df = llm_spark.range(1000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as k")
    rows = learning.stratified_sample(df, "doc_id", "k", 50).collect()
    assert Counter(r.k for r in rows) == {0: 50, 1: 50}
    assert sum(r._weight for r in rows) == pytest.approx(1000)


def test_pipeline(llm_spark, odd):
    docs = llm_spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = {r.doc_id: r.quality for r in llm_spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, corpus_pipeline.checkpointed(stage(llm_spark, at, ROOT), "t")
        ids = {r.doc_id for r in at.select("doc_id").collect()}
        if name != "tokens":
            assert at.columns == docs.columns
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "quality":
            assert np.mean([d in ids for d, q in labels.items() if q == 1]) > 0.95
        if name == "exact dedup":
            texts = [fold_az(r.text) for r in at.collect()]
            assert len(set(texts)) == len(texts) == len({fold_az(r.text) for r in before.collect()})
    names = ("_key", "_sha", "_rn", "_doc", "_dsize", "_did", "_copies", "_quality_text", "_quality_score", "component_id")
    clash = docs.select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:  # a clashing name keeps its values
        if name != "tokens":
            got = stage(llm_spark, clash, ROOT)
            assert got.columns == clash.columns
            assert all(r[n] == n for r in got.select(*names).collect() for n in names)
    for _, stage in corpus_pipeline.STAGES:     # odd rows crash no stage
        assert stage(llm_spark, odd, ROOT).count() >= 0
        assert stage(llm_spark, odd.filter("false"), ROOT).count() == 0


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_files_are_read_in_many_tasks(llm_spark, tmp_path):
    docs = llm_spark.range(400).selectExpr("id as doc_id", "concat('word ', id) as text")
    shards = token_codes.write_token_shards(docs, catalog.vocabulary(), str(tmp_path / "t"), shard_ids=20)
    assert shards.count() > 20
    back = token_codes.read_token_shards(shards, read_ids=100)
    ran = back.select(F.spark_partition_id().alias("p"), "doc_id").collect()
    assert len({r.p for r in ran}) > 4 and len(ran) == 400
    pages = docs.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    archives = warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=500)
    ran = warc.read_archives(archives, read_bytes=2000).select(F.spark_partition_id().alias("p"), "page_id").collect()
    assert len({r.p for r in ran}) > 4 and len(ran) == 400
