"""Vantage-point search, conversation repair and Merkle manifest against brute
force, and on odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from askbatch.llm import common, conversation_repair, merkle_manifest, vantage_ann


@pytest.fixture(scope="module")
def llm_spark(spark):
    common.ship_package(spark)
    return spark


# --- op11 ---------------------------------------------------------------------

def brute_nearest(rows, k, every=20):
    good = [(i, np.array(v, np.float64)) for i, v in rows
            if i is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    out = Counter()
    for i, q in {(i, q.tobytes()): (i, q) for i, q in good if i % every == 0}.values():
        near = {(-float(np.cumsum(q * x)[-1]), j) for j, x in good if j != i and len(x) == len(q)}
        out.update((i, n, j, -s) for n, (s, j) in enumerate(sorted(near)[:k], 1))
    return out


def _answers(df, **kw):
    return Counter(map(tuple, vantage_ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, **kw).collect()))


def test_vantage_search_is_exact_at_factor_one(llm_spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(700)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.5]) for i in range(1000, 1090)]      # copies, more than k
    rows += [(i, (rng.normal(size=3) * i).tolist()) for i in range(1200, 1260)]     # another length, uneven norms
    rows += [(1300, None), (1320, []), (1340, [0.0] * 6), (1360, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6),
             (1380, [float("nan")] + [0.0] * 5), (1400, [float("inf")] + [0.0] * 5),
             (20, rows[20][1]), (40, [9.0, 0.0, 0.0, 0.0, 0.0, 1.0])]             # a repeated row, an id with two vectors
    df = llm_spark.createDataFrame([(i, v, "x", "y") for i, v in rows],
                                   "vec_id long, embedding array<double>, shard string, score string")
    want = brute_nearest(rows, 20)
    assert _answers(df, factor=1.0) == want
    assert _answers(df, factor=1.0, shard=60) == want       # many shards and trees
    assert _answers(df.filter("vec_id = 0"), factor=1.0) == Counter()
    assert _answers(df.filter("vec_id <= 4"), factor=1.0) == brute_nearest(rows[:5], 20)
    assert _answers(df.filter("false")) == Counter()


def test_vantage_factor_prunes_and_keeps_recall(llm_spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 3
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    tree = vantage_ann.VantageTree(x, float((x * x).sum(axis=1).max()))
    q, floor = x[:200], np.full(200, -np.inf)
    looked, recall = [], []
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    for factor in (1.0, 1.5, 3.0):
        seen = [0]
        visit = tree._visit
        tree._visit = lambda node, who, visit=visit, seen=seen: (
            seen.__setitem__(0, seen[0] + len(who) * len(node) * isinstance(node, np.ndarray)), visit(node, who))
        _, at = tree.search(q, 20, floor, factor)
        del tree._visit
        looked.append(seen[0])
        recall.append(np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best.tolist(), at[:, :20].tolist(), strict=True)]))
    assert recall[0] == 1.0 and recall[1] >= 0.9
    assert looked[0] > looked[1] > looked[2]
    df = llm_spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute_nearest([(i, v.tolist()) for i, v in enumerate(x)], 20)
    got = _answers(df, shard=500)
    assert sum((got & want).values()) >= 0.9 * sum(want.values()) and sum(got.values()) == sum(want.values())


# --- op12 ---------------------------------------------------------------------

def spaced(v):
    return " " if v is None else str(v)


def brute_damage(table):
    by = {}
    for c, t, r, x in table:
        rows = by.setdefault(c, [])
        case = zlib.crc32(f"{spaced(c)}:{spaced(t)}".encode()) % 20
        r, x = spaced(r), spaced(x)
        if case:
            x = "" if case == 1 else re.sub("[.!?]", "", x) if case == 2 else x
            rows += [(t, "user" if case == 4 else r, x)] * (2 if case == 3 else 1)
    return by


def brute_repair(rows):
    """All edit strings that matter, kept whole: a state's cheapest, least one."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults, illegal = set(), [], 0
    for (_, r, x), after in itertools.zip_longest(rows, rows[1:]):
        body = x.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
        illegal += after is not None and r[:1] + after[1][:1] not in ("su", "ua", "au")
    following = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def put(states, q, cost, audit, lines):
        if q not in states or (cost, audit) < states[q][:2]:
            states[q] = (cost, audit, lines)

    def with_inserts(states):
        states = dict(states)
        for _ in range(4):
            for p, (c, a, lines) in list(states.items()):
                put(states, following[p][0], c + 3, a + "I", [*lines, f"{following[p][1]}:"])
        return states

    states = {0: (0, "", [])}
    for (_, r, x), fault in zip(rows, faults, strict=True):
        now = {}
        for p, (c, a, lines) in with_inserts(states).items():
            put(now, p, c + 4, a + "D", lines)
            if fault in ("", "truncated"):
                late = 3 if fault else 0
                q, role = following[p]
                put(now, q, c + 3 + late, a + "R", [*lines, f"{role}:{x}"])
                if (r[:1], p) in kept:
                    put(now, kept[(r[:1], p)], c + late, a + "K", [*lines, f"{r}:{x}"])
        states = now
    cost, audit, lines = min((v for q, v in with_inserts(states).items() if q in (0, 3)), key=lambda v: v[:2])
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _conversations():
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "student"]
    texts = ["a.", "b!", "c", "  ", "", "d?", None, "e. ", "no end", "x.\n", " ", "é."]
    rows = [(c if c % 17 else None, rng.choice([t, t, t, None, t + rng.randint(0, 3)]), rng.choice(roles), rng.choice(texts))
            for c in range(60) for t in range(rng.randint(0, 14))]
    rows += [(7, 3, "user", "same.")] * 5 + [(8, 1, "user", "w" * 100000)] + [(500, t, "user", "x.") for t in range(40)]
    return rows + [(99, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{i}.", f"t{i}", "same."]))
                   for i in range(200)]


SCHEMA = "conv_id long, turn long, role string, text string, conv string, at string, piece string, codes string, p string"


@pytest.mark.parametrize("piece_bits,fan_bits", [(12, 10), (1, 1), (3, 2)])
def test_conversation_repair(llm_spark, monkeypatch, piece_bits, fan_bits):
    monkeypatch.setattr(conversation_repair, "PIECE_BITS", piece_bits)
    monkeypatch.setattr(conversation_repair, "FAN_BITS", fan_bits)
    rows = _conversations()
    df = llm_spark.createDataFrame([(*r, *["z"] * 5) for r in rows], SCHEMA)
    want = Counter((c, *brute_repair(v)) for c, v in brute_damage(rows).items())
    assert Counter(map(tuple, conversation_repair.repair_audit(df).collect())) == want


def test_conversation_repair_rows_and_empty(llm_spark):
    df = llm_spark.createDataFrame([(*r, *["z"] * 5) for r in _conversations()], SCHEMA)
    repair = conversation_repair.Repair(conversation_repair.damaged(df))
    audits = {r.conv: r for r in repair.audits().collect()}
    by = {}
    for r in sorted(repair.rows().collect(), key=lambda r: r.place):
        by.setdefault(r.conv, []).append(r)
    for conv, rows in by.items():
        assert "".join(r.edit for r in rows) == audits[conv].audit
        lines = [f"{r.role}:{r.text}" for r in rows if r.edit != "D"]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == audits[conv].repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    assert conversation_repair.repair_audit(df.filter("false")).count() == 0


def test_crossing_is_the_least_of_all_cheapest():
    """Against every edit string of short conversations."""
    letters = {q: n for q, n in conversation_repair.ENDING.items()}
    for codes in itertools.product("suaxUD", repeat=4):
        paths = {0: {(0, "")}}
        for c in codes:
            now = {}
            for p, found in paths.items():
                for q, cost, audit in conversation_repair.ROWS[c][p]:
                    now.setdefault(q, set()).update((a + cost, b + audit) for a, b in found)
            paths = now
        want = min((a + 3 * letters[q], b + "I" * letters[q]) for q, found in paths.items() for a, b in found)
        items = [conversation_repair.ROWS[c] for c in codes]
        end = conversation_repair.last_state(items)
        got = "".join(conversation_repair._solved("".join(codes), 0, None)) + "I" * letters[end]
        assert got == want[1]


# --- op13 ---------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(digests):
    paths, level = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
    while len(level) > 1:
        above = []
        for a in range(0, len(level), 16):
            run = level[a:a + 16]
            for j, (_, own) in enumerate(run):
                for i in own:
                    paths[i].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1:])))
            above.append((sha(*[d for d, _ in run]), [i for _, own in run for i in own]))
        level = above
    return level[0][0], paths


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([leaf_of(*r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))])
             for s in names}
    root, above = brute_tree([trees[s][0] for s in names])
    out = Counter()
    for s, up in zip(names, above, strict=True):
        for r, path in zip(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))), trees[s][1], strict=True):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            d = leaf_of(*r[:4], text)
            for left, right in path + up:
                d = sha(left, d, right)
            out[(r[0], leaf_of(*r), trees[s][0], root, sha(*[a + b for a, b in path + up]), d, d == root)] += 1
    return out


def _manifest(spark, rows):
    df = spark.createDataFrame([(*r, *["z"] * 4) for r in rows],
                               "doc_id long, source string, lang string, n_chars long, text string, "
                               "place string, leaf string, tree string, path string")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return Counter(map(tuple, merkle_manifest.manifest(df, changed).collect()))


def test_manifest(llm_spark, monkeypatch):
    rng = random.Random(9)
    ids = [*range(400), *(rng.randrange(-2**62, 2**62) for _ in range(60)), 2**63 - 1, -2**63, 32767, 32768, -1]
    rows = [(i, rng.choice(["s1", "s1", "s1", "é", None]), rng.choice(["en", None]), rng.choice([3, None]),
             rng.choice(["Some Text", "", None, "x" * 50000])) for i in ids]
    rows += [(5, "s1", "en", 1, f"T{n}") for n in range(40)] + [(5, "s1", "en", 1, "same")] * 30      # one id, many rows
    rows += [(None, "s1", None, None, f"N{n % 7}") for n in range(30)] + [(None, None, None, None, None)] * 3
    rows += [(9, "lone", "en", 1, "Lone")] + [(n, f"tail{n}", "en", 1, "A") for n in range(20)]
    want = brute_manifest(rows)
    assert _manifest(llm_spark, rows) == want
    monkeypatch.setattr(merkle_manifest, "CROWD", 16)       # ranges dealt over salts
    assert _manifest(llm_spark, rows) == want
    for few in (rows[:1], rows[:17], [(9, "lone", None, None, None)]):
        assert _manifest(llm_spark, few) == brute_manifest(few)
    assert _manifest(llm_spark, rows[:1]).total() == 1
    empty = llm_spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle_manifest.manifest(empty).count() == 0


def test_rank_bitmap():
    rng = np.random.default_rng(2)
    for size in (1, 50, 3000, 30000):
        offsets = np.sort(rng.choice(merkle_manifest.RANGE, size, replace=False))
        weights = np.where(rng.random(size) < 0.1, rng.integers(2, 9, size), 1)
        bitmap, repeated, extra, n = merkle_manifest._counted(offsets, weights)
        assert n == weights.sum() and (merkle_manifest.unpack(bitmap) == offsets).all()
        ranks = merkle_manifest.RankBitmap(bitmap, repeated, extra)
        assert (ranks.below(offsets) == np.cumsum(weights) - weights).all()
        assert (ranks.copies(offsets) == weights).all()
