"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation must read `(s?(ua)+)?` in the initials of its roles. Its rows
are kept (cost 0), given another role (3), deleted (4; always for blank and
repeated rows), and empty rows are inserted anywhere (3); a truncated row that
stays adds 3. The legal prefixes are four states (nothing yet, after the system
row, after a user, after an assistant). To reconstruct the cheapest edits in
linear space, a forward pass over the first half of the rows gives the cost of
each state there, a backward pass over the second half the cost from each state
to the end; they meet in the middle, the crossing of least total is taken, and
both halves are solved in the same way. Among equal totals the crossing is the
one of the ASCII-least audit: edit strings that reach different states after the
same row differ before the end of either, so a forward pass that also carries
the order of its four strings, as four ranks, compares them without keeping any.

A conversation may hold a third of all rows, so the same split runs over tasks.
Rows are ordered by range partitions and cut into pieces of at most PIECE rows;
a piece becomes the costs and ranks from each state to each state; pieces of a
conversation are composed FAN at a time, states at their borders are chosen
from the top down in the same way, and every piece is then solved by itself.
Only the hash of a conversation's whole repaired text reads its rows one after
the other, in one task, as a stream.

Edge cases: null role, text, and, in the damage key only, null conversation or
turn read as one space; a null conversation is a conversation of its own; null
turns come first and do not count for gaps; rows of one turn are ordered by
role, then text; equal rows follow one another; a role other than system, user,
assistant counts by its first character; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import with_group_totals

PIECE_BITS = 12             # rows of a piece: 4,096 at most
FAN_BITS = 10               # pieces composed at a time: 1,024 at most
SALTS = 64

# Blanks of the text rules, costs of edits, damage cases.
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL_PAIRS = ("su", "ua", "au")
DAMAGE_CASES = 20           # of which 0 drop, 1 empty, 2 strip, 3 repeat, 4 user

# --- the four states ----------------------------------------------------------

FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> the state after one inserted or re-roled row, and that row's role
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: role initial kept in a state
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: rows to insert behind the last row to end legally
ENDING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


def _transitions(code: str) -> list[list[tuple[int, int, str]]]:
    """From each state the reachable states with least cost and its audit. A
    code is a role initial (`D`: must go), in upper case if truncated."""
    out = []
    for p in range(4):
        best: dict[int, tuple[int, str]] = {}
        now, seen, lead = p, set(), 0
        while now not in seen:
            seen.add(now)
            options = [(now, DELETE, "D")]
            if code != "D":
                late = TRUNCATED if code.isupper() else 0
                options.append((NEXT[now][0], REROLE + late, "R"))
                if (kept := KEPT.get((code.lower(), now))) is not None:
                    options.append((kept, KEEP + late, "K"))
            for q, cost, letter in options:
                found = (lead * INSERT + cost, "I" * lead + letter)
                best[q] = min(best.get(q, found), found)
            now, lead = NEXT[now][0], lead + 1
        out.append([(q, c, letters) for q, (c, letters) in best.items()])
    return out


#: `x` stands for every other initial
ROWS = {c: _transitions(c) for c in ("s", "u", "a", "x", "S", "U", "A", "X", "D")}


def forward(items: list, p: int) -> tuple[list[int], list[int]]:
    """(costs, ranks) of the states after the items, from state p."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[p] = 0
    for item in items:
        best: list = [None] * 4
        for s in range(4):
            if cost[s] < FAR:
                for q, c, key in item[s]:
                    found = (cost[s] + c, rank[s], key)
                    if best[q] is None or found < best[q]:
                        best[q] = found
        cost = [FAR if b is None else b[0] for b in best]
        for i, q in enumerate(sorted((q for q in range(4) if best[q] is not None), key=lambda q: best[q][1:])):
            rank[q] = i
    return cost, rank


def backward(items: list, q: int) -> list[int]:
    """Cost from each state over the items to state q."""
    cost = [FAR] * 4
    cost[q] = 0
    for item in reversed(items):
        cost = [min((c + cost[t] for t, c, _ in item[s] if cost[t] < FAR), default=FAR) for s in range(4)]
    return cost


def crossings(items: list, p: int, q: int) -> list[tuple[int, int]]:
    """(state before, state after) of every item on the audit-least cheapest
    way from state p to state q."""
    if len(items) == 1:
        return [(p, q)]
    half = len(items) // 2
    cost, rank = forward(items[:half], p)
    rest = backward(items[half:], q)
    s = min((s for s in range(4) if cost[s] < FAR and rest[s] < FAR), key=lambda s: (cost[s] + rest[s], rank[s]))
    return crossings(items[:half], p, s) + crossings(items[half:], s, q)


def last_state(items: list, p: int = START) -> int:
    cost, rank = forward(items, p)
    return min((q for q in range(4) if cost[q] < FAR), key=lambda q: (cost[q] + ENDING[q] * INSERT, rank[q]))


def composed(items: list) -> bytes:
    """Costs and ranks from each state to each state, as an item's bytes."""
    return np.array([forward(items, p) for p in range(4)], "<i8").tobytes()


def item_of(data: bytes) -> list:
    table = np.frombuffer(data, "<i8").reshape(4, 2, 4).tolist()
    return [[(q, table[p][0][q], table[p][1][q]) for q in range(4) if table[p][0][q] < FAR] for p in range(4)]


def _solved(codes: str, p: int, q: int | None) -> list[str]:
    """Audit letters of each row of a piece."""
    items = [ROWS[c] for c in codes]
    if q is None:
        q = last_state(items, p)
    return [next(letters for t, _, letters in ROWS[c][a] if t == b)
            for c, (a, b) in zip(codes, crossings(items, p, q), strict=True)]


@lru_cache(maxsize=1 << 14)
def _solved_short(codes: str, p: int, q: int | None) -> list[str]:
    """Short pieces repeat a lot."""
    return _solved(codes, p, q)


# --- rows ---------------------------------------------------------------------

def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """conv, turn, role, text after the damage that the repair is tried on."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    case = F.crc32(F.encode(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)), "UTF-8")) % DAMAGE_CASES
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                                spaced(role_col).alias("role"), spaced(text_col).alias("text"), case.alias("case"))
    return rows.filter("case <> 0").select(
        "conv", "turn", F.when(F.col("case") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    ).drop("_copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, in order: `at` grows along a
    conversation, and at most 2^PIECE_BITS rows share a piece."""
    order = ["conv", "turn", "role", "text"]
    once = rows.groupBy(*order).agg(F.count(F.lit(1)).alias("copies"))
    # a start of the text decides only which partition, never the order
    placed = once.repartitionByRange("conv", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions(*order)
    placed = placed.withColumn("at", F.monotonically_increasing_id())
    return checkpointed(placed.withColumn("piece", F.shiftright("at", PIECE_BITS)), "repair-rows")


def _judged(ordered: DataFrame) -> DataFrame:
    """conv, piece, at, turn, copies, initial, code and fault of each row."""
    end = F.rtrim("text", F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    rows = ordered.select(
        "conv", "piece", "at", "turn", "copies", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.sha2(F.to_json(F.struct("conv", "role", "text")), 256).alias("key"),
        F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = rows.groupBy("key", "salt").agg(F.min("at").alias("part_first"))
    rows = with_group_totals(rows, "key", "salt", parts, {"first": F.min("part_first")})
    fault = (F.when(F.col("blank"), "blank").when(F.col("at") != F.col("first"), "duplicate")
             .when(F.col("cut"), "truncated").otherwise("none"))
    return rows.withColumn("fault", fault).withColumn(
        "code", F.when(F.col("fault").isin("blank", "duplicate"), "D")
        .when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))


def _pieces(judged: DataFrame) -> DataFrame:
    """conv, piece, codes, initials, copies: one row per piece."""
    def each(field: str) -> Column:
        return F.transform("e", lambda x: x[field])

    entry = F.struct("at", "code", "initial", "copies")
    return (judged.groupBy("conv", "piece").agg(F.array_sort(F.collect_list(entry)).alias("e"))
            .select("conv", "piece", F.array_join(each("code"), "").alias("codes"),
                    F.array_join(each("initial"), "").alias("initials"), each("copies").alias("copies")))


def _bounds(pieces: DataFrame, conv_type: str) -> DataFrame:
    """conv, piece, p, q: the states before and after each piece of the
    conversations that have several."""
    several = pieces.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("conv").alias("_c"))

    def compose(batches):
        for b in batches:
            data = [composed([ROWS[c] for c in codes]) for codes in b.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("piece"), pa.array(data, pa.binary())],
                                             names=["conv", "node", "item"])

    def lift(batches):
        for b in batches:
            data = [composed([item_of(c["item"]) for c in row]) for row in b.column("children").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("node"), pa.array(data, pa.binary())],
                                             names=["conv", "node", "item"])

    def lower(batches):
        for b in batches:
            conv, node, p, q = [], [], [], []
            for c, a, z, children in zip(*(b.column(x).to_pylist() for x in ("conv", "p", "q", "children")), strict=True):
                items = [item_of(x["item"]) for x in children]
                ways = crossings(items, a, last_state(items, a) if z is None else z)
                conv.extend([c] * len(ways))
                node.extend(x["node"] for x in children)
                p.extend(s for s, _ in ways)
                q.extend(s for _, s in ways)
            yield pa.RecordBatch.from_arrays([pa.array(conv, b.schema.field("conv").type), pa.array(node, pa.int64()),
                                              pa.array(p, pa.int32()), pa.array(q, pa.int32())], names=["conv", "node", "p", "q"])

    def grouped(rows: DataFrame, node: Column) -> DataFrame:
        return rows.groupBy("conv", node.alias("node")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("node"), F.col("item")))).alias("children"))

    schema = f"conv {conv_type}, node long, item binary"
    now = checkpointed(pieces.join(several, F.col("conv").eqNullSafe(F.col("_c")), "left_semi")
                       .select("conv", "piece", "codes").mapInArrow(compose, schema), "repair-nodes")
    levels = []
    while (now.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > 1 << FAN_BITS:
        levels.append(checkpointed(grouped(now, F.shiftright("node", FAN_BITS)), "repair-level"))
        now = checkpointed(levels[-1].mapInArrow(lift, schema), "repair-nodes")
    tops = grouped(now, F.lit(0).cast("long")).select("conv", F.lit(START).alias("p"), F.lit(None).cast("int").alias("q"), "children")
    ways = tops.mapInArrow(lower, f"conv {conv_type}, node long, p int, q int")
    for level in reversed(levels):
        ways = checkpointed(ways, "repair-ways").select(F.col("conv").alias("_c"), F.col("node").alias("_n"), "p", "q")
        ways = (level.join(ways, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n")))
                .select("conv", "p", "q", "children").mapInArrow(lower, f"conv {conv_type}, node long, p int, q int"))
    return ways


def _stream(ordered: DataFrame, pieces: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pieces, each before its rows, every conversation in one partition."""
    bounds = bounds.select(F.col("conv").alias("_c"), F.col("node").alias("_n"), "p", "q")
    heads = pieces.join(bounds, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_n")), "left").select(
        "conv", F.shiftleft("piece", PIECE_BITS).alias("at"), F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        "codes", "initials", "copies", F.coalesce("p", F.lit(START)).alias("p"), "q")
    lines = ordered.select("conv", "at", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("codes"),
                           F.lit(None).cast("string").alias("initials"), F.lit(None).cast("array<long>").alias("copies"),
                           F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("q"))
    return heads.unionByName(lines).repartition("conv").sortWithinPartitions("conv", "at", "kind")


def _edits(batches) -> Iterator[tuple]:
    """(conv, edit, times, role, text, cost, pairs) for each edit of each
    conversation; `pairs`: illegal pairs of neighbours up to that row; at the
    end of a conversation an edit of None."""
    conv, state, previous, todo, opened = None, START, "", iter(()), False

    def ending():
        now = state
        for _ in range(ENDING[state]):
            now, role = NEXT[now]
            yield conv, "I", 1, role, "", INSERT, 0
        yield conv, None, 0, None, None, 0, 0

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "codes", "initials", "copies", "p", "q")]
        for c, kind, role, text, codes, initials, copies, p, q in zip(*columns, strict=True):
            if kind == 0:
                if opened and c != conv:
                    yield from ending()
                    opened = False
                if not opened:
                    conv, previous, state, opened = c, "", START, True
                letters = (_solved_short if len(codes) <= 64 else _solved)(codes, p, q)
                todo = iter(zip(letters, codes, initials, copies, strict=True))
                continue
            tokens, code, initial, n = next(todo)
            pairs = (n - 1) + (1 if previous and previous + initial not in LEGAL_PAIRS else 0)
            previous = initial
            for letter in tokens:
                if letter == "I":
                    state, inserted = NEXT[state]
                    yield conv, "I", 1, inserted, "", INSERT, 0
                    continue
                late = TRUNCATED if code.isupper() and code != "D" and letter != "D" else 0
                if letter == "K":
                    state = KEPT[(code.lower(), state)]
                    yield conv, "K", 1, role, text, KEEP + late, pairs
                elif letter == "R":
                    state, given = NEXT[state]
                    yield conv, "R", 1, given, text, REROLE + late, pairs
                else:
                    yield conv, "D", 1, role, text, DELETE, pairs
            if n > 1:       # later copies of an equal row
                yield conv, "D", n - 1, role, text, DELETE * (n - 1), 0
    if opened:
        yield from ending()


class Repair:
    """The repair of a table conv, turn, role, text (see `damaged`)."""

    def __init__(self, rows: DataFrame):
        self.conv_type = rows.schema["conv"].dataType.simpleString()
        self.ordered = _ordered(rows)
        self.judged = checkpointed(_judged(self.ordered), "repair-judged")
        pieces = checkpointed(_pieces(self.judged), "repair-pieces")
        self.stream = _stream(self.ordered, pieces, _bounds(pieces, self.conv_type))

    def rows(self) -> DataFrame:
        """conv, place, edit, role, text: the edits of every conversation in
        order; the repaired conversation is those that are not `D`."""
        arrow = {}

        def run(batches):
            held, place = [], 0
            for conv, edit, times, role, text, _, _ in _edits(_noting(batches, arrow)):
                if edit is None:
                    place = 0
                    continue
                for _ in range(times):
                    held.append((conv, place, edit, role, text))
                    place += 1
                    if len(held) >= 4096:
                        yield _batch(held, arrow)
                        held = []
            if held:
                yield _batch(held, arrow)

        return self.stream.mapInArrow(run, f"conv {self.conv_type}, place long, edit string, role string, text string")

    def audits(self) -> DataFrame:
        """conv, illegal, cost, audit, repaired_sha256."""
        arrow = {}

        def run(batches):
            held = []
            cost = illegal = 0
            audit, sha, first = [], hashlib.sha256(), True
            for conv, edit, times, role, text, paid, pairs in _edits(_noting(batches, arrow)):
                if edit is None:
                    held.append((conv, illegal, cost, "".join(audit), sha.hexdigest()))
                    cost = illegal = 0
                    audit, sha, first = [], hashlib.sha256(), True
                    if len(held) >= 4096:
                        yield _digests(held, arrow)
                        held = []
                    continue
                cost, illegal = cost + paid, illegal + pairs
                audit.append(edit * times)
                if edit != "D":
                    sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            if held:
                yield _digests(held, arrow)

        return self.stream.mapInArrow(
            run, f"conv {self.conv_type}, illegal long, cost long, audit string, repaired_sha256 string")

    def counts(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated."""
        def of(fault: str) -> Column:
            return F.sum(F.when(F.col("fault") == fault, F.when(F.lit(fault) == "truncated", F.lit(1))
                                .otherwise(F.col("copies"))).otherwise(F.lit(0)))

        again = F.sum(F.when(F.col("fault").isin("blank", "duplicate"), F.lit(0)).otherwise(F.col("copies") - 1))
        wide = "decimal(38,0)"
        return self.judged.groupBy("conv").agg(
            F.coalesce((F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count_distinct("turn").cast(wide))
                       .try_cast("long"), F.lit(0)).alias("gaps"),
            of("blank").alias("blank"), (of("duplicate") + again).alias("duplicate"), of("truncated").alias("truncated"))


def _noting(batches, arrow: dict):
    for b in batches:
        arrow["conv"] = b.schema.field("conv").type
        yield b


def _batch(held: list, arrow: dict) -> pa.RecordBatch:
    types = [arrow["conv"], pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)],
                                      names=["conv", "place", "edit", "role", "text"])


def _digests(held: list, arrow: dict) -> pa.RecordBatch:
    types = [arrow["conv"], pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)],
                                      names=["conv", "illegal", "cost", "audit", "repaired_sha256"])


def repair_audit(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per conversation of the table, damaged and repaired: its faults,
    the cost and audit of the repair and the hash of the repaired text."""
    every = conversations.select(F.col(conv_col).alias("conv")).distinct()
    repair = Repair(damaged(conversations, conv_col, turn_col, role_col, text_col))
    counts = repair.counts().withColumnRenamed("conv", "_a")
    audits = repair.audits().withColumnRenamed("conv", "_b")
    joined = (every.join(counts, F.col("conv").eqNullSafe(F.col("_a")), "left")
              .join(audits, F.col("conv").eqNullSafe(F.col("_b")), "left"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(F.col("conv").alias(conv_col),
                         *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers],
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
