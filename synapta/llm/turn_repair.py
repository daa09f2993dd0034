"""Conversation structure repair: the cheapest edits that give a conversation the shape system? (user assistant)+, or nothing.

Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3 (required for blank and repeated turns), Insert of an empty user or
assistant turn 2; a turn that ends without a mark and is not deleted adds 1. Of the cheapest edits the ASCII-least are taken.

The costs are found backwards: a vector of four states (nothing yet, after system, after user, after assistant) for each place.
Only every sqrt(n)-th vector is kept; walking forward, the vectors between two of them are computed again, block by block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synapta.llm.common import CRC_TABLE, crc32_sql, map_batches, table

#: Marks that end a whole turn.
MARKS = ".!?"
#: Pairs of role initials that may stand side by side.
LEGAL = frozenset({"su", "ua", "au"})

_INF = 1 << 60
Costs = tuple[int, int, int, int]
#: State after a user or assistant turn comes in, by the state before (0 nothing yet, 1 system, 2 user, 3 assistant).
NEXT = (2, 2, 3, 2)


def code(initial: str, forced: bool, truncated: bool) -> int:
    """A turn as one byte: 0 if it must go, else role (s, u, a, other) and whether it is truncated."""
    return 0 if forced else 1 + 2 * {"s": 0, "u": 1, "a": 2}.get(initial, 3) + truncated


def _inserted(b0: int, b1: int, b2: int, b3: int) -> Costs:
    """Costs where turns may be inserted first."""
    v2, v3 = min(b2, b3 + 2), min(b3, b2 + 2)
    return min(b0, v2 + 2), min(b1, v2 + 2), v2, v3


#: Behind the last turn: done with nothing or after an assistant turn.
END = _inserted(0, _INF, _INF, 0)


def before(turn: int, v: Costs) -> Costs:
    """Costs from a turn on, by the state before it, of the costs behind it."""
    v0, v1, v2, v3 = v
    if not turn:
        return _inserted(v0 + 3, v1 + 3, v2 + 3, v3 + 3)
    role, more = (turn - 1) >> 1, (turn - 1) & 1
    user, assistant = v2 + more + 2 * (role != 1), v3 + more + 2 * (role != 2)
    b0 = min(v0 + 3, user)
    if role == 0:
        b0 = min(b0, v1 + more)
    return _inserted(b0, min(v1 + 3, user), min(v2 + 3, assistant), min(v3 + 3, user))


def cheapest(turns: bytes) -> tuple[int, Iterator[str]]:
    """The least cost of a conversation of `code` bytes, and its edits in order. Holds 2 * sqrt(n) vectors at a time."""
    n = len(turns)
    size = max(1, math.isqrt(n))
    marks, v = {n: END}, END
    for i in range(n - 1, -1, -1):
        v = before(turns[i], v)
        if i % size == 0:
            marks[i] = v

    def walk() -> Iterator[str]:
        state = 0
        for start in range(0, n, size):
            stop = min(start + size, n)
            block = [marks[stop]]
            for i in range(stop - 1, start - 1, -1):
                block.append(before(turns[i], block[-1]))
            for i in range(start, stop):
                here, behind = block[stop - i], block[stop - i - 1]
                while True:
                    if behind[state] + 3 == here[state]:
                        yield "D"
                        break
                    to = NEXT[state]
                    if here[to] + 2 == here[state]:
                        yield "I"
                        state = to
                        continue
                    role, more = (turns[i] - 1) >> 1, (turns[i] - 1) & 1
                    if role == 0 and state == 0 and behind[1] + more == here[0]:
                        yield "K"
                        state = 1
                    else:
                        yield "K" if role == to - 1 and behind[to] + more == here[state] else "R"
                        state = to
                    break
        while state not in (0, 3) or END[state]:
            yield "I"
            state = NEXT[state]

    return v[0], walk()


def _narrow(turns: DataFrame) -> DataFrame:
    """Turns without their texts: an id of role and text (md5), the role's initial and what is wrong with the text alone."""
    r, t = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), r.alias("role"), t.alias("text"))
    same = F.unhex(F.md5(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text").cast("binary")))
    return rows.withColumn("id", same)


def _by_conversation(df: DataFrame, *first: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), "id")


PLAN = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_PLAN = [pa.int64()] * 7 + [pa.string()]


class _Conversation:
    """What is counted while the turns of a conversation pass by; one byte a turn is kept."""

    def __init__(self):
        self.codes, self.last, self.blank, self.duplicate, self.truncated, self.illegal = bytearray(), None, 0, 0, 0, 0
        self.low = self.high = self.at = None
        self.distinct = 0

    def add(self, turn, initial: str, blank: bool, ended: bool, repeated: bool, n: int) -> None:
        """n equal rows; ``repeated``: role and text stood in an earlier turn."""
        if turn is not None:
            self.distinct += turn != self.at
            self.low = turn if self.low is None else self.low
            self.high = self.at = turn
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (n - 1) * (initial + initial not in LEGAL)
        self.last = initial
        first = 0 if blank or repeated else 1
        if blank:
            self.blank += n
        else:
            self.duplicate += n - first
        if first:
            self.truncated += not ended
            self.codes.append(code(initial, False, not ended))
        self.codes.extend(bytes(n - first))

    def row(self) -> tuple:
        cost, edits = cheapest(bytes(self.codes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(edits)


def _plan(batches):
    conv, state = None, None
    for b in batches:
        done = []
        for r in b.to_pylist():
            if state is None or r["conv_id"] != conv:
                if state:
                    done.append((conv, *state.row()))
                conv, state = r["conv_id"], _Conversation()
            state.add(r["turn"], r["initial"], r["blank"], r["ended"], r["repeated"], r["n"])
        yield _batch(done, _PLAN, PLAN)
    yield _batch([(conv, *state.row())] if state else [], _PLAN, PLAN)


def _batch(rows: list[tuple], kinds: list, schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def plan_repairs(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): one row a conversation, its faults and its edits.

    ``turns``: conv_id, turn, role, text; other columns do no harm. Turns are ordered by turn (nulls first), ties by md5 of role and text,
    so equal rows of a turn stand side by side. A null role or text is '' (a blank turn); null conv_ids are one conversation. The first
    fault of a turn counts: blank (no word), duplicate (role and text of an earlier turn), truncated (its last character
    besides white space is no mark). gaps: missing numbers between the least and greatest turn. An empty table gives no rows.

    Texts of any length are read where they lie. What is shuffled is 50 bytes a turn; equal rows are counted before they are
    shuffled. A conversation passes one task as a stream that keeps a byte a turn; its cost vectors take the root of its length.
    """
    rows = _narrow(turns)
    last = F.regexp_extract("text", f"[{MARKS}][\\x20\\x09-\\x0D]*\\z", 0) != ""
    seen = rows.select("conv_id", "turn", "id", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), last.alias("ended"))
    each = seen.groupBy("conv_id", "turn", "id", "initial", "blank", "ended").agg(F.count("*").alias("n"))
    first = seen.groupBy(F.col("conv_id").alias("_conv"), F.col("id").alias("_id")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("_first"))
    told = each.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("id") == F.col("_id")))
    told = told.select("conv_id", "turn", "id", "initial", "blank", "ended", (~F.col("turn").eqNullSafe(F.col("_first"))).alias("repeated"), "n")
    return map_batches(_by_conversation(told), _plan, PLAN)


REPAIRED = "conv_id bigint, position bigint, edit string, turn bigint, role string, text string"
_REPAIRED = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]


def _repair(batches):
    conv, audit, at, state = None, "", 0, 0

    def inserts():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state = NEXT[state]
            yield (conv, at, "I", None, ("user", "assistant")[state - 2], "")
            at += 1

    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["audit"] is not None:  # stands before the turns of its conversation
                out.extend(inserts())
                conv, audit, at, state = r["conv_id"], r["audit"], 0, 0
                continue
            out.extend(inserts())
            edit, role = audit[at], r["role"]
            if edit == "R":
                role = ("user", "assistant")[NEXT[state] - 2]
            if edit != "D":
                state = 1 if state == 0 and edit == "K" and role[:1] == "s" else NEXT[state]
            out.append((conv, at, edit, r["turn"], role, r["text"]))
            at += 1
        yield _batch(out, _REPAIRED, REPAIRED)
    yield _batch(list(inserts()), _REPAIRED, REPAIRED)


def repair(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """One row an edit, in order within its conversation: (conv_id, position, edit, turn, role, text). Rows other than D are the
    repaired conversation; D rows show what went. ``plans`` are `plan_repairs` of the same turns.

    A conversation's edits travel to its turns as one more row in front of them, so nothing is joined; texts are shuffled once and
    stream by, none is held. Edge rows as in `plan_repairs`.
    """
    rows = _narrow(turns).withColumn("audit", F.lit(None).cast("string"))
    heads = plans.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("id"), "audit")
    dealt = _by_conversation(heads.unionByName(rows).withColumn("body", F.col("audit").isNull()), "body")
    return map_batches(dealt.select("conv_id", "turn", "role", "text", "audit"), _repair, REPAIRED)


DIGEST = "conv_id bigint, audit string, repaired_sha256 string"


def _digest(batches):
    conv, sha, letters, first, started = None, None, [], True, False
    kinds = [pa.int64(), pa.string(), pa.string()]
    for b in batches:
        done = []
        for r in b.to_pylist():
            if r["position"] == 0:
                if started:
                    done.append((conv, "".join(letters), sha.hexdigest()))
                conv, sha, letters, first, started = r["conv_id"], hashlib.sha256(), [], True, True
            letters.append(r["edit"])
            if r["edit"] != "D":
                sha.update(("" if first else "\n").encode() + f"{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
                first = False
        yield _batch(done, kinds, DIGEST)
    yield _batch([(conv, "".join(letters), sha.hexdigest())] if started else [], kinds, DIGEST)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) from repaired turns as `repair` leaves them."""
    return map_batches(repaired, _digest, DIGEST)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by crc32('conv_id:turn') % 20; nulls become one space first."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), how.alias("_how"))
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace("text", f"[{MARKS}]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_how") == 4, "user").otherwise(F.col("role"))
    rows = rows.where("_how <> 0").withColumn("text", text).withColumn("role", role)
    return rows.withColumn("_copy", F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_how", "_copy")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations")
    turns = damaged(source)
    plans = plan_repairs(turns)
    back = digests(repair(turns, plans))
    told = plans.drop("audit").withColumnRenamed("conv_id", "_c").join(back.withColumnRenamed("conv_id", "_d"), F.col("_c").eqNullSafe(F.col("_d"))).drop("_d")
    every = source.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    out = every.join(told, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


# --- the same in DuckDB: forward costs of four states, each with its edits and the text so far -----------------------


def _sql() -> str:
    def add(state: str, cost: str, letter: str, text: str = "") -> str:
        line = f"v[{state}].t" + (f" || {text} || chr(10)" if text else "")
        return f"CASE WHEN v[{state}] IS NOT NULL THEN {{'c': v[{state}].c + {cost}, 'k': v[{state}].k || '{letter}', 't': {line}}} END"

    own = "(CASE WHEN truncated THEN 1 ELSE 0 END)"
    inside = lambda s, role: add(s, f"{own}", "K", "role || ':' || text").replace("WHEN v", f"WHEN NOT forced AND initial = '{role[0]}' AND v", 1)
    to = lambda s, role: add(s, f"{own} + 2", "R", f"'{role}:' || text").replace("WHEN v", f"WHEN NOT forced AND initial <> '{role[0]}' AND v", 1)
    gone = lambda s: add(s, "3", "D")
    best = lambda *x: "list_min([" + ", ".join(x) + "])"
    eaten = [
        gone("1"), best(gone("2"), inside("1", "s")),
        best(gone("3"), *(f(s, "user") for s in ("1", "2", "4") for f in (inside, to))), best(gone("4"), *(f("3", "assistant") for f in (inside, to))),
    ]
    two = best("v[3]", *(add(s, "2", "I", "'user:'") for s in ("1", "2", "4")))
    grown = lambda src: f"SELECT * REPLACE ([v[1], v[2], v[3], {best('v[4]', add('3', '2', 'I', chr(39) + 'assistant:' + chr(39)))}] AS v) FROM (SELECT * REPLACE ([v[1], v[2], {two}, v[4]] AS v) FROM ({src}))"
    start = "SELECT conv_id, CAST(0 AS BIGINT) AS p, [{'c': 0, 'k': '', 't': ''}, NULL, NULL, NULL] AS v FROM e"
    step = f"SELECT w.conv_id, r.p, [{', '.join(eaten)}] AS v FROM w JOIN r ON r.conv_id = w.conv_id AND r.p = w.p + 1"
    return f"""
WITH RECURSIVE {CRC_TABLE},
s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS how FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM s WHERE how <> 0),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text)) AS p, left(role, 1) AS initial,
  NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open FROM d),
r AS (SELECT *, blank OR again AS forced, NOT blank AND NOT again AND open AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again FROM q)),
f AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
  count(*) FILTER (WHERE last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY p) AS last FROM r) GROUP BY 1),
e AS (SELECT DISTINCT conv_id FROM r),
w AS ({grown(start)} UNION ALL {grown(step)}),
z AS (SELECT w.conv_id, list_min([v[1], v[4]]) AS b FROM w JOIN f ON f.conv_id = w.conv_id AND f.n = w.p)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.k, '') AS audit,
  sha256(coalesce(left(b.t, length(b.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN f USING (conv_id) LEFT JOIN z USING (conv_id)"""


ORACLE = _sql()
