"""Conversation repair and prefix tries against brute force, with edge rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from synapta.llm import prefix_trie, turn_repair

SPACE = re.compile(r"[^\x20\x09-\x0D]")
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def forward(turns):
    """(cost, edits) by exhaustive forward costs over strings; turns: (initial, must go, truncated)."""
    best = {"": (0, "")}  # state: initials so far, as their last one ('' none)

    def grow(best):
        for _ in range(3):
            for s, (c, k) in list(best.items()):
                to = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
                best[to] = min(best.get(to, (9**9, "")), (c + 2, k + "I"))
        return best

    for initial, gone, cut in turns:
        new = {}

        def put(s, v, new=new):
            new[s] = min(new.get(s, (9**9, "")), v)

        for s, (c, k) in grow(best).items():
            put(s, (c + 3, k + "D"))
            if not gone:
                to = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
                if initial == to:
                    put(to, (c + cut, k + "K"))
                else:
                    put(to, (c + cut + 2, k + "R"))
                if s == "" and initial == "s":
                    put("s", (c + cut, k + "K"))
        best = new
    best = grow(best)
    return min(best[s] for s in ("", "a") if s in best)


def test_edits_are_the_least():
    kinds = [(i, g, c) for i in "suax" for g, c in ((False, False), (False, True), (True, False))]
    rng = random.Random(1)
    cases = [list(x) for n in range(4) for x in itertools.product(kinds, repeat=n)] + [[rng.choice(kinds) for _ in range(rng.randrange(4, 60))] for _ in range(600)]
    for turns in cases:
        cost, edits = turn_repair.cheapest(bytes(turn_repair.code(*t) for t in turns))
        assert (cost, "".join(edits)) == forward(turns), turns


def brute_repair(rows):
    """Of one conversation's (turn, role, text) rows."""
    md5 = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, md5(r)))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    seen, turns, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for t, r, x in rows:
        fault = "blank" if not SPACE.search(x) else "duplicate" if (r, x) in seen else "truncated" if SPACE.findall(x)[-1] not in ".!?" else None
        seen.add((r, x))
        if fault:
            count[fault] += 1
        turns.append((r[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit = forward(turns)
    out, left = [], iter(rows)
    for e in audit:
        row = next(left) if e != "I" else None
        if e != "D":
            last = out[-1][0][:1] if out else ""
            new = "assistant" if last == "u" else "user"
            out.append((row[1] if e == "K" else new, row[2] if row else ""))
    assert SHAPE.match("".join(r[:1] for r, _ in out))
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)


TURNS = "conv_id bigint, turn bigint, role string, text string, id string, audit string, n int"
EDGES = [
    (1, 0, "user", "Hi there."), (1, 1, "user", "Hi there."), (1, 1, "user", "Hi there."), (1, 5, "assistant", "Yes"),
    (2, None, None, None), (2, None, "assistant", "a."), (2, 3, "system", " \n"), (None, 1, "user", "x!"), (None, None, "tool", "y?"), (None, 1, "user", "x!"),
    (3, 2, "assistant", "z" * 200_000), (3, 1, "assistant", "one. \t"), (3, 1, "assistant", "two."), (4, -7, "s", "ok."), (5, 0, "user", ""),
]


def rows_of(seed, hot=0):
    rng = random.Random(seed)
    rows = list(EDGES)
    for c in range(10, 90):
        for t in range(rng.randrange(1, 12)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Hello.", "Hello.", f"text {t}", "so?", " ", None])))
    rows += [(7, i if i % 3 else i - 1, rng.choice(["user", "assistant"]), f"line {i % 900}.") for i in range(hot)]
    return [(*r, "k", "audit", 3) for r in rows]


@pytest.mark.parametrize("hot", [0, 3000])
def test_repair_equals_brute_force(spark, hot):
    rows = rows_of(2, hot)
    turns = spark.createDataFrame(rows, TURNS).repartition(4)
    plans = turn_repair.plan_repairs(turns)
    told = {r.conv_id: tuple(r)[1:] for r in plans.collect()}
    back = {r.conv_id: (r.audit, r.repaired_sha256) for r in turn_repair.digests(turn_repair.repair(turns, plans)).collect()}
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t, r, x))
    assert set(told) == set(back) == set(by)
    for c, v in by.items():
        want = brute_repair(v)
        assert told[c] == want[:-1] and back[c] == want[-2:], c


def test_repair_of_nothing(spark):
    turns = spark.createDataFrame([], TURNS)
    plans = turn_repair.plan_repairs(turns)
    assert plans.collect() == [] and turn_repair.repair(turns, plans).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! x?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = sorted(map(tuple, turn_repair.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()), key=repr)
    want = []
    for c, t, r, x in rows:
        r, x = r or " ", x or " "
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if how:
            want += [(c, t, "user" if how == 4 else r, "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x)] * (2 if how == 3 else 1)
    assert got == sorted(want, key=repr)


def brute_trie(seqs):
    """conv_id to [(id, words), ...] -> rows of nodes."""
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    rows, kids = [], {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids.get(p, [])]
        saved = (len(members[p]) - 1) * p[-1][1] if p else 0
        totals[p] = (sum(x[0] for x in below) if below else 1, saved + sum(x[1] for x in below))
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        rows.append((min(m), len(p), parent, len(m), len(kids.get(p, [])), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows)


def brute_rebuilt(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            by.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}:{x}".encode()).hexdigest(), len(SPACE_WORDS.findall(x))))
    by = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    return {c: by.get(c - c % 20, [])[: h(c)] + v[h(c) :] for c, v in by.items()}


SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def trie_rows(seed, long=0):
    rng = random.Random(seed)
    rows = [r for r in rows_of(seed) if r[0] is None or r[0] >= 0]
    for c in range(100, 420):  # a group of copies, and shared fronts
        rows += [(c, t, "user", "same words here") for t in range(5)] if c % 3 else [(c, t, "user", f"{rng.randrange(2)} a") for t in range(rng.randrange(1, 6))]
    for c in range(500, 500 + 8 * bool(long)):  # long ones that part late, one that ends where a block does
        n = long if c % 2 else 8
        rows += [(c, t, "user", f"t{t}" if t < long - 5 or c % 4 else f"u{c}") for t in range(n)]
    return rows


@pytest.mark.parametrize(("block", "shard_rows", "long"), [(64, 5000, 0), (4, 7, 37), (4, 1000, 37), (64, 20, 150)])
def test_trie_equals_brute_force(spark, block, shard_rows, long):
    rows = trie_rows(4, long)
    turns = spark.createDataFrame([r[:4] + ("x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, seq string, depth int").repartition(3)
    got = sorted(map(tuple, prefix_trie.prefix_trie(prefix_trie.rebuilt(turns), block, shard_rows).collect()), key=lambda r: r[:2])
    assert got == brute_trie(brute_rebuilt(rows))


def test_trie_of_nothing_and_of_bare_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([], schema))).collect() == []
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([(None, 1, "user", "x")], schema))).collect() == []
    bare = [c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "user", "x") for c in bare]
    got = [tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame(rows, schema))).collect()]
    assert got == brute_trie(brute_rebuilt(rows)) == [(bare[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, bare)).encode()).hexdigest())]
