import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from threadlens.llm import turns

D = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
RIGHT = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """(conversation -> rows after damage, all conversations)"""
    out, ids = {}, {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(d, text)
        row = (turn, "user" if d == 4 else role, text)
        out.setdefault(conv, []).extend([row] * {0: 0, 3: 2}.get(d, 1))
    return out, ids


def edit(rows):
    """Cheapest (cost, audit) by uniform-cost search over (row, accepted prefix state), and
    the repaired rows; of equal costs the least audit."""
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        kind = "blank" if not body else "dup" if (role, text) in seen else "cut" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
    # prefixes of (s?(ua)+)? by what may follow: "" -> s or u, s -> u, u -> a, a -> u
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, said, i, state, made = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return kinds, cost, said, made
        grow = lambda s, ini, who, add, text: heapq.heappush(
            heap, (cost + add, said + ini, s, who[:1], (*made, f"{who}:{text}")))
        for who in ("user", "assistant"):
            if who[0] in follow[state] and sum(1 for c in said[::-1][:3] if c == "I") < 3:
                grow(i, "I", who, 2, "")
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, said + "D", i + 1, state, made))
            if kinds[i] in ("", "cut"):
                add, (_, role, text) = int(kinds[i] == "cut"), rows[i]
                if role[:1] and role[0] in follow[state]:
                    heapq.heappush(heap, (cost + add, said + "K", i + 1, role[0], (*made, f"{role}:{text}")))
                for who in ("user", "assistant"):
                    if who[0] in follow[state]:
                        grow(i + 1, "R", who, 2 + add, text)


def brute(rows):
    after, ids = damaged(rows)
    out = []
    for conv in ids:
        rows = sorted(after.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, cost, audit, made = edit(rows)
        known = {t for t, _, _ in rows if t is not None}
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:])]
        out.append((conv, max(known) - min(known) + 1 - len(known) if known else 0, kinds.count("blank"), kinds.count("dup"),
                    kinds.count("cut"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def rows_of(df):
    return [(r.conv_id, r.turn, r.role, r.text) for r in df.select("conv_id", "turn", "role", "text").collect()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    got = turns.op13_conversation_repair(spark, d)
    assert [n for n, _ in got.dtypes] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {t for n, t in got.dtypes if n not in ("audit", "repaired_sha256")} == {"bigint"}
    same(got.collect(), brute(rows_of(spark.read.parquet(f"{d}/conversations.parquet"))))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, 1, "user", "a row without a conversation."), (None, None, None, None), (1, None, "user", None), (1, 0, None, "x."),
            (2, 5, "", "no role."), (2, 9, "tool", "other role"), (2, 9, "user", "tie."), (2, 9, "user", "tie."), (2, 9, "assistant", "tie!"),
            (3, 1, "system", "  \t\n"), (3, 2, "system", "late system."), (3, -4, "user", "early? "), (4, 2**62, "sure", "s"), (4, 3, "u", "t."),
            (5, 0, "user", "é" * 5000 + "."), (6, 1, "assistant", "only."), (7, 1, "system", "s."), (7, 2, "system", "s."), (7, 3, "user", "u.")]
    rows += [(8, 7, "user", "the same row many times.")] * 50 + [(9, t, "user", "one text at many turns.") for t in range(40)]
    rng = random.Random(5)
    rows += [(100 + c, t, rng.choice(["user", "user", "assistant", "system", "bot"]), rng.choice(["a.", "b", "c?", "d!", " ", f"{t}."]))
             for c in range(30) for t in range(rng.randint(1, 60))]
    rows += [(500, t, "user", f"{t}.") for t in range(150)] + [(501, t, rng.choice(["user", "assistant"]), f"{t}") for t in range(150)]
    return spark.createDataFrame([(*r, "x", 1, "k") for r in rows],
                                 "conv_id long, turn long, role string, text string, audit string, pos int, key string")


@pytest.mark.parametrize("chunk", [1, 3, 16, 1000])
def test_odd_rows_in_small_chunks(odd, chunk):
    same(turns.repair_report(turns.damage(odd), chunk).collect(), brute(rows_of(odd)))


def test_fix_up_passes_do_not_grow_with_the_chunks(spark):
    """Rows of one role never forget where they started (even and odd rows differ); the
    number of passes must still not follow the number of chunks."""
    rows = [(1, t, "user", f"{t}.") for t in range(600)]
    df = turns.as_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    counts = {}
    for chunk in (60, 5):
        split = turns._positions(turns.chunk_table(df, chunk).drop("whole").selectExpr("*", "false as whole"))
        known, passes = turns.fix_up(split.select("key", "pos", "n", "syms"))
        counts[split.count()] = passes
    assert set(counts) == {10, 120} and max(counts.values()) <= 6, counts


def test_empty_table(odd):
    assert turns.repair_report(turns.damage(odd.limit(0))).collect() == []


def test_no_rows_after_damage(spark):
    turn = next(t for t in itertools.count() if zlib.crc32(f"77:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(77, turn, "user", "gone.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in turns.repair_report(turns.damage(df)).collect()] == [
        (77, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_read_right_and_match_the_digest(odd):
    rows = turns.as_rows(odd)
    report = {r.conv_id: r for r in turns.repair_report(rows, 16).collect()}
    got = {}
    for r in turns.repaired_turns(rows, 7).orderBy("conv_id", "chunk", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, r in report.items():
        made = got.get(conv, [])
        assert RIGHT.fullmatch("".join(role[:1] for role, _ in made))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest() == r.repaired_sha256
        assert len(made) == len(r.audit) - r.audit.count("D")
