"""Conversation structure repair (operator 13): rank-convergence parallel Viterbi.

The rows of a conversation are edited at least cost so that the initials of the roles read
``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit of blank and
duplicate rows), Insert an empty user or assistant row 2, and 1 more for a truncated row that
stays. Four states (nothing yet, after s, after u, after a) make this a shortest path
through the rows; ``step`` carries the vector of the four costs to the end back over a row.

A conversation is cut into chunks of ``CHUNK_ROWS`` rows that run side by side:
1. the last chunk starts from the true costs at the end, every other one from a speculative
   vector (all zero), and runs back to its first row;
2. vectors that differ only by a constant are the same for every decision, so a chunk's
   result is kept with its least cost taken off. Where the vector that the right neighbour
   now offers has not been run yet, a fix-up pass runs the chunk from it (ordinary text ends
   after one or two). Where that goes on (rows of one role never forget whether their number
   is even), a new vector is run by all chunks of the conversation at once. Costs of two
   states differ by a few units at most, so few vectors exist and the number of passes does
   not follow the number of chunks;
3. the vectors are stitched from the end, the states from the start (both run over one
   narrow row per chunk), and each chunk traces its edits with the true costs to the end:
   of the edits that lie on a cheapest path the ASCII-least initial (D, I, K, R) is
   taken. An edit fixes the next state, so this gives the least string of initials.

Job: rows that agree in conversation, turn, role and text are counted first (a map-side
aggregate, so a row repeated a million times is one); texts that occur at several turns of
a conversation are a narrow table joined back; one range exchange brings the rows into
order, whatever the size of a conversation; tasks cut their sorted rows into chunks and
write them to the shared folder. Conversations that are one chunk are finished by a
map over that table, the others by the passes above. The digest of one conversation's
repaired text is the only thing that one task must read from end to end (it streams).

Defined results: null conv_id is a conversation of its own; null role and text count as one
space (so a null text is blank), a null turn comes first; rows of one turn are ordered by
role and text; a role is judged by its first character, an empty or other role has to be
reroled or deleted; a conversation without rows has zeros, an empty audit and the digest
of the empty string; an empty table has no conversations. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_batch, map_arrow
from .tokens import new_folder

CHUNK_ROWS = 256
CHUNK_BYTES = 4_000_000
NEIGHBOUR_PASSES = 3
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: next state when a role is kept: [state][u, a, s, other]
_KEPT = ((2, None, 1, None), (2, None, None, None), (None, 3, None, None), (2, None, None, None))
#: next state when a role is made or put in
_MADE = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_GONE = 8  # symbol of a row that has to go; others: role class + 4 if truncated
_END = (0, 2 * INSERT, INSERT, 0)
_SPECULATIVE = (0, 0, 0, 0)
_SPACE = " \t\n\x0b\x0c\r"

CHUNK = [("key", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()),
         ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
         ("turns", pa.int64()), ("turn_lo", pa.int64()), ("turn_hi", pa.int64()), ("first", pa.string()), ("last", pa.string()),
         ("syms", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
CHUNK_SQL = ("key string, conv_id long, part int, seq long, whole boolean, blank long, duplicate long, truncated long, "
             "illegal long, turns long, turn_lo long, turn_hi long, first string, last string, syms binary, "
             "roles array<string>, texts array<string>")
COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns", "turn_lo", "turn_hi"]
REPORT_SQL = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string")
REPORT = [("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
          ("audit", pa.string()), ("repaired_sha256", pa.string())]


# --- costs ----------------------------------------------------------------------

@lru_cache(maxsize=None)
def _raw(after: tuple, sym: int) -> tuple:
    """Costs to the end before a row, from those after it."""
    if sym == _GONE:
        return tuple(DELETE + c for c in after)
    role, cut = sym & 3, CUT if sym & 4 else 0
    base = []
    for s in range(4):
        best = min(DELETE + after[s], cut + REROLE + after[_MADE[s]])
        if _KEPT[s][role] is not None:
            best = min(best, cut + KEEP + after[_KEPT[s][role]])
        base.append(best)
    return tuple(min(base[s], INSERT + base[_MADE[s]], 2 * INSERT + base[_MADE[_MADE[s]]]) for s in range(4))


@lru_cache(maxsize=None)
def step(after: tuple, sym: int) -> tuple[tuple, int]:
    """(costs before a row with the least taken off, that least)."""
    raw = _raw(after, sym)
    least = min(raw)
    return tuple(c - least for c in raw), least


@lru_cache(maxsize=None)
def edits(state: int, after: tuple, sym: int) -> tuple[str, tuple, int]:
    """(initials, roles made, next state) that bring ``state`` over a row: the ASCII-least
    of the cheapest. A role of None is the row's own; deleted rows make none."""
    if sym == _GONE:
        return "D", (), state
    before, role, cut = _raw(after, sym), sym & 3, CUT if sym & 4 else 0
    said, made = "", []
    while True:
        left = before[state]
        if left == DELETE + after[state]:
            return said + "D", tuple(made), state
        if left == INSERT + before[_MADE[state]]:
            state = _MADE[state]
            said, made = said + "I", [*made, _ROLE[state]]
            continue
        kept = _KEPT[state][role]
        if kept is not None and left == cut + KEEP + after[kept]:
            return said + "K", (*made, None), kept
        return said + "R", (*made, _ROLE[_MADE[state]]), _MADE[state]


def run_back(syms: bytes, after: tuple) -> tuple[list[tuple], int]:
    """(normal cost vectors at every row and behind the last, cost taken off)."""
    vectors, total = [after] * (len(syms) + 1), 0
    for i in range(len(syms) - 1, -1, -1):
        after, least = step(after, syms[i])
        vectors[i] = after
        total += least
    return vectors, total


def trace(syms: bytes, vectors: list[tuple], state: int, end: bool) -> tuple[str, list, int]:
    """(audit, [(row or -1, role or None)] of the repaired rows, state behind)."""
    said, out, live = [], [], 0
    for i, sym in enumerate(syms):
        letters, made, state = edits(state, vectors[i + 1], sym)
        said.append(letters)
        for k, role in enumerate(made):
            own = k == len(made) - 1 and letters[-1] in "KR"
            out.append((live if own else -1, role))
        live += sym != _GONE
    while end and _END[state]:
        state = _MADE[state]
        said.append("I")
        out.append((-1, _ROLE[state]))
    return "".join(said), out, state


def _pack(v: tuple) -> int:
    return sum(c << (5 * i) for i, c in enumerate(v))


def _unpack(n: int) -> tuple:
    return tuple((n >> (5 * i)) & 31 for i in range(4))


# --- rows to chunks ---------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32(conv_id:turn) mod 20: 0 drops the row (``present``
    false), 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 sets role user."""
    text, blank = F.coalesce("text", F.lit(" ")), F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", blank).alias("role"), text.alias("text"),
                                (F.crc32(key.cast("binary")) % 20).cast("int").alias("_d"))
    d = F.col("_d")
    return rows.select(
        "conv_id", "turn", F.when(d == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(d == 1, F.lit("")).when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (d != 0).alias("present"), F.when(d == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("n"))


def as_rows(conversations: DataFrame) -> DataFrame:
    """A conversation table as it is, in the form that ``damage`` gives."""
    blank = F.lit(" ")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                                F.lit(True).alias("present"), F.lit(1).cast("long").alias("n"))


def _ordered(rows: DataFrame) -> DataFrame:
    """One row per (conversation, turn, role, text) with its count, symbol and faults, in order."""
    own = ["conv_id", "present", "turn", "role", "text"]
    here = F.col("present")
    rows = rows.select("conv_id", "present", *[F.when(here, F.col(c)).alias(c) for c in ("turn", "role", "text")], "n")
    digest = F.md5(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text")).cast("binary"))
    # texts of a conversation at more than one turn, with their first turn
    again = (rows.filter("present").groupBy(F.col("conv_id").alias("_c"), digest.alias("_h"))
             .agg(F.max(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_lo"), F.max("turn").alias("_hi"))
             .filter((F.col("_null") & F.col("_lo").isNotNull()) | (F.col("_lo") < F.col("_hi"))))
    counted = rows.groupBy(*own).agg(F.sum("n").alias("n")).withColumn("_digest", F.when(F.col("present"), digest))
    joined = counted.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_digest") == F.col("_h")), "left")
    later = F.coalesce(F.when(F.col("_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_lo")), F.lit(False))
    body = F.rtrim(F.col("text"), F.lit(_SPACE))
    cut = ~F.substring(body, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    blank = body == ""
    return joined.select(*own, "n", blank.alias("blank"), (~blank & later).alias("later"),
                         F.when(blank | later, F.lit(_GONE)).otherwise(role + F.when(cut, 4).otherwise(0)).alias("sym")) \
        .orderBy(*[F.col(c).asc_nulls_first() for c in own])


class _Chunk:
    """Rows of one conversation in order, until the chunk is full."""

    def __init__(self, conv, part: int, seq: int, whole: bool):
        self.conv, self.part, self.seq, self.whole = conv, part, seq, whole
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.lo = self.hi = self.first = self.last = None
        self.syms, self.roles, self.texts, self.bytes = bytearray(), [], [], 0

    def full(self) -> bool:
        return len(self.syms) >= _limits["rows"] or self.bytes >= CHUNK_BYTES

    def next_turn(self, turn, initial: str) -> None:
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial
        if turn is not None and turn != self.hi:
            self.turns += 1
            self.lo = turn if self.lo is None else self.lo
            self.hi = turn

    def row(self) -> tuple:
        key = "null" if self.conv is None else str(self.conv)
        return (key, self.conv, self.part, self.seq, self.whole, self.blank, self.duplicate, self.truncated, self.illegal,
                self.turns, self.lo, self.hi, self.first, self.last, bytes(self.syms), self.roles, self.texts)


_limits = {"rows": CHUNK_ROWS}


def _cut(batches, part: int, rows: int):
    """Chunks of the sorted rows of a task. The first and the last conversation of a task may
    go on in its neighbours, so only those between are known to be whole."""
    _limits["rows"] = rows
    chunk, ready, seq, size, any_conv = None, [], 0, 0, False
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist()
                   for n in ("conv_id", "present", "turn", "role", "text", "n", "blank", "later", "sym")]
        for conv, present, turn, role, text, n, blank, later, sym in zip(*columns):
            if chunk is None or conv != chunk.conv:
                if chunk is not None:
                    ready.append(chunk.row())
                chunk = _Chunk(conv, part, seq, any_conv)
                any_conv, seq = True, seq + 1
            if not present:
                continue
            initial, left = role[:1], n
            while left:
                if chunk.full():
                    chunk.whole = False
                    ready.append(chunk.row())
                    chunk = _Chunk(conv, part, seq, False)
                    seq += 1
                chunk.next_turn(turn, initial)
                if left == n and sym != _GONE:
                    chunk.syms.append(sym)
                    chunk.roles.append(role)
                    chunk.texts.append(text)
                    chunk.bytes += len(text)
                    chunk.truncated += sym >= 4
                    left -= 1
                    continue
                many = min(left, max(1, rows - len(chunk.syms)))
                chunk.syms += bytes([_GONE]) * many
                chunk.illegal += many - 1  # equal roles never follow each other
                if blank:
                    chunk.blank += many
                else:
                    chunk.duplicate += many
                left -= many
            size += len(text)
            if len(ready) >= 512 or size > CHUNK_BYTES:
                yield _batch(CHUNK, ready)
                ready, size = [], 0
    if chunk is not None:
        chunk.whole = False
        ready.append(chunk.row())
    if ready:
        yield _batch(CHUNK, ready)


def _batch(schema, rows: list[tuple]) -> pa.RecordBatch:
    return arrow_batch(schema, *(list(zip(*rows)) if rows else [[] for _ in schema]))


def chunk_table(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The chunks of all conversations, written to the shared folder."""
    spark = rows.sparkSession

    def cut(batches):
        return _cut(batches, TaskContext.get().partitionId(), chunk_rows)

    folder = f"{new_folder(spark, 'turn-chunks')}/chunks"
    map_arrow(_ordered(rows), cut, CHUNK_SQL).write.parquet(folder)
    return spark.read.schema(CHUNK_SQL).parquet(folder)


# --- passes over the chunks ---------------------------------------------------------

KNOWN_SQL = "key string, pos long, came int, gave int, cost long, map int"
KNOWN = [("key", pa.string()), ("pos", pa.int64()), ("came", pa.int32()), ("gave", pa.int32()), ("cost", pa.int64()),
         ("map", pa.int32())]


def _run(batches):
    """(key, pos, syms, came) -> the chunk's vector, cost and state map for that start."""
    for batch in batches:
        rows = []
        for key, pos, syms, came in zip(*[c.to_pylist() for c in batch.columns]):
            vectors, cost = run_back(syms, _unpack(came))
            states = 0
            for s in range(4):
                at = s
                for i, sym in enumerate(syms):
                    at = edits(at, vectors[i + 1], sym)[2]
                states |= at << (2 * s)
            rows.append((key, pos, came, _pack(vectors[0]), cost, states))
        yield _batch(KNOWN, rows)


def fix_up(chunks: DataFrame) -> tuple[DataFrame, int]:
    """(every start vector that a chunk can meet with what it makes of it, passes): runs from
    the speculative vectors, then from those that neighbours offer, until no new one comes."""
    todo = chunks.select("key", "pos", "syms", F.when(F.col("pos") == F.col("n"), F.lit(_pack(_END)))
                         .otherwise(F.lit(_pack(_SPECULATIVE))).alias("came"))
    known = new = cut_lineage(map_arrow(todo, _run, KNOWN_SQL))
    passes = 1
    while True:
        offered = new.filter("pos > 1").select("key", (F.col("pos") - 1).alias("pos"), F.col("gave").alias("came")).distinct()
        fresh = cut_lineage(offered.join(known, ["key", "pos", "came"], "left_anti"))
        if not fresh.head(1):
            return known, passes
        if passes >= NEIGHBOUR_PASSES:
            # vectors that keep travelling: every chunk of the conversation runs them at once
            vectors = fresh.select("key", "came").distinct()
            fresh = chunks.select("key", "pos").join(vectors, "key").join(known, ["key", "pos", "came"], "left_anti")
        new = cut_lineage(map_arrow(chunks.join(fresh, ["key", "pos"]).select("key", "pos", "syms", "came"), _run, KNOWN_SQL))
        known = known.unionByName(new)
        passes += 1


def _by_key(df: DataFrame, order: list, fn, schema: str) -> DataFrame:
    """``fn`` over rows in (key, ``order``); all rows of a key meet in one stream."""
    return map_arrow(df.repartition("key").sortWithinPartitions("key", *order), fn, schema)


BACK_SQL = "key string, pos long, came int, gave int, cost long, map int, turn_lo long, turn_hi long, first string, last string"
BACK = [*KNOWN, ("turn_lo", pa.int64()), ("turn_hi", pa.int64()), ("first", pa.string()), ("last", pa.string())]
PATH_SQL = "key string, pos long, came int, state int, cost long, cross_illegal long, cross_turns long"
PATH = [("key", pa.string()), ("pos", pa.int64()), ("came", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()),
        ("cross_illegal", pa.int64()), ("cross_turns", pa.int64())]


def _stitch_back(batches):
    """Of the runs of each chunk (from the last one) the one that starts where the chunk
    behind it ended."""
    key, offer, at = None, _pack(_END), None
    for batch in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] != key:
                key, offer, at = row[0], _pack(_END), None
            if row[1] != at and row[2] == offer:
                out.append(row)
                offer, at = row[3], row[1]
        yield _batch(BACK, out)


def _stitch_on(batches):
    """States from the first chunk on, and what the seams between chunks add."""
    key, state, last, turn = None, 0, None, None
    for batch in batches:
        out = []
        for k, pos, came, gave, cost, states, lo, hi, first, end in zip(*[c.to_pylist() for c in batch.columns]):
            if k != key:
                key, state, last, turn = k, 0, None, None
                cost += _unpack(gave)[0]
            out.append((k, pos, came, state, cost,
                        int(last is not None and first is not None and last + first not in ("su", "ua", "au")),
                        int(turn is not None and turn == lo)))
            state = (states >> (2 * state)) & 3
            last, turn = end if end is not None else last, hi if hi is not None else turn
        yield _batch(PATH, out)


# --- repaired rows and report ---------------------------------------------------------

def _repaired(syms, roles, texts, came: tuple, state: int, end: bool):
    vectors, cost = run_back(syms, came)
    audit, out, _ = trace(syms, vectors, state, end)
    rows = [(letter_role(role, roles, i), texts[i] if i >= 0 else "") for i, role in out]
    return audit, rows, vectors, cost


def letter_role(role, roles: list, i: int) -> str:
    return role if role is not None else roles[i]


def _gaps(turns: int, lo, hi) -> int:
    return 0 if lo is None else hi - lo + 1 - turns


def _finish_whole(batches):
    """Report rows of conversations that are one chunk."""
    for batch in batches:
        out = []
        names = ["conv_id", *COUNTS, "syms", "roles", "texts"]
        for conv, blank, dup, cut, illegal, turns, lo, hi, syms, roles, texts in zip(
                *[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]):
            audit, rows, vectors, cost = _repaired(syms, roles, texts, _END, 0, True)
            digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()
            out.append((conv, _gaps(turns, lo, hi), blank, dup, cut, illegal, cost + vectors[0][0], audit, digest))
        yield _batch(REPORT, out)


TRACED = [("key", pa.string()), ("conv_id", pa.int64()), ("pos", pa.int64()), *[(n, pa.int64()) for n in COUNTS],
          ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
TRACED_SQL = ("key string, conv_id long, pos long, " + ", ".join(f"{n} long" for n in COUNTS)
              + ", cost long, audit string, roles array<string>, texts array<string>")


def _trace_chunks(batches):
    for batch in batches:
        out = []
        names = ["key", "conv_id", "pos", "n", *COUNTS, "syms", "roles", "texts", "came", "state", "cost", "cross_illegal", "cross_turns"]
        for key, conv, pos, n, blank, dup, cut, illegal, turns, lo, hi, syms, roles, texts, came, state, cost, x, y in zip(
                *[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]):
            audit, rows, _, _ = _repaired(syms, roles, texts, _unpack(came), state, pos == n)
            out.append((key, conv, pos, blank, dup, cut, illegal + x, turns - y, lo, hi, cost, audit,
                        [r for r, _ in rows], [t for _, t in rows]))
        yield _batch(TRACED, out)


def _finish_chunks(batches):
    """Report rows of conversations of several chunks: one stream in (key, pos)."""
    key, held = None, None

    def report():
        conv, s, lo, hi, audit, h, _ = held
        return (conv, _gaps(s[4], lo, hi), s[0], s[1], s[2], s[3], s[5], "".join(audit), h.hexdigest())

    for batch in batches:
        out = []
        for k, conv, _, blank, dup, cut, illegal, turns, lo, hi, cost, audit, roles, texts in zip(*[c.to_pylist() for c in batch.columns]):
            if held is None or k != key:
                if held is not None:
                    out.append(report())
                key, held = k, [conv, [0] * 6, None, None, [], hashlib.sha256(), False]
            for i, v in enumerate((blank, dup, cut, illegal, turns, cost)):
                held[1][i] += v
            held[2] = lo if held[2] is None else held[2]
            held[3] = hi if hi is not None else held[3]
            held[4].append(audit)
            for r, t in zip(roles, texts):
                held[5].update((("\n" if held[6] else "") + f"{r}:{t}").encode())
                held[6] = True
        yield _batch(REPORT, out)
    if held is not None:
        yield _batch(REPORT, [report()])


def _positions(chunks: DataFrame) -> DataFrame:
    """Chunks of the conversations that are not known to be whole, numbered in their order."""
    split = chunks.filter("not whole")
    narrow = split.select("key", "part", "seq")
    w = Window.partitionBy("key")
    numbered = narrow.select("key", "part", "seq", F.row_number().over(w.orderBy("part", "seq")).cast("long").alias("pos"),
                             F.count(F.lit(1)).over(w).alias("n"))
    return split.join(numbered, ["key", "part", "seq"])


def _traced(split: DataFrame) -> DataFrame:
    known, _ = fix_up(split.select("key", "pos", "n", "syms"))
    edges = split.select("key", "pos", "turn_lo", "turn_hi", "first", "last")
    back = _by_key(known.join(edges, ["key", "pos"]).select(*[n for n, _ in BACK]), [F.desc("pos")], _stitch_back, BACK_SQL)
    path = cut_lineage(_by_key(back, ["pos"], _stitch_on, PATH_SQL))
    return map_arrow(split.join(path, ["key", "pos"]), _trace_chunks, TRACED_SQL)


def repair_report(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (from ``damage`` or ``as_rows``): counted faults,
    least cost, the edits' initials and the digest of the repaired rows."""
    chunks = chunk_table(rows, chunk_rows)
    whole = map_arrow(chunks.filter("whole").select("conv_id", *COUNTS, "syms", "roles", "texts"), _finish_whole, REPORT_SQL)
    split = cut_lineage(_positions(chunks))
    rest = _by_key(_traced(split), ["pos"], _finish_chunks, REPORT_SQL)
    return whole.unionByName(rest)


def repaired_turns(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv_id, chunk, place, role, text): the repaired rows, ordered by chunk and place."""
    chunks = chunk_table(rows, chunk_rows)
    split = cut_lineage(_positions(chunks.withColumn("whole", F.lit(False))))
    both = F.arrays_zip("roles", "texts")
    return (_traced(split).select("conv_id", F.col("pos").alias("chunk"), F.posexplode(both).alias("place", "row"))
            .select("conv_id", "chunk", "place", F.col("row.roles").alias("role"), F.col("row.texts").alias("text")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
