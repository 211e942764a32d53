"""Vector code compression (operator 11): part codebooks fitted with adaptive bounds.

Every vector is floored to integers, cut into equal parts, and each part is coded by the
nearest entry of that part's codebook. The codebooks are refined for some rounds (assign,
then replace every entry by the floored mean of its parts).

Assignments keep Drake and Hamerly's adaptive bounds. Each part's row persists its entry,
an upper bound on the distance to it, the ``b`` next closest entries with ordered lower
bounds, and one outer bound for all entries beyond. After the entries have moved:
1. every bound is widened by how far its entry moved (the outer one by the largest move)
   and the lower bounds are made ordered again;
2. a row whose upper bound lies clearly under its first lower bound keeps its entry
   without any distance;
3. otherwise the exact distance to its entry is computed, which tightens the upper bound;
   the first ``z`` closest entries whose lower bounds do not clear it are the uncertain
   ones: their exact integer distances decide (ties to the lower index), and the row's
   list is put into the new order;
4. a row that does not clear the outer bound either compares all entries.
Bounds are floats rounded outwards; whatever they leave open is decided on integers.
``b`` adapts per part: after a round it falls to the depth that all but ``SPARE`` of
the rows needed, between ``LEAST`` and ``START``.

Job: one row per vector (integers and bounds as packed bytes) in a table in the shared
folder, rewritten once a round by one pass without an exchange; the table of the round
before is removed when the next one is complete. The pass also writes one row per task
with the sums and counts of every entry and the depths needed; their sum over the tasks
(a partial aggregate over a number of cells that the codebook fixes) gives the next
codebook, which is all that reaches the driver and the tasks: parts x entries x length.
The sums per group are a partial aggregate joined back; a hot group is one row of it.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are
left out. Vectors shorter than the longest are continued with zeros, as is a length that
the parts do not divide. Integers beyond +-2^27 are set to that limit (no distance can
leave 64 bits). Rows of a repeated id are rows of their own; seeds are the smallest ids,
of equal ids the smaller vector; a null id is coded but never a seed unless all ids are
null. Fewer rows than entries give that many entries; an empty table gives no rows.
Null groups count as one group. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, map_arrow
from .tokens import new_folder

PARTS, ENTRIES, ROUNDS = 4, 256, 4
START, LEAST, SPARE = 24, 4, 0.05
LIMIT = 1 << 27
SLICE = 8192
#: integers up to this size have squared distances that float64 holds exactly
EXACT = 1 << 21

STATE = [("id", pa.int64()), ("grp", pa.int64()), ("ints", pa.binary()), ("state", pa.binary()),
         ("sums", pa.list_(pa.int64()))]
STATE_SQL = "id long, grp long, ints binary, state binary, sums array<long>"


# --- distances ----------------------------------------------------------------

def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries, int64)."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) <= EXACT:
        xf, cf = x.astype(np.float64), book.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] + (cf * cf).sum(1)[None, :] - 2.0 * (xf @ cf.T)).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k].astype(np.int64)[:, None] - book[:, k][None, :]
        out += d * d
    return out


def picked(x: np.ndarray, book: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to the entries ``at`` (rows x some)."""
    d = x.astype(np.int64)[:, None, :] - book[at]
    return np.einsum("nbk,nbk->nb", d, d)


def root_up(d: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d.astype(np.float64)).astype(np.float32) * np.float32(1 + 1e-6), np.float32(np.inf))


def root_down(d: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(d.astype(np.float64)).astype(np.float32) * np.float32(1 - 1e-6), np.float32(0))


# --- one part's rows ------------------------------------------------------------

class Bounds:
    """State of one part: entry, upper bound, near entries, their lower bounds, outer bound."""

    def __init__(self, own, upper, near, lower, outer):
        self.own, self.upper, self.near, self.lower, self.outer = own, upper, near, lower, outer

    @staticmethod
    def width(b: int) -> int:
        return 2 + 4 + 2 * b + 4 * b + 4

    def pack(self) -> np.ndarray:
        n = len(self.own)
        raw = lambda a, t: np.ascontiguousarray(a, t).view(np.uint8).reshape(n, -1)
        return np.concatenate([raw(self.own, "<i2"), raw(self.upper, "<f4"), raw(self.near, "<i2"),
                               raw(self.lower, "<f4"), raw(self.outer, "<f4")], axis=1)

    @classmethod
    def unpack(cls, raw: np.ndarray, b: int) -> Bounds:
        cuts = np.cumsum([0, 2, 4, 2 * b, 4 * b, 4])
        take = lambda i, t: np.ascontiguousarray(raw[:, cuts[i]:cuts[i + 1]]).view(t)
        return cls(take(0, "<i2")[:, 0].astype(np.int64), take(1, "<f4")[:, 0].copy(), take(2, "<i2").astype(np.int64),
                   take(3, "<f4").copy(), take(4, "<f4")[:, 0].copy())

    def shrink(self, b: int) -> None:
        """Forget the entries beyond ``b``; the first forgotten bound holds for all of them."""
        if b < self.near.shape[1]:
            self.outer = np.minimum(self.outer, self.lower[:, b])
            self.near, self.lower = self.near[:, :b].copy(), self.lower[:, :b].copy()


def closest(x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
    """Compare every entry: exact order by (distance, index)."""
    d = distances(x, book)
    k = len(book)
    order = np.argsort(d, axis=1, kind="stable")[:, :b + 2]
    held = np.take_along_axis(d, order, 1)
    near = np.full((len(x), b), -1, np.int64)
    lower = np.full((len(x), b), np.inf, np.float32)
    m = min(b, k - 1)
    near[:, :m], lower[:, :m] = order[:, 1:m + 1], root_down(held[:, 1:m + 1])
    outer = root_down(held[:, b + 1]) if k > b + 1 else np.full(len(x), np.inf, np.float32)
    return Bounds(order[:, 0], root_up(held[:, 0]), near, lower, outer)


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, s: Bounds) -> np.ndarray:
    """Bring ``s`` up to date after the entries moved by ``moved``; returns the depth each
    row needed (0: kept by its bounds, z: compared z near entries, b + 1: compared all)."""
    n, b = s.near.shape
    with np.errstate(invalid="ignore"):
        s.upper = np.nextafter(s.upper + moved[s.own], np.float32(np.inf))
        s.lower = np.nextafter(s.lower - np.where(s.near >= 0, moved[s.near], np.float32(0)), np.float32(-np.inf))
        s.outer = np.nextafter(s.outer - moved.max(initial=0), np.float32(-np.inf))
    s.lower = np.minimum(np.minimum.accumulate(s.lower[:, ::-1], axis=1)[:, ::-1], s.outer[:, None])
    depth = np.zeros(n, np.int64)
    first = s.lower[:, 0] if b else s.outer
    open_ = np.flatnonzero(~(s.upper < first))
    if len(open_) == 0:
        return depth
    own = picked(x[open_], book, s.own[open_][:, None])[:, 0]
    s.upper[open_] = root_up(own)
    bounds = np.concatenate([s.lower[open_], s.outer[open_][:, None]], axis=1)
    clear = s.upper[open_][:, None] < bounds
    z = np.where(clear.any(axis=1), clear.argmax(axis=1), b + 1)
    depth[open_] = z
    lo = 1
    while lo <= b:  # rows by depth, so that a few deep rows do not widen the others' work
        hi = min(b, 2 * lo - 1)
        at = np.flatnonzero((z >= lo) & (z <= hi))
        if len(at):
            rows, depths = open_[at], z[at]
            near = s.near[rows, :hi]
            used = (np.arange(hi)[None, :] < depths[:, None]) & (near >= 0)
            top = np.iinfo(np.int64).max
            d = np.concatenate([own[at][:, None], np.where(used, picked(x[rows], book, near), top)], axis=1)
            index = np.concatenate([s.own[rows][:, None], near], axis=1)
            # compared entries by (distance, index); the rest stay where they are
            rank = np.where(d == top, len(book) + 1 + np.arange(hi + 1)[None, :], index)
            order = np.lexsort((rank, d), axis=1)
            d, index = np.take_along_axis(d, order, 1), np.take_along_axis(index, order, 1)
            low = np.where(d == top, s.lower[rows, :hi][:, np.r_[0, np.arange(hi)]], root_down(np.minimum(d, 1 << 62)))
            s.own[rows], s.upper[rows] = index[:, 0], root_up(d[:, 0])
            s.near[rows, :hi], s.lower[rows, :hi] = index[:, 1:], low[:, 1:]
        lo = hi + 1
    every = open_[z == b + 1]
    if len(every):
        full = closest(x[every], book, b)
        s.own[every], s.upper[every], s.near[every] = full.own, full.upper, full.near
        s.lower[every], s.outer[every] = full.lower, full.outer
    return depth


# --- passes over the table --------------------------------------------------------

def _fixed(col: pa.Array) -> np.ndarray:
    """Rows of a binary column of equal lengths as a byte matrix."""
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int32 if pa.types.is_binary(col.type) else np.int64)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]].reshape(len(col), -1)


def _binary(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m)
    offs = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offs), pa.py_buffer(m.reshape(-1))])


class Sums:
    """Per task: sums and counts of every entry and the depths needed, in one flat array
    (parts x entries x (count, components), then parts x depths)."""

    def __init__(self, parts: int, k: int, length: int, b: list[int]):
        self.cells, self.depths = np.zeros((parts, k, 1 + length), np.int64), np.zeros((parts, START + 2), np.int64)
        self.b = b

    def add(self, p: int, x: np.ndarray, own: np.ndarray, depth: np.ndarray) -> None:
        k = self.cells.shape[1]
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(k))
        held = np.bincount(own, minlength=k)
        rows = held > 0
        self.cells[p, :, 0] += held
        self.cells[p, rows, 1:] += np.add.reduceat(x[order].astype(np.int64), starts[rows], axis=0)
        depth = np.where(depth > self.b[p], START + 1, depth)
        self.depths[p] += np.bincount(depth, minlength=START + 2)

    def row(self) -> pa.RecordBatch:
        flat = np.concatenate([self.cells.ravel(), self.depths.ravel()])
        return arrow_batch(STATE, [None], [None], [None], [None], [flat])


def _first_pass(books: np.ndarray, length: int, store: str):
    """Vectors -> integers, bounds from all distances, sums."""
    def run(batches):
        sums = Sums(len(books), books.shape[1], length, [START] * len(books))
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                ints = _integers(part.column(2), length * len(books))
                states = []
                for p, book in enumerate(books):
                    x = ints[:, p * length:(p + 1) * length]
                    s = closest(x, book, START)
                    sums.add(p, x, s.own, np.full(len(x), START + 1))
                    states.append(s.pack())
                yield arrow_batch(STATE, part.column(0), part.column(1), _binary(ints.astype(store).view(np.uint8)),
                                  _binary(np.concatenate(states, axis=1)), pa.nulls(len(ints), STATE[4][1]))
        yield sums.row()
    return run


def _integers(col: pa.Array, width: int) -> np.ndarray:
    """floor(1024 x) of a list column, rows continued with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    values = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    lens = np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(col), width), np.int64)
    ints = np.clip(np.floor(values * 1024.0), -LIMIT, LIMIT).astype(np.int64)
    if (lens == width).all():
        return ints.reshape(len(col), width)
    starts = np.cumsum(lens) - lens
    row = np.repeat(np.arange(len(col)), lens)
    out[row, np.arange(len(ints)) - np.repeat(starts, lens)] = ints
    return out


def _next_pass(books: np.ndarray, moved: np.ndarray, length: int, store: str, b_in: list[int], b_out: list[int]):
    def run(batches):
        sums = Sums(len(books), books.shape[1], length, b_in)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                ints = _fixed(part.column(2)).view(store)
                raw, at, states = _fixed(part.column(3)), 0, []
                for p, book in enumerate(books):
                    x = ints[:, p * length:(p + 1) * length]
                    s = Bounds.unpack(raw[:, at:at + Bounds.width(b_in[p])], b_in[p])
                    at += Bounds.width(b_in[p])
                    depth = reassign(x, book, moved[p], s)
                    sums.add(p, x, s.own, depth)
                    s.shrink(b_out[p])
                    states.append(s.pack())
                yield arrow_batch(STATE, part.column(0), part.column(1), part.column(2),
                                  _binary(np.concatenate(states, axis=1)), pa.nulls(len(ints), STATE[4][1]))
        yield sums.row()
    return run


def _last_pass(books: np.ndarray, moved: np.ndarray, length: int, store: str, b_in: list[int]):
    """Final assignment: codes and exact errors."""
    schema = [("id", pa.int64()), ("grp", pa.int64()), ("code", pa.string()), ("error", pa.int64())]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                ints, raw, at = _fixed(part.column(2)).view(store), _fixed(part.column(3)), 0
                codes, error = np.zeros((len(ints), len(books)), np.int64), np.zeros(len(ints), np.int64)
                for p, book in enumerate(books):
                    x = ints[:, p * length:(p + 1) * length]
                    s = Bounds.unpack(raw[:, at:at + Bounds.width(b_in[p])], b_in[p])
                    at += Bounds.width(b_in[p])
                    reassign(x, book, moved[p], s)
                    codes[:, p] = s.own
                    error += picked(x, book, s.own[:, None])[:, 0]
                digits = 2 if books.shape[1] <= 256 else 4
                text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
                yield arrow_batch(schema, part.column(0), part.column(1), text, error)
    return run


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _totals(spark: SparkSession, folder: str, cells: int) -> np.ndarray:
    """Sum of the tasks' arrays: (position, total) for a fixed number of positions."""
    rows = (spark.read.schema(STATE_SQL).parquet(folder).filter("sums is not null").select(F.posexplode("sums").alias("pos", "v"))
            .groupBy("pos").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(cells, np.int64)
    for r in rows:
        out[r.pos] = r.v
    return out


def _seeds(kept: DataFrame, entries: int, length: int, parts: int) -> np.ndarray:
    """Codebooks (parts x entries x length) of the smallest ids: a top-n of ``entries`` rows."""
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    ints = _integers(pa.array([list(r.v) for r in rows], pa.list_(pa.float64())), length * parts)
    return np.stack([ints[:, p * length:(p + 1) * length] for p in range(parts)])


def _depths(seen: np.ndarray, now: list[int]) -> list[int]:
    """The smallest depth per part that all but ``SPARE`` of its rows needed."""
    out = []
    for p, b in enumerate(now):
        counts = seen[p][:b + 1].cumsum()
        enough = np.flatnonzero(counts >= (1 - SPARE) * max(1, seen[p].sum()))
        out.append(int(min(b, max(LEAST, enough[0] if len(enough) else b))))
    return out


def fit_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label",
              parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, grp, code, error) of every kept vector, final codebooks parts x entries x length)."""
    if not 1 <= entries <= 1 << 15:
        raise ValueError("entries must be between 1 and 32768")
    spark = vectors.sparkSession
    v = F.col("v")
    kept = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{group_col}`").cast("long").alias("grp"),
                           F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
            .filter(v.isNotNull() & F.forall(v, lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False)))))
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"),
                    F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("top")).first()
    if not size.n:
        return spark.createDataFrame([], "id long, grp long, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    length = max(1, -(-size.width // parts))
    store = "<i2" if (size.top or 0) * 1024 < 32000 else "<i4"
    books = _seeds(kept, entries, length, parts)
    k = books.shape[1]
    cells = parts * k * (1 + length)
    root = new_folder(spark, "vector-codes")
    folder, b = f"{root}/round-0", [START] * parts
    map_arrow(kept, _first_pass(books, length, store), STATE_SQL).write.parquet(folder)
    moved = np.zeros((parts, k), np.float32)
    for step in range(1, rounds + 1):
        total = _totals(spark, folder, cells + parts * (START + 2))
        sums = total[:cells].reshape(parts, k, 1 + length)
        held = sums[:, :, :1]
        fresh = np.where(held > 0, np.floor_divide(sums[:, :, 1:], np.maximum(held, 1)), books)
        d = (fresh - books).astype(np.float64)
        moved = np.nextafter((np.sqrt((d * d).sum(2)) * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))
        moved[(fresh == books).all(axis=2)] = 0
        books = fresh
        rows = spark.read.schema(STATE_SQL).parquet(folder).filter("ints is not null")
        if step == rounds:
            return map_arrow(rows, _last_pass(books, moved, length, store, b), "id long, grp long, code string, error long"), books
        b_out = b if step == 1 else _depths(total[cells:].reshape(parts, START + 2), b)
        following = f"{root}/round-{step}"
        map_arrow(rows, _next_pass(books, moved, length, store, b, b_out), STATE_SQL).write.parquet(following)
        _remove(spark, folder)
        folder, b = following, b_out
    rows = spark.read.schema(STATE_SQL).parquet(folder).filter("ints is not null")
    return map_arrow(rows, _last_pass(books, moved, length, store, b), "id long, grp long, code string, error long"), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_report(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label",
                parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept vector."""
    spark = vectors.sparkSession
    codes, books = fit_codes(vectors, id_col, vec_col, group_col, parts, entries, rounds)
    folder = f"{new_folder(spark, 'vector-codes')}/codes"
    codes.write.parquet(folder)  # read twice below
    codes = spark.read.schema("id long, grp long, code string, error long").parquet(folder)
    groups = codes.groupBy("grp").agg(F.sum("error").alias("label_error")).withColumnRenamed("grp", "g")
    return (codes.join(groups, F.col("grp").eqNullSafe(F.col("g")))
            .select(F.col("id").alias(id_col), "code", "error", "label_error",
                    F.lit(books_digest(books)).alias("codebooks_sha256")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
