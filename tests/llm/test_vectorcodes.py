import hashlib
import math

import numpy as np
import pytest

from threadlens.llm import vectorcodes as vc

D = "/root/testdata/sf0.001"


def brute(rows, parts=4, entries=256, rounds=4):
    """(id, code, error, label_error, digest) with plain integers and all distances."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    length = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    ints = [[math.floor(1024 * x) for x in v] + [0] * (length * parts - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, list(kept[r][1])))[:entries]
    x = np.array(ints, np.int64).reshape(len(kept), parts, length)
    books = np.stack([x[order, p] for p in range(parts)])
    near = lambda: [((x[:, p][:, None, :] - books[p][None]) ** 2).sum(2) for p in range(parts)]
    for _ in range(rounds):
        for p, d in enumerate(near()):
            own = d.argmin(1)
            for e in set(own.tolist()):
                books[p, e] = x[own == e, p].sum(0) // (own == e).sum()
    d = near()
    own = np.stack([m.argmin(1) for m in d], 1)
    error = sum(m.min(1) for m in d)
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    total = {}
    for (_, _, g), e in zip(kept, error):
        total[g] = total.get(g, 0) + int(e)
    return [(i, "".join(f"{c:02x}" for c in own[r]), int(error[r]), total[g], digest) for r, (i, _, g) in enumerate(kept)]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def rows_of(df):
    return [(r.vec_id, r.embedding, r.label) for r in df.collect()]


def test_query_against_brute_force(spark):
    table = spark.read.parquet(f"{D}/embeddings.parquet")
    got = vc.op11_vector_codes(spark, D)
    assert got.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"),
                          ("codebooks_sha256", "string")]
    same(got.collect(), brute(rows_of(table)))


def test_larger_table_few_entries(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").repartition(5)
    same(vc.code_report(table, entries=48, rounds=6).collect(), brute(rows_of(table), entries=48, rounds=6))


def odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 0.1], 1, "a"), (1, [0.5, -0.25, 0.1], 1, "b"), (2, None, 1, "c"), (3, [1.0, None], 2, "d"),
            (4, [nan, 1.0], 2, "e"), (5, [inf], None, "f"), (6, [], None, "g"), (7, [0.0] * 9, None, "h"),
            (None, [0.3] * 9, 3, "i"), (-8, [-0.001, 3.5, 1.0, 2.0, 100.0], 3, "j"), (1, [0.5, -0.5], 4, "k"),
            (9, [0.25] * 9, 1, "l"), (10, [-30.0] * 9, 1, "m")]
    rows += [(20 + i, [0.75, 0.125] * 4, 5, "copy") for i in range(40)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")


def test_odd_rows_and_clashing_names(spark):
    table = odd_rows(spark)
    for n in (1, 3, 256):
        same(vc.code_report(table, entries=n).collect(), brute(rows_of(table), entries=n))


def test_limit_of_integers(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e300, 5.0]), (3, [2000.0 * 1024, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as label")
    got = {r.vec_id: r for r in vc.code_report(df, entries=2).collect()}
    assert len(got) == 3 and got[1].error >= 0 and got[1].label_error == sum(r.error for r in got.values())


def test_empty_table(spark):
    table = odd_rows(spark)
    assert vc.code_report(table.limit(0)).collect() == []
    assert vc.code_report(table.filter("embedding is null")).collect() == []


@pytest.mark.parametrize("b", [1, 4, 24])
def test_bounds_hold_and_state_round_trips(b):
    """After any moves the state gives the entries of a full comparison, and every bound
    still bounds what it stands for."""
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (700, 5))
    book = x[:40].copy()
    s = vc.closest(x, book, b)
    skipped = 0
    for step in range(8):
        fresh = book + rng.integers(-6, 7, book.shape) * (rng.random(book.shape) < 0.3)
        moved = np.nextafter(np.sqrt(((fresh - book) ** 2).sum(1)).astype(np.float32) * np.float32(1 + 1e-6), np.float32(np.inf))
        book = fresh
        s = vc.Bounds.unpack(s.pack(), s.near.shape[1])
        skipped += (vc.reassign(x, book, moved, s) == 0).sum()
        d = vc.distances(x, book)
        assert (s.own == d.argmin(1)).all()
        r = np.sqrt(d)
        assert (s.upper >= r[np.arange(len(x)), s.own]).all()
        listed = np.zeros(d.shape, bool)
        listed[np.arange(len(x)), s.own] = True
        for z in range(s.near.shape[1]):
            assert (s.lower[:, z] <= r[np.arange(len(x)), s.near[:, z]]).all()
            listed[np.arange(len(x)), s.near[:, z]] = True
        assert (s.outer <= np.where(listed, np.inf, r).min(1)).all()
        if step == 5:
            s.shrink(max(1, b - 2))
    assert skipped > 0
    big = x * (1 << 18)
    assert (vc.distances(big, big[:9]) == vc.picked(big, big[:9], np.tile(np.arange(9), (len(big), 1)))).all()
