"""MinHash near-dedup (operator 6): circulant MinHash, banding, exact Jaccard.

Signature: the shingle hashes x are permuted once (sigma); coordinate k is the
minimum of pi(sigma(x) + k * shift) over the set, so one second permutation pi,
shifted circularly on the ring of 64-bit integers, gives every coordinate. 24 bands
of 5 rows: a pair at similarity 0.85 misses all of them with probability 8e-7.

Job:
1. One pass makes a narrow row per document: set size, 128-bit set digest, band keys.
   Equal sets are one class from here on (partial aggregate on the digest), so a
   text copied a million times is one class.
2. Classes that share a bucket, directly or through others, are a candidate group (labels
   over one link per class and bucket, to the bucket's least class).
3. The members' texts are sent once into units of at most ``BLOCK`` members: small groups
   share units, a large group is cut into blocks by hash, and its leader (the class
   with the largest buckets, which a group's original tends to be) joins every block. A
   task makes the full sets of its unit, counts the intersections of all pairs of one
   group at once (shingle postings, or a product of the incidence matrix) and
   returns a forest of the confirmed links: fewer rows than members, never a pair list.
4. In a large group the members that are not in its largest component by now ("open") meet
   all its members, block by block, in units that compare across two blocks and skip
   pairs that are linked already. After that every pair of the group has been confirmed,
   refuted or linked by others. None is cut; a group of n members of which o stay open
   costs o * n comparisons in (o / BLOCK) * (n / BLOCK) units.
5. Components by min-label propagation with pointer jumping over the forests, to the end.

Hot groups: counts, sizes and leaders are partial aggregates; blocks are cut by hash, so no
task holds more than two of them. Every step ends in a checkpoint, every round of labels in
a written table (both in ``spark.checkpoint.dir``).

Defined results: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null or empty
text, or text without words, has an empty set, links with nothing and is its own
component; with fewer than three words the whole sequence is the one shingle;
repeated rows of one id are one document here (the report keeps a row for each); a
null id is a document that is kept and never linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, held, ship_package
from .common import NON_SPACE, U64, documents, find_words, hash_words, int_column, map_arrow, mix, per_group, sealed, text_column, text_parts

SHINGLE = 3
BANDS = 24
ROWS = 5
PERCENT = 85
BLOCK = 512                # members of a unit
BLOCK_SHINGLES = 600_000   # shingles of a unit, about
TASK_ROWS = 50_000         # links or labels of a task in a round of labels
_SHIFT = 0xA24BAED4963EE407
_SIGMA = U64(0x8EBC6AF09C88C6E3)
_PI = U64(0x589965CC75374CC3)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets): the distinct shingle hashes of every row, sorted per row."""
    s, e, word_offs = find_words(raw, offs, NON_SPACE)
    h = hash_words(raw, s, e, lower=True)
    n_words = np.diff(word_offs)
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    rows = np.repeat(np.arange(len(n_words)), n_shingles)
    first = np.repeat(word_offs[:-1] - (np.cumsum(n_shingles) - n_shingles), n_shingles) + np.arange(len(rows))
    length = np.minimum(n_words, size)[rows]
    out = length.astype(U64) * U64(0xFF51AFD7ED558CCD)
    for j in range(size):
        part = h[np.minimum(first + j, max(len(h) - 1, 0))] * U64(pow(0xC4CEB9FE1A85EC53, j + 1, 1 << 64))
        out = out + np.where(j < length, part, U64(0))
    out = mix(out)
    order = np.lexsort((out, rows))
    out, rows = out[order], rows[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    out, rows = out[new], rows[new]
    return out, np.searchsorted(rows, np.arange(len(n_words) + 1))


def circulant_signatures(hashes: np.ndarray, set_offs: np.ndarray, n: int) -> np.ndarray:
    """n x rows matrix of minima (rows with an empty set hold 0)."""
    rows = np.flatnonzero(np.diff(set_offs))
    out = np.zeros((n, len(set_offs) - 1), dtype=U64)
    if not len(rows):
        return out
    starts = set_offs[rows]
    moved = mix(hashes ^ _SIGMA)
    for k in range(n):
        out[k, rows] = np.minimum.reduceat(mix((moved + U64(k * _SHIFT % (1 << 64))) ^ _PI), starts)
    return out


_SIGNED = "doc_id long, th long, n_shingles long, d1 long, d2 long, bands array<long>"


def signed_sets(docs: DataFrame, bands: int, rows: int, shingle: int) -> DataFrame:
    """Narrow rows: set size, set digest, and one key per band (the band is part of it)."""
    names = ["doc_id", "th", "n_shingles", "d1", "d2", "bands"]

    def run(batches):
        for batch in batches:
            ids, th = int_column(batch, "doc_id"), int_column(batch, "th")
            for lo, hi, raw, offs in text_parts(text_column(batch), 1_000_000):
                h, at = shingle_sets(raw, offs, shingle)
                sig = circulant_signatures(h, at, bands * rows).reshape(bands, rows, hi - lo)
                keys = np.repeat(np.arange(bands, dtype=U64)[:, None], hi - lo, axis=1)
                for r in range(rows):
                    keys = mix(keys * U64(0x9FB21C651E98DF25) + sig[:, r, :])
                sums = [np.concatenate([[U64(0)], np.cumsum(mix(h ^ U64(c)))]) for c in (0x1234567, 0x89ABCDEF)]
                digest = [(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums]
                flat = np.ascontiguousarray(keys.T).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), th.slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), *map(pa.array, digest),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands), pa.int32()), pa.array(flat))], names=names)

    return map_arrow(docs.select("doc_id", "text", "th"), run, _SIGNED)


def _merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Shuffled join. The loops below run many small joins; as broadcasts each would
    leave its table on the driver, which many rounds then add up."""
    return left.join(right.hint("merge"), on, how)


def _counts(h: np.ndarray, rows: np.ndarray, m: int, left: np.ndarray | None) -> np.ndarray:
    """Intersection sizes (m x m) of sets given as (element, row); with ``left`` (mask of the
    first block's rows) only across the two blocks. Elements of one row are skipped."""
    _, inv, df = np.unique(h, return_inverse=True, return_counts=True)
    keep = df[inv] > 1
    inv, rows = inv[keep], rows[keep]
    if not len(rows):
        return np.zeros((m, m), np.float32)
    order = np.argsort(inv, kind="stable")
    inv, rows = inv[order], rows[order]
    start = np.flatnonzero(np.r_[True, inv[1:] != inv[:-1]])
    size = np.diff(np.r_[start, len(inv)])
    if (size * size).sum() <= 4_000_000:
        # few common elements: all pairs of each posting list
        each = np.repeat(size, size)
        first = np.repeat(np.arange(len(rows)), each)
        second = np.repeat(np.repeat(start, size), each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        return np.bincount(rows[first] * m + rows[second], minlength=m * m).reshape(m, m)
    out = np.zeros((m, m), np.float32)
    column = np.repeat(np.arange(len(start)), size)
    for lo in range(0, len(start), 4096):
        at = slice(*np.searchsorted(column, [lo, lo + 4096]))
        part = np.zeros((m, 4096), np.float32)
        part[rows[at], column[at] - lo] = 1
        if left is None:
            out += part @ part.T
        else:
            out[np.ix_(left, ~left)] += part[left] @ part[~left].T
    return out


def forest(ids: np.ndarray, groups: np.ndarray, labels: np.ndarray, texts: pa.Array, percent: int, shingle: int,
           left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that join what the confirmed pairs of one unit join: pairs of one group
    with 100 * intersection >= percent * union on the full sets, of different labels,
    and, with ``left``, of different blocks."""
    hashes, sizes = [], []
    for _, _, raw, offs in text_parts(texts, 1_000_000):
        h, at = shingle_sets(raw, offs, shingle)
        hashes.append(h)
        sizes.append(np.diff(at))
    size = np.concatenate(sizes)
    rows = np.repeat(np.arange(len(ids)), size)
    seed = mix(np.unique(groups, return_inverse=True)[1].astype(U64) + U64(1))
    inter = _counts(mix(np.concatenate(hashes) ^ seed[rows]), rows, len(ids), left)
    fits = (100 * inter >= percent * (size[:, None] + size[None, :] - inter)) & (inter > 0)
    fits &= (labels[:, None] != labels[None, :]) & (groups[:, None] == groups[None, :])
    if left is not None:
        fits &= left[:, None] & ~left[None, :]
    root = {int(x): int(x) for x in labels}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(fits)):
        a, b = find(int(labels[i])), find(int(labels[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def confirm(units: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(a, b): the forests of all units; ``units`` has (unit, side, cid, grp, label, text), one
    row per member and side; side 0 meets side 1, and sides of -1 meet each other."""
    ship_package(units.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        cid, side = table["cid"].to_numpy(), table["side"].to_numpy()
        links: list[tuple[int, int]] = []
        order = np.lexsort((cid, side))
        order = order[np.r_[True, (cid[order][1:] != cid[order][:-1]) | (side[order][1:] != side[order][:-1])]]
        if len(order) > 1:
            texts = text_column(table).take(pa.array(order))
            left = side[order] == 0 if (side >= 0).any() else None
            links = forest(cid[order], table["grp"].to_numpy()[order], table["label"].to_numpy()[order], texts, percent, shingle, left)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return units.groupBy("unit").applyInArrow(per_group(run), "a long, b long")


def _tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for a join of ``rows`` narrow rows; beyond the cores they grow with the rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _spread(label: DataFrame, both: DataFrame, tasks: int) -> DataFrame:
    """One step of min-label propagation over the links (a, b both ways), and a pointer
    jump. A label is a struct (rank, id of the root); ``moved`` says that it fell. Each
    join ends in at most ``tasks`` tasks, however many partitions an exchange has."""
    near = _merge(both, label.select("id", "root"), both.b == label.id).select("a", "root").coalesce(tasks)
    near = near.groupBy("a").agg(F.min("root").alias("m"))
    hooked = _merge(label.select("id", "root"), near, label.id == near.a, "left") \
        .select("id", "root", F.least("root", "m").alias("to")).coalesce(tasks)
    jump = label.select(F.col("id").alias("to_id"), F.col("root").alias("next"))
    return _merge(hooked, jump, F.col("to.id") == F.col("to_id"), "left").select(
        "id", F.least("to", "next").alias("root"), (F.least("to", "next") != F.col("root")).alias("moved")).coalesce(tasks)


def components(links: DataFrame, label: DataFrame) -> DataFrame:
    """Final (id, comp): the smallest id reachable over ``links`` (a, b), starting from
    labels that are already reachable. Runs until a round moves nothing. A round takes as many
    tasks as its rows need: on small graphs its cost is that of starting them."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = held(links.select(F.explode(ways).alias("l")).select("l.a", "l.b"))
    tasks = _tasks(links.sparkSession, max(both.count(), label.count()))
    while True:
        label = held(_spread(label, both, tasks))
        if not label.filter("moved").head(1):
            break
    least = label.groupBy(F.col("root.id").alias("top")).agg(F.min("id").alias("comp"))
    return _merge(label, least, F.col("root.id") == F.col("top")).select("id", "comp")


def _blocks(count, shingles):
    return F.greatest(F.ceil(count / F.lit(BLOCK)), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("long")


def _crossed(members: DataFrame, links: DataFrame) -> DataFrame | None:
    """Units in which the open members of large groups meet all members of their group."""
    large = members.filter("blocks > 1")
    own = large.select(F.col("cid").alias("id"), F.struct(F.lit(0).cast("long").alias("rank"), F.col("cid").alias("id")).alias("root"))
    inside = _merge(links, large.select(F.col("cid").alias("a")), "a", "left_semi").select("a", "b")
    label = components(inside, own) if inside.head(1) else own.select("id", F.col("id").alias("comp"))
    named = cut_lineage(_merge(large, label.select(F.col("id").alias("cid"), F.col("comp").alias("now")), "cid"))
    parts = named.groupBy("grp", "now").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    groups = parts.groupBy("grp").agg(F.max_by("now", F.struct("n", "now")).alias("main"), F.max("n").alias("n_main"),
                                      F.sum("n").alias("n"), F.sum("s").alias("s"))
    open_ = _blocks(F.col("n") - F.col("n_main"), F.col("s") * (F.col("n") - F.col("n_main")) / F.col("n"))
    groups = cut_lineage(groups.withColumn("open_blocks", open_).filter("n > n_main").select("grp", "main", "open_blocks"))
    if not groups.head(1):
        return None
    rows = _merge(named.withColumn("label", F.col("now")), groups, "grp")
    place = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("open_blocks"))
    last = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    others = F.sequence(F.lit(0).cast("long"), F.col("open_blocks") - 1)
    unit = lambda x, y: F.concat_ws("-", F.lit("x"), F.col("grp"), x, y)
    near = rows.filter("now <> main").withColumn("_o", place).withColumn("_b", F.explode(last)).withColumn("side", F.lit(0))
    far = rows.withColumn("_b", F.col("blk")).withColumn("_o", F.explode(others)).withColumn("side", F.lit(1))
    return near.unionByName(far).select(unit(F.col("_o"), F.col("_b")).alias("unit"), "side", "cid", "grp", "label", "text")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    signed = cut_lineage(signed_sets(docs, bands, rows, shingle))
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    same_set = ["n_shingles", "d1", "d2"]
    classes = cut_lineage(full.groupBy(*same_set).agg(F.min(F.struct("doc_id", "th", "bands")).alias("m"))
                          .select(*same_set, "m.doc_id", "m.th", "m.bands", F.monotonically_increasing_id().alias("cid")))
    keys = classes.select("cid", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("lead")).filter("n > 1")
    found = cut_lineage(_merge(keys, shared, "key").select("cid", "lead", "n"))
    weight = cut_lineage(found.groupBy("cid").agg(F.sum("n").alias("w")))
    plain = _merge(signed, classes.select(*same_set, "cid", F.col("doc_id").alias("least")), same_set, "left").select(
        "doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("cid")).alias("cid"), "least")
    alone = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    if not weight.head(1):
        return plain.select("doc_id", "n_shingles", alone.alias("component_id"))
    # candidate groups: a class with larger buckets has the smaller label
    start = weight.select(F.col("cid").alias("id"), F.struct((-F.col("w")).alias("rank"), F.col("cid").alias("id")).alias("root"))
    groups = components(found.filter("cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b")).distinct(), start)
    narrow = _merge(_merge(groups.select(F.col("id").alias("cid"), F.col("comp").alias("grp")), weight, "cid"),
                    classes.select("cid", "n_shingles", "doc_id", "th"), "cid")
    narrow = cut_lineage(narrow)
    of_group = narrow.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"),
                                         F.max(F.struct("w", "cid"))["cid"].alias("leader"))
    sized = _merge(narrow, of_group, "grp").withColumn("blocks", _blocks(F.col("m"), F.col("s")))
    # one row with the text of each class: that of its least document
    texts = docs.withColumn("_s", F.lit(1)).dropDuplicates(["doc_id", "th"])
    members = cut_lineage(_merge(sized, texts, ["doc_id", "th"]).select(
        "cid", "grp", "blocks", "n_shingles", "leader", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("blk"), "text"))
    total = members.agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s")).first()
    units = max(1, -(-2 * total.n // BLOCK), -(-2 * int(total.s) // BLOCK_SHINGLES))
    unit = F.when(F.col("blocks") == 1, F.concat(F.lit("s-"), F.pmod(F.xxhash64("grp"), F.lit(units)))) \
        .otherwise(F.concat_ws("-", F.lit("m"), F.col("grp"), F.col("blk")))
    here = members.select(unit.alias("unit"), F.lit(-1).alias("side"), "cid", "grp", F.col("cid").alias("label"), "text")
    heads = members.filter("blocks > 1 and cid = leader").withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .select(unit.alias("unit"), F.lit(-1).alias("side"), "cid", "grp", F.col("cid").alias("label"), "text")
    links = cut_lineage(confirm(here.unionByName(heads), percent, shingle))
    if members.filter("blocks > 1").head(1):
        crossed = _crossed(members, links)
        if crossed is not None:
            links = links.unionByName(cut_lineage(confirm(crossed, percent, shingle)))
    if not links.head(1):
        return plain.select("doc_id", "n_shingles", alone.alias("component_id"))
    comp = cut_lineage(components(links, start).select(F.col("id").alias("cid"), "comp"))
    least = _merge(comp, classes.select("cid", "doc_id"), "cid").groupBy("comp").agg(F.min("doc_id").alias("first"))
    by_class = _merge(comp, least, "comp").select("cid", "first")
    return _merge(plain, by_class, "cid", "left").select("doc_id", "n_shingles", F.coalesce("first", alone).alias("component_id"))


def component_report(docs: DataFrame, **kw) -> DataFrame:
    return near_duplicates(docs, **kw).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one document of each component (the smallest id; of repeated
    rows of one id all are dropped or all kept)."""
    docs, restore = sealed(docs)
    gone = near_duplicates(docs, **kw).filter("component_id <> doc_id").select(F.col("doc_id").alias("_mh_id")).distinct()
    return restore(docs.join(gone, docs.doc_id == F.col("_mh_id"), "left_anti"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_report(documents(spark, sf_dir))
