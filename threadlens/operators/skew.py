"""Hot-key split for a lookup join (many fact rows per key, one dimension row
per key).

Keys whose fact frequency reaches ``hot_rows`` are few by construction (at most
facts / hot_rows of them); their dimension rows are broadcast (the count is
checked against ``max_hot`` first) and joined map-side, so the hot key never
lands in one reduce task. The remaining keys use an ordinary shuffle join that
has no hot key left. Above the bound the whole join is salted: fact rows spread
over ``SALTS`` sub-keys, dimension rows repeated for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
MAX_HOT = 1_000_000
SALTS = 32


def salted_join(facts: DataFrame, dim: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """Inner join with every key cut into ``salts`` sub-keys by the fact row's hash."""
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns, F.monotonically_increasing_id()), F.lit(salts)))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, [key, "_salt"]).drop("_salt")


def split_hot_join(facts: DataFrame, dim: DataFrame, key: str, freq: DataFrame | None = None,
                   hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT, n_facts: int | None = None) -> DataFrame:
    """Inner join ``facts`` and ``dim`` (unique on ``key``) on ``key``.
    ``freq`` (key, n) may be given when the fact frequencies are known already;
    otherwise they are a partial aggregate over ``facts``. With ``n_facts`` (their number)
    under ``hot_rows`` no key can be hot and nothing is counted."""
    if n_facts is not None and n_facts < hot_rows:
        return facts.join(dim, key)
    if freq is None:
        freq = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot_keys = freq.filter(F.col("n") >= hot_rows).select(key)
    n_hot = hot_keys.count()
    if n_hot == 0:
        return facts.join(dim, key)
    if n_hot > max_hot:
        return salted_join(facts, dim, key)
    hk = F.broadcast(hot_keys)
    hot_dim = dim.join(hk, key, "left_semi")
    hot_part = facts.join(hk, key, "left_semi").join(F.broadcast(hot_dim), key)
    cold_part = facts.join(hk, key, "left_anti").join(dim.join(hk, key, "left_anti"), key)
    return hot_part.unionByName(cold_part)
