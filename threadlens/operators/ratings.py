"""Parse judge responses, compare judge and human ratings.

Agreement per dimension is one aggregation of moments over the unpivoted
table (n, sums, squares, cross products): exact/adjacent agreement, MAE, bias,
means, Pearson correlation (0 when a side is constant) and quadratic weighted
kappa. With weights (i-j)^2/(K-1)^2 the expected disagreement of two
independent raters is (E[h^2] + E[j^2] - 2 E[h] E[j]) / (K-1)^2, so kappa needs
no confusion matrix: kappa = 1 - mean((h-j)^2) / (E[h^2] + E[j^2] - 2 E[h] E[j]);
with no expected disagreement it is 1 for identical ratings, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.rules import DIMENSION_DEFAULT, DIMENSIONS

FENCE_STEPS = [r"^```json\s*", r"^```\s*", r"\s*```$"]


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def parse_judge(df: DataFrame, raw_col: str = "raw_response", dims=DIMENSIONS,
                defaults=DIMENSION_DEFAULT) -> DataFrame:
    """J6 + J7: adds ``judge_<dim>`` (int, clamped to 0..2) and
    ``judge_rationale``.

    Order of attempts: code fence stripped; whole text as a JSON object; else
    the span from the first '{' to the last '}' as a JSON object; else one
    regex per dimension ('"dim": <digit>') with the first 200 characters as
    rationale. Values: numbers truncate toward zero, true/false -> 1/0,
    anything else -> the dimension's default."""
    c = _strip(F.coalesce(F.col(raw_col), F.lit("")))
    for pat in FENCE_STEPS:
        c = F.regexp_replace(c, pat, "")
    fields = ", ".join(f"`{d}` string" for d in list(dims) + ["rationale"])
    schema = f"struct<{fields}>"
    out = df.withColumn("_c", c).withColumn("_span", F.regexp_extract("_c", r"(?s)\{.*\}", 0))
    # strict JSON: the engine's default also takes single quotes
    strict = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}
    checked = f"struct<{fields}, _bad string>"

    def is_object(name):
        got = F.from_json(name, checked, strict)
        return F.coalesce(F.json_object_keys(name).isNotNull() & got["_bad"].isNull(), F.lit(False))

    whole_ok, span_ok = is_object("_c"), is_object("_span")
    out = (out.withColumn("_src", F.when(whole_ok, F.col("_c")).when(span_ok, F.col("_span")))
           .withColumn("_obj", F.from_json("_src", schema, {"allowSingleQuotes": "false"}))
           .withColumn("_keys", F.json_object_keys("_src")))
    cols = {}
    for d in dims:
        v = F.col("_obj")[d]
        low = F.lower(F.trim(v))
        num = F.when(low == "true", F.lit(1)).when(low == "false", F.lit(0)) \
            .otherwise(v.try_cast("double").try_cast("long"))
        from_obj = F.coalesce(num, F.lit(defaults[d]))
        rx = F.regexp_extract("_c", r'"' + d + r'"\s*:\s*(\d)', 1)
        from_rx = F.when(rx != "", rx.cast("int")).otherwise(F.lit(defaults[d]))
        val = F.when(F.col("_src").isNotNull(), from_obj).otherwise(from_rx)
        cols[f"judge_{d}"] = F.greatest(F.lit(0), F.least(F.lit(2), val)).cast("int")
    rat = F.col("_obj")["rationale"]
    rat = F.when(F.col("_src").isNull(), F.left("_c", F.lit(200))) \
        .when(F.array_contains("_keys", "rationale") & rat.isNull(), F.lit("None")) \
        .otherwise(_strip(F.coalesce(rat, F.lit(""))))
    cols["judge_rationale"] = rat
    return out.withColumns(cols).drop("_c", "_span", "_src", "_obj", "_keys")


def add_diffs(df: DataFrame, dims=DIMENSIONS) -> DataFrame:
    """diff_<dim> = judge_<dim> - <dim>."""
    return df.withColumns({f"diff_{d}": F.col(f"judge_{d}") - F.col(d) for d in dims})


def unpivot(df: DataFrame, id_col: str, dims=DIMENSIONS) -> DataFrame:
    """(row id, dimension, human, judge) via ``stack`` (no shuffle)."""
    pairs = ", ".join(f"'{d}', `{d}`, `judge_{d}`" for d in dims)
    return df.selectExpr(f"`{id_col}` AS row_id", f"stack({len(dims)}, {pairs}) AS (dimension, human, judge)")


def agreement(long: DataFrame) -> DataFrame:
    """J9 per dimension from (dimension, human, judge); empty input -> no rows."""
    h, j = F.col("human").cast("double"), F.col("judge").cast("double")
    d = j - h
    m = long.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n"), F.sum(h).alias("sh"), F.sum(j).alias("sj"), F.sum(h * h).alias("shh"),
        F.sum(j * j).alias("sjj"), F.sum(h * j).alias("shj"), F.sum(d * d).alias("sdd"),
        F.sum(F.abs(d)).alias("sad"), F.count_if(d == 0).alias("n_exact"), F.count_if(F.abs(d) <= 1).alias("n_adj"))
    n = F.col("n").cast("double")
    mh, mj = F.col("sh") / n, F.col("sj") / n
    var_h = F.col("shh") / n - mh * mh
    var_j = F.col("sjj") / n - mj * mj
    cov = F.col("shj") / n - mh * mj
    corr = F.when((var_h > 0) & (var_j > 0), cov / F.sqrt(var_h * var_j)).otherwise(F.lit(0.0))
    expected = F.col("shh") / n + F.col("sjj") / n - 2 * mh * mj
    kappa = F.when(expected > 0, F.lit(1.0) - (F.col("sdd") / n) / expected) \
        .otherwise(F.when(F.col("sdd") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return m.select(
        "dimension", "n",
        F.round(F.col("n_exact") / n, 6).alias("exact_agreement"),
        F.round(F.col("n_adj") / n, 6).alias("adjacent_agreement"),
        F.round(F.col("sad") / n, 6).alias("mae"),
        F.round(mj - mh, 6).alias("bias"),
        F.round(mh, 6).alias("human_mean"), F.round(mj, 6).alias("judge_mean"),
        F.round(corr, 6).alias("correlation"),
        F.round(kappa, 6).alias("quadratic_weighted_kappa"))


def confusion(long: DataFrame, levels=(0, 1, 2)) -> DataFrame:
    """All 3x3 cells per dimension (rows human, columns judge), zeros
    included: the dimension list comes from the data, cells from exploding the
    fixed levels (no cross join)."""
    counts = long.groupBy("dimension", "human", "judge").agg(F.count(F.lit(1)).alias("n"))
    lv = F.array(*[F.lit(x) for x in levels])
    spine = (long.select("dimension").distinct()
             .withColumn("human", F.explode(lv)).withColumn("judge", F.explode(lv)))
    return (spine.join(counts, ["dimension", "human", "judge"], "left")
            .select("dimension", "human", "judge", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def truncation_rows(df: DataFrame, notes_col: str = "notes") -> DataFrame:
    """Rows whose note mentions truncation (case-insensitive; null -> no)."""
    return df.filter(F.lower(F.coalesce(F.col(notes_col), F.lit(""))).contains("truncat"))


def divergent_rows(df: DataFrame, order_col: str, dim: str = "overall_quality", n: int | None = 8) -> DataFrame:
    """|judge - human| >= 1 on ``dim``; the first n by ``order_col``
    (a top-n report: a bounded heap per partition, then one small merge)."""
    rows = df.filter(F.abs(F.col(f"judge_{dim}") - F.col(dim)) >= 1)
    return rows.orderBy(order_col).limit(n) if n else rows
