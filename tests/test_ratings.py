"""Judge responses (FIXTURES 3, judge), agreement cases and the
published agreement matrices (golden)."""

import pytest

from threadlens.functions.rules import DIMENSIONS
from threadlens.operators import ratings

FULL = '{"factual_grounding": 2, "helpfulness": 1, "relevance": 2, "unsupported_claims": 0, "overall_quality": 2, "rationale": "ok"}'
RESPONSES = [
    (1, FULL, (2, 1, 2, 0, 2), "ok"),
    (2, "```json\n" + FULL + "\n```", (2, 1, 2, 0, 2), "ok"),
    (3, '{"factual_grounding": 5, "helpfulness": -1, "relevance": 2, "unsupported_claims": 0, "overall_quality": 1}',
     (2, 0, 2, 0, 1), ""),
    (4, "Sure! " + FULL + " Done.", (2, 1, 2, 0, 2), "ok"),
    (5, '{"factual_grounding": 2, "helpfulness": 0, broken', (2, 0, 1, 0, 1), '{"factual_grounding": 2, "helpfulness": 0, broken'),
    (6, "", (1, 1, 1, 0, 1), ""),
    (7, '{"factual_grounding": "2", "helpfulness": "0", "relevance": "1", "unsupported_claims": "1", "overall_quality": "2"}',
     (2, 0, 1, 1, 2), ""),
    (8, '{"factual_grounding": 1.7, "helpfulness": 2, "relevance": 2, "unsupported_claims": 0, "overall_quality": 2, "rationale": null}',
     (1, 2, 2, 0, 2), "None"),
    (9, '{"helpfulness": 2}', (1, 2, 1, 0, 1), ""),
    (10, "[1, 2, 3]", (1, 1, 1, 0, 1), "[1, 2, 3]"),
]


def test_parse_judge(spark):
    df = spark.createDataFrame([(r[0], r[1]) for r in RESPONSES], "id int, raw_response string")
    got = {r.id: r for r in ratings.parse_judge(df).collect()}
    for rid, _, want, rationale in RESPONSES:
        g = got[rid]
        assert tuple(g[f"judge_{d}"] for d in DIMENSIONS) == want, rid
        assert g.judge_rationale == rationale, rid


def _long(spark, pairs, dim="overall_quality"):
    return spark.createDataFrame([(i, dim, h, j) for i, (h, j) in enumerate(pairs)],
                                 "row_id int, dimension string, human int, judge int")


def test_agreement_cases(spark):
    same = ratings.agreement(_long(spark, [(0, 0), (1, 1), (2, 2)])).first()
    assert same.exact_agreement == 1.0 and same.quadratic_weighted_kappa == 1.0 and same.correlation == 1.0
    off = ratings.agreement(_long(spark, [(0, 1), (1, 2), (2, 1)])).first()
    assert off.exact_agreement == 0.0 and off.adjacent_agreement == 1.0 and off.mae == 1.0
    const = ratings.agreement(_long(spark, [(1, 0), (1, 1), (1, 2)])).first()
    assert const.correlation == 0.0
    both = ratings.agreement(_long(spark, [(2, 2), (2, 2)])).first()
    assert both.quadratic_weighted_kappa == 1.0 and both.correlation == 0.0


def test_agreement_empty(spark):
    empty = spark.createDataFrame([], "row_id int, dimension string, human int, judge int")
    assert ratings.agreement(empty).count() == 0


# The five published confusion matrices (rows human 0-2, columns judge 0-2)
# and the published metrics they produced.
MATRICES = {
    "factual_grounding": [[0, 0, 0], [1, 1, 8], [0, 3, 17]],
    "helpfulness": [[3, 0, 0], [1, 8, 4], [0, 7, 7]],
    "relevance": [[0, 0, 0], [0, 2, 9], [0, 0, 19]],
    "unsupported_claims": [[15, 0, 0], [9, 2, 0], [3, 0, 1]],
    "overall_quality": [[3, 0, 0], [2, 8, 4], [0, 6, 7]],
}
PUBLISHED = {  # exact, adjacent, mae, bias, qwk, corr, human mean, judge mean (2 dp)
    "factual_grounding": (0.600, 1.000, 0.40, 0.13, 0.14, 0.15, 1.67, 1.80),
    "helpfulness": (0.600, 1.000, 0.40, -0.13, 0.55, 0.56, 1.37, 1.23),
    "relevance": (0.700, 1.000, 0.30, 0.30, 0.22, 0.35, 1.63, 1.93),
    "unsupported_claims": (0.600, 0.900, 0.50, -0.50, 0.25, 0.38, 0.63, 0.13),
    "overall_quality": (0.600, 1.000, 0.40, -0.13, 0.57, 0.58, 1.33, 1.20),
}


def test_published_matrices(spark):
    rows, rid = [], 0
    for dim, m in MATRICES.items():
        for h in range(3):
            for j in range(3):
                for _ in range(m[h][j]):
                    rows.append((rid, dim, h, j))
                    rid += 1
    long = spark.createDataFrame(rows, "row_id int, dimension string, human int, judge int")
    got = {r.dimension: r for r in ratings.agreement(long).collect()}
    for dim, want in PUBLISHED.items():
        g = got[dim]
        vals = (g.exact_agreement, g.adjacent_agreement, g.mae, g.bias, g.quadratic_weighted_kappa, g.correlation,
                g.human_mean, g.judge_mean)
        for a, b in zip(vals, want):
            assert round(a, 2) == pytest.approx(b, abs=1e-9), (dim, vals, want)
    cm = {(r.dimension, r.human, r.judge): r.n for r in ratings.confusion(long).collect()}
    for dim, m in MATRICES.items():
        assert [[cm[(dim, h, j)] for j in range(3)] for h in range(3)] == m


def test_diffs_truncation_divergence(spark):
    df = spark.createDataFrame([(1, 2, 1, "Truncated mid-sentence"), (2, 1, 1, None), (3, 0, 2, "fine")],
                               "id int, overall_quality int, judge_overall_quality int, notes string")
    d = ratings.add_diffs(df, ["overall_quality"])
    assert [r.diff_overall_quality for r in d.orderBy("id").collect()] == [-1, 0, 2]
    assert [r.id for r in ratings.truncation_rows(d).collect()] == [1]
    assert [r.id for r in ratings.divergent_rows(d, "id").collect()] == [1, 3]


def test_single_quoted_objects_are_no_json(spark):
    raw = "{'helpfulness': 2, 'relevance': 0, 'factual_grounding': 2}"
    r = ratings.parse_judge(spark.createDataFrame([(raw,)], "raw_response string")).first()
    assert (r.judge_helpfulness, r.judge_relevance, r.judge_factual_grounding) == (1, 1, 1)
    assert r.judge_rationale == raw
