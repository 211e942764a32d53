"""The registered queries: SQL twins where there are any, columns of the contracts."""

import pytest

from oracle_check import compare, duck
from threadlens.llm.queries import ORACLE, QUERIES

D = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_": "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op3_": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    "op4_": "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    "op5_": "doc_id long, held_out boolean, score double, predicted int",
    "op6_": "doc_id long, n_shingles long, component_id long, kept boolean",
    "op7_": "doc_id long, start long, n_tokens long, ids_crc32 long",
    "op8_": "doc_id long, n_words long, n_removed long, kept_sha256 string",
    "op9_": "doc_id long, held_out boolean, lang_pred string, score double",
    "op10_": "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int",
    "op12_": "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    "op13_": "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
    "op11_": "vec_id long, code string, error long, label_error long, codebooks_sha256 string",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, name):
    got = compare(spark, name, QUERIES[name], ORACLE[name], D, duck(D))
    assert got["match"] is True, got


@pytest.mark.parametrize("start", sorted(COLUMNS))
def test_columns_and_rows(spark, start):
    name = next(n for n in QUERIES if n.startswith(start))
    df = QUERIES[name](spark, D)
    kinds = dict(df.dtypes)
    for column in COLUMNS[start].split(", "):
        c, kind = column.split()
        assert kinds[c] == {"long": "bigint"}.get(kind, kind), c
    table = {"op11_": "embeddings", "op13_": "conversations"}.get(start, "documents")
    source = spark.read.parquet(f"{D}/{table}.parquet")
    assert df.count() == (source.select("conv_id").distinct() if start == "op13_" else source).count()
