"""The registered queries: contracted columns and a row for every row of their tables; those with SQL against it."""

import os

import duckdb
import pytest

import __spark_entry__
from sparkloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1_url_filters": ("pages", "page_id bigint, host string, path string, rule string, verdict string"),
    "op2_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op3_token_ids": ("documents", "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"),
    "op4_lm_scoring": ("documents", "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"),
    "op5_mixing": ("documents", "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"),
    "op6_warc": ("pages", "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"),
    "op7_language_id": ("documents", "doc_id bigint, held_out boolean, lang_pred string, score double"),
    "op9_simhash": ("documents", "doc_id bigint, fingerprint string, component_id bigint"),
    "op10_quality_rules": ("documents", "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"),
}


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.queries()) | {"pipeline"} <= names and len(queries.queries()) == 10
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    source, columns = COLUMNS[name]
    df = queries.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    for column in columns.split(", "):
        c, kind = column.split()
        assert kinds[c] == kind
    key = df.columns[0] if name in ("op1_url_filters", "op6_warc") else "doc_id"
    ids = sorted(r[0] for r in df.select(key).collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect())


def test_contaminated_documents_only(spark):
    """By a plain search: documents that hold an item's words in a row are among them."""
    from sparkloom.llm.common import plain_words

    got = {r["doc_id"] for r in queries.op8_decontamination(spark, SF).collect()}
    items = [b" ".join(plain_words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if any(b" " + i + b" " in b" " + b" ".join(plain_words(r["text"])) + b" " for i in items)}
    assert exact and exact <= got and len(got) <= len(exact) + 2


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("pages", "documents"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    df = queries.queries()[name](spark, SF)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(cur.fetchall(), key=key)
