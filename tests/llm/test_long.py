"""One text of 60,000 words among short ones, through every operator that reads texts: none of it is cut off."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, language_id, language_model, quality_rules, simhash, source_mixing, token_file, toxicity
from tests.llm.conftest import frame, sentence
from tests.llm.test_copies import plain_print, whole_ids
from tests.llm.test_filters import plain_counts

WORDS = 60_000


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    rng = random.Random(77)
    item = " ".join(f"rare{k} thing" for k in range(8))
    parts = [sentence(rng, "en", 20) for _ in range(WORDS // 20)]
    text = "\n".join(parts) + "\n" + item + " " + " ".join(["the end of it all is near now"] * 3)
    rows = [(1, text, "en", "s"), (2, text, "en", "t")] + [(i, sentence(rng, lang, 30), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 20, 10)]
    path = str(tmp_path_factory.mktemp("long") / "d.parquet")
    frame(spark, rows).coalesce(1).write.parquet(path)
    return spark.read.parquet(path), rows, item


def test_token_ids(long):
    docs, rows, _ = long
    got = {r["doc_id"]: r for r in token_file.token_table(docs).collect()}
    for (i, *_), ids in zip(rows, whole_ids([r[1] for r in rows]), strict=True):
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_copies_and_leaks(spark, long):
    docs, rows, item = long
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == f"{plain_print(rows[0][1]):016x}" and got[2]["component_id"] == 1
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontamination.contaminated(docs, bench).collect()) == [1, 2]


def test_counts_and_sizes(long):
    docs, rows, _ = long
    n = len(rows[0][1].split())
    kept = {r["doc_id"]: r for r in quality_rules.judge_quality(docs).collect()}
    assert tuple(kept[1][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_counts(rows[0][1])
    assert {r["doc_id"]: r["size"] for r in source_mixing.mix(docs).collect()}[2] == n
    scored = {r["doc_id"]: r for r in language_model.score_documents(docs).collect()}
    assert scored[1]["n_tokens"] == n + 1 and scored[1]["score"] < 0


def test_models(spark, long):
    docs, rows, _ = long
    model = language_id.fit_languages(docs, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(docs, model, F.lit(False)).collect()}
    assert got[1] == "en" and sum(got[r[0]] == r[2] for r in rows) > 0.9 * len(rows)
    weights = toxicity.Weights(np.sort(toxicity.features(["rare7"], toxicity.Words())[0][:1]), np.array([9.0]), -3.0)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, weights, F.lit(False)).collect()}
    assert scores[1] == pytest.approx(1 / (1 + np.exp(-6.0))) and scores[10] == pytest.approx(1 / (1 + np.exp(3.0)))
