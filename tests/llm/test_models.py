"""Language ID, toxicity and the language model: contracts, held-out accuracy, and exact parts against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language_id, language_model, toxicity
from sparkloom.llm.common import crc_mod
from tests.llm.conftest import frame, sentence

BAD = ["scoundrel", "wretchling", "blackguardy"]


def crc(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    rng = random.Random(9)
    rows, toxic = [], {}
    for i in range(900):
        lang = ("en", "de", "fr")[i % 3]
        words = sentence(rng, lang, rng.randint(12, 60)).split()
        toxic[i] = int(rng.random() < 0.3)
        if toxic[i]:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ing"]))
        rows.append((i, " ".join(words), lang, "s"))
    path = str(tmp_path_factory.mktemp("many") / "d.parquet")
    frame(spark, rows).repartition(4).write.parquet(path)
    return spark.read.parquet(path), rows, toxic


def test_crc(spark):
    ids = [0, 1, -5, 123456789012, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", crc_mod(F.col("doc_id"), 7).alias("m")).collect()
    assert [(r["doc_id"], r["m"]) for r in got] == [(i, crc(i, 7)) for i in ids]


def test_language_id(many):
    docs, rows, _ = many
    model = language_id.fit_languages(docs, ~language_id.held_out())
    got = {r["doc_id"]: r for r in language_id.identify_languages(docs, model, language_id.held_out()).collect()}
    held = [r for r in rows if crc(r[0], 5) == 0]
    assert all(got[i]["held_out"] == (crc(i, 5) == 0) for i, *_ in rows) and len(held) > 100
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang, _ in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and np.mean([r["rejected"] for r in got.values()]) < 0.02
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["rejected"] for r in got.values())


def test_every_language_is_learned(spark):
    """More labels than fit a folded table, some of them with one row."""
    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(6)] for k in range(230)}
    rows = [(x, n) for k, x in enumerate(words) for n in range(1 if k % 10 == 0 else 40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[x]) for _ in range(40)), x) for i, (x, _) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.fit_languages(docs, F.lit(True), train_docs=1200)
    assert model.langs == sorted(words) and model.table.shape == (language_id.BUCKETS + 1, language_id.DIM)
    texts = [" ".join(w * 5) for w in words.values()]
    langs, _, _ = language_id.predict_texts(model, texts)
    common = [k for k in range(230) if k % 10]
    assert sum(langs[k] == f"l{k:03}" for k in common) >= 0.95 * len(common)


def test_language_id_odd(spark, many, docs, rows, empty):
    model = language_id.fit_languages(many[0], F.lit(True))
    got = language_id.identify_languages(docs, model, language_id.held_out()).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    none = {i for i, t, _, _ in rows if not language_id.has_letter(t)}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == none - {None} | {None}
    assert all(r["score"] == 0 and r["rejected"] for r in got if r["lang_pred"] == "und")
    assert language_id.identify_languages(empty, model).collect() == [] and language_id.fit_languages(empty, F.lit(True)) is None
    blind = language_id.identify_languages(docs, None).collect()
    assert {r["lang_pred"] for r in blind} == {"und"} and language_id.keep_identified(empty, model).collect() == []
    one = language_id.fit_languages(docs.filter("doc_id = 0"), F.lit(True))
    assert one.langs == [rows[0][2]]


def test_language_table_is_the_model():
    """The folded table gives what averaging embeddings and the softmax give."""
    texts = ["the cat", "der Hund", None, "", "a"]
    rng = np.random.default_rng(1)
    e, w = rng.normal(size=(language_id.BUCKETS + 1, 4)), rng.normal(size=(4, 2))
    e[-1] = 0
    model = language_id.Model(["x", "y"], e @ w, np.array([0.1, 0.2]), 1.0, 0.0)
    for text, z in zip(texts, language_id.logits(model, texts), strict=True):
        runs, _ = language_id.buckets([text])
        ids = runs[runs != language_id.BUCKETS]
        v = e[ids].mean(axis=0) if len(ids) else np.zeros(4)
        assert np.allclose(z, v @ w + model.bias)


def plain_runs(text):
    """Buckets of a text by enumeration of its runs of 2, 3 and 4 bytes."""
    b = b" " + "".join(text or "").lower().encode() + b" "
    b = bytes(x if x >= 0x80 or chr(x).isalpha() else 0x20 for x in b)
    out = Counter()
    for size in (2, 3, 4):
        for i in range(len(b) - size + 1):
            run = b[i : i + size]
            if 0x20 not in run[1:-1] and run != b"  ":
                salted = int.from_bytes(run, "little") + (size - 1) * 0x51ED27
                out[(salted * 2654435761 & 0xFFFFFFFF) >> 16] += 1
    return out


def test_runs_by_enumeration():
    texts = ["the cat", None, "", "a", "\u00c9t\u00e9 na\u00efve, 12 x-y", "  ", "\u4e2d\u6587 abc"]
    runs, starts = language_id.buckets(texts)
    for text, a, z in zip(texts, starts, [*starts[1:], runs.shape[1]], strict=True):
        own = runs[:, a:z]
        assert Counter(own[own != language_id.BUCKETS].tolist()) == plain_runs(text)


@pytest.mark.parametrize("ids", ["shared", "null"])
def test_the_sample_of_languages_is_bounded(spark, monkeypatch, ids):
    """A third of the rows share an id, or a text; or all ids are null."""
    monkeypatch.setattr(language_id, "LEAST_EACH", 4)
    rows = [(None if ids == "null" or i % 3 == 0 else i, f"text {i} of many" if i % 7 else "one text again and again", ("en", "de", "fr")[i % 5 % 3]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.sample_texts(docs.repartition(3), F.lit(True), 90).collect()
    per = Counter(r["lang"] for r in sample)
    assert set(per) == {"en", "de", "fr"} and max(per.values()) <= 30 and min(per.values()) >= 25
    assert len({(r["lang"], r["text"]) for r in sample}) == len(sample)
    assert {tuple(r) for r in sample} == {tuple(r) for r in language_id.sample_texts(docs.repartition(7), F.lit(True), 90).collect()}


def labels_of(spark, toxic):
    return spark.createDataFrame([*((i, 1, t, "odd") for i, t in toxic.items()), (None, 1, 1, "odd"), (3, 0, None, "odd"), (5, 1, toxic[5], "odd")], "doc_id long, quality int, toxic int, score string")


def test_toxicity(spark, many):
    docs, rows, toxic = many
    held = toxicity.held_out()
    model = toxicity.fit_toxicity(docs, labels_of(spark, toxic), ~held)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model, held).collect()}
    assert len(got) == len(rows) and all(got[i]["held_out"] == (crc(i, 4) == 2) for i in got)
    out = [i for i in toxic if crc(i, 4) == 2]
    assert np.mean([got[i]["predicted"] == toxic[i] for i in out]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    assert len(model.ids) < 20_000


def test_toxicity_odd(spark, many, docs, rows, empty):
    train, _, toxic = many
    model = toxicity.fit_toxicity(train, labels_of(spark, toxic), F.lit(True))
    got = toxicity.score_toxicity(docs, model, toxicity.held_out()).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    blank = 1 / (1 + np.exp(-model.intercept))
    assert {round(r["score"], 9) for r in got if r["doc_id"] in (60, 61, 62)} == {round(blank, 9)}
    assert toxicity.score_toxicity(empty, model, F.lit(False)).collect() == []
    nothing = toxicity.fit_toxicity(docs, labels_of(spark, toxic).limit(0), F.lit(True))
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, nothing, F.lit(False)).collect()} == {0}
    sure = toxicity.fit_toxicity(docs, labels_of(spark, {**dict.fromkeys(toxic, 1)}).filter("toxic = 1"), F.lit(True))
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, sure, F.lit(False)).collect()} == {1}


def plain_ftrl(docs, y, passes):
    """FTRL-proximal a coordinate at a time."""
    n = Counter(f for d in docs for f in set(d))
    z, s = dict.fromkeys(n, 0.0), dict.fromkeys(n, 0.0)
    zb = sb = 0.0

    def weight(z, s, l1=toxicity.L1, l2=toxicity.L2):
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((toxicity.BETA + math.sqrt(s)) / toxicity.ALPHA + l2)

    for i in passes:
        own = [f for f in docs[i] if n[f] >= toxicity.LEAST_DOCS]
        w, b = {f: weight(z[f], s[f]) for f in own}, weight(zb, sb, 0.0, 0.0)
        g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y[i]
        for f in own:
            z[f] += g - (math.sqrt(s[f] + g * g) - math.sqrt(s[f])) / toxicity.ALPHA * w[f]
            s[f] += g * g
        zb += g - (math.sqrt(sb + g * g) - math.sqrt(sb)) / toxicity.ALPHA * b
        sb += g * g
    return {f: w for f in n if (w := weight(z[f], s[f]))}, weight(zb, sb, 0.0, 0.0)


def test_ftrl_and_score_against_plain_versions(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.3)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["bad", "worse", "fine", "good", "word", "other"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    y = np.array([float("bad" in t or rng.random() < 0.1) for t in texts])
    found = [np.unique(toxicity.features([t], toxicity.Words())[0]) for t in texts]
    model = toxicity.ftrl(found, y)
    order = np.random.default_rng(11)
    weights, bias = plain_ftrl([d.tolist() for d in found], y, [i for _ in range(toxicity.EPOCHS) for i in order.permutation(len(texts))])
    assert model.intercept == pytest.approx(bias) and dict(zip(model.ids.tolist(), model.values.tolist(), strict=True)) == pytest.approx(weights)
    assert len(weights) > 5
    again = [*texts, None, "", "unseen"]
    plain = [1 / (1 + math.exp(-bias - sum(weights.get(f, 0.0) for f in set(toxicity.features([t], toxicity.Words())[0].tolist())))) for t in again]
    assert model.score(again, toxicity.Words()) == pytest.approx(plain)


def test_the_sample_of_labels_is_bounded(spark, monkeypatch, many):
    """A hot id, and equal texts, don't make the fit read more rows than its bound."""
    docs, _, toxic = many
    seen = []
    monkeypatch.setattr(toxicity, "ftrl", lambda d, y, ftrl=toxicity.ftrl: (seen.append((len(d), max(map(len, d)))), ftrl(d, y))[1])
    hot = spark.createDataFrame([(5, f"bad words {i}") for i in range(2000)], "doc_id long, text string")
    toxicity.fit_toxicity(docs.select("doc_id", "text").unionByName(hot), labels_of(spark, toxic), F.lit(True), train_docs=50)
    monkeypatch.setattr(toxicity, "MOST_FEATURES", 16)
    toxicity.fit_toxicity(docs, labels_of(spark, toxic), F.lit(True), train_docs=50)
    assert seen[0][0] <= 100 and seen[1][0] <= 100 and seen[1][1] <= 16


def test_features():
    words = toxicity.Words(most=5)
    f, doc = toxicity.features(["a b c", None, "a b", ""], words)
    n = 1 + len(toxicity.STEMS)
    assert Counter(doc.tolist()) == {0: 3 * n + 2 + 1, 2: 2 * n + 1}
    one = {int(x) for x, d in zip(f, doc, strict=True) if d == 0}
    assert {int(x) for x, d in zip(f, doc, strict=True) if d == 2} < one
    again, _ = toxicity.features(["q r s t u v w", "a b c"], words)
    assert one <= set(again.tolist())


def plain_base(rows):
    counts = Counter()
    split = [((t or "").encode().lower().split() + [b" "], i) for i, t, _, _ in rows]
    for w, i in split:
        if crc(i, 7) != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return Counter((i, crc(i, 7) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for w, i in split), counts


@pytest.mark.parametrize("head", [1 << 20, 40])
def test_language_model_base(docs, rows, head, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", head)  # a small head leaves most words to the join
    monkeypatch.setattr(language_model, "VOCABULARY", 20)
    got = language_model.score_documents(docs).collect()
    expected, _ = plain_base(rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_language_model_learns(many):
    docs, _, _ = many
    got = language_model.score_documents(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_log10(model, counts, text):
    """A text's log10 probability, a token at a time, over all clusters and all units of a cluster."""
    u, dim = model.units, language_model.DIM
    n = len(u)
    r, b, s, a = model.table[:n, :dim], model.table[:n, dim], model.table[n : n + u.clusters, :dim], model.table[n : n + u.clusters, dim]
    c1, c2 = model.table[n + u.clusters :][:dim, :dim], model.table[n + u.clusters :][dim:, :dim]

    def unit(w):
        k = sum(x <= w for x in u.words[language_model.MEMBERS :: language_model.MEMBERS])
        own = u.words[k * language_model.MEMBERS : (k + 1) * language_model.MEMBERS]
        first = sum(min(language_model.MEMBERS, len(u.words) - j * language_model.MEMBERS) + 1 for j in range(k))
        return k, first, first + (own.index(w) if w in own else len(own)), w not in own, len(own) + 1

    total, one, two = 0.0, b" ", b" "
    for w in [*(text or "").encode().lower().split(), b" "]:
        q = r[unit(one)[2]] @ c1 + r[unit(two)[2]] @ c2
        k, first, i, other, size = unit(w)
        top, low = q @ s.T + a, q @ r[first : first + size].T + b[first : first + size]
        total += math.log10(np.exp(top[k]) / np.exp(top).sum() * np.exp(low[i - first]) / np.exp(low).sum())
        if other:
            rest = [c for x, c in counts.items() if unit(x)[2] == i]
            total += math.log10((counts.get(w, 0) + 1) / (sum(rest) + len(rest) + 1))
        one, two = w, one
    return total


def test_language_model_scores_texts(docs, rows, monkeypatch):
    """Scores of whole texts against a plain version, with clusters of few words; they don't depend on the table's layout."""
    for name, value in (("MEMBERS", 5), ("VOCABULARY", 23), ("LEAST", 2), ("HEAD", 2000), ("SHARD_TOKENS", 1500), ("PIECE", 7), ("BATCH", 64)):
        monkeypatch.setattr(language_model, name, value)
    held = language_model.held_out()
    counts = language_model.count_tokens(docs, ~held)
    model, _ = language_model.fit_model(docs, ~held, counts)
    known = {r["word"].encode(): r["n"] for r in counts.collect()}
    assert len(model.units.words) == 23 and model.units.clusters == 5 and b" " in model.units.words
    got = language_model.score_documents(docs).collect()
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r["n_tokens"] < 300 and texts[r["doc_id"]] is not None and sum(x["doc_id"] == r["doc_id"] for x in got) == 1:
            assert r["score"] == pytest.approx(plain_log10(model, known, texts[r["doc_id"]]), rel=1e-4)
    for n in (2, 5):
        again = language_model.score_documents(docs.repartition(n)).collect()
        key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"])
        for x, y in zip(sorted(again, key=key), sorted(got, key=key), strict=True):
            assert x["doc_id"] == y["doc_id"] and x["score"] == pytest.approx(y["score"], rel=1e-6, abs=1e-4)


def test_language_model_is_normalised(docs):
    counts = language_model.count_tokens(docs, F.lit(True))
    model, tail = language_model.fit_model(docs, F.lit(True), counts)
    scorer = language_model.Scorer(model)
    n = len(model.units)
    for one, two in ((0, 0), (1, 2), (n - 1, 0)):
        p = np.exp(scorer.unit_logs(np.arange(n), np.full(n, one), np.full(n, two)))
        assert p.sum() == pytest.approx(1, abs=1e-4)
    # a cluster's unit for others is shared out among its words outside the vocabulary and one for unseen ones
    rest = Counter({r["word"].encode(): r["n"] for r in counts.collect()})
    for w in model.units.words:
        del rest[w]
    whole = model.units.counts[model.units.others] + model.other_types + 1
    shares = 1 / whole
    for w, c in rest.items():
        k = model.units.cluster_of(w)
        shares[k] += (c + 1) / whole[k]
    assert np.allclose(shares, 1) and tail.columns == ["word", "n"]


def test_language_model_empty(empty, docs):
    assert language_model.score_documents(empty).collect() == []
    held = docs.filter(language_model.held_out())
    got = language_model.score_documents(held).collect()
    assert len(got) == held.count() and {r["train_tokens"] for r in got} == {0} and {r["score"] for r in got} == {0.0}
