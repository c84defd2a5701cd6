"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import language_id, toxicity
from sparkloom.llm.common import spread, table
from sparkloom.llm.decontamination import contaminated
from sparkloom.llm.language_model import score_documents
from sparkloom.llm.quality_rules import judge_quality
from sparkloom.llm.simhash import near_duplicates
from sparkloom.llm.source_mixing import mix
from sparkloom.llm.token_file import token_table
from sparkloom.llm.url_filter import judge_urls, rules_of
from sparkloom.llm.warc_bundle import bundle_pages


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spread(table(spark, sf_dir, "pages")), rules_of(spark))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spread(table(spark, sf_dir, "documents")), toxicity.held_out()
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score_toxicity(docs, model, held)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spread(table(spark, sf_dir, "documents")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spread(table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spread(table(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle_pages(spread(table(spark, sf_dir, "pages")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spread(table(spark, sf_dir, "documents")), language_id.held_out()
    return language_id.identify_languages(docs, language_id.fit_languages(docs, ~held), held)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(spread(table(spark, sf_dir, "documents"))).drop("char_distance", "word_distance")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filters, op2_toxicity, op3_token_ids, op4_lm_scoring, op5_mixing, op6_warc, op7_language_id, op8_decontamination, op9_simhash, op10_quality_rules)
    return {f.__name__: f for f in own}


OP1_SQL = """
WITH rules(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (
    SELECT row_number() OVER () AS uid, page_id,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
m AS (
    SELECT uid, rh || rp AS rule, rv, row_number() OVER (PARTITION BY uid ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
    FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM p LEFT JOIN m ON p.uid = m.uid AND k = 1
"""


OP6_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100
"""

#: The references, both distances and the verdict, over whole texts.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT uid, doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
b AS (
    SELECT uid, doc_id, lang, ws, len(ws) AS n, length(array_to_string(ws, '')) AS chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS c0, length(regexp_replace(t, '[^0-9]', '', 'g')) AS c1,
        length(regexp_replace(t, '[^.,;:!?''"()\-]', '', 'g')) AS c2, length(regexp_replace(t, '[^#*$%&|<>@^~=+_/\\{}\[\]]', '', 'g')) AS c3
    FROM w),
dup AS (
    SELECT uid, count(*) - count(DISTINCT line) AS n FROM (SELECT uid, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY uid),
win AS (SELECT uid, i, ws[i:i + 7] AS g FROM (SELECT uid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (
    SELECT uid, count(DISTINCT i + k) AS n FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS c FROM win), (SELECT unnest(range(0, 8)) AS k)
    WHERE c > 1 GROUP BY uid),
tot AS (SELECT lang, sum(n) AS n, sum(c0) AS s0, sum(c1) AS s1, sum(c2) AS s2, sum(c3) AS s3, sum(chars - c0 - c1 - c2 - c3) AS s4 FROM b WHERE lang IS NOT NULL GROUP BY lang),
ref AS (
    SELECT lang, n, list_transform([s0, s1, s2, s3, s4], lambda s: s::DOUBLE / greatest(1, s0 + s1 + s2 + s3 + s4)) AS q
    FROM tot WHERE n > 0),
ww AS (SELECT lang, uid, unnest(ws) AS word FROM b),
com AS (
    SELECT c.lang, c.word, c.n::DOUBLE / ref.n AS y FROM (SELECT lang, word, count(*) AS n FROM ww WHERE lang IS NOT NULL GROUP BY lang, word) c
    JOIN ref ON c.lang = ref.lang WHERE c.n >= greatest(1.0, 0.005::DOUBLE * ref.n)),
rest AS (
    SELECT lang, y, k, 1 - y AS ry, sqrt(greatest(0.0, 0.5 * y + 0.5 * (log2(2 / (2 - y)) + CASE WHEN y < 1 THEN (1 - y) * log2(2 * (1 - y) / (2 - y)) ELSE 0 END))) AS none
    FROM (SELECT ref.lang, coalesce(sum(com.y), 0) AS y, count(com.y) AS k FROM ref LEFT JOIN com ON ref.lang = com.lang GROUP BY ref.lang)),
own AS (SELECT uid, word, count(*) AS n FROM ww WHERE word IN (SELECT word FROM com) GROUP BY uid, word),
hit AS (SELECT own.uid, com.lang, own.n::DOUBLE / greatest(1, b.n) AS x, y, (x + y) / 2 AS m FROM own JOIN com ON own.word = com.word JOIN b ON own.uid = b.uid),
wsum AS (SELECT uid, lang, sum(x) AS x, sum(0.5 * (x * log2(x / m) + y * log2(y / m)) - 0.5 * y) AS j FROM hit GROUP BY uid, lang),
pair AS (
    SELECT b.uid, b.n, 1 / greatest(1, b.n)::DOUBLE + 1 / ref.n::DOUBLE AS draws, rest.k, rest.none, ref.q, list_transform([c0, c1, c2, c3, chars - c0 - c1 - c2 - c3], lambda c: greatest(c, 0)::DOUBLE / greatest(1, chars)) AS p,
        greatest(0.0, 1 - coalesce(wsum.x, 0)) AS rx, greatest(0.0, rest.ry) AS ry, coalesce(wsum.j, 0) + 0.5 * rest.y AS j
    FROM b JOIN ref ON b.lang = ref.lang OR b.lang IS NULL JOIN rest ON rest.lang = ref.lang LEFT JOIN wsum ON wsum.uid = b.uid AND wsum.lang = ref.lang),
dist AS (
    SELECT uid, (4 + 3 * sqrt(8)) / (8 * ln(2)) * draws AS more_chars, (k + 3 * sqrt(2 * k)) / (8 * ln(2)) * draws AS more_words, none,
        sqrt(greatest(0.0, list_sum(list_transform(range(1, 6), lambda i: 0.5 * (CASE WHEN p[i] > 0 THEN p[i] * log2(p[i] / ((p[i] + q[i]) / 2)) ELSE 0 END + CASE WHEN q[i] > 0 THEN q[i] * log2(q[i] / ((p[i] + q[i]) / 2)) ELSE 0 END))))) AS by_chars,
        sqrt(greatest(0.0, j + 0.5 * (CASE WHEN rx > 0 THEN rx * log2(rx / ((rx + ry) / 2)) ELSE 0 END + CASE WHEN ry > 0 THEN ry * log2(ry / ((rx + ry) / 2)) ELSE 0 END))) AS by_words
    FROM pair),
near AS (SELECT uid, bool_or(by_chars <= sqrt(0.30::DOUBLE * 0.30::DOUBLE + more_chars) AND by_words <= sqrt(0.7::DOUBLE * none * 0.7::DOUBLE * none + more_words)) AS ok FROM dist GROUP BY uid)
SELECT doc_id, b.n AS n_words, chars AS word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    b.n < 20 OR 100 * coalesce(rep.n, 0) > 30 * b.n AS base_failed,
    NOT (b.n < 20 OR 100 * coalesce(rep.n, 0) > 30 * b.n) AND coalesce(near.ok, true) AS kept
FROM b LEFT JOIN dup USING (uid) LEFT JOIN rep USING (uid) LEFT JOIN near USING (uid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op6_warc": OP6_SQL, "op10_quality_rules": OP10_SQL}
