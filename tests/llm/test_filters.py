"""URL filters, quality rules, mixing and bundles against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from sparkloom.llm import quality_rules, source_mixing, url_filter, warc_bundle
from sparkloom.llm.queries import OP1_SQL

URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/7", "https://a.b.Example.COM/en/71?x#y", "http://com/en/", "http://xcom/en/", "http://x.com/EN/", "ftp://u@x.net:80/de/8",
    "http://example.net/de/89#z", "http://q.example.net/de/", "http://badexample.net/de/8", "x://y.org/es/a://b.com/en/", "http://y.org?/es/", "http://.com/en/", "http://a..com/en/", "http://x.com/en/" + "a" * 5000, "http://x.com/en/a b\nc",
]


def plain_judge(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


@pytest.mark.parametrize("most", [100_000, 2])
def test_urls(spark, most):
    rules = [*url_filter.RULES, ("X.com", "/en/aa", "allow"), ("x.com", "/en/aa", "block"), (None, "/", "block"), ("", "/", "block"), ("a.b.example.com", None, "block")]
    pages = spark.createDataFrame([(i % 15 or None, u, "odd") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), broadcast_rules=most)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    low = [((h or "").lower(), p or "", v) for h, p, v in rules]
    expected = [(i % 15 or None, *plain_judge(u, low)) for i, u in enumerate(URLS * 2)]
    assert Counter(tuple(r) for r in got.collect()) == Counter(expected)


def test_host_and_path_are_kept_apart(spark):
    """No rule fits by characters of the host that a URL has in its path, whatever the lengths of rules."""
    rules = [("example.co", "m/", "block"), ("a.b", "/", "block"), ("x/y", "/z", "block"), ("c", None, "block")]
    pages = spark.createDataFrame([(i, f"http://{u}") for i, u in enumerate(["example.com/en/x", "a.b/c", "x/y/z", "q.c?d", "example.co/m/"])], "page_id long, url string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert [r["rule"] for r in sorted(got)] == [None, "a.b/", None, "c", None]


def test_urls_sql_and_empty(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    duck = duckdb.connect()
    duck.register("pages", pages.toPandas())
    got = {tuple(r) for r in url_filter.judge_urls(pages, url_filter.rules_of(spark)).collect()}
    assert got == set(duck.execute(OP1_SQL).fetchall())
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_of(spark)).collect() == []
    assert {r["verdict"] for r in url_filter.judge_urls(pages, url_filter.rules_of(spark).limit(0)).collect()} == {"allow"}


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered, lines, twice = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            twice += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, len(covered)


def plain_distance(p, q):
    def part(x, m):
        return x * math.log2(x / m) if x > 0 else 0.0

    return math.sqrt(max(0.0, sum(0.5 * (part(x, (x + y) / 2) + part(y, (x + y) / 2)) for x, y in zip(p, q, strict=True))))


def plain_classes(text, n_chars):
    inside = [len(re.findall(p.replace(r"\p{Lu}", "A-Z\u00c0-\u00d6\u00d8-\u00de"), text)) for p in quality_rules.CLASSES.values()]
    return [max(0, x) / max(1, n_chars) for x in [*inside, n_chars - sum(inside)]]


def plain_limit(least, bins, n, m):
    chance = (bins - 1 + 3 * math.sqrt(2 * (bins - 1))) / (8 * math.log(2)) * (1 / max(1, n) + 1 / m)
    return math.sqrt(least**2 + chance)


def test_quality(spark, docs, rows):
    extra = [(900, "a b c d e f g h " * 30, "en", "s"), (901, "\n".join(["same line here", "", " ", "same line here"] * 9), "en", "s"), (902, "one two three four five six seven eight nine " * 2, "en", "s"), (903, "$$ ## ** || <> && %% " * 20, "en", "s")]
    from tests.llm.conftest import frame

    all_docs, all_rows = docs.unionByName(frame(spark, extra)), [*rows, *extra]
    refs = sorted(quality_rules.references(all_docs).collect(), key=lambda r: r["lang"])
    counted, totals = defaultdict(Counter), Counter()
    for _, text, lang, _ in all_rows:
        if lang is not None:
            words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
            counted[lang].update(words)
            totals[lang] += len(words)
    assert [r["lang"] for r in refs] == sorted(x for x in totals if totals[x])
    for r in refs:
        assert set(r["words"]) == {w for w, n in counted[r["lang"]].items() if n >= max(1, totals[r["lang"]] * quality_rules.WORD_SHARE)}
    got = quality_rules.judge_quality(all_docs).collect()
    expected = Counter()
    for i, text, lang, _ in all_rows:
        c = plain_counts(text)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        own = [r for r in refs if r["lang"] == lang or lang is None]
        near = not own or c[0] < quality_rules.MIN_JUDGED
        for r in own:
            by_chars = plain_distance(plain_classes(text or "", c[1]), r["chars"])
            shares = [words.count(w) / max(1, len(words)) for w in r["words"]]
            known = [*r["shares"], max(0.0, 1 - sum(r["shares"]))]
            by_words = plain_distance([*shares, max(0.0, 1 - sum(shares))], known)
            least = 0.7 * plain_distance([*[0.0] * len(shares), 1.0], known)
            near |= by_chars <= plain_limit(quality_rules.MAX_CHARS, 5, c[0], r["n"]) and by_words <= plain_limit(least, len(known), c[0], r["n"])
        expected[(i, *c, failed, not failed and near)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got) == expected
    assert {r["doc_id"]: r["kept"] for r in got}[903] is False


def test_quality_empty(docs, empty):
    assert quality_rules.judge_quality(empty).collect() == []
    bare = quality_rules.judge_quality(docs.withColumn("lang", docs["lang"].substr(1, 0).cast("string")).filter("doc_id < 5"))
    assert bare.count() == 5


def zipf_text(rng, words, n):
    return " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))


def mixed(spark, rows):
    """Words taken of each source by its target."""
    got = source_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    by_doc = {i: s for i, _, s in rows}
    for r in got:
        taken[by_doc[r["doc_id"]]] += r["taken"]
        target[by_doc[r["doc_id"]]] = r["target"]
    assert len(got) == len(rows)
    return {s: taken[s] / target[s] for s in target}


def test_mixing_splits_equal_rows(spark, monkeypatch):
    """Rows of one doc_id and text, alone and as a third of a source; sources whose names hold odd characters."""
    monkeypatch.setattr(source_mixing, "RUN", 64)
    assert mixed(spark, [(1, "one two three four", "a")] * 1000)["a"] == pytest.approx(1, abs=0.005)
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["a\x01b", 'c"', "[]"])) for i in range(2000)] + [(5000, "hot " * 30, "hot")] * 700 + [(5001 + i, "x " * rng.randint(1, 60), "hot") for i in range(700)]
    for share in mixed(spark, rows).values():
        assert share == pytest.approx(1, abs=0.01)


def test_mixing_is_the_same_in_any_layout(spark):
    rows = [(i % 90, f"w{i % 90} " * (1 + i % 90 % 7), f"s{i % 90 % 2}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (Counter(map(tuple, source_mixing.mix(docs.repartition(n)).collect())) for n in (1, 5))
    assert one == two
    repeated = Counter(r["doc_id"] for r in source_mixing.repeat_mixed(docs.repartition(3)).collect())
    wanted = Counter()
    for (i, size, _, _, taken), n in one.items():
        wanted[i] += n * taken // size
    assert repeated == +wanted


def plain_least_cost(supply, members, quota, copies):
    """(words routed, least cost) over all flows: copy k of a pattern's words costs k * k each."""
    routes = [(p, s) for p in supply for s in members[p]]
    best = (0, 0)
    for flow in itertools.product(*(range(min(quota[s], copies * supply[p]) + 1) for p, s in routes)):
        by_p, by_s = Counter(), Counter()
        for (p, s), n in zip(routes, flow, strict=True):
            by_p[p] += n
            by_s[s] += n
        if all(by_s[s] <= quota[s] for s in quota) and all(by_p[p] <= copies * supply[p] for p in supply):
            cost = sum(min(supply[p], max(0, by_p[p] - k * supply[p])) * k * k for p in supply for k in range(copies))
            best = min(best, (-sum(flow), cost))
    return -best[0], best[1]


@pytest.mark.parametrize("seed", range(40))
def test_flow_costs_least(seed):
    rng = random.Random(seed)
    sources, copies = ["A", "B", "C"][: rng.randint(1, 3)], rng.randint(1, 3)
    supply = {p: rng.randint(0, 3) for p in "xyz"[: rng.randint(1, 3)]}
    members = {p: rng.sample(sources, min(len(sources), rng.randint(1, 2))) for p in supply}
    quota = {s: rng.randint(0, 5) for s in sources}
    flow = source_mixing.min_cost_flow(supply, members, quota, copies)
    by_p, by_s = {p: sum(f.values()) for p, f in flow.items()}, Counter()
    for p, f in flow.items():
        assert set(f) <= set(members[p])
        by_s.update(f)
    assert all(by_s[s] <= quota[s] for s in by_s) and all(by_p[p] <= copies * supply[p] for p in supply)
    cost = sum(min(supply[p], max(0, by_p[p] - k * supply[p])) * k * k for p in supply for k in range(copies))
    assert (sum(by_p.values()), cost) == plain_least_cost(supply, members, quota, copies)


def test_flow_of_many_patterns():
    """A component of hundreds of patterns that share sources fills every quota it can."""
    rng = random.Random(3)
    sources = [f"s{i}" for i in range(12)]
    members = {f"p{i}": rng.sample(sources, 3) for i in range(400)}
    supply = {p: rng.randint(1, 10**6) for p in members}
    quota = {s: sum(supply.values()) // 10 for s in sources}
    flow = source_mixing.min_cost_flow(supply, members, quota)
    by_s = Counter()
    for f in flow.values():
        by_s.update(f)
    assert by_s == quota


@pytest.mark.parametrize("n", [30, 80, 300])
def test_clean_short_texts_are_kept(spark, n):
    """Texts of one distribution, nearly all of whose words are common, diverge from their sum by chance alone; a rare language is no worse off."""
    rng = random.Random(n)
    many, few = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(62)], [f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    rows = [(i, zipf_text(rng, many, n), "aa") for i in range(1500)] + [(i + 1500, zipf_text(rng, few, n), "bb") for i in range(2)]
    rows += [(i + 1600, zipf_text(rng, many, n), None) for i in range(100)]  # judged by any reference
    got = [r for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if not r["base_failed"]]
    for part in (range(1500), range(1500, 1502), range(1600, 1700)):
        own = [r["kept"] for r in got if r["doc_id"] in part]
        assert sum(own) >= 0.95 * len(own)


def test_texts_without_common_words_fail(spark):
    """Long texts of letters in which no common word occurs, or one occurs far too often."""
    rng = random.Random(4)
    common, rare = [f"w{chr(97 + i)}" for i in range(20)], [f"x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)]

    def text(n, share):
        return " ".join(rng.choice(common) if rng.random() < share else rng.choice(rare) for _ in range(n))

    rows = [(i, text(300, 0.35), "aa") for i in range(300)] + [(1000 + i, text(400, 0.0), "aa") for i in range(5)] + [(2000 + i, " ".join(rng.choice([common[0], rng.choice(rare)]) for _ in range(400)), "aa") for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in kept if i >= 1000)


def test_languages_without_a_reference_are_not_judged(spark):
    docs = spark.createDataFrame([(1, "some words of a text " * 2 + " ".join(f"n{i}" for i in range(30)), "aa")], "doc_id long, text string, lang string")
    other = quality_rules.references(docs.selectExpr("doc_id", "'zz' AS lang", "'y ' || upper(text) AS text"))
    assert quality_rules.judge_quality(docs, other).first()["kept"]


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 1e12
    for _ in range(300):  # the level at which capped shares fill the whole
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * w[s]) for s in order) < 1.5 * sum(sizes.values()) else (low, mid)
    return {s: min(2 * sizes[s], low * w[s]) for s in order}


def test_mixing(docs, rows):
    got = source_mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))
    aims = plain_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for i, t, _, _ in rows)
    taken = Counter()
    keyed = defaultdict(list)
    for i, t, _, s in rows:
        keyed[i, len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))].append(s)
    for r in got:
        s = keyed[r["doc_id"], r["size"]].pop()
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(aims[s], abs=1e-6) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    biggest = {s: max((len((t or "").split()) for _, t, _, x in rows if x == s), default=0) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - aims[s]) <= max(0.05 * aims[s], biggest[s] / 2 + 1)
    again = source_mixing.mix(docs).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mixing_repeats_rows(docs):
    taken = Counter()
    for r in source_mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
    out = source_mixing.repeat_mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +taken


def test_mixing_empty(empty):
    assert source_mixing.mix(empty).collect() == [] and source_mixing.repeat_mixed(empty).collect() == []


def test_flow_prefers_first_copies():
    supply, members = {"a": 100, "ab": 50, "b": 10}, {"a": ["A"], "ab": ["A", "B"], "b": ["B"]}
    flow = source_mixing.min_cost_flow(supply, members, {"A": 100, "B": 60})
    assert flow == {"a": {"A": 100}, "ab": {"B": 50}, "b": {"B": 10}}  # nothing is repeated where nothing need be
    flow = source_mixing.min_cost_flow(supply, members, {"A": 240, "B": 90})
    assert sum(x for f in flow.values() for x in f.values()) == 2 * (100 + 50 + 10)  # all that there is, twice
    assert all(sum(f.values()) <= 2 * supply[p] for p, f in flow.items())


def test_overlapping_sources(spark, docs):
    from pyspark.sql import functions as F

    both = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("src0"), F.lit("src1"))).otherwise(F.array(F.coalesce("source", F.lit("none"))))
    got = source_mixing.mix(docs, both).collect()
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), rel=0.2)


def test_bundles(spark, tmp_path):
    big = "<p>\u00e9t\u00e9</p>" * 60
    html = [None, "", "tiny", "tiny", big, big, "y" * 100, "y" * 100, "z" * 99, "z" * 99, "long " * 300_000, "a\r\n\r\nWARC/1.1\r\n" + "b" * 200]
    rows = [(i + 3, f"http://x/{i}\r\nX: y", h, "odd") for i, h in enumerate(html)] + [(1, None, big, "odd"), (None, "u", big, "odd"), (None, None, None, "odd"), (1, None, big, "odd")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    index = warc_bundle.write_bundles(pages, str(tmp_path / "out"), frame_bytes=1000)
    got = warc_bundle.read_bundles(index).drop("url").collect()
    first = {}
    for i, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if len((h or "").encode()) >= 100 and i is not None:
            first.setdefault(h, i)
    expected = Counter()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        refers = first.get(h) if i is not None and len(b) >= 100 and first.get(h) != i else None
        expected[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if refers else "response", refers] += 1
    assert Counter(map(tuple, got)) == expected
    assert index.agg({"frame": "max"}).first()[0] >= 1
    name = index.filter("page_id = 7").first()["bundle"]
    import zstandard

    with open(name, "rb") as f:  # any reader of the format sees the records in order
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\n") and whole.count(b"WARC-Record-ID") == index.filter(index["bundle"] == name).count()
    assert warc_bundle.bundle_pages(pages.limit(0)).collect() == []


def test_a_damaged_record_is_noticed():
    raw = warc_bundle.warc_record(1, "u", b"abc", "0" * 64, None)
    fields, payload = warc_bundle.parse_record(raw)
    assert payload == b"abc" and fields["WARC-Type"] == "response"
    with pytest.raises(ValueError, match="doesn't end"):
        warc_bundle.parse_record(raw[:-1])
