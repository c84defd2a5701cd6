"""SimHash, decontamination, token files and the pipeline against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import decontamination, queries, simhash, token_file
from sparkloom.llm.common import plain_words
from tests.llm.conftest import frame, sentence


def plain_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    votes = [sum(xxhash.xxh64_intdigest(x, 42) >> k & 1 for x in s) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(s))


def plain_components(prints, bits=2):
    """Index of the class of each print."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, rows):
    prints = [plain_print(t) for _, t, _, _ in rows]
    comp = plain_components(prints)
    smallest = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    expected = Counter((r[0], f"{p:016x}", smallest[c]) for r, p, c in zip(rows, prints, comp, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))
    texts = {r[0]: r[1] for r in rows}
    for r in kept.collect():
        assert r["doc_id"] is None or texts[r["doc_id"]] == r["text"]
    assert {r["doc_id"] for r in kept.collect()} >= set(smallest.values()) - {None}


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def test_one_of_each_class_stays(spark, docs, rows):
    """Against the classes of all documents; copies, repeated rows and null ids among them."""
    classes = Counter(r["component_id"] for r in simhash.near_duplicates(docs).collect())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(classes.keys())


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_rows_without_some(spark, tmp_path, share):
    from sparkloom.llm.common import staged

    rows = staged(spark.range(3000).repartition(5).withColumn("uid", F.monotonically_increasing_id()), "numbered")
    gone = rows.filter(F.rand(3) < share).select("uid")
    gone.write.parquet(str(tmp_path / "gone"))
    gone = spark.read.schema("uid long").parquet(str(tmp_path / "gone"))
    left = simhash.without(rows, "uid", gone)
    assert sorted(r["uid"] for r in left.collect()) == sorted(r["uid"] for r in rows.join(gone, "uid", "left_anti").collect())


@pytest.mark.parametrize("pairs_below", [16, 1])
def test_links_and_components(spark, pairs_below):
    """Clusters of many fingerprints a bit or two apart, chains, and noise; in small buckets and in dense ones."""
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(40):  # a chain
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(x)
        prints |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}  # a ball
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = simhash.links(nodes, pairs_below)
    of = dict(zip(signed, prints, strict=True))
    found = [(r["a"], r["b"]) for r in edges.collect()]
    assert all((of[a] ^ of[b]).bit_count() <= 2 for a, b in found)
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    comp = plain_components(prints)
    sizes = Counter(comp)
    assert len(got) == sum(n for n in sizes.values() if n > 1)
    classes = {}
    for s, c in zip(signed, comp, strict=True):
        classes.setdefault(c, []).append(s)
    for members in classes.values():
        assert len(members) == 1 or {got[m] for m in members} == {min(members)}


def test_chains_hold_for_every_near_pair(spark):
    """Every pair within 2 bits shares a key whose chain keeps the budgets."""
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << b
        pairs.append((x, y))
    s = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(s(x), s(y)) for x, y in pairs], "a long, b long")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    tests = [(diff.bitwiseAND(F.lit(s(mask)).cast("long")) == 0) & simhash._chain(diff, F.lit(start)) for start, mask in simhash._masks()]
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    assert df.filter(~hit).count() == 0


def test_long_cycle(spark):
    edges = [(i, (i + 1) % 200) for i in range(200)] + [(1000, i) for i in range(1001, 1200)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(200)} | {i: 1000 for i in range(1000, 1200)}


def plain_align(item, text):
    """Best local score by the full table."""
    g, u = decontamination.GAP, decontamination.UNEQUAL
    s = np.zeros((len(item) + 1, len(text) + 1))
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            s[i, j] = max(0, s[i - 1, j - 1] + (1 if item[i - 1] == text[j - 1] else -u), s[i - 1, j] - g, s[i, j - 1] - g)
    return s.max()


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=25))
def test_alignment(item, text):
    a, b = np.array(item, np.uint64), np.array(text, np.uint64)
    equal, score, first, last = decontamination.align(a, b)
    assert score == plain_align(item, text) and 0 <= first <= last <= len(text) and equal <= len(item)
    if score:
        assert equal >= score and plain_align(item, text[first:last]) == score


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = "changed"
    return out


def test_decontamination(spark, tmp_path, empty):
    rng = random.Random(5)
    items = [(i, sentence(rng, "en", rng.randint(9, 50))) for i in range(12)] + [(50, None), (51, ""), (52, "the of and"), (None, sentence(rng, "fr", 20)), (3, None)]
    items.append((60, items[2][1]))
    rows, dirty = [], set()
    for i in range(80):
        text = sentence(rng, "en", rng.randint(20, 200))
        if i % 8 == 0:
            k = (i // 8) % 12
            share = (0.0, 0.1, 0.15)[i // 8 % 3]
            text += " " + " ".join(edited(rng, items[k][1].split(), share)).upper() + " " + sentence(rng, "de", 9)
            dirty.add(i)
        rows.append((i, text, "en", "s"))
    rows += [(200, None, None, None), (201, "", None, None), (202, "the of and", "en", "s"), (None, items[4][1], "en", "s")]
    path = str(tmp_path / "d.parquet")
    frame(spark, rows).repartition(3).write.parquet(path)
    docs, bench = spark.read.parquet(path), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(docs, bench)
    found = {r["doc_id"]: r for r in got.collect()}
    # a plain version: the share of an item's words that the best alignment with the whole text matches
    expected = set()
    for i, text, _, _ in rows:
        h = np.array([hash(w) & (2**63 - 1) for w in plain_words(text)], np.uint64)
        for _, t in items:
            w = np.array([hash(x) & (2**63 - 1) for x in plain_words(t)], np.uint64)
            if len(w) >= decontamination.LEAST_WORDS and len(h) and decontamination.align(w, h)[0] >= 0.8 * len(w):
                expected.add(i)
    assert set(found) == expected >= dirty | {None}
    assert found[16]["n_items"] >= 2 and found[16]["item_id"] == 2 and all(r["similarity"] >= 0.8 for r in found.values())
    clean = decontamination.keep_clean(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - expected
    blocks = list(decontamination.blocks_of(bench, docs, block_words=20))
    assert len(blocks) > 1 and sum(len(b.ids) for b in blocks) == 14
    assert decontamination.contaminated(empty, bench).collect() == [] and decontamination.contaminated(docs, bench.limit(0)).collect() == []
    assert decontamination.keep_clean(docs, bench.limit(0)).count() == len(rows)


EDITS = {
    "insert": lambda w: [x for i, y in enumerate(w) for x in ([y, f"new{i}"] if i % 3 == 2 else [y])],
    "insert_all": lambda w: [x for i, y in enumerate(w) for x in (y, f"new{i}")],
    "replace": lambda w: ["changed" if i % 4 == 3 and i // 4 < len(w) // 5 else y for i, y in enumerate(w)],
    "leave_out": lambda w: [y for i, y in enumerate(w) if not (i % 4 == 3 and i // 4 < len(w) // 5)],
}


def in_order(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("edit", sorted(EDITS))
def test_evenly_edited_copies_are_found(spark, tmp_path, edit):
    """Whatever the whole-text alignment finds, also where a third of all rows are copies."""
    rng = random.Random(12)
    items = [(n, " ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(4000)}", f"w{rng.randrange(60)}"]) for _ in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 15, 20, 34, 50)] + [(99, "a " * 9 + "bee")]
    noise = lambda n: [f"w{rng.randrange(4000)}" if rng.random() < 0.6 else rng.choice(["the", "of", "and"]) for _ in range(n)]
    rows = [(i, " ".join([*noise(30), *EDITS[edit](t.split()), *noise(40)]), "en", "s") for i, t in items]
    rows += [(1000 + k, rows[10][1], "en", "s") for k in range(40)] + [(2000 + k, " ".join(noise(120)), "en", "s") for k in range(70)]
    path = str(tmp_path / "d.parquet")
    frame(spark, rows).repartition(3).write.parquet(path)
    got = {r["doc_id"]: r["n_items"] for r in decontamination.contaminated(spark.read.parquet(path), spark.createDataFrame(items, "item_id long, text string")).collect()}
    cache, expected = decontamination.word_cache(), Counter()
    for i, text, _, _ in rows:
        for _, t in items:
            w = cache.array(plain_words(t))
            expected[i] += decontamination.align(w, cache.array(plain_words(text)))[0] >= 0.8 * len(w)
    assert set(got) >= {i for i, _ in items[:-1]} | set(range(1000, 1040)) and all(got.get(i, 0) >= n for i, n in expected.items())
    # of alignments that score alike one may have more equal words: what is found beyond has them in order within reach
    for i, text, _, _ in rows:
        if got.get(i, 0) > expected[i]:
            h = plain_words(text)
            reach = [any(in_order(w, h[a : a + 3 * len(w)]) >= 0.8 * len(w) for a in range(len(h))) for w in (plain_words(t) for _, t in items)]
            assert got[i] <= sum(reach)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=14), st.lists(st.integers(0, 12), max_size=60), st.lists(st.integers(0, 30), min_size=13, max_size=13))
def test_signatures_lose_nothing(item, text, often):
    block = decontamination.block_of([(1, " ".join(f"w{x}" for x in item), 1)])
    cache = decontamination.word_cache()
    rate = {cache[b"w%d" % x]: often[x] for x in range(10)}
    block.often[:] = [rate[int(w)] for w in block.known.words]
    block.documents = 20
    of, h = decontamination.index_of(block), cache.array([b"w%d" % x for x in text])
    if decontamination.align(block.words[0], h)[0] >= 0.8 * len(item):
        assert [i for i, _ in decontamination.verdicts(of, ["", " ".join(f"w{x}" for x in text)], cache)] == [1]


def test_copies_of_an_item_are_one(spark):
    """A benchmark most of whose items are one text has small blocks, and counts all of them."""
    rng = random.Random(16)
    texts = [sentence(rng, "en", 12) for _ in range(8)]
    bench = spark.createDataFrame([(i, texts[0]) for i in range(3000)] + [(5000 + i, t) for i, t in enumerate(texts[1:])], "item_id long, text string").repartition(3)
    docs = spark.createDataFrame([(1, f"so {texts[0]} it ended"), (2, texts[3].upper()), (3, "nothing of it")], "doc_id long, text string")
    blocks = list(decontamination.blocks_of(bench, docs, block_words=500))
    assert sum(len(b.ids) for b in blocks) == 8 and all(len(b.ids) <= 8 for b in blocks)
    got = {r["doc_id"]: (r["item_id"], r["n_items"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {1: (0, 3000), 2: (5002, 1)}


def test_short_items_can_be_left_out(spark):
    docs, bench = spark.createDataFrame([(1, "a yes b"), (2, "no")], "doc_id long, text string"), spark.createDataFrame([(1, "yes"), (2, "yes yes no no yes"), (3, ""), (4, "...")], "item_id long, text string")
    assert [r["doc_id"] for r in decontamination.contaminated(docs, bench).collect()] == [1]
    assert decontamination.contaminated(docs, bench, least_words=5).collect() == []


def test_decontamination_in_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    items = [(i, sentence(rng, "en", 20)) for i in range(6)]
    rows = [(i, sentence(rng, "de", 20) + " " + items[i % 6][1] + " " + items[(i + 1) % 6][1], "en", "s") for i in range(12)] + [(99, sentence(rng, "fr", 30), "fr", "s")]
    path = str(tmp_path / "d.parquet")
    frame(spark, rows).write.parquet(path)
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.read.parquet(path)
    whole = decontamination.blocks_of
    monkeypatch.setattr(decontamination, "blocks_of", lambda b, d, **k: whole(b, d, 10, **k))
    got = {r["doc_id"]: r["n_items"] for r in decontamination.contaminated(docs, bench).collect()}
    assert got == dict.fromkeys(range(12), 2)
    assert [r["doc_id"] for r in decontamination.keep_clean(docs, bench).collect()] == [99]


def test_verdicts_of_blocks_meet_whatever_the_order_of_rows(spark, tmp_path, monkeypatch):
    """A shuffle's rows arrive in any order; here each pass sees another one."""
    rng = random.Random(7)
    items = [(i, sentence(rng, "en", 20)) for i in range(6)]
    rows = [(i % 30, f"{sentence(rng, 'de', 20)} {items[i % 6][1]} {items[(i + 1) % 6][1]}", "en", "s") for i in range(60)]
    folder = tmp_path / "sf"
    frame(spark, rows).repartition(2).write.parquet(str(folder / "documents.parquet"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench.write.parquet(str(folder / "benchmark.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet")).select("doc_id", "text")
    whole = decontamination.blocks_of
    monkeypatch.setattr(decontamination, "blocks_of", lambda b, d, **k: whole(b, d, 10, **k))

    def any_order(frames):
        for pdf in frames:
            yield pdf.sample(frac=1)

    twice = Counter({(i, 2): 2 for i in range(30)})
    assert Counter((r["doc_id"], r["n_items"]) for r in decontamination.contaminated(docs.mapInPandas(any_order, docs.schema), bench).collect()) == twice
    assert Counter((r["doc_id"], r["n_items"]) for r in queries.op8_decontamination(spark, str(folder)).collect()) == twice


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 10**9), min_size=0, max_size=60), st.integers(6, 16))
def test_code_lengths(counts, most):
    counts = np.array(counts, np.int64)
    lengths = token_file.code_lengths(counts, most).astype(int)
    used = lengths[counts > 0]
    assert (lengths[counts == 0] == 0).all() and (used >= 1).all() and (used <= most).all()
    if len(used) > 1:
        assert sum(2.0**-n for n in used) == 1.0
        # no shorter than Huffman's, and equal to it where the limit doesn't bind
        import heapq

        heap = [(int(c), i, 0) for i, c in enumerate(counts) if c > 0]
        cost, tie = 0, len(counts)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], tie, max(a[2], b[2]) + 1))
            tie += 1
        mine = int((counts * lengths).sum())
        assert mine >= cost and (mine == cost or heap[0][2] > most)


@settings(deadline=None, max_examples=50)
@given(st.lists(st.lists(st.integers(0, 300), max_size=40), min_size=1, max_size=8), st.sampled_from([1, 3, 128]))
def test_pack_and_unpack(docs, stride):
    docs = [[*d, 2] for d in docs]
    ids = np.array([x for d in docs for x in d], np.uint32)
    lengths = token_file.code_lengths(np.bincount(ids, minlength=301))
    bounds = np.cumsum([0, *map(len, docs)])
    packed = token_file.pack(ids, bounds, token_file.canonical_codes(lengths), lengths, stride)
    for d, (bits, marks) in zip(docs, packed, strict=True):
        sizes = np.array([min(stride, len(d) - k) for k in range(0, len(d), stride)])
        assert token_file.unpack(bits, marks, sizes, lengths.tobytes()).tolist() == d


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_file.tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, token_file.END] for x in texts]


def test_words_are_encoded_as_the_whole_text(rows):
    texts = [t for _, t, _, _ in rows]
    texts += ["it's 'S I'LL  don't.", "e\u0301 E\u0301te \u212b \u1e9e \u0130x \u03a3\u03a3 \u03c3\u03c2", "a<|endoftext|>b <|ENDOFTEXT|> x", "tab\tnew\nline\u00a0nbsp\u2003em", "x2. 3.! .. ?! a,b. \u00b2. \u2155!", "a\x0bb\x0cc\rd\x85e\x1cf g", "Word*** of%%%\nThe$$$ \u00c9t\u00e9.### a<b> (c)] 'd'. e's, \u0130. \u0130b \u03a3. \u1e9e \u01c5x \ufb01x.", "\x00 \x7f \xad \ufeff", "\u4e2d\u6587\u3002 \U0001f600! na\u00efve, STRA\u00dfE", "\u0645\u0631\u062d\u0628\u0627. \u0939\u093f\u0928\u094d\u0926\u0940."]
    tiny = token_file.Encoder(token_file.tokenizer_path(), most=3)  # generations turn over all the time
    for e in (token_file.encoder(token_file.tokenizer_path()), tiny):
        got = [np.frombuffer(x, "<u4").tolist() for t in texts for x in e([t])]
        assert got == whole_ids(texts)


def test_words_with_marks_are_encoded_as_the_whole_text():
    """Letters with combining marks, letters that the normaliser takes apart, special tokens; any string made of them."""
    letters = [chr(c) for c in (*range(0x41, 0x250), *range(0x370, 0x400), *range(0x958, 0x960), *range(0x1E00, 0x1F00), 0xF4D, 0x212B, 0xFB1D) if chr(c).isalpha()]
    marks = [chr(c) for c in (*range(0x300, 0x330), 0x331, 0x338, 0x345)]
    texts = [f"{x}{m} a{x}{m}. {x}, B{x}." for x in letters for m in marks[::3] + ["\u030a", "\u0308", "\u0331", "\u030c"]]
    rng = random.Random(5)
    pool = [*letters[:300], *marks, *" \t\n.,;:!?*#$%&|<>)]}\"'\u00a0\u0085\x1c0123\u03a3\u03c3\u03c2\u0130", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>", "'s", "'LL"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(20_000)]
    want = [np.array(x, "<u4").tobytes() for x in whole_ids(texts)]
    for e in (token_file.encoder(token_file.tokenizer_path()), token_file.Encoder(token_file.tokenizer_path(), most=40)):
        assert [t for t, a, b in zip(texts, e(texts), want, strict=True) if a != b] == []


def test_other_tokenizers_encode_whole_texts(rows):
    """One that keeps white space and capitals: its pre-tokens span what lies between words."""
    from tokenizers import Tokenizer

    path = token_file.tokenizer_path("byte_bpe_50k.json")
    texts = [r[1] for r in rows]
    library = Tokenizer.from_file(path)
    e = token_file.Encoder(path)
    assert not e.by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == [[*library.encode(t or "", add_special_tokens=False).ids, token_file.END] for t in texts]


def test_token_table(spark, docs, rows, empty):
    got = sorted(token_file.token_table(docs).collect(), key=lambda r: r["start"])
    ids = whole_ids([t for _, t, _, _ in rows])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids, strict=True))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_file.token_table(empty).collect() == []


def test_token_file_of_one_id(spark, tmp_path):
    """A doc_id that all rows share is dealt over the parts, and still in order."""
    docs = frame(spark, [(7, f"word {i}", "en", "s") for i in range(50)])
    token_file.write_tokens(docs, str(tmp_path / "t"), token_file.tokenizer_path(), stride=2, block_tokens=8)
    got = token_file.read_tokens(spark, str(tmp_path / "t"))
    assert sorted(tuple(r["ids"]) for r in got.collect()) == sorted(tuple(x) for x in whole_ids([f"word {i}" for i in range(50)]))
    assert spark.read.parquet(str(tmp_path / "t/blocks")).select("part").distinct().count() > 1


def test_pipeline(spark, docs, rows, tmp_path):
    import os

    folder = tmp_path / "sf"
    os.makedirs(folder)
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, rows[9][1]), (2, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    d, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(folder))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        d = spark.read.parquet(path)
        kept.append(d.count())
    assert kept[0] >= len(rows) - 8 and kept[1] < kept[0] and kept[2] < kept[1] and kept[4] == kept[3]
    assert corpus_pipeline.run(spark, str(folder)).count() == kept[-1]
    ids = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "decontamination")).collect()}
    assert 9 not in ids


def test_pipeline_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
