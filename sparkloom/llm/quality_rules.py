r"""Quality rules: counts of a whole text, and the divergence of its distributions from those of known languages.

Base counts, with words ``[^\x20\x09-\x0D]+`` (a null text has none): ``n_words``; ``word_chars``, code points in words;
``n_symbols``, characters of ``[#*$%&|<>]``; ``n_dup_lines``, lines with a word that equal an earlier line;
``n_repeat_words``, words inside 8-word windows that occur twice or more in the text. ``base_failed``: fewer than 20 words, or
over 30 % repeated words.

Verdict: a document is compared to the reference of its language by the Jensen-Shannon distance (base 2, 0 to 1) between
histograms of character classes, and between histograms of common words (one more bin for all others). References are sums
over *all* documents of a language, and every language has one, whatever its share: a row of a table that is joined by
language. A language's common words are those with at least ``WORD_SHARE`` of its words (so 1/WORD_SHARE at most). A
document passes if it is within both limits. That of characters is ``MAX_CHARS``; that of words is ``ABSENT`` of the distance at
which a text without any common word is, so that such a text fails in every language.

Guards against short histograms: of n and N draws from one distribution over k bins, the divergence by chance is about
1 / (8 ln 2) * (1/n + 1/N) times a chi-square of k - 1 degrees; the limits' squares are wider by its mean and ``SPREADS``
standard deviations. Under ``MIN_JUDGED`` words nothing is judged.

Only DataFrame functions run here. Windows are compared by XXH64 over the words' XXH64 (64-bit, so two different windows
of one text count as equal with a chance of about n^2 / 2^65).

Defined cases: null or empty text: all counts 0, base_failed; repeated rows each get their row; documents with a null
language add to no reference and pass if they are within the limits of any; a document whose language has no reference (given
references, or a language without words) isn't judged: its verdict is true; empty tables give empty results. Only the columns named are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import staged

SPACES = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
WORD_SHARE = 0.005
MIN_JUDGED, SPREADS = 20, 3.0
MAX_CHARS, ABSENT = 0.30, 0.7
REFERENCE = "lang string, n double, chars array<double>, words array<string>, shares array<double>"
#: Character classes by pattern; letters are what is left of the words' characters. PLAIN ones are in none of them.
PLAIN = "[a-z\\x20\\x09-\\x0D]"
CLASSES = {"upper": "[\\p{Lu}]", "digit": "[0-9]", "stop": "[.,;:!?'\"()\\-]", "symbol": "[#*$%&|<>@^~=+_/\\\\{}\\[\\]]"}


def bound(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once: a lambda variable is a reference, a column used twice may be computed twice."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def repeat_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more."""

    def covered(hashes: Column) -> Column:
        def marked(windows: Column) -> Column:
            # (hash, start) in order; a window is repeated if a neighbour has its hash
            pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            starts = lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))), lambda x: x["i"]))
            # each start adds the words that the one before it doesn't cover
            spans = lambda s: F.aggregate(F.transform(s, lambda x, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(s, i - 1)))), F.lit(0), lambda a, x: a + x)
            full = bound(bound(pairs, starts), spans)
            return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(full)

        window = lambda i: F.xxhash64(F.slice(hashes, i + 1, F.lit(WINDOW)))
        return bound(F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window), marked)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, bound(hashed, covered)).otherwise(F.lit(0)).cast("bigint")


def class_counts(text: Column, n_chars: Column) -> Column:
    """Counts by class: those of CLASSES, then all other characters in words (letters, mostly)."""
    rest = F.regexp_replace(text, PLAIN + "+", "")  # what may be in a class, a small part of most texts

    def by_class(rest: Column) -> Column:
        return F.array(*[F.char_length(F.regexp_replace(rest, "[^" + p[1:-1] + "]+", "")).cast("double") for p in CLASSES.values()])

    return bound(bound(rest, by_class), lambda c: F.concat(c, F.array(n_chars - F.aggregate(c, F.lit(0.0), lambda a, x: a + x))))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, words and the base columns; a row for each document."""
    d = docs.select("doc_id", F.col("lang").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return d.select(
        "doc_id",
        "lang",
        "text",
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def references(docs: DataFrame, word_share: float = WORD_SHARE) -> DataFrame:
    """Per language with words (``REFERENCE``): its words, class histogram, common words and their shares. Two aggregations over all documents."""
    d = docs.select(F.col("lang").alias("lang"), F.coalesce("text", F.lit("")).alias("text")).filter(F.col("lang").isNotNull())
    words = words_of(F.col("text"))
    sums = [F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    measured = d.select("lang", F.size(words).cast("double").alias("n"), class_counts(F.col("text"), F.char_length(F.array_join(words, ""))).alias("c"))
    totals = staged(measured.groupBy("lang").agg(F.sum("n").alias("n"), *sums).filter("n > 0"), "quality-totals")  # read twice below
    counted = d.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("m"))
    common = counted.join(totals.select("lang", "n"), "lang").filter(F.col("m") >= F.greatest(F.lit(1.0), F.lit(word_share) * F.col("n")))
    listed = common.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("m") / F.col("n")).alias("s"), "word"))).alias("l"))  # 1 / word_share at most
    chars = F.array(*[F.col(f"c{i}") for i in range(len(CLASSES) + 1)])
    whole = F.greatest(F.lit(1.0), F.aggregate("c", F.lit(0.0), lambda a, x: a + x))
    refs = totals.select("lang", "n", chars.alias("c")).join(listed, "lang", "left").withColumn("l", F.coalesce("l", F.array().cast("array<struct<s:double,word:string>>")))
    return staged(refs.select("lang", "n", F.transform("c", lambda x: x / whole).alias("chars"), F.transform("l", lambda x: x["word"]).alias("words"), F.transform("l", lambda x: -x["s"]).alias("shares")), "quality-references")


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, of two arrays."""

    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        both = x * F.log2(x / m) + F.when(y > 0, y * F.log2(y / m)).otherwise(F.lit(0.0))
        return 0.5 * F.when(x > 0, both).otherwise(y)  # where x is 0, y log(y / m) is y

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def with_rest(shares: Column) -> Column:
    """The shares, and what they leave of 1."""
    return F.concat(shares, F.array(F.greatest(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))


def limit(least: Column, bins: Column, n: Column, reference_n: Column) -> Column:
    """``least``, wider by the divergence that samples of these sizes show by chance."""
    free = F.greatest(bins - 1, F.lit(0)).cast("double")
    chance = (free + SPREADS * F.sqrt(2 * free)) * (1 / (8 * math.log(2))) * (1 / n + 1 / reference_n)
    return F.sqrt(least * least + chance)


def _by_key(refs: DataFrame) -> DataFrame:
    """For each language's key the list of its reference; for documents without a language, that of all."""
    own = F.struct(*[x.split()[0] for x in REFERENCE.split(", ")])
    each = refs.select(_key(F.col("lang")).alias("key"), F.array(own).alias("refs"))
    return each.unionByName(refs.agg(F.collect_list(own).alias("refs")).select(_key(F.lit(None).cast("string")).alias("key"), "refs"))


def _key(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def judge_quality(docs: DataFrame, refs: DataFrame | None = None, max_chars: float = MAX_CHARS, absent: float = ABSENT) -> DataFrame:
    """Base columns, the distances to the nearest reference, base_failed and kept. ``refs``: a table like that of ``references``."""
    refs = references(docs) if refs is None else refs
    b = base_counts(docs).withColumn("classes", class_counts(F.col("text"), F.col("word_chars"))).drop("text")
    # references are one row a language, so small that Spark broadcasts them; should they not be, it joins by shuffle
    b = b.withColumn("key", _key(F.col("lang"))).join(_by_key(refs), "key", "left")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    in_class = F.transform("classes", lambda c: F.greatest(c, F.lit(0.0)) / chars)

    def compared(r: Column) -> Column:
        common = F.filter("words", lambda w: F.array_contains(r["words"], w))
        own = bound(common, lambda found: F.transform(r["words"], lambda w: (F.size(found) - F.size(F.array_remove(found, w))) / n))
        none = with_rest(F.transform(r["shares"], lambda x: x * 0.0))
        known = with_rest(r["shares"])
        most = bound(js_distance(none, known) * absent, lambda x: limit(x, F.size(r["shares"]) + 1, n, r["n"]))
        return F.struct(
            js_distance(in_class, r["chars"]).alias("c"),
            limit(F.lit(max_chars), F.lit(len(CLASSES) + 1), n, r["n"]).alias("most_c"),
            bound(own, lambda x: js_distance(with_rest(x), known)).alias("w"),
            most.alias("most_w"),
        )

    b = b.withColumn("judged", F.transform("refs", compared))
    near = F.col("judged").isNull() | (F.size("judged") < 1) | (F.col("n_words") < MIN_JUDGED) | F.exists("judged", lambda x: (x["c"] <= x["most_c"]) & (x["w"] <= x["most_w"]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return b.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & near).alias("kept"),
        F.array_min(F.transform("judged", lambda x: x["c"])).alias("char_distance"),
        F.array_min(F.transform("judged", lambda x: x["w"])).alias("word_distance"),
    )
