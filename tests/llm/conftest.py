"""Small odd inputs for the training-data operators."""

import random

import pytest
from pyspark.sql import types as T

WORDS = {
    "en": "the of and to in is that for with was as are this from have".split(),
    "de": "der die und das ist nicht mit von ein sich auch für über werden nach".split(),
    "fr": "le la les des est une que dans pour pas avec été sur qui même".split(),
}
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        *(T.StructField(n, T.StringType()) for n in ("fp", "score", "size", "row", "part", "uid", "bucket", "copies", "key", "words", "tail", "predicted", "digest", "host", "n")),
    ]
)


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", "ab", "xy", "zu", "on"]) for _ in range(n)).capitalize() + "."


def odd_rows(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = "\n".join(sentence(rng, lang, rng.randint(4, 30)) for _ in range(rng.randint(1, 6)))
        rows.append((i, text, lang, f"src{i % 3}"))
    rows += [(n, None, "en", None), (n + 1, "", None, "src0"), (n + 2, " \t\n\x0b\x0c\r ", "de", ""), (None, "a null id", "en", None), (None, None, None, None)]
    rows += [(n + 3, "123 456 !!", "en", "src1"), (n + 4, "x", "en", "src2"), (n + 5, "\u00c9t\u00e9 na\u00efve \U0001f600 \u4e2d\u6587 \u3000 STRASSE\u00df", "fr", "\u00fc")]
    rows += [(n + 6, " ".join(sentence(rng, "en", 40) for _ in range(400)), "en", "src0")]
    rows += [(n + 7, rows[5][1], "en", "src0"), (n + 8, rows[5][1], "en", "src1"), rows[7], rows[7]]  # copies, repeated rows
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *(["odd"] * (len(SCHEMA) - 5))) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame(spark, rows).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
