"""Shared folder, staging and text helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all is one machine (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = f"file://{folder}"
    return _own[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than half the cores, dealt over all cores; larger ones, as they are. Small files alone need it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


BATCH_BYTES, _BATCH_SETTING, _BATCH_DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches sent to Python hold about 8 MB, whatever the length of texts; a setting of the caller's own is left alone."""
    if str(spark.conf.get(_BATCH_SETTING)).rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts its lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as remainder 0 of an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; bytes methods know ASCII letters and white space only."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def slices(texts: list, budget: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` characters each, so that what is made of a batch stays bounded; a longer text is one range."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= budget:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class HashCache(dict):
    """Word to hash, remembered for at most ``most`` words; frequent words are soon there again after a clearing."""

    def __init__(self, of, most: int = 300_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.of(word)
        return h

    def array(self, words: list, dtype=np.uint64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype, len(words))


_PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, of the lower-cased text."""
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).split() if text else []
