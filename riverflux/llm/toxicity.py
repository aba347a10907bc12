"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic text.

The ordinary dictionary holds the commonest words of ordinary labelled documents; the toxic one holds
the same words and, nearest to the window, those that toxic documents use far more often. Each window
of a text (one word: longer windows were measured to drown a short insult in noise) is compressed
with both; the bytes that the toxic dictionary saves are the window's excess. A document's largest
excess, its three largest, its mean and how many windows reach the threshold go into a logistic
calibration, fitted on labelled documents that trained neither dictionary.

The dictionaries and the calibration are fitted on a bounded sample of labelled documents, SAMPLE rows
at most on average; every document is scored over its whole text. A calibration row counts for as many
labelled rows as its class's sampling share says, so the scores do not depend on how far the sample was cut.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverflux.llm.common import free_name, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Expected number of labelled rows in the sample: toxic, other.
SAMPLE = (6000, 18000)
COMMON_WORDS, TOXIC_WORDS = 60_000, 2_000
#: A word is toxic vocabulary from this many documents and this ratio of document frequencies on.
LEAST_DOCS, LEAST_RATIO = 3, 30
#: A constant tail keeps short windows above the size from which zstandard compresses at all.
TAIL = bytes(48)
WINDOW_THRESHOLD = 4
THRESHOLD = 0.7
#: Words whose excess a worker remembers.
CACHE = 400_000
#: Longest piece that is compressed at once; longer words are cut into pieces, all of which count.
LONGEST = 4096
#: ASCII that isn't a letter separates words; upper case becomes lower case.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    found = (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(compression_level=3, window_log=20, search_log=8, min_match=5, strategy=zstandard.STRATEGY_BTULTRA2, write_content_size=False, write_checksum=False, write_dict_id=False)
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=content)


class Excess:
    """The bytes that the toxic dictionary saves on a word."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.toxic = compressor(ordinary), compressor(toxic)
        self.known: dict[bytes, int] = {}

    def of(self, word: bytes) -> int:
        v = self.known.get(word)
        if v is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            window = b" " + word + b" " + TAIL
            v = self.known[word] = len(self.plain.compress(window)) - len(self.toxic.compress(window))
        return v

    def features(self, text: str | None) -> list[float]:
        """Largest excess, sum of the three largest, share of excess over 2, windows at the threshold, windows."""
        counts = Counter(words_of(text))
        n = sum(counts.values())
        if not n:
            return [0.0, 0.0, 0.0, 0.0, 0.0]
        of, high, top, over = self.of, 0, [], 0
        for w, c in counts.items():
            v = of(w)
            if v > 2:
                over += (v - 2) * c
                high += c * (v >= WINDOW_THRESHOLD)
            if v > 0:
                top += [v] * min(c, 3)
        top = sorted(top)[-3:]
        return [float(max(top, default=0)), float(sum(top)), over / n, float(high), float(n)]


def design(f: np.ndarray) -> np.ndarray:
    return np.column_stack([f[:, 0], f[:, 1], np.log1p(100 * f[:, 2]), np.log1p(f[:, 3]), np.log1p(f[:, 4])])


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method with a small ridge; times: how often each row counts."""
    mu = np.average(x, axis=0, weights=times)
    sd = np.sqrt(np.average((x - mu) ** 2, axis=0, weights=times))
    sd[sd == 0] = 1
    z = np.column_stack([(x - mu) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z.T * (times * p * (1 - p))) @ z + ridge * np.eye(len(w)), z.T @ (times * (p - y)) + ridge * w)
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mu / sd).sum())


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def distinct_words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([list(set(words_of(t))) for t in batch], dtype=object)


def feature_column(spark, text: Column, ordinary: bytes, toxic: bytes) -> Column:
    dictionaries = spark.sparkContext.broadcast((ordinary, toxic))  # bounded by COMMON_WORDS and TOXIC_WORDS

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        excess = Excess(*dictionaries.value)
        for batch in texts:
            yield pd.Series([excess.features(t) for t in batch], dtype=object)

    return features(text)


def remainder(id_: Column, mod: int) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % mod


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int] = SAMPLE) -> dict:
    """The two dictionaries and the calibration, from labelled rows with remainder 0 or 2.

    Rows of labels with a null id or label count as unlabelled; of several for one id the largest
    counts. With labels of one kind only, or none, every score is the (smoothed) share of toxic rows.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(F.col(id_col), 3) != 1))
    marked = marked.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) == 1).alias("toxic"))
    n = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {kind: min(1.0, most / max(1, n.get(kind, 0))) for kind, most in zip((True, False), sample)}
    share = F.when(F.col("toxic"), F.lit(shares[True])).otherwise(F.lit(shares[False]))
    some = marked.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_003)) < share * 1_000_003)
    some = some.withColumn("fit", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)) > 0)
    # at most about sum(sample) rows of an id and two flags, whatever the input's size
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id"))
    words = rows.where("fit").select("toxic", F.explode(distinct_words("text")).alias("word"))
    counts = materialize(words.groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("o")).where("t >= 2 or o >= 2"))
    fit = {r.toxic: r.n for r in rows.where("fit").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nt, no = fit.get(True, 0), fit.get(False, 0)
    ratio = (F.col("t") / F.lit(max(1, nt))) / ((F.col("o") + 0.5) / F.lit(max(1, no)))
    common = counts.orderBy(F.desc("o"), "word").limit(COMMON_WORDS).where("o > 0").collect()
    toxic = counts.where((F.col("t") >= LEAST_DOCS) & (ratio >= LEAST_RATIO)).orderBy(F.desc("t"), "word").limit(TOXIC_WORDS).collect()
    ordinary = b" " + b" ".join(bytes(r.word) for r in reversed(common)) + b" "
    special = ordinary + b" ".join(bytes(r.word) for r in reversed(toxic)) + b" "
    held = rows.where(~F.col("fit")).select("toxic", feature_column(spark, F.col("text"), ordinary, special).alias("f")).collect()
    y = np.array([float(r.toxic) for r in held])
    if len(set(y)) < 2:
        prior = (n.get(True, 0) + 0.5) / (sum(n.values()) + 1)
        weights = np.array([0.0] * 5 + [np.log(prior / (1 - prior))])
    else:
        weights = logistic(design(np.array([r.f for r in held])), y, np.array([1 / shares[r.toxic] for r in held]))
    return {"ordinary": ordinary, "toxic": special, "weights": weights.tolist()}


def score_toxicity(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col (0 to 1) added or replaced. Null, empty and wordless texts have no excess and
    get the calibration's score for that; repeated rows score alike; an empty table stays empty."""
    f = free_name(docs, "features")
    out = docs.withColumn(f, feature_column(docs.sparkSession, F.col(text_col), model["ordinary"], model["toxic"]))
    w = model["weights"]
    x = [F.get(f, 0), F.get(f, 1), F.log1p(100 * F.get(f, 2)), F.log1p(F.get(f, 3)), F.log1p(F.get(f, 4))]
    z = sum((F.lit(wi) * xi for wi, xi in zip(w, x)), F.lit(w[5]))
    return out.withColumn(score_col, 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).drop(f)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
