"""Language identification by rank-order profiles (Cavnar and Trenkle).

A profile is the list of a language's PROFILE most frequent letter n-grams (1 to 3 letters, word
boundaries marked), in order. A document's own list is compared to each: an n-gram's out-of-place
distance is how far its two ranks differ, or PROFILE where the language's list lacks it. The language
with the smallest sum is predicted. Counts for the profiles cover all training documents; each task
adds up its rows' n-grams before anything is shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverflux.llm.common import free_name, materialize
from riverflux.llm.toxicity import remainder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROFILE = 400
UNDETERMINED = "und"
#: Characters whose n-grams are counted at once, and distinct n-grams that a task holds per language.
CHUNK, HELD = 1 << 20, 1 << 20
#: A text that resembles no profile better than this is rejected by the filter.
LEAST_SCORE = 0.05


@lru_cache(1)
def letters() -> np.ndarray:
    """By code point up to 0xFFFF: its lower-case letter's code point, or 0 where it is no letter."""
    out = np.zeros(0x10000, dtype=np.int64)
    for c in range(0x10000):
        low = chr(c).lower()
        if chr(c).isalpha():
            out[c] = ord(low) if len(low) == 1 else c
    return out


def codes_of(text: str | None) -> np.ndarray:
    """The letters of a text as numbers, with one 0 for each run of other characters and at both ends.
    Letters beyond 0xFFFF are folded into 16 bits."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = letters()[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        codes[points == c] = 1 + (int(c) & 0xFFFE) if chr(int(c)).isalpha() else 0
    codes = np.concatenate(([0], codes, [0]))
    return codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]


def grams_of(codes: np.ndarray) -> np.ndarray:
    """n-grams of 1 to 3 letters as numbers; a 0 stands at an n-gram's ends only, and never alone."""
    one = codes[codes != 0] | (1 << 48)
    two = (codes[:-1] << 16 | codes[1:] | (2 << 48))[(codes[:-1] != 0) | (codes[1:] != 0)]
    three = (codes[:-2] << 32 | codes[1:-1] << 16 | codes[2:] | (3 << 48))[codes[1:-1] != 0]
    return np.concatenate((one, two, three))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts, a bounded piece at a time (pieces overlap by two letters)."""
    if len(codes) <= CHUNK:
        return np.unique(grams_of(codes), return_counts=True)
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(codes), CHUNK):
        piece = codes[max(0, at - 2) : at + CHUNK]
        k, c = np.unique(grams_of(piece), return_counts=True)
        if at:  # what lies wholly in the overlap is there twice
            k2, c2 = np.unique(grams_of(codes[max(0, at - 2) : at]), return_counts=True)
            c[np.searchsorted(k, k2)] -= c2
        keys, counts = merged(np.concatenate((keys, k)), np.concatenate((counts, c)))
    return keys, counts


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Columns lang, gram, n: the partition's sums."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[str, int] = {}

    def squeeze(lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = merged(*(np.concatenate(x) for x in zip(*held[lang])))
        held[lang], size[lang] = [(keys, counts)], 0
        return keys, counts

    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            part, n = [], 0
            for t in [*texts, None]:
                if t is not None:
                    part.append(codes_of(t))
                    n += len(part[-1])
                if part and (n >= CHUNK or t is None):
                    found = counted(np.concatenate(part))
                    held.setdefault(lang, []).append(found)
                    size[lang] = size.get(lang, 0) + len(found[0])
                    part, n = [], 0
                    if size[lang] >= HELD:
                        keys, counts = squeeze(lang)
                        if len(keys) >= HELD:
                            yield pd.DataFrame({"lang": lang, "gram": keys, "n": counts})
                            held[lang] = []
    for lang in [x for x in held if held[x]]:
        keys, counts = squeeze(lang)
        yield pd.DataFrame({"lang": lang, "gram": keys, "n": counts})


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Each language's n-grams in order, from rows with a text, a language and a remainder other than 2.

    The driver gets PROFILE numbers per language. No such rows give no profiles."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (remainder(F.col(id_col), 4) != 2))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInPandas(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), "gram"]
    few = counts.withColumn("at", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order))).where(F.col("at") <= PROFILE)
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("at") <= PROFILE)
    out: dict[str, list[int]] = {}
    for r in sorted(few.select("lang", "gram", "at").collect(), key=lambda r: (r.lang, r.at)):
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.keys = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = codes_of(text)
        if not self.langs or not codes.any():
            return UNDETERMINED, 0.0
        keys, counts = counted(codes)
        own = keys[np.argsort(-counts, kind="stable")[:PROFILE]]
        at = np.searchsorted(self.keys, own)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != own] = len(self.keys)
        ranks = self.ranks[:, at]
        apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(apart))  # of equally near ones the first by name
        return self.langs[best], 1.0 - float(apart[best]) / (PROFILE * len(own))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced).

    The score is 1 less the distance over the largest possible one. Null, empty and letterless texts,
    and all texts if there are no profiles, are `und` with score 0. Repeated rows are judged alike."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE numbers per language

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Profiles(sent.value)
        for batch in texts:
            yield pd.DataFrame([known.predict(t) for t in batch], columns=["lang", "score"])

    own = free_name(docs, "judged")
    out = docs.withColumn(own, judge(F.col(text_col)))
    return out.withColumns({"lang_pred": F.col(own)["lang"], "score": F.col(own)["score"]}).drop(own)


def op4_rank_profiles(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn_profiles(docs)
    out = identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
