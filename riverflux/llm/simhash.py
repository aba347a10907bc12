"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two 64-bit fingerprints link at RADIUS = 3 differing bits or fewer. The 64 bits are cut into three
blocks. Whatever the three differing bits are, some block holds at least one of them, so with that
block deleted the rest differ in two bits at most, and the balls of half that radius (1) around both
meet in a common variant. For each deleted block, each distinct rest therefore emits itself
and all its one-bit neighbours: 132 variants in all, where undivided balls would need 2 146. Variants are
shuffled as keys; as a variant's rests are its own one-bit neighbours, no key has more than 44 of them, however many
fingerprints share a rest. Pairs of rests that meet are deduplicated, and then the fingerprints of
both are compared on all 64 bits.

Only distinct fingerprints are hashed, so a group of exact copies counts as one row however large.
Where more than NEAR fingerprints share a rest, they are not compared all with all but by the same method
within the deleted block: one emits its ball of radius 1 there, the other that of radius 2, so a
fingerprint has 23 and 254 keys at most and no group is compared as a whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from riverflux.llm.common import connected_components, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS = 3
SHINGLE = 3
SEED = 42
NEAR = 32
#: First bit and width of the three deleted blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer; a text without words has zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint_of(t) for t in batch], dtype="int64")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def flipped(value: Column, masks: list[int]) -> Column:
    """Array of the value with each mask's bits flipped."""
    return F.transform(F.array(*[F.lit(signed(x)) for x in masks]), lambda x: value.bitwiseXOR(x))


def ball_masks(bits: list[int], radius: int) -> list[int]:
    """What to flip to reach all within radius (0 to 2) of a value in some of its bits."""
    out = [0] + [1 << a for a in bits if radius]
    return out + [1 << a | 1 << b for i, a in enumerate(bits) for b in bits[:i] if radius == 2]


def linked(fps: DataFrame, near: int = NEAR) -> DataFrame:
    """Columns a < b: all pairs of distinct fingerprints at RADIUS or fewer differing bits.

    fps: column fp, distinct longs.
    """
    found = []
    for first, width in BLOCKS:
        inside, outside = list(range(first, first + width)), [b for b in range(64) if not first <= b < first + width]
        block = F.lit(signed(sum(1 << b for b in inside)))
        each = fps.select("fp", F.col("fp").bitwiseAND(F.bitwise_not(block)).alias("rest"))
        counts = materialize(each.groupBy("rest").agg(F.count("*").alias("n")))
        variants = counts.select("rest", F.explode(flipped(F.col("rest"), ball_masks(outside, 1))).alias("key"))
        before = F.collect_list("rest").over(Window.partitionBy("key").orderBy("rest").rowsBetween(-len(outside) - 1, -1))
        met = variants.select("rest", before.alias("before")).where(F.size("before") > 0)
        pairs = met.select(F.explode("before").alias("r1"), F.col("rest").alias("r2")).distinct().unionByName(counts.where("n > 1").select(F.col("rest").alias("r1"), F.col("rest").alias("r2")))
        side = lambda i: counts.select(F.col("rest").alias(f"r{i}"), F.col("n").alias(f"n{i}"))
        pairs = materialize(pairs.join(side(1), "r1").join(side(2), "r2"))
        ends = [each.select(F.col("rest").alias(f"r{i}"), F.col("fp").alias(c)) for i, c in ((1, "a"), (2, "b"))]
        few = pairs.where((F.col("n1") <= near) & (F.col("n2") <= near)).select("r1", "r2")
        some = few.join(ends[0], "r1").join(ends[1], "r2").select("a", "b")
        dense = pairs.where((F.col("n1") > near) | (F.col("n2") > near)).select("r1", "r2")
        if not dense.isEmpty():
            one = dense.join(ends[0], "r1").select("r1", "r2", "a", F.explode(flipped(F.col("a").bitwiseAND(block), ball_masks(inside, 1))).alias("key"))
            two = dense.join(ends[1], "r2").select("r1", "r2", "b", F.explode(flipped(F.col("b").bitwiseAND(block), ball_masks(inside, 2))).alias("key"))
            some = some.unionByName(one.join(two, ["r1", "r2", "key"]).select("a", "b"))
        some = some.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        found.append(some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """One row per row of docs: the id, fp (long) and component_id, the smallest id reachable by links.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows give
    repeated rows. A row with a null id takes its group's smallest id (null if none has one). An empty
    table gives no rows. Other columns of docs are not read.
    """
    marked = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")))
    each = materialize(marked.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    pairs = materialize(linked(each.select("fp"), near))
    groups = connected_components(pairs)
    named = each.join(groups, each.fp == groups.node, "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("group"), F.col("component").isNotNull().alias("has_links"))
    several = materialize(named.where("n > 1 or has_links"))
    lowest = several.groupBy("group").agg(F.min("first").alias("component_id"))
    known = materialize(several.join(lowest, "group").select("fp", "component_id"))
    return marked.join(known, "fp", "left").select(F.col("id").alias(id_col), "fp", F.coalesce("component_id", "id").alias("component_id"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
