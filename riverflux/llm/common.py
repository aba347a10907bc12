"""Helpers shared by the corpus operators: shared scratch tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverflux.scratch import delete, note

_own_scratch: dict[str, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space, the separators of the word pattern [^\x20\x09-\x0D]+
WHITE = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; plain lower() does just that where all of the text is ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def words(text: Column, separator: str = WHITE) -> Column:
    """The non-empty pieces between separators; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores, whichever no column of df has (column names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local session may do without one and gets a temporary folder:
    on a cluster each machine would have its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "path" not in _own_scratch:
            _own_scratch["path"] = tempfile.mkdtemp(prefix="spark-scratch-")
        path = _own_scratch["path"]
    return path.rstrip("/")


def materialize(df: DataFrame, kept: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends here, so a lost
    executor costs a file read and not a recomputation, and several consumers share one pass. The table goes at the
    end of the innermost scratch.temporary_tables(), unless it is to be kept."""
    path = f"{scratch_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    if not kept:
        note(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing lazy reads them any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            delete(df.sparkSession, path)


def long_array(values) -> Column:
    """An array<bigint> constant from one string literal, folded by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node, component (the smallest node reachable), one row per node that has an edge.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in
    MapReduce and Beyond": every step is a min aggregate (combined before its shuffle) and a join of
    two written tables, which adaptive execution splits where one node has many edges. No component
    is ever gathered in one task. Loops and null ends are ignored; no edges give no rows.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    cur = materialize(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    while True:
        if cur.isEmpty():
            return with_roots(cur)
        both = materialize(cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")))
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        discard(cur, both, low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(large, low)
        several = cur.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        parents = cur.select(F.col("v").alias("u")).distinct()
        if several.isEmpty() and cur.join(parents, "u", "left_semi").isEmpty():
            return with_roots(cur)


def with_roots(stars: DataFrame) -> DataFrame:
    """node, component of finished stars (u under its root v), the roots included."""
    roots = stars.select(F.col("v").alias("u"), "v").distinct()
    return stars.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


#: A group of this share of all rows or more is heavy; so many groups at most are.
HEAVY_SHARE = 1024


def join_groups(rows: DataFrame, groups: DataFrame, keys: dict[str, str], n: str, total: int) -> DataFrame:
    """rows with the columns of their group but n; groups has one row for each key. keys: column of rows -> of groups.

    n is a group's number of rows. The groups of a HEAVY_SHARE-th of total or more are HEAVY_SHARE at most for each
    thing that a row is counted in; they are broadcast, so their rows stay where they are, and the others are shuffled.
    Nulls equal nulls. rows is read twice and should be a table."""
    heavy = F.col(n) * HEAVY_SHARE >= total
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()]
    drop = [n, *(b for a, b in keys.items() if a != b)]
    few, many = groups.where(heavy), groups.where(~heavy)
    near = rows.join(F.broadcast(few), on)
    far = rows.join(F.broadcast(few.select(*keys.values())), on, "left_anti").join(many, on)
    return near.drop(*drop).unionByName(far.drop(*drop))


def bit(at: Column) -> Column:
    """A long with bit at (mod 64) set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def has_bit(array: Column, at: Column) -> Column:
    """Whether bit at of an array of longs is set."""
    return F.get(array, F.shiftright(at, 6).cast("int")).bitwiseAND(bit(at)) != 0
