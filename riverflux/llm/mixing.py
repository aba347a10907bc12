"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Its documents' expected copies follow an inclusion weight that falls with
the length (by powers of two), so that a source's words come from many documents; they are scaled to meet the
target and none is above MOST_COPIES. The whole part of a document's expected copies is certain; the fraction p
that is left is its inclusion probability. Documents are ranked by their random odds u/(1-u) divided by their
inclusion odds p/(1-p), and the first ones are taken until the source's target is met (Rosén's Pareto
order sampling, with the fixed size counted in words). u comes from a hash of the id, so reruns agree.

No source is ever ordered in one task: the cut in the ranking is found by two histograms of partial
sums (2**10 bins of the ranking variable, then 2**10 bins within the one in which the cut lies, per source), and
only the rows of that last bin, a millionth of a source, are ordered, equal rows as one with a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverflux.llm.common import WHITE, materialize

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
SEED = 42
#: Bits of the hash that u is made of, and of one histogram of the ranking variable.
HASH_BITS, BIN_BITS = 52, 10
#: A document of n bits in its word count has the inclusion weight LONGEST - n, at least 1.
LONGEST = 24
#: Equal rows that one row of a task's input stands for when a group of them is written out again.
CHUNK = 10_000


def size_of(text: Column) -> Column:
    """Number of words: where a separator is left at either end, the split has an empty piece."""
    pieces = F.split(F.coalesce(text, F.lit("")), WHITE)
    return (F.size(pieces) - (F.element_at(pieces, 1) == "").cast("int") - ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from sizes (source, words; one row for each source): shares by weight in the
    order of the sources, nulls last, capped at most * size, the excess shared again by weight until no target
    is above its cap. The sources that fill up first are capped first; the others share what is left."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    rows = sizes.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1))
    rows = rows.withColumn("cap", most * F.col("words")).withColumn("full", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("full", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per source
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"capped": F.sum("cap").over(filling) - F.col("cap"), "open": F.sum("weight").over(every) - F.sum("weight").over(filling) + F.col("weight"), "total": F.lit(float(total_share)) * F.sum("words").over(every)})
    level = (F.col("total") - F.col("capped")) / F.col("open")
    fits = level <= F.col("full")
    rows = rows.withColumn("level", F.min_by(F.when(fits, level), F.when(fits, F.struct("full", "place"))).over(every))
    return rows.select("source", F.col("words").alias("source_size"), F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def expected_copies(classes: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """s, k, source_size, target, copies (certain), p (inclusion probability), rest (words left to the sampling) of
    each source and class of sizes (classes: source, k, words). Classes with the largest weights reach the most copies first."""
    rows = classes.join(targets.withColumnRenamed("source", "s"), classes["source"].eqNullSafe(F.col("s"))).drop("source").withColumn("g", F.greatest(F.lit(1), LONGEST - F.col("k")).cast("long"))
    upto = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 64 classes
    of_source = Window.partitionBy("s")
    worth, cap = F.col("g") * F.col("words"), most * F.col("words")
    rows = rows.withColumns({"capped": F.sum(cap).over(upto) - cap, "open": F.sum(worth).over(of_source) - F.sum(worth).over(upto) + worth})
    level = F.try_divide(F.col("target") - F.col("capped"), F.col("open"))
    rows = rows.withColumn("level", F.min_by(F.when(level <= F.lit(float(most)) / F.col("g"), level), F.when(level <= F.lit(float(most)) / F.col("g"), F.col("k"))).over(of_source))
    rows = rows.withColumn("expected", F.when(F.col("words") == 0, 0.0).otherwise(F.least(F.lit(float(most)), F.coalesce(F.col("g") * F.col("level"), F.lit(float(most))))))
    rows = rows.withColumn("copies", F.floor("expected").cast("long"))
    return rows.select("s", "k", "source_size", "target", "copies", (F.col("expected") - F.col("copies")).alias("p"), (F.col("target") - F.sum(F.col("copies") * F.col("words")).over(of_source)).alias("rest"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target and taken (words, repeats counted), and the
    columns named in keep, but for those that are called like one of these.

    A null source is a source of its own, the last. Null, empty and blank texts have size 0 and
    taken 0. Rows without an id rank by their text. Rows with one id in one source and of one size rank alike; rows
    that agree in all columns of the result are one group of the ranking, of which as many are taken as fit, so no
    mass of equal rows is ordered. A source of size 0 has target 0; an empty table gives no rows. Tables of one row
    for each source and class of sizes are broadcast if Spark finds them small, and joined by a shuffle otherwise.
    """
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rank = F.conv(F.substring(F.md5(F.concat_ws(":", own, F.lit(str(seed)))), 1, HASH_BITS // 4), 16, 10).cast("long")
    size = size_of(F.col(text_col))
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(0)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), rank.alias("rank"), kept.alias("kept"))
    rows = materialize(rows.withColumn("k", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)))
    classes = materialize(rows.groupBy("source", "k").agg(F.sum("size").alias("words")))
    plan = materialize(expected_copies(classes, source_targets(classes.groupBy("source").agg(F.sum("words").alias("words")))))

    ranked = rows.withColumnRenamed("k", "own_k").join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("own_k") == F.col("k")))
    u = (F.col("rank") + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = ranked.withColumn("order", F.when(F.col("p") > 0, odds / (1 + odds)))
    bin_of = lambda level: F.floor(F.col("order") * F.lit(float(1 << BIN_BITS * level)))
    cut = plan.select(F.col("s").alias("cs"), F.lit(0).cast("long").alias("cut"), F.col("rest").alias("left")).distinct()
    for level in (1, 2):
        inside = ranked.select("source", "order", "size").join(cut, F.col("source").eqNullSafe(F.col("cs")) & (bin_of(level - 1) == F.col("cut")))
        bins = inside.groupBy("source", bin_of(level).alias("bin"), "left").agg(F.sum("size").alias("words"))
        below = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
        bins = bins.withColumn("below", below).where("below < left")
        cut = bins.groupBy(F.col("source").alias("cs")).agg(F.max_by(F.struct("bin", (F.col("left") - F.col("below")).alias("left")), "bin").alias("c")).select("cs", F.col("c.bin").alias("cut"), F.col("c.left").alias("left"))
        cut = materialize(cut)  # one row for each source that samples

    all_rows = ranked.join(cut, F.col("source").eqNullSafe(F.col("cs")), "left")
    result = ["id", "source", "size", "source_size", "target", "copies", "kept"]
    sure = all_rows.where(F.col("order").isNull() | F.col("cut").isNull() | (bin_of(2) != F.col("cut")))
    sure = sure.select(*result, F.coalesce((bin_of(2) < F.col("cut")).cast("long"), F.lit(0).cast("long")).alias("more"))
    last = all_rows.where(bin_of(2) == F.col("cut")).groupBy(*result, "order", "left").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("order", "size", "id", F.xxhash64("kept")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("upto", F.sum(F.col("n") * F.col("size")).over(w)).withColumn("before", F.col("upto") - F.col("n") * F.col("size"))
    # a document goes in when that comes nearer to the target than leaving it out
    one = (F.col("left") - F.col("before") > F.col("upto") - F.col("left")).cast("long")
    several = F.greatest(F.lit(0), F.least(F.col("n"), F.ceil((F.col("left") - F.col("before")) / F.col("size") + 0.5) - 1)).cast("long")
    last = last.withColumn("fit", F.when(F.col("n") == 1, one).otherwise(several))
    # groups of equal rows are written out again in chunks that are dealt to all tasks
    last = last.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))).repartition(F.xxhash64("id", "order", "chunk"))
    each = F.explode(F.sequence(F.col("chunk") * CHUNK + 1, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK)))
    last = last.withColumn("copy", each).select(*result, (F.col("copy") <= F.col("fit")).cast("long").alias("more"))
    taken = F.col("size") * F.least(F.col("copies") + F.col("more"), F.lit(MOST_COPIES))
    return sure.unionByName(last).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), *[F.col("kept")[c].alias(c) for c in keep if c not in (id_col, source_col, "size", "source_size", "target", "taken")])


def op5_pareto_mix(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) || ':42'), 1, 13) AS BIGINT) AS rank
  FROM documents),
dk AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS k FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (
  SELECT *, 2 * source_size / weight AS ratio,
         sum(2 * source_size) OVER f - 2 * source_size AS capped, sum(weight) OVER () - sum(weight) OVER f + weight AS open_weight, sum(source_size) OVER () AS everything
  FROM w WINDOW f AS (ORDER BY 2 * source_size / weight, i ROWS UNBOUNDED PRECEDING)),
level AS (SELECT arg_min((1.5::DOUBLE * everything - capped) / open_weight, capped) AS v FROM o WHERE (1.5::DOUBLE * everything - capped) / open_weight <= ratio),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * v) AS target FROM w, level),
c AS (SELECT dk.source AS source, k, greatest(1, 24 - k) AS g, CAST(sum(size) AS BIGINT) AS words, any_value(source_size) AS source_size, any_value(target) AS target
      FROM dk JOIN t ON dk.source IS NOT DISTINCT FROM t.source GROUP BY 1, 2),
co AS (SELECT *, sum(2 * words) OVER f - 2 * words AS capped, sum(g * words) OVER (PARTITION BY source) - sum(g * words) OVER f + g * words AS open
       FROM c WINDOW f AS (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING)),
cl AS (SELECT source, arg_min((target - capped) / nullif(open, 0), k) AS v FROM co WHERE (target - capped) / nullif(open, 0) <= 2.0::DOUBLE / g GROUP BY source),
e AS (SELECT c.*, CASE WHEN words = 0 THEN 0.0::DOUBLE ELSE least(2.0::DOUBLE, coalesce(g * v, 2.0::DOUBLE)) END AS expected FROM c LEFT JOIN cl ON c.source IS NOT DISTINCT FROM cl.source),
p AS (SELECT *, floor(expected) AS copies, expected - floor(expected) AS p, target - sum(CAST(floor(expected) AS BIGINT) * words) OVER (PARTITION BY source) AS rest FROM e),
u AS (SELECT doc_id, dk.source AS source, size, source_size, target, copies, p, rest, (rank + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
      FROM dk JOIN p ON dk.source IS NOT DISTINCT FROM p.source AND dk.k = p.k),
r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM u),
q AS (SELECT *, sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds / (1 + odds), size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, size, source_size, target,
       CAST(size * least(copies + CASE WHEN odds IS NOT NULL AND rest - (upto - size) > upto - rest THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM q
"""
