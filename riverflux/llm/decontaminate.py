"""Benchmark decontamination by winnowing.

Texts are words; the hash of every GRAM = 6 consecutive words is taken, and in each window of
SPAN = 5 consecutive hashes the smallest is kept as a fingerprint (all equally small ones). A span of
GRAM + SPAN - 1 = 10 words that a document shares with a benchmark item holds one such window,
whose smallest hash is a fingerprint of both, so a join of the fingerprints meets every shared span of
ten words or more. Each hit is then extended on both sides, which makes it exact.

The words of a document never leave its row: a bit filter over the benchmark's fingerprints, sent
as a constant of bounded size, decides in the row which fingerprints can join, and only those are
exploded, with the words around them. False positives of the filter cost a row each and are
dropped by the join. Each hit is extended to the windows of ten words around it, and these are joined, each once however
many items have it; items come in groups that have the same windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverflux.llm.common import ascii_lower, bit, has_bit, long_array, materialize, words

NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 6
SPAN = WINDOW - GRAM + 1
#: Bits of the filter: 16 for each fingerprint, this many at most (beyond, it lets more rows through).
MAX_BITS = 1 << 23
PROBES = 4
#: Most fingerprint rows of the benchmark that are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 50_000


def grams(w: Column, n: int) -> Column:
    """The hash of each n consecutive words; empty where there are fewer."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
    return F.when(F.size(w) >= n, each).otherwise(F.array().cast("array<bigint>"))


def winnowed(g: Column, i: Column) -> Column:
    """Whether hash i is the smallest in one of the windows of SPAN hashes that hold it."""
    first, last = F.greatest(i - SPAN + 1, F.lit(0)), F.least(i, F.size(g) - SPAN)
    windows = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.exists(windows, lambda j: F.array_min(F.slice(g, j + 1, SPAN)) == F.get(g, i))


def around(w: Column, i: Column, before: int, n: int) -> Column:
    """n words from before words ahead of i on; null beyond either end."""
    return F.transform(F.sequence(i - before, i - before + n - 1), lambda j: F.get(w, j))


def hits(w: Column, g: Column, n: int, keep) -> Column:
    """array of (n, h, at, near) for the positions that keep(g, i) lets through; n = 0: winnowed."""
    at = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: keep(g, i))
    at = F.when(F.size(g) > 0, at).otherwise(F.array().cast("array<int>"))
    near = (lambda i: around(w, i, SPAN - 1, WINDOW + SPAN - 1)) if n == 0 else (lambda i: around(w, i, 0, n))
    return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), F.get(g, i).alias("h"), i.alias("at"), near(i).alias("near")))


def places(bits: int, h: Column) -> list[Column]:
    return [F.pmod(F.shiftright(h, 11 * k), F.lit(bits)) for k in range(PROBES)]


def bit_filter(hashes: DataFrame):
    """A function of a hash column: False only if the hash is not among hashes (column h)."""
    n = hashes.count()
    bits = min(MAX_BITS, 64 * max(1, n // 4))
    at = hashes.select(F.explode(F.array(*places(bits, F.col("h")))).alias("at"))
    rows = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(bit(F.col("at"))).alias("ones"))
    values = [0] * (bits // 64)
    for r in rows.collect():  # bits / 64 rows at most
        values[r.word] = r.ones
    array = long_array(values)

    def maybe(h: Column) -> Column:
        test = F.lit(True)
        for at in places(bits, h):
            test = test & has_bit(array, at)
        return test

    return maybe


def extended(n: str, near: str) -> Column:
    """array of (shift, win) of the windows around a hit whose words are all there; win tells windows apart."""
    win = lambda w: F.md5(F.concat_ws(" ", F.col(n).cast("string"), w))  # noqa: E731  words hold no spaces
    whole = lambda w: F.forall(w, lambda x: x.isNotNull())
    shifts = F.filter(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda j: whole(F.slice(near, j + 1, WINDOW)))
    around_ = F.transform(shifts, lambda j: F.struct(j.alias("shift"), win(F.slice(near, j + 1, WINDOW)).alias("win")))
    return F.when(F.col(n) == 0, around_).otherwise(F.array(F.struct(F.lit(0).alias("shift"), win(F.col(near)).alias("win"))))


def item_groups(owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """win, group of windows that the same items have, and group, item: so a passage that many items share is one group
    and not a row for each of them. A window of items without an id has a group without members. Sets of items are told apart by their size and two sums of hashes."""
    sums = [F.sum(F.when(F.col("item").isNotNull(), F.xxhash64("item", F.lit(i)).cast("decimal(38,0)"))).cast("string") for i in (1, 2)]
    signed = owners.groupBy("win").agg(F.concat_ws("/", F.count("item").cast("string"), *sums).alias("group"))
    signed = materialize(signed)
    shown = signed.groupBy("group").agg(F.min("win").alias("win"))
    members = materialize(owners.where("item is not null").join(shown, "win").select("group", "item"))
    return signed, members


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_hit (words inside a window of an item), n_items and
    items_sha256 (of the items that have a window in the document), contaminated.

    A window is WINDOW consecutive words of an item, or all words of a shorter one. Null, empty and
    wordless texts have no words and no windows, wordless items none either. Equal items count by
    their id; items without an id mark words but are not among the items. Repeated rows give repeated rows (hits are found for the pair of id and text, so rows
    with one id and different texts stay apart). Other columns are not read, but key, w and the
    like may be among them. Without items or documents the result has no hits or no rows.
    """
    bench = materialize(items.select(F.col(item_col).cast("string").alias("item"), words(ascii_lower(F.col(item_text)), NOT_A_WORD).alias("w")).where(F.size("w") > 0))
    short = sorted(r.n for r in bench.where(F.size("w") < WINDOW).select(F.size("w").alias("n")).distinct().collect())
    parts = [bench.where(F.size("w") >= WINDOW).withColumn("g", grams(F.col("w"), GRAM)).select("item", F.explode(hits(F.col("w"), F.col("g"), 0, winnowed)).alias("x"))]
    parts += [bench.where(F.size("w") == n).withColumn("g", grams(F.col("w"), n)).select("item", F.explode(hits(F.col("w"), F.col("g"), n, lambda g, i: F.lit(True))).alias("x")) for n in short]
    known = parts[0]
    for p in parts[1:]:
        known = known.unionByName(p)
    known = known.select("item", F.col("x.n").alias("n"), F.col("x.h").alias("h"), F.col("x.near").alias("near"))
    prints = materialize(known.select("n", "h").distinct())
    owners, members = item_groups(materialize(known.select("item", F.explode(extended("n", "near")).alias("x")).select("item", "x.win").distinct()))
    maybe = {n: bit_filter(prints.where(F.col("n") == n).select("h")) for n in [0, *short]}

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("key"), words(ascii_lower(text), NOT_A_WORD).alias("w"))
    rows = rows.withColumn("g0", grams(F.col("w"), GRAM))
    found = [hits(F.col("w"), F.col("g0"), 0, lambda g, i: maybe[0](F.get(g, i)) & winnowed(g, i))]
    for n in short:
        rows = rows.withColumn(f"g{n}", grams(F.col("w"), n))
        found.append(hits(F.col("w"), F.col(f"g{n}"), n, lambda g, i, n=n: maybe[n](F.get(g, i))))
    rows = materialize(rows.select("id", "key", F.size("w").cast("long").alias("n_words"), F.concat(*found).alias("found")))

    some = rows.where(F.size("found") > 0).select("id", "key", F.explode("found").alias("x")).select("id", "key", F.col("x.n").alias("n"), F.col("x.h").alias("h"), F.col("x.at").alias("at"), F.col("x.near").alias("near"))
    few = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    # fingerprints meet, then hits are extended to whole windows, which meet as they are: never with an item that only begins alike
    met = some.join(few(prints), ["n", "h"], "left_semi").select("id", "key", "n", "at", F.explode(extended("n", "near")).alias("x"))
    first = F.when(F.col("n") == 0, F.col("at") - SPAN + 1 + F.col("x.shift")).otherwise(F.col("at"))
    length = F.when(F.col("n") == 0, WINDOW).otherwise(F.col("n"))
    met = met.select("id", "key", F.col("x.win").alias("win"), first.alias("first"), length.alias("length"))
    windows = materialize(met.join(few(owners), "win").select("id", "key", "win", "group", "first", "length").distinct())
    groups = windows.groupBy("id", "key").agg(F.array_sort(F.collect_set("group")).alias("groups"))
    groups = materialize(groups.withColumn("set", F.sha2(F.array_join("groups", ","), 256)))
    # what items a set of groups has is found once for each set, however many documents have it
    sets = groups.groupBy("set").agg(F.first("groups").alias("groups")).select("set", F.explode("groups").alias("group")).join(members, "group").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sets = sets.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    named = groups.join(sets, "set", "left").select(F.col("id").alias("i2"), F.col("key").alias("k2"), "n_items", "sha")

    spans = windows.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("first", "length"))).alias("spans"))
    spans = spans.join(named, F.col("id").eqNullSafe(F.col("i2")) & F.col("key").eqNullSafe(F.col("k2")), "left")
    step = lambda acc, s: F.struct(  # noqa: E731  words covered so far, and up to where
        (acc["n"] + F.greatest(s["first"] + s["length"] - F.greatest(acc["to"], s["first"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["to"], s["first"] + s["length"]).cast("int").alias("to")
    )
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), step)["n"]
    spans = spans.select(F.col("id").alias("i"), F.col("key").alias("k"), n_hit.alias("n_hit"), "n_items", "sha")
    out = rows.select("id", "key", "n_words").join(spans, F.col("id").eqNullSafe(F.col("i")) & F.col("key").eqNullSafe(F.col("k")), "left")
    none = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"), F.col("key").alias("text_md5"),
    )


def op2_winnowing(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return contaminated(read("documents"), read("benchmark")).drop("text_md5")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, grams.n AS n, item FROM grams JOIN win USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
