"""Vector code compression: equal integer parts are counted once, and Lloyd runs over the distinct ones with weights.

A vector's components become integers and are cut into equal consecutive parts. Equal parts of one position
become one row with a count (combined before the shuffle, so a vector that a third of all rows hold costs one row a
task). A codebook for each position is fitted over these rows: tasks sum up the counted parts of each entry
and give a row for each, so the driver gets as many numbers as the codebooks have. At last each distinct part
has its entry and squared error, which are joined back to the vectors.

All arithmetic is of whole numbers and exact, so results don't depend on partitions.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverflux.llm.common import discard, join_groups, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Distinct parts whose distances to a codebook are held at once.
BLOCK = 4096


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, held within what squared distances can bear: 2**62 for a whole vector."""
    bound = F.floor(F.lit(2.0**30) / F.sqrt(F.greatest(F.size(vector), F.lit(1)).cast("double")))
    held = lambda x: F.greatest(-bound, F.least(bound, F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-(2.0**31))), F.lit(2.0**31)))))
    return F.transform(vector, lambda x: held(x).cast("int"))


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are numbers."""
    good = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, good), F.lit(False))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry nearest to each part, of equally near ones the first, and the squared distance."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * parts.shape[1] * most * most < 1 << 53 else np.int64  # floats of this size are exact, and faster
    x, c = parts.astype(kind), book.astype(kind)
    codes, errors = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    lengths = (c * c).sum(1)
    for i in range(0, len(x), BLOCK):
        b = x[i : i + BLOCK]
        d = (b * b).sum(1)[:, None] - 2 * (b @ c.T) + lengths
        codes[i : i + BLOCK] = at = d.argmin(1)
        errors[i : i + BLOCK] = d[np.arange(len(b)), at]
    return codes, errors


def by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """position, rows of the batch, and their parts as a matrix."""
    if batch.num_rows:
        pos, flat = batch.column("pos").to_numpy(zero_copy_only=False), batch.column("part").flatten().to_numpy(zero_copy_only=False)
        parts = flat.reshape(batch.num_rows, -1).astype(np.int64)
        for p in np.unique(pos):
            at = np.flatnonzero(pos == p)
            yield int(p), at, parts[at]


def sum_up(books: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos, entry, n, total (array): the counted parts of each entry in this task."""
    sums, counts = np.zeros(books.value.shape, np.int64), np.zeros(books.value.shape[:2], np.int64)
    for batch in batches:
        weight = batch.column("n").to_numpy(zero_copy_only=False)
        for p, at, parts in by_position(batch):
            code, _ = nearest(parts, books.value[p])
            np.add.at(counts[p], code, weight[at])
            np.add.at(sums[p], code, parts * weight[at][:, None])
    pos, entry = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[pos, entry]), pa.array(list(sums[pos, entry]), pa.list_(pa.int64()))], ["pos", "entry", "n", "total"])


def encode(books: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct parts with their code and error."""
    for batch in batches:
        code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
        for p, at, parts in by_position(batch):
            code[at], error[at] = nearest(parts, books.value[p])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], [*batch.schema.names, "code", "error"])


def first_entries(vectors: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest ids (of several vectors with one id the smallest), as entries x components."""
    ids = [r.id for r in vectors.where("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]  # a codebook's size
    rows = vectors.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect() if ids else []
    return np.array([r.v for r in rows], np.int64)


def fit_codebooks(distinct: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (position x entry x component) after so many rounds of weighted Lloyd over distinct (pos, part, n).

    Means are rounded down; an entry that nothing is nearest to stays as it is."""
    size = books.shape[2]
    for _ in range(rounds):
        sent = distinct.sparkSession.sparkContext.broadcast(books)
        sums = distinct.mapInArrow(partial(sum_up, sent), "pos int, entry int, n long, total array<long>")
        found = sums.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", j)).alias(f"t{j}") for j in range(size)]).collect()  # a row for each entry
        books = books.copy()
        for r in found:
            books[r.pos, r.entry] = [r[f"t{j}"] // r.n for j in range(size)]
        sent.unpersist()
    return books


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """A table id, label, code (two hex digits a part), error of the vectors, and the codebooks.

    Vectors that are null or hold a null, a NaN or an infinity are dropped, and so are those whose length is not
    the table's most common one among those that parts divides (of equally common ones the shortest), as they can't share
    its codebooks. Repeated rows each have a row; several vectors with one id are coded one by one, and the smallest
    starts the codebook. Null ids are coded, but start no entry; with fewer ids than entries the codebook is
    smaller; without any the table is empty and there is no codebook. Components beyond 2**30 / sqrt(length) after
    scaling are held there. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = materialize(rows.where(finite(F.col("v"))).select("id", "label", whole_numbers(F.col("v")).alias("v"), F.monotonically_increasing_id().alias("row")))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).where((F.col("size") > 0) & (F.col("size") % parts == 0))
    common = sizes.orderBy(F.desc("n"), "size").first()
    start = first_entries(rows.where(F.size("v") == common["size"]), entries) if common else np.empty((0, 0))
    if not len(start):
        return materialize(rows.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))), None

    width = common["size"] // parts
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * width + 1, width))).alias("pos", "part")
    kept = rows.where(F.size("v") == common["size"]).select("id", "label", "row", cut)
    distinct = materialize(kept.groupBy("pos", "part").agg(F.count("*").alias("n")))
    books = fit_codebooks(distinct, start.reshape(len(start), parts, width).transpose(1, 0, 2), rounds)
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    coded = materialize(distinct.mapInArrow(partial(encode, sent), "pos int, part array<int>, n long, code int, error long"))

    joined = join_groups(kept, coded.withColumnsRenamed({"pos": "at", "part": "equal"}), {"pos": "at", "part": "equal"}, "n", common["n"])
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == p, F.col("code"))))), 2, "0") for p in range(parts)]
    out = materialize(joined.groupBy("row", "id", "label").agg(F.concat(*digits).alias("code"), F.sum("error").alias("error")).drop("row"))
    discard(rows, distinct, coded)
    return out, books


def text_of(books: np.ndarray) -> str:
    """All entries' components in order of position, entry and component."""
    return ",".join(map(str, books.ravel().tolist()))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error (null beyond a long), codebooks_sha256."""
    coded, books = compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(text_of(books).encode() if books is not None else b"").hexdigest()
    labels = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")))
    out = join_groups(coded, labels, {"label": "of"}, "n", coded.count())
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """Each round's assignments and codebook as tables."""
    assign = "SELECT pos, part, n, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT d.pos AS pos, d.part AS part, d.n AS n, b.e AS e, list_inner_product(d.part, d.part) - 2 * list_inner_product(d.part, b.c) + list_inner_product(b.c, b.c) AS d FROM d JOIN b{r} b ON b.pos = d.pos) GROUP BY 1, 2, 3"
    means = "SELECT pos, e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT pos, e, i, sum(n * part[i]) AS s, sum(n) AS n FROM a{r}, range(1, (SELECT w + 1 FROM size)) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2"
    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({assign.format(r=r)})")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.pos AS pos, b.e AS e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN ({means.format(r=r)}) m ON m.pos = b.pos AND m.e = b.e)")
    return ",\n".join([*steps, f"last AS MATERIALIZED ({assign.format(r=ROUNDS)})"])


OP11_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER () AS id, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS MATERIALIZED (SELECT max(len(v)) // {PARTS} AS w FROM k),
p AS MATERIALIZED (SELECT id, vec_id, label, t.pos AS pos, v[t.pos * w + 1 : t.pos * w + w] AS part FROM k, size, range({PARTS}) t(pos)),
d AS MATERIALIZED (SELECT pos, part, count(*) AS n FROM p GROUP BY 1, 2),
b0 AS MATERIALIZED (SELECT pos, e, part AS c FROM (SELECT pos, part, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {ENTRIES}),
{_rounds_sql()},
coded AS (SELECT id, vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p.pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM p JOIN last ON last.pos = p.pos AND last.part = p.part GROUP BY 1, 2, 3),
labels AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY 1),
sha AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY pos, e, i)) AS codebooks_sha256 FROM b{ROUNDS}, range(1, (SELECT w + 1 FROM size)) t(i))
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM coded JOIN labels ON coded.label IS NOT DISTINCT FROM labels.label, sha
"""
