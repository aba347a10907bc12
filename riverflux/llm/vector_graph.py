"""Near-duplicate vectors by robust-pruned flat graphs over overlapping cluster shards.

Vectors that are compared with each other (equal label, equal length) are dealt to the shard of their
nearest centroid, and as guests to all other shards that can hold one of their partners: a partner at home
there lies beyond the planes between that centroid and all others, so a shard is left out only if one of those
planes is farther away than the link radius. With that each link's ends meet in a shard whatever the vectors are
like. A large shard is searched in blocks of bounded size.

Each block is cut into clusters that overlap (a vector belongs to its nearest centroids); the near candidates of a
vector come from its cluster. Near and random candidates are thinned by robust pruning (a
candidate goes if a kept one is nearer to it by a factor than the vector itself), the clusters' adjacency lists are
united with their reverse arcs, and whatever the medoid does not reach is tied to what it does. A block's graph holds
the vectors at home there; guests only ask. Every member of a shard is then searched in its blocks: greedily from the
medoid (of each part, if a graph has several) with a beam, then outwards through all vectors in the range and a margin. The queries whose id is divisible by
AUDITED are audited by the exact product with their block, piece by piece: where the graph's recall falls short, the piece is searched
again with a wider beam, and compared as a whole only if the widest doesn't help. Found pairs are verified by
their cosine in double precision, and the recall of each run is logged.

Equal vectors are one class with a count. Links are counted in the block and only a spanning forest of
them leaves it, so no row count grows with the square of a group.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverflux.llm.common import connected_components, discard, let, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOG = logging.getLogger("riverflux.vectors")
COSINE = 0.98
#: Vectors of the sample that places the centroids, members a centroid should get, most centroids.
SAMPLE, SHARD, MOST_CENTROIDS = 16384, 5000, 4096
#: Most members of a block, queries of a task, and queries that are searched at once.
BLOCK, ASKED, PIECE = 6000, 1500, 500
#: Nearest centroids whose planes are tried to rule out a shard, distances to centroids that are held at once.
PLANES, DISTANCES = 8, 2_000_000
DEGREE, NEAR, FAR, ALPHA = 24, 32, 16, 1.2
#: Width of the beam, how often it may be doubled, and the recall that a piece's audited queries have to reach.
BEAM, DOUBLED, RECALL = 32, 3, 0.99
#: Queries with ids divisible by this are audited.
AUDITED = 20
#: Nearest clusters of a block that a vector belongs to, and rows up to which a block is one cluster.
OVERLAP, WHOLE = 3, 256
#: Chords up to this many link radii are followed when a search expands.
MARGIN = 1.5
#: Vectors that are audited over all others, across shards, where a caller asks for it.
AUDIT_ALL = 64


def centroids_of(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means on unit vectors, started from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    some = max(1, DISTANCES // k)
    for _ in range(rounds):
        near = np.concatenate([np.argmin((c * c).sum(1) - 2 * x[at : at + some] @ c.T, axis=1) for at in range(0, len(x), some)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances_between(c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1), 0))


def shards_of(x: np.ndarray, c: np.ndarray, radius: float, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, centroid) of every shard a row belongs to, its home first; no shard is left out that is the home of
    a point within the radius. apart: the distances between the centroids c."""
    d2 = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)
    home = np.argmin(d2, axis=1)
    apart = distances_between(c) if apart is None else apart
    every = np.arange(len(x))
    planes = np.argpartition(d2, PLANES - 1, axis=1)[:, :PLANES] if len(c) > PLANES else np.tile(np.arange(len(c)), (len(x), 1))
    beyond = np.ones(d2.shape, dtype=bool)
    for near in (home, *planes.T):
        beyond &= d2 - d2[every, near][:, None] <= 2 * apart[near] * (radius + 1e-9) + 1e-12
    beyond[every, home] = False
    rows, other = np.nonzero(beyond)
    return np.concatenate((every, rows)), np.concatenate((home, other))


def clusters_of(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows at home, all members) of each of a block's overlapping clusters; each row is at home in one."""
    every = np.arange(len(x))
    k = int(np.sqrt(len(x)) / 2) if len(x) > WHOLE else 1
    if k < 2:
        return [(every, every)]
    c = centroids_of(x, k, 3)
    d2 = (c * c).sum(1) - 2 * x @ c.T
    near = np.argpartition(d2, OVERLAP, axis=1)[:, :OVERLAP] if k > OVERLAP else np.tile(np.arange(k), (len(x), 1))
    home = np.argmin(d2, axis=1)
    member = np.zeros((k, len(x)), dtype=bool)
    member[near.T, every] = True
    return [(np.nonzero(home == j)[0], np.nonzero(member[j])[0]) for j in np.unique(home)]


def prune(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Adjacency lists of a robust-pruned graph in which the medoid reaches every row of x."""
    n = len(x)
    rng = np.random.default_rng(seed)
    kept_a, kept_b = [], []
    for own, members in ((rows[at : at + 256], m) for rows, m in clusters_of(x) for at in range(0, len(rows), 256)):
        sims = x[own] @ x[members].T
        near = np.argpartition(-sims, NEAR, axis=1)[:, : NEAR + 1] if len(members) > NEAR + 1 else np.tile(np.arange(len(members)), (len(own), 1))
        far = rng.integers(0, n, (len(own), FAR))
        cand = np.concatenate((members[near], far), axis=1)
        cosines = np.concatenate((np.take_along_axis(sims, near, axis=1), np.einsum("id,ijd->ij", x[own], x[far])), axis=1)
        d = np.sqrt(np.maximum(2 - 2 * cosines, 0))
        d[cand == own[:, None]] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, order, axis=1), np.take_along_axis(d, order, axis=1)
        v = x[cand]
        between = np.sqrt(np.maximum(2 - 2 * (v @ v.transpose(0, 2, 1)), 0))
        alive, degree = np.isfinite(d), np.zeros(len(own), dtype=int)
        for j in range(cand.shape[1]):
            take = alive[:, j] & (degree < DEGREE)
            degree += take
            kept_a.append(own[take])
            kept_b.append(cand[take, j])
            closer = ALPHA * between[:, j] <= d
            closer[:, : j + 1] = False
            alive &= ~(closer & take[:, None])
    a, b = np.concatenate(kept_a), np.concatenate(kept_b)
    pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
    lists = np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))
    seen, frontier = np.zeros(n, dtype=bool), [int(np.argmax(x @ x.sum(0)))]
    while True:
        while frontier:
            seen[frontier] = True
            frontier = [v for v in np.unique(np.concatenate([lists[u] for u in frontier])).astype(int) if not seen[v]]
        if seen.all():
            return lists
        u = int(np.nonzero(~seen)[0][0])
        inside = np.nonzero(seen)[0]
        v = int(inside[np.argmax(x[inside] @ x[u])])
        lists[u], lists[v] = np.append(lists[u], v), np.append(lists[v], u)
        frontier = [u]


def medoids(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A row near the middle of each part of a graph that arcs (table, -1 for none) hold together: one, if prune() made it."""
    left, out = np.arange(len(x)), []
    while len(left):
        frontier = left[[np.argmax(x[left] @ x[left].sum(0))]]
        out.append(frontier[0])
        seen = np.zeros(len(x), dtype=bool)
        while len(frontier):
            seen[frontier] = True
            found = np.unique(table[frontier])
            frontier = found[(found >= 0) & ~seen[found]]
        left = left[~seen[left]]
    return np.array(out)


def search(queries: np.ndarray, x: np.ndarray, lists: list[np.ndarray], cosine: float, beam: int) -> np.ndarray:
    """Boolean matrix of the rows of x that each query's search finds at the cosine or above."""
    n, m = len(x), len(queries)
    table = np.full((n, max(1, max(len(a) for a in lists))), -1)
    for i, a in enumerate(lists):
        table[i, : len(a)] = a
    small, q32 = x.astype(np.float32), queries.astype(np.float32)
    outer = 1 - (MARGIN * np.sqrt(2 - 2 * cosine)) ** 2 / 2
    starts = medoids(x, table)
    beam = min(max(beam, len(starts)), n)
    seen, opened = np.zeros((m, n), dtype=bool), np.zeros((m, n), dtype=bool)
    near = np.zeros((m, n), dtype=bool)  # in the range or its margin
    ids, sims = np.full((m, beam), -1), np.full((m, beam), -np.inf, np.float32)
    ids[:, : len(starts)], sims[:, : len(starts)] = starts, q32 @ small[starts].T
    seen[:, starts] = True
    near[:, starts] = sims[:, : len(starts)] >= outer

    def look(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open node v for query q: its neighbours and their cosines, -inf for those already seen."""
        opened[q, v] = True
        found = table[v]
        s = np.full(found.shape, -np.inf, np.float32)
        rows, cols = np.nonzero((found >= 0) & ~seen[q[:, None], found])
        new = found[rows, cols]
        s[rows, cols] = np.einsum("ij,ij->i", q32[q[rows]], small[new])
        seen[q[rows], new] = True
        hit = s[rows, cols] >= outer
        near[q[rows[hit]], new[hit]] = True
        return found, s

    active = np.arange(m)
    while len(active):  # the best of the beam that isn't open yet
        s = np.where((ids[active] < 0) | opened[active[:, None], ids[active]], -np.inf, sims[active])
        best = np.argmax(s, axis=1)
        go = s[np.arange(len(active)), best] > -np.inf
        active, best = active[go], best[go]
        if len(active):
            found, new = look(active, ids[active, best])
            all_ids, all_sims = np.concatenate((ids[active], found), axis=1), np.concatenate((sims[active], new), axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, top, axis=1)
            ids[active] = np.where(sims[active] > -np.inf, np.take_along_axis(all_ids, top, axis=1), -1)
    while True:  # then outwards through all that lies in the range or its margin
        q, v = np.nonzero(near & ~opened)
        if not len(q):
            break
        for at in range(0, len(q), 8192):
            look(q[at : at + 8192], v[at : at + 8192])
    q, v = np.nonzero(near)
    out = np.zeros((m, n), dtype=bool)
    for at in range(0, len(q), 1 << 16):  # verified in double precision
        i, j = q[at : at + (1 << 16)], v[at : at + (1 << 16)]
        out[i, j] = np.einsum("ij,ij->i", queries[i], x[j]) >= cosine
    return out


def forest(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each node the smallest id that it is connected to by the pairs of nodes a, b."""
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        if (low == before).all():
            return low


def stack(v: pd.Series) -> np.ndarray:
    return np.vstack(v.to_list()).astype(np.float64)


def build_block(part: pd.DataFrame) -> pd.DataFrame:
    """The graph of one block: id and its neighbours' ids."""
    part = part.sort_values("id")
    x, ids = stack(part["vec"]), part["id"].to_numpy()
    return pd.DataFrame({"id": ids, "near": [ids[a] for a in prune(x)]})


def searcher(cosine: float):
    def search_block(part: pd.DataFrame) -> pd.DataFrame:
        """Search the queries of one block among the members of another; id, links, low, audited and found (links of audited
        queries, and those the graph found), exact (pieces compared as a whole)."""
        targets = part[part["target"]].sort_values("id")
        queries = part[~part["target"]].sort_values("id")
        empty = pd.DataFrame({k: np.empty(0, dtype=np.int64) for k in ("id", "links", "low", "audited", "found", "exact")})
        if targets.empty or queries.empty:
            return empty
        x, ids, n = stack(targets["vec"]), targets["id"].to_numpy(), targets["n"].to_numpy()
        q, qids = stack(queries["vec"]), queries["id"].to_numpy()
        place = {int(v): i for i, v in enumerate(ids)}
        lists = [np.array([place[v] for v in (near if near is not None else ()) if v in place], dtype=int) for near in targets["near"]]
        low = np.concatenate((qids, ids))
        links, audited, recalled, exact = (np.zeros(len(qids), dtype=np.int64) for _ in range(4))
        linked = np.zeros(len(ids), dtype=bool)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(qids), PIECE):
            part_ids, y = qids[at : at + PIECE], q[at : at + PIECE]
            other = part_ids[:, None] != ids[None, :]
            chosen = part_ids % AUDITED == 0
            truth = (y[chosen] @ x.T >= cosine) & other[chosen]
            for wider in range(DOUBLED + 1):
                found = search(y, x, lists, cosine, BEAM << wider) & other
                audited[at], recalled[at] = int(truth.sum()), int((found[chosen] & truth).sum())
                if recalled[at] >= RECALL * audited[at]:
                    break
            else:
                exact[at] = 1
                found |= (y @ x.T >= cosine) & other
            found[chosen] |= truth
            links[at : at + PIECE] = found @ n
            a, b = np.nonzero(found)
            linked[b] = True
            # of the piece's links a spanning forest stays: each node and the first node that it reaches
            first = forest(a + at, b + len(qids), np.arange(len(low)))
            moved = np.nonzero(first != np.arange(len(low)))[0]
            ends.append((moved, first[moved]))
        low = forest(*(np.concatenate(e) for e in zip(*ends)), low)
        own = pd.DataFrame({"id": qids, "links": links, "low": low[: len(qids)], "audited": audited, "found": recalled, "exact": exact})
        others = pd.DataFrame({"id": ids[linked], "links": 0, "low": low[len(qids) :][linked], "audited": 0, "found": 0, "exact": 0})
        return pd.concat([own, others])

    return search_block


def audit_all(classes: DataFrame, cosine: float) -> DataFrame:
    """id, links: links of AUDIT_ALL classes to all others, by brute force. A stated query set against all rows."""
    spark = classes.sparkSession
    asked = classes.orderBy(F.xxhash64("key")).limit(AUDIT_ALL).select("id", "grp", "vec").collect()
    sent = spark.sparkContext.broadcast([(r.id, r.grp, np.array(r.vec)) for r in asked])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, part in batch.groupby("grp"):
                x, ids, n = stack(part["vec"]), part["id"].to_numpy(), part["n"].to_numpy()
                for i, g, v in sent.value:
                    if g == grp:
                        yield pd.DataFrame({"id": [i], "links": [int(n[(x @ v >= cosine) & (ids != i)].sum())]})

    return materialize(classes.select("id", "n", "grp", "vec").mapInPandas(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links")))


def search_shards(classes: DataFrame, cosine: float) -> DataFrame:
    """id, links, low (and audited, found, exact) of all searches."""
    spark = classes.sparkSession
    radius = float(np.sqrt(2 - 2 * cosine))
    sizes = {r.grp: r.n for r in classes.groupBy("grp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "grp").limit(MOST_CENTROIDS).collect()}
    total = max(1, sum(sizes.values()))
    sample = classes.where(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < F.lit(1_000_003.0 * min(1.0, SAMPLE / total))).select("grp", "id", "vec").collect()
    by_group: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r.grp, r.id)):
        by_group.setdefault(r.grp, []).append(r.vec)
    places = {}
    for grp, vectors in by_group.items():
        k = min(max(1, round(sizes.get(grp, 0) / SHARD)), max(1, len(vectors) // 4), max(1, MOST_CENTROIDS * len(vectors) // len(sample)))
        if k > 1:
            places[grp] = centroids_of(np.array(vectors), k)
    sent = spark.sparkContext.broadcast(places)  # MOST_CENTROIDS vectors at most

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apart: dict[str, np.ndarray] = {}
        for batch in batches:
            for grp, part in batch.groupby("grp"):
                x, ids, n = stack(part["vec"]), part["id"].to_numpy(), part["n"].to_numpy()
                c = sent.value.get(grp)
                if c is None:
                    c = np.zeros((1, x.shape[1]))
                if grp not in apart:
                    apart[grp] = distances_between(c)
                some = max(1, DISTANCES // len(c))
                for start in range(0, len(x), some):
                    own = np.arange(start, min(start + some, len(x)))
                    row, shard = shards_of(x[own], c, radius, apart[grp])
                    for at in range(0, len(row), 5000):
                        r, s = own[row[at : at + 5000]], shard[at : at + 5000]
                        yield pd.DataFrame({"shard": [f"{grp}#{i}" for i in s], "home": np.arange(at, at + len(r)) < len(own), "id": ids[r], "n": n[r], "vec": [x[i] for i in r]})

    members = materialize(classes.select("id", "n", "grp", "vec").mapInPandas(deal, "shard string, home boolean, id long, n long, vec array<double>"))
    count = members.groupBy("shard").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / ASKED).cast("int").alias("pieces"))
    # one row for each shard: MOST_CENTROIDS and the groups that are too small for one
    members = members.join(count, "shard").where("blocks > 0")
    members = materialize(members.withColumns({"block": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), "piece": F.pmod(F.xxhash64("id", F.lit(1)), F.col("pieces")).cast("int")}))
    # only what is searched is built in, so that the medoid reaches all of it
    lists = materialize(members.where("home").select("shard", "block", "id", "vec").groupBy("shard", "block").applyInPandas(build_block, "id long, near array<long>"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    targets = members.where("home").join(lists, "id").select("shard", "block", every("pieces").alias("piece"), F.lit(True).alias("target"), "id", "n", "vec", "near")
    queries = members.select("shard", every("blocks").alias("block"), "piece", F.lit(False).alias("target"), "id", "n", "vec", F.lit(None).cast("array<long>").alias("near"))
    found = targets.unionByName(queries).groupBy("shard", "block", "piece").applyInPandas(searcher(cosine), "id long, links long, low long, audited long, found long, exact long")
    found = materialize(found)
    discard(members, lists)
    return found


def link_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, audits: list | None = None) -> DataFrame:
    """One row per row of rows: id, n_links, component_id, kept.

    Vectors link at the cosine or above, if their labels are equal and not null and they have equally many
    components. Null, empty and zero vectors and those with null or non-finite components have no links
    and are components of their own. Ids are expected to be distinct; repeated rows link with each other
    and share their id's component. Norms of any size will do. No rows give no rows. audits: gets (links of AUDIT_ALL
    vectors by brute force over all others, links found), then (links of the audited queries in their blocks, those that the graphs found,
    pieces compared as a whole).
    """
    vec = F.col(vec_col).cast("array<double>")
    # scaled by the largest component first, so that no square overflows or vanishes
    size = F.array_max(F.transform(vec, F.abs))
    good = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (size > 0) & F.col(label_col).isNotNull()
    label = F.col(label_col).cast("string")
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, v: s + v * v))
    # bound by let(), as a column may be put into the lambda and be computed for each component
    both = lambda w: let(norm(w), lambda n: F.struct(w.alias("v"), F.transform(w, lambda v: v / n).alias("unit")))
    scaled = F.when(good, let(size, lambda top: let(F.transform(vec, lambda v: v / top), both)))
    scaled = rows.select(F.col(id_col).alias("id"), label.alias("label"), F.size(vec_col).alias("length"), scaled.alias("x")).select("id", "label", "length", "x.v", "x.unit")
    # two hashes of label and direction: vectors of one direction are one class
    key = F.when(F.col("v").isNotNull(), F.concat_ws("-", F.xxhash64(F.lit(1), "label", "v"), F.xxhash64(F.lit(2), "label", "v")))
    all_rows = materialize(scaled.select("id", key.alias("key"), F.concat_ws("/", "label", F.col("length").cast("string")).alias("grp"), F.col("unit").alias("vec")))
    classes = all_rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("grp").alias("grp"), F.first("vec").alias("vec"))
    classes = materialize(classes)

    found = search_shards(classes, cosine)
    measured = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("audited", "found", "exact")]).first()
    LOG.info("%d of %d audited links found by the graphs, %d pieces compared as a whole", measured["found"], measured["audited"], measured["exact"])
    if audits is not None:
        truth = audit_all(classes, cosine)
        got = found.join(F.broadcast(truth.select("id")), "id").agg(F.sum("links")).first()[0] or 0  # AUDIT_ALL ids
        audits.append((truth.agg(F.sum("links")).first()[0] or 0, got))
        audits.append(tuple(measured))
    groups = connected_components(found.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("key", "id", "n").join(links, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    known = materialize(known.select(F.col("key").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("links"), F.coalesce("component", "id").alias("component")))
    out = all_rows.select("id", "key").join(known, F.col("key") == F.col("k"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op1_vector_graph(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n AS a JOIN n AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id AS vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
