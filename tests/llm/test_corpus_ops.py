import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from helpers import canonical, duck_rows
from pyspark.sql import functions as F

from riverflux.llm import decontaminate, extract, language, lm_score, mixing, quotes, registry, simhash, toxicity, url_cascade, vector_graph
from riverflux.llm.common import connected_components

DOC = "doc_id long, text string, lang string, source string, key string, id long, w string, score double, grp string, word string, size int, rank string, fp string, n long"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, "k", 7, "w", 0.5, "g", "x", 3, "r", "f", 1) for i, t, lang, source in rows], DOC)


LONG = " ".join(f"wort{i % 977}" for i in range(60_000))
EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, "  \t\n ", None, "a"), (4, "alpha beta gamma delta", "en", None), (4, "alpha beta gamma delta", "en", None), (None, "no id here at all", "de", "b"), (5, LONG, "de", "b"), (6, "!!! 123 ...", "fr", "b"), (7, "Ünïcode ÄÖ straße 漢字 😀", "de", "c")]


@pytest.fixture(scope="module")
def edge(spark):
    return docs_of(spark, EDGE)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert canonical(registry.QUERIES[name](spark, sf).toPandas()) == canonical(duck_rows(registry.ORACLE_SQL[name], sf))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)]
    low = {v: v for p in pairs for v in p}
    for _ in range(100):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert out == {v: c for v, c in low.items() if any(v in p and p[0] != p[1] for p in pairs)}


# ---- 1


def brute_links(rows):
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0:
            good[i] = (np.array(v, dtype=float) / np.linalg.norm(v), label)
    links = {i: {j for j in good if j != i and i in good and good[j][1] == good[i][1] and len(good[j][0]) == len(good[i][0]) and good[i][0] @ good[j][0] >= 0.98} for i, _, _ in rows}
    low = {i: i for i, _, _ in rows}
    for _ in range(len(rows)):
        for i in links:
            for j in links[i]:
                low[i] = low[j] = min(low[i], low[j])
    return {i: (len(links[i]), low[i], low[i] == i) for i, _, _ in rows}


def test_vector_links_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(scale=0.03 * (i % 7), size=16)], i % 3) for i in range(500)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [None] + [1.0] * 15, 1), (503, [float("nan")] + [1.0] * 15, 1), (504, rows[0][1], None), (505, [], 1), (506, rows[0][1], 0), (507, [2 * x for x in rows[0][1]], 0), (508, rows[0][1][:8], 0), (509, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "vec_id long, embedding array<double>, label int, key string, n int, shard string")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_graph.link_vectors(df).collect()}
    assert out == brute_links(rows)
    assert vector_graph.link_vectors(df.limit(0)).count() == 0


def test_vector_search_in_several_shards_and_blocks(spark, monkeypatch):
    for name, v in {"SHARD": 100, "BLOCK": 60, "ASKED": 50, "PIECE": 20, "AUDITED": 1}.items():
        monkeypatch.setattr(vector_graph, name, v)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 12))
    rows = [(i, [float(x) for x in base[i % 60] + rng.normal(scale=0.1, size=12)], 0) for i in range(700)] + [(1000 + i, [float(x) for x in base[0] + rng.normal(scale=0.02, size=12)], 0) for i in range(200)]
    audits = []
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_graph.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), audits=audits).collect()}
    want = brute_links(rows)
    assert sum(v[0] for v in out.values()) >= 0.99 * sum(v[0] for v in want.values())
    assert audits[0][1] >= 0.9 * audits[0][0]
    assert audits[1][1] >= 0.99 * audits[1][0] > 0 and audits[1][2] == 0  # the graphs gave the links


def test_links_along_the_line_between_centroids_are_found(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 30)
    monkeypatch.setattr(vector_graph, "AUDIT_ALL", 0)  # as where no audited query has a partner
    turn = np.random.default_rng(5).uniform(0, 2 * np.pi, 150)
    ring = np.zeros((150, 64))
    ring[:, 0], ring[:, 1] = np.cos(turn), np.sin(turn)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(ring)]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_graph.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out == brute_links(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_scattered_vectors_with_pairs_across_the_plane_between_centroids(spark, monkeypatch, seed):
    monkeypatch.setattr(vector_graph, "SHARD", 1500)
    monkeypatch.setattr(vector_graph, "AUDITED", 1)
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a, b = unit(rng.normal(size=(2, 64)))
    cloud = unit(np.concatenate([unit(c + rng.normal(scale=0.12, size=(1500, 64))) for c in (a, b)]))
    middle = unit((a + b) / 2 + rng.normal(scale=0.05, size=(60, 64)))
    across = (a - b) / np.linalg.norm(a - b)
    ends = [unit(middle + s * 0.0955 * across) for s in (1, -1)]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(np.concatenate((cloud, *ends)))]
    audits = []
    out = {r.vec_id: r.n_links for r in vector_graph.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), audits=audits).collect()}
    x = np.array([v for _, v, _ in rows])
    want = (unit(x) @ unit(x).T >= 0.98).sum(1) - 1
    assert want[3000:].min() >= 1 and [out[i] for i in range(len(rows))] == want.tolist()
    assert audits[1][0] >= 120 and audits[1][1] >= 0.9 * audits[1][0] and audits[1][2] == 0  # what the graph itself finds


def planted(rng, groups, size, dims, noise):
    """Groups of near copies among scattered vectors: rows of id, vector, label."""
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centres = unit(rng.normal(size=(groups, dims)))
    x = np.concatenate([unit(np.repeat(centres, size, 0) + rng.normal(scale=noise / np.sqrt(dims), size=(groups * size, dims))), unit(rng.normal(size=(groups * size // 2, dims)))])
    x = x[rng.permutation(len(x))]
    return [(i, v.tolist(), i % 2) for i, v in enumerate(x)]


def test_graphs_find_the_links_of_planted_groups_in_many_shards(spark, monkeypatch):
    for name, v in {"SHARD": 250, "BLOCK": 200, "ASKED": 150, "PIECE": 50}.items():
        monkeypatch.setattr(vector_graph, name, v)
    rows = planted(np.random.default_rng(6), 60, 30, 64, 0.12)
    audits = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_graph.link_vectors(df, audits=audits).collect()}
    want = brute_links(rows)
    n = sum(v[0] for v in want.values())
    assert n > 5000 and sum(out[i][0] for i in want) >= 0.999 * n and all(out[i][0] <= want[i][0] for i in want)
    assert audits[1][0] > 0 and audits[1][2] == 0

    def nothing(queries, x, lists, cosine, beam):
        return np.zeros((len(queries), len(x)), dtype=bool)

    monkeypatch.setattr(vector_graph, "search", nothing)
    audits = []
    vector_graph.link_vectors(df, audits=audits).count()
    assert audits[1][1] == 0 and audits[1][2] > 0  # without its graphs the operator says that it compared pieces as a whole


def test_links_match_sql_where_there_are_some(spark, tmp_path):
    rows = planted(np.random.default_rng(8), 8, 6, 16, 0.1)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vector_graph.op1_vector_graph(spark, str(tmp_path)).toPandas()
    assert got["n_links"].sum() > 100
    assert canonical(got) == canonical(duck_rows(vector_graph.OP1_SQL, str(tmp_path)))


def test_labels_with_commas_and_norms_of_any_size(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [2.0], "a,1.0"), (3, [1e300, 2e300], "a"), (4, [1e-300, 2e-300], "a"), (5, [5e-324, 1e-323], "a"), (6, [2.0], None), (1, [1.0, 2.0], "a")]
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_graph.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect())
    assert out == [(1, 4, 1), (1, 4, 1), (2, 0, 2), (3, 4, 1), (4, 4, 1), (5, 4, 1), (6, 0, 6)]


@pytest.mark.parametrize("audited", [1, 20])
def test_block_search_ends_with_all_of_the_block(monkeypatch, audited):
    monkeypatch.setattr(vector_graph, "AUDITED", audited)
    rng = np.random.default_rng(7)
    x = np.repeat(np.eye(16)[:2], 20, axis=0) + rng.normal(scale=0.01, size=(40, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([v for v in range(1, 60) if v % 20][:40])
    # arcs within each half only, as where a guest that isn't searched tied the halves
    near = [ids[:20] if i < 20 else ids[20:] for i in range(40)]
    part = pd.DataFrame({"id": ids, "n": 1, "vec": list(x), "near": near})
    out = vector_graph.searcher(0.98)(pd.concat([part.assign(target=True), part.assign(target=False, near=None)]))
    links = out.groupby("id")["links"].sum()
    assert links.to_dict() == dict(zip(ids.tolist(), ((x @ x.T >= 0.98).sum(1) - 1).tolist()))
    assert out["audited"].sum() == (links.sum() if audited == 1 else 0) and out["found"].sum() <= out["audited"].sum()
    assert out["exact"].sum() == 0


def test_no_shard_of_a_partner_is_left_out():
    rng = np.random.default_rng(6)
    c = rng.normal(size=(30, 64)) * np.array([1.0] * 3 + [0.02] * 61)
    x = rng.normal(size=(300, 64)) * np.array([1.0] * 3 + [0.02] * 61)
    step = rng.normal(size=x.shape) * np.array([1.0] * 3 + [0.02] * 61)
    y = x + 0.199 * step / np.linalg.norm(step, axis=1)[:, None]
    home = np.argmin(((y[:, None] - c) ** 2).sum(2), axis=1)
    row, shard = vector_graph.shards_of(x, c, 0.2)
    assert set(enumerate(home.tolist())) <= set(zip(row.tolist(), shard.tolist()))
    assert len(row) < 0.5 * len(x) * len(c)


# ---- 2


def brute_hits(text, items):
    def words(t):
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return [w for w in "".join(c if ord(c) > 127 or c.isdigit() or "a" <= c <= "z" else " " for c in low).split(" ") if w]

    w, hit, names = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add(item)
    return len(w), len(hit), len(names)


def test_decontamination_matches_brute_force(spark, edge, none):
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefgh")  # noqa: E731  few words: many ties and repeated grams
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(90, None), (91, "Alpha, BETA gamma")]
    texts = [" ".join(word() for _ in range(60)) for _ in range(30)] + [items[5][1] + " x " + items[7][1], None, "", "alpha beta gamma", LONG]
    docs = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(i, t, "x", "h") for i, t in items], "item_id long, text string, key string, h string")
    out = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contaminated(docs, bench).collect()}
    assert out == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    assert decontaminate.contaminated(edge, bench).count() == len(EDGE)
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(edge, bench.limit(0)).where("contaminated").count() == 0


# ---- 3


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "u", "First words.\n\nHow do I sort\na table?"),
        (1, 1, "a", "You order it."),
        (1, 2, "u", "Anna wrote:\n> How do I sort a table?\n\nLike so."),
        (1, 3, "a", ">> How do I sort a table?\n> Like so.\nThanks"),
        (1, 5, "u", "No quote"),
        (1, 5, "u", "No quote"),
        (2, 0, "u", "> How do I sort a table?\nwhat"),
        (None, None, None, None),
        (3, None, "u", "x"),
        (3, 1, "u", ""),
    ]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "conv_id long, turn long, role string, text string, hash string, origin int")
    out = quotes.link_quotes(df).collect()
    got = {(r.conv_id, r.turn): (r.text, r.reply_to, r.linked, r.depth, r.root_turn) for r in out}
    assert len(out) == len(rows)
    assert got[1, 2] == ("Like so.", 0, True, 1, 0)
    assert got[1, 3] == ("Thanks", 2, True, 2, 0)
    assert got[1, 5] == ("No quote", 3, False, 0, 5)
    assert got[2, 0] == ("what", None, False, 0, 0)
    assert got[3, 1][0] == "" and got[None, None][0] == ""
    keys = [r.path for r in out if r.conv_id == 1]
    assert keys == sorted(keys) and [0, 2, 3] in keys
    talk = {r.conv_id: r.messages for r in quotes.as_conversations(quotes.link_quotes(df)).collect()}
    assert [m.content for m in talk[1]] == ["First words.\n\nHow do I sort\na table?", "Like so.", "Thanks", "You order it.", "No quote"]
    assert quotes.link_quotes(df.limit(0)).count() == 0


def plain_units(text):
    """(level, normalised text) of a message's passages and lines, in one simple walk."""
    lines = []
    for raw in re.split(r"\r\n|\r|\n", text or ""):
        head = re.match(r"[ \t]*>[> \t]*", raw)
        mark = head.group() if head else ""
        lines.append((mark.count(">"), raw[len(mark) :].strip(quotes.BLANK), raw))
    norm = lambda b: re.sub(r"\s+", " ", b.lower()).strip(quotes.EDGE)
    out, run = set(), []
    for level, body, _ in [*lines, (-1, "", "")]:
        if run and (level != run[0][0] or not body):
            out.add((run[0][0], norm(" ".join(b for _, b in run))))
            run = []
        if body:
            run.append((level, body))
            out.add((level, norm(body)))
    return {u for u in out if u[1]}, lines


def test_quoted_mail_matches_a_plain_walk(spark):
    rng = random.Random(3)
    rows, said = [], {}
    for conv in range(40):
        for turn in sorted(rng.sample(range(60), rng.randint(1, 12))):
            own = [" ".join(rng.choice("ja nein und oder so, gut! wie?".split()) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 3))]
            lines = []
            for _, earlier in rng.sample(said.get(conv, []), min(len(said.get(conv, [])), rng.randint(0, 2))):
                lines += [rng.choice(["", "Bo wrote:", "x said :"])] + [rng.choice(["> ", ">", " > "]) + x for x in earlier.split("\n")] + rng.choice([[], [""], ["", ""]])
            text = rng.choice(["\n", "\r\n"]).join(lines + own)
            said.setdefault(conv, []).append((turn, text.replace("\r", "")))
            rows.append((conv, turn, "u", text))
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows) and sum(r.linked for r in got.values()) > 30
    for conv in said:
        mine = [r for r in rows if r[0] == conv]
        first, parent = {}, {}
        for _, turn, _, text in mine:
            for level, body in plain_units(text)[0]:
                if level == 0:
                    first.setdefault(body, turn)
        for i, (_, turn, _, text) in enumerate(mine):
            found, lines = plain_units(text)
            quoted = {u for u in found if u[0] > 0}
            weight = Counter()
            for level, body in quoted:
                if first.get(body, turn) < turn:
                    weight[first[body]] += len(body) * (level == 1)
            best = max(weight, key=lambda o: (weight[o], o)) if weight else None
            parent[turn] = best if best is not None and weight[best] > 0 else None
            path, up = [turn], parent[turn]
            while up is not None:
                path, up = [up, *path], parent[up]
            r = got[conv, turn]
            assert (r.n_quoted, r.n_linked) == (len(quoted), sum(first.get(b, turn) < turn for _, b in quoted))
            assert r.path == path and r.depth == len(path) - 1 and r.linked == (parent[turn] is not None)
            assert r.reply_to == (parent[turn] if r.linked else mine[i - 1][1] if i else None)
            own = [raw for k, (level, body, raw) in enumerate(lines) if level == 0 and not (k + 1 < len(lines) and lines[k + 1][0] > 0 and re.search(quotes.ATTRIBUTION, body))]
            own = [x for k, x in enumerate(own) if x.strip() or (k and own[k - 1].strip())]
            assert r.text == "\n".join(own).strip(quotes.BLANK)


def test_no_message_is_too_odd_to_parse(spark):
    texts = [">" * 1_000_000, "- " * 20_000 + "x", "-" * 1_000_000, "\n" * 300_000, "> " * 300_000 + "x", "\n\n".join(f"> p{i}" for i in range(50_000)), "a wrote" + " " * 500_000 + ":\n> x", " " * 500_000 + "x"]
    rows = [(1, i, "u", t) for i, t in enumerate(texts)]
    began = time.time()
    out = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(out) == len(rows) and out[5].n_quoted == 50_000 and out[0].text == "" and out[7].text == "x"
    assert time.time() - began < 90


def test_long_conversations_have_no_gap(spark):
    rows = spark.range(5000).select(F.lit(1).alias("conv_id"), (F.col("id") * 3).alias("turn"), F.lit("u").alias("role"), F.lit("same words").alias("text"))
    out = quotes.link_quotes(rows).toPandas().sort_values("turn")
    assert list(out["reply_to"].iloc[1:]) == list(out["turn"].iloc[:-1])


# ---- 4


def test_languages_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    both = language.op4_rank_profiles(spark, sf).join(docs, "doc_id").where("held_out and lang is not null")
    assert both.where("lang_pred = lang").count() >= 0.98 * both.count()


def test_profiles_match_brute_force(spark, edge, none):
    profiles = language.learn_profiles(edge)
    counts = Counter()
    for i, t, lang, _ in EDGE:
        if lang == "en" and t is not None and zlib.crc32(str(i if i is not None else "").encode()) % 4 != 2:
            c = list(language.codes_of(t))
            counts.update(int(g) for g in language.grams_of(np.array(c)))
    if counts:
        assert [counts[g] for g in profiles["en"]] == sorted(counts.values(), reverse=True)[: language.PROFILE]
    out = language.identify(edge, profiles).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    assert {r.text: r.lang_pred for r in out}["!!! 123 ..."] == "und" == {r.text: r.lang_pred for r in out}[None]
    assert language.identify(none, profiles).count() == 0
    assert {r.lang_pred for r in language.identify(edge, language.learn_profiles(none)).collect()} == {"und"}


def test_pieces_count_like_the_whole(monkeypatch):
    codes = language.codes_of(LONG[:9000] + " Ünïcode straße")
    keys, counts = np.unique(language.grams_of(codes), return_counts=True)
    monkeypatch.setattr(language, "CHUNK", 100)
    k, c = language.counted(codes)
    some = c > 0
    assert (k[some] == keys).all() and (c[some] == counts).all()


def plain_profile(text):
    """Numbers of letter n-grams by plain counting: runs of other characters are boundaries, written 0."""
    codes = [0]
    for c in text or "":
        v = (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0
        codes += [v] if v or codes[-1] else []
    codes += [0] if codes[-1] or len(codes) == 1 else []
    found = Counter((1, a) for a in codes if a)
    found.update((2, *p) for p in zip(codes, codes[1:]) if any(p))
    found.update((3, *p) for p in zip(codes, codes[1:], codes[2:]) if p[1])
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))], found


def test_languages_match_plain_out_of_place_distances(spark, monkeypatch):
    monkeypatch.setattr(language, "PROFILE", 60)
    rng = random.Random(6)
    say = {"de": "der und nicht größe straße eine", "en": "the and of with which a", "fr": "être le les nous avec à"}
    rows = [(i, " ".join(rng.choice(say[lang].split()) for _ in range(rng.randint(1, 40))) + rng.choice(["", "!", " 12 "]), lang, None) for i, lang in enumerate(rng.choices(list(say), k=90))]
    docs = docs_of(spark, rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.learn_profiles(docs)).collect()}
    ranks = {}
    for lang in sorted(say):
        total = Counter()
        for i, t, own, _ in rows:
            if own == lang and zlib.crc32(str(i).encode()) % 4 != 2:
                total.update(plain_profile(t)[1])
        ranks[lang] = {g: k for k, (g, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:60])}
    for i, t, _, _ in rows:
        own = plain_profile(t)[0][:60]
        apart = {lang: sum(abs(of[g] - k) if g in of else 60 for k, g in enumerate(own)) for lang, of in ranks.items()}
        best = min(sorted(apart), key=apart.get)
        assert got[i] == (best, pytest.approx(1 - apart[best] / (60 * len(own))))


# ---- 5


def test_mix_meets_its_targets(spark, edge, none):
    rng = random.Random(5)
    docs = docs_of(spark, [(i, "w " * rng.randint(0, 60), None, rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(3000)])
    first, again = ({r.doc_id: r for r in mixing.mix_sources(docs).collect()} for _ in range(2))
    assert first == again and len(first) == 3000
    total = sum(r["size"] for r in first.values())
    assert sum({r.source: r.target for r in first.values()}.values()) == pytest.approx(1.5 * total)
    for source in ("a", "b", "c", None):
        rows = [r for r in first.values() if r.source == source]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 60
        assert all(r.taken <= 2 * r["size"] for r in rows)
    # copies by class of sizes fit the expected ones, which differ between classes
    rows = [r for r in first.values() if r.source == "a" and r["size"] > 0]
    classes = {k: [r for r in rows if r["size"].bit_length() == k] for k in {r["size"].bit_length() for r in rows}}
    words = {k: sum(r["size"] for r in v) for k, v in classes.items()}
    low, high = 0.0, 2.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2, (24 - k) * mid) * n for k, n in words.items()) < rows[0].target else (low, mid)
    for k, v in classes.items():
        want, got = min(2, (24 - k) * low), sum(r.taken / r["size"] for r in v) / len(v)
        assert abs(want - got) <= 4 * (0.25 / len(v)) ** 0.5 + 1 / len(v)
    assert len({round(min(2, (24 - k) * low), 6) for k in classes}) > 2
    out = mixing.mix_sources(edge).collect()
    assert len(out) == len(EDGE) and all(r.taken <= 2 * r["size"] for r in out)
    assert mixing.mix_sources(none).count() == 0


def test_mix_counts_a_mass_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    docs = docs_of(spark, [(None, "one two three", "en", "a")] * 1000 + [(i, "w " * (i % 9), "de", "b") for i in range(400)])
    rows = mixing.mix_sources(docs, keep=("text", "lang")).collect()
    assert len(rows) == 1400 and {(r.text, r.lang) for r in rows if r.source == "a"} == {("one two three", "en")}
    for source in ("a", "b"):
        some = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in some) - some[0].target) <= 9


# ---- 6


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        arcs = [(n, i, rng.randint(0, 9), 0) for i in range(n)] + [(i, n + 1, rng.randint(0, 9), 0) for i in range(n)]
        arcs += [(i, j, w, w) for i in range(n) for j in range(i) if (w := rng.randint(0, 4))]
        cost = lambda side: sum((c if side[a] and not side[b] else 0) + (back if side[b] and not side[a] else 0) for a, b, c, back in arcs)
        best = min(cost([*s, True, False]) for s in itertools.product([True, False], repeat=n))
        assert cost(extract.source_side(n + 2, arcs, n, n + 1)) == best


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><a href=/>Home</a></header><nav><a>One</a> <a>Two</a></nav>
<div id="cookie-notice">We use cookies &amp; more.</div><main><h1>Title of it</h1><p>First paragraph, with <a href=x>a link</a> in it. And   more text here.</p>
<p>Short.</p><aside class="related"><ul><li><a>r1</a><li><a>r2</a></ul></aside><div class="ad-box">Buy now, it is good, friends.</div><p>Third&nbsp;para graph &#233; ends here.</p></main>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I think that this is a long comment, by a reader, who likes it.</p></div></section>
<form><label>Name</label><input></form><div class="sidebar"><p>Some long sidebar text that goes on and on, really.</p></div><footer>&copy; 2024 All</footer></body></html>"""


def test_markup_that_is_easily_misread():
    text = extract.main_text
    prose = "This is an article of the page, which has words, and more of them."
    assert text(f"<article><script src=https://cdn.x/a/>code</script><script src='a.js'/>code</script><p>{prose}</p></article>") == prose
    assert text(f'<article><p class="x>{prose}</p></article>') == prose
    assert text(f'<article><p class="x>{prose}</p><p>More <a href="y">links</a> text.</p></article>') == prose + "\nMore links text."
    assert text(f'<p title="a > b" data-h="<b>x</b>">{prose}</p>') == prose
    assert text("<article><p>Sum <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, <object>an object</object> and <svg/>more.</p><xmp>a <b> &amp;</xmp></article>") == "Sum x=2, an object and more.\na <b> &amp;"
    for name in ("main has-sidebar", "reader-content", "article-body no-ads", "storyText"):
        assert text(f'<div class="{name}"><p>{prose}</p><p>Short.</p></div>') == prose + "\nShort."
    for name in ("side-bar", "sidebar-left", "siteFooter", "reader-comments", "ad box", "cookie_notice"):
        assert text(f'<article><p>{prose}</p></article><div class="{name}"><p>{prose}</p></div>') == prose


def generated_page(rng):
    word = lambda: rng.choice("river stone light walks under seven green houses often speak about small water".split())
    sentence = lambda n: " ".join(word() for _ in range(rng.randint(n, 3 * n))).capitalize() + "."
    tag = lambda name, inner, cls="": f"<{name}{f' class={cls}' if cls else ''}>{inner}</{name}>"
    title, body = sentence(3), [" ".join(sentence(6) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 6))]
    links = "".join(f"<li><a href='/{word()}'>{word()} {word()}</a></li>" for _ in range(rng.randint(3, 8)))
    article = tag("h1", title) + "".join(rng.choice(["", "\n<!-- x -->"]) + tag("p", b.replace("river", "<em>river</em>")) for b in body)
    wrap, cls = rng.choice([("article", ""), ("main", ""), ("div", "post-content"), ("div", "entry"), ("section", "story")])
    around = [tag(rng.choice(["nav", "header"]), tag("ul", links)), tag("div", tag("p", sentence(5)), rng.choice(["ad", "promo-box", "cookie-notice", "side-bar"]))]
    after = [tag("aside", tag("p", sentence(6)) + tag("ul", links)), tag("div", tag("p", sentence(9)), rng.choice(["comments", "reader-comments"])), tag("footer", "&copy; " + sentence(2)), "<form><p>Name</p><input></form>"]
    page = "<html><head><title>x</title><script>var a='<p>';</script></head><body>" + "".join(rng.sample(around, rng.randint(1, 2))) + tag(wrap, article, cls) + "".join(rng.sample(after, rng.randint(1, 4))) + "</body></html>"
    return page, "\n".join([title, *body])


def test_articles_of_generated_pages_come_out_whole(spark):
    rng = random.Random(8)
    made = [generated_page(rng) for _ in range(300)]
    pages = spark.createDataFrame([(i, html, "clash", 1) for i, (html, _) in enumerate(made)], "page_id long, html string, text string, f int")
    weights = extract.fit_costs(pages)
    assert weights != extract.DEFAULT and weights[2] < 0 < weights[1]  # links speak for boilerplate, words for content
    got = {r.page_id: r.text for r in extract.extract_main_text(pages, weights=weights).collect()}
    assert [i for i, (_, want) in enumerate(made) if got[i] != want] == []
    assert extract.fit_costs(pages.limit(0)) == extract.DEFAULT


def test_main_text(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<p><b>unclosed <p>And a second, longer sentence here. It goes on."), (5, "<div>" * 3000 + "Deep text here, it is long enough. Yes." + "</div>" * 10), (6, "<<>><p a='>'>Odd markup, but fine. Really.</p><script>x</p>")]
    out = {r.page_id: r.text for r in extract.extract_main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, html string, text string")).collect()}
    assert out[1] == "Title of it\nFirst paragraph, with a link in it. And more text here.\nShort.\nThird para graph é ends here."
    assert out[2] == out[3] == ""
    assert "second, longer sentence" in out[4] and out[5] == "Deep text here, it is long enough. Yes." and "Odd markup, but fine. Really." in out[6]
    assert extract.extract_main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


# ---- 7


def test_toxicity_of_held_out_documents(spark, sf):
    big = sf.replace("sf0.01", "sf0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    r = toxicity.op7_toxicity(spark, big).where("held_out").join(labels, "doc_id").agg(F.count_if(F.expr("toxic = 1 and predicted = 1")).alias("hit"), F.count_if(F.expr("predicted = 1")).alias("said"), F.count_if(F.expr("toxic = 1")).alias("there")).first()
    assert r.hit >= 0.95 * r.said and r.hit >= 0.65 * r.there


def test_toxicity_does_not_depend_on_the_sample(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(6000):
        bad = rng.random() < 0.1
        said = rng.random() < (0.6 if bad else 0.06)  # the word alone leaves the label open: the prior decides
        docs.append((i, " ".join([f"wort{rng.randrange(300)}" for _ in range(20)] + ["grobianisch"] * said)))
        labels.append((i, int(bad)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    mean = {}
    for sample in ((6000, 18000), (300, 900)):
        model = toxicity.train(docs, labels, sample=sample)
        mean[sample] = toxicity.score_toxicity(docs, model).agg(F.avg("score")).first()[0]
    assert mean[6000, 18000] == pytest.approx(0.1, abs=0.02)
    assert mean[300, 900] == pytest.approx(mean[6000, 18000], abs=0.04)


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, 1, 1), (7, 1, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        out = toxicity.score_toxicity(edge, toxicity.train(edge, given)).collect()
        assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_toxicity(none, toxicity.train(none, labels)).count() == 0


# ---- 8


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, edge, none):
    rng = random.Random(9)
    long = [rng.choices([f"w{i}" for i in range(500)], k=400) for _ in range(12)]
    texts = [" ".join(t) for t in long] + [" ".join(t[:5] + ["changed"] + t[6:]) for t in long] + [None, "", " ", "one two", "ONE two", "one two"]
    docs = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    f = [brute_fingerprint(t) for t in texts]
    low = list(range(len(f)))
    for _ in f:
        for i, j in itertools.combinations(range(len(f)), 2):
            if (f[i] ^ f[j]).bit_count() <= 3:
                low[i] = low[j] = min(low[i], low[j])
    for near in (64, 1):  # 1: all go by the second way
        out = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_groups(docs, near=near).collect()}
        assert out == {i: (f[i], low[i]) for i in range(len(f))}
    assert simhash.simhash_groups(edge).count() == len(EDGE)
    assert simhash.simhash_groups(none).count() == 0


@pytest.mark.parametrize("near", [64, 2])
def test_links_of_fingerprints_match_brute_force(spark, near):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {simhash.signed(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4)))) for b in base for _ in range(12)}
    # a rest that many share: they differ in the first block only
    fps |= {simhash.signed(base[0] ^ x << 4) for x in range(150)} | {simhash.signed(base[0] ^ 1 << 60 ^ x << 9) for x in range(40)}
    want = {(a, b) for a, b in itertools.combinations(sorted(fps), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = {tuple(r) for r in simhash.linked(spark.createDataFrame([(x,) for x in fps], "fp long"), near).select("a", "b").collect()}
    assert got == want


# ---- 9


def test_base_score_matches_brute_force(spark, edge, none):
    out = {(r.doc_id, r.n_tokens): r for r in lm_score.score_texts(edge).collect()}
    counts = Counter()
    for i, t, _, _ in EDGE:
        if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split() + [b""])
    n, v = sum(counts.values()), len(counts)
    for i, t, _, _ in EDGE:
        w = (t or "").encode().lower().split() + [b""]
        r = out[i, len(w)]
        assert r.base_score == pytest.approx(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w)) and r.n_known == sum(counts[x] > 0 for x in w) and r.train_tokens == n
        assert np.isfinite(r.score)
    assert lm_score.score_texts(none).count() == 0


def test_model_is_a_distribution_and_gradients_fit():
    fast = [(f"w{i}".encode(), 50 - i) for i in range(40)] + [(b"", 9)]
    vocab = lm_score.Vocabulary(sorted(fast, key=lambda x: (-x[1], x[0])), [5.0] * lm_score.KINDS, 2000, 60)
    p = {k: v.astype(np.float64) for k, v in lm_score.start(vocab).items()}
    rng = np.random.default_rng(0)
    for k in ("c", "w"):
        p[k] += rng.normal(scale=0.3, size=p[k].shape)
    h = rng.normal(size=(1, lm_score.STATE))
    every = np.arange(vocab.inputs)
    lp, _ = lm_score.outputs(p, vocab, np.repeat(h, len(every), 0), every)
    assert np.exp(lp).sum() == pytest.approx(1)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    target = rng.integers(0, vocab.inputs, 5)
    hs = rng.normal(size=(5, lm_score.STATE))
    _, dh = lm_score.outputs(p, vocab, hs, target, grad)
    for k, at in (("c", (2, 3)), ("cb", (1,)), ("w", (int(target.min()) % 41, 2)), ("wb", (3,))):
        e = 1e-6
        p[k][at] += e
        up = -lm_score.outputs(p, vocab, hs, target)[0].sum()
        p[k][at] -= 2 * e
        down = -lm_score.outputs(p, vocab, hs, target)[0].sum()
        p[k][at] += e
        assert grad[k][at] == pytest.approx((up - down) / (2 * e), abs=1e-5)


def test_training_beats_word_frequencies():
    words = [b"a b c d e f".split()[i % 6] for i in range(600)]
    vocab = lm_score.Vocabulary([(w, 100) for w in b"a b c d e f".split()] + [(b"", 10)], [0.0] * lm_score.KINDS, 610, 7)
    docs = [vocab.ids(words)] * 40
    p = lm_score.start(vocab)
    before = lm_score.score_ids(p, vocab, docs[:1])[0]
    lm_score.train_on(p, vocab, iter(docs))
    assert lm_score.score_ids(p, vocab, docs[:1])[0] > 0.5 * before
    many = [vocab.ids(words[:n]) for n in (0, 1, 7, 250)]
    assert lm_score.score_ids(p, vocab, many) == pytest.approx([lm_score.score_ids(p, vocab, [d])[0] for d in many], rel=1e-4)


def test_scores_match_a_plain_evaluation():
    rng = np.random.default_rng(2)
    fast = [(f"w{i}".encode(), 90 - i) for i in range(70)] + [(b"", 9)]
    vocab = lm_score.Vocabulary(sorted(fast, key=lambda x: (-x[1], x[0])), [4.0] * lm_score.KINDS, 4000, 80)
    p = {k: (v + rng.normal(scale=0.2, size=v.shape)).astype(np.float32) for k, v in lm_score.start(vocab).items()}
    texts = [[f"w{j}".encode() for j in rng.integers(0, 90, n)] for n in (0, 1, 3, 40)]
    got = lm_score.score_ids(p, vocab, [vocab.ids(w) for w in texts])
    q, s = {k: v.astype(float) for k, v in p.items()}, lm_score.STATE
    for words, total in zip(texts, got):
        h, prev, want = np.zeros(s), 0, 0.0
        for target in vocab.ids(words):
            x, u = q["x"][prev] + q["b"], h @ q["u"]
            z, r = (1 / (1 + np.exp(-x[k : k + s] - u[k : k + s])) for k in (0, s))
            h = (1 - z) * np.tanh(x[2 * s :] + r * u[2 * s :]) + z * h
            a = h @ q["c"] + q["cb"]
            of = vocab.class_of[target]
            want += a[of] - np.log(np.exp(a).sum())
            e = {int(j): q["w"][j] @ h + q["wb"][j] for j in np.nonzero(vocab.class_of == of)[0]}
            want += e[target] - np.log(sum(np.exp(v) for v in e.values()))
            prev = target
        assert total == pytest.approx(want, rel=1e-4)


def test_lanes_that_run_out_do_not_shorten_the_windows_of_others():
    docs = [np.arange(1, n + 1) for n in np.random.default_rng(5).integers(1, lm_score.PIECE, 700)]
    windows = list(lm_score.windows_of(iter(docs)))
    tokens = sum(map(len, docs))
    assert len(windows) <= (tokens / lm_score.LANES + lm_score.PIECE) / lm_score.WINDOW + 2
    got = [(t, q, b) for _, tok, prev, begins, there in windows for t, q, b in zip(tok[there], prev[there], begins[there])]
    assert Counter(t for t, _, _ in got) == Counter(np.concatenate(docs).tolist())
    assert all(b == (t == 1) and q == t - 1 for t, q, b in got)


def test_documents_of_all_lengths_train_as_one_by_one_gradients_do():
    """The weights' change in one window, some lanes of which run out, against finite differences."""
    rng = np.random.default_rng(3)
    fast = [(f"w{i}".encode(), 90 - i) for i in range(30)] + [(b"", 9)]
    vocab = lm_score.Vocabulary(sorted(fast, key=lambda x: (-x[1], x[0])), [4.0] * lm_score.KINDS, 4000, 80)
    p = {k: (v + rng.normal(scale=0.3, size=v.shape)).astype(np.float32) for k, v in lm_score.start(vocab).items()}
    docs = [rng.integers(0, vocab.inputs, n) for n in (3, 1, 9, 5)]
    q = {k: v.copy() for k, v in p.items()}
    assert lm_score.train_on(q, vocab, iter(docs)) == 18
    # gradient g, scaled by 1 / sqrt(18), moves a weight by RATE * g / sqrt(0.1 + g * g)
    for k in lm_score.NAMES:
        moved = (p[k] - q[k]).astype(float) / lm_score.RATE
        got = moved * np.sqrt(0.1 / (1 - moved**2)) * np.sqrt(18)
        for at in (np.unravel_index(np.abs(got).argmax(), got.shape), tuple(int(rng.integers(n)) for n in got.shape)):
            ends = []
            for e in (0.01, -0.01):
                near = {n: v.copy() for n, v in p.items()}
                near[k][at] += e
                ends.append(-lm_score.score_ids(near, vocab, docs).sum())
            assert got[at] == pytest.approx((ends[0] - ends[1]) / 0.02, rel=0.02, abs=0.02)


def test_large_weights_score_without_overflow():
    vocab = lm_score.Vocabulary([(b"a", 5), (b"b", 4), (b"", 3)], [2.0] * lm_score.KINDS, 12, 3)
    p = {k: v * np.float32(1) for k, v in lm_score.start(vocab).items()}
    p["wb"], p["cb"] = p["wb"] + np.float32(500), p["cb"] - np.float32(500)
    got = lm_score.score_ids(p, vocab, [np.arange(vocab.inputs)])
    assert got == pytest.approx(lm_score.score_ids(lm_score.start(vocab), vocab, [np.arange(vocab.inputs)]), rel=1e-3)


def test_weights_do_not_depend_on_the_partitions(spark):
    words = [f"w{i}".encode() for i in range(60)]
    vocab = lm_score.Vocabulary([(w, 2) for w in words] + [(b"", 60)], [0.0] * lm_score.KINDS, 180, 61)
    rows = spark.createDataFrame([(i, f"w{i % 60} w{i % 7} w{i % 11}") for i in range(300)], "id long, text string")
    one, two = (lm_score.fit(lm_score.encode(rows.repartition(n), vocab), vocab) for n in (1, 5))
    assert all(np.allclose(one[k], two[k], atol=1e-6) for k in one)


def test_all_training_documents_are_learnt(spark):
    words = [f"w{i}".encode() for i in range(60)]
    vocab = lm_score.Vocabulary([(w, 2) for w in words] + [(b"", 60)], [0.0] * lm_score.KINDS, 180, 61)
    p = lm_score.fit(lm_score.encode(spark.createDataFrame([(i, f"w{i} w{i}") for i in range(60)], "id long, text string"), vocab).withColumn("learn", F.lit(True)), vocab)
    moved = np.abs(p["x"] - lm_score.start(vocab)["x"]).max(1) > 0
    assert [w for w in words if not moved[vocab.head[w]]] == []
    copies = lm_score.fit(lm_score.encode(spark.createDataFrame([(None, "w1 w2 w3")] * 40, "id long, text string"), vocab), vocab)
    assert (copies["cb"] != lm_score.start(vocab)["cb"]).any()


# ---- 10


def test_urls_match_brute_force(spark):
    urls = [None, "", "nourl", "http://", "://x.net/a", "HTTP://A.Example.NET/en/x?q#f", "http://example.net/de/", "https://example.com/de", "https://www.example.com/de/1", "http://x.org/fr/é", "http://x.org/fr", "ftp://u@h.net", "http://net/", "http://notnet/", "a://b://c.net/", "http://example.com.net?/x", "http://" + "a." * 3000 + "net/" + "x" * 9000]
    urls += [f"http://{h}/{p}" for h in ("example.net", "m.example.com", "example.org", "knet", "net.com") for p in ("en/1", "de/2", "fr/3", "")]
    rows = [(i, u, "h", "p", "k") for i, u in enumerate(urls)]
    out = url_cascade.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, path string, key string")).collect()
    for r in out:
        rest = (r.url or "").split("://", 1)[1] if "://" in (r.url or "") else ""
        cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
        host, path = rest[:cut].lower() if rest[:cut].isascii() else rest[:cut], rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, v) for h, p, v in url_cascade.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), r.url
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_cascade.judge_urls(empty).count() == 0
    assert {r.verdict for r in url_cascade.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, path string, key string"), rules=()).collect()} == {"allow"}


def test_of_equally_long_rules_the_longer_host_wins(spark):
    rules = (("a.net", "/x", "block"), ("net", "/xyz", "allow"))
    r = url_cascade.judge_urls(spark.createDataFrame([(1, "http://b.a.net/xyz")], "page_id long, url string"), rules=rules).first()
    assert (r.rule, r.verdict) == ("a.net/x", "block")


# ---- pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, kept, sf).persist()
        assert after.columns == docs.columns and after.count() <= kept.count()
        assert after.join(kept, "doc_id", "left_anti").count() == 0
        kept = after
    assert decontaminate.contaminated(kept, bench).where("contaminated").count() == 0
    groups = simhash.simhash_groups(kept)
    assert groups.select("component_id").distinct().count() == kept.count()
    out = P.STAGES[-1][1](spark, kept, sf)
    taken = out.agg(F.sum("size")).first()[0]
    assert abs(taken - sum(r.target for r in out.select("source", "target").distinct().collect())) < 0.01 * taken and out.where("copies > 2 or copy > copies").count() == 0
    assert set(docs.columns) < set(out.columns) and out.join(kept, "doc_id", "left_anti").count() == 0
    assert kept.count() >= 0.8 * docs.count()


def test_pipeline_keeps_columns_of_any_name_and_takes_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, " ".join(f"frage{i}" for i in range(15)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = "doc_id text lang source n_chars score lang_pred key id fp w kept size taken copy order".split()
    schema = ", ".join(f"{n} {'string' if n in ('text', 'lang', 'source') else 'long'}" for n in names)
    rows = [(i, " ".join(f"{'abcdef'[i]}wort{k}" for k in range(30)), "de", "ab"[i % 2], *range(12)) for i in range(6)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(data), name
        out = P.mixing(spark, docs, str(tmp_path))
        assert {tuple(r[c] for c in names if c not in ("size", "taken", "copy")) for r in out.collect()} <= {tuple(v for c, v in zip(names, r) if c not in ("size", "taken", "copy")) for r in data}


def test_pipeline_tells_rows_apart_by_id_and_text(spark, tmp_path):
    import corpus_pipeline as P

    item = " ".join(f"frage{i}" for i in range(15))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    other = [" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta", "gamma")]
    rows = [(1, other[0]), (1, other[1]), (None, other[1]), (None, other[2]), (None, other[2]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in P.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted([(1, other[0]), (1, other[1]), (None, other[2]), (None, None)], key=str)
    docs = spark.createDataFrame([(1, item), (1, other[0]), (None, item), (None, other[1]), (None, None)], "doc_id long, text string")
    out = [tuple(r) for r in P.decontamination(spark, docs, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted([(1, other[0]), (None, other[1]), (None, None)], key=str)


def test_items_with_one_passage_are_one_group(spark):
    """Many items that share a passage, each with words of its own around it, and many documents that hold it."""
    passage = [f"shared{i}" for i in range(25)]
    items = [(i, " ".join([*(f"own{i}x{k}" for k in range(6)), *passage, *(f"after{i}x{k}" for k in range(6))])) for i in range(300)] + [(None, " ".join(passage[:12])), (1000, "two words")]
    docs = [(d, " ".join([f"doc{d}", *passage, f"end{d}"])) for d in range(200)] + [(500, "has two words"), (501, " ".join(passage[:9])), (502, " ".join(passage[:12]))]
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    got = {r.doc_id: (r.n_hit, r.n_items) for r in out.collect()}
    assert got == {d: (25, 300) for d in range(200)} | {500: (2, 1), 501: (0, 0), 502: (12, 300)}
    owners, members = decontaminate.item_groups(spark.createDataFrame([(i, w) for i in range(50) for w in "ab"] + [(0, "c"), (None, "d")], "item int, win string"))
    assert owners.select("group").distinct().count() == 3 and members.count() == 51


@pytest.mark.parametrize("bits", [1 << 25, 1 << 16, 64])
def test_many_rules_are_judged_whatever_a_level_holds(spark, monkeypatch, bits):
    """The levels of 20 000 rules with as many hash functions as are asked for, with fewer, and a join where they don't fit."""
    monkeypatch.setattr(url_cascade, "MAX_BITS", bits)
    rules = [(f"h{i}.net", "/a/" if i % 3 else "/", "block" if i % 2 else "allow") for i in range(20_000)]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = spark.range(3000).select("id", F.concat(F.lit("http://x.h"), (F.col("id") * 9).cast("string"), F.lit(".net/a/"), F.col("id").cast("string")).alias("url"))
    got = {r.id: (r.rule, r.verdict) for r in url_cascade.judge_urls(pages, table).collect()}
    known = {h: (h + p, v) for h, p, v in rules}
    assert got == {i: known.get(f"h{9 * i}.net", (None, "allow")) for i in range(3000)}
