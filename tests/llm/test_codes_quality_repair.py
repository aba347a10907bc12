import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverflux.llm import quality, repair, vector_codes
from riverflux.llm.common import join_groups, materialize

# ---- 11


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Lloyd over all vectors, one by one."""
    good = [(i, label, [int(np.floor(1024 * x)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, _, v in good if v and len(v) % parts == 0)
    size = min(sizes, key=lambda n: (-sizes[n], n))
    good = [r for r in good if len(r[2]) == size]
    w = size // parts
    start = {}
    for i, _, v in good:
        if i is not None:
            start[i] = min(v, start.get(i, v))
    books = [[start[i][p * w : p * w + w] for i in sorted(start)[:entries]] for p in range(parts)]

    def assign(p, v):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, _, v in good:
            for p in range(parts):
                groups.setdefault((p, assign(p, v)[0]), []).append(v[p * w : p * w + w])
        for (p, e), vs in groups.items():
            books[p][e] = [sum(x) // len(vs) for x in zip(*vs)]
    out = []
    for i, label, v in good:
        found = [assign(p, v) for p in range(parts)]
        out.append((i, label, "".join(f"{c:02x}" for c, _ in found), sum(d for _, d in found)))
    return sorted(out, key=str), books


def test_codes_match_plain_lloyd(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(scale=0.3, size=8)], int(i % 3)) for i in range(150)]
    rows += [(1000 + i, rows[3][1], None) for i in range(90)] + [rows[5], rows[5], (6, rows[9][1], 1), (None, rows[2][1], 2)]  # a heavy vector, repeated rows and ids
    rows += [(700, None, 1), (701, [None] + [1.0] * 7, 1), (702, [float("nan")] * 8, 1), (703, [float("-inf")] * 8, 0), (704, [], 1), (705, [1.0] * 4, 1), (706, [0.5] * 6, 1)]
    df = spark.createDataFrame([(*r, "x", 3, [1]) for r in rows], "vec_id long, embedding array<double>, label int, part string, n int, row array<int>").repartition(5)
    got, books = vector_codes.compress_vectors(df, entries=16)
    want, want_books = plain_codes(rows, entries=16)
    assert sorted(((r.id, r.label, r.code, r.error) for r in got.collect()), key=str) == want
    assert books.tolist() == want_books


def test_codes_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    got, books = vector_codes.compress_vectors(spark.createDataFrame([(5, [1e30, -1e30, 0.1, -0.1], 1), (9, [0.0, 0.0, 0.0, 0.0], 1)], schema))
    assert [(r.id, r.code, r.error) for r in got.orderBy("id").collect()] == [(5, "00000000", 0), (9, "01010101", 0)] and books.shape == (4, 2, 1)
    empty, none = vector_codes.compress_vectors(spark.createDataFrame([], schema))
    assert empty.count() == 0 and none is None


def test_entries_without_parts_stay_and_ties_take_the_first():
    books = np.array([[0], [4], [100]])
    codes, errors = vector_codes.nearest(np.array([[2], [3], [0]]), books)
    assert codes.tolist() == [0, 1, 0] and errors.tolist() == [4, 1, 0]
    far = np.array([[1 << 27], [-(1 << 27)]], np.int64)  # beyond what floats hold exactly
    assert vector_codes.nearest(far, far + 1)[1].tolist() == [1, 1]


def test_heavy_groups_join_without_moving(spark):
    rows = materialize(spark.range(5000).select(F.when(F.col("id") < 3000, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"), "id"))
    groups = materialize(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).withColumnRenamed("k", "of"))
    out = join_groups(rows, groups, {"k": "of"}, "n", 5000)
    assert out.columns == ["k", "id", "top"] and out.count() == 5000
    assert out.where("k is null and top = 2999").count() == 3000 and out.where("k is not null and top = id").count() == 2000


# ---- 12

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    w = SPACE.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, m string, n_words int, rejected_by string")


def test_measures_match_plain_counts(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\r\n", "a b", "a b c", "a b c a b c", "x x x x x", "Ünï 漢字 😀 #*$ %&|<>", "a b \x0b c\x0c d", "l\nl\r\nl\n\n l\nl"]
    texts += [rng.choice([" ", "\n"]).join(rng.choice("abc#%") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(f"w{rng.randint(0, 40)}" for _ in range(30_000)), "z " * 40_000, "#" * 50_000]
    out = quality.judge(documents(spark, texts), report=quality.BASE_MEASURES, keep=("doc_id", "n_words"))
    got = {r.doc_id: tuple(r[m] for m in quality.BASE_MEASURES) for r in out.collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(texts)}
    assert quality.judge(documents(spark, [])).count() == 0


def test_any_order_of_rules_keeps_the_same(spark):
    rng = random.Random(5)
    kinds = [lambda: "good prose here,", lambda: "SHOUT!!", lambda: "a$$$", lambda: "- item\n", lambda: "wait...\n", lambda: "12 34", lambda: "line again\n", lambda: "extraordinarylonglonglongword"]
    odd = lambda: "".join(rng.choice("abcdé") for _ in range(4))
    texts = [" ".join(f"{odd()} {rng.choice(some)()}" for _ in range(rng.randint(20, 90))) for some in (rng.sample(kinds, rng.randint(1, 3)) for _ in range(80))]
    df = documents(spark, texts)
    kept = []
    for order in (quality.RULES, quality.RULES[::-1]):
        plan = [quality.Estimate(r.name, 1.0, 0) for r in order]
        kept.append({r.doc_id for r in quality.judge(df, keep=("doc_id",), plan=plan).where("rejected_by is null").collect()})
    planned = {r.doc_id for r in quality.judge(df, keep=("doc_id",)).where("rejected_by is null").collect()}
    assert kept[0] == kept[1] == planned and 0 < len(planned) < len(texts)


def test_rules_stop_at_the_first_rejection(spark):
    rules = (quality.Rule("cheap", lambda m: m("n_words") < 3), quality.Rule("never", lambda m: F.when(m("n_words") < 3, F.raise_error(F.lit("seen"))).otherwise(F.lit(0)).cast("int") == 1))
    plan = [quality.Estimate("cheap", 1.0, 1), quality.Estimate("never", 1.0, 0)]
    out = quality.judge(documents(spark, ["a", "a b c d"]), rules, keep=("doc_id",), plan=plan).orderBy("doc_id").collect()
    assert [r.rejected_by for r in out] == ["cheap", None]
    with pytest.raises(Exception, match="seen"):
        quality.judge(documents(spark, ["a", "a b c d"]), rules, plan=plan[::-1]).collect()


def test_cascade_is_ordered_by_rejections_per_cost(spark):
    # rule 0 rejects 60 for 6 s, 1 rejects 40 for 1 s (all of them also by 0), 2 rejects 5 for 0.01 s
    patterns = {(True, True, False): 40, (True, False, False): 20, (False, False, True): 5, (False, False, False): 35}
    assert quality.arrange(patterns, [6.0, 1.0, 0.01]) == [(2, 5), (1, 40), (0, 20)]
    plan = quality.plan_cascade(documents(spark, ["a b"] * 30 + ["good words " * 40] * 30), sample=10)
    assert sorted(e.name for e in plan) == sorted(r.name for r in quality.RULES) and plan[0].rejected > 0


# ---- 13


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation in order. Dynamic programming over whole audits."""
    on, initials = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "u", 3: "a"}
    counts, seen, said, faults = Counter(), set(), [], []
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        faults.append(fault)
        said.append(role[:1])
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for s, (c, a, out) in list(best.items()):
                new = (c + 5, a + "I", (*out, ("user" if on[s] == 2 else "assistant") + ":"))
                best[on[s]] = min(best.get(on[s], new), new)
        return best

    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for s, (c, a, out) in inserted(best).items():
            more = 5 * (fault == "truncated")
            ways = [(s, (c + 2, a + "D", out))]
            if fault not in ("blank", "duplicate"):
                ways.append((on[s], (c + 1 + more, a + "R", (*out, f"{'user' if on[s] == 2 else 'assistant'}:{text}"))))
                if s == 0 and role[:1] == "s":
                    ways.append((1, (c + more, a + "K", (*out, f"{role}:{text}"))))
                if role[:1] == initials[on[s]]:
                    ways.append((on[s], (c + more, a + "K", (*out, f"{role}:{text}"))))
            for t, way in ways:
                new[t] = min(new.get(t, way), way)
        best = new
    cost, audit, out = min(v for s, v in inserted(best).items() if s in (0, 3))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def in_order(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))


def repaired(spark, rows, kind="long"):
    df = spark.createDataFrame([(*r, "x", 1, "m") for r in rows], f"conv_id {kind}, turn long, role string, text string, row string, seq int, matrix string").repartition(6)
    found = repair.repair_conversations(df)
    out = repair.with_digests(found).collect()
    i = lambda r: r["info"]
    gaps = lambda x: x["last_turn"] - x["first_turn"] + 1 - x["n_turns"] if x["n_turns"] else 0
    return found, {r.conv: (gaps(i(r)), i(r)["blank"], i(r)["duplicate"], i(r)["truncated"], i(r)["illegal"], r.cost, r.audit, r.sha) for r in out}


def conversation(rng, n, conv):
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None]
    texts = ["Hi.", "So it is!", "Really?", "cut off", "", " ", None, "Yes. \n", "no"]
    out = []
    for i in range(n):
        text = rng.choice(texts)
        if text and rng.random() < 0.6:
            text = f"{i} {text}"
        out.append((conv, rng.choice([None, rng.randint(0, n)]) if rng.random() < 0.1 else i, rng.choice(roles), text))
    return out


@pytest.mark.parametrize(("span", "fan"), [(256, 16), (3, 2)])
def test_repair_matches_dynamic_programming(spark, monkeypatch, span, fan):
    monkeypatch.setattr(repair, "SPAN", span)
    monkeypatch.setattr(repair, "FAN", fan)
    rng = random.Random(span)
    rows = [r for c in range(60) for r in conversation(rng, rng.randint(1, 9), c)] + conversation(rng, 120, 900) + conversation(rng, 5, None)
    rows += [(901, 1, "user", "Same.")] * 40 + rows[:7]
    _, got = repaired(spark, rows)
    want = {c: plain_repair(in_order([r[1:] for r in rows if r[0] == c])) for c in {r[0] for r in rows}}
    assert got == want


def test_long_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(repair, "SPAN", 16)
    monkeypatch.setattr(repair, "FAN", 3)
    rng = random.Random(9)
    rows = conversation(rng, 1500, "c") + conversation(rng, 4, "d")
    found, got = repaired(spark, rows, "string")
    assert got == {c: plain_repair(in_order([r[1:] for r in rows if r[0] == c])) for c in "cd"}
    assert found.pieces.count() >= 1500 // 16
    turns = repair.repaired_turns(found).where("conv = 'c'").orderBy("at").collect()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == got["c"][-1]
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns))


def test_repair_of_nothing(spark):
    assert repaired(spark, [])[1] == {}


def test_products_of_matrices_are_associative():
    rng = random.Random(1)
    for _ in range(200):
        ms = [[repair.step(v, rng.choice("suax"), rng.random() < 0.2, rng.choice([0, 0, 5])) for v in repair.ONE] for _ in range(3)]
        a, b, c = ms
        assert repair.times(repair.times(a, b), c) == repair.times(a, repair.times(b, c))


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    from zlib import crc32

    dropped = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    kept = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 > 4)
    spark.createDataFrame([(dropped, 0, "user", "Hi."), (kept, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in repair.op13_min_plus_repair(spark, str(tmp_path)).collect()}
    assert (out[dropped].cost, out[dropped].audit, out[dropped].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert (out[kept].cost, out[kept].audit) == (2, "D")
