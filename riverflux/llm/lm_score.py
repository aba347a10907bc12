"""Scoring texts with a gated recurrent language model.

The model's vocabulary is the HEAD commonest words and, for all other words, KINDS kinds told apart by
their spelling. The output is factored by class: first a softmax over classes given the state, then one
over the class's words given the state; the kinds are the words of a class of their own, and a rarer word has
its share of its kind's counts. Biases start from the counts, so training can only improve on word frequencies.

Training is truncated backpropagation through time in numpy with AdaGrad: learners train side by side on their
part of the documents, their weights are averaged (in the tasks, by their tokens), and the next round starts
from the average. Each training document is in one round; counts cover all of them. Scoring carries the state
through the whole document, for many documents at once.

Counts of the FAST commonest words are sent to the tasks; the rarer words of each document meet
their counts in one shuffle join, which has no hot key, as its words are rare by construction.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverflux.llm.common import discard, materialize
from riverflux.llm.toxicity import remainder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words with an output of their own, kinds of rarer words, state size, words whose counts are sent.
HEAD, KINDS, STATE, FAST = 2048, 64, 16, 131072
#: Steps of a window, documents trained side by side, step size, rounds of averaging.
WINDOW, LANES, RATE, ROUNDS = 24, 256, 0.3, 2
#: Longest piece of a document that a training lane takes at once.
PIECE = 768
#: Distinct words that a counting task holds, tokens that a scoring task has in hand.
HELD, IN_HAND = 400_000, 4_000_000
#: Tokens that a learner is meant to get in all rounds, most learners (beyond, each gets more).
TOKENS, MOST_LEARNERS = 3_000_000, 2048
#: Partitions in which weights are averaged before the driver gets them.
AVERAGERS = 8
END = b""
#: How a head word or a kind is stored.
ID = np.dtype("<u2")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def kind_of(word: bytes) -> int:
    """The kind of a rare word: its last byte, and whether all of it is ASCII."""
    return (word[-1] & 31) * 2 + (not word.isascii())


def kind_column(word: Column) -> Column:
    last = F.conv(F.hex(F.substring(word, -1, 1)), 16, 10).cast("int")
    ascii_ = F.length(word) == F.length(word.cast("string"))
    return last.bitwiseAND(F.lit(31)) * 2 + F.when(ascii_, 0).otherwise(1)


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for batch in batches:
        for t in batch["text"]:
            counts.update(words_of(t))
            counts[END] += 1
            if len(counts) >= HELD:
                yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})
                counts = Counter()
    if counts:
        yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The words in the highest classes of counts (64 to a factor of e) that together have no more than most words."""
    level = F.floor(F.log("n") * 64)
    sizes = sorted(((r.level, r.words) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, words = float("inf"), 0
    for at, n in sizes:  # some thousand classes, whatever the counts
        words += n
        if words > most:
            break
        least = at
    return counts.where(level >= F.lit(least))


class Vocabulary:
    """What is sent to the tasks: bounded by FAST words."""

    def __init__(self, fast: list[tuple[bytes, int]], mass: list[float], total: int, distinct: int):
        """fast: the commonest words and their counts; mass: (c + 1) summed by kind over all words but the head."""
        head = [(END, dict(fast).get(END, 0))] + [x for x in fast if x[0] != END][: HEAD - 1]
        self.head = {w: i for i, (w, _) in enumerate(head)}
        self.n, self.v = total, distinct
        self.denominator = float(total + distinct + 1)
        # a kind has one more for its unseen words, as the base has
        self.mass = np.array(mass) + 1.0
        p = np.array([c + 1.0 for _, c in head])
        # classes of about equal share, so common words get small classes
        share = np.cumsum(np.sqrt(p)) / np.sqrt(p).sum()
        self.class_of = np.minimum((share * (max(1, int(np.sqrt(len(p)) * 0.75)) - 1e-9)).astype(int), len(p) - 1)
        self.class_of = np.unique(self.class_of, return_inverse=True)[1]
        # the kinds are the words of a last class
        p = np.concatenate((p, self.mass))
        self.class_of = np.append(self.class_of, np.full(KINDS, self.class_of.max() + 1))
        self.classes = int(self.class_of.max()) + 1
        self.first = np.searchsorted(self.class_of, np.arange(self.classes + 1))
        self.log_word = np.log(p)
        self.log_class = np.log(np.bincount(self.class_of, weights=p, minlength=self.classes) / self.denominator)
        self.inputs = len(p)

        # by place in fast: head word or kind, and log10 of the count and one
        self.place = {w: i for i, (w, _) in enumerate(fast)}
        self.id_of = np.array([self.head.get(w, -1) if w in self.head else len(head) + kind_of(w) for w, _ in fast], dtype=np.int64)
        self.log_of = np.log10(np.array([c + 1.0 for _, c in fast]))

    def looked_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Head words and kinds of the words and then the end, and the words' places in fast, -1 where rarer."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        ids = np.zeros(len(words) + 1, dtype=np.int64)
        if len(self.id_of):
            ids[:-1] = self.id_of[at]
        rare = np.nonzero(at < 0)[0]
        ids[rare] = [len(self.head) + kind_of(words[j]) for j in rare.tolist()]
        return ids, at

    def ids(self, words: list[bytes]) -> list[int]:
        """Head words, then kinds; the end comes last."""
        return self.looked_up(words)[0].tolist()


NAMES = ("x", "u", "b", "c", "cb", "w", "wb")


def start(vocab: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    """x: gates of each input; u: gates of the state; c, cb: classes; w, wb: words within their class."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    b = np.zeros(3 * STATE, np.float32)
    return {
        "x": small(vocab.inputs, 3 * STATE), "u": small(STATE, 3 * STATE), "b": b, "c": small(STATE, vocab.classes) * np.float32(0.1), "cb": vocab.log_class.astype(np.float32),
        "w": small(vocab.inputs, STATE) * np.float32(0.1), "wb": vocab.log_word.astype(np.float32),
    }


def gates_of(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Gates of all inputs, and of the state, a row for each gate; those of z and r are negated, as step() has them."""
    x, u = np.ascontiguousarray((p["x"] + p["b"]).T), np.ascontiguousarray(p["u"].T)
    x[: 2 * STATE] *= -1
    u[: 2 * STATE] *= -1
    return x, u


def step(gx: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the gated unit from the inputs' gates gx and the state h; a column for each document."""
    s = STATE
    gh = u @ h
    zr = gx[: 2 * s] + gh[: 2 * s]
    np.exp(zr, out=zr)  # infinite where a gate is shut: its reciprocal is 0
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr[:s], zr[s:]
    a = gh[2 * s :] * r
    a += gx[2 * s :]
    np.tanh(a, out=a)
    h = h - a
    h *= z
    h += a
    return h, z, r, a, gh[2 * s :]


def with_bias(w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.concatenate((w, bias[:, None]), axis=1)


def exp_sums(h: np.ndarray, w: np.ndarray, small: bool, sums: np.ndarray, grad: np.ndarray | None) -> np.ndarray | int:
    """exp(h @ w.T) summed over each row, in the last column of sums (the last column of h is 1, that of w the biases). With
    grad, the exps times w are summed before it, and the gradient of the sums' logs is added to grad. small: no product is
    too large or small for exp; else each row's largest is taken off, which is returned."""
    e, off = h @ w.T, 0
    if not small:
        off = e.max(axis=1)
        e -= off[:, None]
    np.exp(e, out=e)
    if grad is None:
        np.matmul(e, np.ones(len(w), e.dtype), out=sums[:, -1])
    else:
        ones = w.copy()
        ones[:, -1] = 1
        np.matmul(e, ones, out=sums)
        grad += e.T @ (h / sums[:, -1:])
    return off


def outputs(p: dict, vocab: Vocabulary, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target, a head word or a kind, given the states h. With grad,
    gradients of the negative sum are added there and the one by h is returned."""
    cls = np.take(vocab.class_of, target)
    order = np.argsort(cls.astype(np.int16), kind="stable")  # the tokens of a class stand together
    target, cls = np.take(target, order), np.take(cls, order)
    hs = np.ones((len(h), h.shape[1] + 1), h.dtype)
    hs[:, :-1] = np.take(h, order, axis=0)
    c, w = with_bias(p["c"].T, p["cb"]), with_bias(p["w"], p["wb"])
    reach = max(1.0, float(np.abs(h).max(initial=0)))
    small = [bool(np.abs(x).sum(1).max() * reach < 60) for x in (c, w)]
    gc, gw = (None, None) if grad is None else (np.zeros_like(c), np.zeros_like(w))
    in_class, in_all = np.empty_like(hs), np.empty_like(hs)
    off = np.zeros(len(h), h.dtype)
    off += exp_sums(hs, c, small[0], in_all, gc)
    bounds = np.searchsorted(cls, np.arange(vocab.classes + 1))
    for k in np.nonzero(bounds[1:] > bounds[:-1])[0]:
        at, of = slice(bounds[k], bounds[k + 1]), slice(vocab.first[k], vocab.first[k + 1])
        off[at] += exp_sums(hs[at], w[of], small[1], in_class[at], None if gw is None else gw[of])
    own = np.take(c, cls, axis=0)
    own += np.take(w, target, axis=0)
    lp = np.empty(len(h), h.dtype)
    lp[order] = np.einsum("ij,ij->i", hs, own) - np.log(in_all[:, -1]) - np.log(in_class[:, -1]) - off
    if grad is None:
        return lp, None
    of_words = np.stack([np.bincount(target, weights=column, minlength=len(w)) for column in hs.T])
    gw -= of_words.T
    gc -= np.add.reduceat(of_words, vocab.first[:-1], axis=1).T
    for k, g in (("c", gc.T[:-1]), ("cb", gc[:, -1]), ("w", gw[:, :-1]), ("wb", gw[:, -1])):
        grad[k] += g
    in_all /= in_all[:, -1:].copy()
    in_class /= in_class[:, -1:].copy()
    in_all += in_class
    in_all -= own
    dh = np.empty_like(h)
    dh[order] = in_all[:, :-1]
    return lp, dh


def windows_of(texts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Lanes that are live, their next tokens (step, lane), the tokens before these, where the state starts anew, and which of them
    there are: all but at the end.

    A lane is an endless row of pieces of documents of at most PIECE tokens, so that no long document runs on
    by itself at the end; a piece knows the token before it. When no more come, the lanes run out; those
    that do so before the others of a window are filled up."""
    pieces = ((doc, at) for doc in texts for at in range(0, len(doc), PIECE))
    room = WINDOW + PIECE
    lanes = np.zeros((3, LANES, room), dtype=np.int32)  # token, token before, 1 at a piece's start
    first, left = np.zeros(LANES, dtype=np.int64), np.zeros(LANES, dtype=np.int64)
    more = True
    while more or left.any():
        for i in np.nonzero(left < WINDOW)[0] if more else ():
            n = int(left[i])
            lanes[:, i, :n] = lanes[:, i, first[i] : first[i] + n].copy()
            while n < WINDOW:
                doc, at = next(pieces, (None, 0))
                if doc is None:
                    more = False
                    break
                tok = doc[at : at + PIECE]
                end = n + len(tok)
                lanes[0, i, n:end], lanes[1, i, n + 1 : end], lanes[1, i, n] = tok, tok[:-1], doc[at - 1] if at else 0
                lanes[2, i, n:end] = 0
                lanes[2, i, n] = 1
                n = end
            first[i], left[i] = 0, n
        use = np.nonzero(left)[0]
        if not len(use):
            return
        steps = np.arange(min(WINDOW, int(left.max())))[:, None]
        out = lanes[:, use, np.minimum(first[use] + steps, room - 1)]
        there = steps < left[use]
        taken = np.minimum(left, len(steps))
        first += taken
        left -= taken
        yield use, out[0], out[1], out[2] > 0, there


def train_on(p: dict, vocab: Vocabulary, texts: Iterator[np.ndarray]) -> int:
    """Fit p in place to the documents, LANES side by side; the number of tokens seen."""
    s, seen = STATE, 0
    memory = {k: np.full_like(v, 0.1) for k, v in p.items()}
    state = np.zeros((s, LANES), np.float32)
    spaces = [np.empty(k * s * WINDOW * LANES, np.float32) for k in (3, 6, 4)]  # used by each window
    for use, tok, prev, begins, there in windows_of(texts):
        steps, lanes = tok.shape
        keep = (~begins).astype(np.float32)
        x, u = gates_of(p)
        gates, kept, back = (space[: k * s * tok.size].reshape(k * s, steps, lanes) for k, space in zip((3, 6, 4), spaces))
        np.take(x, prev, axis=1, out=gates, mode="clip")
        h = state[:, use]
        # a row for each feature, then steps and lanes
        h_in, z, r, a, g, hs = kept.reshape(6, s, steps, lanes)
        with np.errstate(over="ignore"):
            for t in range(steps):
                h = h * keep[t]
                h_in[:, t] = h
                h, z[:, t], r[:, t], a[:, t], g[:, t] = step(gates[:, t], u, h)
                hs[:, t] = h
        state[:, use] = h
        grad = {k: np.zeros_like(v) for k, v in p.items() if k not in ("x", "u", "b")}
        real = np.nonzero(there.ravel())[0]
        whole = len(real) == tok.size
        rows = hs.reshape(s, -1).T
        _, d_rows = outputs(p, vocab, np.ascontiguousarray(rows if whole else rows[real]), tok.ravel()[real], grad)
        if whole:
            dh = np.ascontiguousarray(d_rows.T)
        else:
            dh = np.zeros((s, tok.size), np.float32)  # what fills a lane up changes nothing
            dh[:, real] = d_rows.T
        dh = dh.reshape(s, steps, lanes)
        carry = np.zeros((s, lanes), np.float32)
        # back: gates of the state for the candidate, z and r; then z, r and the candidate's gates of the input
        da_z, back_z, back_r = (1 - z) * (1 - a * a), (h_in - a) * z * (1 - z), g * r * (1 - r)
        u = np.ascontiguousarray(np.roll(p["u"], s, axis=1))
        for t in reversed(range(steps)):
            d = dh[:, t] + carry
            now = back[:, t]
            da = now[3 * s :]
            np.multiply(d, da_z[:, t], out=da)
            np.multiply(da, r[:, t], out=now[:s])
            np.multiply(d, back_z[:, t], out=now[s : 2 * s])
            np.multiply(da, back_r[:, t], out=now[2 * s : 3 * s])
            d *= z[:, t]
            d += u @ now[: 3 * s]
            d *= keep[t]
            carry = d
        back, n = back.reshape(4 * s, -1), len(real)
        gh, gx = back[: 3 * s], back[s:]
        grad["u"] = np.roll(h_in.reshape(s, -1) @ gh.T, -s, axis=1)
        grad["b"] = gx.sum(axis=1)
        met = np.bincount(prev.ravel()[real], minlength=vocab.inputs) > 0
        ids, place = np.nonzero(met)[0], np.cumsum(met) - 1
        at = place[prev.ravel()]
        scale = np.float32(1 / np.sqrt(n))
        if not whole:
            at, gx = at[real], gx[:, real]
        gids = np.stack([np.bincount(at, weights=one, minlength=len(ids)) for one in gx], axis=1).astype(np.float32) * scale
        memory["x"][ids] += gids * gids
        p["x"][ids] -= np.float32(RATE) * gids / np.sqrt(memory["x"][ids])
        for k, gk in grad.items():
            gk *= scale
            memory[k] += gk * gk
            p[k] -= np.float32(RATE) * gk / np.sqrt(memory[k])
        seen += n
    return seen


def pack(p: dict) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in NAMES)


def unpack(raw: bytes, like: dict) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(raw, dtype="<f4"), {}, 0
    for k in NAMES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The mean of the changes of the weights, weighted by tokens, one set at a time."""
    total, tokens = None, 0
    for batch in batches:
        for raw, n in zip(batch["change"], batch["tokens"]):
            flat = np.frombuffer(raw, dtype="<f2").astype(np.float64) * n
            total, tokens = flat if total is None else total + flat, tokens + n
    if total is not None and tokens:
        yield pd.DataFrame({"change": [(total / tokens).astype("<f2").tobytes()], "tokens": [tokens]})


def encode(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """rows (id, text) as a table with their tokens: row, id (as text), learn, deal, ids, n_known, fast, tail, rare.

    ids: the tokens' head words and kinds, two bytes each;
    fast and tail: log10 of the counts summed over the words that were sent, and over those of them outside the head;
    rare: the words that were not."""
    sent = rows.sparkSession.sparkContext.broadcast(vocab)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = sent.value
        head = len(vocab.head)
        end = float(vocab.log_of[vocab.place[END]]) if END in vocab.place else 0.0
        for batch in batches:
            out = []
            for t in batch["text"]:
                words = words_of(t)
                ids, at = vocab.looked_up(words)
                known, tail = at[at >= 0], at[(at >= 0) & (ids[:-1] >= head)]
                rare = [words[j] for j in np.nonzero(at < 0)[0].tolist()]
                out.append((ids.astype(ID).tobytes(), len(known) + (end > 0), float(vocab.log_of[known].sum()) + end, float(vocab.log_of[tail].sum()), rare))
            found = pd.DataFrame(out, columns=["ids", "n_known", "fast", "tail", "rare"])
            yield pd.concat([batch[["id", "learn", "deal"]].reset_index(drop=True), found], axis=1)

    # only rows without an id are dealt by position, as a mass of them may share one text
    deal = F.xxhash64("id", "text", F.when(F.col("id").isNull(), F.monotonically_increasing_id()), F.lit(11))
    ready = rows.select(F.col("id").cast("string").alias("id"), (remainder(F.col("id"), 7) != 2).alias("learn"), deal.alias("deal"), "text")
    schema = "id string, learn boolean, deal long, ids binary, n_known long, fast double, tail double, rare array<binary>"
    return materialize(ready.mapInPandas(code, schema).withColumn("row", F.monotonically_increasing_id()))


def fit(coded: DataFrame, vocab: Vocabulary) -> dict[str, np.ndarray]:
    """The model of the rows of encode() that are learned from. ROUNDS rounds, each over its own part of the rows,
    together over all of them.

    Rows are dealt by their hash to a number of learners that follows the number of tokens, and learned in the hash's
    order, so the weights do not depend on how the table or the cluster is cut."""
    spark = coded.sparkSession
    sent = spark.sparkContext.broadcast(vocab)
    params = start(vocab)
    learners = max(1, min(MOST_LEARNERS, round(vocab.n / TOKENS)))
    for round_ in range(ROUNDS):
        now = spark.sparkContext.broadcast(pack(params))

        def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            before = unpack(now.value, start(sent.value))
            p = {k: v.copy() for k, v in before.items()}
            n = train_on(p, sent.value, (np.frombuffer(ids, ID) for batch in batches for ids in batch["ids"]))
            if n:
                yield pd.DataFrame({"change": [b"".join((p[k] - before[k]).astype("<f2").tobytes() for k in NAMES)], "tokens": [n]})

        turn = coded.where(F.col("learn") & (F.pmod(F.shiftright("deal", 32), F.lit(ROUNDS)) == round_)).select("deal", "ids")
        sets = turn.repartition(learners, "deal").sortWithinPartitions("deal").mapInPandas(train, "change binary, tokens long")
        # AVERAGERS sets of bounded size reach the driver, however many learners there are
        few = sets.repartition(AVERAGERS).mapInPandas(average, "change binary, tokens long").collect()
        mean = list(average(iter([pd.DataFrame({"change": [bytes(r.change) for r in few], "tokens": [r.tokens for r in few]})]))) if few else []
        if mean:
            change, at = np.frombuffer(mean[0]["change"][0], dtype="<f2").astype(np.float32), 0
            for k in NAMES:
                params[k] = params[k] + change[at : at + params[k].size].reshape(params[k].shape)
                at += params[k].size
        now.unpersist()
    return params


def score_ids(p: dict, vocab: Vocabulary, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of the classes and head words of each document, all in step."""
    if not docs:
        return np.zeros(0)
    out, totals = np.zeros(len(docs)), np.zeros(len(docs))
    lengths = np.array([len(x) for x in docs])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    flat = np.concatenate([np.asarray(docs[i]) for i in order])
    # documents longer than t come first, so the tokens of step t are those of the first live[t] documents
    live = len(docs) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    step_of = np.arange(len(flat), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    flat = flat[np.argsort(step_of.astype(np.uint16) if lengths[0] <= 65536 else step_of, kind="stable")]
    del step_of
    x, u = gates_of(p)
    h, prev = np.zeros((STATE, len(docs)), np.float32), np.zeros(len(docs), dtype=np.int64)
    states, owners, at, held = [], [], 0, 0
    with np.errstate(over="ignore"):
        for t, n in enumerate(live.tolist()):
            h = step(np.take(x, prev[:n], axis=1), u, h if n == h.shape[1] else np.ascontiguousarray(h[:, :n]))[0]
            prev = flat[at + held : at + held + n]
            states.append(h)
            owners.append(n)
            held += n
            if held >= 16384 or t == lengths[0] - 1:
                lp, _ = outputs(p, vocab, np.ascontiguousarray(np.concatenate(states, axis=1).T), flat[at : at + held].astype(np.int64))
                who = np.arange(held) - np.repeat(np.cumsum(owners) - owners, owners)
                totals += np.bincount(who, weights=lp, minlength=len(docs))
                states, owners, at, held = [], [], at + held, 0
    out[order] = totals
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    A null text counts as empty: one token, the end. Rows with remainder 2 are held out of all learning.
    Repeated rows score alike. Without training rows all counts are 0 and the model has seen nothing; an
    empty table gives no rows. Words are compared as bytes, so texts in any encoding of words work.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learn = rows.where(remainder(F.col("id"), 7) != 2)
    counts = materialize(learn.select("text").mapInPandas(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    kinds = counts.where(F.length("word") > 0).groupBy(kind_column(F.col("word")).alias("kind")).agg(F.sum(F.col("n") + 1).alias("mass"), F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    fast = [(bytes(r.word), r.n) for r in commonest(counts, FAST).collect()]
    ends = sum(r.n for r in counts.where(F.length("word") == 0).collect())
    fast = [x for x in fast if x[0] != END] + ([(END, ends)] if ends else [])
    fast.sort(key=lambda x: (-x[1], x[0]))
    mass = [0.0] * KINDS
    for r in kinds:
        mass[r.kind] = float(r.mass)
    for w, c in [x for x in fast if x[0] != END][: HEAD - 1]:
        mass[kind_of(w)] -= c + 1
    vocab = Vocabulary(fast, mass, ends + sum(r.n for r in kinds), sum(r.v for r in kinds) + (ends > 0))
    coded = encode(rows, vocab)
    sent = spark.sparkContext.broadcast((vocab, pack(fit(coded, vocab))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, raw = sent.value
        p = unpack(raw, start(vocab))
        log_mass = np.concatenate((np.zeros(len(vocab.head)), np.log10(vocab.mass)))

        def finish(held: list[pd.DataFrame]) -> pd.DataFrame:
            some = pd.concat(held, ignore_index=True)
            ids = [np.frombuffer(x, ID) for x in some["ids"]]
            lengths = np.array([len(x) for x in ids])
            # every text has a token, its end
            kinds = np.add.reduceat(np.take(log_mass, np.concatenate(ids)), np.cumsum(lengths) - lengths)
            model = score_ids(p, vocab, ids) / np.log(10) + some["tail"] - kinds
            return some[["row", "id", "n_known", "fast"]].assign(n_tokens=lengths, model=model)

        held, tokens = [], 0
        for batch in batches:
            first = 0
            for at, ids in enumerate(batch["ids"], 1):
                tokens += len(ids) // ID.itemsize
                if tokens >= IN_HAND:
                    yield finish([*held, batch.iloc[first:at]])
                    held, tokens, first = [], 0, at
            if first < len(batch):
                held.append(batch.iloc[first:])
        if held:
            yield finish(held)

    # the id travels as text and comes back in its own type; null stays null
    id_type = rows.schema["id"].dataType
    scored = materialize(coded.select("row", "id", "ids", "n_known", "fast", "tail").mapInPandas(score, "row long, id string, n_known long, fast double, n_tokens long, model double"))
    rare = coded.where(F.size("rare") > 0).select("row", F.explode("rare").alias("word"))
    met = rare.join(counts.select("word", "n"), "word").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("logs"))
    out = scored.join(met, "row", "left")
    logs, zero = F.coalesce("logs", F.lit(0.0)), F.lit(0).cast("long")
    id_ = F.col("id").cast(id_type)
    base = F.col("fast") + logs - F.col("n_tokens") * F.lit(float(np.log10(vocab.denominator)))
    return out.select(
        id_.alias(id_col), (remainder(id_, 7) == 2).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(int(vocab.n)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + logs).alias("score"),
    )


def op9_gru_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
