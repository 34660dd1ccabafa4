"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of WINDOW words, STRIDE apart, the last
one ending with the text. A word's input is learned from its characters (the
mean of the vectors of its byte trigrams, word edges included, hashed to BUCKETS
rows) and, for words of the vocabulary, a word vector added to that. A gated recurrent
unit (update gate, reset gate and candidate) reads each window in both
directions, attention pools the states, and a text's score is its highest
window's. All windows of all texts are scored. Nothing but the network scores.

Training needs only labels per document: windows compete, and the network learns
from each document's highest window. The first choice of windows and of the
vocabulary goes by the smoothed log-odds of words between toxic and clean
training documents; no score ever sees them. Words are dropped at random
in training, and some toxic windows with strong evidence are cut down to the words
around its peak and pasted into clean windows, so that no document is learned by heart.
The bias is lowered until at most CALM of the clean training documents exceed THRESHOLD.
It takes at most MAX_TOXIC + MAX_CLEAN labelled documents of at most MAX_CHARS
characters, chosen by a hash of their ids: the documented bound of the sample.

Defined results: null text counts as empty; empty texts get the score of a window
without words; without labels of both kinds every score is the prior 0.5 or the
share of the one kind there is; repeated rows get equal scores; null ids count as
held out; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

WINDOW, STRIDE = 32, 24
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1200, 2000, 10_000
DIM, HIDDEN, EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 16, 16, 14, 300, 128, 0.01, 5
#: Rows of the character table; a word counts from so many training documents on; how many are kept at most, by evidence; strength of the prior in it.
BUCKETS, LEAST_DOCS, MOST_NAMES, PRIOR = 1 << 13, 4, 16384, 10.0
#: Share of words hidden from, and of word vectors left out in, a training step.
DROP_WORDS, DROP_VECTORS = 0.1, 0.3
CHAR_RATE, DECAY = 0.2, 1e-3
#: Share of toxic windows that are pasted into clean ones in a step, and how many words go along on each side at most.
PASTE, AROUND, STRONG = 0.6, 4, 1.0
#: How often windows are chosen; the share of clean training documents that may lie above the threshold.
ROUNDS, CALM = 6, 0.005
THRESHOLD = 0.7
#: Windows scored at once; distinct words kept on a worker; characters turned into inputs at once.
BLOCK, CACHE, CHARS = 2048, 150_000, 1 << 16
EDGE = ".,;:!?\"'()[]{}<>*#%&$-_/\\|+=~`…“”‘’«»¿¡"
#: Marks of a word's edges; in a text they count as space.
BEGIN, END = "\x01", "\x02"


def words_of(text: str) -> list[str]:
    return text.lower().replace(BEGIN, " ").replace(END, " ").split()


def word_of(raw: str) -> str:
    return raw.strip(EDGE)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character table for all byte trigrams of the words, and how many each word has."""
    a = np.frombuffer((BEGIN + (END + BEGIN).join(words) + END).encode("utf-8", "replace"), np.uint8)
    ends = a == 2
    whole = np.flatnonzero(~(ends[:-2] | ends[1:-1]))
    x = a.astype(np.uint32)
    rows = (((x[whole] << 16) | (x[whole + 1] << 8) | x[whole + 2]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    word = np.cumsum(a == 1) - 1
    return rows.astype(np.int32), np.bincount(word[whole], minlength=len(words))


def starts(n: int) -> list[int]:
    """Where the windows of a text of ``n`` words begin."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gate(t: np.ndarray) -> np.ndarray:
    """Logistic of twice the argument, from its hyperbolic tangent ``t``."""
    return 0.5 + 0.5 * t


def recur(x: np.ndarray, mask: np.ndarray, u: np.ndarray):
    """States (T, n, H) of the unit over input projections (T, n, 3H: update, reset, candidate), and what training needs of each step."""
    steps, n, wide = x.shape
    hid = wide // 3
    h, states, kept = np.zeros((n, hid), x.dtype), np.empty((steps, n, hid), x.dtype), []
    for t in range(steps):
        g = gate(np.tanh(x[t, :, : 2 * hid] + h @ u[:, : 2 * hid]))
        z, r = g[:, :hid], g[:, hid:]
        c = np.tanh(x[t, :, 2 * hid :] + (r * h) @ u[:, 2 * hid :])
        kept.append((h, z, r, c))
        h = states[t] = np.where(mask[t][:, None], c + z * (h - c), h)
    return states, kept


def recur_back(d_states: np.ndarray, kept: list, mask: np.ndarray, u: np.ndarray):
    """Gradients of the input projections and of ``u``."""
    steps, n, hid = d_states.shape
    dx, du, dh = np.zeros((steps, n, 3 * hid), u.dtype), np.zeros_like(u), np.zeros((n, hid), u.dtype)
    gates, cand = slice(0, 2 * hid), slice(2 * hid, 3 * hid)
    for t in range(steps - 1, -1, -1):
        h, z, r, c = kept[t]
        live, d = mask[t][:, None], dh + d_states[t]
        skip, d = np.where(live, 0, d), np.where(live, d, 0)
        dc = d * (1 - z) * (1 - c * c)
        dm = dc @ u[:, cand].T  # of the reset state
        dg = np.concatenate([d * (h - c) * 2 * z * (1 - z), dm * h * 2 * r * (1 - r)], 1)
        dx[t, :, gates], dx[t, :, cand] = dg, dc
        du[:, gates] += h.T @ dg
        du[:, cand] += (r * h).T @ dc
        dh = skip + d * z + dm * r + dg @ u[:, gates].T
    return dx, du


def summed(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of value vectors by row number."""
    return np.stack([np.bincount(rows, values[:, k], size) for k in range(values.shape[1])], 1).astype(values.dtype)


class Network:
    """Weights, and the vocabulary's numbers from 1."""

    def __init__(self, words: dict, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.words = words
        small = lambda *s: (rng.normal(size=s) * 0.1).astype(np.float32)
        self.p = {"word": small(len(words) + 1, DIM), "char": small(BUCKETS, DIM) * 3, "w": small(DIM, 6 * HIDDEN) * 3, "bias": np.zeros(6 * HIDDEN, np.float32), "uf": small(HIDDEN, 3 * HIDDEN), "ub": small(HIDDEN, 3 * HIDDEN), "att": small(2 * HIDDEN), "out": small(2 * HIDDEN) * 3, "b": np.full(1, -1.0, np.float32)}
        self.p["word"][0] = 0

    def characters(self, words: list[str]) -> np.ndarray:
        """The mean of the vectors of each word's trigrams; zero for words without."""
        out = np.zeros((len(words), DIM), np.float32)
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= CHARS):
                size += len(words[end])
                end += 1
            rows, n = trigrams(words[at:end])
            if end == at + 1:  # one word may be long
                out[at] = np.bincount(rows, minlength=BUCKETS) @ self.p["char"] / max(1, len(rows))
            else:
                some = n > 0
                first = (np.cumsum(n) - n)[some]
                out[at:end][some] = np.add.reduceat(self.p["char"][rows], first, axis=0) / n[some][:, None] if len(rows) else 0
            at = end
        return out

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input vectors of words without punctuation at their edges."""
        number = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        return self.p["word"][number] + self.characters(words)

    def score(self, tables: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Logits of windows ``at`` (T, n) of row numbers in the two directions' projections; row 0 is no word."""
        steps, n = at.shape
        mask = at > 0
        padded = not mask.all()
        a, v = np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
        two = 2 * HIDDEN
        for side, u in ((0, self.p["uf"]), (1, self.p["ub"])):
            own = slice(side * HIDDEN, (side + 1) * HIDDEN)
            table = tables[side]
            heads = np.stack([self.p["att"][own], self.p["out"][own]], 1)
            ug, uc = np.ascontiguousarray(u[:, :two]), np.ascontiguousarray(u[:, two:])
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if not side else range(steps - 1, -1, -1):
                x = table[at[t]]
                g = h @ ug
                g += x[:, :two]
                np.tanh(g, out=g)
                g *= 0.5
                g += 0.5
                c = (g[:, HIDDEN:] * h) @ uc
                c += x[:, two:]
                np.tanh(c, out=c)
                new = h - c
                new *= g[:, :HIDDEN]
                new += c
                h = np.where(mask[t][:, None], new, h) if padded else new
                both = h @ heads
                a[t] += both[:, 0]
                v[t] += both[:, 1]
        if padded:
            a = np.where(mask, a, np.float32(-1e9))
        a = np.exp(a - a.max(0)) * mask
        return (a * v).sum(0) / np.maximum(a.sum(0), 1e-9) + self.p["b"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Loss gradients of the weights and of the inputs ``x`` (n, T, DIM), and logits."""
        p, side = self.p, 3 * HIDDEN
        xt, m = x.transpose(1, 0, 2), mask.T
        proj = xt @ p["w"] + p["bias"]
        f, kf = recur(proj[:, :, :side], m, p["uf"])
        b, kb = recur(proj[::-1, :, side:], m[::-1], p["ub"])
        h = np.concatenate([f, b[::-1]], 2)
        a = np.where(m, h @ p["att"], -1e9)
        a = np.exp(a - a.max(0)) * m
        a /= np.maximum(a.sum(0), 1e-9)
        v = h @ p["out"]
        logit = (a * v).sum(0) + p["b"][0]
        d = ((sigmoid(logit) - y) * weight / len(y)).astype(x.dtype)
        dv, da = a * d, v * d
        da = a * (da - (a * da).sum(0))
        dh = da[:, :, None] * p["att"] + dv[:, :, None] * p["out"]
        g = {"att": np.einsum("tn,tnh->h", da, h), "out": np.einsum("tn,tnh->h", dv, h), "b": d.sum(keepdims=True)}
        dxf, g["uf"] = recur_back(dh[:, :, :HIDDEN], kf, m, p["uf"])
        dxb, g["ub"] = recur_back(dh[::-1, :, HIDDEN:], kb, m[::-1], p["ub"])
        dp = np.concatenate([dxf, dxb[::-1]], 2)
        g["w"] = np.einsum("tni,tnj->ij", xt, dp)
        g["bias"] = dp.sum((0, 1))
        return g, (dp @ p["w"].T).transpose(1, 0, 2), logit


def log_odds(sets: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """The smoothed log-odds of each number between toxic and clean documents; 0 for numbers seen in neither."""
    flat, owner = np.concatenate(sets), np.repeat(labels, [len(s) for s in sets])
    toxic, clean = np.bincount(flat[owner > 0], minlength=size), np.bincount(flat[owner == 0], minlength=size)
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    out = np.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share))) - np.log(share / (1 - share))
    out[0] = 0
    return out


def named(docs: list[set], labels: np.ndarray) -> dict[str, int]:
    """Numbers, from 1, of the words that tell most between the kinds of documents."""
    seen, toxic = Counter(), Counter()
    for d, y in zip(docs, labels, strict=True):
        seen.update(d)
        if y:
            toxic.update(d)
    share = float(labels.mean())
    far = {w: abs(toxic[w] - n * share) / np.sqrt(n) for w, n in seen.items() if n >= LEAST_DOCS}
    return {w: k for k, w in enumerate(sorted(far, key=lambda w: (-far[w], w))[:MOST_NAMES], 1)}


class Words:
    """The distinct words of the training documents: vocabulary numbers and trigrams; word 0 is none."""

    def __init__(self, words: list[str], numbers: dict[str, int]):
        self.number = np.array([numbers.get(w, 0) for w in words], np.int64)
        parts = [trigrams(words[k : k + 4096]) for k in range(0, len(words), 4096)]
        self.rows, self.count = np.concatenate([r for r, _ in parts]), np.concatenate([n for _, n in parts])
        self.first = np.cumsum(self.count) - self.count

    def spread(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trigram rows of the words ``ids``, whose they are, and one over their count."""
        n = self.count[ids]
        owner = np.repeat(np.arange(len(ids)), n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return self.rows[self.first[ids][owner] + inside], owner, (1 / np.maximum(n, 1)).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network | float:
    """Fits the network; a constant score where there is nothing to tell apart."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    ids: dict[str, int] = {"": 0}
    nums = [np.array([ids.setdefault(w, len(ids)) for w in map(word_of, words_of(t))], np.int32) for t in texts]
    names = list(ids)
    own = [np.unique(n) for n in nums]
    net = Network(named([{names[k] for k in s if k} for s in own], y), seed)
    table = Words(names, net.words)
    rng = np.random.default_rng(seed)
    half = rng.permutation(len(y)) % 2  # the evidence of a document is that of the other half
    odds = [log_odds([s for s, k in zip(own, half, strict=True) if k != h], y[half != h], len(names)) if (half != h).any() else np.zeros(len(names)) for h in (0, 1)]
    owner, wins, mask, evidence, peak = [], [], [], [], []
    for k, n in enumerate(nums):
        for s in starts(len(n)):
            part = n[s : s + WINDOW]
            fill = WINDOW - len(part)
            owner.append(k)
            wins.append(np.concatenate([part, np.zeros(fill, np.int32)]))
            mask.append(np.arange(WINDOW) < WINDOW - fill)
            here = odds[half[k]][part]
            evidence.append(here.max(initial=0))
            peak.append(here.argmax() if len(here) else 0)
    owner, wins, mask, evidence, peak = (np.array(x) for x in (owner, wins, mask, evidence, peak))
    of_clean = np.flatnonzero(y[owner] == 0)
    first = np.searchsorted(owner, np.arange(len(y)))
    del nums, own, odds

    def highest(value: np.ndarray) -> np.ndarray:
        order = np.lexsort((-value, owner))
        return order[np.searchsorted(owner[order], np.arange(len(y)))]

    def pasted(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows ``w`` for a step: of some toxic ones with strong evidence only the words around their peak, in the window of a clean document."""
        words, seen = wins[w].copy(), mask[w].copy()
        for i in np.flatnonzero((y[owner[w]] > 0) & (evidence[w] >= STRONG) & (rng.random(len(w)) < PASTE)):
            at, (before, after) = peak[w[i]], rng.integers(0, AROUND + 1, 2)
            span = words[i, max(0, at - before) : min(at + after, mask[w[i]].sum() - 1) + 1].copy()
            host = rng.choice(of_clean)
            words[i], seen[i] = wins[host], mask[host]
            to = rng.integers(0, max(1, seen[i].sum() - len(span) + 1))
            words[i, to : to + len(span)], seen[i, to : to + len(span)] = span, True
        return words, seen

    top = highest(evidence)
    moment = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    weight = np.sqrt(np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32))
    step, p = 0, net.p
    epochs = max(epochs, LEAST_STEPS * BATCH // len(y))  # small samples need more rounds

    def logits() -> np.ndarray:
        out = []
        for s in range(0, len(wins), BLOCK):
            known, where = np.unique(wins[s : s + BLOCK], return_inverse=True)
            x = net.inputs([names[k] for k in known]) @ p["w"] + p["bias"]
            tables = [np.concatenate([half[:1], half]) for half in np.split(x, 2, axis=1)]  # row 0 is no word
            out.append(net.score(tables, np.where(mask[s : s + BLOCK], where.reshape(-1, WINDOW) + 1, 0).T))
        return np.concatenate(out)

    for epoch in range(epochs):
        if epoch in {epochs * k // ROUNDS for k in range(1, ROUNDS)}:  # windows compete anew
            top = highest(logits())
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            b = order[at : at + BATCH]
            spare = b[y[b] == 0]  # and another window of each clean document
            w = np.concatenate([top[b], first[spare] + rng.integers(0, np.diff(np.append(first, len(owner)))[spare])])
            shown, live = pasted(w)
            known, where = np.unique(shown, return_inverse=True)
            where = where.reshape(len(w), WINDOW)
            rows, of, scale = table.spread(known)
            number = np.where(rng.random(len(known)) < DROP_VECTORS, 0, table.number[known])
            x = p["word"][number] + summed(of, p["char"][rows], len(known)) * scale[:, None]
            seen = rng.random(where.shape) >= DROP_WORDS
            g, dx, _ = net.gradients(x[where] * seen[..., None], live, y[owner[w]], weight[owner[w]])
            dx = summed(where.ravel(), (dx * seen[..., None]).reshape(-1, DIM), len(known))
            g["word"] = np.zeros_like(p["word"])
            np.add.at(g["word"], number, dx)
            g["word"][0] = 0
            g["char"] = summed(rows, (dx * scale[:, None])[of], BUCKETS)
            step += 1
            for k, d in g.items():
                moment[k] += 0.1 * (d - moment[k])
                square[k] += 0.001 * (d * d - square[k])
                rate = RATE * (CHAR_RATE if k == "char" else 1)
                p[k] -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7) + rate * DECAY * p[k]
    final = logits()
    if CALM:
        high = np.quantile(final[highest(final)][y == 0], 1 - CALM)
        p["b"] += np.float32(min(0.0, np.log(THRESHOLD / (1 - THRESHOLD)) - high))
    return net


class Scorer:
    """Scores texts on a worker; keeps the projections of the words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.tables = [np.repeat(b[None], 1 << 14, axis=0) for b in np.split(self.net.p["bias"], 2)]

    def numbers(self, text: str) -> np.ndarray:
        """Row numbers of a text's words, from 1; row 0 is no word."""
        raw, known = words_of(text), self.known
        if missing := [w for w in dict.fromkeys(raw) if w not in known]:
            base = len(known) + 1
            while base + len(missing) > len(self.tables[0]):
                self.tables = [np.concatenate([t, np.zeros_like(t)]) for t in self.tables]
            found = self.net.inputs([word_of(w) for w in missing]) @ self.net.p["w"] + self.net.p["bias"]
            for t, x in zip(self.tables, np.split(found, 2, axis=1), strict=True):
                t[base : base + len(missing)] = x
            known.update(zip(missing, range(base, base + len(missing)), strict=True))
        return np.fromiter(map(known.__getitem__, raw), np.int32, len(raw))

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest window's probability of each text."""
        best = np.full(len(texts), -np.inf)
        owner: list = []
        wins: list = []

        def run() -> None:
            w, o = np.concatenate(wins), np.concatenate(owner)
            for s in range(0, len(w), BLOCK):
                part = w[s : s + BLOCK]
                np.maximum.at(best, o[s : s + BLOCK], self.net.score(self.tables, np.ascontiguousarray(part.T)))
            wins.clear()
            owner.clear()

        held = 0
        for k, text in enumerate(texts):
            n = self.numbers(text)
            if len(n) < WINDOW:
                n = np.concatenate([n, np.zeros(WINDOW - len(n), np.int32)])
            at = np.array(starts(len(n)))
            wins.append(np.lib.stride_tricks.sliding_window_view(n, WINDOW)[at])
            owner.append(np.full(len(at), k))
            held += len(at)
            if held >= 4 * BLOCK or len(self.known) > CACHE:
                run()
                held = 0
                if len(self.known) > CACHE:
                    self.reset()
        if wins:
            run()
        return sigmoid(best)


def fit(docs: DataFrame, labels: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN):
    """Trains on the bounded sample of labelled documents for which the condition ``usable`` on the id holds.

    Null labels are left out; of repeated labels any toxic one counts.
    """
    names = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull())
    names = names.groupBy("id").agg(F.max("y").alias("y"))
    if usable is not None:
        names = names.where(usable(F.col("id")))
    by_hash = lambda y, most: names.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
    chosen = F.broadcast(by_hash(1, max_toxic).union(by_hash(0, max_clean)))  # bounded by the sample
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= MAX_CHARS).join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample = sorted((r["id"], r["text"], r["y"]) for r in rows.collect())
    model = train([t for _, t, _ in sample], [y for _, _, y in sample])
    if isinstance(model, Network):  # the sample's share of toxic documents is not the labels'
        of = {r["y"]: r["count"] for r in names.groupBy("y").count().collect()}
        toxic = sum(y for _, _, y in sample)
        model.p["b"] += np.float32(np.log(of[1] / of[0]) - np.log(toxic / (len(sample) - toxic)))
    return model


def with_scores(rows: DataFrame, text_col: str, model, below: float | None = None) -> DataFrame:
    """``rows`` with a last column ``score``, or only the rows that score below ``below``, in one pass."""
    held, at_text = rows.sparkSession.sparkContext.broadcast(model), rows.columns.index(text_col)

    def run(batches):
        net = held.value
        scorer = None if isinstance(net, float) else Scorer(net)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                score = np.full(part.num_rows, net) if scorer is None else scorer.scores([t or "" for t in part.column(at_text).to_pylist()])
                if below is None:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, "score"])
                else:
                    yield part.filter(pa.array(score < below))

    return rows.mapInArrow(run, rows.schema if below is not None else StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def scored(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` for every row."""
    return with_scores(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", model).select("id", "score")


def held_out(column):
    """One third of the ids: crc32 of the id as text, remainder 1; null ids count as held out."""
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(True))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that score below ``threshold``; trained on labels outside the held-out third."""
    return with_scores(docs, text_col, fit(docs, labels, lambda c: ~held_out(c), id_col, text_col), below=threshold)
