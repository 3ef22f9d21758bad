"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters the network as its own hashed embedding beside the scaled sum of the hashed embeddings of
its character 3-, 4- and 5-grams.  A text is read in overlapping windows of words; each window is run through a
gated recurrent network in both directions, attention pools the states, and the score of the text is
that of its highest window.  Training is by numpy in one task, whose result is the parameters: a text's
label is carried by its highest window, out of the four with the highest log odds and two others.

Where scoring is concerned, what a word adds to the gates depends on the word alone, so these
projections are kept in a bounded table for each worker, and a batch is one gather and a few small
matrix products for each step of a window.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_ROWS, WORD_DIM, GRAM_ROWS, GRAM_DIM = 12, 8192, 8, 16384, 16
#: Bound of the labelled sample: documents of each class.
TRAIN_DOCS = 1500

#: Longer runs of word characters are cut into pieces of so many, each beginning with the last ones of the piece before, so that no n-gram is lost.
PIECE, OVERLAP = 40, 4

_runs = re.compile(r"\w+").findall


def find_words(text: str) -> list[str]:
    """The words of a text: runs of word characters, long ones in pieces that are words of their own."""
    runs = _runs(text)
    if max(map(len, runs), default=0) <= PIECE:
        return runs
    return [w[i : i + PIECE] for w in runs for i in range(0, max(1, len(w) - OVERLAP), PIECE - OVERLAP)]


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The embedding row of each word, those of its character n-grams (all words' together), and how many grams each has.

    Words are marked at both ends, so that a gram tells a beginning.
    """
    marked = [f"<{w}>" for w in words]
    rows = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % WORD_ROWS for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes))
    grams, owners = [], []
    for n in (3, 4, 5):
        own = at[: max(0, len(codes) - n + 1)]
        own = own[own + n <= ends[own]]
        value = np.full(len(own), n, np.uint64)
        for k in range(n):
            value = (value ^ codes[own + k]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        grams.append((value >> np.uint64(20)).astype(np.int64) % GRAM_ROWS)
        owners.append(owner[own])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    return rows, grams[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))


def windows_of(n: int) -> list[int]:
    """The starts of the windows over n words: every STRIDE words, the last one reaching the end."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_params(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + GRAM_DIM, HIDDEN
    p = {"word": rng.normal(0, 0.1, (WORD_ROWS, WORD_DIM)), "gram": rng.normal(0, 0.1, (GRAM_ROWS, GRAM_DIM))}
    for k in "fb":
        p |= {f"W{k}": rng.normal(0, d**-0.5, (d, 3 * h)), f"U{k}": rng.normal(0, h**-0.5, (h, 3 * h)), f"c{k}": np.zeros(3 * h)}
        p |= {f"att{k}": rng.normal(0, 0.3, h), f"out{k}": rng.normal(0, 0.5, h)}
    return {k: v.astype(np.float32) for k, v in p.items()} | {"bias": np.full(1, -1.0, np.float32)}


def embed(p: dict, inputs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The embeddings of words, one row each."""
    rows, grams, sizes = inputs
    total = np.add.reduceat(p["gram"][grams], np.cumsum(sizes) - sizes, axis=0)
    return np.concatenate([p["word"][rows], total / np.sqrt(sizes[:, None]).astype(np.float32)], axis=1)


def project(p: dict, x: np.ndarray) -> np.ndarray:
    """What words add to the gates of both directions."""
    return np.stack([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]]).astype(np.float32)


def run_windows(p: dict, gates: np.ndarray, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The logits of windows.  ids: rows of ``gates`` (direction, row, gate inputs), one line for each window; row 0 pads.  keep: gets what a backward pass needs."""
    n, steps, h = len(ids), ids.shape[1], HIDDEN
    score, value = np.empty((2, n, steps), np.float32), np.empty((2, n, steps), np.float32)
    for k, name in enumerate("fb"):
        u, att, out = p[f"U{name}"], p[f"att{name}"], p[f"out{name}"]
        own = gates[k]
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if k == 0 else reversed(range(steps)):
            g = own[ids[:, t]]
            rec = state @ u
            rz = g[:, : 2 * h] + rec[:, : 2 * h]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            new = np.tanh(g[:, 2 * h :] + rz[:, :h] * rec[:, 2 * h :])
            if keep is not None:
                keep.append((k, t, state, rz, rec[:, 2 * h :], new))
            state = new + rz[:, h:] * (state - new)
            score[k, :, t] = state @ att
            value[k, :, t] = state @ out
            if keep is not None:
                keep[-1] += (state,)
    s = score[0] + score[1]
    s[ids == 0] = -1e9
    s -= s.max(axis=1, keepdims=True)
    w = np.exp(s)
    w[ids == 0] = 0
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
    v = value[0] + value[1]
    if keep is not None:
        keep.append((w, v))
    return (w * v).sum(axis=1) + p["bias"][0]


def sum_rows(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """An array of n rows to each of which the values with its number are added."""
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(rows, kind="stable")
    found, starts = np.unique(rows[order], return_index=True)
    out[found] = np.add.reduceat(values[order], starts, axis=0)
    return out


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def start_at_odds(p: dict, docs: list[np.ndarray], inputs: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray) -> None:
    """Set the first component of every embedding row to the log odds of meeting it in a text of class 1."""
    counts = {"word": np.zeros((2, WORD_ROWS)), "gram": np.zeros((2, GRAM_ROWS))}
    rows, grams, sizes = inputs
    starts = np.cumsum(sizes) - sizes
    for doc, y in zip(docs, labels.astype(int), strict=True):
        seen = np.unique(doc)
        counts["word"][y, np.unique(rows[seen])] += 1
        counts["gram"][y, np.unique(grams[spans(starts[seen], sizes[seen])])] += 1
    total = np.array([(labels == 0).sum(), (labels == 1).sum()])
    for k, (c0, c1) in counts.items():
        odds = np.log((c1 + 0.5) / (total[1] + 1)) - np.log((c0 + 0.5) / (total[0] + 1))
        sure = np.abs(odds) > 2.5 * np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
        p[k][:, 0] = np.where(sure, odds, 0) / 2


def backward(p: dict, x: np.ndarray, ids: np.ndarray, keep: list, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of the word embeddings x (row 0 pads)."""
    h = HIDDEN
    w, v = keep[-1]
    d_value = w * d_logit[:, None]
    pooled = (w * v).sum(axis=1, keepdims=True)
    d_score = d_value * (v - pooled)
    grad = {"bias": np.array([d_logit.sum()])}
    d_words = np.empty((*ids.shape, 6 * h), np.float32)
    for k, name in enumerate("fb"):
        u, att, out = p[f"U{name}"], p[f"att{name}"], p[f"out{name}"]
        d_u, d_att, d_out = np.zeros_like(u), np.zeros_like(att), np.zeros_like(out)
        d_state = np.zeros((len(ids), h), np.float32)
        for kk, t, before, rz, rec_n, new, after in reversed(keep[:-1]):
            if kk != k:
                continue
            d_att += d_score[:, t] @ after
            d_out += d_value[:, t] @ after
            d = d_state + d_score[:, t, None] * att + d_value[:, t, None] * out
            r, z = rz[:, :h], rz[:, h:]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * rec_n * r * (1 - r)
            d_rec = np.concatenate([d_r, d_z, d_new * r], axis=1)
            d_u += before.T @ d_rec
            d_state = d * z + d_rec @ u.T
            d_words[:, t, 3 * h * k : 3 * h * (k + 1)] = np.concatenate([d_r, d_z, d_new], axis=1)
        grad |= {f"U{name}": d_u, f"att{name}": d_att, f"out{name}": d_out}
    d_gates = sum_rows(d_words.reshape(-1, 6 * h), ids.ravel(), len(x))
    d_x = np.zeros_like(x)
    for k, name in enumerate("fb"):
        part = d_gates[:, 3 * h * k : 3 * h * (k + 1)]
        grad |= {f"W{name}": x.T @ part, f"c{name}": part.sum(axis=0)}
        d_x += part @ p[f"W{name}"].T
    return grad, d_x


def train(texts: list[str], labels: list[int], steps: int = 400, seed: int = 5, batch: int = 48, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Parameters learned from texts with labels 0 and 1.  Without rows of both classes the score is a constant near that class."""
    p = new_params(seed)
    if len(set(labels)) < 2:
        p["bias"][:] = 4.0 if labels and labels[0] else -4.0
        p["outf"][:] = p["outb"][:] = 0
        return p
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in find_words(t.lower())], np.int32) for t in texts]
    listed = [" ", *vocab]
    parts = [word_inputs(listed[lo : lo + 20_000]) for lo in range(0, len(listed), 20_000)]  # in parts, to bound memory
    inputs = tuple(np.concatenate([part[k].astype(np.int32) for part in parts]) for k in range(3))
    del listed, parts
    all_rows, all_grams, all_sizes = inputs
    all_starts = np.cumsum(all_sizes, dtype=np.int64) - all_sizes
    rng = np.random.default_rng(seed)
    y_all = np.array(labels, np.float32)
    weight = np.where(y_all == 1, 0.5 / y_all.mean(), 0.5 / (1 - y_all.mean())).astype(np.float32)
    start_at_odds(p, docs, inputs, y_all)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    prior = p["word"][all_rows, 0] + np.add.reduceat(p["gram"][all_grams, 0], all_starts) / np.sqrt(all_sizes)
    prior[0] = 0
    candidates = []
    for doc in docs:
        starts = np.array(windows_of(len(doc)))
        if len(starts) > 6:
            run = np.concatenate(([0], np.cumsum(np.maximum(prior[doc], 0))))
            best = np.argsort(run[starts] - run[starts + WINDOW], kind="stable")
            starts = starts[np.concatenate([best[:4], best[4:][rng.permutation(len(best) - 4)[:2]]])]
        candidates.append(starts)
    for _ in range(max(4, -(-steps * batch // len(docs)))):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            lines, owner = [], []
            for i in chosen:
                for s in candidates[i]:
                    lines.append(docs[i][s : s + WINDOW])
                    owner.append(i)
            ids = np.zeros((len(lines), WINDOW), np.int64)
            for j, line in enumerate(lines):
                ids[j, : len(line)] = line
            used, local = np.unique(ids, return_inverse=True)
            if used[0]:
                used, local = np.concatenate(([0], used)), local + 1
            local = local.reshape(ids.shape)
            own = all_rows[used], all_grams[spans(all_starts[used], all_sizes[used])], all_sizes[used]
            x = embed(p, own)
            gates = project(p, x)
            gates[:, 0] = 0
            owner = np.array(owner)
            logit = run_windows(p, gates, local)
            pick = np.array([(at := np.flatnonzero(owner == i))[logit[at].argmax()] for i in chosen])
            keep: list = []
            logit = run_windows(p, gates, local[pick], keep)
            y, wt = y_all[owner[pick]], weight[owner[pick]]
            grad, d_x = backward(p, x, local[pick], keep, ((sigmoid(logit) - y) * wt / len(pick)).astype(np.float32))
            d_x[0] = 0
            grad["word"] = sum_rows(d_x[:, :WORD_DIM], own[0], WORD_ROWS)
            spread = np.repeat(d_x[:, WORD_DIM:] / np.sqrt(own[2][:, None]), own[2], axis=0)
            grad["gram"] = sum_rows(spread, own[1], GRAM_ROWS)
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


class Scorer:
    """Scores texts; the gate inputs of words are kept in a table of bounded size that starts anew when it is full."""

    def __init__(self, params: dict, limit: int = 200_000):
        self.p, self.limit = params, limit
        self._reset()

    def _reset(self):
        self.rows: dict[str, int] = {}
        self.gates = np.zeros((2, 1024, 3 * HIDDEN), np.float32)

    def _lookup(self, words: list[list[str]]) -> list[list[int]]:
        known = self.rows
        fresh = list({w for ws in words for w in ws if w not in known})
        if len(known) + len(fresh) > self.limit and known:
            self._reset()
            return self._lookup(words)
        if fresh:
            at = len(known) + 1
            while at + len(fresh) > self.gates.shape[1]:
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)], axis=1)
            for lo in range(0, len(fresh), 20_000):
                part = fresh[lo : lo + 20_000]
                self.gates[:, at + lo : at + lo + len(part)] = project(self.p, embed(self.p, word_inputs(part)))
            known.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return [list(map(known.__getitem__, ws)) for ws in words]

    def scores(self, texts: list[str | None]) -> list[float]:
        out = np.empty(len(texts))
        lo = 0
        while lo < len(texts):  # about 100,000 words at a time
            words, total = [], 0
            while lo + len(words) < len(texts) and (not words or total < 100_000):
                words.append(find_words((texts[lo + len(words)] or "").lower()))
                total += len(words[-1])
            flat, starts, sizes = [], [], []
            for ids in self._lookup(words):
                base = len(flat)
                ws = windows_of(len(ids))
                flat += ids
                if len(ids) < WINDOW:
                    flat += [0] * (WINDOW - len(ids))
                starts += [base + s for s in ws]
                sizes.append(len(ws))
            grid = np.array(flat, np.int64)[np.array(starts)[:, None] + np.arange(WINDOW)]
            logit = np.concatenate([run_windows(self.p, self.gates, grid[i : i + 4096]) for i in range(0, len(grid), 4096)])
            best = np.maximum.reduceat(logit, np.concatenate(([0], np.cumsum(sizes)[:-1])))
            out[lo : lo + len(words)] = sigmoid(best.astype(np.float64))
            lo += len(words)
        return out.tolist()


def held_out_column(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, **options) -> dict[str, np.ndarray]:
    """Learn from a bounded sample: of each class the ``train_docs`` ids first by a hash, with their whole texts.

    Rows held out, without label or without id are never in it; a row labelled twice counts with its highest label,
    and of rows with one id the text first in order.  One task trains; the driver gets the parameters, of a fixed size.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).filter(~held_out_column()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = [known.filter(F.col("y") == y).orderBy(*order).limit(train_docs) for y in (0, 1)]
    # The sample has at most 2 * train_docs ids, so it can be broadcast; no other text is shuffled.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample[0].union(sample[1])), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").cast("int").alias("y"))
    rows = rows.select("y", F.xxhash64("doc_id").alias("h"), "doc_id", "text").repartition(1).sortWithinPartitions("y", "h", "doc_id")

    def learn(batches):
        texts, labels = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            labels += batch.column("y").to_pylist()
        if texts:
            for name, value in train(texts, labels, **options).items():
                yield pa.RecordBatch.from_pydict({"name": [name], "shape": pa.array([list(value.shape)], pa.list_(pa.int32())), "value": [value.astype(np.float32).tobytes()]})

    found = rows.select("y", "text").mapInArrow(learn, "name string, shape array<int>, value binary").collect()
    return {r["name"]: np.frombuffer(bytes(r["value"]), np.float32).reshape(r["shape"]) for r in found} or train([], [], **options)


_scorers: dict[str, Scorer] = {}


def score_documents(docs: DataFrame, params: dict[str, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """Adds held_out, score and predicted to ``docs`` (doc_id, text, ...); columns with these names are replaced.

    Whole texts are scored, however long.  A null text counts as an empty one, which has a score of its own.  Equal texts
    get equal scores, repeated rows and ids too.  An empty table gives an empty result.  There is no shuffle; the parameters (about 1.4 MB, a fixed size) are broadcast.
    """
    added = ("held_out", "score", "predicted")
    keep = [c for c in docs.columns if c not in added]
    held, token = docs.sparkSession.sparkContext.broadcast(params), uuid.uuid4().hex
    fields = {c: docs.schema[c].dataType.simpleString() for c in keep}
    schema = ", ".join(f"`{c}` {t}" for c, t in fields.items()) + ", score double"
    docs = docs.select(*keep)

    def run(batches):
        if token not in _scorers:
            _scorers.clear()
            _scorers[token] = Scorer(held.value)
        scorer = _scorers[token]
        for batch in batches:
            scores = scorer.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, "score"])

    scored = docs.mapInArrow(run, schema)
    return scored.select(
        *(f"`{c}`" for c in keep), held_out_column().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
