import zlib

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import toxicity as T


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        starts = T.windows_of(n)
        assert {i for s in starts for i in range(s, min(n, s + T.WINDOW))} == set(range(n))
        assert all(b - a <= T.STRIDE for a, b in zip(starts, starts[1:]))


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in T.new_params(1).items()}
    x = T.embed(p, T.word_inputs([" ", "one", "two", "three", "fours"])).astype(np.float64)
    ids = np.array([[1, 2, 3, 4, 0, 0], [4, 4, 2, 1, 3, 2]])

    def loss():
        gates = np.stack([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]])
        gates[:, 0] = 0
        return gates, T.run_windows(p, gates, ids)

    keep = []
    gates, logit = loss()
    T.run_windows(p, gates, ids, keep)
    d = np.array([0.7, -0.4])
    grad, _ = T.backward(p, x.astype(np.float32), ids, keep, d.astype(np.float32))
    for k in ("Uf", "Ub", "Wf", "attb", "outf"):
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        old = p[k][at]
        p[k][at] = old + 1e-2
        up = loss()[1] @ d
        p[k][at] = old - 1e-2
        down = loss()[1] @ d
        p[k][at] = old
        assert abs((up - down) / 2e-2 - grad[k][at]) < 2e-3, k


def test_learns_and_scores_tables(spark):
    rng = np.random.default_rng(3)
    clean = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        words = list(rng.choice(clean, rng.integers(5, 150)))
        toxic = i % 3 == 0
        if toxic:
            words.insert(int(rng.integers(0, len(words))), ["nasty", "vilest", "vilely"][i % 9 // 3])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, ""), (1001, ""), (None, "nasty " * 3000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    out = T.score_documents(docs, T.fit(docs, labels)).collect()
    assert len(out) == 404
    held = {r.doc_id: r for r in out if r.held_out}
    assert set(held) == {i for i in [*range(400), 1000, 1001] if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [r.predicted == rows[i][2] for i, r in held.items() if i < 400]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    blank = {r.score for r in out if not r.text}
    assert len(blank) == 1
    assert [r for r in out if r.doc_id is None][0].predicted == 1
    assert T.score_documents(docs.limit(0), T.new_params()).count() == 0
    T.score_documents(docs, T.fit(docs, labels.limit(0))).count()


def test_long_runs_are_read_to_their_end():
    rng = np.random.default_rng(2)
    letters = [chr(0x4E00 + i) for i in range(300)]
    assert T.find_words("some_words " + "x" * 40 + " é") == ["some_words", "x" * 40, "é"]
    for n in (41, 44, 45, 76, 77, 200, 2001):
        run = "".join(rng.choice(letters, n))
        pieces = T.find_words(run)
        assert all(len(p) <= 40 for p in pieces)
        assert {run[i : i + 5] for i in range(n - 4)} <= {p[i : i + 5] for p in pieces for i in range(len(p) - 4)}
    # What characters far into a run add reaches its score.
    p, q = T.new_params(), T.new_params()
    q["gram"][T.word_inputs(["abcde"])[1]] += 1
    for at in (0, 38, 300, 1990):
        run = "".join(rng.choice(letters, 2000))
        texts = [run[:at] + "abcde" + run[at:]]
        assert abs(T.Scorer(p).scores(texts)[0] - T.Scorer(q).scores(texts)[0]) > 1e-6, at


def plain_score(p, text):
    """A text's score, one word and one unit at a time."""
    words = T.find_words((text or "").lower())
    h = T.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    inputs = []
    for w in words:
        rows, grams, sizes = T.word_inputs([w])
        gram = sum(p["gram"][g].astype(np.float64) for g in grams) / np.sqrt(sizes[0])
        inputs.append(np.concatenate([p["word"][rows[0]].astype(np.float64), gram]))
    best = -np.inf
    for start in T.windows_of(len(words)):
        window = inputs[start : start + T.WINDOW]
        score, value = np.zeros(len(window)), np.zeros(len(window))
        for k in "fb":
            state = np.zeros(h)
            for t in range(len(window)) if k == "f" else reversed(range(len(window))):
                gate, rec = window[t] @ p[f"W{k}"] + p[f"c{k}"], state @ p[f"U{k}"]
                r, z = sig(gate[:h] + rec[:h]), sig(gate[h : 2 * h] + rec[h : 2 * h])
                new = np.tanh(gate[2 * h :] + r * rec[2 * h :])
                state = (1 - z) * new + z * state
                score[t] += state @ p[f"att{k}"]
                value[t] += state @ p[f"out{k}"]
        weight = np.exp(score - score.max()) if len(window) else np.zeros(0)
        best = max(best, (weight @ value / weight.sum() if len(window) else 0.0) + p["bias"][0])
    return sig(best)


def test_scores_are_those_of_a_plain_forward_pass(spark):
    rng = np.random.default_rng(8)
    p = {k: v * 3 for k, v in T.new_params(4).items()}
    vocabulary = [f"wörd{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 31, 32, 33, 56, 57, 140)] + [None, "", "\n \t", "x" * 95]
    rows = T.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), p).collect()
    assert all(abs(r.score - plain_score(p, r.text)) < 1e-4 for r in rows) and len({r.score for r in rows}) > 8


def test_repeated_ids_are_learned_from_once(spark):
    docs = [(i, f"clean words here {i}") for i in range(60)] + [(i, f"nasty words here {i}") for i in range(60, 90)] + [(61, "another nasty text")] * 400
    labels = [(i, int(i >= 60)) for i in range(90)]
    params = T.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), train_docs=30, steps=60)
    a, b = T.Scorer(params).scores(["clean words here", "nasty words here"])
    assert a < 0.3 < b
