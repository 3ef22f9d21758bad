import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagewright.llm import quality as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def test_statistics(spark):
    rng = random.Random(0)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x\x1cy\x00 é😀 <|>\x0b#", "L\nL\n\n \nL", "s " * 20000]
    texts += [rng.choice(["", " "]) + "".join(rng.choice(["a", "b", "Cc", "#", " ", " ", "\n", "é ", "<&>", "\t"]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    out = {r.doc_id: r for r in Q.judge(df, []).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)
        assert r.kept == (not r.base_failed)
    assert Q.judge(df.limit(0), []).count() == 0


def test_learns_a_list():
    rng = random.Random(2)
    rows = [{"a": rng.random(), "b": rng.random()} for _ in range(900)]
    bad = [r["a"] > 0.8 or (r["b"] <= 0.2 and r["a"] > 0.5) for r in rows]
    rules = Q.learn(rows, bad)
    said = [any(all((r[f] > t) == above for f, above, t in rule) for rule in rules) for r in rows]
    assert sum(x == y for x, y in zip(said, bad, strict=True)) > 0.95 * len(rows)
    assert sum(x and not y for x, y in zip(said, bad, strict=True)) < 0.03 * len(rows)
    assert Q.learn([], []) == [] and Q.learn(rows, [False] * 900) == []


def test_fit_and_judge(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(300):
        ws = [word() for _ in range(80)]
        rows.append((i, " ".join(w + ("%%%" if i % 3 == 0 else "") for w in ws)))
    docs = spark.createDataFrame(rows + [(None, "x"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i, _ in rows] + [(None, 0), (1, None)], "doc_id long, quality int")
    rules = Q.fit(docs, labels)
    assert rules
    for r in Q.judge(docs.filter("doc_id is not null and text is not null"), rules).select("doc_id", "kept").collect():
        assert r.kept == (r.doc_id % 3 != 0)
    assert Q.fit(docs, labels.limit(0)) == []
