import random
import re
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import neardup as N


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    x, y = bag(a), bag(b)
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def classes(rows, threshold=0.8):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1] or "", rows[j][1] or ""
            if a == b or jaccard(a, b) >= threshold:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_overlap_is_exact():
    rng = random.Random(0)
    texts = [" ".join(rng.choice("ab c") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "a", "a b c d", "a\tb\nc  d"]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(200)]
    assert np.allclose(N.overlap(pairs), [jaccard(*p) for p in pairs])


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 40).astype(np.uint64)
    wa, wb = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    hits = []
    for s in range(60):
        k = N.mix64(keys + np.uint64(s * 977))
        doc = np.repeat([0, 1], 40)
        w = np.concatenate([wa, wb])
        sig = N.signatures(doc[w > 0], np.concatenate([k, k])[w > 0], w[w > 0], 2)
        assert np.isfinite(sig).all()
        hits.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(hits) - want) < 0.03


def test_blocks_find_the_same_links():
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(150)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = "zz" + rng.choice("abcdef")
        texts.append(" ".join(t))
    comp = np.array([i % 7 for i in range(60)])
    left, right = np.arange(60) < 25, np.arange(60) >= 20
    parent = list(range(7))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def parts(links):
        parent[:] = range(7)
        for a, b in links:
            parent[find(a)] = find(b)
        return [{j for j in range(7) if find(j) == find(i)} for i in range(7)]

    got = N.block_links(texts, comp, left, right, 0.8)
    want = [(comp[i], comp[j]) for i in range(25) for j in range(20, 60) if i != j and jaccard(texts[i], texts[j]) >= 0.8]
    assert len(got) < 7 and parts(got) == parts(want) and want
    assert len(N.block_links(texts, np.arange(60), left, right, 0.8)) < 60


@pytest.mark.parametrize("pair_bucket, block_docs", [(0, 7), (3, 1024), (48, 1024)])
def test_same_classes_as_brute_force(spark, monkeypatch, pair_bucket, block_docs):
    monkeypatch.setattr(N, "PAIR_BUCKET", pair_bucket)
    monkeypatch.setattr(N, "BLOCK_DOCS", block_docs)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(t) // 12])):
                t[rng.randrange(len(t))] = word()
            rows.append((n, " ".join(t)))
            n += 3
    hub = [word() for _ in range(100)]
    for i in range(25):  # a chain: neighbours are near, the ends aren't
        hub[4 * i] = word()
        rows.append((1000 + i, " ".join(hub)))
    rows += [(5, None), (6, ""), (7, " \n"), (8, "one two"), (9, "one two"), (10, "one  two"), (None, rows[0][1]), (None, "alone and without any id at all"), (0, rows[0][1]), (0, rows[0][1]), (0, "another text of the same id it is")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, keys string")
    out = N.near_duplicates(df).collect()
    want = classes(rows)
    members = {}
    for (i, _), c in zip(rows, want, strict=True):
        members.setdefault(c, []).append(i)
    expected = sorted((str(i), str(min((x for x in members[c] if x is not None), default=None)), len(members[c])) for (i, _), c in zip(rows, want, strict=True))
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in out) == expected
    assert sum(r.kept for r in out) == len(members)
    assert N.near_duplicates(df.limit(0)).count() == 0
