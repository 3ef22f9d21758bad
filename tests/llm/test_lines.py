import random

from pyspark.sql import functions as F

from pagewright.llm import lines as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edits(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(3)
        at = rng.randrange(len(s) + (k == 1))
        if k == 0:
            s[at] = rng.choice("abcdé")
        elif k == 1:
            s.insert(at, rng.choice("abcdé"))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


def allowed(a, b):
    return 2 if min(len(a), len(b)) >= L.TWO_EDITS else 1


def test_banded_distance(spark):
    rng = random.Random(0)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        b = edits(rng, a, rng.randint(0, 4))
        if len(a) < len(b):
            a, b = b, a
        for t in (1, 2, 3):
            if len(a) - len(b) <= t:
                rows.append((a, b, t, distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, t int, want int").select("t", "want", F.split("a", "").alias("p"), F.split("b", "").alias("q"))
    for r in df.select("t", "want", F.expr(L.edit_distance("p", "q", "t")).alias("got")).collect():
        assert min(r.got, r.t + 1) == min(r.want, r.t + 1), r


def make(rng):
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([20, 25, 38, 41, 60, 200]))) for _ in range(12)]
    pool = list(base)
    for b in base:
        pool += [edits(rng, b, rng.randint(0, 3)) for _ in range(6)]
    chain = base[4] + "zzzz" * 5
    for i in range(8):  # neighbours are linked, the ends aren't
        pool.append(chain)
        chain = edits(rng, chain, 2)
    pool += ["short", "short", "", " ", "x" * 30, "x" * 29, "x" * 19, "x" * 20]
    return pool


def test_same_as_brute_force(spark):
    rng = random.Random(7)
    pool = make(rng)
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "\n\n"), (3, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (None, pool[0]), (80, "q" * 3000), (81, "q" * 3001)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, line string")
    found = L.dedup_lines(df)
    out = found.collect()
    distinct = sorted({x for _, t in docs for x in (t or "").split("\n") if x.strip()})
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if len(a) < 1000 and linked(a, b):
                parent[find(a)] = find(b)
    parent[find("q" * 3001)] = find("q" * 3000)
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    first = {}
    dropped = {}
    for i in order:
        for pos, x in enumerate((docs[i][1] or "").split("\n")):
            if x.strip():
                c = find(x)
                if c in first:
                    dropped.setdefault(i, []).append(pos)
                else:
                    first[c] = i
    want = sorted((str(docs[i][0]), len((docs[i][1] or "").split("\n")), str(dropped.get(i, []))) for i in range(len(docs)))
    got = sorted((str(r.doc_id), r.n_lines, str(r.dropped)) for r in out)
    # Which of equal ids or none keeps a line isn't fixed; compare those by their sums.
    plain = lambda rows: [r for r in rows if r[0] not in ("3", "None")]
    assert plain(got) == plain(want)
    assert sum(r.n_dropped for r in out) == sum(map(len, dropped.values()))
    left = L.without_lines(df, found).collect()
    kept = [x for r in left for x in (r.text or "").split("\n") if x.strip()]
    assert len(kept) == len(first) and len({find(x) for x in kept}) == len(first)
    assert {r.doc_id for r in left} >= {70, 71, 72}
    assert L.dedup_lines(df.limit(0)).count() == 0


def linked(a, b):
    words = [x.split(" ") for x in (a, b)]
    shorter = min(map(len, words))
    t = max([0, *(k for low, k in L.WORD_EDITS if shorter >= low)])
    chars = shorter < L.LONG and min(len(a), len(b)) >= L.MIN_CHARS and abs(len(a) - len(b)) <= 2 and distance(a, b) <= allowed(a, b)
    return chars or (t > 0 and abs(len(words[0]) - len(words[1])) <= t and distance(*words) <= t)


def word_pool(rng):
    """Lines of 8 to 70 words and copies of them in which words are replaced, inserted or dropped."""
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    pool = []
    for n in (8, 14, 15, 16, 29, 30, 31, 32, 45, 70, 89, 90, 93, 120):
        base = [rng.choice(vocabulary) for _ in range(n)]
        pool.append(" ".join(base))
        for k in range(7):
            own = list(base)
            for _ in range(rng.randint(1, max(1, n // 30) + 1)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([["changedword"], [], [own[at], "another"], [rng.choice(vocabulary)]])
            pool.append(" ".join(own))
    return sorted(set(pool))


def test_long_lines_with_changed_words(spark):
    rng = random.Random(3)
    pool = word_pool(rng)
    docs = [(i, x) for i, x in enumerate(pool)]
    parent = list(range(len(pool)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(pool):
        for j in range(i):
            if linked(a, pool[j]):
                parent[find(i)] = find(j)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = L.dedup_lines(df).collect()
    first = {}
    for i in range(len(pool)):
        first.setdefault(find(i), i)
    assert len(first) < len(pool) - 20
    assert {r.doc_id: (r.n_dropped, r.kept_in) for r in out} == {i: (0, []) if first[find(i)] == i else (1, [first[find(i)]]) for i in range(len(pool))}


def test_short_lines_by_equality(spark):
    docs = [(1, "short\nother\n\n \nshort"), (2, "Short\nshort\n\n\t\né"), (3, "é\nshorts\n \n" + "x" * 19), (4, "x" * 19 + "\n" + "x" * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: (r.n_lines, r.dropped, r.kept_in) for r in L.dedup_lines(df).collect()}
    assert out == {1: (5, [4], [1]), 2: (5, [1], [1]), 3: (4, [0], [2]), 4: (2, [0], [3])}


def test_classes_of_a_bucket_that_no_centre_joins(spark):
    """Chains and groups that meet in one bucket but are apart from its centre."""
    stem = "the same first half of the line " + "x" * 20
    pool = [stem + f"{k:02d}" * 10 for k in range(12)]
    pool += [edits(random.Random(k), pool[k % 12][40:], 1) for k in range(40)]
    pool += [pool[j][:50] + edits(random.Random(90 + j), pool[j][50:], 2) for j in range(12) for _ in range(2)]
    pool = sorted(set(pool))
    parent = list(range(len(pool)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(pool):
        for j in range(i):
            if linked(a, pool[j]):
                parent[find(i)] = find(j)
    out = L.dedup_lines(spark.createDataFrame(list(enumerate(pool)), "doc_id long, text string")).collect()
    got = {}
    for r in out:
        got.setdefault(r.shared[0].class_id if r.shared else -r.doc_id, set()).add(r.doc_id)
    want = {}
    for i in range(len(pool)):
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
