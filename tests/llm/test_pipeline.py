import hashlib
import random
import zlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from pagewright.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g1 string"


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = [(i, "\n".join(" ".join(word() for _ in range(20)) for _ in range(4)), "en", f"s{i % 3}") for i in range(300)]
    shared = " ".join(word() for _ in range(60))
    for i in range(0, 300, 9):
        docs[i] = (i, docs[i][1] + "\n" + shared, *docs[i][2:])
    toxic = {i for i in range(300) if i % 5 == 1}
    for i in toxic:
        docs[i] = (i, docs[i][1] + " vilest", *docs[i][2:])
    near = docs[2][1].replace("\n", " ")
    docs += [(400, near, "en", "s1"), (401, near.replace(" ", "  ", 1), "en", "s1"), (402, docs[3][1], "en", "s1"), (403, None, "en", None), (403, None, "en", None)]
    return docs, toxic, shared


def test_stages(spark, tmp_path):
    docs, toxic, shared = corpus()
    frame = spark.createDataFrame([(*d, len(d[1] or ""), "x") for d in docs], SCHEMA)
    spark.createDataFrame([(i, int(i in toxic)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "piece_encoding"]
    left = P.materialize(stages["toxicity"](spark, frame, str(tmp_path)))
    ids = {r.doc_id for r in left.collect()}
    assert not ids & toxic and ids >= {i for i in range(300)} - toxic
    assert left.schema.names == frame.schema.names
    lines = P.materialize(stages["line_dedup"](spark, left, str(tmp_path)))
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert [i for i, t in texts.items() if t and shared in t] == [0]
    assert 402 not in texts and 403 in texts and 400 in texts
    assert all(texts[i] == docs[i][1].replace("\n" + shared, "") for i in ids if i < 300 and i)
    near = P.materialize(stages["near_dedup"](spark, lines, str(tmp_path)))
    kept = sorted(r.doc_id for r in near.collect())
    assert kept == sorted(i for i in texts if i not in (400, 401, 403)) + [403]
    mixed = P.materialize(stages["mixing"](spark, near, str(tmp_path)))
    assert mixed.schema.names == frame.schema.names
    taken = {r.doc_id: r.taken for r in mixing.taken_words(near).collect()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == {i: n for i, n in taken.items() if n}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, hashlib.sha256(",".join(map(str, lib.encode(r.text))).encode()).hexdigest()) for r in mixed.collect())
    out = stages["piece_encoding"](spark, mixed, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in out) == want


def test_mixing_reaches_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 30, 400]))), rng.choice(["a", "a", "a", "b", None, "tiny"]) if i else "tiny") for i in range(200)]
    rows = [r for r in rows if r[2] != "tiny" or r[0] < 12] + [(500, None, "blank"), (1, rows[1][1], rows[1][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for block in (16, 64):
        out = mixing.taken_words(docs, block, cell_rows=7).collect()
        assert len(out) == len(rows)
        sums, targets, sizes = {}, {}, {}
        for r in out:
            assert r.taken <= 3 * r.size and r.taken == sum(s.hi - s.lo for s in r.spans)
            sums[r.source] = sums.get(r.source, 0) + r.taken
            sizes[r.source] = sizes.get(r.source, 0) + r.size
            targets[r.source] = r.target
        total = sum(sizes.values())
        weights = dict(zip([*sorted(s for s in sizes if s is not None), None], (5, 2, 1) * 3))
        want, free, rest = {}, set(sizes), float(total)
        while True:  # reshare by weight until none is above
            share = {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
            over = {s for s in free if share[s] >= 3 * sizes[s]}
            if not over:
                want |= share
                break
            want |= {s: 3 * sizes[s] for s in over}
            rest -= sum(3 * sizes[s] for s in over)
            free -= over
        for s in sizes:
            assert abs(targets[s] - want[s]) < 1e-6 and abs(sums[s] - want[s]) <= 0.5
    assert mixing.taken_words(docs.limit(0)).count() == 0


def packed(vectors, n_shards):
    """Vector bin packing in plain loops."""
    totals = [sum(v[d] for v in vectors) or 1 for d in range(3)]
    left = [[1 / n_shards] * 3 for _ in range(n_shards)]
    out = {}
    for v, name in sorted(((tuple(x / t for x, t in zip(v, totals)), i) for i, v in enumerate(vectors)), key=lambda p: (-max(p[0]), p[1])):
        out[name] = max(range(n_shards), key=lambda s: (sum(a * b * w for a, b, w in zip(v, left[s], sharding.WEIGHTS)), -s))
        left[out[name]] = [a - b for a, b in zip(left[out[name]], v)]
    return [out[i] for i in range(len(vectors))]


def held(docs, out, n_shards=8):
    """Checks what must hold of any sharding; returns the shards of every text and the sizes of shards."""
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots, sizes, where = {}, [0] * n_shards, {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r.size
        where.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return where, sizes


def test_packing_is_that_of_plain_loops():
    rng = random.Random(6)
    for n in (1, 7, 8, 90):
        vectors = [(rng.randint(1, 500), rng.randint(0, 90), rng.randint(1, 9)) for _ in range(n)]
        assert sharding.place(vectors, 8) == packed(vectors, 8)
    assert sharding.place([(1, 0, 1)] * 5, 3) == packed([(1, 0, 1)] * 5, 3)


def test_sharding(spark):
    rng = random.Random(2)
    docs = [(i, "t" * rng.randint(0, 300)) for i in range(900)] + [(1000 + i, "hot " * 20) for i in range(500)] + [(7, None), (7, None), (None, "")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, row string")
    where, sizes = held(docs, sharding.assign_shards(frame).collect())
    assert max(sizes) < 1.05 * sum(sizes) / 8
    hot = (zlib.crc32(b"hot " * 20), 81)
    assert len(where.pop(hot)) > 1 and all(len(s) == 1 for s in where.values())
    # Without names all but the hot group are dealt by cells.
    where, sizes = held(docs, sharding.assign_shards(frame, cells=64, named=9).collect())
    assert max(sizes) < 1.3 * sum(sizes) / 8 and len(where.pop(hot)) > 1 and all(len(s) == 1 for s in where.values())
    assert sharding.assign_shards(frame.limit(0)).count() == 0


def test_groups_by_name_are_packed_as_in_plain_loops(spark):
    rng = random.Random(9)
    counts = rng.sample(range(1, 200), 40)  # different sizes, so that the order is one
    docs = [(i, "same text " + f"{g:03d}" * 9) for i, g in enumerate(g for g, n in enumerate(counts) for _ in range(n))]
    # The largest has less than a shard's share.
    assert max(counts) < sum(counts) / 8
    where, _ = held(docs, sharding.assign_shards(spark.createDataFrame(docs, "doc_id long, text string"), cells=1).collect())
    got = [where[zlib.crc32(t.encode()), len(t) + 1] for t in (f"same text {f'{g:03d}' * 9}" for g in range(40))]
    assert got == [{s} for s in packed([(38 * n, 3 * n, n) for n in counts], 8)]


def test_a_hot_group_of_one_id_is_split_and_a_fitting_one_is_not(spark):
    small = [(i, "s" * (i % 200) + str(i)) for i in range(400)]
    for docs in (small + [(5, "repeated row " * 6)] * 600, small + [(None, "no id " * 9)] * 600):
        where, sizes = held(docs, sharding.assign_shards(spark.createDataFrame(docs, "doc_id long, text string")).collect())
        assert max(sizes) < 1.1 * sum(sizes) / 8
    docs = small + [(1000 + i, "fortycopiesfitashard") for i in range(40)]
    where, sizes = held(docs, sharding.assign_shards(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert all(len(s) == 1 for s in where.values()) and max(sizes) < 1.05 * sum(sizes) / 8
