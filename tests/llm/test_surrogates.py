import random
import re
import time

import pytest
import regex

from pyspark.sql import functions as F

from pagewright.llm import surrogates as P


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_surrogates(spark):
    texts = [
        'mail und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM, ip 97.51.17.173, card 4111111111111111 and 4111-1111-1111-1111.',
        'call +1 (017) 555-7713 now; again +1 017 555 7713! token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"###',
        "Mrs. Anna Berg met Mr. Carl; Госпожа Вера too; 1.2.3 isn't one, nor 12.", None, "", "no data here", "97.51.17.173", "97.51.17.173",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kinds string")
    out = {r.doc_id: r for r in P.replace_entities(df, "k").collect()}
    assert len(out) == len(texts)
    a = out[0].text
    m = re.fullmatch(r"mail (\S+@\S+\.com) or (\S+@\S+\.COM), ip (\d\d\.\d\d\.\d\d\.\d\d\d), card (\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4})\.", a)
    assert m and m[1] != "und.34@mail7.example.com" and m[2] == m[1].upper() and m[5].replace("-", "") == m[4] and luhn(m[4]) and m[4] != "4111111111111111"
    assert all(int(x) < 256 for x in m[3].split(".")) and out[6].text == out[7].text == m[3]
    b = re.fullmatch(r'call (\+\d \(\d{3}\) \d{3}-\d{4}) now; again (\+\d \d{3} \d{3} \d{4})! token = "([0-9a-f]{40})"###', out[1].text)
    assert b and re.sub(r"\D", "", b[1]) == re.sub(r"\D", "", b[2]) and "04dbebab" not in out[1].text
    c = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+); Госпожа (\w+) too; 1\.2\.3 isn't one, nor 12\.", out[2].text)
    assert c and c[1] in P.NAMES["given_f_latin"] and c[2] in P.NAMES["family_latin"] and c[3] in P.NAMES["family_latin"] and c[4] in P.NAMES["family_f_cyrillic"]
    assert out[3].text is None and out[4].text == "" and out[5].text == "no data here" and out[5].n_entities == 0
    assert out[0].kinds == ["card", "email", "ip"] and out[0].n_entities == 5
    assert P.replace_entities(df.limit(0), "k").count() == 0


def test_distinct_entities_stay_distinct(spark):
    rows = [(i, f"10.0.0.{i % 10} and Mr. {'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[i % 26]}{'aeiou'[i % 5]}x") for i in range(130)]
    out = P.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    before = {}
    for r in out:
        for old, new in zip(rows[r.doc_id][1].split(" and "), r.text.split(" and "), strict=True):
            assert before.setdefault(old, new) == new
    assert len(set(before.values())) == len(before) and not set(before) & set(before.values())


def entities(text):
    return [m[0] for m in regex.finditer(P.PATTERN, text or "")]


def test_against_a_plain_scan(spark):
    """Every entity a plain scan finds is replaced, one for one, injectively; everything between stays."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 8)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makers = [
        lambda: f"{word()}.{word()}@{word()}.example.org", lambda: f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"DE{digits(20)}", lambda: " ".join(digits(4) for _ in range(4)),
        lambda: rng.choice(["Mr.", "Mrs", "Frau", "Sr."]) + " " + rng.choice(["Adam ", "Eva ", ""]) + rng.choice(["Smith", "Müller", "Stone"]), lambda: "Господин " + rng.choice(["Иван Петров", "Петров"]),
    ]
    pool = [rng.choice(makers)() for _ in range(60)]
    rows = [(i % 70, " ~ ".join(rng.choice(pool) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 30)))) for i in range(150)] + [(None, None), (1, ""), (2, "\n")]
    out = P.replace_entities(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, at long"), "k").collect()
    assert sorted(r.at for r in out) == list(range(len(rows)))
    mapping = {}
    for r in out:
        old = rows[r.at][1]
        found = entities(old)
        assert r.n_entities == len(found)
        pieces = regex.split(P.PATTERN, old) if old is not None else []
        if old is None:
            assert r.text is None
            continue
        rest, got = r.text, []
        m = re.fullmatch("(.+?)".join(map(re.escape, pieces)), rest, re.S)
        assert m, (old, rest)
        got = list(m.groups())
        for a, b in zip(found, got, strict=True):
            assert mapping.setdefault(a, b) == b and a != b
    assert len(set(mapping.values())) == len(mapping) > 40
    originals = {re.sub(r"[\W_]", "", e).lower() for e in mapping}
    assert not originals & {re.sub(r"[\W_]", "", v).lower() for v in mapping.values()}


def test_full_formats_get_longer_surrogates(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[i // 26]}@{letters[i % 26]}.co and {i // 1000}.{i // 100 % 10}.{i // 10 % 10}.{i % 10}") for i in range(676)]
    out = P.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    new = [r.text.split(" and ") for r in out]
    for side in (0, 1):
        olds, news = {r[1].split(" and ")[side] for r in rows}, [n[side] for n in new]
        assert len(set(news)) == len(news) == 676 and not olds & set(news)


def test_scripts_names_and_coreference(spark):
    texts = ["mail αβγ@δεζ.gr", "mail 山田@例え.jp", "Mr. Adam Smith met Mrs. Eva Smith. Mr Smith left; Mr. Smith stayed.", "Mr. Smith"]
    out = {r.doc_id: r.text for r in P.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    assert re.fullmatch(r"mail [α-ω]{3}@[α-ω]{3}\.gr", out[0]) and out[0] != texts[0]
    assert re.fullmatch(r"mail [\u4e00-\u9fff]{2}@[\u4e00-\u9fff][\u3041-\u309f]\.jp", out[1]) and out[1] != texts[1]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Mr (\w+) left; Mr\. (\w+) stayed\.", out[2])
    assert m and m[2] == m[4] == m[5] == m[6] != "Smith" and out[3] == f"Mr. {m[2]}"
    assert m[1] in P.NAMES["given_m_latin"] and m[3] in P.NAMES["given_f_latin"]


def test_long_runs_and_clashing_columns(spark):
    rows = [(1, "x" * 300_000, "f", 1), (2, "1" * 100_000, None, 2), (3, "a@b.example " * 5000, "n", None)]
    started = time.time()
    out = P.replace_entities(spark.createDataFrame(rows, "doc_id long, text string, found string, row long"), "k").collect()
    assert time.time() - started < 60
    assert {r.doc_id: r.n_entities for r in out} == {1: 0, 2: 0, 3: 5000} and {r.found for r in out} == {"f", None, "n"}
    with pytest.raises(ValueError):
        P.replace_entities(spark.createDataFrame(rows, "doc_id long, text string, found string, row long"), "")
