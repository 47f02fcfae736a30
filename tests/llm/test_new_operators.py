"""Hard negatives, the secret scan and the fill-in-the-middle cut against plain versions, on ordinary and awkward rows."""

import hashlib
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from barflow.llm import fill_in_middle as fim
from barflow.llm import hard_negatives as hn
from barflow.llm import secret_scan as ss

KEY = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


def plain_negatives(rows, is_anchor, positives=5, k=10, lower=30, upper=90):
    """Everything by whole lists and Python's whole numbers."""
    kept = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in kept:
        if a is None or not is_anchor(a):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i is None, i or 0, l) for i, l, w in kept if i != a))
        for p in [s for s in scored if s[3] == label][:positives]:
            best = -p[0]
            found = [s for s in scored if s[3] != label and lower * best <= -100 * s[0] <= upper * best][:k]
            out += [(a, None if p[1] else p[2], r, None if s[1] else s[2], best, -s[0]) for r, s in enumerate(found, 1)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").select("*", F.lit(1).alias("id"), F.lit(2).alias("r_b"), F.lit(3).alias("score"))


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_against_plain_lists(spark, monkeypatch, seed):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 70)
    monkeypatch.setattr(hn, "ANCHORS", 4)
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(3), [rnd.choice((-0.5, 0.25, 0.5, 1.0)) for _ in range(6)]) for i in range(300)]
    rows += [(None, 1, [0.5] * 6), (700, None, [0.5] * 6), (710, 1, None), (720, 1, [0.5, None]), (730, 1, [math.nan]), (740, 2, [math.inf]), (750, 2, []), (760, 1, [1.0] * 3)]
    rows += [(40, 1, [0.5] * 6), rows[7], (770, 9, [1.0] * 6)]  # an id and a row repeated, a label alone
    got = hn.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(want, key=KEY)


def test_hard_negatives_of_large_components_and_of_nothing(spark):
    rows = [(i, i % 2, [1e5 * (i + 1), -1e4, 3.0 * i]) for i in range(8)]
    got = hn.hard_negatives(vectors(spark, rows), F.col("vec_id") % 3 == 0, upper=100, lower=0)
    assert sorted(map(tuple, got.collect())) == sorted(plain_negatives(rows, lambda i: i % 3 == 0, upper=100, lower=0))
    far = [(i, i % 2, [1e30, 1.0]) for i in range(4)]
    assert {r.positive_score for r in hn.hard_negatives(vectors(spark, far), F.lit(True), upper=100).collect()} == {hn.BIG}
    empty = hn.hard_negatives(vectors(spark, rows).where("false"), F.lit(True))
    assert empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and not empty.count()


def plain_fixed(text):
    found = []
    for kind, pattern, least, group in (("assign", ss.ASSIGN, 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.A | (re.I if kind == "assign" else 0)) if len(m[group]) >= least]
    return sorted(found, key=lambda x: (x[0], ss.KINDS.index(x[1])))


def secret_rows(rnd):
    parts = ["password", "Token", "secret:token: abcdefgh", "api_key='", "apikey", "API-KEY", ":", "=", ' = "', "'", " ", "\n", "é", "ſecret=abcdefgh", "𝔘", "deadbeef" * 3, "deadbeef" * 2, "AKIA" + "Z9" * 8, "AKIAAKIA", "abc", "abcdef", "x.y/z+w=="]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))) for i in range(300)]
    return rows + [(1000, None), (1001, ""), (1001, ""), (None, "token=abcdef"), (1002, "token=" + "a1" * 1_500_000), (1003, "pass " * 5000), (1004, "token=\x00abcdef")]


def test_fixed_secret_forms_against_plain_search(spark):
    rows = secret_rows(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("piece", F.lit(2)).repartition(3)
    got = sorted(((r[0], [(x.start, x.kind, x.end) for x in r[1] if x.kind != "novel"]) for r in ss.secret_scan(docs).collect()), key=KEY)
    assert got == sorted(((i, plain_fixed(t or "")) for i, t in rows), key=KEY)
    assert not ss.secret_scan(docs.where("false")).count()


def test_novel_strings_near_sensitive_words_and_not_names(spark):
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("conf", "user", "serv", "data", "cach", "queu", "node", "page") for b in ("ig", "name", "ice", "base", "ed", "line", "list", "view")]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows, random_ones, names = [], 0, 0
    for i in range(200):
        if i % 2:
            secret = "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(rnd.randrange(20, 50)))
        else:
            secret = "_".join(rnd.choice(words).title() for _ in range(4)) + str(i % 7)
        rows.append((i, f"{prose(40)} private key {secret} {prose(30)}"))
    rows.append((900, prose(30) + " Aq3Zx9Lm2Pw7Rt5Vb8Nc " + prose(30)))  # nothing sensitive near
    out = {r.doc_id: [x for x in r.spans if x.kind == "novel"] for r in ss.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for i in range(200):
        for x in out[i]:
            assert text[i][x.start : x.end] in text[i].split() and x.novelty >= ss.NOVEL
        random_ones += i % 2 == 1 and len(out[i]) == 1
        names += i % 2 == 0 and bool(out[i])
    assert random_ones >= 90 and names <= 5 and not out[900]


def test_candidates_overlap_no_fixed_span():
    text = "secret key token=Ab3dEf6hIj9kLm2nOp and auth Zx9Lm2Pw7Rt5Vb8NcQ1"
    base = sorted((a, b) for a, _, b in plain_fixed(text))
    assert [text[a:b] for a, b in ss.candidates(text, base)] == ["Zx9Lm2Pw7Rt5Vb8NcQ1"]


def test_identifiers_are_counted_once_a_text_over_all_partitions(spark):
    texts = spark.createDataFrame([("getUserName getUserName",), ("userName",), ("User",), ("ab",)], "text string").select(F.col("text").cast("binary").alias("text")).repartition(4)
    assert ss.identifiers(texts).split() == [b"get", b"ab", b"name", b"user"] or ss.identifiers(texts).split()[-2:] == [b"name", b"user"]


def test_without_secrets(spark):
    docs = spark.createDataFrame([(1, "a token = 'abcdefgh' b deadbeefdeadbeefdeadbeef"), (2, None), (3, "clean")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = ss.without_secrets(docs)
    assert out.schema == docs.schema
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a [removed]' b [removed]", 2: None, 3: "clean"}


def plain_cut(id_, text, units):
    """By a list of all units."""
    text = text or ""
    got = units(text)
    n = len(got)
    digest = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return id_, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m = "".join(got[:a]), "".join(got[a:b])
    s = text[len(p) + len(m) :]
    if h4 % 100 < 20:
        return id_, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return id_, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,units", [("char", list), ("word", lambda t: re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)), ("line", lambda t: t.splitlines(keepends=True) if "\r" not in t else re.findall(r"[^\n]*\n|[^\n]+", t))])
def test_fill_in_middle_against_lists_of_units(spark, unit, units):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("ab é𝔘\n<P\x00ß ") for _ in range(rnd.randrange(300)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "x<S>y"), (1003, "<"), (None, "no id " * 20), (5, rows[5][1]), (1004, "é" * 1_500_000), (1005, "<M" * 70), (1006, "a" * 64), (1007, "b" * 128)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    out = fim.fill_in_middle(docs, unit=unit)
    got = sorted(map(tuple, out.collect()), key=KEY)
    assert got == sorted((plain_cut(i, t, units) for i, t in rows), key=KEY)
    back = out.select("doc_id", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, back), key=KEY) == sorted(((i, t or "") for i, t in rows), key=KEY)
    assert not fim.fill_in_middle(docs.where("false")).count()


def test_sql_of_the_quality_rules_in_all_scripts(spark):
    """The SQL of op10 keeps what the operator keeps: capitals of any script, words without spaces between them."""
    import duckdb
    import pandas as pd

    from barflow.llm.oracle import OP10
    from barflow.llm.quality_rules import quality_rules

    rnd = random.Random(12)
    alphabets = ["abcdefgh", "ABCDEFgh", "абвгдежз", "АБВГДЕЖз", "αβγδεΖΗΘ", "漢字仮名交文", "ไทยภาษาคำ", "あいうえお", "éÉèÈàÀ", "0123#$%"]
    rows = [(i, " ".join("".join(rnd.choice(rnd.choice(alphabets) if rnd.random() < 0.1 else a) for _ in range(rnd.randint(1, rnd.choice([6, 45])))) for _ in range(rnd.randint(20, 60)))) for i in range(400) for a in [rnd.choice(alphabets)]]
    rows += [(1000, None), (1001, "")]
    out = {tuple(r) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).drop("failed_rule").select("doc_id", "n_words", "word_chars", "kept").collect()}
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = {(r[0], r[1], r[2], r[3]) for r in duckdb.sql(f"SELECT doc_id, n_words, word_chars, kept FROM ({OP10})").fetchall()}
    assert out == want and 50 < sum(k for *_, k in out) < 390
