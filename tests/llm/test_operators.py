"""Every operator against a plain version, on ordinary rows and on awkward ones."""

import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.llm.decontamination import decontamination, keep_clean
from barflow.llm.license_scan import license_scan
from barflow.llm.lm_scoring import lm_scoring
from barflow.llm.ngram_join import ngram_join, one_of_each
from barflow.llm.packing import packing, patterns, placements, sequences
from barflow.llm.queries import TOKENIZER
from barflow.llm.quality_classifier import quality_classifier
from barflow.llm.quality_rules import RULES, cascade, Doc, estimate, keep_good, quality_rules
from barflow.llm.suffix_dedup import suffix_dedup, without_repeats
from barflow.llm.token_counts import token_counts

PROSE = " ".join(f"word{i % 97}x{i * 7 % 31} and" for i in range(120))
OTHER = " ".join(f"tale{i}" for i in range(60))
ROWS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, PROSE + " tail"), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one two"), (9, OTHER + "\n" + OTHER),
    (10, "All rights reserved. Licensed under CC BY-NC 4.0. the GNU General Public License, version 3."), (11, "é" * 300 + " naïve " + "ß" * 50), (12, "a" * 5000),
    (13, " ".join(f"w{i}" for i in range(9000))), (14, "x\x00y \x85 z　q <|endoftext|> don't STOP!! 123"), (15, "mentpa " * 300), (16, OTHER), (17, OTHER + " end"), (None, "no id here at all"),
]
ITEMS = [(None, "tale20 tale21"), (1, "tale5 tale6 tale7 tale8 tale9 tale10 tale11 tale12 tale13 tale14 tale15"), (2, "One"), (10, None), (11, ""), (12, "word1 nowhere")]


@pytest.fixture(scope="module")
def docs(spark):
    """The columns of documents, and others whose names the operators use inside."""
    cols = [F.lit(k).alias(c) for c, k in (("lang", "en"), ("source", "s"), ("n", 1), ("block", 2), ("node", "x"), ("length", 3), ("rank", 4), ("row", 5))]
    return spark.createDataFrame(ROWS, "doc_id long, text string").select("*", F.length("text").cast("long").alias("n_chars"), *cols).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def got(df, *names):
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)


def same(df, want, *names):
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    assert got(df, *names) == sorted(want, key=key)


def test_quality_rules(docs, none):
    out = quality_rules(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same(out, [(i, *brute.quality(t)) for i, t in ROWS], *names)
    keep = {(i, t) for i, t in ROWS if cascade(RULES, Doc((t or "").encode())) is None}
    same(keep_good(docs), [r for r in ROWS if r in keep], "doc_id", "text")
    assert keep_good(docs).columns == docs.columns
    assert quality_rules(none).count() == 0 and keep_good(none).count() == 0


def test_cascade_order_is_by_worth_and_stops_early(docs):
    order = estimate(docs)
    assert [e.worth for e in order] == sorted((e.worth for e in order), reverse=True)
    assert {e.seen for e in order} == {len(ROWS)}
    from barflow.llm.quality_rules import Rule

    hits = []
    rules = (Rule("first", lambda d: True), Rule("second", lambda d: hits.append(1)))
    assert cascade(rules, Doc(b"x")) == "first" and not hits


def test_cascade_order_counts_what_earlier_rules_left(spark):
    import time

    from barflow.llm.quality_rules import Rule

    rows = spark.createDataFrame([(i, f"{'a' if i < 10 else 'b' if i < 15 else 'c'} text") for i in range(30)], "doc_id long, text string")
    one = Rule("one", lambda d: d.text.startswith(b"a"))
    same = Rule("same", lambda d: time.sleep(1e-4) or d.text.startswith(b"a"))
    other = Rule("other", lambda d: time.sleep(1e-3) or d.text.startswith(b"b"))
    order = estimate(rows, (other, same, one))
    assert [(e.rule, e.rejected) for e in order] == [("one", 10), ("other", 5), ("same", 0)]
    assert estimate(rows.where("false"), (one, same))[0].seen == 0


def test_license_scan(docs, none):
    out = license_scan(docs)
    same(out, [(i, *brute.licences(t)) for i, t in ROWS], "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    row = out.where("doc_id = 10").first()
    assert row["labels"] == "cc-by,cc-by-nc-4.0,gpl,gpl-3.0,reserved" and 0 < row["score"] <= 1
    assert license_scan(none).count() == 0


def test_license_labels_and_scores_against_plain_search(spark):
    """Notices whole, cut, with words put in, left out and changed, among prose that holds their words."""
    from barflow.llm import license_scan as ls

    rng = random.Random(4)
    prose = sorted({w for t in ls.TEMPLATES for w in brute.ALNUM.findall(brute.low(t.text))}) + [f"p{i}" for i in range(40)]

    def spoiled(words):
        out = []
        for w in words:
            x = rng.random()
            out += [] if x < 0.04 else [w, rng.choice(prose)] if x < 0.08 else [rng.choice(prose)] if x < 0.11 else [w]
            if x > 0.97 and len(out) > 1:
                out[-2:] = out[:-3:-1]
        return out

    texts = []
    for k in range(240):
        t = rng.choice(ls.TEMPLATES).text.split()
        t = rng.choice([t, spoiled(t), t[: len(t) // 2], t[len(t) // 3 :], spoiled(t) + t])
        texts.append(" ".join([*rng.choices(prose, k=rng.randint(0, 40)), *t, *rng.choices(prose, k=rng.randint(0, 40))]))
    texts += [
        "Licensed under the Apache Software License, Version 2.0", "Permission is hereby granted, free of any charge, to any person obtaining a copy", None, "",
        "Redistribution and use in source and binary forms", "the mit license",
        ls.TEMPLATES[6].text.replace("is hereby granted", "is hereby freely granted"), ls.TEMPLATES[6].text.replace("obtaining a copy", "obtaining a verbatim copy"),
        ls.TEMPLATES[6].text.replace("hereby", "", 1).replace("person obtaining", "obtaining person"), "// SPDX-License-Identifier: Apache-2.0", "MIT License Copyright (c) 2020 N N", "used under the Apache-2.0 license",
    ]
    out = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    found = Counter()
    for i, (labels, score) in enumerate(brute.licence_labels(texts, ls.TEMPLATES, ls.STRETCH, ls.TOP, ls.VOTES, ls.BAND, ls.EDIT, ls.SHARE)):
        assert (out[i]["labels"], round(out[i]["score"], 9)) == (labels, round(score, 9)), texts[i]
        found.update(labels.split(","))
    assert len(found) > 15 and out[240]["labels"] == "apache-2.0" and out[241]["labels"] == "mit" and out[244]["labels"] == ""
    assert [out[k]["labels"] for k in range(246, 252)] == ["mit", "mit", "mit", "apache-2.0", "mit", "apache-2.0"]


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    # an item without id marks words, but is not named
    named = brute.decontaminate([t for _, t in ROWS], [x for x in ITEMS if x[0] is not None])
    marked = brute.decontaminate([t for _, t in ROWS], ITEMS)
    want = [(i, m[0], m[1], *r[2:4], m[4]) for (i, _), r, m in zip(ROWS, named, marked, strict=True)]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same(decontamination(docs, bench), want, *names)
    same(decontamination(docs, bench, chunk_bytes=40), want, *names)  # several passes over a benchmark beyond the bound
    same(keep_clean(docs, bench), [(i,) for i, *_, bad in want if not bad], "doc_id")
    same(keep_clean(docs, bench, chunk_bytes=40), [(i,) for i, *_, bad in want if not bad], "doc_id")
    assert not decontamination(docs, bench.where("false")).where("contaminated").count()
    assert decontamination(none, bench).count() == 0


def test_longest_matches(spark, docs):
    found = decontamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).where("doc_id = 16").first()["found"]
    assert [(f["item"], f["doc_word"], f["item_word"], f["words"]) for f in found] == [("1", 5, 0, 11), (None, 20, 0, 2)]


def test_chunks_come_one_at_a_time(spark, monkeypatch):
    """A chunk's suffixes are built only after the one before has been searched and written."""
    from barflow.llm import decontamination as de

    alive, most = [], []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, x: (alive.append(x), most.append(len(alive)), broadcast(sc, x))[2])
    monkeypatch.setattr(de.Broadcast, "destroy", lambda self, blocking=False: alive.pop())
    docs = spark.createDataFrame([(1, "tale5 tale6"), (2, "word")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"tale{k} tale{k + 1}") for k in range(12)], "item_id long, text string")
    same(decontamination(docs, bench, chunk_bytes=30), [(1, 1), (2, 0)], "doc_id", "n_items")
    same(keep_clean(docs, bench, chunk_bytes=30), [(2,)], "doc_id")
    assert max(most) <= 2 and len(most) > 8  # the last one of keep_clean stays for its reader


def test_equal_short_items_are_searched_once():
    from barflow.llm.decontamination import Shard, TestSuffixes

    shard = Shard([[b"yes"] * 20000], TestSuffixes([(i, b"Yes") for i in range(2000)] + [(5000, b"yes yes")], 10))
    assert len(shard.search()[0]) == 20000 + 19999
    names, found = shard.documents()[0]
    assert len(names) == 2001 and sum(f["words"] for f in found) >= 20000


@pytest.mark.parametrize("seed", range(30))
def test_matches_of_a_shard_against_plain_search(seed):
    """Words hit, items, and each place's longest match, on small alphabets with long repeats, short items, ties and nulls."""
    from barflow.llm.decontamination import Shard, TestSuffixes

    rng = random.Random(seed)
    window, letters = rng.choice([3, 4, 10]), rng.choice(["ab", "abcd", "abcdefghij"])
    text = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    shared = text(25)
    items = [(rng.choice([i, i, 1, None]), rng.choice([text(rng.randint(0, 30)), shared, text(3) + " " + shared + " x", None])) for i in range(8)]
    docs = [rng.choice([text(rng.randint(0, 60)), shared + " " + text(9), "a " * 150, f"zz {text(8)} zz {shared[:30]}", None]) for _ in range(10)]
    shard = Shard([brute.ALNUM.findall(t or "") and [w.encode() for w in brute.ALNUM.findall(t)] for t in docs], TestSuffixes([(i, (t or "").encode()) for i, t in items], window))
    own = shard.documents()
    want = brute.decontaminate(docs, [(i, t) for i, t in items if i is not None], window)
    marked = brute.decontaminate(docs, [(k, t) for k, (_, t) in enumerate(items)], window)
    words = [brute.ALNUM.findall(t or "") for _, t in items]
    for d, t in enumerate(docs):
        names, found = own.get(d, ([], []))
        w = brute.ALNUM.findall(t or "")
        hit = {p for f in found for p in range(f["doc_word"], f["doc_word"] + f["words"])}
        assert (len(hit), bool(hit)) == (marked[d][1], marked[d][4]) and len(names) == want[d][2]
        for f in found:
            p, n = f["doc_word"], f["words"]
            best = max((k for x in words for q in range(len(x)) for k in range(min(window, len(x)), len(x) - q + 1) if w[p : p + k] == x[q : q + k]), default=0)
            assert n == best
            assert any((None if i is None else str(i)) == f["item"] and x[f["item_word"] : f["item_word"] + n] == w[p : p + n] for (i, _), x in zip(items, words, strict=True))
        assert [f["doc_word"] for f in found] == sorted(f["doc_word"] for f in found)


def test_suffix_dedup(docs, none):
    want = [(i, *r) for (i, _), r in zip(ROWS, brute.repeats([t for _, t in ROWS]), strict=True)]
    same(suffix_dedup(docs), want, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert suffix_dedup(none).count() == 0


def test_without_repeats_keeps_rows_and_characters(docs, none):
    out = without_repeats(docs, chars_col="n_chars")
    assert out.columns == docs.columns and out.count() == len(ROWS)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[4]["text"] is None and rows[1]["text"] == "" and rows[16]["n_chars"] == len(rows[16]["text"]) and rows[3]["text"] == " tail"
    assert set(rows[11]["text"]) <= set("éß naïve")
    assert without_repeats(none).count() == 0


def test_ngram_join(docs, none):
    ids = [i if i is not None else 10**9 for i, _ in ROWS]
    want = brute.components(ids, [t for _, t in ROWS])
    want = [(i, n, None if i is None else c) for (i, _), (n, c) in zip(ROWS, want, strict=True)]
    same(ngram_join(docs), want, "doc_id", "n_shingles", "component_id")
    assert ngram_join(none).count() == 0


def test_ngram_join_on_crowds_of_near_copies(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for k in range(90):
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w) if k % 9 else " ".join(f"u{rng.randrange(10**6)}" for _ in range(50)))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = [(i, *c) for (i, _), c in zip(rows, brute.components(list(range(90)), texts), strict=True)]
    import barflow.llm.ngram_join as nj

    for pivots, per_salt in ((1, 128), (2, 5)):  # also with shingles over many salts
        monkeypatch.setattr(nj, "PER_SALT", per_salt)
        same(ngram_join(df, pivots=pivots), want, "doc_id", "n_shingles", "component_id")
    loose = brute.components(list(range(90)), texts, 5, 80, 100)
    kept = one_of_each(df, words=5, num=80, den=100)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in loose})


def test_one_of_each_keeps_texts_without_words(docs):
    kept = [r["doc_id"] for r in one_of_each(docs).collect()]
    assert {4, 5, 6} <= set(kept) and 2 not in kept and kept.count(1) == 1


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, t in ROWS:
        n = len(tok.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 2048))
    same(token_counts(docs, TOKENIZER), want, "doc_id", "n_bytes", "n_tokens", "over_limit")
    same(token_counts(docs, TOKENIZER, chunk=700, overlap=64), want, "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert token_counts(none, TOKENIZER).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_spliced_chunks_equal_the_library(name):
    import public_tokenizers as P

    from barflow.llm.token_counts import library, spliced

    lib, rng = library(P.path(name)), random.Random(11)
    words = ["the", "naïve", "don't", "!!", "12,5", "Straße", "中文", "a" * 40, "x́y", "J\u030c", "<|endoftext|>", "...", "\n\n", "\t"]
    for trial in range(12):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", ""]) for _ in range(600))
        assert spliced(lib, text.encode(), 256, 40 + trial).tolist() == lib.ids(text)
    for text in ("q" * 1000, "é" * 1000):  # no white space at all: the overlap reaches the whole text
        assert spliced(lib, text.encode(), 128, 16).tolist() == lib.ids(text)


def test_long_texts_are_spliced(small):
    """The tables reach the chunk: texts of sf0.01 go through splices and equal the library."""
    import pyarrow.parquet as pq

    from barflow.llm import token_counts as tc

    lib = tc.library(TOKENIZER)
    texts = [t for t in pq.read_table(f"{small}/../sf0.01/documents.parquet")["text"].to_pylist() if t and len(t) > tc.CHUNK]
    tc.splices = 0
    for t in texts:
        assert np.frombuffer(lib.packed(t.encode()), "<u4").tolist() == lib.ids(t)
    assert tc.splices >= len(texts) > 20


def test_words_one_by_one_equal_the_library():
    from barflow.llm.token_counts import library

    lib, rng = library(TOKENIZER), random.Random(5)
    assert lib.by_word
    chars = "abcXYZJWHTİıſK ÀéßøÿµªºĲσΣς.,!?'-_|<>()[]{}#*%&0123456789  \x1cć中\n\t\x85\u3000"
    marks = [chr(c) for c in range(0x300, 0x370)]
    for _ in range(20_000):
        t = "".join(rng.choice(marks) if rng.random() < 0.2 else rng.choice(chars) for _ in range(rng.randint(0, 24)))
        assert np.frombuffer(lib.packed(t.encode()), "<u4").tolist() == lib.ids(t), repr(t)


def test_short_way_of_letters_and_signs_for_every_character_of_its_classes():
    """Every letter and sign that the short way admits, alone, beside each other, and at both sides of a cut."""
    from barflow.llm.token_counts import _ENDED, _LETTERS, library

    lib = library(TOKENIZER)
    letters = [chr(c) for c in range(0x180) if _LETTERS.fullmatch(chr(c))]
    signs = [chr(c) for c in range(0x80) if _ENDED.fullmatch("a" + chr(c))]
    assert len(letters) == 26 + 32 and "'" not in signs and "<" not in signs
    words = [a + b + c for a in letters for b in ("", *letters) for c in ("", "e")] + [a + x + y for a in letters for x in signs for y in ("", *signs)]
    for word, ids in zip(words, lib._ids(words), strict=True):
        assert lib.word_ids(word.encode()) == ids, word


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    out = packing(docs, TOKENIZER, size=256, with_ids=True)
    rows = out.collect()
    ids = {}
    for i, t in ROWS:
        ids.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert any(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes() == bytes(r["ids"]) for x in ids[r["doc_id"]])
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]][0])
    for i, x in ids.items():
        assert sum(r["length"] for r in by_doc[i]) == sum(map(len, x))
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in at.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n
        assert end <= 256
    assert sorted(at) == list(range(len(at)))
    whole = {r["sequence_id"]: r["ids"] for r in sequences(out, 256).collect()}
    assert all(len(x) == 256 or len(x) & (len(x) - 1) == 0 for x in whole.values()) and len(whole) == len(at)
    assert packing(none, TOKENIZER).count() == 0


def test_patterns_place_every_piece_and_waste_little():
    rng = random.Random(2)
    hist = dict(Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000)))
    found = patterns(hist)
    placed = Counter()
    for packs, runs in found:
        assert sum(n * c for n, c in runs) <= 4096
        for n, c in runs:
            placed[n] += packs * c
    assert placed == Counter(hist) and len(found) <= 4096
    need = sum(n * c for n, c in hist.items()) / 4096
    assert sum(p for p, _ in found) <= need * 1.02 + 1
    table = placements(found)
    assert (np.diff((table["length"] << 44) | table["first"]) > 0).all()


def lm_rows(docs):
    """Tokens and fold of each document, as plain lists."""
    return [(brute.SPACE.findall(brute.low(t)) + ["</s>"], zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0) for i, t in docs]


def test_lm_scoring(docs, none):
    model = brute.Trigrams([w for w, held in lm_rows(ROWS) if not held])
    want = [
        (i, h, len(w), sum(model.c[x] > 0 for x in w), model.n, round(sum(math.log10(model.p1(x)) for x in w), 6), round(model.score(w), 6))
        for (i, _), (w, h) in zip(ROWS, lm_rows(ROWS), strict=True)
    ]
    out = lm_scoring(docs).withColumns({k: F.round(k, 6) for k in ("base_score", "score")})
    same(out, want, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert lm_scoring(none).count() == 0


def test_lm_scoring_over_blocks_and_shards(spark, monkeypatch):
    """Many blocks and shards, repeated documents and held-out text of unseen words, against the plain trigram model."""
    from barflow.llm import blocks, lm_scoring as lm

    rng = random.Random(9)
    phrases = [" ".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(9)]
    rows = [(i, " ".join(rng.choice(phrases) if rng.random() < 0.8 else f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 120)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:9]]
    monkeypatch.setattr(blocks.blocked, "__defaults__", ("text", 4000))
    monkeypatch.setattr(lm, "PER_SHARD", 9000)
    model = brute.Trigrams([w for w, held in lm_rows(rows) if not held])
    out = {r["doc_id"]: r for r in lm.lm_scoring(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for (i, _), (w, h) in zip(rows, lm_rows(rows), strict=True):
        assert out[i]["held_out"] == h and out[i]["train_tokens"] == model.n
        assert math.isclose(out[i]["score"], model.score(w), abs_tol=1e-6)
    held = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the histories help on unseen text


def test_automaton_probabilities_sum_to_one():
    """After several histories, kept and not, the probabilities of all words, the end and the unknown word sum to one."""
    from barflow.llm.common import crc_mod

    vocab = ["a", "b", "c", "d"]
    train = ["a b c", "a b d", "b c a b c", "d", "", "c c c a", "a b c d a b"]
    # every history and word of the test stands in the block, in texts that are held out
    probes = [f"{u} {v} {w}" for u in vocab for v in vocab for w in (*vocab, "zz")] + [f"{u} {v}" for u in vocab for v in vocab]
    folds = iter(i for i in range(10**6) if crc_mod(i, 10) != 0)
    held = iter(i for i in range(10**6) if crc_mod(i, 10) == 0)
    import pyarrow as pa

    from barflow.llm import lm_scoring as lm

    docs = pa.table({"doc_id": pa.array([*(next(folds) for _ in train), *(next(held) for _ in probes)]), "text": train + probes})
    t = lm.Tokens(docs, 10, 3)
    sums = sum(lm.unpack(a, "<i8")[0] for _, p in lm._ask(10, 3)(docs) for b, a in lm._answer([(7, p)]) if b == -1).tolist()
    a = lm.Automaton(t, (*t.two.sums(), t.two.count, *t.three.sums(), t.three.count), sums[0], sums[1], (lm.discount(*sums[2:4]), lm.discount(*sums[4:])))
    weight = a.walk()
    model = brute.Trigrams([lm_rows([(0, x)])[0][0] for x in train])
    for k, text in enumerate(train + probes):
        w = lm_rows([(0, text)])[0][0]
        assert math.isclose(weight[t.starts[k] : t.ends[k]].sum(), model.score(w), abs_tol=1e-9)
    at = {text: int(t.starts[len(train) + k]) for k, text in enumerate(probes)}
    for u in vocab:
        for v in vocab:
            total = sum(10 ** weight[at[f"{u} {v} {w}"] + 2] for w in (*vocab, "zz")) + 10 ** weight[at[f"{u} {v}"] + 2]
            assert math.isclose(total, 1.0, rel_tol=1e-9), (u, v)
    # the length of the stretches changes nothing
    for stretch in (2, 3, 5):
        assert np.allclose(a.walk(stretch), weight)


def test_quality_classifier_on_held_out_labels(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier(docs, labels)
    assert out.count() == docs.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    m = out.where("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert sum(r[0] == r[1] for r in m) / len(m) > 0.97
    again = quality_classifier(docs, labels.unionByName(labels).withColumn("toxic", F.lit(None)))
    assert got(out, "doc_id", "score") == got(again, "doc_id", "score")


def test_quality_classifier_without_usable_labels(spark, docs, none):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {round(r["score"], 6) for r in quality_classifier(docs, labels).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert quality_classifier(docs, one).where("predicted = 1").count() == len(ROWS)
    assert quality_classifier(none, one).count() == 0


def shape(word):
    kind = lambda ch: "A" if "A" <= ch <= "Z" or "À" <= ch <= "Þ" and ch != "×" else "a" if "a" <= ch <= "z" or "ß" <= ch <= "ÿ" and ch != "÷" else "0" if "0" <= ch <= "9" else ch
    out = ""
    for ch in map(kind, word):
        if not (out and ch == out[-1] and ch in "Aa0"):
            out += ch
    return out


def test_indicators_against_a_loop():
    """Two words share an indicator exactly where they agree on a word, a pair of words, or up to three shapes and repeats."""
    from barflow.llm.quality_classifier import indicators

    texts = ["The cat sat on the mat", "the the Cat", "", "12 dogs 345 Dogs!", "ÀÉ été x×y", "a", "The cat"]
    doc, x = indicators([t.encode() for t in texts])
    want = []
    for t in texts:
        w = t.split()
        s = [(shape(a), k > 0 and w[k - 1] == a) for k, a in enumerate(w)]
        want.append({("w", a) for a in w} | {("ww", *p) for p in zip(w, w[1:], strict=False)} | {("s", *s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)})
    own = [set(x[doc == k].tolist()) for k in range(len(texts))]
    assert [len(o) for o in own] == [len(g) for g in want]  # no two of these few share one of 2 ** 18 places
    for i in range(len(texts)):
        for j in range(i):
            assert len(own[i] & own[j]) == len(want[i] & want[j])


def test_log_count_ratios_against_counting():
    from barflow.llm.quality_classifier import ALPHA, BITS, _ratio

    rows, y = [np.array([1, 5, 9]), np.array([5, 7]), np.array([1, 9]), np.array([], np.int64)], np.array([1, -1, 1, -1])
    counts = {c: Counter(int(v) for r, s in zip(rows, y, strict=True) if s == c for v in r) for c in (1, -1)}
    total = {c: sum(counts[c].values()) + ALPHA * 2**BITS for c in (1, -1)}
    ratio = _ratio(rows, y)
    for v in (0, 1, 5, 7, 9):
        assert math.isclose(ratio[v], math.log(((counts[1][v] + ALPHA) / total[1]) / ((counts[-1][v] + ALPHA) / total[-1])))


def test_descent_reaches_the_minimum_of_the_hinge_loss():
    """Against slow projected gradient steps on the same dual."""
    from barflow.llm.quality_classifier import descend

    rng = np.random.default_rng(1)
    ratio = rng.normal(size=12)
    rows = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(25)]
    y = np.where(rng.random(25) < 0.5, 1, -1)
    w, bias = descend(rows, y, ratio, cost=1.0, passes=400)
    x = np.zeros((25, 13))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-12)
    x[:, 12] = 1
    q = (x * y[:, None]) @ (x * y[:, None]).T
    dual = np.zeros(25)
    for _ in range(200_000):
        dual = np.clip(dual - 0.02 * (q @ dual - 1), 0, 1)
    plain = (dual * y) @ x
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    assert math.isclose(loss(np.append(w, bias)), loss(plain), rel_tol=1e-5)
    assert np.allclose(np.append(w, bias), plain, atol=1e-2)


def test_training_rows_are_bounded_and_defined(spark):
    """Conflicting labels count as 0, an id with several texts is one row, and bytes are bounded in the order of the id's hash."""
    from barflow.llm.quality_classifier import _rank, indicators, training_rows

    docs = spark.createDataFrame([(i, f"some text {i} of words") for i in range(40)] + [(3, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (4, 1), (5, 7), (None, 1)], "doc_id long, quality int")
    args = (docs, labels, "doc_id", "text", "quality", 5)
    used = sorted((i for i in range(40) if zlib.crc32(str(i).encode()) % 5), key=lambda i: _rank({"doc_id": i}))
    rows, y = training_rows(*args, 100)
    assert y.tolist() == [0 if i == 3 else i % 2 for i in used]
    sizes = [len(r) * 4 for r in rows]
    some, _ = training_rows(*args, 100, sum(sizes[:7]))
    assert [r.tolist() for r in some] == [r.tolist() for r in rows[:7]]
    assert len(training_rows(*args, 100, 1)[0]) == 1
    k = next(i for i in used if i != 3)
    assert rows[used.index(k)].tolist() == indicators([f"some text {k} of words".encode()])[1].tolist()
