"""The pipeline as a whole, against a chain of plain versions, on ordinary and awkward rows."""

import brute
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_operators import ROWS

import corpus_pipeline
from barflow.llm.queries import TOKENIZER
from barflow.llm.quality_rules import RULES, Doc, cascade


def without_repeats(texts, least=200):
    """Characters of which no byte is under a string of `least` bytes that stands at two places."""
    raw = [t.encode() for t in texts]
    seen, twice = {}, set()
    for b in raw:
        for i in range(len(b) - least + 1):
            s = b[i : i + least]
            if s in seen:
                twice.add(s)
            seen[s] = 1
    out = []
    for t, b in zip(texts, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if b[i : i + least] in twice:
                gone[i : i + least] = b"\1" * least
        at, kept = 0, ""
        for ch in t:
            n = len(ch.encode())
            kept += "" if any(gone[at : at + n]) else ch
            at += n
        out.append(kept)
    return out


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """Tables of sf0.001 with awkward rows, and columns whose names the operators use inside."""
    path = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    more = spark.createDataFrame([(None if i is None else i + 10**6, t) for i, t in ROWS], "doc_id long, text string")
    more = more.select("doc_id", "text", *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c not in ("doc_id", "text")))
    extra = [F.lit(k).alias(c) for c, k in (("n", 1), ("block", 2), ("node", "x"), ("length", 3), ("row", 5))]
    docs.unionByName(more).select("*", *extra).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_against_plain_versions(spark, folder, monkeypatch):
    stages = []

    def kept(df, label, own=corpus_pipeline.written):
        stages.append(own(df, label))
        return stages[-1]

    monkeypatch.setattr(corpus_pipeline, "written", kept)
    last = corpus_pipeline.run(spark, folder)
    docs = pq.read_table(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "suffix_dedup", "decontamination", "packing"]
    rows = list(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True))
    got = [[(r["doc_id"], r["text"]) for r in s.collect()] for s in stages]
    for s in stages:
        assert set(s.columns) == set(docs.column_names)
    order = lambda some: sorted(some, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))

    want = [r for r in rows if cascade(RULES, Doc((r[1] or "").encode())) is None]
    assert all(not brute.quality(t)[-1] for _, t in want)
    assert order(got[0]) == order(want)

    ids = [i if i is not None else 10**9 for i, _ in want]
    groups = brute.components(ids, [t for _, t in want], 5, 80, 100)
    first = {}
    for (i, t), d, (_, c) in zip(want, ids, groups, strict=True):
        if d == c:
            first.setdefault(c, (i, t))
    assert len(first) < len(want)
    assert order(got[1]) == order(first.values())

    want = list(zip((i for i, _ in got[1]), without_repeats([t for _, t in got[1]]), strict=True))
    assert order(got[2]) == order(want) and sum(len(t) for _, t in want) < sum(len(t) for _, t in got[1])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].select("n_chars", "text").collect())

    bench = pq.read_table(f"{folder}/benchmark.parquet")
    bad = brute.decontaminate([t for _, t in got[2]], list(zip(bench["item_id"].to_pylist(), bench["text"].to_pylist(), strict=True)))
    want = [r for r, b in zip(got[2], bad, strict=True) if not b[-1]]
    assert order(got[3]) == order(want) and len(want) < len(got[2])

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    pieces, sequences = {}, {}
    for r in last.collect():
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces == {i: len(tok.encode(t, add_special_tokens=False)) + 1 for i, t in got[3]}
    for spans in sequences.values():
        assert [a for a, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
