"""N-gram Jaccard self-join: rare-first prefixes with length, positional and suffix filters, verified once per pair.

1. Documents with one set of shingles are one node (the set's 128-bit hash). Blocks ask for the document frequency of each
   distinct shingle; shards count over all documents and answer.
2. A node's shingles are ordered rarest first (frequency, then hash: the same order everywhere). Two sets that reach the
   threshold share a shingle within the first n - ceil(t n) + 1 of either, the prefix. Shingles that stand in one document only
   have no partner and are not sent at all, so unlike documents send nothing.
3. Nodes meet by prefix shingle. A pair is a candidate if the lengths allow the threshold, if enough shingles can still follow
   at these positions, and if the sets agree enough by ranges of the hash order (suffix filter). Candidates are made distinct and
   verified once, on the whole sets.
4. So that a crowd of near copies does not give all its pairs, each prefix shingle's nodes are first compared with its most
   central node alone (PIVOTS rounds; the node whose shingles are shared most). Links found give components; then only pairs
   from different components, not compared before, are compared. No link between different components can be lost, and within
   a component no further link is needed. Every pair is compared at most once.
5. A shingle's entries are dealt to salts by the node, as many as the shingle's frequency asks for; the comparison with a central
   node meets them salt by salt, that of pairs in squares of two salts, so a shingle of a third of all documents spreads.

Words: A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`. A document with fewer words than a shingle is one shingle; NULL, empty and blank
texts have none and are linked with nothing. Ids are whole numbers; a row without id takes part, and gives its component no name.
Repeated rows and equal texts are one node. Long texts are compared whole. Ties in frequency are broken by hash, ties between
central nodes by node; neither changes a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.blocks import answered, asked, blocked, chosen, deflated, inflated, pack, pack_keys, shard_slices, shards, texts, told, unpack, unpack_keys, volume
from barflow.llm.common import space_words, word_hashes, written
from barflow.llm.components import components

#: Words of a shingle; similarity as a fraction.
WORDS, NUM, DEN = 3, 90, 100
#: Rounds of comparison with one central node for each shingle.
PIVOTS = 2
#: Text bytes that one shard of the frequency count stands for.
PER_SHARD = 16 << 20
#: Sets with one shingle that meet in one task, about: a shingle of more is dealt over as many salts as its frequency asks for.
PER_SALT = 128
#: Ranges of the hash order in the suffix filter.
RANGES = 8
#: Bits of a shingle's hash that the frequency count uses; a clash can only make a shingle look more frequent.
_COUNT_BITS = 48
_MUL = np.array([pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) for j in range(64)], dtype=np.uint64)


def shingle_sets(docs: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out = []
    for text in docs:
        w = space_words(text.lower())
        ids = np.fromiter(map(word_hashes.__getitem__, w), np.uint64, len(w))
        k = min(words, len(w))
        if not k:
            out.append(ids)
            continue
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h += ids[j : len(w) - k + 1 + j] * _MUL[j]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        h.sort()
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
    return out


def _node(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes())


def _distinct(docs: pa.Table, words: int) -> tuple[list[np.ndarray], list[bytes | None], dict[bytes, int]]:
    """Sets, nodes, and the first row of each node in this block."""
    sets = shingle_sets(texts(docs), words)
    nodes = [_node(s) if len(s) else None for s in sets]
    first: dict[bytes, int] = {}
    for i, n in enumerate(nodes):
        if n is not None:
            first.setdefault(n, i)
    return sets, nodes, first


def _keys(sets: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - _COUNT_BITS)
    allk = np.concatenate([sets[i] for i in rows] or [np.zeros(0, np.uint64)])
    allk = (allk >> shift) << shift
    allk.sort()
    start = np.flatnonzero(np.concatenate(([True], allk[1:] != allk[:-1]))) if len(allk) else np.zeros(0, np.int64)
    return allk[start], np.diff(np.concatenate((start, [len(allk)])))


def _ask(words: int, n: int):
    def ask(docs: pa.Table) -> Iterator[tuple[int, bytes]]:
        sets, _, first = _distinct(docs, words)
        keys, counts = _keys(sets, list(first.values()))
        shift = np.uint64(64 - _COUNT_BITS)
        for shard, at in shard_slices(keys, n):
            c = counts[at]
            more = np.flatnonzero(c > 1)
            yield shard, pack(np.frombuffer(pack_keys(keys[at] >> shift), np.uint8), more.astype("<u4"), c[more].astype("<u4"))

    return ask


def _count(got: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    keys, counts = [], []
    for _, p in got:
        k, more, c = unpack(p, "<u1", "<u4", "<u4")
        k = unpack_keys(k)
        n = np.ones(len(k), np.int64)
        n[more] = c
        keys.append(k)
        counts.append(n)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    cluster = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1]))) - 1
    total = np.empty(len(every), np.int64)
    total[order] = np.bincount(cluster, weights=np.concatenate(counts)[order]).astype(np.int64)[cluster]
    total = np.minimum(total, 65535).astype("<u2")
    at = 0
    for (block, _), k in zip(got, keys, strict=True):
        yield block, deflated(total[at : at + len(k)].tobytes())
        at += len(k)


_NODES = "kind string, doc_id long, block long, at long, node binary, n long, shingle long, pos int, salts int, central int, ranges array<int>, shingles array<long>"


_ROW = pa.schema([
    ("kind", pa.string()), ("doc_id", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("shingle", pa.int64()), ("pos", pa.int32()), ("salts", pa.int32()),
    ("central", pa.int32()), ("ranges", pa.list_(pa.int32())), ("shingles", pa.list_(pa.int64())),
])


def _tell(words: int, num: int, den: int):
    def use(block: int, docs: pa.Table, got: list[tuple[int, bytes]]) -> pa.Table:
        sets, nodes, first = _distinct(docs, words)
        rows = list(first.values())
        keys, _ = _keys(sets, rows)
        df = np.frombuffer(b"".join(inflated(p) for _, p in got), "<u2").astype(np.int64)
        shift = np.uint64(64 - _COUNT_BITS)
        m = docs.num_rows
        members = pa.table({
            "kind": pa.array(["member"] * m), "doc_id": docs.column("doc_id").cast(pa.int64()), "block": pa.array(np.full(m, block, np.int64)), "at": pa.array(np.arange(m)),
            "node": pa.array(nodes, pa.binary()), "n": pa.array(np.array([len(s) for s in sets], np.int64)),
        })
        held, pos, central, salts = [], [], [], []
        for i in rows:
            s = sets[i]
            own = df[np.searchsorted(keys, (s >> shift) << shift)]
            reach = len(s) - (num * len(s) + den - 1) // den + 1
            order = np.lexsort((s, own))[:reach]
            p = np.flatnonzero(own[order] > 1)
            if len(p):
                held.append((i, s[order[p]]))
                pos.append(p.astype(np.int32))
                salts.append((-(-own[order[p]] // PER_SALT)).astype(np.int32))
                central.append(int(1000 * np.log2(own).mean()))
        if not held:
            return pa.concat_tables([members, _ROW.empty_table()], promote_options="default").select(_ROW.names)
        counts = np.array([len(p) for p in pos])
        of = pa.array(np.repeat(np.arange(len(held)), counts))
        node = pa.array([nodes[i] for i, _ in held], pa.binary())
        size = pa.array(np.array([len(sets[i]) for i, _ in held], np.int64))
        spread = np.stack([np.bincount((sets[i] >> np.uint64(61)).astype(np.int64), minlength=RANGES) for i, _ in held]).astype(np.int32)
        total = int(counts.sum())
        entries = pa.table({
            "kind": pa.array(["entry"]).take(pa.array(np.zeros(total, np.int64))), "node": node.take(of), "n": size.take(of), "shingle": pa.array(np.concatenate([x for _, x in held]).view(np.int64)),
            "pos": pa.array(np.concatenate(pos)), "salts": pa.array(np.concatenate(salts)), "central": pa.array(np.repeat(np.array(central, np.int32), counts)),
            "ranges": pa.ListArray.from_arrays(pa.array(np.arange(total + 1, dtype=np.int32) * RANGES), pa.array(np.repeat(spread, counts, axis=0).ravel())),
        })
        ends = np.concatenate(([0], np.cumsum([len(sets[i]) for i, _ in held]))).astype(np.int32)
        whole = pa.table({
            "kind": pa.array(["set"] * len(held)), "node": node, "n": size, "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([sets[i] for i, _ in held]).view(np.int64))),
        })
        return pa.concat_tables([members, entries, whole, _ROW.empty_table()], promote_options="default").select(_ROW.names)

    return use


def _possible(num: int, den: int, a: str = "x", b: str = "y") -> F.Column:
    """Length, positional and suffix filters for two entries of one shingle."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil((na + nb) * F.lit(num) / F.lit(num + den))
    follow = 1 + F.least(na - F.col(f"{a}.pos") - 1, nb - F.col(f"{b}.pos") - 1)
    shared = sum((F.least(F.col(f"{a}.ranges")[i], F.col(f"{b}.ranges")[i]) for i in range(RANGES)), F.lit(0))
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (follow >= need) & (shared >= need)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold, with `linked`."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(one, "a").join(two, "b").select("a", "b", (both * den >= union * num).alias("linked"))


def _dealt(rows: DataFrame) -> DataFrame:
    """A row for each salt of a shingle, to meet that shingle's entries by (shingle, salt). rows: shingle, salts and more."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _linked(rows: DataFrame, num: int, den: int, pivots: int) -> DataFrame | None:
    """node, root for all nodes with a link to another node.

    Aggregates by shingle are added up before they are dealt, and what they give meets the entries by (shingle, salt), so no
    task holds all sets with one shingle.
    """
    raw = rows.where("kind = 'entry'").select("shingle", "node", "n", "pos", "central", "ranges", "salts").dropDuplicates(["shingle", "node"])
    raw = raw.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    often = raw.groupBy("shingle").agg(F.count("*").alias("c"), F.max("salts").alias("salts")).where("c > 1").select("shingle", "salts")
    entries = written(raw.join(_dealt(often), ["shingle", "salt"]), "entries")
    if entries.isEmpty():
        return None
    sets = written(rows.where("kind = 'set'").select("node", "shingles").dropDuplicates(["node"]).join(entries.select("node").distinct(), "node"), "sets")
    tested, labels = None, None
    current = entries.withColumn("root", F.col("node"))
    for _ in range(pivots):
        top = current.groupBy("shingle").agg(
            F.max_by(F.struct("node", "n", "pos", "ranges", "root"), F.struct("central", "node")).alias("y"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("salts").alias("salts")
        ).where("r0 <> r1").select("shingle", "salts", "y")
        top = written(top, "pivots")
        near = current.alias("x").join(_dealt(top), ["shingle", "salt"]).where((F.col("x.root") != F.col("y.root")) & _possible(num, den))
        pairs = near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        new = written(_verified(pairs, sets, num, den), "tested")
        tested = new if tested is None else tested.unionByName(new)
        labels = components(tested.where("linked").select("a", "b"))
        current = entries.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # the nodes used as pivots step back, so that another round takes the next
        used = top.select("shingle", F.col("y.node").alias("node"))
        current = current.join(used.withColumn("used", F.lit(1)), ["shingle", "node"], "left").withColumn("central", F.when(F.col("used").isNull(), F.col("central")).otherwise(-1)).drop("used")
        current = written(current, "labelled")
    mixed = current.groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("salts").alias("salts")).where("r0 <> r1").select("shingle", "salts")
    # sizes within the threshold lie in the same or in the next class of lengths
    step = float(np.log(den / num))
    rest = written(
        current.join(_dealt(mixed), ["shingle", "salt"]).withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + 1e-9))
        .select("shingle", "size", "salt", "salts", "node", "root", "n", "pos", "ranges"), "rest"
    )
    # salts meet in squares (p, q) with p <= q: the first partner has salt p, the second salt q
    one = rest.withColumn("p", F.col("salt")).withColumn("q", F.explode(F.sequence("salt", F.col("salts") - 1)))
    two = rest.withColumn("q", F.col("salt")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("salt"))))
    two = two.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    square = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("shingle", "size", "p", "q")]
    once = (F.col("x.p") < F.col("x.q")) | (F.col("x.node") < F.col("y.node"))
    far = one.alias("x").join(two.alias("y"), square).where(once & (F.col("x.root") != F.col("y.root")) & _possible(num, den))
    pairs = far.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    new = written(_verified(pairs, sets, num, den), "tested")
    return components(tested.unionByName(new).where("linked").select("a", "b"))


def _named(docs: DataFrame, text_col: str, words: int, num: int, den: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Blocks, and for each row: doc_id, block, at, n, name (class of the row: its component's root, its node, or itself)."""
    blocks = blocked(docs, text_col)
    size = volume(blocks)
    n = shards(size, PER_SHARD)
    df = answered(asked(blocks, _ask(words, n)), _count, n)
    rows = written(told(blocks, size, df, _tell(words, num, den), _NODES), "nodes")
    members = rows.where("kind = 'member'").select("doc_id", "block", "at", "n", "node")
    roots = _linked(rows, num, den, pivots)
    if roots is None:
        return blocks, members.withColumn("name", F.col("node"))
    return blocks, members.join(roots, "node", "left").select("doc_id", "block", "at", "n", F.coalesce("root", "node").alias("name"))


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN, pivots: int = PIVOTS
) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    _, rows = _named(own, "text", words, num, den, pivots)
    # written, so that the join can split the rows of a hot component
    least = written(rows.where("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least, "name", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN, pivots: int = PIVOTS
) -> DataFrame:
    """The rows of docs, all columns, one for each component: that of the smallest id. Rows without words all stay."""
    if (id_col, text_col) != ("doc_id", "text"):
        raise ValueError("one_of_each works on columns doc_id and text")
    blocks, rows = _named(docs, "text", words, num, den, pivots)
    first = rows.where("name IS NOT NULL").groupBy("name").agg(F.min(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "block", "at")).alias("k"))
    kept = first.select("k.block", "k.at").unionByName(rows.where("name IS NULL").select("block", "at"))
    return chosen(blocks, volume(blocks), kept, docs.schema)
