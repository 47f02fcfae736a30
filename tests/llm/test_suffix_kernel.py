"""The distributed steps of the suffix dedup, run in one process on small alphabets, with hot owners and small transforms."""

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

import barflow.llm.suffix_dedup as sd


def run(blocks, least, gram, n=3):
    tables = [pa.table({"text": pa.array(b, pa.string())}) for b in blocks]

    def shards(asked, f):
        return [(b, s, p) for s in sorted({x[1] for x in asked}) for b, p in f(sorted((k, p) for k, t, p in asked if t == s))]

    asked = [(k, s, p) for k, t in enumerate(tables) for s, p in sd._ask_owners("text", least, gram, n)(t)]
    seen = shards(asked, sd._count_owners)
    sent = []
    for k, t in enumerate(tables):
        out = sd._send("text", least, gram, n)(k, t, sorted((s, p) for b, s, p in seen if b == k))
        sent += zip(out["block"].to_pylist(), out["shard"].to_pylist(), out["payload"].to_pylist(), strict=True)
    flags = shards(sent, sd._judge(least))
    for k, t in enumerate(tables):
        for text, mask in sd._masks(t, "text", sorted((s, p) for b, s, p in flags if b == k), least):
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
            yield len(text), int(mask.sum()), len(sd._spans(mask)), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", range(40))
def test_against_all_substrings(seed, monkeypatch):
    rng = random.Random(seed)
    least, gram = rng.choice([(20, 8), (24, 5), (33, 12)])
    letters = rng.choice(["ab", "abc", "abcdefgh é", "a"])
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(4)]

    def doc():
        if rng.random() < 0.1:
            return rng.choice(["", None, "x"])
        return "".join(rng.choice([rng.choice(passages), "".join(rng.choice(letters + "zyxwv") for _ in range(rng.randint(0, 40)))]) for _ in range(rng.randint(1, 5)))

    blocks = [[doc() for _ in range(rng.randint(1, 5))] for _ in range(3)]
    monkeypatch.setattr(sd, "HOT", rng.choice([4096, 3, 1, 8]))
    monkeypatch.setattr(sd, "BWT_BYTES", rng.choice([50, 1 << 20]))
    monkeypatch.setattr(sd, "_CHUNK", rng.choice([37, 1 << 20]))
    assert list(run(blocks, least, gram)) == brute.repeats([t for b in blocks for t in b], least)


def test_bounded_rows_are_common_prefixes():
    text = np.frombuffer(b"banana_bandana_banana\0", np.uint8).astype(np.int64)
    _, text = np.unique(text, return_inverse=True)
    order = sorted(range(len(text)), key=lambda i: text[np.r_[i : len(text), 0:i]].tolist())
    rot = [text[np.r_[i : len(text), 0:i]].tolist() for i in order]
    lcp = [next((k for k in range(len(text)) if a[k] != b[k]), len(text)) for a, b in zip(rot, rot[1:], strict=False)]
    for least in (1, 2, 4, 7):
        bounded = sd.bounded_rows(text[np.array(order) - 1], int(text.max()) + 1, least)
        assert bounded[1:-1].tolist() == [x < least for x in lcp]
        assert [text[np.r_[i : len(text), 0:i]].tolist()[:least] for i in sd.suffix_order(text, least)] == [x[:least] for x in rot]
