"""Operators that must do their whole job: every script, and links until they are settled."""

import pytest

from barflow.llm.components import components
from barflow.llm.quality_rules import RULES, Doc, cascade


def test_rules_leave_prose_of_other_scripts():
    cyrillic = " ".join(f"слово{k} которое стоит в тексте{k} рядом с NATO" for k in map(chr, range(0x430, 0x44A)))
    # each paragraph differs, so that no window of words repeats
    han = "\n".join("".join(chr(0x4E00 + (37 * k + 11 * j) % 5000) for j in range(60)) + "。" for k in range(25))
    thai = " ".join("".join(chr(0x0E01 + (7 * k + 3 * j) % 46) for j in range(40)) for k in range(25))
    for text in (cyrillic, han, thai):
        assert cascade(RULES, Doc(text.encode())) is None
    words = [f"word{chr(97 + k)}" for k in range(25)]
    assert cascade(RULES, Doc(" ".join(w.upper() for w in words).encode())) == "capitals"
    assert cascade(RULES, Doc(" ".join(f"СЛОВО{chr(0x410 + k)}" for k in range(25)).encode())) == "capitals"
    assert cascade(RULES, Doc(" ".join(w * 8 for w in words).encode())) == "word_length"
    assert cascade(RULES, Doc(" ".join(w * 8 + "漢" for w in words).encode())) == "word_length"


def test_links_settle_or_raise(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(chain).collect()} == {(k, 0) for k in range(41)}
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)
