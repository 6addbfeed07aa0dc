"""A language with a single training text, and the filter against plain sets."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np

from tallygrove.llm import language_id as L
from tallygrove.llm.language_id import identify_languages


def test_one_text_is_enough(spark):
    train = [d for d in range(100) if zlib.crc32(str(d).encode()) % 4 != 2]
    held = [d for d in range(100) if d not in train]
    rare = "zwrk qwyx vbnjt plokm uhzgf zwrkq ytrew"
    data = [(d, f"the quick brown fox and the lazy dog number {'abcdefghij'[d % 10]}", "en") for d in train[1:]]
    data += [(train[0], rare, "xx"), (held[0], rare, "xx"), (held[1], "the quick lazy dog", "en")]
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert got[held[0]] == "xx" and got[held[1]] == "en"


def plain_grams(text):
    t = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    t = re.sub(" +", " ", t)
    return {t[i : i + n] for n in (3, 4) for i in range(len(t) - n + 1)} | {(w,) for w in t.split()}


def test_filter_against_plain_sets(spark, monkeypatch):
    """No language's n-gram is missed, few are added, and scores agree with counts on sets."""
    monkeypatch.setattr(L, "_AT_ONCE", 500)
    rnd = random.Random(3)
    langs = {f"l{k:02d}": "".join(rnd.sample("abcdefghijklmnopqrstuvwxyz", 9)) for k in range(70)}  # more than one plane of masks
    text = lambda a: " ".join("".join(rnd.choice(a) for _ in range(rnd.randrange(2, 8))) for _ in range(30))
    data = [(d, text(langs[name]), name) for d, name in enumerate(sorted(langs) * 6)]
    model = L.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model["langs"] == sorted(langs) and model["planes"].shape[0] == 2
    known = {name: set() for name in langs}
    for d, t, name in data:
        if zlib.crc32(str(d).encode()) % 4 != 2:
            known[name] |= plain_grams(t)
    for d, t, name in data[:40]:
        own = plain_grams(t)
        want = np.array([len(own & known[n]) / len(own) for n in model["langs"]])
        assert np.abs(L.hits(model, t) - want).max() < 0.03
