"""Repeated passages against a brute force on windows of 50 words, which knows nothing of runs."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np

from tallygrove.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def untouched(spark, data, width=50):
    """Windows of `width` words that stay whole at more than one place."""
    cleaned = {r["doc_id"]: r["removed"] for r in remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    places = defaultdict(set)
    for d, text in data:
        gone = {i for s in cleaned[d] for i in range(s["start"], s["end"])}
        found = [(m[0].lower(), m.start() in gone) for m in WORD.finditer(text or "")]
        for i in range(len(found) - width + 1):
            if not any(g for _, g in found[i : i + width]):
                places[tuple(w for w, _ in found[i : i + width])].add((d, i))
    return [(w, p) for w, p in places.items() if len(p) > 1]


def prose(rnd, n):
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))


def test_short_sentences_and_lines(spark):
    rnd = random.Random(3)
    menu = "\n".join(prose(rnd, rnd.choice([1, 2, 3])) for _ in range(40))
    junk = " ".join(f"J{rnd.randrange(900)}!!" for _ in range(80))
    talk = " ".join(f"{prose(rnd, 2)}? No. {prose(rnd, 1)}!" for _ in range(20))
    data = [(k, f"{prose(rnd, 9)}.\n{x}\n{prose(rnd, 9)}.") for k, x in enumerate([menu, junk, talk] * 3)]
    assert untouched(spark, data) == []


def test_short_sentences_on_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    left = untouched(spark, rows)
    assert [w for w, _ in left if sum(x[-1] in ".!?" for x in w) >= 8] == []


def test_passages_without_stops(spark):
    """51 words in other surroundings each time: found always, and few of the words stay."""
    rnd = random.Random(4)
    data, kept = [], 0
    passages = [prose(rnd, 51).replace("w", f"p{k}x") for k in range(300)]
    for k, x in enumerate(passages):
        data += [(2 * k + i, f"{prose(rnd, rnd.randrange(40))} {x} {prose(rnd, rnd.randrange(40))}") for i in range(2)]
    assert untouched(spark, data) == []
    for r in remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect():
        if r["doc_id"] % 2:
            left = r["text"].count(f"p{r['doc_id'] // 2}x")
            assert left < 40
            kept += left
    assert kept < 0.25 * 51 * len(passages)


def test_passages_in_texts_without_spaces(spark):
    rnd = random.Random(5)
    han = lambda n: "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(n))
    stops = "".join(han(rnd.randrange(5, 15)) + "。" for _ in range(12))
    plain = han(120)
    data = [(k, han(rnd.randrange(30)) + x + han(rnd.randrange(30))) for k, x in enumerate([stops, plain] * 2)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[0] == data[0][1] and got[1] == data[1][1]
    assert stops[25:80] not in got[2] and plain[25:80] not in got[3]
    assert len(got[2]) < len(data[2][1]) - 70 and len(got[3]) < len(data[3][1]) - 70


def test_tokens_against_a_pattern():
    from tallygrove.llm.substring_dedup import tokens

    for text in ("", "ab 文字x。 y", "文", "é文 字\nสวัส ok", "a𠀀b 𠀀", "x。", "…“q”"):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        first, end, half = tokens(data)
        want = re.findall(r"[⺀-鿿฀-࿿＀-﾿\U00020000-\U00033fff]|[^\s⺀-鿿฀-࿿＀-﾿\U00020000-\U00033fff]+", text)
        assert [bytes(data[a:b]).decode() for a, b in zip(first, end, strict=True)] == want
        assert len(half) == len(want)


def test_copies_of_short_texts(spark):
    """Texts of one or two sentences, or of few words, are compared whole, and only with whole texts."""
    shorts = ["The cat sat on the mat. It was a sunny day today.", "Yes.", "One. Two. Three. Four.", "lonely words here"]
    data = [(10 * c + k, x) for c in range(2) for k, x in enumerate(shorts)] + [(50, f"{shorts[0]} Then there came a dog along the road. It barked."), (51, "Yes. No."), (52, " THE cat sat on the mat. It was  a sunny day today.")]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(4)] == shorts and [got[10 + k] for k in range(4)] == [""] * 4
    assert got[50] == data[8][1] and got[51] == "Yes. No." and got[52] == ""


def brute_runs(text):
    """(start, end, words) of every run, in plain Python: sentences by stops and line ends, for texts whose sentences have at most ten words."""
    sentences, begin, count = [], 0, []
    for line in re.finditer(r"[^\n]+", text):
        for m in WORD.finditer(line[0]):
            count.append(m[0].lower())
            if m[0][-1] in ".!?" or not line[0][m.end() :].strip():
                sentences.append((begin, line.start() + m.end(), tuple(count)))
                begin, count = line.start() + m.end(), []
    runs = []
    for i in range(len(sentences)):
        for j in range(i + 3, len(sentences) + 1):
            if sum(len(s[2]) for s in sentences[i:j]) >= 12:
                runs.append((i, j))
                break
    return sentences, runs or ([(0, len(sentences))] if sentences else [])


def test_against_plain_runs(spark):
    """Which sentences go, by a brute force of its own over word tuples."""
    rnd = random.Random(6)
    pool = [[" ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 10))) + rnd.choice(".!?") for _ in range(rnd.randrange(2, 9))] for _ in range(25)]
    data = []
    for d in range(80):
        parts = [s for _ in range(rnd.randrange(1, 4)) for s in rnd.choice(pool)]
        parts += [f"own{d} " + " ".join(f"z{rnd.randrange(9999)}" for _ in range(5)) + "." for _ in range(rnd.randrange(3))]
        data.append((d, rnd.choice([" ", "\n"]).join(parts)))
    first, cut = {}, {}
    for d, text in data:
        sentences, runs = brute_runs(text)
        for i, j in runs:
            first.setdefault(tuple(s[2] for s in sentences[i:j]), (d, i))
    for d, text in data:
        sentences, runs = brute_runs(text)
        cut[d] = {k for i, j in runs if first[tuple(s[2] for s in sentences[i:j])] != (d, i) for k in range(i, j)}
    assert sum(map(bool, cut.values())) > 30 and not all(cut.values())
    for r in remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect():
        sentences, _ = brute_runs(data[r["doc_id"]][1])
        kept = [w for k, s in enumerate(sentences) if k not in cut[r["doc_id"]] for w in s[2]]
        assert [w.lower() for w in WORD.findall(r["text"])] == kept
