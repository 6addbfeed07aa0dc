"""Excerpts of benchmark items, short items, and a benchmark in several blocks."""

from __future__ import annotations

import random

import tallygrove.llm.decontamination as D


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def judged(spark, data, items):
    df, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: r for r in D.contamination(df, bench).collect()}


def test_excerpts_of_items(spark):
    rnd = random.Random(1)
    items = [(k, words(rnd, 60)) for k in range(20)]
    data = []
    for d in range(120):
        k, n = d % 20, (79, 100, 120, 135, 150, 170)[d // 20]
        at = rnd.randrange(len(items[k][1]) - n)
        data.append((d, f"{words(rnd, 30)} {items[k][1][at:at + n]} {words(rnd, 30)}"))
    data += [(1000 + d, words(rnd, 120)) for d in range(20)]
    got = judged(spark, data, items)
    for d in range(120):
        assert got[d]["items"] == [d % 20]
    assert all(got[1000 + d]["kept"] for d in range(20))


def test_short_items_are_searched_whole(spark):
    items = [(1, "Who wrote Faust?"), (2, " capital of the Peru "), (3, "seven times eleven is what number"), (4, " Paris "), (5, "42"), (6, " "), (7, None), (8, "paris")]
    data = [(1, "Who wrote Faust?"), (2, "so, who  wrote Faust? x"), (3, "say: who wrote faust? he"), (4, "he who wrote faust?s x"), (5, "capital of the peru"), (6, "x seven times elevin is what number y"), (7, "seven times"), (8, "she said:\n  PARIS\n42 of them"), (9, "Paris is a town"), (10, "\n42")]
    got = judged(spark, data, items)
    assert {d: r["items"] for d, r in got.items()} == {1: [1], 2: [], 3: [1], 4: [], 5: [2], 6: [3], 7: [], 8: [4, 8], 9: [], 10: [5]}
    assert got[8]["starts"] == [12, 12] and got[8]["ends"] == [17, 17]
    assert got[3]["starts"] == [4] and got[3]["ends"] == [22]


def test_blocks_give_the_same(spark, monkeypatch):
    rnd = random.Random(2)
    items = [(k, words(rnd, 30)) for k in range(12)]
    data = [(d, f"{items[d % 12][1]} {words(rnd, 9)} {items[(d + 5) % 12][1]}") for d in range(12)] + [(None, None), (5, ""), (None, items[3][1]), (None, items[3][1])]
    one = sorted((str(r["doc_id"]), sorted(zip(r["items"], r["starts"], r["ends"]))) for r in D.contamination(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    monkeypatch.setattr(D, "BLOCK_CHARS", 500)
    many = sorted((str(r["doc_id"]), sorted(zip(r["items"], r["starts"], r["ends"]))) for r in D.contamination(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert one == many and sum(len(x) for _, x in one) == 26


def least_edits(piece, text):
    """Edits of the best place of `piece` in `text`, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(piece, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_both_ways_against_edit_distances(spark):
    """Items of 12 to 72 characters, with edits around what is allowed: found just when the distance is within it."""
    rnd = random.Random(11)
    items = [(k, words(rnd, rnd.randrange(3, 14))[:72].strip()) for k in range(16)]
    items = [(k, t) for k, t in items if len(t) >= 12]

    def allowed(t):
        n = len(t) + (2 if len(t) < 40 else 0)
        return max(0, min(int(0.08 * n), (n - 10) // 10))

    data = []
    for d in range(240):
        t = list(items[d % len(items)][1])
        for _ in range(rnd.randrange(0, allowed("".join(t)) + 4)):
            at = rnd.randrange(len(t))
            t[at : at + 1] = rnd.choice(["", "q", t[at] + "q"])
        data.append((d, f"{words(rnd, rnd.randrange(6))} {''.join(t)} {words(rnd, rnd.randrange(6))}"))
    got = judged(spark, data, items)
    hits = 0
    for d, text in data:
        want = [k for k, t in items if least_edits(f" {t} " if len(t) < 40 else t, f" {text} ") <= allowed(t)]
        assert sorted(got[d]["items"]) == want, (text, want)
        hits += bool(want)
    assert 60 < hits < 200
