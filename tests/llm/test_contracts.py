"""Training-data queries against brute force, on real tables and on awkward ones."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallygrove.llm import queries as Q
from tallygrove.llm.decontamination import contamination
from tallygrove.llm.language_id import identify_languages
from tallygrove.llm.mixing import mix_documents, mixed_sizes
from tallygrove.llm.near_dup import drop_near_duplicates, near_duplicates
from tallygrove.llm.pii import base_spans, find_pii, pii_digest, redact
from tallygrove.llm.quality_classifier import classify, keep_good
from tallygrove.llm.quality_rules import score_quality
from tallygrove.llm.sharding import shard_digest, shard_documents, write_shards
from tallygrove.llm.substring_dedup import remove_repeats, repeats_digest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    long = "lorem ipsum dolor sit amet " * 20_000
    data = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 3), (4, long, "en", None, 1), (4, long, "en", None, 1),
        (5, "one", "en", "b", 3), (5, "two", "de", "b", 3), (None, "three words here", None, "é", None), (None, "three words here", None, "é", None),
        (6, "Ünïcödé 。 文字 text @ x@y.zz +1 (222) 333-4444", "en", "", 9), (7, "x" * 50_000, "en", "a", 1), (8, "1" * 3_000 + " .1.2.3.4", "en", "a", 1),
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


# Mixing.
def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling, source by source."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not full:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def check_mix(df, rows):
    got = df.collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    target = brute_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(words(t))) for d, t, _ in rows)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-9, abs=1e-9)
        taken[r["source"]] += r["taken"]
    return target, taken


def test_mixing(docs, rows):
    target, taken = check_mix(mixed_sizes(docs), rows)
    largest = max(len(words(t)) for _, t, _ in rows)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 3 * largest
    a, b = (sorted(map(tuple, mixed_sizes(d).collect()), key=str) for d in (docs, docs.repartition(7)))
    assert a == b
    mixed = mix_documents(docs).groupBy("doc_id").count().collect()
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixed_sizes(docs).collect() if r["size"] and r["taken"]}
    assert {r["doc_id"]: r["count"] for r in mixed if r["doc_id"] in want} == want


# Quality rules.
def brute_quality(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def check_quality(df, rows):
    want = Counter()
    for d, t, _ in rows:
        n, c, s, dup, rep = brute_quality(t)
        want[d, n, c, s, dup, rep, n < 50 or 100 * rep > 50 * n] += 1
    got = df.collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    return got


def test_quality_rules(docs, rows, spark, sf_dir):
    got = check_quality(score_quality(docs), rows)
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    clean = [r for r in got if r["doc_id"] in good and not r["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.95 * len(clean)


# Personal data.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_pii(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in p.finditer(text or ""):
            digits = re.sub(r"\D", "", m[0], flags=re.ASCII)
            if kind == "ip" and any(len(x.lstrip("0")) > 3 or int(x.lstrip("0")[:4] or 0) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) if 16 <= len(digits) <= 19 else 1
                if total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def check_pii(df, rows):
    want = Counter()
    for d, t, _ in rows:
        spans = brute_pii(t)
        n = Counter(k for k, _, _ in spans)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want[d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest()] += 1
    got = df.collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    return got


def test_pii(docs, rows):
    by_id = {d: t for d, t, _ in rows}
    for r in check_pii(pii_digest(docs), rows):
        base = {f"{k}:{s}:{e}" for k, s, e in brute_pii(by_id[r["doc_id"]])}
        every = [x for x in r["spans"].split(",") if x]
        assert base <= set(every) and len(every) == len(base) + r["n_added"]


TRICKY = [
    "a@b.c@d.e", "@@x@y.z", "a.b@c", "x@y-.z.", "a@b..c", "1.2.3.4.5.6.7.8", "999.1.1.1", "001.002.003.004", "1.2.3", "1..2.3.4", "٣.1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111  111111111111", "+1 (222) 333-4444 55", "++1222333444", "+1 2 (", "+12345678901234567", "mail me: joe@x.org.",
]


@pytest.mark.parametrize("text", [*TRICKY, " ".join(TRICKY), "a" * 5000 + "@" + "b" * 5000, "1" * 5000, "1." * 3000])
def test_pii_patterns(text):
    got = [(k, s, e) for k in PATTERNS for s, e in base_spans(text)[k]]
    assert got == brute_pii(text)


def test_pii_further_spans_and_redaction(spark):
    lines = [(i, f"write to joe.{i}@mail{i}.example.com or call +1 (310) 555-{1000 + i} card 4465758382889437") for i in range(60)]
    more = [(100, "contact joe [at] example [dot] com today"), (101, "phone (310) 555-1234 please"), (102, "order 1234567890123456 version 10"), (103, None), (104, "plain words")]
    df = spark.createDataFrame(lines + more, "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_pii(df).collect()}
    assert [a["kind"] for a in got[100]["added"]] == [0] and [a["kind"] for a in got[101]["added"]] == [3]
    assert got[102]["added"] == [] and got[104]["added"] == []
    clean = {r["doc_id"]: r["text"] for r in redact(df).collect()}
    assert clean[100] == "contact [email] today" and clean[104] == "plain words" and clean[103] is None
    assert "@" not in clean[3] and "[phone]" in clean[3] and "[card]" in clean[3]


# Sharding.
def check_shards(df, rows, n=40):
    got = df.collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, load = defaultdict(list), Counter()
    for r in got:
        assert r["law"] == "bytes" and 0 <= r["shard"] < n and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return got, load


def check_groups(got, rows, n=40):
    """Equal texts share a shard unless they exceed one; returns the largest difference from the mean size."""
    texts, shards, size = {d: t for d, t, _ in rows}, defaultdict(set), Counter()
    for r in got:
        shards[texts[r["doc_id"]]].add(r["shard"])
        size[texts[r["doc_id"]]] += r["size"]
    mean = sum(size.values()) / n
    assert {len(shards[t]) for t in shards if size[t] <= mean} <= {1}
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    return max(abs(load[s] - mean) for s in range(n)), mean


def test_sharding(docs, rows, tmp_path):
    got, load = check_shards(shard_digest(docs), rows)
    off, mean = check_groups(got, rows)
    assert off <= 0.02 * mean + max(r["size"] for r in got)
    again = shard_digest(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in again) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in got)
    out = str(tmp_path / "shards")
    write_shards(shard_documents(docs, 5), out)
    back = docs.sparkSession.read.parquet(out)
    assert back.count() == len(rows) and set(docs.columns) <= set(back.columns)


def test_shards_of_more_documents(spark, sf_dir):
    """Mostly small groups at 4 shards, mostly large ones at 40."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    for n in (4, 40):
        got, _ = check_shards(shard_digest(docs, n), rows, n)
        off, mean = check_groups(got, rows, n)
        assert off <= 0.04 * mean


def test_shards_with_large_groups(spark):
    """Half of all bytes in one text, a group of a quarter of a shard, and small ones."""
    data = [(i, "the same words over and over") for i in range(600)] + [(1000 + i, "another text with a few copies") for i in range(5)] + [(2000 + i, f"text {i} by itself, with some words") for i in range(500)]
    rows = [(d, t, None) for d, t in data]
    got, load = check_shards(shard_digest(spark.createDataFrame(data, "doc_id long, text string"), 10), rows, 10)
    off, mean = check_groups(got, rows, 10)
    assert off <= 0.03 * mean and len({r["shard"] for r in got if r["doc_id"] < 1000}) >= 5


def test_dealing_of_large_groups():
    import random

    from tallygrove.llm.sharding import deal_large

    rnd = random.Random(8)
    for _ in range(200):
        n = rnd.randrange(1, 9)
        sizes = [rnd.randrange(1, 400) for _ in range(rnd.randrange(0, 30))]
        total = sum(sizes) + rnd.randrange(0, 2000) + 1
        dealt, room = deal_large(list(enumerate(sizes)), total, n)
        load = Counter()
        for k, pieces in dealt.items():
            assert pieces[-1][0] == sizes[k] and (len(pieces) == 1 or sizes[k] > total / n)
            for i, (end, s) in enumerate(pieces):
                load[s] += end - (pieces[i - 1][0] if i else 0)
        free = [room[s] - (room[s - 1] if s else 0) for s in range(n)]
        assert room[-1] == pytest.approx(total - sum(sizes), abs=1e-6)
        whole = [load[s] + free[s] for s in range(n)]
        filled = [w for w, f in zip(whole, free) if f > 1e-9]
        assert not filled or max(filled) - min(filled) < 1e-6 and max(filled) <= min([w for w, f in zip(whole, free) if f <= 1e-9], default=total) + 1e-6


# Repeated passages.
PASSAGE = " ".join(f"Word{i} says that number {i} follows the {i - 1} before." for i in range(12))


def test_repeated_passages(spark):
    own = lambda k: " ".join(f"Doc{k} has its very own {k * 31 + i} sentence here." for i in range(8))
    data = [(k, f"{own(k)}\n{PASSAGE} {own(100 + k)}") for k in range(6)] + [(50, own(50)), (51, own(51))]
    got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    texts = dict(data)
    assert got[0]["text"] == texts[0] and got[50]["text"] == texts[50] and got[51]["n_removed"] == 0
    for k in range(1, 6):
        assert "Word5 says" not in got[k]["text"] and got[k]["text"].startswith(own(k)[:40])
        spans = [(s["start"], s["end"]) for s in got[k]["removed"]]
        kept, at = [], 0
        for s, e in spans:
            kept.append(texts[k][at:s])
            at = e
        assert "".join(kept) + texts[k][at:] == got[k]["text"]
        assert sum(e - s for s, e in spans) == got[k]["n_removed"] > 400


def test_one_word_over_and_over(spark):
    data = [(1, "start here " + "of " * 100), (2, "of " * 300 + "end"), (3, "of of of of of")]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1].count("of") < 40 and got[2].count("of") < 40 and got[3] == data[2][1]


# Decontamination.
def test_decontamination(spark, sf_dir, docs):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    long = [t for _, t in items if len(t) >= 120]
    edited = long[0][:60] + "X" + long[0][61:]
    data = [(1, f"before {long[0]} after"), (2, f"before {edited.upper()} after"), (3, "nothing of the kind is in here, just a few plain words"), (4, None), (5, ""), (6, long[1][:25])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in contamination(df, bench).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: True, 6: True}
    whole = {r["doc_id"]: r for r in contamination(docs, bench).collect()}
    squash = lambda s: " ".join((s or "").lower().split())
    for d, t in ((r["doc_id"], r["text"]) for r in docs.collect()):
        if any(len(x) >= 60 and squash(x) in squash(t) for _, x in items):
            assert not whole[d]["kept"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["kept"] for r in contamination(df, none).collect()} == {True}


# Near duplicates.
def brute_components(rows):
    sets = []
    for _, t, _ in rows:
        w = words((t or "").translate(LOWER))
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = Counter()
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        low = min(ids) if ids else None
        for i in g:
            out[rows[i][0], len(sets[i]), low, rows[i][0] == low] += 1
    return out


def check_near(df, rows):
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()) == brute_components(rows)


def test_near_duplicates(docs, rows):
    check_near(near_duplicates(docs), rows)
    kept = {r["doc_id"] for r in drop_near_duplicates(docs).collect()}
    assert kept == {d for (d, _, low, _), _ in brute_components(rows).items() if d == low}


def test_near_duplicates_hot_group(spark, monkeypatch):
    """One family of edited copies, large enough to be compared in blocks."""
    import random

    import tallygrove.llm.near_dup as N

    monkeypatch.setattr(N, "BLOCK", 16)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    data = []
    for d in range(90):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 6])):
            w[rnd.randrange(120)] = f"x{rnd.random()}"
        data.append((d, " ".join(w), None))
    data += [(1000 + d, " ".join(base), None) for d in range(40)]
    check_near(near_duplicates(spark.createDataFrame(data, "doc_id long, text string, source string")), data)


# Classifier and languages.
def test_classifier(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = classify(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in classify(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz")}), flipped).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got)


def test_classifier_held_out_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = classify(docs, labels).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / max(1, len(good) * len(bad)) > 0.9


def test_language(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    extra = docs.select("doc_id", "text", "lang", "source").limit(0).union(spark.createDataFrame([(-1, None, None, None), (-2, "123 !?", None, None)], "doc_id long, text string, lang string, source string"))
    both = identify_languages(docs.select("doc_id", "text", "lang", "source").union(extra)).where("doc_id < 0").collect()
    assert {(r["lang_pred"], r["score"]) for r in both} == {("und", 0.0)}


# All of them on awkward tables.
def test_odd_tables(spark, odd, empty):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    check_mix(mixed_sizes(odd), rows)
    check_quality(score_quality(odd), rows)
    check_pii(pii_digest(odd), rows)
    check_shards(shard_digest(odd), rows)
    check_near(near_duplicates(odd), rows)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet")], "item_id long, text string")
    labels = spark.createDataFrame([(None, 1, 0), (4, None, None), (5, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    hit = [r["doc_id"] for r in contamination(odd, bench).where("not kept").collect()]
    assert sorted(hit) == [4, 4]
    for df in (repeats_digest(odd), classify(odd, labels), identify_languages(odd)):
        assert df.count() == len(rows)
    for df in (mixed_sizes(empty), score_quality(empty), pii_digest(empty), shard_digest(empty), near_duplicates(empty), contamination(empty, bench), repeats_digest(empty), classify(empty, labels), identify_languages(empty)):
        assert df.count() == 0


def test_clashing_columns_are_kept_apart(spark, odd):
    more = odd.withColumns({c: F.lit("mine") for c in ("size", "target", "shard", "slot", "score", "kept", "removed", "n", "key", "node", "quality", "copies")})
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert mix_documents(more).columns == more.columns
    assert keep_good(more, labels).columns == more.columns
    assert drop_near_duplicates(more).columns == more.columns
    assert {"shard", "slot"} <= set(shard_documents(more).columns)
    assert remove_repeats(more).count() == more.count()


def test_queries_have_the_contract_columns(spark, sf_dir):
    want = {
        "op1_mixing": "doc_id size source_size target taken", "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op4_sharding": "doc_id size text_crc32 law shard slot grown_shard",
        "op7_near_duplicates": "doc_id n_shingles component_id kept", "op9_quality_classifier": "doc_id held_out score predicted", "op10_language_id": "doc_id held_out lang_pred score",
    }
    for name, cols in want.items():
        assert Q.QUERIES[name](spark, sf_dir).columns[: len(cols.split())] == cols.split()


def test_json_is_canonical():
    from tallygrove.llm.tool_chat import canonical

    assert canonical({"b": 1, "a": ["é"]}) == '{"a":["é"],"b":1}' and json.loads(canonical({"x": None})) == {"x": None}
