"""Spelling variants, the n-gram join and the source divergence audit against brute force, on real tables and on awkward ones."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import ngram_join, source_divergence
from tallygrove.llm import queries as Q
from tallygrove.llm.ngram_join import _may_link, bitmap, folded, least_common, linked_documents
from tallygrove.llm.source_divergence import divergence
from tallygrove.llm.spelling_variants import TwoWayIndex, WaveletTree, near_words, spelling_variants, vocabulary
from tallygrove.llm.text_hash import shingles

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    long = "lorem ipsum dolor sit amet " * 20_000
    data = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, long, "en", None), (4, long, "en", None),
        (5, "one", "en", "b"), (5, "two", "de", "b"), (None, "three words here", None, "é"), (None, "three words here", None, "é"),
        (6, "Ünïcödé 。 文字 text Ünïcödé ünïcödé", "en", ""), (7, "x" * 50_000, "en", "a"), (8, "1" * 3_000 + " .1.2.3.4", "en", "a"),
        (9, "planets planet PLANET planet planet planet plamet plamet plamet plamet plamet", "", ""), (10, ("z" * 40_000 + " ") * 6, "fr", "a"),
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def nullable(v):
    return "null" if v is None else str(v)


# Spelling variants.
def brute_words(rows):
    n = Counter()
    for d, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{nullable(d)}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def variants(df):
    rows = df.collect()
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_variants_of_written_texts(spark):
    rng = random.Random(5)
    stems = ["planet", "aaaaaa", "aaaaaaa", "señora", "bookkeeper", "bookkeper", "abcdefghij" * 4]
    texts = []
    for k in range(250):
        some = []
        for _ in range(12):
            w, r = rng.choice(stems), rng.random()
            i = rng.randrange(len(w))
            w = w[:i] + w[i + 1 :] if r < 0.2 else w[:i] + rng.choice("aéb") + w[i:] if r < 0.4 else w[:i] + rng.choice("azé") + w[i + 1 :] if r < 0.6 else w
            some.append(rng.choice((w, w.translate({97: 65}))))
        texts.append((k, " ".join(some), "en", "a"))
    want = brute_variants(brute_words(texts))
    assert len(want) > 50 and any(w[1] for w in want) and max(w[4] for w in want) > 5
    assert variants(spelling_variants(spark.createDataFrame(texts, SCHEMA))) == want


def test_roots_follow_forms(spark):
    texts = [(1, " ".join(["abcdef"] * 1000 + ["abcdeg"] * 130 + ["abcdhg"] * 26 + ["abcihg"] * 5), "en", "a")]
    got = {r["word"]: r["root"] for r in spelling_variants(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert got == dict.fromkeys(("abcdef", "abcdeg", "abcdhg", "abcihg"), "abcdef")


def test_variants_of_odd_tables(odd, empty):
    words = brute_words(rows_of(odd))
    assert variants(spelling_variants(odd)) == brute_variants(words)
    assert spelling_variants(empty).count() == 0
    more = odd.withColumns({c: F.lit("mine") for c in ("word", "n", "form", "root", "length", "piece")})
    assert variants(spelling_variants(more)) == brute_variants(words)


def test_near_words_by_small_shards(spark, monkeypatch):
    from tallygrove.llm import spelling_variants as S

    rng = random.Random(9)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(6, 9))): rng.randrange(5, 500) for _ in range(900)}
    want = {(w, sum(one_edit(w, v) for v in words if abs(len(v) - len(w)) < 2)) for w in words}
    for shard in (20_000, 50):
        monkeypatch.setattr(S, "SHARD", shard)
        got = {(r["word"], r["n_near"]) for r in near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
        assert got == {x for x in want if x[1]}


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 64, 100, 257):
        values = rng.permutation(size)
        q = np.sort(rng.integers(0, size + 1, (50, 2, 2)), axis=2)
        a, b, c, d = q[:, 0, 0], q[:, 0, 1], q[:, 1, 0], q[:, 1, 1]
        query, value = WaveletTree(values).report(a, b, c, d)
        want = {(k, int(v)) for k in range(50) for v in values[a[k] : b[k]] if c[k] <= v < d[k]}
        assert set(zip(query.tolist(), value.tolist())) == want and len(query) == len(want)


def test_two_way_index():
    words = np.array([b"planet", b"plamet", b"planes", b"blanet"])
    index = TwoWayIndex(words)
    i, j = index.around(words, 3, replaced=True)
    assert {(words[x], words[y]) for x, y in zip(i, j)} == {(b"planet", b"plamet"), (b"plamet", b"planet")}
    i, j = index.around(np.array([b"plane"]), 5, replaced=False)
    assert {words[y] for y in j} == {b"planet", b"planes"}


# N-gram join.
def brute_links(rows, percent=80):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                comp[top(i)] = top(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)].append(r[0])
    return Counter((r[0], len(s), min(low[top(i)], default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


def links(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def near_texts(seed, groups=12, passage=60):
    """Groups of near copies about the threshold, and a passage that most of the documents share."""
    rng = random.Random(seed)
    shared = [f"p{i}" for i in range(passage)]
    out = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.choice((6, 20, 80, 200)))]
        for _ in range(rng.choice((1, 2, 5, 25))):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 40))):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(0, 2)] = [f"x{rng.randrange(9999)}"]
            out.append(w + shared if rng.random() < 0.7 else w)
    rng.shuffle(out)
    return [(k, " ".join(w), "en", "a") for k, w in enumerate(out)]


@pytest.mark.parametrize("small", [16, 2])
def test_join_links_what_is_similar(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", 4 if small == 2 else ngram_join.BLOCK)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1 if small == 2 else ngram_join.PIVOTS)
    rows = near_texts(small)
    assert links(linked_documents(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute_links(rows)


def test_join_of_real_and_odd_tables(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert links(linked_documents(docs)) == brute_links(rows_of(docs))
    assert links(linked_documents(odd)) == brute_links(rows_of(odd))
    assert linked_documents(empty).count() == 0
    more = odd.withColumns({c: F.lit("mine") for c in ("n", "node", "key", "comp", "bits", "first", "th")})
    assert links(linked_documents(more)) == brute_links(rows_of(odd))


def test_bitmaps_never_rule_out_a_link():
    rng = random.Random(2)
    for _ in range(300):
        base = [f"w{rng.randrange(50)}" for _ in range(rng.choice((3, 7, 60, 300, 3000)))]
        other = [w for w in base if rng.random() > 0.05] + [f"y{i}" for i in range(rng.randrange(0, 1 + len(base) // 10))]
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if not len(a) or not len(b):
            continue
        c = len(np.intersect1d(a, b))
        x, y = (np.frombuffer(bitmap(s), dtype=np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        differ = np.bitwise_count(folded(x[None, :], size) ^ folded(y[None, :], size)).sum()
        assert differ <= len(a) + len(b) - 2 * c
        linked = 100 * c >= 80 * (len(a) + len(b) - c)
        assert not linked or bool(_may_link(np.array([len(a)]), np.array([len(b)]), np.array([differ]))[0]) and c >= least_common(max(len(a), len(b)))


# Source divergence.
def brute_divergence(rows, least=30, top=50):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in docs[lang].items() if c >= least]
        v = len(kept)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        q = share(sum((count[lang, s] for s in sources), Counter()))
        p = {s: share(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [("pair", o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for some, most in ((pairs, None), (terms, top)):
                for rank, (part, item, value) in enumerate(sorted(some, key=lambda x: (-x[2], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return Counter(out)


def audit(df):
    return Counter((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_divergence_of_written_texts(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for k in range(1500):
        lang, source = rng.choice(("en", "de", None)), rng.choice(("a", "b", "c", "Ä", None, "lone" if k < 2 else "b"))
        rows.append((k, " ".join(f"T{rng.choice('abcdefghijklmnopqrstuvwxyzé')}{rng.choice('xyzü')}{rng.choice('ab') if source == 'a' else ''}" for _ in range(rng.randrange(0, 60))), lang, source))
    rows += [(9000, "rare", "fr", "a"), (9001, None, "fr", "b"), (9002, "", "it", "only"), (9003, "1 2 3", "it", "digits")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_divergence(rows)
    assert sum(x[2] == "term" for x in want) > 300 and max(x[5] for x in want) == 50
    assert audit(divergence(df)) == want
    monkeypatch.setattr(source_divergence, "GROUPS", 2)
    monkeypatch.setattr(source_divergence, "TERMS", 7)
    monkeypatch.setattr(source_divergence, "HELD", 3)
    assert audit(divergence(df)) == want


def test_divergence_of_odd_tables(spark, odd, empty):
    assert audit(divergence(odd)) == brute_divergence(rows_of(odd))
    rows = rows_of(odd) * 31
    assert audit(divergence(spark.createDataFrame(rows, SCHEMA))) == brute_divergence(rows)
    assert divergence(empty).count() == 0
    more = odd.withColumns({c: F.lit("mine") for c in ("term", "n", "p", "q", "z", "v", "rank", "item")})
    assert audit(divergence(more)) == brute_divergence(rows_of(odd))


# SQL.
@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_ngram_join", "op13_source_divergence"])
def test_queries_give_the_rows_of_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{Path(sf_dir, 'documents.parquet')}')")
    res = con.execute(Q.SQL[name])
    names = [d[0] for d in res.description]
    df = Q.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(res.fetchall())


def test_vocabulary_counts_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {r["word"]: r["n"] for r in vocabulary(docs).collect()} == brute_words(rows_of(docs))


def test_join_of_near_copies_deals_few_rows_to_blocks(spark, monkeypatch):
    """Copies with many words of their own cannot be linked by what all share, so they leave the tiles of it."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng, seen, by_blocks = random.Random(3), [], ngram_join._pairs_by_blocks
    monkeypatch.setattr(ngram_join, "_pairs_by_blocks", lambda members, nodes: seen.append(members.count()) or by_blocks(members, nodes))
    rows = []
    for d in range(200):
        w = [f"w{i}" for i in range(120)]
        for k in range(rng.choice((1, 2, 3, 4, 6))):
            w[rng.randrange(120)] = f"x{d}y{k}"
        rows.append((d, " ".join(w), "en", "a"))
    assert links(linked_documents(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute_links(rows)
    assert seen[0] < len(rows)


def test_counters_move_compressed():
    counts = np.random.default_rng(5).poisson(2, ngram_join.CHUNK).astype(np.int32)
    counts[7] = 70_000
    packed = ngram_join._packed(counts)
    assert (ngram_join._unpacked(packed) == counts).all() and len(ngram_join._packed(np.minimum(counts, 9))) < ngram_join.CHUNK


def test_only_shingles_that_may_be_shared_are_joined(spark, monkeypatch):
    """The rows' first shingles are written once and go through no join, also where classes are not broadcast."""
    plans, kept = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, label: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df, label))
    text = [" ".join(f"t{d}x{k}" for k in range(60)) for d in range(8)]
    docs = spark.createDataFrame([(d, text[d % 8] + (" end" if d > 15 else "")) for d in range(24)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in linked_documents(docs).collect()} == {d: d % 8 for d in range(24)}
    assert [label for label, plan in plans if label in ("shared", "crowded") and "first" in plan] == []
