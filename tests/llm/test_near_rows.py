"""The pipeline's second stage on repeated rows and null ids, against a brute force of its own."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P


def test_one_row_of_each_group(spark):
    text = lambda k: " ".join(f"g{k}w{i}" for i in range(60))
    data = [(1, text(1)), (1, text(1)), (2, text(1) + " more"), (None, text(2)), (None, text(2)), (None, text(2) + " more"), (7, text(3)), (7, text(3) + " more"), (None, text(4)), (9, text(4)), (11, text(5)), (12, ""), (12, ""), (None, None)]
    got = [tuple(r) for r in P.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"), "").collect()]
    assert not Counter(got) - Counter(data)

    def near(a, b):
        a, b = ({tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in (a, b))
        return 4 * len(a & b) >= 3 * len(a | b)

    full = [r for r in data if r[1]]
    groups = []
    for r in full:
        home = next((g for g in groups if any(near(r[1], x[1]) for x in g)), None)
        groups.append([r]) if home is None else home.append(r)
    for g in groups:
        kept = [r for r in got if r in g]
        ids = [r[0] for r in g if r[0] is not None]
        assert len(kept) == 1 and kept[0][0] == (min(ids) if ids else None)
    assert len(got) == len(groups) + 3
