"""MinHash containment search against exact containment of every pair."""

import os
import random

import numpy as np
import pytest

from fumikura.llm import leaks
from fumikura.llm.letters import letters, rolling


def sets(texts):
    return [set(rolling(letters([t])[0], leaks.SHINGLE).tolist()) for t in texts]


def test_contained(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("山川空雪雨風花鳥月日會國のがをに") for _ in range(n))
    items = [(j, word(r.choice([7, 8, 40, 90, 300, 900]))) for j in range(14)] + [(90, None), (91, ""), (None, word(60))]
    items += [(93, items[3][1]), items[4]]

    def spoil(t, k):
        t = list(t)
        for p in sorted(r.sample(range(len(t)), min(k, len(t)))):
            t[p] = "変"
        return "".join(t)

    docs = [(j, word(50) + "".join(spoil(r.choice(items[:14])[1], r.choice([0, 0, 1, 4])) for _ in range(r.randrange(4))) + word(20)) for j in range(40)]
    docs += [(100, None), (101, ""), (None, items[0][1]), docs[0]]
    dd = spark.createDataFrame([(a, b, "q") for a, b in docs], "doc_id long, text string, item_id string")
    ii = spark.createDataFrame([(a, b, "q") for a, b in items], "item_id long, text string, doc_id string")
    want = set()
    for (d, t), x in zip(docs, sets([t for _, t in docs])):
        for (i, _), y in zip(items, sets([t for _, t in items])):
            if d is not None and i is not None and y and len(x & y) / len(y) >= 0.8:
                want.add((d, i, round(len(x & y) / len(y), 6)))
    for k, size in ((64, 10_000), (8, 100)):
        got = {tuple(x) for x in leaks.contained(dd, ii, k=k, block_letters=size).collect()}
        assert got <= want and len(got) >= 0.9 * len(want), k
    assert leaks.contained(dd, ii.limit(0)).count() == leaks.contained(dd.limit(0), ii).count() == 0


def test_recall_on_whole_tables(spark):
    """Every pair of sf0.01 that holds 80 percent of an item's shingles; at least 0.95 of them are found."""
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    ds = [tuple(x) for x in docs.where("text <> ''").select("doc_id", "text").collect()]
    its = [tuple(x) for x in items.where("text <> ''").select("item_id", "text").collect()]
    si = [np.array(sorted(x), np.uint64) for x in sets([t for _, t in its])]
    want = {(a, i) for (a, _), x in zip(ds, sets([t for _, t in ds])) for (i, _), y in zip(its, si) if len(y) and x and np.isin(y, np.array(sorted(x), np.uint64)).mean() >= 0.8}
    got = {(x["doc_id"], x["item_id"]) for x in leaks.contained(docs, items).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
