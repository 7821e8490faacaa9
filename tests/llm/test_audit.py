"""The filter audit against applying every order to every document."""

import collections
import itertools
import random

from pyspark.sql import functions as F

from pipeweave.llm.audit import audit, survivors
from pipeweave.llm.storage import Scratch


def rows_of(seed, n=80):
    r = random.Random(seed)
    texts = ["", None, "AB", "ab#", "A#", "abcdef", "x" * 3000, "same", "same"] + ["".join(r.choices("aB# c", k=r.randint(1, 8))) for _ in range(n)]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(n)]
    docs += [(None, "same", "en"), (None, "same", "en"), *r.sample(docs, 5), (3, "same", "de"), (0, None, None)]
    labels = [(r.choice([*range(n), None]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(n)]
    return docs, labels


def slow(docs, labels, names="ABC"):
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    ids = collections.defaultdict(list)
    for d, t, _ in docs:
        if d is not None:
            ids[t or ""].append(d)
    failed = []
    for d, t, lang in docs:
        t = t or ""
        copy = d is not None and min(ids[t]) < d
        failed.append((d, lang or "", {n for n, x in zip(names, ("#" in t, len(t) < 3, copy)) if x}))
    out, per_step = {}, collections.Counter()
    for part in {p for _, p, _ in failed}:
        own = [(d, f) for d, p, f in failed if p == part]
        for order in itertools.permutations(names):
            left = own
            for step, x in enumerate(order, 1):
                gone, stay = [y for y in left if x in y[1]], [y for y in left if x not in y[1]]
                redundant = sum(x in f for _, f in own) - len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), redundant, sum(f == {x} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                per_step[part, x] += len(gone)
                left = stay
    return sorted((*k, *v, per_step[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def conditions():
    return {"A": F.col("_text").contains("#"), "B": F.length("_text") < 3}


FLAGS = {"good": "quality = 1", "toxic": "toxic = 1"}


def run(spark, docs, labels):
    docs = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, mask string, n int")  # clashing names
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return audit(docs, labels, conditions(), FLAGS, Scratch(spark, "test"), copies="C")


def test_every_order(spark):
    for seed in (1, 2):
        docs, labels = rows_of(seed)
        got = run(spark, docs, labels)
        assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert sorted(map(tuple, got.collect())) == slow(docs, labels)


def test_without_copies_or_rows(spark):
    docs, labels = rows_of(3)
    assert run(spark, [], []).count() == 0
    one = run(spark, [(1, None, None)], [])
    assert sorted(map(tuple, one.collect())) == slow([(1, None, None)], [])
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = audit(docs, labels, conditions(), FLAGS, Scratch(spark, "test"))
    assert plain.count() == 2 * 2 * docs.select(F.coalesce("lang", F.lit(""))).distinct().count()


def test_survivors_of_all_sets(spark):
    r = random.Random(4)
    counts = {m: r.randint(0, 9) for m in r.sample(range(64), 40)}
    rows = spark.createDataFrame([("p", m, n) for m, n in counts.items()], "part string, mask int, n long")
    (row,) = survivors(rows, 6).collect()
    assert row.n == [sum(n for m, n in counts.items() if not m & s) for s in range(64)]
