"""Word bigram scores against brute force."""

import collections
import math
import random

import pytest

from pipeweave.llm import queries, wordlm
from pipeweave.llm.storage import Scratch


@pytest.fixture
def docs(spark):
    r = random.Random(6)
    words = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(5000)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(300)] + ["a a a", "", None, " \n", "é ü", "a"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "b c"), (7, "again the same id")]


def losses(texts, words):
    one, two = collections.Counter(), collections.Counter()
    for t in texts:
        w = (t or "").split()
        if w:
            one.update([*w, None])
            two.update(zip([None, *w], [*w, None], strict=True))
    total = sum(one.values())
    p = lambda v, w: (two[v, w] + wordlm.MU * (one[w] + 1) / (total + words)) / (one[v] + wordlm.MU)
    return lambda w: -sum(math.log(p(v, x)) for v, x in zip([None, *w], [*w, None], strict=True)) / (len(w) + 1)


@pytest.mark.parametrize("few", [True, False])
def test_word_scores_against_brute_force(spark, docs, monkeypatch, few):
    monkeypatch.setattr(wordlm, "BLOCK_ROWS", 40)
    monkeypatch.setattr(wordlm, "BROADCAST_ROWS", 10**6 if few else 0)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    target = set(range(0, 90, 3)) | {7}
    got = wordlm.score_words(table, spark.createDataFrame([(i,) for i in target], "doc_id long"), Scratch(spark, "t5")).collect()
    words = len({w for _, t in docs for w in (t or "").split()}) + 1
    mine, whole = losses([t for i, t in docs if i in target], words), losses([t for _, t in docs], words)
    want = [(i, len((t or "").split()), *((mine((t or "").split()), whole((t or "").split())) if (t or "").split() else (None, None))) for i, t in docs]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2]
        assert (g[2:] == (None,) * 3) if w[2] is None else g[2:] == pytest.approx((w[2], w[3], w[2] - w[3]), abs=1e-9)


def test_no_words_and_no_targets(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert wordlm.score_words(spark.createDataFrame([], "doc_id long, text string"), none, Scratch(spark, "t5")).count() == 0
    got = wordlm.score_words(spark.createDataFrame([(1, "a b"), (2, " ")], "doc_id long, text string"), none, Scratch(spark, "t5")).orderBy("doc_id").collect()
    assert got[0].loss_target == pytest.approx(math.log(3)) and got[1].loss_target is None


def test_scores_keep_clashing_columns(spark, tmp_path):
    rows = [(1, "a b", 5, True, "m", 7.0), (2, "a c", 6, False, None, 8.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _block int, _target boolean, _metadata string, loss_target double")
    df.write.parquet(str(tmp_path / "x"))
    for table in (df, spark.read.parquet(str(tmp_path / "x"))):
        got = wordlm.score_words(table, spark.createDataFrame([(1,)], "doc_id long"), Scratch(spark, "t5"))
        assert got.columns == ["doc_id", "_block", "_target", "_metadata", *wordlm.NEW]
        assert [(r.doc_id, r._block, r._target, r._metadata, r.n_tokens) for r in got.orderBy("doc_id").collect()] == [(1, 5, True, "m", 2), (2, 6, False, None, 2)]


def test_phrasing_is_told_apart(spark, tmp_path):
    """Texts of the same words, and so nearly the same letters, in another order."""
    r = random.Random(2)
    words = [f"xx{a}{b}xx" for a in "abcdefgh" for b in "abcdefgh"]
    after = dict(zip(words, r.sample(words, 64), strict=True))

    def text(follow):
        w = [r.choice(words)]
        while len(w) < 80:
            w.append(after[w[-1]] if follow and r.random() < 0.9 else r.choice(words))
        return " ".join(w)

    spark.createDataFrame([(i, text(i % 2 == 0)) for i in range(200)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {x.doc_id: x.loss_difference for x in queries.op5_lm_scoring(spark, str(tmp_path)).collect()}
    assert max(got[i] for i in range(100, 200, 2)) < min(got[i] for i in range(101, 200, 2))
