"""The pipeline against a brute-force version of its five stages."""

import collections
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pipeweave.llm import mixing, quality

from .test_llm import ODD, groups, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def alnum(c):
    return unicodedata.category(c)[0] in "LN"


def features(t):
    w = WORD.findall(t or "")
    often = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {p + j for p in range(len(w) - 2) if often[w[p], w[p + 1], w[p + 2]] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((t or "").count(c) for c in quality.SYMBOLS), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_capitals": sum(unicodedata.category(c) == "Lu" for c in t or ""), "n_alnum": sum(map(alnum, t or "")), "n_bare_words": sum(not any(map(alnum, x)) for x in w)}


def vote(rule, f):
    holds = lambda sql: eval(re.sub(r"(\w+) BETWEEN (.+?) AND (.+)$", r"(\2) <= \1 <= (\3)", sql).replace(" OR ", " or ").replace(" AND ", " and "), {}, f)
    return 0 if holds(rule.bad) else 2 if holds(rule.good) else 1


def kept_by_quality(texts):
    f = [features(t) for t in texts]
    cast = [tuple(vote(r, x) for r in quality.RULES) for x in f]
    n, count = len(quality.RULES), collections.Counter(cast)
    good, rate = 0.8, [[[0.30, 0.20, 0.50]] * n, [[0.02, 0.08, 0.90]] * n]

    def p(v):
        one, zero = (math.prod(rate[c][r][v[r]] for r in range(n)) * (good if c else 1 - good) for c in (1, 0))
        return one / (one + zero)

    for _ in range(40):
        g = {v: p(v) for v in count}
        sums = [sum(m * (1 - g[v]) for v, m in count.items()), sum(m * g[v] for v, m in count.items())]
        rate = [[[(sum(m * (g[v] if c else 1 - g[v]) for v, m in count.items() if v[r] == x) + 1) / (sums[c] + 3) for x in range(3)] for r in range(n)] for c in (0, 1)]
        good = (sums[1] + 1) / (sum(sums) + 2)
    return [x["n_words"] >= 50 and 100 * x["n_repeat_words"] <= 50 * x["n_words"] and p(v) >= 0.5 for x, v in zip(f, cast, strict=True)]


@pytest.fixture
def texts():
    r = random.Random(4)
    words = [f"wort{i}" for i in range(700)]
    out = [" ".join(r.choices(words, k=r.randint(20, 260))) for _ in range(80)]
    for t in out[:30]:
        w = t.split()
        w[r.randrange(len(w))] = "other"
        out.append(" ".join(w))
    passage = " ".join(r.choices(words, k=65))
    out += [f"{' '.join(r.choices(words, k=90))}\n{passage}\n{' '.join(r.choices(words, k=80))}" for _ in range(6)]
    out += [" ".join(w + "#$" for w in t.split()) for t in out[:8]] + ["spam and more spam " * 40] * 3
    return out + ODD


def test_pipeline(spark, tmp_path, texts):
    pytest.importorskip("public_tokenizers")
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [i for i, ok in enumerate(kept_by_quality(texts)) if ok]
    sets = {i: shingles(texts[i], 5) for i in left}
    root = groups(len(texts), [(i, j) for i in left for j in left if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    left = [i for i in left if root[i] == i]
    assert 40 < len(left) < len(texts) - 30
    words, first, want = {i: WORD.findall(texts[i]) for i in left}, {}, {}
    for i in left:
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p : p + 50]), i)
    for i in left:
        gone = [False] * len(words[i])
        for p in range(len(words[i]) - 49):
            if first[tuple(words[i][p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        want[i] = [w for w, g in zip(words[i], gone, strict=True) if not g]
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.vocabulary_path())
    assert sorted(r.doc_id for r in got) == left
    assert any(len(want[i]) < len(words[i]) for i in left)
    for r in got:
        assert WORD.findall(lib.decode(r.pieces)) == want[r.doc_id] and r.round_trip and r.n_pieces == len(r.pieces)

    # The mixing stage writes its rows in the order of the mix.
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ordered = [r.doc_id for r in corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()]
    placed = mixing.mix_sources(docs, corpus_pipeline.Scratch(spark, "t")).orderBy("mix_place").select("doc_id")
    assert ordered == [r.doc_id for r in placed.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where(F.lit(False)), str(tmp_path))
        assert out.count() == 0 and (name == "pieces" or out.columns == docs.columns)


def test_the_mix_outlives_the_reread(spark, tmp_path, monkeypatch):
    """The places that run() returns are those of the mix, over many files of uneven sizes."""
    pytest.importorskip("public_tokenizers")
    r = random.Random(9)
    rows = [(i, "wort " * r.randint(1, 300), "en", f"s{min(i % 7, 2)}", 1) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    kept, keep = [], corpus_pipeline.Scratch.keep
    monkeypatch.setattr(corpus_pipeline.Scratch, "keep", lambda self, df, name: kept.append(out := keep(self, df, name)) or out)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "mix_place").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(kept[-1].inputFiles()) == 13
    assert sorted(x.mix_place for x in got) == list(range(900))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = mixing.mix_sources(docs, corpus_pipeline.Scratch(spark, "t")).orderBy("mix_place").select("doc_id")
    assert [x.doc_id for x in sorted(got, key=lambda x: x.mix_place)] == [x.doc_id for x in want.collect()]
    assert [x.doc_id for x in got] != [x.doc_id for x in sorted(got, key=lambda x: x.mix_place)]  # reading alone does not keep it


def test_stages_with_clashing_columns_and_null_ids(spark, tmp_path, texts):
    """Helper names of the operators as columns of the input, rows without an id, repeated rows."""
    names = "text_id spans _key _s _h _salt _tie _r _first n_words mix_place mix_slot block removed".split()
    rows = [(i if i != 3 else None, t, "en", f"s{i % 3}", len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate([*texts, texts[0]])]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs, own = spark.createDataFrame(rows, kinds), {r[1]: r for r in rows}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        if stage is not corpus_pipeline.quality_rules:
            assert sum(r.doc_id is None for r in got) == 1
        for r in got:
            if r.doc_id is not None and stage is not corpus_pipeline.substrings:
                assert all(r[n] in (f"{n}{r.doc_id}", f"{n}{len(texts)}") for n in names) and r.text in own
    kept = kept_by_quality([r[1] for r in rows])
    assert sorted(r.block for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()) == sorted(r[names.index("block") + 5] for r, k in zip(rows, kept, strict=True) if k)
