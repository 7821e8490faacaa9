"""The operators against brute force, round trips and edge cases."""

import collections
import hashlib
import html
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipeweave.llm import chat, lm, minhash, mixing, pieces, quality, substrings, urls, vectors
from pipeweave.llm.components import components
from pipeweave.llm.html import extract
from pipeweave.llm.storage import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "one", "one two", "ünï cödé  x", "a" * 5000, "x y " * 3000, "same text here now", "same text here now", "# * $ % & | < >" * 20, "日本語 のテキスト 😀"]


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def table(spark, texts, **more):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words double")  # a clashing name


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "the"]
    texts = [" ".join(r.choices(words, k=r.randint(1, 220))) for _ in range(n)]
    for _ in range(n // 2):
        t = r.choice(texts).split()
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t))
    passage = " ".join(r.choices(words, k=70))
    texts += [f"{r.choice(words)} {r.choice(texts)} {passage} {r.choice(texts)}" for _ in range(12)]
    return texts + ODD


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


# Components


def test_components(spark, scratch):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(60)] + [(5, 5)]
    got = {x.node: x.component_id for x in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    want = groups(301, links)
    assert got == {i: want[i] for a, b in links for i in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


# 1


@pytest.fixture(scope="module")
def model():
    try:
        return pieces.vocabulary_path()
    except ImportError:
        pytest.skip("needs the public tokenizers")


def test_pieces_as_the_library(spark, model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [*corpus(1), " " * 300, "aaaaaaaa" * 200, "a\u2581b", "tab\tnew\nline", "  lead", "trail  ", "=====-----====", "\x00"]
    got = pieces.encode(table(spark, texts), model).orderBy("doc_id").collect()
    assert [r.pieces for r in got] == [lib.encode(t or "") for t in texts]
    assert all(r.n_pieces == len(r.pieces) for r in got)
    back = pieces.decode(pieces.encode(table(spark, texts), model), model).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == [(t or "").replace("\u2581", " ") for t in texts]
    assert pieces.encode(table(spark, texts), model, check=True).where("NOT round_trip").count() == 0
    assert pieces.encode(table(spark, []).limit(0), model).count() == 0


def test_viterbi_against_brute_force():
    texts = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cab"]
    r = random.Random(5)
    scores = np.array([-r.random() * 5 - 0.1 for _ in texts])
    t = pieces.Pieces(texts, scores, np.array([False] + [True] * 10), np.full(256, -1, dtype=np.int32), 0)
    known = {x: s for x, s in zip(texts[1:], scores[1:], strict=True)}

    def best(w):
        top = [0.0] + [-1e9] * len(w)
        for i in range(1, len(w) + 1):
            for j in range(max(0, i - t.longest), i):
                top[i] = max(top[i], top[j] + known.get(w[j:i], -1e9))
        return top[-1]

    for _ in range(50):
        text = " ".join("".join(r.choices("abc", k=r.randint(1, 8))) for _ in range(3))
        ids, n = pieces.encode_texts([text], t, "viterbi")
        assert "".join(texts[i] for i in ids) == "▁" + text.replace(" ", "▁") and n.tolist() == [len(ids)]
        assert abs(scores[ids].sum() - sum(best("▁" + w) for w in text.split())) < 1e-9


def test_lattice_in_spark_against_brute_force(spark):
    r = random.Random(8)
    texts = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cab"]
    scores = np.array([0.0] + [-r.random() * 5 - 0.1 for _ in texts[1:]])
    t = pieces.Pieces(texts, scores, np.array([False] + [True] * 10), np.full(256, -1, dtype=np.int32), 0)
    words = ["▁" + "".join(r.choices("abc", k=r.randint(1, 9))) for _ in range(60)] + ["▁", "a", "xab", None, ""]
    rows = pieces.piece_rows(spark, t)
    got = {x.word: x.pieces for x in pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), rows, t.longest, t.unknown).collect()}
    assert set(got) == {w for w in words if w} and got["xab"][0] == 0
    for w, ids in got.items():
        if "x" not in w:
            want, _ = pieces.encode_texts([w.removeprefix("▁")], t, "viterbi") if w.startswith("▁") and len(w) > 1 else (ids, 0)
            assert list(want) == ids and "".join(texts[i] for i in ids) == w


# 2


@pytest.mark.parametrize("blocks, parts", [({"a": 50, "b": 30, "c": 7}, {"a": 5, "b": 3, "c": 1}), ({"a": 1, "b": 400}, {"a": 7, "b": 11}), ({"x": 9, "y": 9, "z": 9}, {"x": 1, "y": 1})])
def test_mixing_keeps_to_its_weights(blocks, parts):
    plan, taken = mixing.phases(blocks, parts), {}
    for s, rows in plan.items():
        for j in range(blocks[s]):
            b, start, q, slots = [x for x in rows if x[0] <= j][-1]
            slot = start + (j - b) // len(slots) * q + slots[(j - b) % len(slots)]
            assert slot not in taken
            taken[slot] = s
    assert sorted(taken) == list(range(sum(blocks.values())))  # every slot once, none empty
    left, start = dict(blocks), 0
    while left:  # in each phase every source has had its share to less than one block
        active = {s: parts.get(s, 0) for s in left if parts.get(s, 0)} or dict.fromkeys(left, 1)
        q, had, t = sum(active.values()), collections.Counter(), 0
        while all(had[s] < left[s] for s in active):
            had[taken[start + t]] += 1
            t += 1
            assert all(abs(had[s] - t * p / q) < 1 for s, p in active.items())
        start += t
        left = {s: n - had[s] for s, n in left.items() if n > had[s]}


def test_mixing_rows(spark, scratch):
    docs = table(spark, ["t"] * 300).unionByName(table(spark, ["t"] * 20))  # repeated rows
    got = mixing.mix_sources(docs, scratch, block_rows=4, salts=8)
    rows = got.collect()
    assert len(rows) == 320 and len({r.mix_place for r in rows}) == 320 and "n_words" in got.columns
    for s, n in collections.Counter(r.source for r in rows).items():
        assert collections.Counter(r.mix_block for r in rows if r.source == s) == {b: min(4, n - 4 * b) for b in range(-(-n // 4))}
    assert [r.mix_place for r in got.orderBy("mix_place").collect()] == sorted(r.mix_place for r in rows)
    assert mixing.mix_sources(docs.limit(0), scratch).count() == 0


# 3


def test_vectors_against_brute_force(spark, scratch):
    r = np.random.default_rng(11)
    base = r.standard_normal((40, 24))
    x = np.concatenate((base, base + 0.18 * r.standard_normal((40, 24)), base[:10], np.repeat(base[:1], 30, axis=0) + 0.05 * r.standard_normal((30, 24)))).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 40 % 3)) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, x[0].tolist(), None), (904, [None] * 24, 1), (905, [1.0, 2.0], 1), (906, [float("inf")] + [1.0] * 23, 1), (907, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash"))
    got = {g.vec_id: g for g in vectors.near_vectors(df, scratch, chunk=8).collect()}
    y = x.astype(float)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    label = np.array([c for *_, c in rows])
    near = (y @ y.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    want = groups(len(x), np.argwhere(near))
    assert len(got) == len(x) + 8
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == want and all(got[i].kept == (want[i] == i) for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, *_ in odd)
    assert vectors.near_vectors(df.limit(0), scratch).count() == 0


def test_vectors_of_repeated_ids(spark, scratch):
    r = np.random.default_rng(2)
    u, v = r.standard_normal((2, 24))
    rows = [(5, u.tolist(), 1), (5, v.tolist(), 1), (7, (u * 2 + 0.01).tolist(), 1), (3, v.tolist(), 1), (3, v.tolist(), 1), (9, (-u).tolist(), 1), (None, u.tolist(), 1)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), scratch).collect()}
    assert got == {5: (1, 3, False), 7: (1, 3, False), 3: (1, 3, True), 9: (0, 9, True)}


# 4


@pytest.mark.parametrize("k, leaders", [(2, 4), (5, 4), (2, 1)])
def test_near_duplicates_against_brute_force(spark, scratch, monkeypatch, k, leaders):
    monkeypatch.setattr(minhash, "LEADERS", leaders)
    texts = corpus(k)
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    want = groups(len(texts), links)
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, texts), scratch, k=k).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want and all(got[i].kept == (want[i] == i) for i in got)
    assert minhash.near_duplicates(table(spark, []).limit(0), scratch, k=k).count() == 0


def test_near_duplicates_of_repeated_ids(spark, scratch):
    r = random.Random(4)
    a, b = ([f"{x}{r.randrange(500)}" for _ in range(100)] for x in "ab")
    near = lambda t, i: " ".join([*t[:50], f"n{i}", *t[51:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 1)), (3, near(b, 2)), (3, near(b, 2)), (1, " ".join(a).upper()), (None, " ".join(a)), (4, "else"), (4, None)]
    got = {x.doc_id: (x.component_id, x.kept) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch, k=2).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True)}


def test_near_duplicates_that_share_a_passage(spark, scratch):
    """Large buckets of sets that are all a little alike: no link is lost, none is made up."""
    r = random.Random(6)
    passage = [f"p{i}" for i in range(70)]
    texts = []
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(r.choice([6, 12, 25]))]
        texts.append(" ".join(own + passage))
        if i % 5 == 0:
            texts.append(" ".join([*own[:-1], "new", *passage]))
    sets = [shingles(t, 2) for t in texts]
    want = groups(len(texts), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= 80 * len(a | b)])
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(table(spark, texts), scratch, k=2).collect()}
    assert [got[i] for i in range(len(texts))] == want


# 5


def test_scoring_against_brute_force(spark, scratch):
    texts = ["abab abba", "abc abc", None, "", "zz top", "ab"]
    docs = table(spark, texts)
    held = lm.train(docs, spark.createDataFrame([(0,), (5,)], "doc_id long"), scratch)
    got = {r.doc_id: r for r in lm.score(docs, held).collect()}

    def losses(some):
        three = collections.Counter()
        for t in some:
            b = b"\0\0" + (t or "").encode()
            three.update(b[i : i + 3] for i in range(len(b) - 2))
        two, one = collections.Counter(), collections.Counter()
        for g, n in three.items():
            two[g[1:]] += n
            one[g[2:]] += n
        total = sum(one.values())

        def p(g):
            p1 = (one[g[2:]] + 1) / (total + 256)
            seen, kinds = sum(n for x, n in two.items() if x[:1] == g[1:2]), sum(x[:1] == g[1:2] for x in two)
            p2 = (two[g[1:]] + kinds * p1) / (seen + kinds) if seen else p1
            seen, kinds = sum(n for x, n in three.items() if x[:2] == g[:2]), sum(x[:2] == g[:2] for x in three)
            return (three[g] + kinds * p2) / (seen + kinds) if seen else p2

        return lambda t: -sum(np.log(p((b"\0\0" + t.encode())[i : i + 3])) for i in range(len(t))) / len(t)

    target, whole = losses([texts[0], texts[5]]), losses(texts)
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(t or "")
        if t:
            assert abs(got[i].loss_target - target(t)) < 1e-5 and abs(got[i].loss_corpus - whole(t)) < 1e-5
            assert abs(got[i].loss_difference - (got[i].loss_target - got[i].loss_corpus)) < 1e-12
        else:
            assert got[i].loss_target is None and got[i].loss_difference is None
    assert lm.score(docs.limit(0), lm.train(docs.limit(0), spark.createDataFrame([], "doc_id long"), scratch)).count() == 0


def test_scoring_tells_kinds_apart(spark, scratch):
    r = random.Random(1)
    good = [" ".join(r.choices("water pipe heat network building supply".split(), k=40)) for _ in range(60)]
    bad = [" ".join(r.choices("zxq qzx vvk kkv jqj".split(), k=40)) for _ in range(60)]
    docs = table(spark, good + bad)
    held = lm.train(docs, spark.createDataFrame([(i,) for i in range(30)], "doc_id long"), scratch)
    got = {x.doc_id: x.loss_difference for x in lm.score(docs, held).collect()}
    assert max(got[i] for i in range(30, 60)) < min(got[i] for i in range(60, 120))  # held out


# 6


def test_urls(spark, scratch):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    cases = [
        ("http://WWW.Example.COM/en/1?x", "www.example.com", "/en/1", "com/en/", "block"), ("https://example.com/en/71", "example.com", "/en/71", "example.com/en/7", "allow"),
        ("https://a.example.com/en/7#f", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("https://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("https://example.net/de/80", "example.net", "/de/80", "example.net/de/8", "block"), ("http://x.org/es", "x.org", "/es", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("no scheme/com/en/", "", "", None, "allow"), ("http://bad.io/p/", "bad.io", "/p", None, "block"), ("http://www.BAD.io/p?q", "www.bad.io", "/p", None, "block"), ("http://bad.io/P", "bad.io", "/P", None, "allow"),
        ("http://h?u=a://b/c", "h", "", None, "allow"), ("x" * 50000 + "://long.io/" + "y" * 50000, "long.io", "/" + "y" * 50000, None, "allow"), ("://e/f", "e", "/f", None, "allow"),
    ]
    cases = [(u, h, p + "/" if u == "http://bad.io/p/" else p, r, v) for u, h, p, r, v in cases]
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("https://bad.io/p",), ("https://bad.io/p/",), (None,), ("nothing",)], "url string")
    for blocks in (1, 1 << 16):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, listed, rules, scratch, most_blocks=blocks).collect()}
        assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert urls.judge_urls(pages, listed.limit(0), [], scratch).where("verdict = 'block'").count() == 0
    assert urls.judge_urls(pages.limit(0), listed, rules, scratch).count() == 0


def test_bloom_has_no_false_negatives(spark, scratch):
    pages = spark.range(5000).selectExpr("id AS page_id", "concat('http://h', id % 77, '.io/p/', id) AS url")
    got = urls.judge_urls(pages, pages.where("page_id % 3 = 0").select("url"), [], scratch, most_blocks=8)
    assert got.where("(verdict = 'block') <> (page_id % 3 = 0)").count() == 0 and got.count() == 5000


# 7


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "a\\b\\\\", "<|turn|>user<|says|>x<|end|>", "\\<|end|>", "", None, "<s>\n[INST]", "ü😀" * 50, "<|", "\\"]
    rows = [(i % 4, 9 - i, "assistant" if i % 2 else "us<|er", t) for i, t in enumerate(hard)] + [(5, 0, None, "x"), (5, 0, None, "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    chats = chat.format_chat(df)
    got = {r.conv_id: r for r in chats.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    digests = {r.conv_id: r for r in chat.digests(chats).collect()}
    for c in (0, 1, 2, 3, 5, None):
        mine = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert [(t.role, t.text) for t in got[c].t] == [m[1:] for m in mine]
        loss = "".join(m[2] for m in mine if m[1] == "assistant")
        assert got[c].l == loss and digests[c].loss_chars == len(loss) and digests[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
        assert got[c].formatted.count(chat.TURN) == len(mine) and digests[c].formatted_chars == len(got[c].formatted)
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_parts(spark):
    part = lambda k, text=None, ref=None, amount=None: (k, text, ref, amount)
    rows = [(1, 0, "user", [part("text", "see <|image|>"), part("image", ref="a.png", amount=784 * 10.0), part("audio", ref="b.wav", amount=1.5), part("odd", ref="c")]), (1, 1, "assistant", [part("document", ref="d.pdf", amount=2.0), part("text", None)]), (1, 2, "user", None)]
    got = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")).first()
    assert got.formatted == "<|turn|>user<|says|>see <\\|image|><|image|><|audio|><|file|><|end|><|turn|>assistant<|says|><|document|><|end|><|turn|>user<|says|><|end|>"
    assert [(a.place, a.type, a.ref, a.tokens) for a in got.attachments] == [(0, "image", "a.png", 10), (1, "audio", "b.wav", 38), (2, "odd", "c", 0), (3, "document", "d.pdf", 1024)]
    assert [got.formatted[s.start : s.start + s.length] for s in got.loss_spans] == ["<|document|>"]
    odd = [(1, 0, "assistant", [part(None, ref="x", amount=3.0), None, part("text", "t"), part("image", ref="y")])]
    got = chat.format_chat(spark.createDataFrame(odd, f"conv_id long, turn long, role string, parts {chat.PARTS}")).first()
    assert got.formatted == "<|turn|>assistant<|says|><|file|><|file|>t<|image|><|end|>"
    assert [(a.place, a.type, a.ref, a.tokens) for a in got.attachments] == [(0, None, "x", 0), (1, None, None, 0), (2, "image", "y", 0)]


# 8


@pytest.mark.parametrize("length, seed, ids", [(50, 12, 10**6), (8, 3, 0), (5, 5, 10**6), (3, 1, 0)])
def test_substrings_against_brute_force(spark, scratch, monkeypatch, length, seed, ids):
    monkeypatch.setattr(substrings, "BROADCAST_IDS", ids)
    texts = corpus(length)
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), i)
    got = {r.doc_id: r for r in substrings.substring_dedup(table(spark, texts), scratch, length, seed, digest=True).collect()}
    plain = {r.doc_id: r for r in substrings.substring_dedup(table(spark, texts), scratch, length, seed).collect()}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert (got[i].n_words, got[i].n_removed) == (len(w), sum(gone))
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert WORD.findall(plain[i].text or "") == kept and (sum(gone) or plain[i].text == texts[i])
    assert substrings.substring_dedup(table(spark, []).limit(0), scratch).count() == 0


# 9


def text_of(spark, *pages):
    df = spark.createDataFrame([(i, h, "clash") for i, h in enumerate(pages)], "page_id long, html string, text string")
    return [r.text for r in extract(df).orderBy("page_id").collect()]


def test_extraction(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> -->'
        '<div class="ad">Buy</div><div id="cookie-notice"><p>We use cookies</p></div><article><header><h1>Head&amp;line</h1><p>by line</p></header><p><b>First\n one.<br>two<p>In<i>line</i> caf&eacute; &lt;tag&gt;</p>'
        "<form><input value='x'><p>Name</p></form><aside>Side</aside><ul><li>item one<li>item <a href=x>two</a></ul><div class='share'>Share</div><p>Of.</p><section class=\"comments\"><article><p>Nice!</p></article></section></article>"
        "<div class=sidebar><p>More</p></div><footer>&copy; me</footer>"
    )
    assert text_of(spark, page, None, "", "<p", "plain words only")[0] == "Head&line First one. two Inline café <tag> item one item two Of."
    assert text_of(spark, "<nav><p>menu<article><p>Body text</p></article>") == ["Body text"]  # a menu left open
    assert text_of(spark, "<article><p>" + "long word " * 30000 + "</p></article>")[0].count("long") == 30000


def test_extraction_without_article(spark):
    good = "The house that was in the middle of the town is not for the people who have been there with all of their things and he was one of them as you will see it."
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><p>{good}</p><p>Short one.</p><p>{good}</p><p>Short two.</p><div><a href=3>Three links here</a></div><p>Tail.</p>"
    assert text_of(spark, page) == [f"{good} Short one. {good}"]


def test_extraction_keeps_all_of_an_article(spark):
    links = "".join(f"<li><a href=/{i}>Source {i}</a></li>" for i in range(3))
    pages = {
        "<article><h1><a href=x>Linked headline</a></h1><p>Body.</p></article>": "Linked headline Body.",
        '<article><p>One.</p><section id="related-work"><p>Two.</p></section></article>': "One. Two.",
        '<article><p class="ad-hoc">One.</p><p class="ad">Buy.</p><div class="ad-box-2">Buy.</div></article>': "One.",
        f"<article><p>Body.</p><ul>{links}</ul></article>": "Body. Source 0 Source 1 Source 2",
        f"<article><p>Body.</p><div class=related><ul>{links}</ul></div></article>": "Body.",
        "<article><div class=page-header><h1>Head</h1><p>by line</p></div><p>Body.</p></article>": "Head Body.",
        "<form><article><p>A page in a form.</p><form>Name</form></article></form>": "A page in a form.",
        "<aside><article><p>Teaser.</p></article></aside><article><p>Body.</p></article>": "Body.",
        "<article><b><p>One</b> two</p>three</article><p>after</p>": "One two three",
        '<article><p>One <span class="share">Share</span> two.</p><div role="navigation">x</div></article>': "One two.",
    }
    assert text_of(spark, *pages) == list(pages.values())


@pytest.mark.parametrize("name", "reader-comments user-comments comment-thread comments-area ad-300x250 google-ad div-gpt-ad-1468-0 adsbygoogle article-footer post-footer site-nav cookie-law cookieNotice sponsored-content".split())
def test_extraction_names_of_boilerplate(spark, name):
    body = "The house that was in the middle of the town is not for the people who have been there with all of their things and he was one of them as you will see it."
    pages = [f'<article><p>Body.</p><div class="{name}"><p>Other.</p></div></article>', f'<p>{body}</p><div class="x {name}"><p>{body[::-1]}</p></div>']
    assert text_of(spark, *pages) == ["Body.", body]


@pytest.mark.parametrize("name", "ad-hoc related-work has-sidebar no-comments page-with-sidebar layout-sidebar-right table-header market-share comment-on-the-law elementor-widget food-menu".split())
def test_extraction_names_of_prose(spark, name):
    assert text_of(spark, f'<article><p>Body.</p><div class="{name}"><p>More.</p></div></article>', f'<article><h2 id="public-comments">Head</h2><section id="public-comments">More.</section><pre class="x"><span class="hljs-comment"># note</span></pre></article>') == [
        "Body. More.", "Head More. # note"
    ]


def test_extraction_forms_headers_and_teasers(spark):
    good = "The house that was in the middle of the town is not for the people who have been there with all of their things and he was one of them as you will see it."
    pages = {
        f"<form action=x><div><p>{good}</p><p>Short one.</p><p>{good}</p></div><input></form><div>Tail</div>": f"{good} Short one. {good}",
        f"<p>{good}</p><form><p>{good[::-1]}</p></form>": good,
        f"<form><nav>Menu</nav><main><p>{good}</p></main><p>{good[::-1]}</p></form>": good,
        "<div class=header><article><p>Body.</p></article></div>": "Body.",
        '<article><p>Body.</p></article><div class="side-box"><article><p>Other.</p></article></div>': "Body.",
        '<div><article class="teaser"><p>Other.</p></article></div><article><p>Body.</p></article>': "Body.",
        '<article class="teaser"><p>One.</p></article><article class="post-teaser"><p>Two.</p></article>': "One. Two.",
        "<article><p>Body.</p><form><p>Name</p></form></article>": "Body.",
    }
    assert text_of(spark, *pages) == list(pages.values())


def test_extraction_takes_linear_time(spark):
    import time

    from pipeweave.llm.html import blocks_of

    n = 100_000
    for page in ("<font>" * n, "<div>" * n + "</span>" * n, "<span>" + "<font>" * n + "</i>" * n, "<li><div>" * n + "</p>" * n, "<p>a" * n, "<a href=x>" * n, "<table><tr><td>" * n + "</li>" * n):
        began = time.process_time()
        for _ in blocks_of("<article>" + page + "</article>"):
            pass
        assert time.process_time() - began < 1e-5 * page.count("<")  # a second for 100 000 tags
    many = "<p>short</p>" * 20_000
    assert text_of(spark, f"<div><p>{'the house of the man is in it as you ' * 5}</p>{many}</div>")[0].count("short") == 0


def test_block_rules_against_brute_force(spark):
    r = random.Random(9)
    stops, rare = "the of and is in to".split(), [f"w{i}" for i in range(50)]
    pages, want = [], []
    for _ in range(60):
        blocks = []
        for _ in range(r.randint(1, 9)):
            share, n = r.choice([0.1, 0.6]), r.choice([3, 8, 12, 25, 40])
            words = [r.choice(stops if r.random() < share else rare) for _ in range(n)]
            blocks.append((words, r.choice([0, 0, 0, n // 2, n])))
        pages.append("".join(f"<div><a href=x>{' '.join(w[:k])}</a> {' '.join(w[k:])}</div>" if k else f"<div>{' '.join(w)}</div>" for w, k in blocks))

        def first(w, k, rule):
            text, linked = " ".join(w), len(" ".join(w[:k]))
            size = max(len(w), len(text) // 6)
            if 3 * linked > len(text):
                return "b"
            if rule == "dense":
                if size < 10:
                    return "b" if linked else "s"
                if 100 * sum(x in stops for x in w) >= 30 * len(w):
                    return "g" if size >= 30 else "n"
                return "n" if size >= 20 else "s"
            return "g" if rule == "any" or size >= 10 else "s"

        for rule in ("dense", "long", "any"):
            labels = [first(w, k, rule) for w, k in blocks]
            if "g" in labels:
                break
        kept = []
        for i, x in enumerate(labels):
            sides = [next((y for y in side if y in "gb"), "b") == "g" for side in (labels[i::-1], labels[i:])]
            if x == "g" or (x == "s" and all(sides)) or (x == "n" and any(sides)):
                kept.append(" ".join(blocks[i][0]))
        want.append(" ".join(kept))
    assert text_of(spark, *pages) == want


def test_extraction_in_other_languages(spark):
    long = "Дом который стоял в середине города был не для тех людей которые жили там раньше."
    assert text_of(spark, f"<p>{long}</p><p>Коротко.</p><p>{long}</p><div><a href=1>Ещё</a></div>", "<p>日本語のテキストです。</p>" * 20, "<p>Body</p>", f"<main><p>Short body.</p></main><p>{long}</p>") == [
        f"{long} Коротко. {long}", " ".join(["日本語のテキストです。"] * 20), "Body", "Short body.",
    ]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_extraction_of_the_table(spark):
    for r in extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("raw", F.col("html"))).collect():
        body = re.search(r"<article>(.*)</article>", r.raw, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", body).replace("<b>", "")).split()) and r.n_chars == len(r.text)


# 10


@pytest.mark.parametrize("bits", [24, 3])
def test_features_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(quality, "PLACE_BITS", bits)
    texts = [*corpus(10), "a b c a b c", "a a a a", "a a a", "x\nx\n\nx\n y", "# $\n# $"]
    got = {r.doc_id: r for r in quality.features(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        often = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {p + j for p in range(len(w) - 2) if often[w[p], w[p + 1], w[p + 2]] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i][f] for f in quality.FEATURES) == want
        assert got[i].base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_quality_tells_junk_from_prose(spark, scratch):
    r = random.Random(2)
    prose = [" ".join(r.choices([f"word{i}" for i in range(900)], k=120)) for _ in range(200)]
    junk = [" ".join(w + "#$%"[: 1 + i % 3] for w in t.split()) for i, t in enumerate(prose[:20])] + ["buy this thing now " * 40] * 10
    got = {x.doc_id: x.kept for x in quality.judge(table(spark, prose + junk), scratch).collect()}
    assert all(got[i] for i in range(200)) and not any(got[i] for i in range(200, 230))
    assert quality.judge(table(spark, []).limit(0), scratch).count() == 0


def test_sets_that_hang_together_over_many_links_are_one_group(spark):
    """op4: a chain of links is one group before sets are paired, or a group of near copies would be paired with itself."""
    from pipeweave.llm import minhash
    from pipeweave.llm.storage import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21)], "a long, b long")
    got = {r.sid: r.c for r in minhash._hanging(links, Scratch(spark, "hanging")).collect()}
    assert got == {**dict.fromkeys(range(1, 13), 1), 20: 20, 21: 20}
