"""Cross-tokenizer alignment against a loop over tokens with both libraries."""

import collections
import hashlib
import random

import numpy as np
import pytest

from pipeweave.llm import alignment, bytetokens
from pipeweave.llm.alignment import align, align_corpus
from pipeweave.llm.pieces import vocabulary_path
from pipeweave.llm.storage import Scratch

A, B = bytetokens.vocabulary_path(), vocabulary_path()
TEXTS = [
    None, "", " ", " \t\n ", "one", "Hello  world", "it's 1234 o'clock", "ünï cödé — “x”", "日本語 のテキスト 😀👩‍👩‍👧", "x▁y", "▁", "a" * 4000, "<|endoftext|> and </s>", "no<s>w",
    "tab\tand\r\nlines\n\n\n  end ", "same text", "same text", "\x00\x1f\x85\xa0  ", "ab " * 500, "café naïve Größe",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), bytetokens.load(A, True).raw


def slow_groups(text, libraries):
    """Lists of ids of both sides, group by group."""
    a, b, raw_a = libraries
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    ends = lambda ids, raw: list(np.cumsum([len(raw(i)) for i in ids]))
    if b"".join(raw_a[i] for i in ids_a) != (" " + text).encode() or b"".join(map(raw_b, ids_b)) != (" " + text).encode():
        return []
    ends_a, ends_b = ends(ids_a, lambda i: raw_a[i]), ends(ids_b, raw_b)
    out, first = [], 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        out.append(([i for i, e in zip(ids_a, ends_a) if first < e <= cut], [i for i, e in zip(ids_b, ends_b) if first < e <= cut]))
        first = cut
    return out


def slow(texts, libraries):
    groups = [slow_groups(t, libraries) for t in texts]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = collections.Counter(p for x in links for p in x)
    best = collections.defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    rows = []
    for g, x in zip(groups, links):
        spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        n_best = sum(n for p, n in x.items() if held[p] == best[p[0]])
        sums = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(x.values()), n_best, sum(held[p] * n for p, n in x.items()))
        rows.append((*sums, hashlib.sha256(spelt.encode()).hexdigest() if g else ""))
    return rows, held


def corpus(n=60):
    r = random.Random(5)
    words = ["the", "The", "quick", "brownish", "Größe", "l'été", "foo_bar", "x1y2", "...", "--", "(a)", "1,234.5", "año", "émigré"] + [f"w{i}zz" for i in range(40)]
    blanks = [" ", " ", " ", "  ", "\n", "\t"]
    return TEXTS + ["".join(r.choice(words) + r.choice(blanks) for _ in range(r.randint(1, 120))) for _ in range(n)]


def counted(spark, texts, **more):
    rows = [(i if i != 3 else None, "x", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, n_a string, text string").repartition(3)
    docs, pairs = align_corpus(docs, A, B, Scratch(spark, "test"), **more)
    return docs, pairs


@pytest.mark.parametrize("block,many,step", [(1 << 24, 256, 1 << 22), (500, 256, 1 << 22), (500, 1, 50)])
def test_counts_equal_a_loop(spark, libraries, block, many, step):
    before = alignment._MANY, alignment._STEP
    texts = corpus()
    docs, pairs = counted(spark, texts, block=block)
    alignment._MANY, alignment._STEP = many, step  # workers fork later; the slice test below covers it in this process too
    try:
        got = sorted(tuple(r) for r in docs.select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
        want, held = slow(texts, libraries)
        assert got == sorted(want)
        assert {(r.a, r.b): r.total for r in pairs.collect()} == dict(held)
        assert docs.where("doc_id is null").count() == 1
    finally:
        alignment._MANY, alignment._STEP = before


@pytest.mark.parametrize("many,step", [(256, 1 << 22), (0, 1 << 22), (0, 7)])
def test_links_of_a_slice(libraries, monkeypatch, many, step):
    monkeypatch.setattr(alignment, "_MANY", many)
    monkeypatch.setattr(alignment, "_STEP", step)
    texts = corpus(20)
    doc, code, times = alignment.Slice(alignment.load(A, B), texts).links()
    got = [collections.Counter() for _ in texts]
    for d, c, n in zip(doc.tolist(), code.tolist(), times.tolist()):
        assert (c >> 20, c & (1 << 20) - 1) not in got[d]
        got[d][c >> 20, c & (1 << 20) - 1] = n
    assert got == [collections.Counter((x, y) for a, b in slow_groups(t, libraries) for x in a for y in b) for t in texts]


def test_groups_of_tokens(spark, libraries):
    docs = spark.createDataFrame(list(enumerate(corpus(10))), "doc_id long, text string")
    for r in align(docs, A, B).collect():
        n = max(r.group_a, default=-1) + 1
        got = [([x for x, k in zip(r.a, r.group_a) if k == i], [x for x, k in zip(r.b, r.group_b) if k == i]) for i in range(n)]
        assert got == slow_groups(corpus(10)[r.doc_id], libraries)


def test_nothing_there(spark):
    for texts in ([], [None], ["", None, "x▁y"]):
        docs, pairs = counted(spark, texts)
        assert [tuple(r)[1:] for r in docs.collect()] == [(0, 0, 0, 0, "", 0, 0)] * len(texts)
        assert pairs.count() == 0


def test_words_have_the_ids_of_the_library(libraries):
    r = random.Random(1)
    chars = [chr(c) for c in [*range(0x20, 0x250), 9, 10, 11, 12, 13]] + [" ", "'", "\n"] * 60
    odd = chars + [chr(c) for c in (0, 0x1C, 0x85, 0x300, 0x2028, 0x3000, 0x4E00, 0x1F600, 0xFEFF)]
    texts = ["".join(r.choices(chars, k=r.randint(1, 60))) for _ in range(3000)] + ["".join(r.choices(odd, k=30)) for _ in range(500)] + [t or "" for t in TEXTS]
    texts += ["<|endoftext|>", "a <|endoftext|>b", "we'll they've I'm 's's'S"]
    for plain in (True, False):
        model = bytetokens.load(A, plain)
        model.whole.encode_special_tokens = plain
        want = [e.ids for e in model.whole.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in model.encode(texts)] == want
