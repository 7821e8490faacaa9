"""Packing: pieces against the library, bounds and sequences against exact search."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipeweave.llm import bytetokens
from pipeweave.llm.packing import best_fit, cut, lower_bound, pack, sequences
from pipeweave.llm.storage import Scratch

PATH = bytetokens.vocabulary_path()


def fewest(lengths, size):
    """By exhaustive search, longest first."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for k in {r: k for k, r in enumerate(room) if r >= lengths[i]}.values():
            place(i + 1, [*room[:k], room[k] - lengths[i], *room[k + 1 :]])
        place(i + 1, [*room, size - lengths[i]])

    place(0, [])
    return best[0]


def test_bound_and_best_fit_on_small_cases():
    r = random.Random(2)
    tight = 0
    for _ in range(300):
        size = r.choice([10, 12, 30])
        lengths = [r.randint(1, size) for _ in range(r.randint(1, 9))]
        least, bound = fewest(lengths, size), lower_bound(np.bincount(lengths, minlength=size + 1), size)
        where, offset = best_fit(np.array(lengths), size)
        assert bound <= least <= where.max() + 1
        tight += bound == least
        rows = sorted(zip(where.tolist(), offset.tolist(), lengths))
        for (a, at, n), (b, then, _) in zip(rows, rows[1:]):
            assert then == (at + n if a == b else 0)
    assert tight > 250


def test_best_fit_takes_the_tightest():
    where, offset = best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert where.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 8]


TEXTS = [None, "", "one", "a b c " * 50, "<|endoftext|>x", "日本語 😀" * 20, "word " * 3000, "same", "same"]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces(spark, size):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, Piece string")
    got = cut(docs, PATH, size=size)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids"]
    by_id = {}
    for r in got.withColumn("crc", F.crc32("ids")).collect():
        by_id.setdefault(r.doc_id or 0, []).append(r)
    for i, t in enumerate(TEXTS):
        want = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        rows = sorted(by_id[i], key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and len(rows) == -(-len(want) // size)
        assert [r.start for r in rows] == np.cumsum([0, *[r.length for r in rows]])[:-1].tolist()
        assert all(r.length == size for r in rows[1:])
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows]).tolist() == want
        assert all(r.crc == zlib.crc32(bytes(r.ids)) for r in rows)


@pytest.mark.parametrize("kind", ["even", "thirds", "big", "one"])
def test_all_pieces_once_and_near_the_bound(spark, kind):
    r, size = random.Random(kind), 60
    pick = {"even": lambda: r.randint(1, size), "thirds": lambda: r.choice([20, 21, 19, 40, 41, 1]), "big": lambda: r.randint(31, 60), "one": lambda: 7}[kind]
    lengths = [pick() for _ in range(900)]
    rows = spark.createDataFrame([(None if i % 7 == 0 else i, n, "x") for i, n in enumerate(lengths)], "doc_id long, length long, offset string")
    got = pack(rows, Scratch(spark, "test"), size=size, per_part=100)
    assert got.columns == ["doc_id", "length", "sequence_id", "offset"]
    found = got.collect()
    assert sorted((x.doc_id or -1, x.length) for x in found) == sorted((i if i % 7 else -1, n) for i, n in enumerate(lengths))
    by = {}
    for x in found:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == np.cumsum([0, *[n for _, n in x]])[:-1].tolist() and sum(n for _, n in x) <= size
    bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
    whole = best_fit(np.array(lengths), size)[0].max() + 1  # all in one partition
    assert bound <= len(by) <= 1.01 * whole + 1


def test_empty_and_whole(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(cut(docs, PATH), Scratch(spark, "test")).count() == 0
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    packed = pack(cut(docs, PATH, size=64), Scratch(spark, "test"), size=64)
    whole = sequences(packed).collect()
    assert sum(r.length for r in whole) == sum(len(r.ids) // 4 for r in whole) == packed.agg(F.sum("length")).first()[0]
    assert len(whole) == packed.select("sequence_id").distinct().count()


def test_words_that_come_again_are_not_encoded_again(monkeypatch):
    """op13: a full store of words gives its words to the next one; what was kept is not lost at once."""
    model, seen = bytetokens.ByteTokens(PATH, plain=False), []
    encode = model._word
    monkeypatch.setattr(bytetokens, "_KEPT", 3)
    monkeypatch.setattr(model, "_word", lambda w: seen.append(w) or encode(w))
    texts = ["one two three four", "one two five", "one two six\t\u00e9 " + "x" * 70, "one two"]
    got = [x.tolist() for x in model.encode(texts)]
    assert got == [model.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert seen.count(" two") == seen.count("one") == 1
