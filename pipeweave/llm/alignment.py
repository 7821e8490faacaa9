"""Operator 11: alignment of two tokenizers by the bytes of their tokens.

Both encodings of a text are the same bytes, so tokens are aligned by where they end: cumulative sums of token sizes
are the ends, their intersection the common cuts, a search among the cuts gives each token its group, and repeats of both sides
spell out all pairs of a group. All documents of a slice go through this together, in NumPy.

Corpus counts: a block is a bounded run of documents of one task. It names its distinct pairs once, with the number
of its documents that hold them, and keeps each document's links as places in that list. Pairs are summed in two stages,
first by pair and salt, then by pair; sums go back to the blocks that asked, and each block's documents are scored with them. No
model or table of all pairs is in one place; rows are one for each pair of a block. A group with many tokens on both sides is first reduced to
distinct ids with their numbers, so repeats cost nothing.

Texts: a blank and the text, as the second tokenizer puts a blank before it. Special tokens' strings are plain text.
Null and empty texts, and those that either tokenizer does not give back byte for byte (U+2581 in the text is one case), have
no tokens: zeros and an empty groups_sha256. A row is a document, whatever its doc_id; repeated rows and rows without a
doc_id count like others. An empty table gives an empty table. Columns other than the id and the text are not
looked at. Long texts are handled one at a time; memory then grows with the text, and with the pairs of distinct ids of its largest group.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.llm import bytetokens
from pipeweave.llm.storage import Scratch

_AT_ONCE = 1 << 20  # characters of texts aligned together
#: Characters of texts in a block: more make fewer pairs in all, and more memory.
BLOCK = 12 << 20
_MANY = 256  # pairs of a group from which its ids are first made distinct
_STEP = 1 << 22  # pairs spelt out at a time
_BITS = 20  # of an id
SALTS = 16

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Pair:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = bytetokens.load(path_a, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in raw], dtype=np.int64) for raw in (self.a.raw, self.raw_b))
        if max(len(self.size_a), len(self.size_b)) >= 1 << _BITS:
            raise ValueError("a vocabulary is too large")
        # What a token adds to the spelling of a group: even places inside a side, odd ones at its end.
        self.spelt = np.array([f"{i}{end}".encode() for n, last in ((len(self.a.raw), "|"), (n, ";")) for i in range(n) for end in (",", last)], dtype=object)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of both for each text; none for texts that either does not give back."""
        none = np.zeros(0, dtype=np.int32)
        some = [i for i, t in enumerate(texts) if t]
        out_a, out_b = [none] * len(texts), [none] * len(texts)
        spaced = [" " + texts[i] for i in some]
        for i, text, a, b in zip(some, spaced, self.a.encode(spaced), self.b.encode([texts[i] for i in some], num_threads=1), strict=True):
            raw = text.encode()
            if b"".join([self.a.raw[x] for x in a.tolist()]) == raw and b"".join([self.raw_b[x] for x in b]) == raw:
                out_a[i], out_b[i] = a, np.array(b, dtype=np.int32)
        return out_a, out_b


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class Slice:
    """Groups of all texts of a slice, one after the other. Groups are numbered through the slice."""

    def __init__(self, pair: Pair, texts: list[str | None]) -> None:
        a, b = pair.encode(texts)
        self.n_a, self.n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        self.a, self.b = np.concatenate(a) if a else np.zeros(0, np.int32), np.concatenate(b) if b else np.zeros(0, np.int32)
        ends_a, ends_b = np.cumsum(pair.size_a[self.a]), np.cumsum(pair.size_b[self.b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))
        # Ends of texts are cuts: the group of a text's last token is its last.
        last = np.cumsum(self.n_a)
        self.group_end = np.where(last > 0, self.group_a[np.maximum(last - 1, 0)] + 1 if len(self.a) else 0, 0)
        self.n_groups = np.diff(np.concatenate(([0], self.group_end)))
        self.doc = np.repeat(np.arange(len(texts)), self.n_groups)
        self.n_links = np.bincount(self.doc, weights=self.in_a * self.in_b, minlength=len(texts)).astype(np.int64)

    def digests(self, pair: Pair) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each text, hashed; empty without tokens."""
        before_a, before_b = (np.concatenate(([0], np.cumsum(x))) for x in (self.in_a, self.in_b))
        at_a, at_b = np.arange(len(self.a)) + before_b[self.group_a], np.arange(len(self.b)) + before_a[self.group_b + 1]
        code = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        code[at_a], code[at_b] = 2 * self.a.astype(np.int64), 2 * (self.b.astype(np.int64) + len(pair.size_a))
        code[at_a[before_a[1:] - 1]] += 1
        code[at_b[before_b[1:] - 1]] += 1
        words, ends = pair.spelt[code].tolist(), np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        return [hashlib.sha256(b"".join(words[s:e])[:-1]).hexdigest() if e > s else "" for s, e in zip(ends[:-1], ends[1:], strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc, pair (a and b in one number) and how often, of each distinct pair of each text, in order."""
        first_a, first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        total = self.in_a * self.in_b
        many = np.flatnonzero(total > _MANY)
        few = np.flatnonzero(total <= _MANY)
        found = [self._spell(few, self.a, first_a, self.in_a, None, self.b, first_b, self.in_b, None)] if len(few) else []
        for part in np.array_split(many, max(1, len(many) // 1024)) if len(many) else []:
            ids_a, f_a, n_a, t_a = self._distinct(part, self.a, first_a, self.in_a)
            ids_b, f_b, n_b, t_b = self._distinct(part, self.b, first_b, self.in_b)
            own = np.arange(len(part))
            # As many groups at a time as make one step of pairs, one group at least.
            for some in np.split(own, np.flatnonzero(np.diff(np.cumsum(n_a * n_b) // _STEP)) + 1):
                found.append(self._spell(some, ids_a, f_a, n_a, t_a, ids_b, f_b, n_b, t_b, self.doc[part]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return _sum(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _distinct(self, groups, ids, first, size):
        at = np.repeat(first[groups], size[groups]) + _count(size[groups])
        code, times = np.unique(np.repeat(np.arange(len(groups)), size[groups]) << _BITS | ids[at], return_counts=True)
        n = np.bincount(code >> _BITS, minlength=len(groups))
        return code & (1 << _BITS) - 1, np.cumsum(n) - n, n, times

    def _spell(self, groups, a, first_a, n_a, times_a, b, first_b, n_b, times_b, doc=None):
        """All pairs of the groups: each token of one side repeated by the number of the other."""
        na, nb = n_a[groups], n_b[groups]
        at_a = np.repeat(first_a[groups], na) + _count(na)
        each = np.repeat(nb, na)
        at_b = np.repeat(np.repeat(first_b[groups], na), each) + _count(each)
        of = np.repeat(np.repeat((self.doc if doc is None else doc)[groups], na), each)
        at_a = np.repeat(at_a, each)
        times = np.ones(len(at_a), dtype=np.int64) if times_a is None else times_a[at_a] * times_b[at_b]
        return _sum(of, a[at_a].astype(np.int64) << _BITS | b[at_b], times)


def _count(sizes: np.ndarray) -> np.ndarray:
    """0 .. sizes[0] - 1, 0 .. sizes[1] - 1, ..."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _sum(doc: np.ndarray, code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((code, doc)) if len(doc) and doc[-1] >= 1 << 23 else np.argsort(doc << 40 | code, kind="stable")
    doc, code, times = doc[order], code[order], times[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])))) if len(doc) else np.zeros(0, np.int64)
    return doc[new], code[new], np.add.reduceat(times, new) if len(new) else times


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
    """First and last + 1 of texts that are handled together, and their characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and held + n > _AT_ONCE:
            yield start, i, held
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts), held


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), dtype=np.int32)


def align(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, a and b (ids of both), group_a and group_b (each token's group within its text, from 0). Map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(path_a, path_b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e, _ in _slices(texts):
                cut = Slice(pair, texts[s:e])
                first = cut.group_end - cut.n_groups
                lists = [(cut.n_a, cut.a), (cut.n_b, cut.b), (cut.n_a, cut.group_a - np.repeat(first, cut.n_a)), (cut.n_b, cut.group_b - np.repeat(first, cut.n_b))]
                columns = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(x.astype(np.int32))) for n, x in lists]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), *columns], [id, "a", "b", "group_a", "group_b"])

    return docs.select(id, text).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, a array<int>, b array<int>, group_a array<int>, group_b array<int>")


def _blocks(path_a: str, path_b: str, id: str, block: int):
    """Rows of documents, and of the distinct pairs of each block; pairs follow their block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task = load(path_a, path_b), TaskContext.get().partitionId()
        names = [id, "block", *_COUNTS, "groups_sha256", "held", "codes", "times", "at", "a", "b", "n"]
        number, waiting, held = 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            """A block's documents, then its pairs."""
            nonlocal number, waiting, held
            codes, places = np.unique(np.concatenate([w[3] for w in waiting]), return_inverse=True)
            where, name = 0, pa.scalar(task << 32 | number, pa.int64())
            for ids, cut, digests, code, times, n in waiting:
                own, ends = places[where : where + len(code)].astype(np.int32), np.cumsum(n)
                where += len(code)
                parts = [(own[e - k : e], times[e - k : e].astype(np.int32)) for e, k in zip(ends, n, strict=True)]
                size = len(ids)
                none = [pa.nulls(size, pa.int32())] * 3 + [pa.nulls(size, pa.int64())]
                counts = [pa.array(x, pa.int64()) for x in (cut.n_a, cut.n_b, cut.n_groups, cut.n_links)]
                packed = [pa.array([_pack(x) for x in (np.diff(p, prepend=np.int32(0)) for p, _ in parts)], pa.binary()), pa.array([_pack(t) for _, t in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays([ids, pa.repeat(name, size), *counts, pa.array(digests), pa.array(n, pa.int32()), *packed, *none], names)
            holders = np.bincount(places, minlength=len(codes))
            for s in range(0, len(codes), 1 << 16):
                some = codes[s : s + (1 << 16)]
                size = len(some)
                none = [pa.nulls(size, ids.type), pa.repeat(name, size), *[pa.nulls(size, pa.int64())] * 4, pa.nulls(size, pa.string()), pa.nulls(size, pa.int32()), *[pa.nulls(size, pa.binary())] * 2]
                new = [pa.array(x, pa.int32()) for x in (np.arange(s, s + size), some >> _BITS, some & (1 << _BITS) - 1)]
                yield pa.RecordBatch.from_arrays([*none, *new, pa.array(holders[s : s + size], pa.int64())], names)
            number, waiting, held = number + 1, [], 0

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e, chars in _slices(texts):
                cut = Slice(pair, texts[s:e])
                doc, code, times = cut.links()
                digests = cut.digests(pair)
                del cut.a, cut.b, cut.group_a, cut.group_b, cut.in_a, cut.in_b, cut.doc
                waiting.append((batch.column(0).slice(s, e - s), cut, digests, code, times, np.bincount(doc, minlength=e - s)))
                held += chars
                if held >= block:
                    yield from flush()
        if waiting:
            yield from flush()

    return run


def _scored(names: list[str]):
    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        """Documents of a block with the corpus counts of its pairs."""
        at = pairs.column("at").to_numpy()
        n, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        n[at], best[at] = pairs.column("total").to_numpy(), pairs.column("best").to_numpy()
        sums, bests = [], []
        for codes, times in zip(docs.column("codes").to_pylist(), docs.column("times").to_pylist(), strict=True):
            places, times = np.cumsum(_unpack(codes)), _unpack(times).astype(np.int64)
            sums.append(int((n[places] * times).sum()))
            bests.append(int((best[places] * times).sum()))
        out = docs.select(names)
        return out.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    return run


def pair_counts(pairs: DataFrame, salts: int = SALTS) -> DataFrame:
    """a, b, total (documents that hold the pair linked), best (1 where no pair of that a has more). pairs: block, a, b, n.

    Pairs of all words of a language are in every block, so sums are made by pair and salt before they are made by pair. A window
    is one a and its partners, the second vocabulary at most.
    """
    salted = pairs.groupBy("a", "b", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")).agg(F.sum("n").alias("n"))
    total = salted.groupBy("a", "b").agg(F.sum("n").alias("total"))
    return total.withColumn("best", (F.col("total") == F.max("total").over(Window.partitionBy("a"))).cast("long"))


def align_corpus(docs: DataFrame, path_a: str, path_b: str, scratch: Scratch, id: str = "doc_id", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents with their counts, and the pairs of the corpus (see pair_counts).

    Documents: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose pair has the greatest count of its a) and
    count_sum (of all links).
    """
    kind = docs.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held int, codes binary, times binary, at int, a int, b int, n long"
    found = scratch.keep(docs.select(id, text).mapInArrow(_blocks(path_a, path_b, id, block), schema), "blocks")
    pairs = found.where("at is not null").select("block", "at", "a", "b", "n")
    counts = scratch.keep(pair_counts(pairs), "pairs")
    asked = pairs.select("block", "at", "a", "b").join(counts, ["a", "b"]).select(F.col("block").alias("asking"), "at", "total", "best")
    names = [id, *_COUNTS, "groups_sha256"]
    own = found.where("held is not null").select(id, "block", *_COUNTS, "groups_sha256", "codes", "times")
    scored = own.groupBy("block").cogroup(asked.groupBy("asking")).applyInArrow(
        _scored(names), f"`{id}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    )
    return scored, counts
