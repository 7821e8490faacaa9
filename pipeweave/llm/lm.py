"""Operator 5: documents scored by cross-entropy difference.

Two n-gram models of the same kind, one of target documents and one of the whole corpus, share one
vocabulary, the 256 byte values, and one order, three: the probability of a byte given the two before
it, interpolated with shorter contexts by Witten and Bell's weights. A document's score is its mean loss
under the target model minus that under the corpus model, over all of its bytes; low is like the target.

Counts cover every byte of every document. They are added up in each task before the shuffle; the model
has at most 2 ** 24 entries whatever the corpus, which bounds what is broadcast. Scoring shuffles nothing.
(Word n-grams would have to meet their counts in a join of one row per word of the corpus.)

Rows: one per input row. Null and empty texts have n_tokens 0 and null losses. Without target documents
the target model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.storage import Scratch
from pipeweave.llm.words import columns

_AT_ONCE = 1 << 21  # bytes looked at together; bounds memory
#: Documents of the target are broadcast up to this number (8 bytes each), shuffled beyond it.
BROADCAST_ROWS = 1_000_000


def _grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, trigrams of these rows in order), rows taken together up to a size."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _AT_ONCE, side="right")) - 1)
        part = data[at[i] : at[j]].astype(np.int32)
        one, two = np.concatenate(([0], part[:-1])), np.concatenate(([0, 0], part[:-2]))[: len(part)]
        first = at[i:j][np.diff(at[i : j + 1]) > 0] - at[i]
        one[first] = 0
        two[first] = 0
        second = first + 1
        two[second[second < len(part)]] = 0
        yield i, j, (two << 16) | (one << 8) | part
        i = j


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(grams, return_inverse=True)
    return keys, np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))] * 2
    for batch in batches:
        data, at = columns(batch, "text")
        target = batch.column(batch.schema.get_field_index("target")).to_numpy(zero_copy_only=False)
        for i, j, grams in _grams(data, at):
            own = np.repeat(target[i:j], np.diff(at[i : j + 1]))
            used = np.flatnonzero(np.bincount(grams & 255, minlength=256) + (np.arange(256) == 0))
            code = np.zeros(256, dtype=np.int32)
            code[used] = np.arange(len(used))
            k = len(used)
            dense = (code[grams >> 16] * k + code[(grams >> 8) & 255]) * k + code[grams & 255]
            for m, some in enumerate((dense, dense[own])):
                n = np.bincount(some, minlength=k**3)
                hit = np.flatnonzero(n)
                names = (used[hit // (k * k)] << 16) | (used[hit // k % k] << 8) | used[hit % k]
                total[m] = _summed(np.concatenate((total[m][0], names)), np.concatenate((total[m][1], n[hit])))
    (grams, n), (mine, t) = total
    in_target = np.zeros(len(grams), dtype=np.int64)
    in_target[np.searchsorted(grams, mine)] = t
    yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int32)), pa.array(n), pa.array(in_target)], ["gram", "n", "n_target"])


def _losses(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """-log p of each of the 2 ** 24 trigrams, from counts of those that occur."""
    hit = n > 0
    grams, n = grams[hit], n[hit].astype(np.float64)
    add = lambda key, size: np.bincount(key, weights=n, minlength=size)
    one = add(grams & 255, 256)
    p1 = (one + 1) / (one.sum() + 256)
    pairs = add(grams & 65535, 65536)  # the last two bytes
    kinds = (pairs.reshape(256, 256) > 0).sum(axis=1)
    seen = pairs.reshape(256, 256).sum(axis=1)
    some = np.maximum(seen + kinds, 1)
    p2 = np.where((seen > 0)[:, None], (pairs.reshape(256, 256) + kinds[:, None] * p1[None]) / some[:, None], p1[None])
    context, kinds3 = add(grams >> 8, 65536), np.bincount(grams >> 8, minlength=65536)
    weight = np.where(context > 0, kinds3 / np.maximum(context + kinds3, 1), 1.0)
    out = (weight.reshape(256, 256)[:, :, None] * p2[None]).astype(np.float32).reshape(-1)
    out[grams] += (n / (context + kinds3)[grams >> 8]).astype(np.float32)
    return -np.log(out)


class Model:
    """The two models' counts, as sent to the workers; the full tables are made once in each."""

    _made: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, name: str, grams: np.ndarray, n: np.ndarray, target: np.ndarray) -> None:
        self.name, self.grams, self.n, self.target = name, grams, n, target

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self.name not in Model._made:
            Model._made.clear()
            Model._made[self.name] = (_losses(self.grams, self.target), _losses(self.grams, self.n))
        return Model._made[self.name]


def train(docs: DataFrame, targets: DataFrame, scratch: Scratch) -> Model:
    """docs: doc_id, text. targets: doc_id of each target document, distinct."""
    near = F.broadcast if targets.count() <= BROADCAST_ROWS else (lambda x: x)
    flagged = docs.select("doc_id", "text").join(near(targets.withColumn("target", F.lit(True))), "doc_id", "left")
    flagged = flagged.select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = flagged.mapInArrow(_counted, "gram int, n long, n_target long")
    table = scratch.keep(counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")), "trigrams").toArrow()
    grams, n, target = (table.column(k).to_numpy() for k in ("gram", "n", "n_target"))
    return Model(scratch.root, grams, n, target)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens (long), loss_target, loss_corpus and loss_difference (double, nats a byte) in place of the text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_tokens", "loss_target", "loss_corpus", "loss_difference"]
    others = [c for c in docs.columns if c not in (text, *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, corpus = held.value.tables()
        for batch in batches:
            data, at = columns(batch, text)
            size = np.diff(at)
            sums = np.zeros((2, len(size)))
            for i, j, grams in _grams(data, at):
                full = np.flatnonzero(size[i:j])
                if len(full):
                    first = at[i:j][full] - at[i]
                    for k, table in enumerate((target, corpus)):
                        sums[k, i + full] = np.add.reduceat(table[grams].astype(np.float64), first)
            none = size == 0
            mean = sums / np.maximum(size, 1)
            new = [pa.array(size.astype(np.int64)), *[pa.array(x, mask=none) for x in (mean[0], mean[1], mean[0] - mean[1])]]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in others], *new], [*others, *names])

    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in others], "n_tokens long", *[f"{n} double" for n in names[1:]]])
    return docs.select(*others, text).mapInArrow(run, kinds)
