"""Operator 5: documents scored by cross-entropy difference of two word bigram models.

One model is of the target documents and one of the whole corpus. They share one vocabulary, all words of
the corpus as they stand, and one order: p(w | v) = (n(v, w) + MU p(w)) / (n(v) + MU), where
p(w) = (n(w) + 1) / (n + size of the vocabulary). A border mark stands before and after each document, so
each word, and the mark, is followed by exactly one other. A document's score is its mean loss under the
target model minus that under the corpus model, the mark at its end included; low is like the target.

Every word and pair of every document is counted, and what is gathered grows with the input: no table of
the model is broadcast or held by the driver. Documents that stand together in the input's files are a
block. A task counts the distinct words and pairs of a block and deals them by hash to shares; a share adds
up the counts of all blocks and answers each block with the sums, in the order of the block's hashes, so
that answers carry no keys. A block's answers then meet its documents. Hashes of a block are sent sorted, as
differences, in compressed byte planes: as rows of their own they would be several times the input.

Rows: one per input row, with its columns but the text; columns that have one of the new names (NEW) are
replaced, names of helper columns give way to the input's. Null, empty and wordless texts have n_tokens 0 and
null losses. Texts are taken whole, however long. Repeated rows count as often as they stand, repeated ids
share whether they are targets, a null doc_id is never one. An empty table gives no rows; without target
documents the target model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.lm import BROADCAST_ROWS
from pipeweave.llm.names import fresh
from pipeweave.llm.storage import Scratch
from pipeweave.llm.words import Words, columns, mix

_U = np.uint64
MU = 4.0
#: Documents of a block, and bytes of text whose words and pairs are one share; they bound a task's memory.
BLOCK_ROWS, SHARE_BYTES = 2048, 32 << 20
_BORDER = _U(0x6A09E667F3BCC909)
NEW = ("n_tokens", "loss_target", "loss_corpus", "loss_difference")


def _grams(texts: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and a mark after each text that has words; of the pairs that end there; and the texts' numbers of words."""
    words = Words(*columns(texts, name))
    size = np.diff(words.first)
    ends = words.first[1:][size > 0]
    one = mix(np.insert(words.hashes(), ends, _BORDER))
    before = np.concatenate((one[-1:], one[:-1]))  # the last is a mark, and so is what precedes each text's first word
    return one & ~_U(1), mix(before * _U(0x9E3779B97F4A7C15) + one) | _U(1), size


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(x, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(-1)


def _counter(shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, target = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_block", "_target"))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                one, two, size = _grams(batch.slice(i, j - i), "text")
                own = np.repeat(target[i:j], size + (size > 0))
                keys, back = np.unique(np.concatenate((one, two)), return_inverse=True)
                n, t = np.bincount(back, minlength=len(keys)), np.bincount(back[np.concatenate((own, own))], minlength=len(keys))
                share = ((keys >> _U(32)) * _U(shares)) >> _U(32)
                at = np.searchsorted(share, np.arange(shares + 1, dtype=_U))
                rows = [(s, at[s], at[s + 1]) for s in range(shares) if at[s] < at[s + 1]]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), block[i])), pa.array([s for s, _, _ in rows], pa.int32()), pa.array([b - a for _, a, b in rows], pa.int64()),
                            pa.array([_packed(np.diff(keys[a:b], prepend=_U(0))) for _, a, b in rows], pa.binary()), pa.array([_packed(n[a:b]) for _, a, b in rows], pa.binary()), pa.array([_packed(t[a:b]) for _, a, b in rows], pa.binary()),
                        ],
                        ["block", "share", "size", "keys", "n", "t"],
                    )

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """The sums over all blocks of one share, for each block in the order of its hashes; its first row has the share's distinct words and their counts too."""
    block, size = rows["block"].to_numpy(), rows["size"].to_numpy()
    order = np.argsort(block, kind="stable")
    keys = [np.cumsum(_unpacked(x, n), dtype=_U) for x, n in zip(rows["keys"].to_pylist(), size, strict=True)]
    known, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(back, weights=np.concatenate([_unpacked(x, n) for x, n in zip(rows[c].to_pylist(), size, strict=True)]), minlength=len(known)).astype(np.int64) for c in ("n", "t")]
    at = np.concatenate(([0], np.cumsum(size)))
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(block[order])) + 1, [len(order)]))
    out = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        parts = [back[at[k] : at[k + 1]] for k in order[i:j]]
        mine = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))  # a block that two tasks have read
        out.append((int(block[order[i]]), len(mine), _packed(sums[0][mine]), _packed(sums[1][mine])))
    word = (known & _U(1)) == 0
    total = [[int(x), *[0] * (len(out) - 1)] for x in (word.sum(), sums[0][word].sum(), sums[1][word].sum())]
    return pa.table(
        [
            pa.array([x[0] for x in out], pa.int64()), pa.array([rows["share"][0].as_py()] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.int64()),
            pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.binary()), *[pa.array(x, pa.int64()) for x in total],
        ],
        ["block", "share", "size", "n", "t", "words", "total", "in_target"],
    )


def _scorer(others: list[str], text: str, words: int, total: int, in_target: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        one, two, size = _grams(pa.RecordBatch.from_arrays([docs[text].combine_chunks() if docs.num_rows else pa.array([], pa.string())], [text]), text)
        keys, back = np.unique(np.concatenate((one, two)), return_inverse=True)
        order = np.argsort(answers["share"].to_numpy())
        sizes, full = answers["size"].to_numpy(), size > 0
        if sizes.sum() != len(keys):
            raise RuntimeError("a block's answers are not those of its words and pairs")
        long = size + full
        first = (np.cumsum(long) - long)[full]
        means = []
        for c, n in (("t", in_target), ("n", total)):
            packed = answers[c].to_pylist()
            count = np.concatenate([np.zeros(0), *[_unpacked(packed[k], sizes[k]) for k in order]])[back]
            word, pair = count[: len(one)], count[len(one) :]
            loss = -np.log((pair + MU * (word + 1) / (n + words)) / (np.concatenate((word[-1:], word[:-1])) + MU)) if len(one) else word
            mean = np.zeros(len(size))
            if len(first):
                mean[full] = np.add.reduceat(loss, first) / long[full]
            means.append(pa.array(mean, mask=~full))
            mean_of = mean if c == "t" else mean_of - mean
        return pa.table([*[docs[c] for c in others], pa.array(size.astype(np.int64)), *means, pa.array(mean_of, mask=~full)], [*others, *NEW])

    return run


def _blocks(docs: DataFrame, name: str) -> DataFrame:
    return docs.select("*", F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / BLOCK_ROWS)).alias(name))


def score_words(docs: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text) with n_tokens (long), loss_target, loss_corpus and loss_difference (double, nats a word) in place of the text. targets: doc_id of each target document, distinct."""
    docs = docs.drop(*NEW)
    named = docs.columns
    (block,) = fresh(docs, "_block")
    try:
        placed = _blocks(docs, block)
    except AnalysisException:  # not straight from files; a column of the input's may hide where rows stand
        hides = [c for c in named if c.lower() == "_metadata"]
        (apart,) = fresh(docs, "_meta_of_input")
        placed = _blocks(scratch.keep(docs.withColumnsRenamed({c: apart for c in hides}), "docs"), block)
        docs = placed.drop(block)
    size = placed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = max(12, -(-size // SHARE_BYTES))
    few = targets.count() <= BROADCAST_ROWS
    marked = targets.select("doc_id", F.lit(True).alias("_target"))
    flagged = placed.select("doc_id", "text", F.col(block).alias("_block")).join(F.broadcast(marked) if few else marked, "doc_id", "left")
    flagged = flagged.select("text", "_block", F.coalesce("_target", F.lit(False)).alias("_target"))
    if not few:
        flagged = flagged.repartition("_block").sortWithinPartitions("_block")
    counts = flagged.mapInArrow(_counter(shares), "block long, share int, size long, keys binary, n binary, t binary")
    sums = counts.groupBy("share").applyInArrow(_summed, "block long, share int, size long, n binary, t binary, words long, total long, in_target long")
    answers = scratch.keep(sums, "answers")
    totals = [x or 0 for x in answers.agg(*[F.sum(c) for c in ("words", "total", "in_target")]).first()]
    others = [c for c in docs.columns if c != "text"]
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in others], "n_tokens long", *[f"{c} double" for c in NEW[1:]]])
    mine = answers.select("block", "share", "size", "n", "t").groupBy("block")
    scored = placed.groupBy(block).cogroup(mine).applyInArrow(_scorer(others, "text", *totals), kinds)
    return scored.withColumnsRenamed({c: was for c, was in zip(docs.columns, named, strict=True) if c != was})
