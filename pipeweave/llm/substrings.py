"""Operator 8: removal of passages that an earlier document has too, by seed and extend.

A window is `length` consecutive words of one document. A word goes if it lies in a window whose words
also start somewhere in a document with a smaller doc_id; windows are judged on the input as it is.

Seeds: every window's least hash of `seed` consecutive words (the rightmost of equals) is its anchor, as
in winnowing, so that two documents that share a window share its anchor. Windows in a row with the same
anchor are one run; the words that a run spans are its anchor extended both ways.

Extension, without forming pairs: runs that agree over their whole span are equal, and the smallest
doc_id among them decides for all. Where an anchor is found with different spans, each of its distinct
spans, once whatever the number of its copies, is split into windows, and for each window the smallest
doc_id decides. Overlapping windows then unite to maximal repeats. Work is linear in the words, a group
of n copies costs n rows, and each join on anchors has one row a key on one side.

Anchors, spans and windows are compared by hash; a window must agree in two of 64 bits.

Rows: one per input row, with its columns; those that have the name of a new column are replaced. Null,
blank or empty texts and rows without doc_id have nothing to remove. Rows with the same doc_id do not count
as earlier or later than each other; equal rows lose the same. An empty table gives an empty table. Long
texts are hashed in slices; a text's windows are held together, some 30 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.names import fresh
from pipeweave.llm.storage import Scratch
from pipeweave.llm.words import Ranges, Words, columns, ngrams, signed

_STEP = 1 << 16  # windows looked at together; bounds memory
#: Names of documents (16 bytes each) are broadcast up to this number, so that the texts of all others stay
#: where they are; with more, all texts are shuffled.
BROADCAST_IDS = 1_000_000
_KEYS = ["doc_id", "text_id"]


def _anchors(h: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run: its anchor's hash and place, and its first and last window."""
    g = ngrams(h, seed)
    width = length - seed + 1
    if len(g) < width:
        return (np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3)
    n = len(g) - width + 1
    at = np.empty(n, dtype=np.int64)
    for i in range(0, n, _STEP):
        part = np.lib.stride_tricks.sliding_window_view(g[i : min(n, i + _STEP) + width - 1], width)
        at[i : i + len(part)] = np.arange(i, i + len(part)) + width - 1 - part[:, ::-1].argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [n])) - 1
    return g[at[first]], at[first], first, last


def _runs(length: int, seed: int):
    """h: anchor, c: span with the anchor's place in it, first and last: windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*columns(batch, "text"))
            hashes = words.hashes()
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for row, (s, e) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                if e - s < length:
                    continue
                h, at, first, last = _anchors(hashes[s:e], length, seed)
                c = Ranges(hashes[s:e]).of(first, last + length) + (at - first).astype(np.uint64)
                for kept, x in zip(out, (np.full(len(h), row), signed(h), signed(c), first, last), strict=True):
                    kept.append(x)
            row, h, c, first, last = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out)
            ids = [batch.column(batch.schema.get_field_index(k)).take(pa.array(row)) for k in ("doc_id", "text_id")]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(h), pa.array(c), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                ["doc_id", "text_id", "h", "c", "first", "last"],
            )

    return run


def _windows(length: int):
    """The windows of the given runs of each document: h, c, which window of the run, its hash, doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*columns(batch, "text"))
            hashes = words.hashes()
            runs = batch.column(batch.schema.get_field_index("runs"))
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
            at, flat = runs.offsets.to_numpy(), runs.values
            lo = at[0] if len(at) else 0
            parts = {k: flat.field(k).to_numpy() for k in ("h", "c", "first", "last")}
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for row, (s, e) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                mine = slice(at[row], at[row + 1])
                first, last = parts["first"][mine].astype(np.int64), parts["last"][mine].astype(np.int64)
                size = last - first + 1
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = np.repeat(first, size) + step
                w = Ranges(hashes[s:e]).of(start, start + length)
                for kept, x in zip(out, (np.repeat(parts["h"][mine], size), np.repeat(parts["c"][mine], size), step, signed(w), np.full(len(w), ids[row])), strict=True):
                    kept.append(x)
            h, c, step, w, doc = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out)
            del lo
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(step, pa.int32()), pa.array(w), pa.array(doc)], ["h", "c", "step", "w", "doc_id"])

    return run


def united(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ranges in order that cover what the given ranges cover."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(starts, kind="stable"):
        s, e = int(starts[i]), int(ends[i])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _cut(length: int, digest: bool, spans_: str):
    """n_words, n_removed, removed ranges of words; the kept text as it stands or only its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*columns(batch, "text"))
            spans = batch.column(batch.schema.get_field_index(spans_))
            texts = batch.column(batch.schema.get_field_index("text"))
            found: list[list] = [[], [], [], []]
            for row, (f, t) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                n = int(t - f)
                given = spans[row].as_py() or []
                gone = united(np.array([x["first"] for x in given]), np.array([x["last"] + length for x in given])) if given else []
                keep = [(a, b) for a, b in zip([0, *[e for _, e in gone]], [*[s for s, _ in gone], n], strict=True) if a < b]
                if digest:
                    data = words.data
                    pieces = b" ".join(
                        b" ".join(data[words.start[f + a] : words.end[f + b - 1]].tobytes().split()) for a, b in keep
                    )
                    text = hashlib.sha256(pieces).hexdigest()
                elif not gone:
                    text = texts[row].as_py()
                else:
                    text = "\n".join(words.data[words.start[f + a] : words.end[f + b - 1]].tobytes().decode() for a, b in keep)
                for kept, x in zip(found, (n, sum(e - s for s, e in gone), [{"first": s, "end": e} for s, e in gone], text), strict=True):
                    kept.append(x)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            new = [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], kind), pa.array(found[3], pa.string())]
            others = [x for x in batch.schema.names if x not in ("text", spans_)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(x)) for x in others], *new],
                [*others, "n_words", "n_removed", "removed", "kept_sha256" if digest else "text"],
            )

    return run


def repeats(docs: DataFrame, scratch: Scratch, length: int, seed: int) -> DataFrame:
    """doc_id, text_id, spans: runs of windows that start in a document with a smaller doc_id too."""
    runs = scratch.keep(
        docs.select("doc_id", "text_id", "text").mapInArrow(_runs(length, seed), "doc_id long, text_id long, h long, c long, first int, last int"), "runs"
    )
    # Spans: the smallest doc_id of each; its first run there stands for the span.
    spans = runs.groupBy("h", "c").agg(
        F.min(F.struct("doc_id", "text_id", "first", "last")).alias("of"), F.max("doc_id").alias("most")
    )
    spans = scratch.keep(spans, "spans")
    anchors = spans.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("of.doc_id").alias("lo"), F.max("most").alias("hi")).where("lo < hi")
    seeds = scratch.keep(spans.join(anchors.select("h", "n"), "h"), "seeds")
    equal = seeds.where("n = 1").select("h", "c", F.array(F.struct(F.lit(0).alias("step"), (F.col("of.last") - F.col("of.first")).alias("to"), F.col("of.doc_id").alias("least"))).alias("found"))

    # Anchors with several spans: window by window.
    where = seeds.where("n > 1").select("h", "c", "of.*")
    where = scratch.keep(where.groupBy(_KEYS).agg(F.collect_list(F.struct("h", "c", "first", "last")).alias("runs")), "where")
    if where.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(where.select(_KEYS)), _KEYS, "left_semi")
    windows = docs.join(where, _KEYS).select("doc_id", "text", "runs")
    windows = scratch.keep(windows.mapInArrow(_windows(length), "h long, c long, step int, w long, doc_id long"), "windows")
    least = windows.groupBy("h", "w").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    some = windows.join(least.where("n > 1").select("h", "w", "least"), ["h", "w"], "left").withColumn("least", F.coalesce("least", "doc_id"))
    differ = some.groupBy("h", "c").agg(F.collect_list(F.struct("step", F.col("step").alias("to"), "least")).alias("found"))

    known = equal.unionByName(differ)
    hits = runs.join(known, ["h", "c"]).select("doc_id", "text_id", "first", F.expr("filter(found, x -> x.least < doc_id)").alias("found")).where(F.size("found") > 0)
    hits = hits.select("doc_id", "text_id", F.expr("transform(found, x -> struct(first + x.step AS first, first + x.to AS last))").alias("found"))
    return hits.groupBy("doc_id", "text_id").agg(F.flatten(F.collect_list("found")).alias("spans"))


def substring_dedup(docs: DataFrame, scratch: Scratch, length: int = 50, seed: int = 12, digest: bool = False) -> DataFrame:
    """docs with n_words, n_removed (long), removed (ranges of words) and the text without them.

    Kept ranges stand as they stood, a line break between two. With digest the text gives way to
    kept_sha256, over the kept words joined by one space.
    """
    if not 1 <= seed <= length:
        raise ValueError("seed must be from 1 to length")
    others = [x for x in docs.columns if x not in ("text", "n_words", "n_removed", "removed", "kept_sha256")]
    id_, spans = fresh(docs, "text_id", "spans")
    keys = ["doc_id", id_]
    named = docs.select(*[f"`{x}`" for x in others], "text").withColumn(id_, F.xxhash64("text"))
    known = named.where("doc_id is not null and text is not null").select("doc_id", F.col(id_).alias("text_id"), "text")
    found = scratch.keep(repeats(known, scratch, length, seed), "found").withColumnsRenamed({"text_id": id_, "spans": spans})
    if found.count() <= BROADCAST_IDS:
        ids = F.broadcast(found.select(keys))
        whole = named.join(ids, keys, "left_anti").withColumn(spans, F.lit(None).cast(found.schema[spans].dataType))
        out = whole.unionByName(named.join(ids, keys, "left_semi").join(found, keys, "left").select(*[f"`{x}`" for x in whole.columns]))
    else:
        out = named.join(found, keys, "left")
    out = out.select(*[f"`{x}`" for x in others], "text", spans)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in others)
    new = f"n_words long, n_removed long, removed array<struct<first:int,end:int>>, {'kept_sha256' if digest else 'text'} string"
    return out.mapInArrow(_cut(length, digest, spans), f"{schema}, {new}")
