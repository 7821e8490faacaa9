"""Operator 3: near-duplicate embeddings by spherical-cap filters of structured random product codes.

A code is a random rotation and, for each half of the rotated vector, `words` random directions; each of
the words ** 2 pairs of directions is one filter. A vector's list is all filters with which its inner
product is at least `cap` / sqrt(dimension); the sorted inner products of the halves give it without
trying them all. Vectors that share a filter (and the label) are compared in double precision. With six
codes of 1024 x 1024 filters and a cap of 3.84, a vector has about 160 filters, two unrelated vectors
share one with 0.4 %, and a pair of cosine 0.93 shares none with about 0.001 % (measured on random
vectors; tests/llm compares whole tables with brute force).

Equal vectors of a label are one, sid, which carries the number of vec_ids that have it. A bucket of a
filter is split into chunks of about `chunk` vectors, and two chunks at a time are compared in one task;
a pair counts in the bucket of the smallest filter it shares, so a vector goes to a bucket with those of
its filters that are smaller. Links are not written out: each comparison gives a row per vector with its
number of new links and the least vector it hangs together with there.

Rows: one per distinct vec_id; null ones are left out. Vectors that are null, zero, or hold null or
non-finite components, and those without label, have no links. Vectors of different length are never
compared. Repeated rows of one vec_id with different vectors: it is linked with what any of them is linked
with, n_links is the largest number. Other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.components import components
from pipeweave.llm.storage import Scratch


@lru_cache(maxsize=4)
def _codes(dim: int, words: int, n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rotation, directions of the first half, of the second half) of each code; the same on every machine."""
    half, out = max(32, -(-dim // 2)), []
    for k in range(n):
        r = np.random.default_rng([seed, dim, k])
        turn = np.linalg.qr(r.standard_normal((2 * half, 2 * half)))[0][:dim]
        sides = r.standard_normal((2, words, half))
        sides /= np.linalg.norm(sides, axis=2, keepdims=True) * np.sqrt(2)
        out.append((turn, sides[0], sides[1]))
    return out


def _matrix(col: pa.ListArray, dim: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def filters_of(x: np.ndarray, words: int, codes: int, cap: float, seed: int) -> list[np.ndarray]:
    """The filters that each unit vector exceeds."""
    found: list[list[np.ndarray]] = [[] for _ in range(len(x))]
    for k, (turn, one, two) in enumerate(_codes(x.shape[1], words, codes, seed)):
        least, y = cap / np.sqrt(turn.shape[1]), x @ turn
        half = one.shape[1]
        for i, (a, b) in enumerate(zip(y[:, :half] @ one.T, y[:, half:] @ two.T, strict=True)):
            down = np.argsort(-b)
            many = np.searchsorted(-b[down], a - least, side="right")  # so many of the second half go with each of the first
            left = np.flatnonzero(many)
            size = many[left]
            right = down[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            found[i].append((k * words + np.repeat(left, size)) * words + right)
    return [np.concatenate(f) for f in found]


def _listed(words: int, codes: int, cap: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, out = batch.column(batch.schema.get_field_index("embedding")), [np.zeros(0, dtype=np.int64)] * batch.num_rows
            size = col.value_lengths().to_numpy()
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                for at in range(0, len(rows), 1024):
                    some = rows[at : at + 1024]
                    for i, f in zip(some, filters_of(_matrix(col.take(pa.array(some)), int(dim)), words, codes, cap, seed), strict=True):
                        out[i] = f
            at = np.concatenate(([0], np.cumsum([len(f) for f in out]))).astype(np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
            names = ["id", "label", "dim"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], [*names, "filters"]
            )

    return run


def _roots(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the smallest row it hangs together with."""
    root = np.arange(len(links))
    links = links | np.eye(len(links), dtype=bool)
    while True:
        new = np.where(links, root[None, :], len(root)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _compared(least: float):
    """For the blocks of one group: id, weight of the vectors linked first in this bucket, least id it hangs together with."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.stack([table.column(k).to_numpy() for k in ("label", "dim", "filter", "lo", "hi", "id")])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        mine = {k: table.column(k).to_numpy()[order] for k in ("part", "n")}
        vectors, lists = table.column("embedding").combine_chunks(), table.column("shared").combine_chunks()
        edge = np.flatnonzero(np.concatenate(([True], (keys[:5, 1:] != keys[:5, :-1]).any(axis=0))))
        ids, news, roots = [], [], []
        for s, e in zip(edge, [*edge[1:], keys.shape[1]], strict=True):
            (_, dim, now, lo, hi), id_ = keys[:5, s], keys[5, s:e]
            rows = pa.array(order[s:e])
            x = _matrix(vectors.take(rows), int(dim))
            near = x @ x.T >= least
            np.fill_diagonal(near, False)
            if lo != hi:  # pairs within a chunk are compared where the chunk meets itself
                part = mine["part"][s:e]
                near &= part[:, None] != part[None, :]
            if not near.any():
                continue
            first = near
            if (near.sum(axis=1) > 0).any():
                mylists = lists.take(rows)
                flat, at = mylists.flatten().to_numpy(), np.repeat(np.arange(e - s), mylists.value_lengths().to_numpy())
                low = flat < now
                if low.any():
                    _, col = np.unique(flat[low], return_inverse=True)
                    before = np.zeros((e - s, e - s), dtype=bool)
                    for a in range(0, int(col.max()) + 1, 4096):
                        some = (col >= a) & (col < a + 4096)
                        has = np.zeros((e - s, 4096), dtype=np.float32)
                        has[at[low][some], col[some] - a] = 1
                        before |= has @ has.T > 0
                    first = near & ~before
            linked = np.flatnonzero(near.any(axis=1))
            ids.append(id_[linked])
            news.append((first[linked] * mine["n"][s:e][None, :]).sum(axis=1))
            roots.append(id_[_roots(near)[linked]])
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
        return pa.table({"id": cat(ids), "new": cat(news), "root": cat(roots)})

    return run


def near_vectors(
    given: DataFrame, scratch: Scratch, least: float = 0.93, words: int = 1024, codes: int = 6, cap: float = 3.84, chunk: int = 512, seed: int = 5
) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept."""
    given = given.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).where("vec_id is not null")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = given.where("label is not null and embedding is not null").where(~odd).where(F.exists("embedding", lambda x: x != 0))
    sound = sound.withColumn("sid", F.xxhash64("label", "embedding"))
    equal = sound.groupBy("sid").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("n"))
    equal = scratch.keep(equal.withColumn("dim", F.size("embedding").cast("long")), "equal")
    lists = equal.withColumnRenamed("sid", "id").mapInArrow(_listed(words, codes, cap, seed), "id long, label long, dim long, filters array<long>")
    listed = scratch.keep(lists.select("id", "label", "dim", F.explode("filters").alias("filter")), "filters")
    bucket = ["label", "dim", "filter"]
    many = listed.groupBy(bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = scratch.keep(listed.join(many, bucket), "shared")

    # A chunk meets each chunk of its bucket once; most buckets are a single chunk.
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    placed = shared.withColumn("part", F.pmod(F.xxhash64("filter", "id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    placed = placed.withColumns({"lo": F.least("part", "other").cast("long"), "hi": F.greatest("part", "other").cast("long")})
    rows = placed.count()
    groups = max(1, rows // 20_000)
    own = shared.groupBy("id").agg(F.collect_list("filter").alias("all")).join(equal.select(F.col("sid").alias("id"), "embedding", "n"), "id")
    blocks = placed.join(own, "id").withColumn("g", F.pmod(F.xxhash64(*bucket, "lo", "hi"), F.lit(groups)))
    blocks = blocks.withColumn("shared", F.expr("filter(all, x -> x < filter)"))
    found = scratch.keep(
        blocks.select("g", *bucket, "lo", "hi", "id", "part", "n", "embedding", "shared").groupBy("g").applyInArrow(_compared(least), "id long, new long, root long"), "found"
    )
    # From here on a vector goes by its smallest vec_id, and a vec_id of several vectors ties those together.
    of = equal.select(F.col("sid").alias("id"), "least")
    links = found.select("id", "root").distinct().join(of.withColumnRenamed("least", "a"), "id").select("root", "a").join(of.withColumnsRenamed({"id": "root", "least": "b"}), "root").select("a", "b")
    several = sound.groupBy("vec_id").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("vec_id")
    tied = sound.join(several, "vec_id").select(F.col("vec_id").alias("a"), F.col("sid").alias("id")).distinct().join(of.withColumnRenamed("least", "b"), "id").select("a", "b")
    reach = components(links.unionByName(tied), scratch)
    new = found.groupBy(F.col("id").alias("sid")).agg(F.sum("new").alias("new"))
    per = equal.select("sid", "least", "n").join(new, "sid", "left").join(reach.withColumnRenamed("node", "least"), "least", "left")
    per = per.select("sid", (F.col("n") - 1 + F.coalesce("new", F.lit(0))).alias("links"), F.coalesce("component_id", "least").alias("c"))
    named = sound.select("vec_id", "sid").join(per, "sid").groupBy("vec_id").agg(F.max("links").alias("links"), F.min("c").alias("c"))
    out = given.select("vec_id").distinct().join(named, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
