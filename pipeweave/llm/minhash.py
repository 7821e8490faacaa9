"""Operator 4: near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct runs of k words, A-Z lower-cased; a document with fewer words has
its whole sequence as the one element, and without words the set is empty. Two documents are linked
if 100 * intersection >= threshold * union of their full sets.

Candidates: two collections of `side` sketches of `rows` minhashes each are computed, and a table key
is a pair of one sketch from either. side * side tables cost only 2 * side sketches of hashing, about
the square root. With 12 x 3 + 12 x 3 minhashes two sets of similarity 0.8 share no key with a
probability of 0.04 %, of 0.85 with 0.002 %. Every candidate is verified on full sets (64-bit hashes
of the runs).

Groups of copies: equal sets become one set, named by the smallest doc_id that has it, before any table
is built. In a bucket every set is compared with a leader, and where most then hang together with a
second one, drawn by a hash that differs from bucket to bucket. In buckets of whatever size, all sets that
are still apart from them are then compared with the first LEADERS of the bucket, which leaves only pairs of
two others, if there are any. Those are compared if they have one of the rarest items of both in common: of
two similar sets these prefixes always meet, so no pair of a bucket is lost, and sets that share a passage
but little else, of which a bucket may hold many, are not paired. Pairs grow with the rows of the buckets.

Rows: one per distinct doc_id. Null, blank or empty texts: n_shingles 0, own component. Rows without a
doc_id are left out: nothing could name them. Repeated rows of one doc_id with different texts: the
doc_id is linked with what any of them is linked with, n_shingles is the largest. An empty table gives an
empty table. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.llm.components import components
from pipeweave.llm.storage import Scratch
from pipeweave.llm.words import Words, columns, mix, ngrams, seeds, signed

_U = np.uint64
#: Candidate pairs are broadcast up to this number of rows (16 bytes each); beyond it they are shuffled.
BROADCAST_PAIRS = 100_000
#: Sets of each bucket that all others of it are compared with.
LEADERS = 4


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    words = Words(*columns(batch, "text"))
    h = words.hashes(lower=True)
    for s, e in zip(words.first[:-1], words.first[1:], strict=True):
        yield np.unique(ngrams(h[s:e], min(k, e - s))) if e > s else np.zeros(0, dtype=_U)


def _sketch(k: int, side: int, rows: int):
    """doc_id, text_id, n_shingles, the set's 128-bit name, and 2 * side sketches."""
    times, plus = (seeds(11, 2 * side * rows) | _U(1))[:, None], seeds(12, 2 * side * rows)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, out = [], [], []
            for x in _sets(batch, k):
                n.append(len(x))
                if len(x):
                    least = np.full(2 * side * rows, ~_U(0), dtype=_U)
                    for i in range(0, len(x), 4096):
                        least = np.minimum(least, (x[None, i : i + 4096] * times + plus).min(axis=1))
                    band = np.zeros(2 * side, dtype=_U)
                    for c in least.reshape(2 * side, rows).T:
                        band = mix(band * _U(31) + c)
                    names.append([signed(mix(x)).sum(), signed(mix(x ^ _U(0x5851F42D4C957F2D))).sum()])
                    out.append(signed(band))
                else:
                    names.append([0, 0])
                    out.append(np.zeros(2 * side, dtype=np.int64))
            names = np.array(names, dtype=np.int64).reshape(-1, 2)
            flat = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * side, dtype=np.int32)), pa.array(flat))
            ids = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_id")]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(n, pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), sketches],
                ["doc_id", "text_id", "n_shingles", "name1", "name2", "sketches"],
            )

    return run


def _full(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch, k))
            at = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = signed(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("sid")), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["sid", "items"]
            )

    return run


def _overlap(a: str, b: str) -> F.Column:
    return F.size(F.array_intersect(a, b))


class Verifier:
    """Confirms pairs on full sets."""

    def __init__(self, items: DataFrame, threshold: int, scratch: Scratch) -> None:
        self.items, self.threshold, self.scratch = items, threshold, scratch

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the given distinct pairs whose sets are similar enough."""
        pairs = self.scratch.keep(pairs, "pairs")
        small = pairs.count() <= BROADCAST_PAIRS
        near = F.broadcast if small else (lambda x: x)
        # A side of few pairs goes to where the sets are; else sets and pairs meet by name.
        left = self.items.select(F.col("sid").alias("a"), F.col("items").alias("of_a")).join(near(pairs), "a")
        both = left.join(self.items.select(F.col("sid").alias("b"), F.col("items").alias("of_b")), "b")
        common = _overlap("of_a", "of_b").cast("long")
        return both.where(100 * common >= self.threshold * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def _grouped(links: DataFrame) -> DataFrame:
    """sid, c: the smallest sid within two links. Sets with the same c hang together; others may."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    once = both.groupBy("a").agg(F.least("a", F.min("b")).alias("c"))
    over = both.join(once.select(F.col("a").alias("b"), "c"), "b").select("a", "c").unionByName(once)
    return over.groupBy(F.col("a").alias("sid")).agg(F.min("c").alias("c"))


def _hanging(links: DataFrame, scratch: Scratch) -> DataFrame:
    """sid, c: the smallest sid reachable by links, over however many."""
    return components(links, scratch).select(F.col("node").alias("sid"), F.col("component_id").alias("c"))


def _rarest(sets: DataFrame, items: DataFrame, threshold: int) -> DataFrame:
    """sets (sid, n_shingles, c) with one row for each item of their prefix, the n - ceil(threshold * n / 100) + 1 rarest ones.

    Two sets that are similar enough share an item of their prefixes, whatever the order of the items, so
    this loses no link. What many sets share, such as a common passage, is rarely among the rarest.
    """
    each = sets.join(items, "sid").select("sid", "n_shingles", "c", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, "item").withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy("often", "item")))
    return ranked.where(F.col("rank") <= F.col("n_shingles") - F.ceil(F.col("n_shingles") * threshold / F.lit(100)) + 1).where("often > 1")


def near_duplicates(
    docs: DataFrame, scratch: Scratch, k: int = 5, threshold: int = 80, side: int = 12, rows: int = 3
) -> DataFrame:
    """doc_id, n_shingles (long), component_id (smallest doc_id reachable by links), kept (doc_id = component_id)."""
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("text_id")).where("doc_id is not null")
    schema = "doc_id long, text_id long, n_shingles long, name1 long, name2 long, sketches array<long>"
    signed_ = scratch.keep(given.mapInArrow(_sketch(k, side, rows), schema), "sketches")

    # Equal sets are one, with a number of its own, sid, which is written with it. One text of the smallest doc_id stands for it.
    names = ["n_shingles", "name1", "name2"]
    full = signed_.where("n_shingles > 0")
    one = F.struct("doc_id", "text_id")
    first = full.groupBy(names).agg(F.min_by("sketches", one).alias("sketches"), F.min(one).alias("of")).select("*", F.monotonically_increasing_id().alias("sid"), "of.*").drop("of")
    first = scratch.keep(first, "distinct")
    same = full.select("doc_id", *names).join(first.select(*names, F.col("doc_id").alias("first")), names).select("doc_id", "first").where("doc_id <> first")

    # Sketches that one set alone has lead to no key that two sets share.
    sketches = first.select("sid", "n_shingles", F.posexplode("sketches").alias("slot", "hash"))
    shared = sketches.groupBy("slot", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    left = (
        sketches.join(shared, ["slot", "hash"])
        .groupBy("sid", "n_shingles")
        .agg(F.collect_list(F.when(F.col("slot") < side, F.struct("slot", "hash"))).alias("x"), F.collect_list(F.when(F.col("slot") >= side, F.struct("slot", "hash"))).alias("y"))
    )
    keys = left.select("sid", "n_shingles", F.explode("x").alias("x"), "y").select("sid", "n_shingles", "x", F.explode("y").alias("y"))
    keys = scratch.keep(keys.select("sid", "n_shingles", F.xxhash64("x.slot", "x.hash", "y.slot", "y.hash").alias("key")), "keys")
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = scratch.keep(keys.join(many, "key"), "buckets")
    scratch.drop(keys)

    members = buckets.select("sid").distinct().join(first.select("sid", "doc_id", "text_id"), "sid")
    texts = given.join(members, ["doc_id", "text_id"]).dropDuplicates(["doc_id", "text_id"]).select("sid", "text")
    items = scratch.keep(texts.mapInArrow(_full(k), "sid long, items array<long>"), "sets")
    verify = Verifier(items, threshold, scratch)
    fits = "100 * least(n, m) >= {t} * greatest(n, m)".format(t=threshold)  # else the sizes alone rule it out

    def placed(groups: DataFrame | None) -> DataFrame:
        """The buckets that hold more than one group of sets known to hang together, with their size and groups."""
        at = buckets.withColumn("c", F.col("sid")) if groups is None else buckets.join(groups, "sid", "left").withColumn("c", F.coalesce("c", "sid"))
        sizes = at.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.approx_count_distinct("c").alias("groups"))
        return scratch.keep(at.join(sizes.where("lo < hi").drop("lo", "hi"), "key"), "mixed")

    def with_leader(at: DataFrame, rank) -> DataFrame:
        """Pairs of each set with the leader of each of its buckets."""
        lead = at.groupBy("key").agg(F.min_by(F.struct("sid", "n_shingles", "c"), rank).alias("l"))
        pairs = at.select("key", "sid", F.col("n_shingles").alias("n"), "c").join(lead, "key").where("c <> l.c").withColumn("m", F.col("l.n_shingles")).where(fits)
        return pairs.select(F.least("sid", "l.sid").alias("a"), F.greatest("sid", "l.sid").alias("b")).distinct()

    def with_leaders(at: DataFrame) -> DataFrame:
        """Pairs of each set with the first LEADERS of each of its buckets."""
        w = Window.partitionBy("key").orderBy(F.xxhash64("sid"), "sid")
        first = at.select("key", F.struct("sid", "n_shingles", "c").alias("l"), F.row_number().over(w).alias("_n")).where(F.col("_n") <= LEADERS)
        lead = first.groupBy("key").agg(F.array_sort(F.collect_list("l")).alias("leaders"))
        # A bucket's leaders come as one list, and a set names each of its leaders once, however many buckets they meet in.
        met = at.select("key", "sid", F.col("n_shingles").alias("n"), "c").join(lead, "key")
        close = F.expr(f"transform(filter(leaders, l -> l.c <> c AND 100 * least(n, l.n_shingles) >= {threshold} * greatest(n, l.n_shingles)), l -> l.sid)")
        each = met.select("sid", close.alias("leaders")).where("size(leaders) > 0").groupBy("sid").agg(F.array_distinct(F.flatten(F.collect_set("leaders"))).alias("leaders"))
        pairs = each.select("sid", F.explode("leaders").alias("other"))
        return pairs.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()

    def by_rarest(own: DataFrame, prefix: DataFrame) -> DataFrame:
        """Pairs of sets of different groups that have a bucket and an item of their prefixes in common."""
        mine = prefix.select("item", F.col("sid").alias("a"), F.col("n_shingles").alias("n"), F.col("c").alias("ca"), F.col("rank").alias("i"))
        others = prefix.select("item", F.col("sid").alias("b"), F.col("n_shingles").alias("m"), F.col("c").alias("cb"), F.col("rank").alias("j"))
        # The first item in common, at ranks i and j, leaves at most 1 + least(n - i, m - j) of them.
        enough = f"(100 + {threshold}) * (1 + least(n - i, m - j)) >= {threshold} * (n + m)"
        pairs = mine.join(others, "item").where("a < b and ca <> cb").where(fits).where(enough).select("a", "b").distinct()
        keyed = pairs.join(own.select(F.col("sid").alias("a"), F.col("keys").alias("of_a")), "a").join(own.select(F.col("sid").alias("b"), F.col("keys").alias("of_b")), "b")
        return keyed.where(F.arrays_overlap("of_a", "of_b")).select("a", "b")

    links = scratch.keep(verify(with_leader(placed(None), F.col("sid"))), "links")
    # Buckets of copies mostly hang together by now; a second leader finds what the first was too far from.
    drawn = placed(_grouped(links)).where("2 * groups <= sets")
    links = links.unionByName(scratch.keep(verify(with_leader(drawn, F.xxhash64("key", "sid"))), "links"))
    links = links.unionByName(scratch.keep(verify(with_leaders(placed(_grouped(links)).where("sets > 2"))), "links"))
    # What hangs together over any number of links is not paired, or a group of near copies would be, with the square of its size.
    apart = placed(_hanging(links, scratch)).where(f"sets > {LEADERS} + 1")  # of others all pairs have been compared
    own = scratch.keep(apart.groupBy("sid", "n_shingles", "c").agg(F.collect_list("key").alias("keys")), "apart")
    prefix = scratch.keep(_rarest(own.drop("keys"), items, threshold), "prefixes")
    # Nor is what hangs together by way of one of the sets that have an item: each is compared with that first.
    links = links.unionByName(scratch.keep(verify(with_leader(prefix.withColumnRenamed("item", "key"), F.xxhash64("key", "sid"))), "links"))
    prefix = prefix.drop("c").join(_hanging(links, scratch), "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    links = links.unionByName(scratch.keep(verify(by_rarest(own, scratch.keep(prefix, "prefixes"))), "links"))

    of = first.select("sid", "doc_id")
    named = links.join(of.withColumnsRenamed({"sid": "a", "doc_id": "first"}), "a").join(of.withColumnRenamed("sid", "b"), "b").select("first", "doc_id")
    c = components(named.unionByName(same.select("first", "doc_id")).withColumnsRenamed({"first": "a", "doc_id": "b"}), scratch)
    out = signed_.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    out = out.join(c.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
