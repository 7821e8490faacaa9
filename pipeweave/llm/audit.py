"""Operator 12: what a chain of filters does in any order, from one count of each set of failed filters.

Each document has a mask of the filters that it fails. Documents are counted by part and mask; a zeta
transform over subsets turns the counts of a part into the survivors of every set of filters:
survivors(S) = documents whose mask has nothing of S. Whatever an order of filters does is then a difference
of neighbouring sets: the step that applies f after the filters of S removes survivors(S) - survivors(S + f). The
same holds for labelled documents. Nothing is looked at once per order, and 2 ** filters numbers a part are kept.

Rows: a document is a row. Null text counts as empty, a null part as ''. A document is a copy if a row of a smaller doc_id
has the same text; rows of one doc_id are not copies of each other, and a row without a doc_id is no copy and has
none. Labels: a document has a label if any row of its doc_id says so; without a row or doc_id it has none. Repeated
rows count each. An empty table gives no rows. Only the columns named are read, so others clash with
nothing. Texts of any length: the words of one text are in memory at a time.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.storage import Scratch

_SALTS = 64  # rows without a doc_id are dealt to so many keys
#: More filters have too many orders to list.
MOST = 7


def _mask(conditions: dict[str, Column]) -> Column:
    out = F.lit(0)
    for i, c in enumerate(conditions.values()):
        out = out + F.when(c, 1 << i).otherwise(0)
    return out.cast("int")


def masks(docs: DataFrame, conditions: dict[str, Column], part: str = "lang", text: str = "text", copies: bool = True) -> DataFrame:
    """doc_id, part, mask (bit i: the i-th condition holds, true is a failure) and digest of the text, in one pass without a shuffle.

    conditions are on the column _text, which is the text without nulls. Null conditions do not hold.
    """
    t = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("_text"))
    digest = F.unhex(F.sha2("_text", 256)) if copies else F.lit(None).cast("binary")
    return t.select("doc_id", "part", _mask(conditions).alias("mask"), digest.alias("digest"))


def mask_counts(found: DataFrame, labels: DataFrame, flags: dict[str, str], copy_bit: int | None, scratch: Scratch) -> DataFrame:
    """part, mask, n and one count for each flag. flags: SQL conditions on rows of labels. copy_bit: set for copies.

    Copies of one text are never gathered: all rows that have a doc_id are counted as copies, and the rows of the smallest
    doc_id of each text, one row a text after partial aggregation, are counted back.
    """
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part", "mask"), F.lit(_SALTS)).cast("int")).otherwise(F.lit(-1))
    rows = found.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", salt).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*[F.max(F.expr(c)).alias(f) for f, c in flags.items()]).withColumn("salt", F.lit(-1))
    joined = rows.join(said, ["id", "salt"], "left").select("doc_id", "digest", "part", "mask", "n", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])
    counts = lambda sign=1: [F.sum(F.col("n") * sign).alias("n"), *[F.sum(F.when(F.col(f), F.col("n") * sign).otherwise(0)).alias(f) for f in flags]]
    if copy_bit is None:
        return joined.groupBy("part", "mask").agg(*counts())
    kept = scratch.keep(joined, "masks")
    bit = 1 << copy_bit
    copied = F.when(F.col("doc_id").isNotNull(), F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask"))
    # Rows of one doc_id and text differ in part at most.
    one = kept.where("doc_id is not null").groupBy("digest", "doc_id").agg(F.collect_list(F.struct("part", "mask", "n", *flags)).alias("rows"))
    first = one.groupBy("digest").agg(F.min_by("rows", "doc_id").alias("rows")).select(F.inline("rows"))
    back = first.groupBy("part", "mask").agg(*counts())
    taken = first.groupBy("part", F.col("mask").bitwiseOR(F.lit(bit)).alias("mask")).agg(*counts(-1))
    every = kept.groupBy("part", copied.alias("mask")).agg(*counts())
    return every.unionByName(back).unionByName(taken).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", *flags)])


def _dense(entries: str, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.element_at(entries, m), F.lit(0).cast("long")))


def _swept(sums: str, bit: int) -> Column:
    return F.transform(sums, lambda x, m: x + F.when(m.bitwiseAND(F.lit(bit)) != 0, F.get(F.col(sums), m.bitwiseXOR(F.lit(bit)))).otherwise(F.lit(0)))


def survivors(counts: DataFrame, n_filters: int) -> DataFrame:
    """part and, for n and each flag of counts, an array by set of filters: how many documents fail none of the set.

    The zeta transform: one sweep a filter adds to each set of failed filters the counts of the set without it, which leaves at M
    the documents that fail nothing outside M. Those that fail nothing of S are at the complement of S.
    """
    values = [c for c in counts.columns if c not in ("part", "mask")]
    size = 1 << n_filters
    dense = counts.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in values])  # 2 ** filters entries at most
    for c in values:
        dense = dense.withColumn(c, _dense(c, size))
    for i in range(n_filters):
        for c in values:
            dense = dense.withColumn(c, _swept(c, 1 << i))
    return dense.select("part", *[F.reverse(c).alias(c) for c in values])


def orders(dense: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of the filters and step, from survivors(). names: one letter a filter."""
    k = len(names)
    if k > MOST:
        raise ValueError(f"orders of more than {MOST} filters are too many to list; survivors() gives every set")
    flags = [c for c in dense.columns if c not in ("part", "n")]
    listed = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    row = dense.select("*", F.explode(listed).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = lambda letter: F.get(F.array(*[F.lit(1 << i) for i in range(k)]), F.position(letter, F.lit(names)) - 1)
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda s, i: s + F.when(i > 0, bit(F.substring(F.col("filter_order"), i, F.lit(1)))).otherwise(0))
    row = row.withColumn("_before", before).withColumn("_bit", bit(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))))
    row = row.withColumn("_after", F.col("_before") + F.col("_bit"))
    full = (1 << k) - 1
    gone = lambda c, s, t: F.get(c, s) - F.get(c, t)
    removed = gone("n", F.col("_before"), F.col("_after"))
    others = F.lit(full) - F.col("_bit")
    # Sets of equal size without the filter come before it in equally many orders.
    weights = F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)).cast("long") if s < k else F.lit(0).cast("long") for s in range(k + 1)])
    shapley = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(F.col("_bit")) == 0),
        F.lit(0).cast("long"),
        lambda a, s: a + F.get(weights, F.bit_count(s)) * gone("n", s, s + F.col("_bit")),
    )
    return row.select(
        "part", "filter_order", "step",
        F.get("n", F.col("_after")).alias("kept"),
        removed.alias("removed"),
        (gone("n", F.lit(0), F.col("_bit")) - removed).alias("redundant"),
        gone("n", others, F.lit(full)).alias("unique_fails"),
        *[gone(f, F.col("_before"), F.col("_after")).alias(f"{f}_lost") for f in flags],
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], flags: dict[str, str], scratch: Scratch, copies: str | None = None, part: str = "lang", text: str = "text") -> DataFrame:
    """Every order of the filters, step by step, within each part. copies: letter of the filter that takes out copies, after the others."""
    if any(len(x) != 1 for x in [*conditions, *([copies] if copies else [])]):
        raise ValueError("a filter's name is one letter")
    found = masks(docs, conditions, part, text, copies is not None)
    counts = mask_counts(found, labels, flags, len(conditions) if copies else None, scratch)
    names = "".join(conditions) + (copies or "")
    return orders(survivors(counts, len(names)), names)
