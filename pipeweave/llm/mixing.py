"""Operator 2: mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

The rows of each source, in an order drawn by hash, are dealt into blocks. With weight p out of Q, block
i of a source is released at slot floor(i * Q / p) and due by ceil((i + 1) * Q / p); each slot goes to
the released block with the earliest deadline. Weights that sum to one can always be met so, and at
every slot each source has had its share to less than one block.

The schedule repeats after Q slots, so one period, a table of Q entries made from the weights alone,
places any number of blocks: block j takes slot Q * (j div p) + offset[j mod p]. When a source runs
out, the others go on by their own weights, in a period of their own; so no row is dropped or repeated.
Only the number of rows of each source, one number a source, reaches the driver, and the schedule has as
many entries as there are slots in a period for each time that sources run out: a mix is of sources that
somebody has given weights, thousands at most, not of every domain of a crawl.

Rows: one per input row. Null sources count as the source ''. Sources without a weight, or of weight 0,
come with weight 1 after all others have run out. Repeated rows get places of their own. An empty
table gives an empty table. Columns of the input that have the name of a new column are replaced; all others stay.
Texts are not looked at, only carried. Rows of equal doc_id, null included, are ordered by a hash of all columns.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.llm.names import fresh
from pipeweave.llm.storage import Scratch

NEW = ("mix_block", "mix_slot", "mix_place")


def period(parts: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(parts) slots, by earliest deadline first."""
    q = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(parts)]  # release, source, block
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    out: dict[str, list[int]] = {s: [] for s in parts}
    heapq.heapify(waiting)
    for slot in range(q):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * q // parts[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out[s].append(slot)
        if i + 1 < parts[s]:
            heapq.heappush(waiting, ((i + 1) * q // parts[s], s, i + 1))
    return out


def phases(blocks: dict[str, int], parts: dict[str, int]) -> dict[str, list[tuple[int, int, int, list[int]]]]:
    """For each source: (first block, first slot, slots of a period, its slots in it), until it runs out."""
    left = {s: n for s, n in blocks.items() if n}
    used = dict.fromkeys(left, 0)
    out: dict[str, list] = {s: [] for s in left}
    start = 0
    while left:
        active = {s: parts.get(s, 0) for s in left if parts.get(s, 0) > 0} or dict.fromkeys(left, 1)
        mine = period(active)
        q = sum(active.values())
        for s in active:
            out[s].append((used[s], start, q, mine[s]))
        # The phase ends with the last block of the source that runs out first.
        end = min((left[s] - 1) // p * q + mine[s][(left[s] - 1) % p] for s, p in active.items())
        for s, p in active.items():
            n = end // q * p + sum(x <= end % q for x in mine[s])
            used[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start += end + 1
    return out


def tempered(rows: dict[str, int], slots: int, power: float) -> dict[str, int]:
    """Weights in proportion to rows ** power, in whole parts of about `slots`, one at least."""
    total = sum(n**power for n in rows.values())
    return {s: max(1, round(slots * n**power / total)) for s, n in rows.items()}


def _slot(block: Column, plan: dict[str, list], source: Column) -> Column:
    """The slot of a block, from the phase of its source that it falls in."""
    kind = "map<string,array<struct<block:bigint,start:bigint,q:bigint,slots:array<bigint>>>>"
    of = F.from_json(F.lit(_json(plan)), kind)
    phase = F.element_at(F.filter(F.element_at(of, source), lambda x: x["block"] <= block), -1)
    i = block - phase["block"]
    p = F.size(phase["slots"])
    return phase["start"] + F.floor(i / p) * phase["q"] + F.element_at(phase["slots"], (i % p + 1).cast("int"))


def _json(plan: dict[str, list]) -> str:
    import json

    return json.dumps({s: [{"block": b, "start": t, "q": q, "slots": x} for b, t, q, x in rows] for s, rows in plan.items()})


def mix_sources(
    docs: DataFrame,
    scratch: Scratch,
    weights: dict[str, int] | None = None,
    block_rows: int = 16,
    slots: int = 1000,
    power: float = 0.5,
    salts: int = 1024,
    seed: int = 17,
) -> DataFrame:
    """docs with mix_block, mix_slot and mix_place (long): place orders all rows, block by block.

    weights: whole parts by source; without them, sources get parts of about `slots` in proportion to
    their rows to the power `power`. A source is numbered in `salts` shares, each of them sorted on its
    own, so that one that holds most of the rows is no single task.
    """
    docs = docs.drop(*NEW)
    source = F.coalesce("source", F.lit(""))
    drawn = F.xxhash64(F.lit(seed), "doc_id")
    s, h, salt, tie, at, start = fresh(docs, "_s", "_h", "_salt", "_tie", "_r", "_first")
    keyed = docs.withColumns({s: source, h: drawn, salt: F.pmod(drawn, F.lit(salts)), tie: F.xxhash64(*[f"`{c}`" for c in docs.columns])})
    counts = scratch.keep(keyed.groupBy(s, salt).agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy(s).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(s, salt, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    rows = {r[s]: r["n"] for r in counts.groupBy(s).agg(F.sum("n").alias("n")).collect()}  # one row a source
    parts = weights if weights is not None else tempered(rows, slots, power)
    plan = phases({s: -(-n // block_rows) for s, n in rows.items()}, parts)

    own = F.row_number().over(Window.partitionBy(s, salt).orderBy(h, "doc_id", tie))
    ranked = keyed.withColumn(at, own - 1).join(first, [s, salt]).withColumn(at, F.col(at) + F.col(start))
    out = ranked.withColumn("mix_block", F.floor(F.col(at) / block_rows)).withColumn("mix_slot", _slot(F.col("mix_block"), plan, F.col(s)))
    return out.withColumn("mix_place", F.col("mix_slot") * block_rows + F.col(at) % block_rows).select(*[f"`{c}`" for c in docs.columns], *NEW)


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows in the order of their places, in range partitions, without the new columns."""
    return mixed.orderBy("mix_place").drop(*NEW)
