"""Operator 13: packing documents into sequences of fixed size, with lower bounds that say when to stop.

Documents become pieces of at most `size` tokens. Pieces are dealt to partitions of bounded size; each is
packed by best fit, longest first. Dual feasible functions give a lower bound of a partition's sequences: a partition
that meets its bound is certified and its full sequences are done. Partitions with a gap exchange their documents,
together with what lies in sequences that are not full, are dealt anew and packed again. Where these meet their bound, or a deal brings
nothing, all documents are dealt to partitions of twice the size. It ends when the sequences meet the bound of the whole, or when
partitions of eight times the size bring nothing. A new deal that needs no fewer sequences than the old one is dropped.

The driver sees one count for each length, `size` at most, and totals. Rows carry lengths and whatever columns
came with them; texts and ids need not be among them.

Rows: one a piece. Null text counts as empty and is one piece of the end token; null doc_ids are documents like
others, as are repeated rows. A document longer than `size` is cut, its first piece may be the shorter one. An empty table gives an empty
table. Texts are encoded one at a time, of any length. Columns of the input that have the name of a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from pipeweave.llm import bytetokens
from pipeweave.llm.storage import Scratch

#: Pieces dealt to a partition; bounds a task's memory and time.
PER_PART = 8192
_PLACES = 1 << 20  # sequences of one partition at most; part of their numbers
_WIDEST = 8  # partitions may grow so many times where nothing else closes the gap
NEW = ("piece", "start", "length", "ids")


def _cutter(path: str, size: int, end: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bytetokens.load(path, plain=False)
        for batch in batches:
            others = [x for x in batch.schema.names if x != text]
            column, row, done, held = batch.column(batch.schema.get_field_index(text)), [], [], 0
            for i in range(len(batch)):
                ids = np.append(model.encode([column[i].as_py() or ""])[0], np.int32(end)).astype("<u4")
                first = (len(ids) - 1) % size + 1
                cuts = [0, *range(first, len(ids) + 1, size)]
                done += [(k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                row += [i] * (len(cuts) - 1)
                held += len(ids)
                if held > 1 << 20 or i == len(batch) - 1:
                    new = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.select(others).take(pa.array(row)).columns, *new], [*others, *NEW])
                    row, done, held = [], [], 0

    return run


def cut(docs: DataFrame, path: str, size: int = 2048, end: int = 0, text: str = "text") -> DataFrame:
    """docs as pieces: piece (int, from 0), start and length (long, in tokens), ids (little-endian 32-bit numbers) in place of the text.

    A document's ids are those of its text, where strings of special tokens are special tokens, and then `end`. Map only.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in NEW])
    new = [StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType())]
    return docs.mapInArrow(_cutter(path, size, end, text), StructType([f for f in docs.schema if f.name != text] + new))


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, by best fit in order of falling length.

    Open sequences are kept by the room that is left; a bit for each room that occurs finds the tightest one.
    """
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, n = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, x in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = size, n
            n += 1
        where[i], offset[i] = at, size - room
        if room > x:
            by_room[room - x].append(at)
            rooms |= 1 << (room - x)
    return where, offset


def lower_bound(counts: np.ndarray, size: int) -> int:
    """No packing of counts[x] pieces of x tokens has fewer sequences.

    A dual feasible function f has sums of at most 1 over whatever fits one sequence, so the sum of f over all pieces bounds
    their number. Families: f(x) = x; pieces above size - m count whole and those below m not at all; and
    rounding down to multiples of 1 / k, with whole multiples of 1 / (k + 1) as they are. All in whole numbers.
    """
    x, n = np.arange(size + 1, dtype=np.int64), counts.astype(np.int64)
    up = lambda total, unit: -(-int(total) // unit)
    mass, number = np.concatenate(([0], np.cumsum(x * n))), np.concatenate(([0], np.cumsum(n)))
    m = np.arange(0, size // 2 + 1)
    whole = number[-1] - number[size - m + 1]
    found = up((whole * size + mass[size - m + 1] - mass[m]).max(), size)
    for k in range(1, 101):
        down = (k + 1) * x // size
        value = np.where((k + 1) * x % size == 0, k * x, size * down)
        found = max(found, up((value * n).sum(), k * size))
    return found


def _packer(size: int):
    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        where, offset = best_fit(lengths, size)
        bins = int(where.max(initial=-1)) + 1
        fill = np.bincount(where, weights=lengths, minlength=bins).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
        for name, values in (("_bin", where), ("_offset", offset), ("_fill", fill[where]), ("_gap", np.full(len(where), bins - bound))):
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group

    return run


def pack(pieces: DataFrame, scratch: Scratch, size: int = 2048, per_part: int = PER_PART, most_rounds: int = 12) -> DataFrame:
    """pieces with sequence_id and offset (long). pieces: length (long, 1 to size) and any other columns, all of which are carried along."""
    if per_part > _PLACES // _WIDEST // 2:
        raise ValueError("too many pieces for a partition")
    pieces = pieces.drop("sequence_id", "offset")
    own = [f"`{c}`" for c in pieces.columns]
    todo = scratch.keep(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")

    def histogram(df: DataFrame) -> np.ndarray:
        out = np.zeros(size + 1, dtype=np.int64)
        for length, n in df.groupBy("length").count().collect():  # one row a length
            out[length] = n
        return out

    def union(some: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, some)

    def deal(df: DataFrame, n: int, turn: int, per_part: int) -> DataFrame:
        parts = -(-n // per_part)
        dealt = df.withColumn("_part", F.pmod(F.xxhash64("_uid", F.lit(turn)), F.lit(parts)).cast("long"))
        more = [StructField(c, LongType()) for c in ("_bin", "_offset", "_fill", "_gap")]
        packed = dealt.groupBy("_part").applyInArrow(_packer(size), StructType(dealt.schema.fields + more))
        name = F.lit(turn) * F.lit(1 << 56) + F.col("_part") * F.lit(_PLACES) + F.col("_bin")
        return scratch.keep(packed.withColumn("sequence_id", name).drop("_part", "_bin"), f"deal-{turn}")

    counts = histogram(todo)
    n = int(counts.sum())
    if not n:
        return todo.select(*own, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    least, dealt_to = lower_bound(counts, size), per_part
    now, done, idle = deal(todo, n, 0, per_part), [], False
    number = lambda df: df.where("_offset = 0").count()
    is_open = (F.col("_gap") > 0) | (F.col("_fill") < size)
    total = number(now)
    for turn in range(1, most_rounds + 1):
        if total <= least:
            break
        fixed, exchanged = now.where(~is_open), now.where(is_open)
        counts = histogram(exchanged)
        had, some = number(exchanged), int(counts.sum())
        if idle or had <= lower_bound(counts, size):  # what is full could help: all documents, in larger partitions
            if n <= dealt_to or dealt_to >= _WIDEST * per_part:
                break
            exchanged, fixed, had, some, dealt_to = union([*done, now]), None, total, n, 2 * dealt_to
        again = deal(exchanged.select(*own, "_uid"), some, turn, dealt_to)
        won = had - number(again)
        idle = won <= 0
        if not idle:
            now, done, total = again, [*done, fixed] if fixed is not None else [], total - won
    return union([*done, now]).select(*own, "sequence_id", F.col("_offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence, from packed pieces with their ids. A sequence is of bounded size."""
    one = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    return one.select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
