"""Operator 1: SentencePiece encoding and decoding over a lattice of pieces.

Encoding a batch of texts is relational, in arrays of one Arrow batch: words are runs that start where a
blank follows a non-blank (no piece of the model crosses that border, which is checked); distinct words
are exploded into all substrings up to the longest piece; substrings are equi-joined with the piece
table; the edges found stay grouped by word; a fold over each word's edges gives its pieces; and words
are joined back to the texts. Every step is map-only: nothing is shuffled, whatever the vocabulary of
the corpus.

lattice() is the same with Spark's own join, grouping and aggregate, over a table of distinct words, for
unigram tables. It is not the query's way: to bring every word of every text to its encoding and back would
shuffle one row a word, measured as 3.8 times the input each way, of 1.5 that are allowed.

Fold: "merge" replays byte-pair merges, best score first, leftmost of equals, "viterbi" takes the path
of the greatest total score. The public 32k model is a byte-pair model, for which the best total score
is not what its own library gives, so "merge" is the default. Characters without a piece become bytes.

Texts: ' ' and U+2581 are one and the same to the model, and decoding gives ' '. Every other text comes
back as it was. Null and empty texts have no pieces; with check, the text column is gone and both count as
having come back. Repeated rows are encoded alike; other columns stay, those of new names are replaced. An
empty table gives an empty table. Texts are encoded a million characters at a time, longer ones whole, at
some 70 bytes a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeweave.llm.words import Powers, mix

_U = np.uint64
_BLANK = "▁"
_AT_ONCE = 1 << 20  # characters of text handled together; bounds memory
_POWERS = Powers(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """A piece table: text, score, and which pieces are ordinary ones."""

    texts: list[str]
    scores: np.ndarray
    ordinary: np.ndarray
    bytes_: np.ndarray  # id of each byte's piece, -1 without
    unknown: int

    def __post_init__(self) -> None:
        self.longest = max((len(t) for t, o in zip(self.texts, self.ordinary, strict=True) if o), default=1)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, self.longest + 1):
            ids = np.array([i for i, t in enumerate(self.texts) if self.ordinary[i] and len(t) == n], dtype=np.int32)
            if len(ids):
                chars = np.frombuffer("".join(self.texts[i] for i in ids).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                at = np.arange(0, n * len(ids), n)
                h = _hash(_prefix(chars), at, at + n)
                order = np.argsort(h)
                if (np.diff(h[order]) == 0).any():
                    raise ValueError("two pieces have one hash")
                self.by_length[n] = (h[order], ids[order])
        if any(_BLANK in t.lstrip(_BLANK) for t, o in zip(self.texts, self.ordinary, strict=True) if o):
            raise ValueError("a piece has a blank after another character")
        raw = [bytes([int(t[3:5], 16)]) if b else t.replace(_BLANK, " ").encode() if o else b"" for t, o, b in zip(self.texts, self.ordinary, self._is_byte(), strict=True)]
        raw[self.unknown] = " ⁇ ".encode()
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_at = np.concatenate(([0], np.cumsum([len(x) for x in raw])))

    def _is_byte(self) -> np.ndarray:
        out = np.zeros(len(self.texts), dtype=bool)
        out[self.bytes_[self.bytes_ >= 0]] = True
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The piece table of a SentencePiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) for i in range(n)]
    bytes_ = np.full(256, -1, dtype=np.int32)
    for i in range(n):
        if m.is_byte(i):
            bytes_[int(m.id_to_piece(i)[3:5], 16)] = i
    return Pieces([m.id_to_piece(i) for i in range(n)], np.array([m.get_score(i) for i in range(n)]), ~np.array(special), bytes_, m.unk_id())


def _prefix(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _POWERS.upto(len(chars) + 1)
    total = np.zeros(len(chars) + 1, dtype=_U)
    np.cumsum(mix(chars) * up[: len(chars)], out=total[1:])
    return total, down


def _hash(prefix: tuple[np.ndarray, np.ndarray], s: np.ndarray, e: np.ndarray) -> np.ndarray:
    total, down = prefix
    return (total[e] - total[s]) * down[s] + (e - s).astype(_U)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] numbers, then those of the next."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _edges(chars: np.ndarray, end: np.ndarray, table: Pieces) -> np.ndarray:
    """edges[n, i]: the piece of the n characters from i on within i's word, or -1. end: of each character's word."""
    prefix, at = _prefix(chars), np.arange(len(chars))
    edges = np.full((table.longest + 1, len(chars)), -1, dtype=np.int32)
    for n, (known, ids) in table.by_length.items():
        s = at[at + n <= end]
        if len(s):
            h = _hash(prefix, s, s + n)
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[k] == h
            edges[n, s[hit]] = ids[k[hit]]
    return edges


def _merge(edges: np.ndarray, word: np.ndarray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of all words, by byte-pair merges. word: of each character."""
    start, end, w = np.arange(len(word)), np.arange(1, len(word) + 1), word
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(start):
        size = np.concatenate((end[1:] - start[:-1], [0]))
        fits = (size > 0) & (size <= table.longest) & np.concatenate((w[1:] == w[:-1], [False]))
        piece = np.where(fits, edges[np.where(fits, size, 0), start], -1)
        score = np.where(piece >= 0, table.scores[piece], -np.inf)
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        count = np.diff(np.concatenate((first, [len(w)])))
        best = np.repeat(np.maximum.reduceat(score, first), count)
        more = best > -np.inf
        if not more.all():
            done.append((start[~more], end[~more]))
        hit = more & (score == best)
        # Of best pairs that overlap, every second merges, from the left.
        run = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
        if len(run):
            back = np.arange(len(hit)) - np.repeat(run, np.diff(np.concatenate((run, [len(hit)]))))[-len(hit) :] if run[0] == 0 else np.concatenate((np.zeros(run[0], dtype=np.int64), np.arange(run[0], len(hit)) - np.repeat(run, np.diff(np.concatenate((run, [len(hit)]))))))
            hit &= back % 2 == 0
        gone = np.concatenate(([False], hit[:-1]))
        end = np.where(hit, np.concatenate((end[1:], [0])), end)
        stay = more & ~gone
        start, end, w = start[stay], end[stay], w[stay]
    s = np.concatenate([x for x, _ in done]) if done else np.zeros(0, dtype=np.int64)
    e = np.concatenate([x for _, x in done]) if done else np.zeros(0, dtype=np.int64)
    order = np.argsort(s)
    return s[order], e[order]


def _viterbi(edges: np.ndarray, word: np.ndarray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces on each word's path of the greatest score; of equals the one with the longest last piece."""
    n = len(word)
    low = table.scores[table.ordinary].min() - 10 if table.ordinary.any() else -10.0
    cost = np.where(edges >= 0, table.scores[edges], -np.inf)
    cost[1] = np.where(edges[1] >= 0, cost[1], low)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    size = np.diff(np.concatenate((first, [n])))
    best, back = np.zeros(n + 1 + len(first)), np.zeros(n + 1 + len(first), dtype=np.int64)
    base = first + np.arange(len(first))  # a word of k characters has k + 1 borders
    for i in range(1, int(size.max(initial=0)) + 1):
        some = np.flatnonzero(size >= i)
        top, length = np.full(len(some), -np.inf), np.ones(len(some), dtype=np.int64)
        for m in range(1, min(i, table.longest) + 1):
            total = best[base[some] + i - m] + cost[m, first[some] + i - m]
            better = total >= top
            top, length = np.where(better, total, top), np.where(better, m, length)
        best[base[some] + i], back[base[some] + i] = top, length
    starts, ends, at, some = [], [], size.copy(), np.arange(len(first))
    while len(some):
        m = back[base[some] + at[some]]
        ends.append(first[some] + at[some])
        at[some] -= m
        starts.append(first[some] + at[some])
        some = some[at[some] > 0]
    s, e = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (starts, ends))
    order = np.argsort(s)
    return s[order], e[order]


def encode_texts(texts: list[str], table: Pieces, fold: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and each text's number of ids."""
    text = "".join([_BLANK + t for t in texts if t]).replace(" ", _BLANK)
    if not text:
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    long = np.array([len(t) + 1 if t else 0 for t in texts])
    at = np.cumsum(long) - long
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = chars == ord(_BLANK)
    new = blank & ~np.concatenate(([False], blank[:-1]))
    new[at[long > 0]] = True
    s = np.flatnonzero(new)
    e = np.concatenate((s[1:], [len(chars)]))
    _, place, inverse = np.unique(_hash(_prefix(chars), s, e), return_index=True, return_inverse=True)

    size = (e - s)[place]
    own = chars[_spread(s[place], size)]
    word = np.repeat(np.arange(len(place)), size)
    edges = _edges(own, np.repeat(np.cumsum(size), size), table)
    ps, pe = (_merge if fold == "merge" else _viterbi)(edges, word, table)
    ids, of = edges[pe - ps, ps], word[ps]
    if (ids < 0).any():  # a character without a piece: its bytes, or the unknown piece
        count = np.ones(len(ids), dtype=np.int64)
        lost = np.flatnonzero(ids < 0)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in own[ps[lost]]]
        spelt = [table.bytes_[list(x)] for x in raw]
        spelt = [x if (x >= 0).all() else np.array([table.unknown], dtype=np.int32) for x in spelt]
        count[lost] = [len(x) for x in spelt]
        ids = np.repeat(ids, count)
        ids[_spread((np.cumsum(count) - count)[lost], count[lost])] = np.concatenate(spelt)
        of = np.repeat(of, count)
    per_word = np.bincount(of, minlength=len(place))
    each = per_word[inverse]
    out = ids[_spread((np.cumsum(per_word) - per_word)[inverse], each)]
    ends = np.concatenate(([0], np.cumsum(each)))
    row_word = np.searchsorted(s, np.concatenate((at, [len(chars)])))
    return out.astype(np.int32), np.where(long > 0, np.diff(ends[row_word]), 0)


def decode_ids(ids: np.ndarray, count: np.ndarray, table: Pieces) -> list[str]:
    """The texts of runs of ids. Bytes that are not UTF-8 become U+FFFD."""
    size = np.diff(table.raw_at)[ids]
    raw = table.raw[_spread(table.raw_at[ids], size)].tobytes()
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))]
    out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [t[1:] if t.startswith(" ") else t for t in out]


def _parts(texts: list[str | None]) -> Iterator[list[str]]:
    """Consecutive texts that are handled together."""
    some, n = [], 0
    for t in texts:
        if some and n + len(t or "") > _AT_ONCE:
            yield some
            some, n = [], 0
        some.append(t or "")
        n += len(t or "")
    if some:
        yield some


def _encoder(path: str, fold: str, text: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(path)
        for whole in batches:
            i = whole.schema.get_field_index(text)
            others = [x for x in whole.schema.names if x != text or not check]
            done = 0
            for part in _parts(whole.column(i).to_pylist()):
                batch = whole.slice(done, len(part))
                done += len(part)
                ids, count = encode_texts(part, table, fold)
                at = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
                columns = [batch.column(whole.schema.get_field_index(x)) for x in others]
                columns += [pa.ListArray.from_arrays(at, pa.array(ids)), pa.array(count, pa.int64())]
                names = [*others, "pieces", "n_pieces"]
                if check:
                    back = decode_ids(ids, count, table)
                    columns.append(pa.array([a == b.replace(_BLANK, " ") for a, b in zip(back, part, strict=True)]))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _fields(df: DataFrame, without: set[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without]


def encode(df: DataFrame, path: str, text: str = "text", fold: str = "merge", check: bool = False) -> DataFrame:
    """df with pieces (array of ids) and n_pieces (long); columns of these names are replaced.

    With check, the pieces are decoded again in the same pass and round_trip tells whether that gave the
    text; the text itself is left out then.
    """
    if fold not in ("merge", "viterbi"):
        raise ValueError("fold must be merge or viterbi")
    df = df.drop("pieces", "n_pieces", *(["round_trip"] if check else []))
    schema = [*_fields(df, {text} if check else set()), "pieces array<int>", "n_pieces long", *(["round_trip boolean"] if check else [])]
    return df.mapInArrow(_encoder(path, fold, text, check), ", ".join(schema))


def decode(df: DataFrame, path: str, pieces: str = "pieces", text: str = "decoded") -> DataFrame:
    """df with the text of its pieces; null pieces give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(path)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(pieces))
            ids = col.flatten().to_numpy(zero_copy_only=False)
            count = np.array([0 if x is None else x for x in col.value_lengths().to_pylist()], dtype=np.int64)
            given = decode_ids(ids, count, table)
            new = pa.array([t if ok else None for t, ok in zip(given, col.is_valid().to_pylist(), strict=True)], pa.string())
            others = [x for x in batch.schema.names if x != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in others], new], [*others, text])

    return df.mapInArrow(run, ", ".join([*_fields(df, {text}), f"`{text}` string"]))


def piece_rows(spark: SparkSession, table: Pieces) -> DataFrame:
    """piece, id, score of each ordinary piece: some ten thousand rows, whatever the text."""
    rows = [(t, i, float(table.scores[i])) for i, t in enumerate(table.texts) if table.ordinary[i]]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def lattice(words: DataFrame, known: DataFrame, longest: int, unknown: int) -> DataFrame:
    """word, pieces: the path of the greatest total score through each distinct word's lattice, all of it in Spark.

    Substrings of up to `longest` characters are exploded and joined with the piece table, edges are grouped
    by word, and two folds go through them: one keeps the best score and last edge at each border, one walks
    back. Of equal paths the one whose last piece is longest wins. Characters without a piece become `unknown`.
    For unigram tables, whose own rule this is; words: word, null and empty ones have no row.
    """
    low = F.lit(known.agg(F.min("score")).first()[0] or 0.0) - 10.0
    each = words.where("word <> ''").select("word").distinct()
    cut = each.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    cut = cut.select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("at") + 1))).alias("n"))
    cut = cut.withColumn("piece", F.substring("word", F.col("at"), F.col("n")))
    edges = cut.join(F.broadcast(known), "piece", "left").where("id is not null or n = 1")
    edge = F.struct((F.col("at") - 1).alias("start"), (F.col("at") + F.col("n") - 1).alias("end"), F.coalesce("score", low).alias("score"), F.coalesce("id", F.lit(unknown)).alias("id"))
    grouped = edges.groupBy("word").agg(F.collect_list(edge).alias("edges"))
    # best[i]: score, minus the length of the last piece as tie-break, its start and id, for the first i characters
    best = F.expr(
        "aggregate(sequence(1, length(word)), array(named_struct('score', 0.0D, 'long', 0, 'start', 0, 'id', 0)), (a, i) -> concat(a, array(array_max("
        "transform(filter(edges, e -> e.end = i), e -> named_struct('score', a[e.start].score + e.score, 'long', i - e.start, 'start', e.start, 'id', e.id))))))"
    )
    walked = "aggregate(sequence(1, length(word)), named_struct('at', length(word), 'ids', cast(array() as array<int>)), (s, i) -> CASE WHEN s.at = 0 THEN s ELSE named_struct('at', best[s.at].start, 'ids', concat(array(best[s.at].id), s.ids)) END)"
    return grouped.withColumn("best", best).select("word", F.expr(f"{walked}.ids").alias("pieces"))


def vocabulary_path() -> str:
    """The public 32k model, where the box has it; the path is a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
