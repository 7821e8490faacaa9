"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipeweave.llm.minhash import near_duplicates
from pipeweave.llm.mixing import NEW, in_order, mix_sources
from pipeweave.llm.names import fresh
from pipeweave.llm.pieces import encode, vocabulary_path
from pipeweave.llm.quality import judge
from pipeweave.llm.substrings import substring_dedup
from pipeweave.storage import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    A row is judged by its text: repeated rows and copies fare alike, null and empty texts are too short and
    go, rows with a null doc_id, lang or source are judged like others. No column is looked at or changed but
    the text; an empty table gives an empty table.
    """
    (key,) = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))  # the id only deals out copies
    kept = judge(keyed.select(key, "text"), Scratch(spark, "p-quality")).where("kept").select(key).distinct()
    return keyed.join(kept, key, "left_semi").select(*_all(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group of near-duplicates by five-word shingles.

    Rows of one doc_id are one document and stay or go together. Rows without a doc_id are in no group and
    stay, as do those without words. No other column is looked at; an empty table gives an empty table.
    """
    groups = near_duplicates(docs, Scratch(spark, "p-near"), k=5)
    return docs.join(groups.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*_all(docs))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words and more that a document of a smaller doc_id has.

    A text of which nothing goes is left as it is, null included. Where a table has n_chars, it is counted
    anew. Rows of one doc_id do not take from each other, rows without a doc_id lose nothing and take nothing.
    Columns that the operator would replace are kept; an empty table gives an empty table.
    """
    same = {c: x for c in docs.columns if c in ("n_words", "n_removed", "removed", "kept_sha256") for x in fresh(docs, c + "_")}
    out = substring_dedup(docs.withColumnsRenamed(same), Scratch(spark, "p-substrings"))
    out = out.select(*[f"`{c}`" for c in out.columns if c not in same]).withColumnsRenamed({v: k for k, v in same.items()})
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*_all(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix.

    Null sources count as the source ''. Repeated rows get places of their own. Columns that have the name of
    one of the operator's stay as they are; an empty table gives an empty table.
    """
    same = {c: x for c in docs.columns if c in NEW for x in fresh(docs, c + "_")}
    mixed = mix_sources(docs.withColumnsRenamed(same), Scratch(spark, "p-mixing"))
    return in_order(mixed).withColumnsRenamed({v: k for k, v in same.items()}).select(*_all(docs))


def _all(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def placed(docs: DataFrame) -> DataFrame:
    """docs, as read from the files of one write, with mix_place: 0, 1, 2 ... in the order in which that write had the rows.

    Readers deal out files by size, so the order of rows is not kept by reading; a row's file and its index
    in the file are. Part numbers follow the range partitions of the sort. One row a file is numbered.
    """
    docs = docs.drop("mix_place")
    file, index, first = fresh(docs, "_file", "_index", "_first")
    at = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(index))
    number = lambda pattern: F.regexp_extract(file, pattern, 1).try_cast("bigint")
    before = Window.orderBy(number(r"part-(\d+)[^/]*$"), number(r"-c(\d+)\.[^/]*$"), file).rowsBetween(Window.unboundedPreceding, -1)
    files = at.groupBy(file).agg((F.max(index) + 1).alias("_n")).select(file, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(first))
    return at.join(F.broadcast(files), file).withColumn("mix_place", F.col(first) + F.col(index)).select(*_all(docs), "mix_place")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces, with the check that they decode to the text, and their place in the mix, mix_place.

    Null and empty texts have no pieces. Columns named pieces, n_pieces, round_trip or mix_place are replaced; the
    text gives way to its pieces. Repeated rows are encoded alike; an empty table gives an empty table.
    """
    return encode(placed(docs), vocabulary_path(), check=True)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("substrings", substrings), ("mixing", mixing), ("pieces", pieces)]

#: Components, maximisation and merges have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
