"""Queries over the operators for training data; ``oracle`` holds their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import frequent, garbled, leakage, mixture, percentiles, topn
from millrace.session import table

Query = Callable[[SparkSession, str], DataFrame]

FRACTIONS = (0.05, 0.25, 0.5, 0.75, 0.95)
#: error of condensed pieces in p1_from_pieces
PIECE_ERROR = 0.01
HISTOGRAM_TOLERANCE = 0.05
FREQUENT_SHARE = 0.015
TOP_VALUES = 20
TOP_EARNERS = 3
PHRASE_WORDS = 12


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    emp = table(spark, sf, "emp").where("dept IS NOT NULL")
    rows = percentiles.known_values(emp, ["dept"], "salary", key="id")
    return percentiles.misfits(rows, ["dept"], "salary", table(spark, sf, "histogram_bucket"), "bucket_no", "upper_bound", "cumulative_fraction", HISTOGRAM_TOLERANCE)


def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per department, put together from exact pieces by pay day."""
    emp = table(spark, sf, "emp").where("dept IS NOT NULL")
    rows = percentiles.known_values(emp, ["pay_day", "dept"], "salary", key="id")
    pieces = percentiles.piece(rows, ["pay_day"], ["dept"], "salary")
    found = percentiles.percentiles(pieces.select("dept", "salary", "weight"), ["dept"], "salary", FRACTIONS)
    return found.select("dept", "n", "fraction", F.round("percentile", 6).alias("percentile"))


def p1_from_condensed(spark: SparkSession, sf: str) -> DataFrame:
    """The same from pieces condensed to a bounded number of values, within ``PIECE_ERROR`` in rank."""
    emp = table(spark, sf, "emp").where("dept IS NOT NULL")
    rows = percentiles.known_values(emp, ["pay_day", "dept"], "salary", key="id")
    pieces = percentiles.piece(rows, ["pay_day"], ["dept"], "salary", PIECE_ERROR)
    found = percentiles.percentiles(pieces.select("dept", "salary", "weight"), ["dept"], "salary", FRACTIONS)
    return found.select("dept", "n", "fraction", F.round("percentile", 6).alias("percentile"))


def _segments(spark: SparkSession, sf: str) -> frequent.NodeCounts:
    return frequent.count_segments(table(spark, sf, "mcv_entry"), ["relation_id", "column_idx"], ["segment_no"], "value", "frequency", "tuple_count")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequent.values_above_share(_segments(spark, sf), FREQUENT_SHARE).select("relation_id", "column_idx", "value")


def p2_top_values(spark: SparkSession, sf: str) -> DataFrame:
    found = frequent.top_k(_segments(spark, sf), TOP_VALUES)
    return found.select("relation_id", "column_idx", "value", F.round("n", 3).alias("n"), "rank")


def p2_top_departments(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent values of a plain column: departments by rows of emp."""
    found = frequent.top_k(frequent.count_rows(table(spark, sf, "emp"), "dept"), TOP_VALUES, value="dept")
    return found.select("dept", F.col("n").cast("long").alias("n"), "rank")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, sf, "emp"), "dept", "salary", "id", TOP_EARNERS).select("dept", "id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "eval_item"), words=PHRASE_WORDS)
    return found.select("doc_id", "item_id")


def p6_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the documents to remove, in word numbers, and how much of each document they are."""
    found = leakage.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "eval_item"), words=PHRASE_WORDS)
    return found.select("doc_id", "item_id", F.explode("spans").alias("span")).select("doc_id", "item_id", F.col("span.first").alias("first_word"), F.col("span.end").alias("end_word"))


def _tokenizer(spark: SparkSession) -> str:
    return spark.conf.get("spark.millrace.tokenizer", mixture.TOKENIZER)


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Every source filled up to its share of all tokens, as far as it has them."""
    return mixture.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_target"), mixture.ALL, tokenizer=_tokenizer(spark))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares actually reached, of the mixture and of all tokens, and what each source is short of."""
    return mixture.mixture_report(table(spark, sf, "documents"), table(spark, sf, "mix_target"), tokenizer=_tokenizer(spark))


def p7_balanced_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached by the largest mixture that gives every source with documents its share."""
    targets = table(spark, sf, "mix_target")
    asked = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share")).where("source IS NOT NULL")
    return mixture.reached_shares(mixture.mixture(table(spark, sf, "documents"), targets, tokenizer=_tokenizer(spark)), asked)


def p7_filled(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture with texts measured in bytes: every source gets what it is short of its share or has, whichever is less.

    ``filled`` allows for the rounding to whole texts: a hundredth and the longest text.
    """
    tokens = table(spark, sf, "documents").where("doc_id IS NOT NULL AND text <> ''").select(
        F.col("doc_id").alias("doc"), F.lower(F.trim("source")).alias("source"), F.unhex(F.sha2("text", 256)).alias("content"), F.octet_length("text").cast("long").alias("tokens")
    )
    found = mixture.report(tokens, table(spark, sf, "mix_target"))
    due = F.least("wanted", "available")
    kept = F.abs(F.col("tokens") - due) <= due / 100 + tokens.agg(F.max("tokens").alias("n")).scalar()
    return found.select("source", "wanted", "available", (kept & (F.col("most_copies") <= F.col("max_repeats"))).alias("filled"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.garbled_lines(table(spark, sf, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Affected documents with their text restored where possible."""
    return garbled.restored_documents(table(spark, sf, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_percentiles": p1_percentiles, "p1_from_condensed": p1_from_condensed,
        "p2_found": p2_found, "p2_top_values": p2_top_values, "p2_top_departments": p2_top_departments,
        "p4_found": p4_found,
        "p6_found": p6_found, "p6_spans": p6_spans,
        "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_balanced_shares": p7_balanced_shares, "p7_filled": p7_filled,
        "p8_found": p8_found, "p8_restored": p8_restored,
    }
