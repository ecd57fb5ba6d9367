"""Statistics, mapping tables, and the filters, orders and decisions of a review, over one row for each detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.plans.config import CATEGORIES


def statistics(detections: DataFrame, high: float = 90, medium: float = 70) -> DataFrame:
    """One row: total, one count for each category, and high, medium and low confidence."""
    c = F.col("confidence")
    return detections.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("category") == k).alias(k) for k in CATEGORIES),
        F.count_if(c >= high).alias("high"), F.count_if((c >= medium) & (c < high)).alias("medium"), F.count_if(c < medium).alias("low"),
    )


def by_category(detections: DataFrame) -> DataFrame:
    return detections.groupBy("category").agg(F.count("*").alias("n"), F.count_if("approved").alias("approved"))


def type_counts(detections: DataFrame, kind: str = "type") -> DataFrame:
    return detections.groupBy(kind).agg(F.count("*").alias("n"))


def mapping(detections: DataFrame, doc: str = "doc_id", backwards: bool = False) -> DataFrame:
    """By document and placeholder: distinct original values, the category of the first, and the number of values.

    Values are in order of their first places; ``backwards``, from the last place in the text to the first."""
    at = detections.where("approved").withColumn("__at", -F.col("start") if backwards else F.col("start"))
    once = at.groupBy(doc, "placeholder", "text").agg(F.min("__at").alias("first"), F.min_by("category", "__at").alias("category"))
    own = once.groupBy(doc, "placeholder").agg(F.array_sort(F.collect_list(F.struct("first", "text", "category"))).alias("v"))
    return own.select(doc, "placeholder", F.transform("v", lambda x: x["text"]).alias("original_values"), F.col("v")[0]["category"].alias("category"), F.size("v").cast("long").alias("occurrences"))


def mapping_json(of: DataFrame, doc: str = "doc_id") -> DataFrame:
    one = F.struct("placeholder", F.col("original_values").alias("originalValues"))
    return of.groupBy(doc).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("mapping"))


def searched(detections: DataFrame, term: str) -> DataFrame:
    t = term.strip().lower()
    fields = [F.lower(F.col(c)).contains(t) for c in ("text", "subcategory", "placeholder")]
    return detections.where(fields[0] | fields[1] | fields[2]) if t else detections


def reviewed(detections: DataFrame, by: str = "text", ascending: bool = True) -> DataFrame:
    """Ordered by text, category, confidence or placeholder; ties by place.  Strings are ordered by code point."""
    c = F.col(by)
    return detections.orderBy(c.asc() if ascending else c.desc(), "start")


def decided(detections: DataFrame, approved: bool | None, where: Column | None = None) -> DataFrame:
    """Approval set, or turned over if ``approved`` is None, for the rows of ``where``."""
    new = ~F.col("approved") if approved is None else F.lit(approved)
    return detections.withColumn("approved", new if where is None else F.when(where, new).otherwise(F.col("approved")))


def first_by_place(detections: DataFrame, most: int = 1000, doc: str = "doc_id") -> DataFrame:
    """At most so many detections of a document, by place."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy("start", "emission"))
    return detections.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")
