"""The relations that queries start from, derived from the driver's tables, each with the same rule in SQL.

``lines``: lines of documents.text, 20 to a page.  ``elements``: lines that aren't blank, one below the other.
``layout``: the same elements in two columns, with spanning lines and tables.  ``ocr``: a second reading of the layout
with lines left out, letters exchanged and boxes shifted.  ``versions``: original and extracted lines of every page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES_PER_PAGE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, ord (from 0 in the document), line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return d.select("doc_id", (F.floor(F.col("ord") / LINES_PER_PAGE) + 1).cast("int").alias("page"), "ord", "line")


LINES = """raw_lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS ord, unnest(string_split(text, chr(10))) AS line FROM documents),
lines AS (SELECT doc_id, (ord // 20 + 1)::INT AS page, ord, line FROM raw_lines)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, ord (from 1 in the page), id, text, source, type, x0, y0, x1, y1, confidence, reading_order."""
    kept = lines(spark, sf_dir).where(F.col("line").rlike(r"\S"))
    i = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord"))
    e = kept.withColumn("i", i)
    return e.select(
        "doc_id", "page", F.col("i").cast("int").alias("ord"), F.concat_ws("_", F.lit("native"), "doc_id", "page", "i").alias("id"), F.col("line").alias("text"), F.lit("native").alias("source"), F.lit("text").alias("type"),
        F.lit(50.0).alias("x0"), (50.0 + 20.0 * (F.col("i") - 1)).alias("y0"), F.lit(550.0).alias("x1"), (68.0 + 20.0 * (F.col("i") - 1)).alias("y1"), F.lit(1.0).alias("confidence"), F.col("i").cast("int").alias("reading_order"),
    )


ELEMENTS = (
    LINES
    + """,
numbered AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS i, line FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
elements AS (SELECT doc_id, page, i::INT AS ord, concat_ws('_', 'native', doc_id, page, i) AS id, line AS text, 'native' AS source, 'text' AS type,
  50.0::DOUBLE AS x0, (50 + 20 * (i - 1))::DOUBLE AS y0, 550.0::DOUBLE AS x1, (68 + 20 * (i - 1))::DOUBLE AS y1, 1.0::DOUBLE AS confidence, i::INT AS reading_order FROM numbered)"""
)


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements in two columns; every 13th spans the page, every 11th is a table; with font size, bold and confidence."""
    e = elements(spark, sf_dir).drop("x0", "y0", "x1", "y1", "type", "confidence", "reading_order")
    i = F.col("ord") - 1
    wide = i % 13 == 0
    e = e.withColumn("type", F.when(i % 11 == 10, "table").otherwise("text"))
    e = e.withColumn("x0", F.when(wide, 50.0).otherwise(50.0 + 300.0 * (i % 2) + 4.0 * (i % 3))).withColumn("x1", F.when(wide, 550.0).otherwise(F.col("x0") + 200.0))
    e = e.withColumn("y0", 60.0 + 24.0 * F.floor(i / 2) + 50.0 * F.floor(i / 8)).withColumn("y1", F.col("y0") + 14.0)
    e = e.withColumn("font_size", 11.0 + F.when(wide, 10.0).when(i % 7 == 0, 3.0).otherwise(0.0)).withColumn("bold", i % 5 == 0)
    return e.withColumn("confidence", F.lit(1.0))


LAYOUT = (
    ELEMENTS
    + """,
boxed AS (SELECT doc_id, page, ord, id, text, source, CASE WHEN (ord - 1) % 11 = 10 THEN 'table' ELSE 'text' END AS type,
  CASE WHEN (ord - 1) % 13 = 0 THEN 50.0 ELSE 50.0 + 300.0 * ((ord - 1) % 2) + 4.0 * ((ord - 1) % 3) END::DOUBLE AS x0,
  (60.0 + 24.0 * ((ord - 1) // 2) + 50.0 * ((ord - 1) // 8))::DOUBLE AS y0,
  (11.0 + CASE WHEN (ord - 1) % 13 = 0 THEN 10.0 WHEN (ord - 1) % 7 = 0 THEN 3.0 ELSE 0.0 END)::DOUBLE AS font_size, (ord - 1) % 5 = 0 AS bold, 1.0::DOUBLE AS confidence FROM elements),
layout AS (SELECT *, CASE WHEN (ord - 1) % 13 = 0 THEN 550.0 ELSE x0 + 200.0 END::DOUBLE AS x1, y0 + 14.0 AS y1 FROM boxed)"""
)


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout read again: every tenth element is missing, some letters are exchanged, boxes are shifted."""
    i = F.col("ord") - 1
    e = layout(spark, sf_dir).where(i % 10 != 9).withColumn("source", F.lit("ocr"))
    e = e.withColumn("text", F.when(i % 7 == 3, F.translate("text", "l", "1")).when(i % 5 == 2, F.lower("text")).otherwise(F.col("text")))
    e = e.withColumn("confidence", 0.5 + (i % 50) / 100.0)
    e = e.withColumn("id", F.concat_ws("_", F.lit("ocr"), "doc_id", "page", "ord"))
    shift = 2.0 * (i % 3)
    for c in ("x0", "x1"):
        e = e.withColumn(c, F.col(c) + shift + F.when(i % 6 == 5, 260.0).otherwise(0.0))
    return e


OCR = (
    LAYOUT
    + """,
ocr AS (SELECT doc_id, page, ord, concat_ws('_', 'ocr', doc_id, page, ord) AS id,
  CASE WHEN (ord - 1) % 7 = 3 THEN replace(text, 'l', '1') WHEN (ord - 1) % 5 = 2 THEN lower(text) ELSE text END AS text, 'ocr' AS source, type,
  x0 + 2.0 * ((ord - 1) % 3) + CASE WHEN (ord - 1) % 6 = 5 THEN 260.0 ELSE 0.0 END AS x0, y0, x1 + 2.0 * ((ord - 1) % 3) + CASE WHEN (ord - 1) % 6 = 5 THEN 260.0 ELSE 0.0 END AS x1, y1,
  font_size, bold, (0.5 + ((ord - 1) % 50) / 100.0)::DOUBLE AS confidence FROM layout WHERE (ord - 1) % 10 <> 9)"""
)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, orig and ext (arrays of lines): ext lacks every tenth line of a document and has letters exchanged."""
    e = lines(spark, sf_dir).where(F.col("line").rlike(r"\S"))
    other = F.when(F.col("ord") % 10 == 9, F.lit(None).cast("string")).when(F.col("ord") % 7 == 3, F.translate("line", "l", "1")).when(F.col("ord") % 11 == 5, F.lower("line")).otherwise(F.col("line"))
    listed = e.withColumn("other", other).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "line", "other"))).alias("l"))
    return listed.select("doc_id", "page", F.transform("l", lambda x: x["line"]).alias("orig"), F.filter(F.transform("l", lambda x: x["other"]), lambda x: x.isNotNull()).alias("ext"))


VERSIONS = (
    LINES
    + """,
versions AS (SELECT doc_id, page, ord, line AS orig_line, CASE WHEN ord % 10 = 9 THEN NULL WHEN ord % 7 = 3 THEN replace(line, 'l', '1') WHEN ord % 11 = 5 THEN lower(line) ELSE line END AS ext_line
  FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]'))"""
)
