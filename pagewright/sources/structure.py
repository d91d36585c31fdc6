"""Structure trees, markup, job results and uploads as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.storage import delete, shared_folder, stored

# Tags that only group others, and what headings' tags may be called.
GROUPING = ["Document", "Part", "Sect", "Art", "Div"]
# End of fixed values.


def struct_tree(nodes: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Nodes (doc_id, xref, parent, tag, page) below the roots (parent null), with depth and the page inherited.

    A node's tag is replaced by its role; grouping tags are left out of the result but passed through.  A node that is its
    own ancestor, or whose ancestor is missing, is not reached.

    Every node points at its parent; each round it takes over the pointer, depth and page of what it points at, so a tree
    of any depth takes about log2(depth) joins, on stored tables.  An xref is unique in its document.
    """
    spark = nodes.sparkSession
    folder = shared_folder(spark, "tree")
    role = F.create_map(*[F.lit(x) for kv in (roles or {"": ""}).items() for x in kv])
    rows = nodes.select("doc_id", "xref", F.coalesce(role[F.col("tag")], F.col("tag")).alias("tag"), "page", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    rows = stored(rows, f"{folder}/0")
    for k in range(1, rows.count().bit_length() + 2):
        open_ = rows.where("up is not null")
        if open_.isEmpty():
            break
        above = rows.select("doc_id", F.col("xref").alias("up"), F.col("page").alias("p"), F.col("up").alias("u"), F.col("depth").alias("d"))
        moved = open_.join(above, ["doc_id", "up"]).select("doc_id", "xref", "tag", F.coalesce("page", "p").alias("page"), F.col("u").alias("up"), (F.col("depth") + F.col("d")).alias("depth"))
        rows = stored(rows.where("up is null").unionByName(moved), f"{folder}/{k}")
        delete(spark, f"{folder}/{k - 1}")
    return rows.where(F.col("up").isNull() & ~F.col("tag").isin(GROUPING)).select("doc_id", "xref", "tag", "page", "depth")


def markup_counts(pages: DataFrame) -> DataFrame:
    """S4 on HTML: headings, paragraphs, links and the first heading's text."""
    every = lambda pattern, group=0: F.regexp_extract_all("html", F.lit(pattern), F.lit(group))
    first = F.regexp_replace(F.coalesce(F.get(every(r"<h1[^>]*>([^<]*)", 1), F.lit(0)), F.lit("")), r"\s+", " ")
    return pages.select("page_id", F.size(every(r"<h[1-6][ >]")).alias("headings"), F.size(every(r"<p[ >]")).alias("paragraphs"), F.size(every(r"<a [^>]*href=")).alias("links"), first.alias("title"))


def links(pages: DataFrame) -> DataFrame:
    """A page's link targets in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("k", "target"))


def either_join(images: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings of an image by its id, or by page where both have boxes: two equi joins and a union, not one disjunction.

    images: image_id, page_key, boxed; readings: reading_id, image_id, page_key, boxed.
    """
    by_id = images.select("image_id").join(readings.select("reading_id", "image_id"), "image_id")
    by_page = images.where("boxed").select("image_id", "page_key").join(readings.where("boxed").select("reading_id", "page_key"), "page_key").select("image_id", "reading_id")
    return by_id.select("image_id", "reading_id").unionAll(by_page).distinct()


def alternative_texts(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """For every element the first node of its page that shares two words with it, or one if the node has three or fewer.

    elements: doc_id, page, ord, words (array); nodes: doc_id, page, node_ord, alt_words (array).
    """
    pairs = elements.join(nodes, ["doc_id", "page"])
    shared = F.size(F.array_intersect("words", "alt_words"))
    enough = (shared >= 2) | ((shared >= 1) & (F.size(F.array_distinct("alt_words")) <= 3))
    return pairs.where(enough).groupBy("doc_id", "page", "ord").agg(F.min("node_ord").alias("node_ord"))


def zip_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """The n-th row on the left with the n-th on the right, within keys; rows without a partner stay on the left."""
    n = lambda o: F.row_number().over(Window.partitionBy(*keys).orderBy(o))
    return left.withColumn("n", n(left_order)).join(right.withColumn("n", n(right_order)), [*keys, "n"], "left")


def latest_result(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """For every wanted key the newest result whose key contains it or lies in it; both carry ``block``, an equi key."""
    hit = F.contains(F.col("key"), F.col("wanted")) | F.contains(F.col("wanted"), F.col("key"))
    return wanted.join(results, "block").where(hit).groupBy("block", "wanted").agg(F.max_by("result_id", F.struct("mtime", "result_id")).alias("result_id"))


def highlights(lines: DataFrame, items: DataFrame) -> DataFrame:
    """For every line the element of its page that equals it, contains it or lies in it, the nearest in length first.

    lines: doc_id, page, line, text; items: doc_id, page, ord, text.  Whole texts are compared, by letters and digits.
    """
    a, b = F.col("a"), F.col("b")
    keyed = lambda df, name, *columns: df.select("doc_id", "page", *columns, text.alnum_key(F.col("text")).alias(name)).where(F.col(name) != "")
    score = F.when(a == b, 100.0).otherwise(100.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))
    hits = keyed(lines, "a", "line").join(keyed(items, "b", "ord"), ["doc_id", "page"]).where(F.contains(b, a) | F.contains(a, b)).withColumn("score", score)
    best = hits.groupBy("doc_id", "page", "line").agg(F.max(F.struct("score", (-F.col("ord")).alias("back"))).alias("m"))
    return best.select("doc_id", "page", "line", (-F.col("m.back")).alias("ord"), F.round("m.score", 6).alias("score"))


def first_mentions(texts: DataFrame) -> DataFrame:
    """The texts (doc_id, page, ord, text) that no earlier text of their page contains."""
    s = texts.select("doc_id", "page", "ord", "text")
    b = s.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("ord").alias("o"), F.col("text").alias("u"))
    return s.join(b, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & (F.col("o") < F.col("ord")) & F.contains(F.col("u"), F.col("text")), "left_anti").select("doc_id", "page", "ord")


def retained(sessions: DataFrame, keys: list[str], newest: int = 2) -> DataFrame:
    """The newest sessions by key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("mtime").desc(), F.col("session_id").desc()))
    return sessions.withColumn("rank", rank).where(F.col("rank") <= newest).drop("rank")


def accepted(name: Column, mime: Column) -> Column:
    """How an upload is read, by its name or type; null if not at all."""
    n = F.lower(name)
    return F.when(n.endswith(".pdf"), "pdf").when(n.endswith(".docx"), "docx").when(n.endswith(".txt") | (mime == "text/plain"), "text")


def progress(done: Column, total: Column) -> Column:
    """Percent of a job, 15 before the first page and 90 after the last."""
    return (15 + F.floor(done / total * 75)).cast("int")
