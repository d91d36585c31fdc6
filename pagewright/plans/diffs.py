"""Queries on versions of a text: alignment, mismatches, accuracy, reports (D, A5-A9, A14-A16, J3, J4, K1-K6, O5, P14)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import diff, layout, matching
from pagewright.plans import relations as R
from pagewright.plans.registry import query
from pagewright.sources import sinks, structure
from pagewright.storage import shared_folder, stored


def aligned(spark, sf_dir):
    return diff.line_pairs(R.versions(spark, sf_dir))


def page_words(spark, sf_dir):
    v = R.versions(spark, sf_dir)
    words = lambda c: text.words(text.normal_text(F.array_join(c, "\n")))
    return v.select("doc_id", "page", words("orig").alias("orig_words"), words("ext").alias("ext_words"))


def accuracies(spark, sf_dir):
    found = diff.mismatches(aligned(spark, sf_dir))
    return diff.page_accuracy(page_words(spark, sf_dir), found), found


@query()
def d01_line_blocks(spark, sf_dir):
    b = diff.line_blocks(R.versions(spark, sf_dir))
    return b.select("doc_id", "page", "block", "op.*")


@query()
def d02_line_pairs(spark, sf_dir):
    return aligned(spark, sf_dir)


@query()
def d03_d06_mismatches(spark, sf_dir):
    return diff.mismatches(aligned(spark, sf_dir)).withColumn("char_diffs", F.to_json("char_diffs"))


@query()
def d09_page_accuracy(spark, sf_dir):
    return accuracies(spark, sf_dir)[0].drop(*diff.COUNTS)


_IDENTICAL = f"""WITH {R.LINES}, p AS (SELECT doc_id, page, count(*) FILTER (regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')) AS n FROM lines GROUP BY ALL HAVING n > 0) SELECT doc_id, page, 100.0::DOUBLE AS accuracy, 'PASS' AS status, 0::BIGINT AS n_mismatches FROM p"""


@query(_IDENTICAL)
def d09_identical_versions(spark, sf_dir):
    """A text against itself: every page passes with 100."""
    same = R.versions(spark, sf_dir).withColumn("ext", F.col("orig"))
    words = same.select("doc_id", "page", text.words(F.array_join("orig", "\n")).alias("orig_words"), text.words(F.array_join("ext", "\n")).alias("ext_words"))
    return diff.page_accuracy(words, diff.mismatches(diff.line_pairs(same))).select("doc_id", "page", "accuracy", "status", "n_mismatches")


_DROPPED = f"""WITH {R.LINES}, k AS (SELECT doc_id, page, line, ord FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')), u AS (SELECT doc_id, line FROM k GROUP BY ALL HAVING count(*) = 1)
SELECT k.doc_id, k.page, count(*) FILTER (ord % 10 = 9)::BIGINT AS missing FROM k JOIN (SELECT doc_id FROM k GROUP BY doc_id HAVING count(*) = count(DISTINCT line)) d USING (doc_id) GROUP BY ALL HAVING count(*) FILTER (ord % 10 = 9) > 0 AND count(*) FILTER (ord % 10 <> 9) > 0"""


@query()
def d01_dropped_lines(spark, sf_dir):
    """Lines left out, and nothing else changed: each is one missing line."""
    e = R.lines(spark, sf_dir).where(F.col("line").rlike(r"\S"))
    listed = e.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    pages = listed.select("doc_id", "page", F.transform("l", lambda x: x["line"]).alias("orig"), F.transform(F.filter("l", lambda x: x["ord"] % 10 != 9), lambda x: x["line"]).alias("ext"))
    found = diff.mismatches(diff.line_pairs(pages))
    return found.groupBy("doc_id", "page").agg(F.count_if(F.col("diff_type") == "MISSING_TEXT").alias("missing"), F.count_if(F.col("diff_type") != "MISSING_TEXT").alias("others"))


@query(f"""WITH {R.LINES}, o AS (SELECT doc_id, page, line AS key, min(ord) AS orig_line FROM lines WHERE line <> '' GROUP BY ALL HAVING count(*) = 1),
x AS (SELECT doc_id, page, line AS key, min(CASE WHEN ord % 6 = 0 THEN ord + 3 ELSE ord END) AS ext_line FROM lines WHERE line <> '' GROUP BY ALL HAVING count(*) = 1),
b AS (SELECT o.doc_id, o.page, o.key, orig_line, ext_line, lag(ext_line) OVER (PARTITION BY o.doc_id, o.page ORDER BY orig_line) AS prev FROM o JOIN x ON o.doc_id = x.doc_id AND o.page = x.page AND o.key = x.key)
SELECT doc_id, page, key, orig_line, ext_line FROM b WHERE ext_line < prev""")
def d07_inversions(spark, sf_dir):
    rows = R.lines(spark, sf_dir).where("line <> ''").select("doc_id", "page", F.col("line").alias("key"), F.col("ord").alias("line_no"))
    moved = rows.withColumn("line_no", F.when(F.col("line_no") % 6 == 0, F.col("line_no") + 3).otherwise(F.col("line_no")))
    return diff.inversions(rows, moved)


@query()
def a05_report(spark, sf_dir):
    return diff.report(accuracies(spark, sf_dir)[0])


@query(f"""WITH {R.LINES}, c AS (SELECT doc_id, page, count(*) AS n FROM lines GROUP BY ALL), p AS (SELECT doc_id, page, (n * 10) % 7 * 50 AS orig_count, (n * 10) % 5 * 40 AS ext_count, CASE WHEN n % 4 = 0 THEN 100.0 ELSE 90.0 + (n % 10) + 0.5 END AS accuracy, n % 3 % 2 AS high, n % 4 AS m,
 CASE WHEN n % 4 = 0 THEN 'PASS' WHEN n % 4 = 1 THEN 'WARNING' ELSE 'ERROR' END AS status FROM c),
a AS (SELECT doc_id, count(*) AS total_pages, count(*) FILTER (status = 'PASS') AS passed_pages, count(*) FILTER (status = 'WARNING') AS warning_pages, count(*) FILTER (status = 'ERROR') AS error_pages, sum(orig_count)::BIGINT AS total_orig_words, sum(ext_count)::BIGINT AS total_extracted_words, sum(high)::BIGINT AS high, bool_and(accuracy = 100 AND m = 0) AS perfect,
 round(CASE WHEN sum(orig_count) = 0 THEN avg(accuracy) ELSE sum(accuracy * greatest(orig_count, 1)) / sum(greatest(orig_count, 1)) END, 1)::DOUBLE AS w FROM p GROUP BY doc_id)
SELECT doc_id, total_pages, passed_pages, warning_pages, error_pages, total_orig_words, total_extracted_words, high, CASE WHEN perfect THEN 100.0 ELSE w END::DOUBLE AS overall_accuracy,
 CASE WHEN perfect OR (w >= 99 AND high = 0 AND error_pages = 0 AND warning_pages = 0) THEN 'PASS' WHEN w >= 95 AND error_pages = 0 AND high = 0 THEN 'WARNING' ELSE 'ERROR' END AS verification_status FROM a""")
def a08_d10_overall(spark, sf_dir):
    n = F.col("n")
    c = R.lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    status = F.when(n % 4 == 0, "PASS").when(n % 4 == 1, "WARNING").otherwise("ERROR")
    pages = c.select("doc_id", "page", (n * 10 % 7 * 50).alias("orig_count"), (n * 10 % 5 * 40).alias("ext_count"), F.when(n % 4 == 0, 100.0).otherwise(90.5 + n % 10).alias("accuracy"), (n % 3 % 2).alias("high"), (n % 4).alias("n_mismatches"), status.alias("status"))
    return diff.overall(pages)


@query("""WITH d AS (SELECT doc_id, doc_id % 3 AS s, doc_id % 5 AS w, doc_id % 4 AS e, doc_id % 6 AS nm, doc_id % 2 AS ro FROM documents)
SELECT doc_id, CASE s WHEN 0 THEN 'The extracted text is an exceptionally accurate representation of the original document.' WHEN 1 THEN 'Minor extraction discrepancies detected across ' || w || ' page(s). Review recommended.' ELSE 'Critical mismatches detected across ' || e || ' page(s). Important content or numbers differ.' END
 || CASE WHEN nm > 0 THEN chr(10) || 'Caution: ' || nm || ' numeric mismatch(es) detected. Review numbers carefully.' ELSE '' END || CASE WHEN ro > 0 THEN chr(10) || 'Note: ' || ro || ' reading order transposition(s) identified.' ELSE '' END AS notes FROM d""")
def a09_notes(spark, sf_dir):
    d = F.col("doc_id")
    rows = R.table(spark, sf_dir, "documents").select("doc_id", F.when(d % 3 == 0, "PASS").when(d % 3 == 1, "WARNING").otherwise("ERROR").alias("verification_status"), (d % 5).alias("warning_pages"), (d % 4).alias("error_pages"), (d % 6).alias("number_mismatches"), (d % 2).alias("reading_order_issues"))
    return rows.select("doc_id", diff.notes().alias("notes"))


@query(f"WITH {R.ELEMENTS}, k AS (SELECT doc_id, page, string_agg(trim(text), chr(10) ORDER BY reading_order, y0, x0, ord) AS t FROM elements WHERE ord % 4 <> 0 AND length(trim(text)) > 2 GROUP BY doc_id, page), p AS (SELECT DISTINCT doc_id, page FROM elements) SELECT doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || CASE WHEN t IS NULL THEN '' ELSE t || chr(10) END, chr(10) ORDER BY page) AS reconstructed FROM p LEFT JOIN k USING (doc_id, page) GROUP BY doc_id")
def a06_reconstruct(spark, sf_dir):
    e = R.elements(spark, sf_dir).where(~F.col("type").isin("image"))
    kept = e.where((F.col("ord") % 4 != 0) & (F.length(F.trim("text")) > 2))
    pages = e.select("doc_id", "page").distinct()
    return sinks.reconstructed(pages, kept.withColumn("text", F.trim("text")))


@query("SELECT doc_id, text AS value FROM documents")
def k01_text_export(spark, sf_dir):
    return sinks.text_round_trip(R.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value")))


@query(f"WITH {R.ELEMENTS} SELECT doc_id, page, ord, text, x0, y1 FROM elements")
def k02_json_export(spark, sf_dir):
    return sinks.json_round_trip(R.elements(spark, sf_dir).select("doc_id", "page", "ord", "text", "x0", "y1"))


@query()
def k05_report_json(spark, sf_dir):
    return sinks.report_json(accuracies(spark, sf_dir)[0])


@query()
def k06_report_csv(spark, sf_dir):
    found = stored(diff.mismatches(aligned(spark, sf_dir)), shared_folder(spark, "mismatches"))
    pages = stored(diff.page_accuracy(page_words(spark, sf_dir), found), shared_folder(spark, "pages"))
    return sinks.report_rows(diff.report(pages), pages, found)


@query(f"WITH {R.LINES}, o AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY ord) AS t FROM lines GROUP BY ALL) SELECT doc_id, page, t AS orig, CASE WHEN page % 2 = 0 THEN '' ELSE t END AS ext FROM o")
def j03_page_join(spark, sf_dir):
    listed = F.array_sort(F.collect_list(F.struct("ord", "line")))
    o = R.lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("orig"))
    x = o.where(F.col("page") % 2 == 1).withColumnRenamed("orig", "ext")
    return o.join(x, ["doc_id", "page"], "left").withColumn("ext", F.coalesce("ext", F.lit("")))


@query(f"WITH {R.LINES}, p AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS rn FROM (SELECT DISTINCT doc_id, page FROM lines)), q AS (SELECT doc_id, page * 10 AS job_page, row_number() OVER (PARTITION BY doc_id ORDER BY page DESC) AS rn FROM (SELECT DISTINCT doc_id, page FROM lines)) SELECT p.doc_id, p.page, q.job_page::INT AS job_page FROM p JOIN q ON p.doc_id = q.doc_id AND p.rn = q.rn")
def j04_positional_join(spark, sf_dir):
    pages = R.lines(spark, sf_dir).select("doc_id", "page").distinct()
    by = lambda order: F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    return pages.withColumn("rn", by(F.col("page"))).join(pages.select("doc_id", (F.col("page") * 10).alias("job_page"), by(F.col("page").desc()).alias("rn")), ["doc_id", "rn"]).drop("rn")


@query(f"WITH {R.LINES}, n AS (SELECT doc_id, page, trim(regexp_replace(line, '[^a-zA-Z0-9 ]+', ' ', 'g')) AS t FROM lines), w AS (SELECT doc_id, page, unnest(list_filter(string_split(t, ' '), lambda x: x <> '')) AS w FROM n) SELECT doc_id, page, count(*) AS words, sum(length(w))::BIGINT AS chars FROM w GROUP BY ALL")
def a14_page_counts(spark, sf_dir):
    cleaned = R.lines(spark, sf_dir).select("doc_id", "page", F.explode(F.filter(F.split(F.trim(F.regexp_replace("line", "[^a-zA-Z0-9 ]+", " ")), " "), lambda w: w != "")).alias("w"))
    return cleaned.groupBy("doc_id", "page").agg(F.count("*").alias("words"), F.sum(F.length("w")).alias("chars"))


@query(f"WITH {R.LINES}, p AS (SELECT doc_id, page, count(*) AS n, sum(len(list_filter(string_split(line, ' '), lambda x: x <> ''))) AS w FROM lines GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS lines, sum(w)::BIGINT AS words, count(*) FILTER (n % 3 = 0) AS passed, count(*) FILTER (n % 3 = 1) AS warnings, count(*) FILTER (n % 3 = 2) AS errors FROM p GROUP BY doc_id")
def a15_p14_page_totals(spark, sf_dir):
    p = R.lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum(F.size(F.filter(F.split("line", " "), lambda w: w != ""))).alias("w"))
    return p.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.sum("w").alias("words"), F.count_if(F.col("n") % 3 == 0).alias("passed"), F.count_if(F.col("n") % 3 == 1).alias("warnings"), F.count_if(F.col("n") % 3 == 2).alias("errors"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')))::INT AS lines, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::INT AS words, length(text)::INT AS chars FROM documents")
def a16_upload_statistics(spark, sf_dir):
    d = R.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))).alias("lines"), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("words"), F.length("text").alias("chars"))


@query(f"WITH {R.LINES} SELECT doc_id, page, ord, left(line, 65) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS rn FROM lines WHERE page <= 5) WHERE rn <= 25")
def o05_first_rows(spark, sf_dir):
    first = R.lines(spark, sf_dir).where("page <= 5").withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord")))
    return first.where("rn <= 25").select("doc_id", "page", "ord", F.left("line", F.lit(65)).alias("snippet"))


@query(f"WITH {R.ELEMENTS}, l AS (SELECT doc_id, page, ord AS line, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM elements), e AS (SELECT doc_id, page, ord, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM elements), s AS (SELECT l.doc_id, l.page, line, e.ord, CASE WHEN l.k = e.k THEN 100.0 ELSE 100.0 * least(length(l.k), length(e.k)) / greatest(length(l.k), length(e.k)) END::DOUBLE AS score FROM l JOIN e ON l.doc_id = e.doc_id AND l.page = e.page AND l.k <> '' AND e.k <> '' AND (contains(e.k, l.k) OR contains(l.k, e.k))) SELECT doc_id, page, line, ord, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line ORDER BY score DESC, ord) AS rn FROM s) WHERE rn = 1")
def j18_highlight(spark, sf_dir):
    """Every whole line of a page against every element of it."""
    e = R.elements(spark, sf_dir)
    return structure.highlights(e.select("doc_id", "page", F.col("ord").alias("line"), "text"), e)


@query(f"WITH {R.LAYOUT}, n AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY ord) AS t FROM layout WHERE ord % 2 = 0 GROUP BY ALL) SELECT l.doc_id, l.page, l.ord FROM layout l LEFT JOIN n USING (doc_id, page) WHERE NOT coalesce(contains(n.t, l.text), false)")
def j19_not_contained(spark, sf_dir):
    e = R.layout(spark, sf_dir)
    listed = F.array_sort(F.collect_list(F.struct("ord", "text")))
    native = e.where(F.col("ord") % 2 == 0).groupBy("doc_id", "page").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("t"))
    return e.join(native, ["doc_id", "page"], "left").where(~F.coalesce(F.contains(F.col("t"), F.col("text")), F.lit(False))).select("doc_id", "page", "ord")


@query(f"WITH {R.LAYOUT}, s AS (SELECT doc_id, page, ord, text AS t FROM layout) SELECT a.doc_id, a.page, a.ord FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.doc_id = b.doc_id AND a.page = b.page AND b.ord < a.ord AND contains(b.t, a.t))")
def j20_first_mentions(spark, sf_dir):
    """Whole texts against all earlier ones of their page."""
    return structure.first_mentions(R.layout(spark, sf_dir))
