"""Queries on layout (J, W, A12, A13, U, O) and on tags and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import layout, matching
from pagewright.operators.layout import PAGE
from pagewright.plans import relations as R
from pagewright.plans.registry import query
from pagewright.functions.classify import CAPTION, NUMBERED, SECTION
from pagewright.plans.texts import classified_layout, f16_classify, sql_key, sql_strip  # noqa: F401
from pagewright.plans.registry import _SQL

_MARKED = "SELECT doc_id, page, ord, CASE WHEN ord % 4 = 0 THEN CASE ord % 3 WHEN 0 THEN 'TM' WHEN 1 THEN '™' ELSE 'm' END ELSE text || CASE WHEN ord % 3 = 0 THEN '.' ELSE '' END END AS text, CASE WHEN ord % 4 = 0 THEN x1 - 300 ELSE x0 END AS x0, y0, CASE WHEN ord % 4 = 0 THEN x1 - 290 ELSE x1 END AS x1, CASE WHEN ord % 4 = 0 THEN y0 + 5 ELSE y1 END AS y1 FROM ocr"
_MEET = "greatest(0.0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
_APART = "abs(({a}.x0 + {a}.x1) / 2 - ({b}.x0 + {b}.x1) / 2)"
_THIN = "least(greatest(1.0, {a}.x1 - {a}.x0), greatest(1.0, {b}.x1 - {b}.x0))"
_WIDE = "greatest(1.0, {a}.x1 - {a}.x0, {b}.x1 - {b}.x0)"


def fold_sql(relation: str, fields: str, order: str, start: str, step: str, let: str = "NULL") -> str:
    """A fold in SQL over a page's rows: ``l`` is their list, ``s`` the state and ``x`` a row; ``found`` is ``let``.  Ends in the relation ``done``."""
    struct = ", ".join(f"'{f}': {f}" for f in fields.split())
    return f"""lists AS (SELECT doc_id, page, list({{{struct}}} ORDER BY {order}) AS l FROM {relation} GROUP BY doc_id, page),
turns AS (SELECT doc_id, page, l, 0 AS i, {start} AS s FROM lists
 UNION ALL SELECT doc_id, page, l, i + 1, {step} FROM (SELECT *, {let} AS found FROM (SELECT *, l[i + 1] AS x FROM turns WHERE i < len(l)))),
done AS (SELECT doc_id, page, l, s FROM turns WHERE i = len(l))"""


def _pair_step(fits: str, nearest: str = "0") -> dict:
    """A fold that gives row i the best unused row k that ``fits``, by ``nearest`` and place; the state lists the pairs n, d."""
    unused = lambda k: f"NOT list_contains(list_transform(s, lambda p: p.n), {k}) AND NOT list_contains(list_transform(s, lambda p: p.d), {k})"
    best = f"list_sort(list_transform(list_filter(range(1, len(l) + 1), lambda k: {unused('k')} AND {fits}), lambda k: {{'c': ({nearest})::DOUBLE, 'k': k}}))[1]"
    return {"start": "[{'n': 0::BIGINT, 'd': 0::BIGINT}]", "let": f"CASE WHEN {unused('i + 1')} THEN {best} END", "step": "CASE WHEN found IS NULL THEN s ELSE list_append(s, {'n': (i + 1)::BIGINT, 'd': found.k}) END"}


def _near_row(least: float, tall: str, group: str = "0") -> dict:
    """The fold of W3 and W13: lines of a group with sums of centres and heights; the state's first line is a dummy."""
    c, h = "(x.y0 + x.y1) / 2", "greatest(1.0, x.y1 - x.y0)"
    hit = f"list_filter(range(2, len(s.r) + 1), lambda k: s.r[k].g = {group} AND abs({c} - s.r[k].c / s.r[k].n) <= greatest({least}, 0.45 * least({h}, s.r[k].h / s.r[k].n)))[1]"
    new = f"{{'r': list_append(s.r, {{'c': {c}, 'h': {tall}, 'n': 1, 'g': {group}}}), 'at': list_append(s.at, len(s.r) + 1)}}"
    old = f"{{'r': list_transform(s.r, lambda v, k: CASE WHEN k = found THEN {{'c': v.c + {c}, 'h': v.h + {tall}, 'n': v.n + 1, 'g': v.g}} ELSE v END), 'at': list_append(s.at, found)}}"
    return {"start": "{'r': [{'c': 0::DOUBLE, 'h': 0::DOUBLE, 'n': 0, 'g': -1}], 'at': [0::BIGINT]}", "let": hit, "step": f"CASE WHEN found IS NULL THEN {new} ELSE {old} END"}


_ROWS = """items AS (SELECT doc_id, page, i, l[i] AS x, s.at[i + 1] AS r, s.r[s.at[i + 1]].c / s.r[s.at[i + 1]].n AS mean FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM done)),
ranked AS (SELECT *, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY mean, r) - 1)::INT AS rank FROM items)"""

_BOTH = R.OCR + ", every AS (SELECT doc_id, page, ord, x0, y0, x1, y1 FROM layout UNION ALL SELECT doc_id, page, ord + 1000, x0, y0, x1, y1 FROM ocr)"


def both(spark, sf_dir):
    """Native and OCR elements together, the latter after the former."""
    return R.layout(spark, sf_dir).unionByName(R.ocr(spark, sf_dir).withColumn("ord", F.col("ord") + 1000))


@query(f"""WITH {_BOTH}, p AS (SELECT a.doc_id, a.page, a.ord AS ord_a, b.ord AS ord_b, greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS inter, (a.x1-a.x0)*(a.y1-a.y0) AS aa, (b.x1-b.x0)*(b.y1-b.y0) AS ab
 FROM every a JOIN every b ON a.doc_id=b.doc_id AND a.page=b.page AND a.ord < b.ord)
SELECT doc_id, page, ord_a, ord_b, inter/aa AS overlap_a, CASE WHEN inter/aa > 0.85 AND inter/ab > 0.85 THEN 'equal' WHEN inter/aa > 0.85 THEN 'contained_by' WHEN inter/ab > 0.85 THEN 'contains' ELSE 'overlaps' END AS relationship FROM p WHERE inter > 0 AND inter/aa > 0.1""")
def j01_overlaps(spark, sf_dir):
    return layout.overlaps(both(spark, sf_dir)).select(*PAGE, "ord_a", "ord_b", "overlap_a", "relationship")


@query(f"""WITH {_BOTH}, p AS (SELECT a.doc_id, a.page, a.ord AS u, b.ord AS v, greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS inter, (a.x1-a.x0)*(a.y1-a.y0) AS aa
 FROM every a JOIN every b ON a.doc_id=b.doc_id AND a.page=b.page AND a.ord < b.ord), q AS (SELECT * FROM p WHERE inter > 0 AND inter/aa > 0.1), s AS (SELECT doc_id, page, u AS ord, v AS o FROM q UNION ALL SELECT doc_id, page, v, u FROM q)
SELECT doc_id, page, ord, string_agg(DISTINCT o::VARCHAR, ',' ORDER BY o::VARCHAR) AS others FROM s GROUP BY ALL""")
def j01_overlap_lists(spark, sf_dir):
    out = layout.overlap_lists(both(spark, sf_dir))
    return out.select(*PAGE, "ord", F.array_join(F.array_sort(F.transform("others", lambda o: o.cast("string"))), ",").alias("others"))


_SETS = "list_distinct(list_filter(string_split({0}, ' '), lambda x: x <> ''))"


@query(f"""WITH {R.OCR}, n AS (SELECT *, {sql_key('text')} AS key FROM layout), o AS (SELECT *, {sql_key('text')} AS key FROM ocr),
p AS (SELECT o.doc_id, o.page, o.ord, n.ord AS native, o.key AS a, n.key AS b, greatest(0, least(o.x1,n.x1)-greatest(o.x0,n.x0))*greatest(0, least(o.y1,n.y1)-greatest(o.y0,n.y0)) AS inter, (o.x1-o.x0)*(o.y1-o.y0) AS ao, (n.x1-n.x0)*(n.y1-n.y0) AS an
 FROM o JOIN n ON o.doc_id=n.doc_id AND o.page=n.page WHERE length(o.key) >= 2 AND length(n.key) >= 2),
s AS (SELECT *, CASE WHEN inter > 0 THEN inter/(ao+an-inter) ELSE 0 END AS iou, len(list_intersect({_SETS.format('a')}, {_SETS.format('b')})) AS both_, len(list_distinct(list_concat({_SETS.format('a')}, {_SETS.format('b')}))) AS either_, least(length(a), length(b)) AS lo, greatest(length(a), length(b)) AS hi FROM p),
t AS (SELECT *, CASE WHEN a = b THEN 1.0 WHEN (contains(a, b) OR contains(b, a)) AND lo > 10 AND lo / hi > 0.65 THEN greatest(both_ / either_, 0.85) ELSE both_ / either_ END::DOUBLE AS words FROM s),
u AS (SELECT *, CASE WHEN iou > 0.15 THEN greatest(words, 0.70 + iou * 0.30) ELSE words END AS score FROM t),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, ord ORDER BY score DESC, native) AS rn, max(iou) OVER (PARTITION BY doc_id, page, ord) > 0.15 AS touches FROM u)
SELECT doc_id, page, ord, CASE WHEN score > 0 THEN native END AS native_ord, round(score, 6) AS score, touches, CASE WHEN score <= 0 THEN false WHEN touches THEN score >= 0.7 ELSE score >= 0.9 AND length(a) > 15 END AS possible_duplicate FROM v WHERE rn = 1""")
def j02_duplicates(spark, sf_dir):
    every = text.to_nfkc(both(spark, sf_dir), "text").withColumn("ord", F.when(F.col("source") == "ocr", F.col("ord") - 1000).otherwise(F.col("ord")))
    return layout.duplicates(every).withColumn("score", F.round("score", 6))


_REGIONS = R.LAYOUT + """,
ext AS (SELECT doc_id, page, max(x1) - min(x0) AS total, count(*) AS n FROM layout GROUP BY doc_id, page),
alone AS (SELECT l.*, n, (type = 'table') OR (total > 150 AND (x1 - x0) / total >= 0.70) AS alone FROM layout l JOIN ext USING (doc_id, page)),
cut AS (SELECT *, (n > 3 AND (alone OR lag(alone, 1, false) OVER w OR coalesce(y0 - lag(y1) OVER w > 35, false)))::INT AS c FROM alone WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, ord)),
regions AS (SELECT *, (sum(c) OVER w - first_value(c) OVER w)::INT AS region FROM cut WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, ord))"""


@query(f"WITH {_REGIONS} SELECT doc_id, page, ord, region FROM regions")
def w01_regions(spark, sf_dir):
    return layout.regions(R.layout(spark, sf_dir)).select(*PAGE, "ord", "region")


_COLUMNS = _REGIONS + """,
g AS (SELECT *, min(x0) OVER w AS l, max(x1) OVER w AS r, count(*) OVER w AS m FROM regions WINDOW w AS (PARTITION BY doc_id, page, region)),
taken AS (SELECT DISTINCT doc_id, page, region, l, r, unnest(range(floor((x0 - l) / 2)::INT, floor((x1 - l) / 2)::INT + 1)) AS step FROM g WHERE m >= 3 AND r - l >= 120),
nxt AS (SELECT *, lead(step) OVER (PARTITION BY doc_id, page, region ORDER BY step) AS nx FROM taken),
gaps AS (SELECT doc_id, page, region, l + (step + 1) * 2.0 AS low, l + nx * 2.0 AS high, l, r FROM nxt WHERE nx - step - 1 >= 5),
splits AS (SELECT doc_id, page, region, (low + high) / 2 AS s FROM gaps WHERE low - l >= 30 AND r - high >= 30),
cols AS (SELECT g.doc_id, g.page, g.ord, g.region, (SELECT count(*) FROM splits s WHERE s.doc_id = g.doc_id AND s.page = g.page AND s.region = g.region AND (g.x0 + g.x1) / 2 > s.s)::INT AS col FROM g)"""


@query(f'WITH {_COLUMNS} SELECT doc_id, page, ord, region, col AS "column" FROM cols')
def w02_columns(spark, sf_dir):
    return layout.columns_of(layout.regions(R.layout(spark, sf_dir)), [*PAGE, "region"]).select(*PAGE, "ord", "region", "column")


@query(f"""WITH RECURSIVE {R.OCR}, {fold_sql("ocr", "ord x0 y0 x1 y1", "y0, x0, ord", **_near_row(4.0, "(x.y1 - x.y0)"))}, {_ROWS}
SELECT doc_id, page, x.ord AS ord, rank AS line FROM ranked""")
def w03_line_clusters(spark, sf_dir):
    return layout.with_line_ranks(R.ocr(spark, sf_dir), []).drop("x0")


@query(f"""WITH {_REGIONS}, o AS (SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY region, y0, x0, ord)::INT AS a FROM regions) SELECT doc_id, page, count(*) AS n, min(a)::INT AS lo, max(a)::INT AS hi FROM o GROUP BY doc_id, page""")
def w04_reading_order_ranks(spark, sf_dir):
    """Ranks of a page are 1 to n; the order itself is in ``w04_reading_order``."""
    o = layout.reading_order(R.layout(spark, sf_dir))
    return o.groupBy(*PAGE).agg(F.count("*").alias("n"), F.min("reading_order").alias("lo"), F.max("reading_order").alias("hi"))


@query(f"WITH {R.ELEMENTS} SELECT doc_id, page, ord, reading_order FROM elements")
def w04_reading_order_plain(spark, sf_dir):
    """One element a line: reading order is the order of lines."""
    return layout.reading_order(R.elements(spark, sf_dir))


_KINDS = f""", t AS (SELECT *, trim(text) AS t, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS nw FROM regions),
c AS (SELECT doc_id, page, region, count(*) AS n, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (ends_with(lower(t), ':')) AS colons, count(*) FILTER (t <> '' AND regexp_matches(lower(t), '{layout.PROMPT}')) AS prompts, count(*) FILTER (regexp_matches(t, '{layout.LEADERS}')) AS leaders,
 count(*) FILTER ((nw > 0 AND nw <= 4) OR regexp_matches(t, '{layout.ITEM}')) AS shorts FROM t GROUP BY ALL),
kinds AS (SELECT *, CASE WHEN tables > 0 THEN 'table' WHEN n >= 2 AND (colons >= 2 OR (prompts >= 2 AND prompts / n >= 0.25)) THEN 'form' WHEN n >= 3 AND (leaders >= 2 OR leaders / n >= 0.3) THEN 'toc' WHEN n >= 4 AND shorts / n >= 0.65 THEN 'list' ELSE 'text' END AS kind FROM c)"""


@query(f"""WITH RECURSIVE {_COLUMNS}{_KINDS}, grouped AS (SELECT doc_id, page, ord, layout.x0, layout.y0, layout.y1, region * 1000 + CASE WHEN kind IN ('table', 'form') THEN 0 ELSE col END AS g FROM cols JOIN layout USING (doc_id, page, ord) JOIN kinds USING (doc_id, page, region)),
{fold_sql("grouped", "ord g x0 y0 y1", "y0, x0, ord", **_near_row(4.0, "(x.y1 - x.y0)", "x.g"))}, {_ROWS}
SELECT doc_id, page, x.ord AS ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY x.g, mean, r, x.x0, x.ord)::INT AS reading_order FROM items""")
def w04_reading_order(spark, sf_dir):
    return layout.reading_order(R.layout(spark, sf_dir))


_CLASSIFIED = _SQL["f16_classify"].removesuffix("\nSELECT doc_id, page, ord, content_type FROM k")
_TAGS = "CASE content_type WHEN 'table' THEN 'Table' WHEN 'formula' THEN 'Formula' WHEN 'header' THEN 'Header' WHEN 'footer' THEN 'Footer' WHEN 'caption' THEN 'Caption' WHEN 'list_item' THEN 'LI' WHEN 'heading_1' THEN 'H1' WHEN 'heading_2' THEN 'H2' WHEN 'heading_3' THEN 'H3' WHEN 'title' THEN 'Title' ELSE 'P' END"


@query(_CLASSIFIED + f""", r AS (SELECT *, count(*) FILTER (content_type = 'heading_1') OVER (PARTITION BY doc_id ORDER BY page, ord ROWS UNBOUNDED PRECEDING) AS rn FROM k)
SELECT doc_id, page, ord, CASE WHEN content_type = 'heading_1' AND rn > 1 THEN 'heading_2' ELSE content_type END AS content_type, CASE WHEN content_type = 'heading_1' AND rn > 1 THEN 'H2' ELSE {_TAGS} END AS tag FROM r""")
def w05_single_h1(spark, sf_dir):
    return layout.single_first_heading(classified_layout(spark, sf_dir)).select(*PAGE, "ord", "content_type", "tag")


def _heading(t: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({t}, '{p}')" for p in (SECTION, NUMBERED, CAPTION)) + ")"


_DISTINCT = f"({_heading('x.t')} OR x.font_size >= 1.25 * 11.0 OR (x.bold AND len(list_filter(regexp_split_to_array(x.t, '\\s+'), lambda w: w <> '')) <= 12 AND x.font_size >= 1.1 * 11.0))"


@query(f"""WITH RECURSIVE {R.LAYOUT}, h AS (SELECT * REPLACE (CASE ord % 9 WHEN 4 THEN 'Section ' || ord || ': ' || text WHEN 6 THEN '1.' || ord || ' A ' || text WHEN 8 THEN 'fig. ' || ord || text ELSE text END AS text) FROM layout),
t AS (SELECT doc_id, page, ord, text, {sql_strip('text')} AS t, font_size, bold FROM h WHERE {sql_strip('text')} <> ''),
{fold_sql("t", "ord text t font_size bold", "ord", "{'b': 0, 'text': '', 'most': 0::DOUBLE, 'out': [{'ord': -1, 'block': 0}]}",
 "{'b': s.b + found, 'text': CASE WHEN found = 1 THEN x.text ELSE s.text || x.text END, 'most': CASE WHEN found = 1 THEN x.font_size ELSE greatest(s.most, x.font_size) END, 'out': list_append(s.out, {'ord': x.ord, 'block': s.b + found})}",
 f"(len(s.out) > 1 AND ({_DISTINCT} OR {_heading(sql_strip('s.text'))} OR abs(x.font_size - s.most) >= 2.5))::INT")}
SELECT doc_id, page, o.ord AS ord, o.block AS block FROM (SELECT doc_id, page, unnest(s.out) AS o FROM done) WHERE o.ord >= 0""")
def w06_style_blocks(spark, sf_dir):
    """Some lines begin as headings and captions do; the median size is 11."""
    o = F.col("ord")
    begin = F.when(o % 9 == 4, F.concat(F.lit("Section "), o, F.lit(": "))).when(o % 9 == 6, F.concat(F.lit("1."), o, F.lit(" A "))).when(o % 9 == 8, F.concat(F.lit("fig. "), o)).otherwise("")
    e = R.layout(spark, sf_dir).select(*PAGE, "ord", F.concat(begin, "text").alias("text"), "font_size", "bold", F.lit(11.0).alias("median"))
    return e.groupBy(*PAGE).applyInPandas(matching.style_blocks, "doc_id long, page int, ord int, block int")


@query(f"""WITH RECURSIVE {R.OCR}, t AS (SELECT doc_id, page, ord, x0, x0 + 40 * (1 + ord % 5) AS x1 FROM ocr),
{fold_sql("t", "ord x0 x1", "ord", "{'c': [{'a': 0::DOUBLE, 'b': 0::DOUBLE}], 'at': [{'ord': -1, 'c': 0::BIGINT}]}",
 "CASE WHEN found IS NULL THEN {'c': list_append(s.c, {'a': x.x0, 'b': x.x1}), 'at': list_append(s.at, {'ord': x.ord, 'c': len(s.c) + 1})} ELSE {'c': list_transform(s.c, lambda v, k: CASE WHEN k = found THEN {'a': least(v.a, x.x0), 'b': greatest(v.b, x.x1)} ELSE v END), 'at': list_append(s.at, {'ord': x.ord, 'c': found})} END",
 "list_filter(range(2, len(s.c) + 1), lambda k: x.x1 >= s.c[k].a - 25 AND x.x0 <= s.c[k].b + 25)[1]")},
spread AS (SELECT doc_id, page, max(x0) - min(x0) AS spread FROM t GROUP BY doc_id, page)
SELECT doc_id, page, o.ord AS ord, CASE WHEN spread < 45 THEN 0 ELSE o.c - 2 END::INT AS cluster FROM (SELECT doc_id, page, unnest(s.at) AS o FROM done) JOIN spread USING (doc_id, page) WHERE o.ord >= 0""")
def w07_sub_blocks(spark, sf_dir):
    e = R.ocr(spark, sf_dir).select(*PAGE, "ord", "x0", (F.col("x0") + 40 * (1 + F.col("ord") % 5)).alias("x1"))
    return e.groupBy(*PAGE).applyInPandas(matching.sub_blocks, "doc_id long, page int, ord int, cluster int")


@query()
def w08_baseline_lines(spark, sf_dir):
    e = R.ocr(spark, sf_dir).select(*PAGE, "ord", "text", "x0", "y0", "x1")
    return e.groupBy(*PAGE).applyInPandas(matching.baseline_lines, "doc_id long, page int, line int, part int, text string")


@query()
def w08_verified_lines(spark, sf_dir):
    e = R.ocr(spark, sf_dir).select(*PAGE, "ord", "text", "x0", "y0", "x1")
    return e.groupBy(*PAGE).applyInPandas(matching.verified_lines, "doc_id long, page int, line int, part int, text string")


@query(f"""WITH RECURSIVE {R.OCR}, {fold_sql("ocr", "ord text x0 y0 x1 y1", "y0, x0, ord", **_near_row(5.0, "greatest(1.0, x.y1 - x.y0)"))}, {_ROWS}
SELECT doc_id, page, rank AS row, string_agg(x.text, '   ' ORDER BY x.x0, i) AS text FROM ranked GROUP BY doc_id, page, rank""")
def w13_cohesion_rows(spark, sf_dir):
    e = R.ocr(spark, sf_dir).select(*PAGE, "ord", "text", "x0", "y0", "x1", "y1")
    return e.groupBy(*PAGE).applyInPandas(matching.cohesion_rows, "doc_id long, page int, row int, text string")


@query(f"WITH {R.LAYOUT} SELECT doc_id, page, ord, concat('native_p', page, '_', row_number() OVER (PARTITION BY doc_id, page ORDER BY ord)) AS new_id FROM layout")
def w14_generated_ids(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord"))
    return R.layout(spark, sf_dir).select(*PAGE, "ord", F.concat(F.lit("native_p"), "page", F.lit("_"), n).alias("new_id"))


@query(f"WITH {_REGIONS}{_KINDS} SELECT * FROM kinds")
def a12_region_kinds(spark, sf_dir):
    return layout.region_kinds(layout.regions(R.layout(spark, sf_dir)), [*PAGE, "region"])


@query(f"WITH {R.OCR}, g AS (SELECT *, min(x0) OVER (PARTITION BY doc_id, page) AS l FROM ocr), s AS (SELECT doc_id, page, unnest(range(floor((x0-l)/2)::INT, floor((x1-l)/2)::INT + 1)) AS step FROM g) SELECT doc_id, page, step::BIGINT AS step, count(*) AS n FROM s GROUP BY ALL")
def a13_x_occupancy(spark, sf_dir):
    return layout.x_occupancy(R.ocr(spark, sf_dir), PAGE)


@query(_CLASSIFIED + """ SELECT k.doc_id, count(*) AS total_elements, count(DISTINCT page) AS pages, count(*) FILTER (content_type LIKE 'heading%' OR content_type = 'title') AS headings, count(*) FILTER (content_type = 'paragraph') AS paragraphs, count(*) FILTER (content_type = 'table') AS tables,
 count(*) FILTER (content_type = 'list_item') AS list_items, count(*) FILTER (content_type = 'formula') AS formulas, count(*) FILTER (content_type = 'header') AS headers, count(*) FILTER (content_type = 'footer') AS footers FROM k GROUP BY k.doc_id""")
def a01_statistics(spark, sf_dir):
    kind = lambda *k: F.count_if(F.col("content_type").isin(*k))
    return classified_layout(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("total_elements"), F.countDistinct("page").alias("pages"), kind("title", "heading", "heading_1", "heading_2", "heading_3").alias("headings"), kind("paragraph").alias("paragraphs"), kind("table").alias("tables"), kind("list_item").alias("list_items"), kind("formula").alias("formulas"), kind("header").alias("headers"), kind("footer").alias("footers"))


@query(_CLASSIFIED + """, kinds AS (SELECT doc_id, content_type, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT doc_id, string_agg(content_type || '=' || n, ',' ORDER BY content_type) AS content_types, sum(n)::BIGINT AS total FROM kinds GROUP BY doc_id)
SELECT doc_id, total, 0::BIGINT AS tagged, total AS inferred, 'untagged' AS status, content_types FROM t""")
def a02_tagging_summary(spark, sf_dir):
    return matching.tagging_summary(classified_layout(spark, sf_dir)).withColumn("content_types", F.array_join(F.transform(F.array_sort(F.map_entries("content_types")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")).select("doc_id", "total", "tagged", "inferred", "status", "content_types")


@query(f"""WITH {R.LAYOUT}, f AS (SELECT doc_id, page, 'font' || (ord % 3) AS name, font_size, bold FROM layout), c AS (SELECT doc_id, page, name, count(*) AS n FROM f GROUP BY ALL), m AS (SELECT doc_id, page, name, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, name) AS rn FROM c)
SELECT f.doc_id, f.page, any_value(m.name) AS font, round(avg(font_size), 1) AS size, count(*) FILTER (bold) > count(*) / 2 AS bold FROM f JOIN m ON f.doc_id = m.doc_id AND f.page = m.page AND rn = 1 GROUP BY f.doc_id, f.page""")
def a04_dominant_font(spark, sf_dir):
    return matching.dominant_font(R.layout(spark, sf_dir).withColumn("name", F.concat(F.lit("font"), F.col("ord") % 3)), PAGE)


@query(f"WITH {R.OCR} SELECT doc_id, page, coalesce(avg(CASE WHEN ord % 4 <> 0 THEN confidence END), 0.85)::DOUBLE AS confidence, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ocr GROUP BY doc_id, page")
def a10_a11_page_rollup(spark, sf_dir):
    e = R.ocr(spark, sf_dir)
    return e.groupBy(*PAGE).agg(F.coalesce(F.avg(F.when(F.col("ord") % 4 != 0, F.col("confidence"))), F.lit(0.85)).alias("confidence"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


_ONCE_COVERED = "greatest(0, least({v}.x1,{k}.x1)-greatest({v}.x0,{k}.x0))*greatest(0, least({v}.y1,{k}.y1)-greatest({v}.y0,{k}.y0)) / (({v}.x1-{v}.x0)*({v}.y1-{v}.y0)) >= 0.6 AND ({k}.x1-{k}.x0)*({k}.y1-{k}.y0) <= 2.5*({v}.x1-{v}.x0)*({v}.y1-{v}.y0)"


def in_turn_sql(relation: str, clash: str) -> str:
    """A greedy choice: the boxes v for which no box k taken before has ``clash``, in the state of ``done``."""
    step = f"CASE WHEN len(list_filter(s, lambda k: {clash.format(v='x', k='k')})) > 0 THEN s ELSE list_append(s, x) END"
    return fold_sql(relation, "ord x0 y0 x1 y1", "ord", "l[1:0]", step)


@query(f"""WITH RECURSIVE {_BOTH}, seen AS (SELECT doc_id, page, ord, x0 + 150 * (ord % 2) AS x0, y0, x1 + 150 * (ord % 2) AS x1, y1 FROM every WHERE ord >= 1000 AND ord % 3 <> 0),
v AS (SELECT * FROM seen UNION ALL SELECT doc_id, page, ord + 1000, x0 + 30 * (ord % 4), y0 + 2, x1 + 30 * (ord % 4), y1 + 2 FROM seen), k AS (SELECT * FROM every WHERE ord < 1000),
rest AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = v.doc_id AND k.page = v.page AND {_ONCE_COVERED.format(v='v', k='k')})),
{in_turn_sql('rest', _ONCE_COVERED)}
SELECT doc_id, page, b.ord AS ord FROM (SELECT doc_id, page, unnest(s) AS b FROM done)""")
def j06_new_visuals(spark, sf_dir):
    """Visuals that are seen twice, the second time up to 90 points aside."""
    e = both(spark, sf_dir).select(*PAGE, "ord", "x0", "y0", "x1", "y1")
    seen = e.where((F.col("ord") >= 1000) & (F.col("ord") % 3 != 0)).withColumns({c: F.col(c) + 150 * (F.col("ord") % 2) for c in ("x0", "x1")})
    aside = 30 * (F.col("ord") % 4)
    again = seen.select(*PAGE, (F.col("ord") + 1000).alias("ord"), (F.col("x0") + aside).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x1") + aside).alias("x1"), (F.col("y1") + 2).alias("y1"))
    return layout.new_visuals(seen.unionByName(again), e.where(F.col("ord") < 1000)).select(*PAGE, "ord")


@query(f"""WITH {R.LAYOUT}, s AS (SELECT * FROM layout WHERE ord % 3 <> 0), b AS (SELECT doc_id, page, ord, x0 + 20 AS x0, y1 + 4 AS y0, x1 - 20 AS x1, y1 + 5 AS y1 FROM layout WHERE ord % 3 = 0),
p AS (SELECT s.doc_id, s.page, b.ord AS bar, s.ord, least(s.x1,b.x1)-greatest(s.x0,b.x0) AS ov, s.x1-s.x0 AS w, s.x0 >= b.x0-3 AND s.x1 <= b.x1+3 AS inside, CASE WHEN s.y1 BETWEEN b.y0-22 AND b.y0+2 THEN 'num' WHEN s.y0 BETWEEN b.y1-2 AND b.y1+22 THEN 'den' END AS part FROM s JOIN b ON s.doc_id=b.doc_id AND s.page=b.page)
SELECT doc_id, page, bar, ord, part FROM p WHERE part IS NOT NULL AND (ov/greatest(1.0, w) >= 0.4 OR inside)""")
def j09_fraction_members(spark, sf_dir):
    e = R.layout(spark, sf_dir).select(*PAGE, "ord", "x0", "y0", "x1", "y1")
    bars = e.where(F.col("ord") % 3 == 0).select(*PAGE, "ord", (F.col("x0") + 20).alias("x0"), (F.col("y1") + 4).alias("y0"), (F.col("x1") - 20).alias("x1"), (F.col("y1") + 5).alias("y1"))
    return layout.fraction_members(e.where(F.col("ord") % 3 != 0), bars)


_BARS = "b AS (SELECT doc_id, page, x0 + 20 AS x0, y1 - 6 AS y0, x1 - 20 AS x1, y1 - 5 AS y1 FROM layout WHERE ord % 5 = 0)"
_HELD = "EXISTS (SELECT 1 FROM b WHERE b.doc_id=l.doc_id AND b.page=l.page AND l.x0-5 <= b.x0 AND b.x1 <= l.x1+5 AND b.y0 BETWEEN l.y0-5 AND l.y1+5)"


def _bars(e):
    return e.where(F.col("ord") % 5 == 0).select(*PAGE, (F.col("x0") + 20).alias("x0"), (F.col("y1") - 6).alias("y0"), (F.col("x1") - 20).alias("x1"), (F.col("y1") - 5).alias("y1"))


@query(f"WITH {R.LAYOUT}, {_BARS} SELECT doc_id, page, ord FROM layout l WHERE {_HELD}")
def j15_blocks_at_bars(spark, sf_dir):
    e = R.layout(spark, sf_dir)
    return layout.blocks_at_bars(e, _bars(e)).select(*PAGE, "ord")


@query(f"""WITH RECURSIVE {R.LAYOUT}, {_BARS}, h AS (SELECT doc_id, page, ord, y0, y1, {_HELD} AS held FROM (SELECT * REPLACE (y1 + (ord % 2) * 14 AS y1) FROM layout) l),
lists AS (SELECT doc_id, page, list({{'ord': ord, 'y0': y0, 'y1': y1, 'held': held}} ORDER BY ord) AS l FROM h GROUP BY ALL),
turns AS (SELECT doc_id, page, l, 0 AS i, [{{'ord': -1, 'cluster': -1}}] AS got FROM lists
 UNION ALL SELECT doc_id, page, l, i + 1, CASE WHEN list_contains(list_transform(got, lambda x: x.ord), l[i + 1].ord) THEN got ELSE list_concat(got, list_transform(list_filter(l, lambda x: x.ord = l[i + 1].ord OR (l[i + 1].held AND NOT list_contains(list_transform(got, lambda g: g.ord), x.ord) AND least(x.y1, l[i + 1].y1) - greatest(x.y0, l[i + 1].y0) > 3)), lambda x: {{'ord': x.ord, 'cluster': l[i + 1].ord}})) END FROM turns WHERE i < len(l))
SELECT doc_id, page, g.ord AS ord, g.cluster AS cluster FROM (SELECT doc_id, page, unnest(got) AS g FROM turns WHERE i = len(l)) WHERE g.ord >= 0""")
def j15_bar_clusters(spark, sf_dir):
    """Bars stand in every fifth block; every other block reaches into the row below."""
    e = R.layout(spark, sf_dir)
    taller = e.withColumn("y1", F.col("y1") + F.col("ord") % 2 * 14)
    return layout.bar_clusters(taller, _bars(e))


@query(f"""WITH {R.LAYOUT}, s AS (SELECT *, 11.0 - 3 * (ord % 2) AS size, y1 - 4 * (ord % 2) AS base, left(text, 1 + ord % 5) || CASE ord % 4 WHEN 0 THEN '+1' WHEN 1 THEN '−2' ELSE '' END AS t FROM layout WHERE ord % 3 <> 0),
b AS (SELECT doc_id, page, ord, x0 - 300 AS x0, y1 + 4 AS y0, x1 + 300 AS x1, y1 + 5 AS y1 FROM layout WHERE ord % 3 = 0),
m AS (SELECT s.doc_id, s.page, b.ord AS bar, s.ord, s.x0, s.x1, b.x0 AS bx0, b.x1 AS bx1, size, base, trim(t) AS t, CASE WHEN s.y1 BETWEEN b.y0-22 AND b.y0+2 THEN 'num' WHEN s.y0 BETWEEN b.y1-2 AND b.y1+22 THEN 'den' END AS part FROM s JOIN b ON s.doc_id=b.doc_id AND s.page=b.page WHERE (least(s.x1,b.x1)-greatest(s.x0,b.x0))/greatest(1.0, s.x1-s.x0) >= 0.4 OR (s.x0 >= b.x0-3 AND s.x1 <= b.x1+3)),
k AS (SELECT *, CASE WHEN size < 0.85 * lag(size) OVER w AND base < lag(base) OVER w - 2 THEN '^' || t ELSE t END AS token FROM m WHERE part IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page, bar, part ORDER BY x0, ord)),
f AS (SELECT doc_id, page, bar, trim(coalesce(string_agg(token, '' ORDER BY x0, ord) FILTER (part = 'num'), '')) AS num, trim(coalesce(string_agg(token, '' ORDER BY x0, ord) FILTER (part = 'den'), '')) AS den, least(min(bx0), min(x0)) AS x0, greatest(max(bx1), max(x1)) AS x1 FROM k GROUP BY doc_id, page, bar),
g AS (SELECT *, CASE WHEN regexp_matches(num, '[-+−]') THEN '(' || num || ')' ELSE num END AS n, CASE WHEN regexp_matches(den, '[-+−]') THEN '(' || den || ')' ELSE den END AS d FROM f)
SELECT doc_id, page, bar, CASE WHEN den <> '' THEN n || '/' || d ELSE num END AS text, x0, x1 FROM g""")
def f29_fraction_texts(spark, sf_dir):
    """Short terms above and below long bars; every other one is small and raised."""
    e, odd = R.layout(spark, sf_dir), F.col("ord") % 2
    sign = F.when(F.col("ord") % 4 == 0, "+1").when(F.col("ord") % 4 == 1, "\u22122").otherwise("")
    spans = e.where(F.col("ord") % 3 != 0).select(*PAGE, "ord", "x0", "y0", "x1", "y1", F.concat(F.left("text", 1 + F.col("ord") % 5), sign).alias("text"), (11.0 - 3 * odd).alias("size"), (F.col("y1") - 4 * odd).alias("base"))
    bars = e.where(F.col("ord") % 3 == 0).select(*PAGE, "ord", (F.col("x0") - 300).alias("x0"), (F.col("y1") + 4).alias("y0"), (F.col("x1") + 300).alias("x1"), (F.col("y1") + 5).alias("y1"))
    return layout.fraction_texts(spans, bars)


@query(f"WITH {R.OCR} SELECT a.doc_id, a.page, a.ord, count(*) AS n FROM ocr a JOIN ocr b ON a.doc_id=b.doc_id AND a.page=b.page AND (abs(a.x0-b.x0) <= 15 OR abs((a.x0+a.x1)/2-(b.x0+b.x1)/2) <= 15) GROUP BY ALL HAVING count(*) >= 3")
def j12_column_members(spark, sf_dir):
    return layout.column_members(R.ocr(spark, sf_dir).select(*PAGE, "ord", "x0", "x1"))


_TERMS = R.OCR + """, terms AS (SELECT doc_id, page, ord, length(text) || CASE ord % 3 WHEN 0 THEN '+x' WHEN 1 THEN 'a' ELSE '' END AS text, x0 + 700 * ((ord - 1) // 4) AS x0, y0, x1 + 700 * ((ord - 1) // 4) AS x1, y0 + 14 AS y1 FROM ocr)"""
_UNDER = f"l[k].y0 - x.y0 BETWEEN 2 AND 26 AND {_APART.format(a='x', b='l[k]')} < 999 AND ({_MEET.format(a='x', b='l[k]')} > 0.25 * {_THIN.format(a='x', b='l[k]')} OR {_APART.format(a='x', b='l[k]')} <= greatest(10.0, 0.5 * {_WIDE.format(a='x', b='l[k]')}))"


@query(f"""WITH RECURSIVE {_TERMS}, t AS (SELECT * FROM terms WHERE length(text) <= 12 AND NOT regexp_matches(text, '{matching.NO_SHORT_TERM}')),
{fold_sql("t", "ord x0 y0 x1", "y0, x0, ord", **_pair_step(_UNDER, _APART.format(a='x', b='l[k]')))}
SELECT doc_id, page, l[p.n].ord AS num, l[p.d].ord AS den FROM (SELECT doc_id, page, l, unnest(s) AS p FROM done) WHERE p.n > 0""")
def j10_fraction_pairs(spark, sf_dir):
    e = matching.terms(R.ocr(spark, sf_dir))
    return e.where(matching.is_short_term(F.col("text"))).groupBy(*PAGE).applyInPandas(matching.fraction_pairs, "doc_id long, page int, num int, den int")


_BELOW = f"k > i + 1 AND x.free AND l[k].free AND l[k].y0 - x.y1 >= -5 AND l[k].y0 - x.y1 < 3.5 * greatest(1.0, x.y1 - x.y0, l[k].y1 - l[k].y0) AND ({_APART.format(a='x', b='l[k]')} < 0.7 * {_WIDE.format(a='x', b='l[k]')} OR {_MEET.format(a='x', b='l[k]')} > 0.25 * {_THIN.format(a='x', b='l[k]')})"
_PART = "CASE WHEN regexp_matches({t}, '[-+=]') THEN '(' || regexp_replace({t}, '([a-zA-Z0-9])\\s*([+\\-])\\s*([a-zA-Z0-9])', '\\1 \\2 \\3', 'g') || ')' ELSE {t} END"


@query(f"""WITH RECURSIVE {_TERMS}, beside AS (SELECT a.doc_id, a.page, a.ord, count(*) AS n FROM terms a JOIN terms b ON a.doc_id = b.doc_id AND a.page = b.page AND ({_APART.format(a='a', b='b')} <= greatest(12.0, 0.4 * {_WIDE.format(a='a', b='b')}) OR {_MEET.format(a='a', b='b')} > 0.4 * {_THIN.format(a='a', b='b')}) GROUP BY ALL),
t AS (SELECT terms.*, n < 3 AND NOT regexp_matches(text, '^[0-9]{{3,}}$') AS free FROM terms JOIN beside USING (doc_id, page, ord)),
{fold_sql("t", "ord text free x0 y0 x1 y1", "y0, x0, ord", **_pair_step(_BELOW))},
every_item AS (SELECT doc_id, page, l, s, unnest(range(1, len(l) + 1)) AS i FROM done), paired AS (SELECT *, list_filter(s, lambda p: p.n = i)[1].d AS d FROM every_item WHERE NOT list_contains(list_transform(s, lambda p: p.d), i))
SELECT doc_id, page, l[i].ord AS ord, CASE WHEN d IS NULL THEN l[i].text ELSE {_PART.format(t='l[i].text')} || '/' || {_PART.format(t='l[d].text')} END AS text FROM paired""")
def j11_vertical_fractions(spark, sf_dir):
    e = matching.terms(R.ocr(spark, sf_dir)).withColumn("term", matching.is_fraction_term(F.col("text")))
    return e.groupBy(*PAGE).applyInPandas(matching.vertical_fractions, "doc_id long, page int, ord int, text string")


_MARK = "upper(trim(l[k].text)) IN ('TM', '™', 'M') AND k <> i + 1 AND l[k].x0 - x.x1 BETWEEN -25 AND 70 AND l[k].y0 <= x.y0 + 0.45 * (x.y1 - x.y0) AND l[k].y1 - l[k].y0 <= 0.55 * (x.y1 - x.y0)"


@query(f"""WITH RECURSIVE {R.OCR}, marked AS ({_MARKED}), {fold_sql("marked", "ord text x0 y0 x1 y1", "ord", **_pair_step(_MARK))},
every_item AS (SELECT doc_id, page, l, s, unnest(range(1, len(l) + 1)) AS i FROM done), paired AS (SELECT *, list_filter(s, lambda p: p.n = i)[1].d AS d FROM every_item WHERE NOT list_contains(list_transform(s, lambda p: p.d), i))
SELECT doc_id, page, l[i].ord AS ord, CASE WHEN d IS NULL THEN l[i].text ELSE {sql_strip("regexp_replace(" + sql_strip("l[i].text") + ", '[.]$', '')")} || ' TM' END AS text FROM paired""")
def j13_superscripts(spark, sf_dir):
    e = matching.with_marks(R.ocr(spark, sf_dir))
    return e.groupBy(*PAGE).applyInPandas(matching.superscript_marks, "doc_id long, page int, ord int, text string")


@query()
def j14_line_recovery(spark, sf_dir):
    e = R.layout(spark, sf_dir).unionByName(R.ocr(spark, sf_dir)).select(*PAGE, "ord", "source", "text", "y0")
    return matching.line_recovery(e)


@query(f"""WITH RECURSIVE {_BOTH}, kept AS (SELECT * FROM every WHERE NOT (x1 - x0 > 0.65 * 600 AND y1 - y0 > 0.65 * (14 + 4 * (ord % 5)))),
{in_turn_sql('kept', 'abs({k}.x0 - {v}.x0) < 8 AND abs({k}.y0 - {v}.y0) < 8 AND abs({k}.x1 - {v}.x1) < 8 AND abs({k}.y1 - {v}.y1) < 8')}
SELECT doc_id, page, b.ord AS ord FROM (SELECT doc_id, page, unnest(s) AS b FROM done)""")
def u04_dedupe_boxes(spark, sf_dir):
    """Native and OCR boxes on pages that are so low that boxes across them contain some of them."""
    e = both(spark, sf_dir).select(*PAGE, "ord", "x0", "y0", "x1", "y1", F.lit(600.0).alias("page_width"), (14.0 + 4 * (F.col("ord") % 5)).alias("page_height"))
    return layout.distinct_boxes(e).select(*PAGE, "ord")


@query(f"WITH {_BOTH} SELECT doc_id, page, count(*) AS n, count(*) FILTER (ord >= 1000) AS n_ocr, sum(x1 - x0)::DOUBLE AS width FROM every GROUP BY doc_id, page")
def u01_union(spark, sf_dir):
    return both(spark, sf_dir).groupBy(*PAGE).agg(F.count("*").alias("n"), F.count_if(F.col("ord") >= 1000).alias("n_ocr"), F.sum(F.col("x1") - F.col("x0")).alias("width"))


@query(f"WITH {R.OCR}, b AS (SELECT doc_id, page, (ord - 1) // 4 AS block, min(y0) AS y0, max(y1) AS y1 FROM layout GROUP BY ALL) SELECT doc_id, page, 'block' AS kind, y0, y1 FROM b UNION ALL SELECT doc_id, page, 'line', y0, y1 FROM ocr")
def u02_blocks_and_lines(spark, sf_dir):
    blocks = R.layout(spark, sf_dir).groupBy(*PAGE, F.floor((F.col("ord") - 1) / 4)).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return blocks.select(*PAGE, F.lit("block").alias("kind"), "y0", "y1").unionByName(R.ocr(spark, sf_dir).select(*PAGE, F.lit("line").alias("kind"), "y0", "y1"))


@query(f"WITH {R.OCR} SELECT doc_id, page, ord FROM layout EXCEPT SELECT doc_id, page, ord FROM ocr")
def u05_unused(spark, sf_dir):
    return R.layout(spark, sf_dir).select(*PAGE, "ord").join(R.ocr(spark, sf_dir).select(*PAGE, "ord"), [*PAGE, "ord"], "left_anti")


@query(f"WITH {R.OCR} SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN ord % 6 = 0 THEN 99999 ELSE 40 - ord END, y0, x0, ord)::INT AS place FROM ocr")
def o01_output_order(spark, sf_dir):
    e = R.ocr(spark, sf_dir).withColumn("reading_order", F.when(F.col("ord") % 6 == 0, 0).otherwise(40 - F.col("ord")))
    return e.select(*PAGE, "ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*layout.output_order())).alias("place"))


@query(f"WITH {R.OCR} SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord)::INT AS place FROM ocr")
def o02_vertical_order(spark, sf_dir):
    return R.ocr(spark, sf_dir).select(*PAGE, "ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "ord")).alias("place"))


@query(f"WITH {R.OCR}, g AS (SELECT doc_id, page, (ord - 1) // 4 AS grp, avg((y0 + y1) / 2) AS yc, min(x0) AS x0 FROM ocr GROUP BY ALL) SELECT doc_id, page, grp::BIGINT AS grp, row_number() OVER (PARTITION BY doc_id, page ORDER BY yc, x0, grp)::INT AS place FROM g")
def o06_row_groups(spark, sf_dir):
    g = R.ocr(spark, sf_dir).groupBy(*PAGE, F.floor((F.col("ord") - 1) / 4).alias("grp")).agg(F.avg((F.col("y0") + F.col("y1")) / 2).alias("yc"), F.min("x0").alias("x0"))
    return g.select(*PAGE, "grp", F.row_number().over(Window.partitionBy(*PAGE).orderBy("yc", "x0", "grp")).alias("place"))


@query(f"""WITH {R.OCR} SELECT doc_id, page, ord, text FROM ocr WHERE NOT (ord % 9 = 4 AND (regexp_matches(text, 'ation|tion') OR length(text) < 15))""")
def p03_watermark(spark, sf_dir):
    tilted = F.col("ord") % 9 == 4
    return R.ocr(spark, sf_dir).where(~matching.watermark(F.when(tilted, 0.5).otherwise(0.0), F.col("text"), F.lit(11.0), ["ation", "tion"], [])).select(*PAGE, "ord", "text")


@query(f"WITH {R.OCR} SELECT doc_id, page, CASE WHEN sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) >= 5 THEN 'TEXT_BASED' WHEN sum(length(text)) < 15 THEN 'OCR' ELSE 'TEXT_BASED_SPARSE' END AS route, sum(length(text)) < 15 AS scanned FROM ocr GROUP BY doc_id, page")
def p08_p09_page_route(spark, sf_dir):
    words = F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != "")))
    chars = F.sum(F.length("text"))
    return R.ocr(spark, sf_dir).groupBy(*PAGE).agg(F.when(words >= 5, "TEXT_BASED").when(chars < 15, "OCR").otherwise("TEXT_BASED_SPARSE").alias("route"), (chars < 15).alias("scanned"))


@query(f"WITH {R.OCR}, f AS (SELECT *, ord % 4 = 0 OR page % 2 = 0 AS dup FROM ocr WHERE trim(text) <> ''), g AS (SELECT *, bool_or(NOT dup) OVER (PARTITION BY doc_id, page) AS any_ FROM f) SELECT doc_id, page, ord FROM g WHERE NOT dup OR NOT any_")
def p10_reconstruct_filter(spark, sf_dir):
    e = R.ocr(spark, sf_dir).withColumn("possible_duplicate", (F.col("ord") % 4 == 0) | (F.col("page") % 2 == 0))
    return matching.to_reconstruct(e).select(*PAGE, "ord")


@query(f"""WITH {R.OCR}, w AS (SELECT *, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS nw, CASE WHEN ord % 3 = 0 THEN 'figure' ELSE 'text' END AS kind FROM ocr)
SELECT doc_id, page, ord, CASE WHEN kind = 'figure' AND (nw >= 15 OR length(text) >= 80) THEN 'text' ELSE kind END AS kind, CASE WHEN ord % 5 <> 0 AND x1 > x0 AND y1 > y0 THEN 'Validated' ELSE 'Needs Review' END AS validation, regexp_matches(text, '^[+−\\s-]+$') AS operator_fragment FROM w""")
def p11_p12_p15_flags(spark, sf_dir):
    e = R.ocr(spark, sf_dir).withColumn("kind", F.when(F.col("ord") % 3 == 0, "figure").otherwise("text"))
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    demoted = F.when((F.col("kind") == "figure") & ((words >= 15) | (F.length("text") >= 80)), "text").otherwise(F.col("kind"))
    valid = (F.col("ord") % 5 != 0) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    return e.select(*PAGE, "ord", demoted.alias("kind"), F.when(valid, "Validated").otherwise("Needs Review").alias("validation"), F.col("text").rlike(r"^[+\-−\s]+$").alias("operator_fragment"))


@query(f"WITH {R.LAYOUT}, c AS (SELECT doc_id, page, (ord - 1) // 3 AS r, list(trim(text) ORDER BY ord) AS cells FROM layout GROUP BY ALL) SELECT doc_id, page, r::BIGINT AS r, array_to_string(list_filter(cells, lambda x: x <> ''), ' | ') AS line FROM c")
def p18_table_text(spark, sf_dir):
    cells = F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("c"))))
    rows = R.layout(spark, sf_dir).groupBy(*PAGE, F.floor((F.col("ord") - 1) / 3).alias("r")).agg(F.transform(cells, lambda x: x["c"]).alias("cells"))
    return rows.select(*PAGE, "r", matching.table_line(F.col("cells"), " | ").alias("line"))


@query(f"WITH {_BOTH}, s AS (SELECT l.doc_id, l.page, l.ord, source, type FROM layout l UNION ALL SELECT doc_id, page, ord, source, type FROM ocr) SELECT doc_id, count(*) FILTER (source = 'native') AS native, count(*) FILTER (source = 'ocr') AS ocr, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (source IN ('ocr') AND type <> 'table' OR ord = 1) AS shown FROM s GROUP BY doc_id")
def p13_p21_facets(spark, sf_dir):
    e = R.layout(spark, sf_dir).unionByName(R.ocr(spark, sf_dir))
    shown = (F.col("source").isin("ocr") & (F.col("type") != "table")) | (F.col("ord") == 1)
    return e.groupBy("doc_id").agg(F.count_if(F.col("source") == "native").alias("native"), F.count_if(F.col("source") == "ocr").alias("ocr"), F.count_if(F.col("type") == "table").alias("tables"), F.count_if(shown).alias("shown"))
