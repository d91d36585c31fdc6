"""Greedy and sequential steps of layout analysis, page by page, and small aggregates and predicates beside them.

A greedy step takes items in a fixed order and each choice uses its items up, so it has no relational form; it runs as a
Python function on one page at a time, and a page bounds its memory.
"""

from __future__ import annotations

import heapq
import itertools
import re
from bisect import bisect_left

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.classify import CAPTION, NUMBERED, SECTION
from pagewright.functions.text import strip

# Names of functions and the signs that no term of a fraction holds; texts of trademark signs.
FUNCTIONS = ["sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "lim", "exp", "mod", "sqrt"]
NO_TERM = r"""[:;,!?"'@#$%&]"""
NO_SHORT_TERM = r"""[:;,!?"=+]"""
TRADEMARKS = ["TM", "™", "M"]
# End of fixed values.


def is_fraction_term(c: Column) -> Column:
    """at most 18 characters and 4 words, none of NO_TERM, no word of 3 letters but a function's name, whole numbers up to 99."""
    t = strip(F.coalesce(c, F.lit("")))
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    letters = lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z]", ""))
    long = F.exists(words, lambda w: (F.length(letters(w)) >= 3) & ~letters(w).isin(FUNCTIONS))
    big = t.rlike(r"^\p{Nd}+$") & (F.length(F.regexp_replace(t, "^0+", "")) > 2)
    return (F.length(t) <= 18) & ~t.rlike(NO_TERM) & (F.size(words) <= 4) & ~long & ~big & t.rlike("[0-9a-zA-Z+*-]")


def is_short_term(c: Column) -> Column:
    """J10's terms: at most 12 characters, none of NO_SHORT_TERM."""
    t = strip(F.coalesce(c, F.lit("")))
    return (F.length(t) <= 12) & ~t.rlike(NO_SHORT_TERM)


def terms(e: DataFrame) -> DataFrame:
    """Items that carry the length of their text, every third with a sum, four to a column."""
    i = F.col("ord") - 1
    aside = 700.0 * F.floor(i / 4)
    t = F.concat(F.length("text").cast("string"), F.when(F.col("ord") % 3 == 0, "+x").when(F.col("ord") % 3 == 1, "a").otherwise(""))
    return e.select("doc_id", "page", "ord", t.alias("text"), (F.col("x0") + aside).alias("x0"), "y0", (F.col("x1") + aside).alias("x1"), (F.col("y0") + 14.0).alias("y1"))


def with_marks(e: DataFrame) -> DataFrame:
    """Every fourth item becomes a small mark beside the item before; some others end in a full stop."""
    o = F.col("ord")
    mark = o % 4 == 0
    sign = F.when(o % 3 == 0, "TM").when(o % 3 == 1, "™").otherwise("m")
    text = F.when(mark, sign).otherwise(F.concat("text", F.when(o % 3 == 0, ".").otherwise("")))
    return e.select("doc_id", "page", "ord", text.alias("text"), F.when(mark, F.col("x1") - 300).otherwise(F.col("x0")).alias("x0"), "y0", F.when(mark, F.col("x1") - 290).otherwise(F.col("x1")).alias("x1"), F.when(mark, F.col("y0") + 5).otherwise(F.col("y1")).alias("y1"))


def _meet(a, b) -> float:
    """Width that two items share."""
    return max(0.0, min(a.x1, b.x1) - max(a.x0, b.x0))


def _apart(a, b) -> float:
    return abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2)


def _wide(a) -> float:
    return max(1.0, a.x1 - a.x0)


def _result(g: pd.DataFrame, **columns) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": g.doc_id.iloc[0], "page": g.page.iloc[0], **columns})


def fraction_pairs(g: pd.DataFrame) -> pd.DataFrame:
    """Each item takes the nearest centre among items 2 to 26 points below that overlap it or stand under it; no item is used twice.

    Items are those of ``is_short_term``; of equally near ones the first from the top and the left counts.
    """
    rows = list(g.sort_values(["y0", "x0", "ord"], kind="stable").itertuples())
    used, out = set(), []
    for i, top in enumerate(rows):
        if i in used:
            continue
        under = [(_apart(top, low), j) for j, low in enumerate(rows[i + 1 :], i + 1) if j not in used and 2 <= low.y0 - top.y0 <= 26]
        under = [(d, j) for d, j in under if d < 999 and (_meet(top, rows[j]) > 0.25 * min(_wide(top), _wide(rows[j])) or d <= max(10.0, 0.5 * max(_wide(top), _wide(rows[j]))))]
        if under:
            j = min(under)[1]
            used |= {i, j}
            out.append((top.ord, rows[j].ord))
    return _result(g, num=[n for n, _ in out], den=[d for _, d in out]).astype({"num": "int32", "den": "int32"})


def clean_math_term(t: str) -> str:
    """exponents and indices of letters and digits lose their braces."""
    return re.sub(r"([\^_])\{([a-zA-Z0-9]+)\}", r"\1\2", t.strip())


def _enclosed(t: str) -> bool:
    """Whether one pair of parentheses holds the whole text."""
    depths = list(itertools.accumulate((c == "(") - (c == ")") for c in t))
    return t.startswith("(") and t.endswith(")") and 0 not in depths[:-1]


def format_fraction(num: str, den: str) -> str:
    """num/den; what holds a sign of a sum or an equation gets parentheses, unless they enclose it."""
    parts = [re.sub(r"^-\s+", "-", clean_math_term(x)) for x in (num, den)]
    return "/".join(f"({x})" if any(c in x for c in "+-=") and not _enclosed(x) else x for x in parts)


def _spaced_fraction(num: str, den: str) -> str:
    """num/den with blanks around signs between letters or digits; a sum or an equation in parentheses unless some stand at both ends."""
    parts = [re.sub(r"([a-zA-Z0-9])\s*([+\-])\s*([a-zA-Z0-9])", r"\1 \2 \3", x.strip()) for x in (num, den)]
    return "/".join(f"({x})" if any(c in x for c in "+-=") and not (x[0] == "(" and x[-1] == ")") else x for x in parts)


def vertical_fractions(g: pd.DataFrame) -> pd.DataFrame:
    """A term and the first fitting term below it become one fraction; other items stay.  ``term`` tells the terms of F17.

    Items of which three or more stand in one column are of a table and take no part.
    """
    rows = list(g.sort_values(["y0", "x0", "ord"], kind="stable").itertuples())
    stacked = lambda a: sum(_apart(a, b) <= max(12.0, 0.4 * max(_wide(a), _wide(b))) or _meet(a, b) > 0.4 * min(_wide(a), _wide(b)) for b in rows) >= 3
    free = {i for i, a in enumerate(rows) if a.term and not stacked(a)}
    tall = lambda a: max(1.0, a.y1 - a.y0)
    fits = lambda a, b: -5 <= b.y0 - a.y1 < 3.5 * max(tall(a), tall(b)) and (_apart(a, b) < 0.7 * max(_wide(a), _wide(b)) or _meet(a, b) > 0.25 * min(_wide(a), _wide(b)))
    used, out = set(), []
    for i, a in enumerate(rows):
        if i in used:
            continue
        j = next((j for j in range(i + 1, len(rows)) if i in free and j in free and j not in used and fits(a, rows[j])), None)
        used |= {i, j}
        out.append((a.ord, a.text if j is None else _spaced_fraction(a.text, rows[j].text)))
    return _result(g, ord=[o for o, _ in out], text=[t for _, t in out])


def superscript_marks(g: pd.DataFrame) -> pd.DataFrame:
    """An item takes the first unused small trademark sign at its upper right; a full stop before it goes."""
    rows = list(g.sort_values("ord", kind="stable").itertuples())
    mark = [(a.text or "").strip().upper() in TRADEMARKS for a in rows]
    used, out = set(), []
    for i, a in enumerate(rows):
        if i in used:
            continue
        tall = a.y1 - a.y0
        j = next((j for j, m in enumerate(rows) if mark[j] and j != i and j not in used and -25 <= m.x0 - a.x1 <= 70 and m.y0 <= a.y0 + 0.45 * tall and m.y1 - m.y0 <= 0.55 * tall), None)
        used |= {i, j}
        out.append((a.ord, a.text if j is None else f"{(a.text or '').strip().removesuffix('.').strip()} TM"))
    return _result(g, ord=[o for o, _ in out], text=[t for _, t in out])


def ratio_reaches(a: str, b: str, least: float) -> bool:
    """Whether ``difflib.SequenceMatcher(None, a, b).ratio() >= least``, found without difflib's loops.

    Longest common parts are found by substring search, and the search ends as soon as the parts found, or the most that the
    rest could add, decide.  As in difflib, letters that are popular in a ``b`` of 200 characters or more begin no common
    part but prolong one, and of equally long parts that first in ``a``, then in ``b``, counts.
    """
    length = len(a) + len(b)
    reached = lambda n: (2.0 * n / length if length else 1.0) >= least
    if a == b:
        return reached(len(b))
    room = min(len(a), len(b))
    if not reached(room):
        return False
    seed_a, seed_b = a, b
    if len(b) >= 200:
        popular = {ord(c) for c in set(b) if b.count(c) > len(b) // 100 + 1}
        unlike_a, unlike_b = itertools.islice((c for c in map(chr, itertools.count()) if c not in a and c not in b), 2)
        seed_a, seed_b = a.translate(dict.fromkeys(popular, unlike_a)), b.translate(dict.fromkeys(popular, unlike_b))
    begins = set(seed_b)
    at = [k for k, c in enumerate(seed_a) if c in begins]
    found, rest = 0, [(-room, 0, len(a), 0, len(b))]
    while rest:
        if reached(found):
            return True
        if not reached(found + room):
            return False
        most, a0, a1, b0, b1 = heapq.heappop(rest)
        room += most
        part, size, i = seed_b[b0:b1], 0, a0
        for k in at[bisect_left(at, a0) : bisect_left(at, a1)]:
            if k + size >= a1:
                break
            while k + size < a1 and seed_a[k : k + size + 1] in part:
                size, i = size + 1, k
        j = b0 + part.find(seed_a[i : i + size])
        if seed_a is not a:
            while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
                size += 1
        if size:
            found += size
            for x in ((a0, i, b0, j), (i + size, a1, j + size, b1)):
                most = min(x[1] - x[0], x[3] - x[2])
                if most:
                    room += most
                    heapq.heappush(rest, (-most, *x))
    return reached(found)


def recovered(native: list[tuple[int, str, float]], ocr: list[tuple[int, str, float]]) -> list[tuple[int, str, str]]:
    """J14 of one page: ord, text and origin from lines (ord, text, y0) in their order; see ``line_recovery``."""
    out = [[o, t or "", y, "native", (t or "").strip().lower()] for o, t, y in native]
    for _, t, y in ocr:
        new = (t or "").strip()
        if not new:
            continue
        low = new.lower()
        alike = [x for x in out if x[4] and abs(x[2] - y) < 40 and ((len(x[4]) >= 8 and x[4] in low) or ratio_reaches(low, x[4], 0.55))]
        if not alike:
            out.append([1000 + len(out), new, y, "added", low])
            continue
        alike[0][1:] = [new, y, "replaced", low]
        for x in alike[1:]:
            x[1] = x[4] = ""
    return [(x[0], x[1], x[3]) for x in out if x[1].strip()]


def recovered_lines(g: pd.DataFrame) -> pd.DataFrame:
    """J14 of one page as a table; see ``line_recovery``."""
    g = g.sort_values(["source", "ord"], kind="stable")
    native, ocr = (list(g.loc[g.source == s, ["ord", "text", "y0"]].itertuples(index=False, name=None)) for s in ("native", "ocr"))
    out = recovered(native, ocr)
    return _result(g, ord=[x[0] for x in out], text=[x[1] for x in out], origin=[x[2] for x in out])


def line_recovery(elements: DataFrame) -> DataFrame:
    """A line read again replaces the first line it resembles within 40 points, others that it resembles go; else it is added.

    Two lines are alike from a ratio of 0.55, or if the old one has 8 characters and is part of the new one; case doesn't
    count.  A replaced line stands where the new one does, and lines read later meet it there.  Lines go to Python as one
    array for each page.
    """
    listed = F.array_sort(F.collect_list(F.struct("source", "ord", "text", F.coalesce("y0", F.lit(float("nan"))).alias("y0"))))
    pages = elements.where(F.col("source").isin("native", "ocr")).groupBy("doc_id", "page").agg(listed.alias("lines"))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                found = []
                for page in part.column(2).to_pylist():
                    by = {s: [(x["ord"], x["text"], x["y0"]) for x in page if x["source"] == s] for s in ("native", "ocr")}
                    found.append([{"ord": o, "text": t, "origin": w} for o, t, w in recovered(by["native"], by["ocr"])])
                kind = pa.list_(pa.struct([("ord", pa.int32()), ("text", pa.string()), ("origin", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)], ["doc_id", "page", "found"])

    done = pages.mapInArrow(run, "doc_id long, page int, found array<struct<ord: int, text: string, origin: string>>")
    return done.select("doc_id", "page", F.inline("found"))


def style_blocks(g: pd.DataFrame) -> pd.DataFrame:
    """Lines with text and their blocks; a block begins at a heading, after one, and where the size differs by 2.5 points.

    A line is a heading by its pattern, by 1.25 times the median size, or bold with at most 12 words and 1.1 times that
    size.  What comes before is a heading if the block's whole text begins like one; its size is the block's largest.
    """
    heading = re.compile("|".join(f"(?:{p.replace('(?i)', '(?i:') + ')' if p.startswith('(?i)') else p})" for p in (SECTION, NUMBERED, CAPTION)))
    block, text, most, out = 0, "", 0.0, []
    for a in g.sort_values("ord", kind="stable").itertuples():
        line = (a.text or "").strip()
        if not line:
            continue
        distinct = heading.match(line) or a.font_size >= 1.25 * a.median or (a.bold and len(line.split()) <= 12 and a.font_size >= 1.1 * a.median)
        if out and (distinct or heading.match(text.strip()) or abs(a.font_size - most) >= 2.5):
            block, text, most = block + 1, "", 0.0
        text, most = text + a.text, max(most, a.font_size)
        out.append((a.ord, block))
    return _result(g, ord=[o for o, _ in out], block=[b for _, b in out]).astype({"ord": "int32", "block": "int32"})


def sub_blocks(g: pd.DataFrame) -> pd.DataFrame:
    """Where left edges differ by 45 points or more, a line joins the first cluster from whose sides it is at most 25 points away."""
    g = g.sort_values("ord", kind="stable")
    if g.x0.max() - g.x0.min() < 45:
        return g[["doc_id", "page", "ord"]].assign(cluster=0)
    sides: list[list[float]] = []
    out = []
    for x0, x1 in zip(g.x0, g.x1):
        k = next((k for k, (low, high) in enumerate(sides) if x1 >= low - 25 and x0 <= high + 25), len(sides))
        if k == len(sides):
            sides.append([x0, x1])
        sides[k] = [min(sides[k][0], x0), max(sides[k][1], x1)]
        out.append(k)
    return g[["doc_id", "page", "ord"]].assign(cluster=out)


def _on_baselines(g: pd.DataFrame) -> list[list]:
    """Items within 8 points of a line's first item form a line; a line's items from left to right."""
    lines: list[list] = []
    for a in g.sort_values(["y0", "x0", "ord"], kind="stable").itertuples():
        line = next((x for x in lines if abs(x[0].y0 - a.y0) <= 8.0), None)
        if line is None:
            lines.append([a])
        else:
            line.append(a)
    return [sorted(line, key=lambda a: a.x0) for line in lines]


# What keeps the items of a line together over a gap.
GLUE_IN, GLUE_END = ("Then", "where", "="), ("+", "-", "=", "*", "/")
# End of fixed values.


def _cut_lines(g: pd.DataFrame, most: float, wide: float | None) -> pd.DataFrame:
    out = []
    for k, line in enumerate(_on_baselines(g)):
        parts: list[str] = []
        end = 0.0
        for a in line:
            gap = a.x0 - end
            if not parts or (gap > most and not any(w in a.text for w in GLUE_IN) and not parts[-1].endswith(GLUE_END)):
                parts.append(a.text)
                end = a.x1
            else:
                blanks = "" if parts[-1].endswith(" ") else "   " if wide is not None and gap > wide else " "
                parts[-1] += blanks + a.text
                end = max(end, a.x1)
        out += [(k, i, t) for i, t in enumerate(parts)]
    return _result(g, line=[x[0] for x in out], part=[x[1] for x in out], text=[x[2] for x in out])


def baseline_lines(g: pd.DataFrame) -> pd.DataFrame:
    """W8 of extraction: lines are cut at gaps over 180 points, but where a formula goes on; gaps over 15 get three blanks."""
    return _cut_lines(g, 180.0, 15.0)


def verified_lines(g: pd.DataFrame) -> pd.DataFrame:
    """W8 of verification: lines are cut at gaps over 30 points, but where a formula goes on."""
    return _cut_lines(g, 30.0, None)


def cohesion_rows(g: pd.DataFrame) -> pd.DataFrame:
    """Rows by nearness to a row's mean centre, tolerance at least 5 points; rows by their mean centres, items from left to right."""
    rows: list[list] = []
    mean = lambda of, r: sum(map(of, r)) / len(r)
    centre, tall = lambda a: (a.y0 + a.y1) / 2, lambda a: max(1.0, a.y1 - a.y0)
    for a in g.sort_values(["y0", "x0", "ord"], kind="stable").itertuples():
        near = next((r for r in rows if abs(centre(a) - mean(centre, r)) <= max(5.0, 0.45 * min(tall(a), mean(tall, r)))), None)
        if near is None:
            rows.append([a])
        else:
            near.append(a)
    rows.sort(key=lambda r: mean(centre, r))
    texts = ["   ".join(a.text for a in sorted(r, key=lambda a: a.x0)) for r in rows]
    return _result(g, row=range(len(texts)), text=texts)


def tagging_summary(elements: DataFrame) -> DataFrame:
    """A2: counts of tagged and inferred elements, of content types and tag sources, and the document's status; one pass over the elements."""
    kinds = elements.groupBy("doc_id", *[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("content_type", "tag_source")]).agg(F.count("*").alias("n"), F.count_if("is_tagged").alias("tagged"))
    out = kinds.groupBy("doc_id").agg(F.sum("n").alias("total"), F.sum("tagged").alias("tagged"), F.collect_list(F.struct("content_type", "tag_source", "n")).alias("kinds"))
    of = lambda c, k: F.aggregate(F.filter("kinds", lambda x: x[c] == k), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    by = lambda c: F.map_from_entries(F.transform(F.array_distinct(F.transform("kinds", lambda x: x[c])), lambda k: F.struct(k, of(c, k))))
    status = F.when(F.col("tagged") == F.col("total"), "tagged").when(F.col("tagged") > 0, "partially_tagged").otherwise("untagged")
    marked = (F.col("tagged") > 0) & (F.col("tagged") >= 0.5 * F.col("total"))
    return out.select("doc_id", "total", "tagged", by("content_type").alias("content_types"), by("tag_source").alias("tag_sources"), (F.col("total") - F.col("tagged")).alias("inferred"), status.alias("status"), marked.alias("is_tagged_document"))


def dominant_font(spans: DataFrame, keys: list[str]) -> DataFrame:
    """A4: the most frequent font (of equals the first by name), the mean size, and whether most spans are bold."""
    counts = spans.groupBy(*keys, "name").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("back"), "name")).alias("best")).select(*keys, F.col("best.name").alias("font"))
    rest = spans.groupBy(*keys).agg(F.round(F.avg("font_size"), 1).alias("size"), (F.count_if("bold") > F.count("*") / 2).alias("bold"))
    return rest.join(best, keys).select(*keys, "font", "size", "bold")


def watermark(tilt: Column, text: Column, size: Column, fragments: list[str], phrases: list[str]) -> Column:
    """Tilted lines that hold a fragment or are short, listed phrases, and fragments in large type."""
    holds = F.lit(False)
    for f in fragments:
        holds = holds | F.contains(text, F.lit(f))
    listed = F.lower(strip(text)).isin([p.lower() for p in phrases]) if phrases else F.lit(False)
    return ((F.abs(tilt) > 0.2) & (holds | (F.length(text) < 15))) | listed | (holds & (size > 30))


def to_reconstruct(elements: DataFrame) -> DataFrame:
    """P10: texts that aren't duplicates; on a page of duplicates only, all texts."""
    from pyspark.sql import Window

    kept = elements.where(~F.col("type").isin("image", "figure") & (strip(F.coalesce("text", F.lit(""))) != ""))
    some = F.max(~F.col("possible_duplicate")).over(Window.partitionBy("doc_id", "page"))
    return kept.withColumn("__some", some).where(~F.col("possible_duplicate") | ~F.col("__some")).drop("__some")


def table_line(cells: Column, glue: str) -> Column:
    """The cells that aren't blank, stripped and joined."""
    return F.array_join(F.filter(F.transform(cells, strip), lambda c: c != ""), glue)
