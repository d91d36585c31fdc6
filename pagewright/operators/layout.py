"""Layout operators on elements: overlaps, duplicates, regions, columns, reading order.

Elements are rows with doc_id, page, ord (place in the page, also the tie-break), text, source and x0, y0, x1, y1.
Pairs meet within a page only, by an equi join on (doc_id, page); a page bounds the pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.geometry import Box, area, iou, overlap_ratio, relationship
from pagewright.functions.text import normal_key, similarity, strip, word_set

PAGE = ["doc_id", "page"]


def renamed(df: DataFrame, suffix: str, keep: list[str] = PAGE) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{c}{suffix}") for c in df.columns if c not in keep])


def overlaps(elements: DataFrame, least: float = 0.1) -> DataFrame:
    """Pairs of a page, the earlier element first, whose shared part exceeds ``least`` of the earlier one's area."""
    a, b = renamed(elements, "_a"), renamed(elements, "_b")
    ba, bb = Box.of(suffix="_a"), Box.of(suffix="_b")
    touching = (F.col("x0_a") < F.col("x1_b")) & (F.col("x0_b") < F.col("x1_a")) & (F.col("y0_a") < F.col("y1_b")) & (F.col("y0_b") < F.col("y1_a"))
    pairs = a.join(b, PAGE).where((F.col("ord_a") < F.col("ord_b")) & touching)
    return pairs.withColumn("overlap_a", overlap_ratio(ba, bb)).withColumn("relationship", relationship(ba, bb)).where(F.col("overlap_a") > least)


def overlap_lists(elements: DataFrame, least: float = 0.1) -> DataFrame:
    """Every overlapping element with the sorted places of the others, linked both ways."""
    p = overlaps(elements, least)
    both = p.select(*PAGE, F.col("ord_a").alias("ord"), F.col("ord_b").alias("other")).unionAll(p.select(*PAGE, "ord_b", "ord_a"))
    return both.groupBy(*PAGE, "ord").agg(F.array_sort(F.collect_set("other")).alias("others"))


def duplicates(elements: DataFrame) -> DataFrame:
    """For every OCR element its best native match on the page, and whether it is a duplicate of it.

    Texts must be in NFKC.  Of equal scores the earliest native element counts.  A match needs 0.70 where any native
    element overlaps, else 0.90 and more than 15 characters.
    """
    keyed = elements.select(*PAGE, "ord", "source", "x0", "y0", "x1", "y1", normal_key(F.col("text")).alias("key")).where(F.length("key") >= 2).withColumn("set", word_set(F.col("key")))
    ocr = renamed(keyed.where(F.col("source").isin("ocr", "pp_structure")), "_o")
    native = renamed(keyed.where(F.col("source").isin("native", "docx")), "_n")
    shared = iou(Box.of(suffix="_o"), Box.of(suffix="_n"))
    scored = ocr.join(native, PAGE).withColumn("iou", shared).withColumn("words", similarity(F.col("key_o"), F.col("key_n"), F.col("set_o"), F.col("set_n")))
    scored = scored.withColumn("score", F.when(F.col("iou") > 0.15, F.greatest("words", 0.70 + F.col("iou") * 0.30)).otherwise(F.col("words")))
    best = scored.groupBy(*PAGE, "ord_o").agg(F.max(F.struct("score", (-F.col("ord_n")).alias("back"))).alias("best"), F.max(F.col("iou") > 0.15).alias("touches"), F.first(F.length("key_o")).alias("chars"))
    score = F.col("best.score")
    flag = F.when(score <= 0, False).when(F.col("touches"), score >= 0.70).otherwise((score >= 0.90) & (F.col("chars") > 15))
    return best.select(*PAGE, F.col("ord_o").alias("ord"), F.when(score > 0, -F.col("best.back")).alias("native_ord"), score.alias("score"), "touches", flag.alias("possible_duplicate"))


def regions(elements: DataFrame) -> DataFrame:
    """Elements with ``region``: a page is cut at tables, at elements that span it, and at gaps over 35 points."""
    page = Window.partitionBy(*PAGE)
    line = page.orderBy("y0", "x0", "ord")
    total = F.max("x1").over(page) - F.min("x0").over(page)
    e = elements.withColumn("__total", total).withColumn("__n", F.count("*").over(page))
    e = e.withColumn("__alone", (F.col("type") == "table") | ((F.col("__total") > 150.0) & ((F.col("x1") - F.col("x0")) / F.col("__total") >= 0.70)))
    cut = F.col("__alone") | F.lag("__alone", 1, False).over(line) | F.coalesce(F.col("y0") - F.lag("y1").over(line) > 35.0, F.lit(False))
    e = e.withColumn("__cut", (cut & (F.col("__n") > 3)).cast("int"))
    number = F.sum("__cut").over(line.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("__cut").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return e.withColumn("region", (number - first).cast("int")).drop("__total", "__n", "__alone", "__cut")


def columns_of(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Elements with ``column``: groups are cut at vertical bands of 10 points or more that no element covers.

    Bands count from the group's left edge in steps of 2 points; a band less than 30 points from either edge is margin.
    """
    group = Window.partitionBy(*keys)
    e = elements.withColumn("__l", F.min("x0").over(group)).withColumn("__r", F.max("x1").over(group)).withColumn("__n", F.count("*").over(group))
    step = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - F.col("__l")) / 2.0))
    taken = e.where((F.col("__n") >= 3) & (F.col("__r") - F.col("__l") >= 120.0)).select(*keys, "__l", "__r", F.explode(F.sequence(step("x0"), step("x1"))).alias("step")).distinct()
    after = F.lead("step").over(Window.partitionBy(*keys).orderBy("step"))
    gaps = taken.withColumn("next", after).where(F.col("next") - F.col("step") - 1 >= 5)
    low, high = F.col("__l") + (F.col("step") + 1) * 2.0, F.col("__l") + F.col("next") * 2.0
    splits = gaps.where((low - F.col("__l") >= 30.0) & (F.col("__r") - high >= 30.0)).groupBy(*keys).agg(F.collect_list((low + high) / 2.0).alias("__splits"))
    joined = e.join(splits, keys, "left")
    centre = (F.col("x0") + F.col("x1")) / 2.0
    return joined.withColumn("column", F.coalesce(F.size(F.filter("__splits", lambda s: centre > s)), F.lit(0))).drop("__l", "__r", "__n", "__splits")


def x_occupancy(elements: DataFrame, keys: list[str]) -> DataFrame:
    """How many elements cover each step of 2 points, counted from the group's left edge."""
    left = F.min("x0").over(Window.partitionBy(*keys))
    step = lambda c: F.floor((F.col(c) - F.col("left")) / 2.0)
    return elements.withColumn("left", left).select(*keys, F.explode(F.sequence(step("x0"), step("x1"))).alias("step")).groupBy(*keys, "step").agg(F.count("*").alias("n"))


# What marks a prompt of a form, and a line of a table of contents.
PROMPT = r":\s*$|\bname\b|\bemail\b|\bphone\b|\baddress\b|\bdate\b|\bsignature\b|\bfirst\s*name\b|\blast\s*name\b|\bcity\b|\bstate\b|\bzip\b|\[\s*input\s*\]|\[\s*x?\s*\]|[_]{3,}"
LEADERS = r"\.\s*\.\s*\.|[A-Za-z\s]\s{2,}\d+$"
ITEM = r"^([•\-\*\d+\.]|\([a-z0-9]+\))\s+"
# End of fixed values.


def region_kinds(elements: DataFrame, keys: list[str]) -> DataFrame:
    """The kind of each group: table, form, toc, list or text."""
    t = strip(F.coalesce("text", F.lit("")))
    low = F.lower(t)
    n_words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    counts = elements.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("type") == "table").alias("tables"),
        F.count_if(low.endswith(":")).alias("colons"),
        F.count_if((t != "") & low.rlike(PROMPT)).alias("prompts"),
        F.count_if(t.rlike(LEADERS)).alias("leaders"),
        F.count_if(((n_words > 0) & (n_words <= 4)) | t.rlike(ITEM)).alias("shorts"),
    )
    form = (F.col("n") >= 2) & ((F.col("colons") >= 2) | ((F.col("prompts") >= 2) & (F.col("prompts") / F.col("n") >= 0.25)))
    toc = (F.col("n") >= 3) & ((F.col("leaders") >= 2) | (F.col("leaders") / F.col("n") >= 0.3))
    listed = (F.col("n") >= 4) & (F.col("shorts") / F.col("n") >= 0.65)
    return counts.withColumn("kind", F.when(F.col("tables") > 0, "table").when(form, "form").when(toc, "toc").when(listed, "list").otherwise("text"))


def ranks_of_lines(items: list[tuple]) -> list[int]:
    """The rank of the line of every item (y0, x0, ord, y1): an item joins the first line whose mean centre is near.

    A line's mean moves as it grows, so the items are taken one by one, from the top and the left; lines are ranked by
    their mean centres.
    """
    sums: list[list[float]] = []
    where = [0] * len(items)
    for at in sorted(range(len(items)), key=lambda i: items[i][:3]):
        y0, _, _, y1 = items[at]
        c, h = (y0 + y1) / 2, y1 - y0
        for i, (total, tall, n) in enumerate(sums):
            if abs(c - total / n) <= max(4.0, 0.45 * min(max(1.0, h), tall / n)):
                sums[i] = [total + c, tall + h, n + 1]
                where[at] = i
                break
        else:
            where[at] = len(sums)
            sums.append([c, h, 1])
    rank = {i: r for r, i in enumerate(sorted(range(len(sums)), key=lambda i: sums[i][0] / sums[i][2]))}
    return [rank[i] for i in where]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def line_ranks(pages: pd.Series) -> pd.Series:
    """W3 for many pages at once: the rank of the line of every item of a page, in the items' order.  Items: group, y0, x0, ord, y1."""
    out = []
    for page in pages:
        members: dict[tuple, list[int]] = {}
        for i, item in enumerate(page):
            members.setdefault(tuple(item["group"]), []).append(i)
        line = [0] * len(page)
        for at in members.values():
            for i, r in zip(at, ranks_of_lines([(page[i]["y0"], page[i]["x0"], page[i]["ord"], page[i]["y1"]) for i in at])):
                line[i] = r
        out.append(line)
    return pd.Series(out, dtype=object)


def with_line_ranks(elements: DataFrame, groups: list[str]) -> DataFrame:
    """doc_id, page, the group columns (int), ord, x0 and ``line`` of elements; lines are formed inside a group.

    A page is one row for Python, so a batch holds many pages.
    """
    group = F.array(*[F.col(g).cast("int") for g in groups]).cast("array<int>").alias("group")
    pages = elements.groupBy(*PAGE).agg(F.collect_list(F.struct(group, "y0", "x0", "ord", "y1")).alias("items"))
    lined = pages.withColumn("lines", line_ranks("items")).select(*PAGE, F.explode(F.arrays_zip("items", "lines")).alias("i"))
    return lined.select(*PAGE, *[F.col("i.items.group")[k].alias(g) for k, g in enumerate(groups)], F.col("i.items.ord").alias("ord"), F.col("i.items.x0").alias("x0"), F.col("i.lines").alias("line"))


def reading_order(elements: DataFrame) -> DataFrame:
    """doc_id, page, ord and ``reading_order``.

    Regions from top to bottom; in tables and forms line by line, elsewhere column by column; then elements without text,
    then those without a box, in their places.  A page without any text keeps its order.
    """
    has_box = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    has_text = strip(F.coalesce("text", F.lit(""))) != ""
    group = F.when(has_box & has_text, 0).when(has_box, 1).otherwise(2)
    e = elements.withColumn("__group", group).withColumn("__texts", F.count_if(F.col("__group") == 0).over(Window.partitionBy(*PAGE)))
    keys = [*PAGE, "region"]
    text = regions(e.where(F.col("__group") == 0))
    kinds = region_kinds(text, keys).select(*keys, F.col("kind").isin("table", "form").alias("__rows"))
    placed = columns_of(text, keys).join(kinds, keys).withColumn("column", F.when(F.col("__rows"), 0).otherwise(F.col("column")))
    lined = with_line_ranks(placed, ["region", "column"])
    spots = lined.select(*PAGE, "ord", F.struct(F.lit(0).alias("g"), "region", "column", "line", "x0").alias("spot"))
    rest = e.where(F.col("__group") > 0).select(*PAGE, "ord", F.struct(F.when(F.col("__texts") == 0, 0).otherwise(F.col("__group")).alias("g"), F.lit(0).alias("region"), F.lit(0).alias("column"), F.lit(0).alias("line"), F.lit(0.0).alias("x0")).alias("spot"))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("spot", "ord"))
    return spots.unionByName(rest).withColumn("reading_order", order).drop("spot")


def single_first_heading(elements: DataFrame) -> DataFrame:
    """The first H1 of a document stays, later ones become H2."""
    is_h1 = (F.col("tag") == "H1") | (F.col("content_type") == "heading_1")
    rank = F.count_if(is_h1).over(Window.partitionBy("doc_id").orderBy("page", "ord").rowsBetween(Window.unboundedPreceding, 0))
    late = is_h1 & (F.col("__rank") > 1)
    return elements.withColumn("__rank", rank).withColumn("__late", late).withColumn("tag", F.when(F.col("__late"), "H2").otherwise(F.col("tag"))).withColumn("content_type", F.when(F.col("__late"), "heading_2").otherwise(F.col("content_type"))).drop("__rank", "__late")


def output_order() -> list[Column]:
    """O1: by reading order, then position; unset values come last, ties keep their places."""
    order = F.when(F.col("reading_order") > 0, F.col("reading_order")).otherwise(99999)
    return [F.coalesce(order, F.lit(99999)), F.coalesce("y0", F.lit(99999.0)), F.coalesce("x0", F.lit(99999.0)), F.col("ord")]


def column_members(items: DataFrame, tolerance: float = 15.0, least: int = 3) -> DataFrame:
    """Items of a page with at least ``least`` items, themselves included, whose left edges or centres align."""
    a, b = renamed(items, "_a"), renamed(items, "_b")
    near = (F.abs(F.col("x0_a") - F.col("x0_b")) <= tolerance) | (F.abs((F.col("x0_a") + F.col("x1_a")) / 2 - (F.col("x0_b") + F.col("x1_b")) / 2) <= tolerance)
    return a.join(b, PAGE).where(near).groupBy(*PAGE, "ord_a").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*PAGE, F.col("ord_a").alias("ord"), "n")


def in_turn(items: Column, clash) -> Column:
    """Greedy choice: items are taken one by one, but those for which ``clash(taken, item)`` holds with one taken before."""
    nothing = F.filter(items, lambda x: F.lit(False))
    return F.aggregate(items, nothing, lambda taken, x: F.when(F.exists(taken, lambda t: clash(t, x)), taken).otherwise(F.array_append(taken, x)))


def by_place(columns: list[str], where: Column | None = None) -> Column:
    """An aggregate: a page's rows as structs by their place; those of ``where`` alone, if it is given."""
    row = F.struct(*columns)
    order = lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)
    return F.array_sort(F.collect_list(row if where is None else F.when(where, row)), order)


def new_visuals(visuals: DataFrame, known: DataFrame, cover: float = 0.60, larger: float = 2.5) -> DataFrame:
    """Visuals that nothing on their page covers by ``cover``, neither a known visual nor one that was accepted before.

    What is over ``larger`` times a visual's area is its container and doesn't count.  Known visuals are met by an anti
    join; what that leaves is accepted in turn, by place.
    """
    v, k = renamed(visuals, "_v"), renamed(known, "_k")
    bv, bk = Box.of(suffix="_v"), Box.of(suffix="_k")
    hit = ((bk.width * bk.height) <= larger * (bv.width * bv.height)) & (overlap_ratio(bv, bk) >= cover)
    seen = v.join(k, PAGE).where(hit).select(*PAGE, F.col("ord_v").alias("ord")).distinct()
    box = lambda x: Box(*(x[c] for c in ("x0", "y0", "x1", "y1")))
    covers = lambda t, x: (area(box(t)) <= larger * area(box(x))) & (overlap_ratio(box(x), box(t)) >= cover)
    rest = [c for c in visuals.columns if c not in PAGE]
    left = visuals.join(seen, [*PAGE, "ord"], "left_anti").groupBy(*PAGE).agg(by_place(rest).alias("items"))
    return left.select(*PAGE, F.inline(in_turn(F.col("items"), covers)))


def distinct_boxes(boxes: DataFrame, near: float = 8.0, most: float = 0.65) -> DataFrame:
    """U4: of boxes all of whose sides lie within ``near`` points of each other's, the first stays.

    Boxes over ``most`` of their page's width and of its height contain the page and go first, where the page's size
    (page_width, page_height) is a column.
    """
    if {"page_width", "page_height"} <= set(boxes.columns):
        boxes = boxes.where(~F.coalesce((F.col("x1") - F.col("x0") > most * F.col("page_width")) & (F.col("y1") - F.col("y0") > most * F.col("page_height")), F.lit(False)))
    same = lambda t, x: (F.abs(t["x0"] - x["x0"]) < near) & (F.abs(t["y0"] - x["y0"]) < near) & (F.abs(t["x1"] - x["x1"]) < near) & (F.abs(t["y1"] - x["y1"]) < near)
    return boxes.groupBy(*PAGE).agg(by_place([c for c in boxes.columns if c not in PAGE]).alias("items")).select(*PAGE, F.inline(in_turn(F.col("items"), same)))


def _at_bars(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """Spans (``_s``) with the bars (``_b``) that they stand above or below: wide enough an overlap, and an edge near the bar."""
    s, b = renamed(spans, "_s"), renamed(bars, "_b")
    overlap = F.least("x1_s", "x1_b") - F.greatest("x0_s", "x0_b")
    inside = (F.col("x0_s") >= F.col("x0_b") - 3) & (F.col("x1_s") <= F.col("x1_b") + 3)
    wide = (overlap / F.greatest(F.lit(1.0), F.col("x1_s") - F.col("x0_s")) >= 0.4) | inside
    num = F.col("y1_s").between(F.col("y0_b") - 22, F.col("y0_b") + 2)
    den = F.col("y0_s").between(F.col("y1_b") - 2, F.col("y1_b") + 22)
    return s.join(b, PAGE).where(wide).withColumn("part", F.when(num, "num").when(den, "den")).where("part is not null")


def fraction_members(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """Spans above (num) or below (den) a fraction bar."""
    return _at_bars(spans, bars).select(*PAGE, F.col("ord_b").alias("bar"), F.col("ord_s").alias("ord"), "part")


def fraction_texts(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """the fraction at every bar: its text and the sides of bar and members.

    spans: also text, size and base (of the baseline).  Members stand from left to right; one of under 0.85 times the size
    of the one before whose base is over 2 points higher is a superscript.  A part with + or - has parentheses, and a
    numerator without a denominator stands alone.
    """
    one = Window.partitionBy(*PAGE, "ord_b", "part").orderBy("x0_s", "ord_s")
    raised = (F.col("size_s") < 0.85 * F.lag("size_s").over(one)) & (F.col("base_s") < F.lag("base_s").over(one) - 2)
    token = F.concat(F.when(raised, "^").otherwise(""), strip(F.coalesce("text_s", F.lit(""))))
    m = _at_bars(spans, bars).withColumn("token", token)
    part = lambda p: strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("x0_s", "ord_s", "token")))), lambda x: x["token"]), "")).alias(p)
    g = m.groupBy(*PAGE, F.col("ord_b").alias("bar")).agg(part("num"), part("den"), F.least(F.min("x0_b"), F.min("x0_s")).alias("x0"), F.greatest(F.max("x1_b"), F.max("x1_s")).alias("x1"))
    whole = lambda c: F.when(F.col(c).rlike("[-+\u2212]"), F.concat(F.lit("("), c, F.lit(")"))).otherwise(F.col(c))
    return g.select(*PAGE, "bar", F.when(F.col("den") != "", F.concat(whole("num"), F.lit("/"), whole("den"))).otherwise(F.col("num")).alias("text"), "x0", "x1")


def blocks_at_bars(blocks: DataFrame, bars: DataFrame) -> DataFrame:
    """Blocks that hold a fraction bar, with 5 points to spare."""
    b = bars.select(*PAGE, *[F.col(c).alias(f"{c}_b") for c in ("x0", "y0", "x1", "y1")])
    hit = (F.col("x0") - 5 <= F.col("x0_b")) & (F.col("x1_b") <= F.col("x1") + 5) & F.col("y0_b").between(F.col("y0") - 5, F.col("y1") + 5)
    return blocks.join(b, [blocks[c] == b[c] for c in PAGE] + [hit], "left_semi")


def bar_clusters(blocks: DataFrame, bars: DataFrame, least: float = 3.0) -> DataFrame:
    """doc_id, page, ord and ``cluster``, the place of the block that leads its row.

    Blocks that hold a bar lead, in turn, unless they share over ``least`` points of height with a leader before them; a
    later block joins the first leader with which it does, and all others stay alone.
    """
    e = blocks.select(*PAGE, "ord", "x0", "y0", "x1", "y1")
    held = blocks_at_bars(e, bars).select(*PAGE, "ord", F.lit(True).alias("held"))
    row = lambda t, x: F.least(t["y1"], x["y1"]) - F.greatest(t["y0"], x["y0"]) > least
    pages = e.join(held, [*PAGE, "ord"], "left").groupBy(*PAGE).agg(by_place(["ord", "y0", "y1"]).alias("items"), by_place(["ord", "y0", "y1"], F.col("held")).alias("holders"))
    led = pages.withColumn("leaders", in_turn(F.col("holders"), row)).select(*PAGE, "leaders", F.explode("items").alias("i"))
    first = F.get(F.filter("leaders", lambda t: (t["ord"] < F.col("i.ord")) & row(t, F.col("i"))), F.lit(0))
    return led.select(*PAGE, F.col("i.ord").alias("ord"), F.coalesce(first["ord"], F.col("i.ord")).alias("cluster"))
