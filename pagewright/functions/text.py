"""Text functions as Column expressions: normalisation, words, numbers, noise and clean-up rules.

Java's \\s and \\w are ASCII unless (?U) is set; where the rules mean Unicode classes the patterns say so.
NFKC has no built-in, so ``nfkc`` is a pandas function; ``to_nfkc`` calls it for rows with non-ASCII text only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes and patterns that the results depend on.
WINDOW_CONTROL = r"^[\-_—–\s]*([xX✕✖×]|(?:[口□◻oO0\[\]\(\)\-_—–\s]+[xX✕✖×]))[\-_—–\s]*$"
DROPDOWN_ARROW = r"^[|\[\(]?\s*([vV▼▾▽▲△▴u\^Aa]|v\.|V\.|a\.|A\.)\s*[|\]\)]?$"
CHECKBOX_GLYPH = r"^(?:\[\s*\]|\(\s*\)|[☐☑☒■□●○✓✔√•·\-_—–])$"
SPECIAL_SPACES = "[   -​  　﻿]"
DOUBLE_QUOTES = "[“”„«»″]"
SINGLE_QUOTES = "[‘’‚‛′`]"
DASHES = "[—–‒―]"
LEADING_MARKER = "^[•●▪▫‣�·*\\-]\\s*"
WORD = r"[a-zA-Z0-9_\-\+\*/\.,:;\(\)≠≤≥±]+|[^\s\p{L}\p{N}_]"
NUMBER = r"\b\d+(?:[\.,/]\d+)*(?:%|[a-zA-Z]{1,2}\b)?"
PAGE_MARK = r"(?i)---\s*Page\s*(\d+)\s*---"
STRICT_PAGE_MARK = r"--- Page (\d+) ---"
SECTION_MARK = r"(?i)---\s*(?:Page|Section)\s*(\d+)\s*---"
PAGE_NUMBER = r"(?i)^\s*(\d+|page\s+\d+(\s+of\s+\d+)?|[ivxlcdm]+)\s*$"
FORMULA_SIGN = "[∀-⋿✕✖✚±×÷]"
FORMULA_MARKS = ["\\frac", "\\sqrt", "\\sum", "\\int", "\\prod", "mathtype", "omath"]
# End of fixed values.


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def to_nfkc(df: DataFrame, column: str) -> DataFrame:
    """df, read once, with the column in NFKC; Python gets nulls for ASCII rows."""
    other = F.when(F.col(column).rlike(r"[^\x00-\x7F]"), F.col(column))
    return df.withColumn(column, F.coalesce(nfkc(other), column))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: What the classes and bounds of RE2 are in Java, where \\b and $ mean more even without (?U).  Java's stack grows with the
#: turns of a group, unless it gives none back.
PLAIN = [(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"), (r"\s", r"[\t\n\f\r ]"), (r"(\.\d+)*", r"(?:\.\d+)*+")]
#: Letters beyond ASCII that are another case of an ASCII letter in RE2; Java's (?iu) also takes \u0130 and \u0131 for an i.
FOLDS = {"s": "s\u017f", "S": "s\u017f", "k": "k\u212a", "K": "k\u212a"}


def _any_case(x: str) -> str:
    """A letter for a pattern with (?i), which in Java knows ASCII's cases only."""
    cases = x.lower() + x.upper() if x.isalpha() and not x.isascii() else FOLDS.get(x)
    return f"[{cases}]" if cases else x


def plain(pattern: str) -> str:
    """A pattern of this package with the ASCII classes and bounds that it has in SQL; $ is the end of the text."""
    for a, b in PLAIN:
        pattern = pattern.replace(a, b)
    if pattern.startswith("(?i)"):
        pattern = "(?i)" + "".join(map(_any_case, pattern[4:]))
    return pattern[:-1] + r"\z" if pattern.endswith("$") else pattern


def strip_plain(c: Column) -> Column:
    return F.btrim(c, F.lit("\t\n\f\r "))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normal_key(c: Column) -> Column:
    """F5, for text in NFKC: lower case, white space collapsed."""
    return F.coalesce(collapse(F.lower(c)), F.lit(""))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def similarity(a: Column, b: Column, set_a: Column | None = None, set_b: Column | None = None) -> Column:
    """F6 of two normal keys: Jaccard of word sets (computed here unless given), raised to 0.85 for a long text inside one of like length."""
    set_a, set_b = word_set(a) if set_a is None else set_a, word_set(b) if set_b is None else set_b
    both = F.size(F.array_intersect(set_a, set_b))
    jaccard = both / (F.size(set_a) + F.size(set_b) - both)
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = (F.contains(a, b) | F.contains(b, a)) & (shorter > 10) & (shorter / longer > 0.65)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(inside, F.greatest(jaccard, F.lit(0.85))).otherwise(jaccard)


def normal_line(c: Column) -> Column:
    """F8, for text in NFKC."""
    for pattern, put in (
        (SPECIAL_SPACES, " "), (DOUBLE_QUOTES, '"'), (SINGLE_QUOTES, "'"), (DASHES, "-"), (r"\s+([,.:;?!])", "$1"),
        (r"\(\s+", "("), (r"\s+\)", ")"), ("≠", "!="), ("≤", "<="), ("≥", ">="), (r"\s*/\s*", "/"), (LEADING_MARKER, ""), (r"[ \t]+", " "),
    ):
        c = F.regexp_replace(c, pattern, put)
    return F.coalesce(strip(c), F.lit(""))


def normal_text(c: Column) -> Column:
    """lines normalised one by one, three line ends or more become two."""
    lines = F.transform(F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n"), normal_line)
    return F.coalesce(strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")), F.lit(""))


def normal_lines(c: Column) -> Column:
    """the lines that aren't empty, normalised again."""
    return F.filter(F.transform(F.split(normal_text(c), "\n"), normal_line), lambda x: x != "")


def words(c: Column) -> Column:
    """F7 of a normalised text: ASCII word runs, other marks one by one; letters beyond ASCII split words and are lost."""
    return F.filter(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda w: strip(w) != "")


def numbers(c: Column) -> Column:
    """F13; digits and word bounds are Unicode's."""
    return F.regexp_extract_all(c, F.lit("(?U)" + NUMBER), F.lit(0))


def confidence_unit(c: Column) -> Column:
    """Confidences over 1 are percentages."""
    return F.when(c > 1, c / 100).otherwise(c)


def is_noise(text: Column, w: Column, h: Column, confidence: Column) -> Column:
    """Whether a text is a control, glyph or noise rather than text; a null size is that of a large box."""
    t = strip(F.coalesce(text, F.lit("")))
    c = confidence_unit(confidence)
    w, h = F.coalesce(w, F.lit(999.0)), F.coalesce(h, F.lit(999.0))
    ratio, room = F.when(w == 999.0, 1.0).otherwise(w / F.greatest(F.lit(0.1), h)), F.when(w == 999.0, 999999.0).otherwise(w * h)
    low = lambda v: F.coalesce(c < v, F.lit(False))
    within = lambda a, b: (w <= a) & (h <= b)
    n = F.length(t)
    word_char = t.rlike(r"[\p{L}\p{N}]")
    digits = t.rlike(r"^\p{Nd}+$")
    rules = [
        t == "",
        low(0.40),
        t.rlike(WINDOW_CONTROL) & (n > 1),
        t.rlike(WINDOW_CONTROL) & F.lower(t).isin("x", "×", "✕", "✖") & (within(60, 60) | (ratio.between(0.5, 1.8) & (room <= 3600)) | low(0.85)),
        t.rlike(DROPDOWN_ARROW) & t.isin("A", "a", "A.", "a.") & within(28, 28) & ratio.between(0.5, 1.6) & (room <= 650),
        t.rlike(DROPDOWN_ARROW) & ~t.isin("A", "a", "A.", "a.") & (within(60, 60) | ((room <= 3600) & ratio.between(0.5, 2.0)) | F.lower(t).isin("v", "v.")),
        t.rlike(CHECKBOX_GLYPH),
        t.isin("o", "O") & within(36, 36) & ratio.between(0.65, 1.5),
        (t == "0") & within(36, 36) & ratio.between(0.65, 1.5) & low(0.50),
        t.isin("|", "l") & within(30, 30) & ((ratio >= 0.55) | low(0.85)),
        (t == "1") & within(30, 30) & low(0.50),
        (n <= 2) & ~word_char & (within(25, 25) | low(0.80)),
        (n == 1) & ~digits & ~t.isin("a", "A", "I") & (low(0.90) | within(65, 65)),
        (n == 1) & t.isin("a", "A", "I") & low(0.75),
        (n <= 2) & within(35, 35) & (room <= 1200) & (~digits | low(0.40)),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    return out


# Replacements at the start and end of a line read by OCR, in order.
TECH_SUFFIX = r"(?:st|nd|rd|th|d|D|k|K|g|G|fa|FA|bit|BIT|p|P)\b"
LEADING_RULES = [
    (rf"^[0-9]+(?!(?:{TECH_SUFFIX}))([A-Za-z_][A-Za-z0-9_]*)", "$1"),
    (r"^0\s+([A-Za-z])", "$1"),
    (r"^[SsOo]Show\b", "Show"),
    (r"^(?:\[\s*\]|[\[\(][xXvV01\s][\]\)]|[☐☑☒■□●○✓✔√•·])\s*", ""),
    (r"^[vxoVXO_]([A-Z]{3,}\b)", "$1"),
    (r"^[>•·~–—]\s*", ""),
    (r"^[.:]\s+([A-Za-zÀ-ÿ])", "$1"),
    (r"^[Oo]([A-Z][a-z]{2,})", "$1"),
    (r"([!?])\s*\.+$", "$1"),
    (r"(?<!\.)\.\.(?!\.)$", "."),
]
LINE_RULES = [
    (r"([A-Za-z0-9]):([A-Za-z0-9])", "$1: $2"),
    (r"(?i)\b(right|left|top|bottom|up|down|center|middle|none|yes|no|true|false)d\b", "$1"),
    (r"(?i)\b(right|left|top|bottom)v\b", "$1"),
    (r"(?i)\b(Upper left|Upper right|Lower left|Lower right)\.", "$1"),
]
# End of fixed values.


def clean_leading(c: Column, ascii_classes: bool = False) -> Column:
    """F11; with ``ascii_classes`` white space and word bounds are ASCII's, as in SQL."""
    for pattern, put in LEADING_RULES:
        c = F.regexp_replace(c, plain(pattern) if ascii_classes else "(?U)" + pattern, put)
    return F.coalesce((strip_plain if ascii_classes else strip)(c), F.lit(""))


def clean_lines(lines: Column, ascii_classes: bool = False) -> Column:
    """F12 of an array of lines: every line cleaned, blank lines dropped, joined by line ends; see ``clean_leading``."""

    def line(x: Column) -> Column:
        x = clean_leading(x, ascii_classes)
        for pattern, put in LINE_RULES:
            x = F.regexp_replace(x, plain(pattern) if ascii_classes else "(?U)" + pattern, put)
        return strip_plain(F.regexp_replace(x, plain(r"\s+"), " ")) if ascii_classes else collapse(x)

    return F.array_join(F.filter(F.transform(lines, line), lambda x: x != ""), "\n")


def clean_ocr(c: Column) -> Column:
    """F12 of a text, which any line end splits."""
    return clean_lines(F.split(F.coalesce(c, F.lit("")), "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"))


def is_formula(c: Column, marks: bool = True, ascii_classes: bool = False) -> Column:
    """LaTeX marks; else no prose and a mathematical sign, an equation, or a fraction with an operator.

    Without ``marks`` LaTeX's don't count; see ``clean_leading`` for ``ascii_classes``.
    """
    as_is = plain if ascii_classes else str
    t = (strip_plain if ascii_classes else strip)(F.coalesce(c, F.lit("")))
    mark = F.lit(False)
    for m in FORMULA_MARKS if marks else []:
        mark = mark | F.contains(F.lower(t), F.lit(m))
    prose = F.size(F.filter(F.split(t, plain(r"\s+") if ascii_classes else r"(?U)\s+"), lambda w: w.rlike(as_is("^[A-Za-z]{3,}$")))) >= 5
    sign = t.rlike(FORMULA_SIGN)
    no_code = ~t.rlike("<|>|==|!=|http|href|xmlns")
    equation = F.contains(t, F.lit("=")) & no_code & t.rlike(as_is(r"\b[a-zA-Z_0-9]\s*=\s*[-0-9a-zA-Z+*/()]"))
    fraction = t.rlike(as_is(r"\b[a-zA-Z0-9]+/[a-zA-Z0-9]+")) & t.rlike(r"[-+*/^=]")
    return (t != "") & (mark | (~prose & (sign | equation | fraction)))


def is_page_number(c: Column) -> Column:
    """F28."""
    return c.rlike(PAGE_NUMBER)


def alnum_key(c: Column) -> Column:
    """F31."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


#: What exports add to a file's name, taken out in this order.
NAME_SUFFIXES = ["_extracted", " extracted", "-extracted", ".txt", ".json", ".docx", ".pdf"]


def job_name_key(c: Column) -> Column:
    """base name without its extension and without NAME_SUFFIXES, letters and digits only."""
    base = F.regexp_replace(F.lower(F.regexp_extract(c, r"([^/\\]*)$", 1)), r"(?<=.)\.[^.]*$", "")
    for x in NAME_SUFFIXES:
        base = F.replace(base, F.lit(x), F.lit(""))
    return F.regexp_replace(base, r"[^\p{L}\p{N}]", "")


def numbered_parts(c: Column, mark: str) -> Column:
    """a map from a mark's number to the text after it; the last of equal numbers wins, text before is dropped."""
    found = F.regexp_extract_all(c, F.lit(mark), F.lit(1))
    parts = F.slice(F.split(c, mark), 2, 1_000_000)
    pairs = F.arrays_zip(found.alias("n"), F.transform(parts, strip).alias("t"))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["n"].cast("int").alias("n"), p["t"].alias("t"), i.alias("i"))), lambda p: F.lit(True))
    return F.map_from_entries(F.transform(F.filter(last, lambda p: ~F.exists(last, lambda q: (q["n"] == p["n"]) & (q["i"] > p["i"]))), lambda p: F.struct(p["n"], p["t"])))


def proportional_parts(lines: Column, total: Column) -> Column:
    """F25 without marks: total pieces of max(1, n // total) lines, the rest in the last."""
    each = F.greatest(F.lit(1), F.floor(F.size(lines) / total)).cast("int")
    return F.transform(F.sequence(F.lit(1), total), lambda k: F.array_join(F.when(k < total, F.slice(lines, (k - 1) * each + 1, each)).otherwise(F.slice(lines, (k - 1) * each + 1, F.greatest(F.lit(0), F.size(lines)))), "\n"))
