"""Word documents without an office library: zip and XML scans on the executors, one file at a time."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# XML namespaces and parts of a document.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
O = "{urn:schemas-microsoft-com:office:office}"  # noqa: E741
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DOCUMENT, RELATIONS, FOOTNOTES, MEDIA = "word/document.xml", "word/_rels/document.xml.rels", "word/footnotes.xml", "word/media/"
SEPARATORS = ("separator", "continuationSeparator")
# End of fixed values.

ITEMS = "doc_id long, ord int, kind string, style string, text string, page_break boolean"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, modification time, length and content of the .docx files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true").load(path)


def _text(node) -> str:
    return "".join((t.text or "") if t.tag in (f"{W}t", f"{M}t") else "\t" if t.tag == f"{W}tab" else "" for t in node.iter())


def items_of(content: bytes) -> Iterator[tuple[str, str | None, str, bool]]:
    """Kind, style, text and whether a hard page break stands in it, in the order of the document.

    Kinds: paragraph, table_row (cells joined by " | "), math, object (the target of its relation), textbox, footnote, media.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        targets = {}
        if RELATIONS in names:  # S5
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read(RELATIONS))}
        body = ElementTree.fromstring(z.read(DOCUMENT)).find(f"{W}body")
        for node in body if body is not None else []:
            if node.tag == f"{W}p":
                style = node.find(f"{W}pPr/{W}pStyle")
                broken = any(b.get(f"{W}type") == "page" for b in node.iter(f"{W}br"))
                boxes = list(node.iter(f"{W}txbxContent"))
                yield "paragraph", None if style is None else style.get(f"{W}val"), _text(node).strip(), broken
                for m in node.iter(f"{M}oMath"):
                    yield "math", None, _text(m), False
                for o in node.iter(f"{O}OLEObject"):
                    yield "object", o.get("ProgID"), targets.get(o.get(f"{R}id")) or "", False
                for b in boxes:
                    yield "textbox", None, _text(b).strip(), False
            elif node.tag == f"{W}tbl":
                for row in node.iter(f"{W}tr"):
                    cells = [_text(c).strip() for c in row.findall(f"{W}tc")]
                    yield "table_row", None, " | ".join(c for c in cells if c), False
        if FOOTNOTES in names:
            for note in ElementTree.fromstring(z.read(FOOTNOTES)).findall(f"{W}footnote"):
                if note.get(f"{W}type") not in SEPARATORS and (t := _text(note).strip()):
                    yield "footnote", None, t, False
        for name in sorted(n for n in names if n.startswith(MEDIA)):  # S12: metafiles are formulas
            yield "media", "formula" if name.lower().endswith((".wmf", ".emf")) else "image", name, False


def extract(files: DataFrame) -> DataFrame:
    """files: doc_id, content.  One row per item; a file that can't be read gives one ``error`` row."""

    def run(batches):
        for b in batches:
            rows = []
            for d, c in zip(b["doc_id"], b["content"]):
                try:
                    rows += [(d, i, *x) for i, x in enumerate(items_of(c))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as e:
                    rows.append((d, 0, "error", None, f"{type(e).__name__}", False))
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "kind", "style", "text", "page_break"])

    return files.select("doc_id", "content").mapInPandas(run, ITEMS)


def sections(items: DataFrame) -> DataFrame:
    """Items with ``section``, which grows at every hard page break, and their line inside it."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("ord")
    before = F.coalesce(F.sum(F.col("page_break").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = items.where("text <> ''").withColumn("section", (before + 1).cast("int"))
    return e.withColumn("line", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("ord")))


def written(text: str | None) -> bytes:
    """A document whose paragraphs are the lines of a text, a hard page break after every 20."""
    from xml.sax.saxutils import escape

    lines = (text or "").split("\n")
    mark = '<w:r><w:br w:type="page"/></w:r>'
    clean = lambda t: escape("".join(c for c in t if c >= " " or c == "\t"))
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{clean(x)}</w:t></w:r>{mark if i % 20 == 19 else ""}</w:p>' for i, x in enumerate(lines))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(DOCUMENT, f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def to_docx(text: pd.Series) -> pd.Series:
    return text.map(written)
