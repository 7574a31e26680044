"""Readers of document folders: Spark lists and reads the files, a parser by suffix makes documents of their bytes."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from .doc import document_text

SUFFIXES = ("md", "txt", "pdf", "docx", "pptx", "doc", "xlsx", "csv")
BATCH_CHARS, ROW_CHARS = 1 << 21, 64  # of documents that a task gives on together, and what each counts beside its text
DOCUMENT_SCHEMA = "path string, ordinal int, content string, sheet string, slide int, page int, total_pages int, layout string, parser string, chunk_role string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, only: list[str] | None = None) -> DataFrame:
    """path (below ``root``, with /), content, length and modificationTime of the files of a folder and those below it.

    With ``only``, those of these paths alone.
    """
    reader = spark.read.format("binaryFile")
    if only is None:
        files = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    else:  # names are no patterns
        paths = [f"{root.rstrip('/')}/" + re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in only]
        files = reader.load(paths) if paths else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/") + "/"
    below = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/"), "^" + re.escape(base), "")
    return files.select(F.replace(below, F.lit("\\"), F.lit("/")).alias("path"), "content", "length", "modificationTime")


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, length and modified of the files of a folder and those below it; no file is read."""
    return scan(spark, root, suffixes).select("path", "length", F.col("modificationTime").alias("modified"))


def _docx(raw: bytes) -> list[dict]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    lines = []
    for paragraph in body.iter(f"{_W}p"):
        parts = ["\t" if node.tag == f"{_W}tab" else "\n" if node.tag in (f"{_W}br", f"{_W}cr") else node.text or "" for node in paragraph.iter() if node.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr")]
        lines.append("".join(parts))
    return [{"content": "\n\n".join(lines).strip()}]


def _number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def _pptx(raw: bytes) -> list[dict]:
    pack = zipfile.ZipFile(io.BytesIO(raw))
    out = []
    for name in sorted((n for n in pack.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number):
        slide = ElementTree.fromstring(pack.read(name))
        inside = {id(p) for t in slide.iter(f"{_A}tbl") for p in t.iter(f"{_A}p")}
        text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{_A}t")).strip()
        lines = [text_of(p) for p in slide.iter(f"{_A}p") if id(p) not in inside]
        for row in slide.iter(f"{_A}tr"):
            lines.append(" | ".join(c for c in map(text_of, row.iter(f"{_A}tc")) if c))
        if text := "\n".join(line for line in lines if line):
            out.append({"content": text, "slide": _number(name)})
    return out


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    value = cell.find(f"{_S}v")
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    if value is None or value.text is None:
        return ""
    return shared[int(value.text)] if cell.get("t") == "s" else value.text


def _column(reference: str | None, default: int) -> int:
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return default
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx(raw: bytes) -> list[dict]:
    pack = zipfile.ZipFile(io.BytesIO(raw))
    names = set(pack.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.fromstring(pack.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(pack.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for k, sheet in enumerate(ElementTree.fromstring(pack.read("xl/workbook.xml")).iter(f"{_S}sheet")):
        target = (targets.get(sheet.get(f"{_R}id")) or f"worksheets/sheet{k + 1}.xml").lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        lines = []
        for row in ElementTree.fromstring(pack.read(target)).iter(f"{_S}row"):
            cells: list[str] = []
            for cell in row.iter(f"{_S}c"):
                at = _column(cell.get("r"), len(cells))
                cells += [""] * (at - len(cells)) + [_cell(cell, shared)]
            if any(c.strip() for c in cells):
                lines.append(" | ".join(cells))
        if lines:
            out.append({"content": "\n".join(lines), "sheet": sheet.get("name")})
    return out


def _csv(raw: bytes) -> list[dict]:
    text = None
    for encoding in ("utf-8-sig", "gbk", "utf-8"):
        try:
            text = raw.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    if text is None:
        raise ValueError("unknown encoding")
    rows = [" | ".join(r) for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r)]
    return [{"content": "\n".join(rows)}] if rows else []


def _plain(raw: bytes) -> list[dict]:
    return [{"content": raw.decode("utf-8")}]


def _doc(raw: bytes) -> list[dict]:
    text = document_text(raw)
    return [{"content": text}] if text else []


#: Parsers by suffix, each a list that is tried in order until one gives documents.  Behind those of PDF comes :mod:`quern.sources.pdf`.
PARSERS: dict[str, list[Callable[[bytes], list[dict]]]] = {"md": [_plain], "txt": [_plain], "docx": [_docx], "pptx": [_pptx], "xlsx": [_xlsx], "csv": [_csv], "pdf": [], "doc": [_doc]}


def register_parser(suffix: str, parser: Callable[[bytes], list[dict]]) -> None:
    """Put a parser before those of a suffix; the others remain as fallbacks."""
    PARSERS.setdefault(suffix.lower().lstrip("."), []).insert(0, parser)


def parse_one(path: str, raw: bytes, parsers: dict[str, list[Callable[[bytes], list[dict]]]]) -> list[dict]:
    """Documents of a file.  A failure is one row without content that says what failed; an unknown suffix is none."""
    suffix = path.rpartition(".")[2].lower() if "." in path else ""
    error = None
    for parser in parsers.get(suffix, []):
        try:
            if found := parser(raw):
                return [{"ordinal": i, "parser": parser.__name__.strip("_")} | d for i, d in enumerate(found)]
            error = None
        except Exception as e:  # a file must not stop the others; what went wrong is kept beside it
            error = f"{type(e).__name__}: {e}"
    return [{"ordinal": 0, "error": error}] if error else []


def parse(files: DataFrame, preferred: str | None = None, pdfs: bool = True) -> DataFrame:
    """Documents (path, ordinal, content, ...) of files (path, content); failures have an ``error`` and no content.

    Of a format's parsers the one whose name is ``preferred`` is tried first.  PDF files for which no registered parser
    gives documents, or all if ``pdf`` is preferred, are read by this library: stated facts as page 0, then the pages that
    have words.  A page of two columns reads its head over both columns, then the left one, then the right one; grids
    follow the text as tables.  ``files`` is gone through once.  Without ``pdfs``, PDF files give nothing.
    """
    from . import pdf

    parsers = {k: sorted(v, key=lambda p: p.__name__.strip("_") != preferred) for k, v in PARSERS.items()}
    kinds = {"int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in DOCUMENT_SCHEMA.split(", "))])
    texts, facts = pa.list_(pa.string()), pa.struct([(k, pa.string()) for k in ("title", "author", "subject", "keywords")])
    if pdfs:
        schema = pa.schema([*schema, ("two_column", pa.bool_()), ("texts", texts), ("grids", pa.list_(pa.list_(texts))), ("facts", facts)])

    def documents(held: list[tuple[str, bytes]]) -> Iterator[list[dict]]:
        left = []
        for path, raw in held:
            own = path.lower().endswith(".pdf")
            found = [] if own and preferred == "pdf" else [d for d in parse_one(path, raw, parsers) if not own or d.get("content") is not None]
            if own and not found:
                left.append((path, raw))
            yield [{"path": path} | d for d in found]
        for (path, _), found in zip(left, pdf.page_rows(left), strict=True):
            yield [{"path": path, "ordinal": d["page"], "parser": None if d["error"] else "pdf", "chunk_role": "pdf_metadata" if d["facts"] else None} | d for d in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for held in pdf.in_files(batches):
            for found in documents(held):
                rows += found
                chars += sum(ROW_CHARS + len(d.get("content") or "") + sum(map(len, d.get("texts") or ())) for d in found)
                if chars >= BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    named = files.select("path", "content")
    if not pdfs:
        return named.where(~F.lower("path").endswith(".pdf")).mapInArrow(run, DOCUMENT_SCHEMA)
    found = named.mapInArrow(run, f"{DOCUMENT_SCHEMA}, {pdf.PAGE_SCHEMA}")
    # In an array, so that a page's text is made once, and not also for a filter.
    content = F.when(F.col("facts").isNull() & F.col("texts").isNull(), F.array("content")).otherwise(F.filter(F.array(pdf.page_content()), lambda c: F.trim(c) != ""))
    layout = F.when(F.col("two_column"), "two-column").when(~F.col("two_column"), "single-column").otherwise(F.col("layout"))
    columns = [c.split()[0] for c in DOCUMENT_SCHEMA.split(", ")]
    return found.withColumn("layout", layout).select(*(F.explode(content).alias(c) if c == "content" else c for c in columns))


def text_documents(files: DataFrame) -> DataFrame:
    """path and content of Markdown and plain texts, decoded without leaving the JVM."""
    return files.where(F.lower("path").rlike(r"\.(md|txt)$")).select("path", F.decode("content", "UTF-8").alias("content"))


def two_column_pages(words: DataFrame, gutter: float = 20.0, by: Sequence[str] = ("page",)) -> DataFrame:
    """The columns of ``by`` that tell pages apart, and two_column, from the words (page_width, x0) of pages."""
    middle = F.col("page_width") / 2
    sides = words.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("x0") < middle - gutter).alias("left"), F.count_if(F.col("x0") > middle + gutter).alias("right"))
    even = F.abs(F.col("left") - F.col("right")) / F.greatest("left", "right") < 0.6
    return sides.select(*by, F.coalesce((F.col("n") >= 30) & (F.col("left") > 15) & (F.col("right") > 15) & even, F.lit(False)).alias("two_column"))


def reading_order(words: DataFrame, header_share: float = 0.18, gutter: float = 10.0) -> DataFrame:
    """Words (page, page_width, page_height, x0, top, text) of a two-column page with ``band`` 0 (head), 1 or 2 (columns).

    Words within the gutter belong to the nearer column.
    """
    band = F.when(F.col("top") < F.col("page_height") * header_share, 0).when(F.col("x0") < F.col("page_width") / 2 - gutter, 1).when(F.col("x0") > F.col("page_width") / 2 + gutter, 2).otherwise(F.when(F.col("x0") < F.col("page_width") / 2, 1).otherwise(2))
    return words.withColumn("band", band)


def markdown_table(rows: F.Column) -> F.Column:
    """Rows of cells as a Markdown table, the first one its head; a missing cell is empty."""
    cells = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(rows, 1), lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(cells, 1, 1), F.array(rule), F.slice(cells, F.lit(2), F.size(rows))), "\n")).otherwise(F.lit(""))


def pdf_metadata_text(title: F.Column, author: F.Column, subject: F.Column, keywords: F.Column) -> F.Column:
    """The lines of a document that describes a PDF; what is not stated has no line."""
    stated = lambda c, *out: F.when((F.trim(c) != "") & ~F.lower(F.trim(c)).isin(*out), c)
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n", line("Title", stated(title, "(anonymous)", "(unspecified)")), line("Author(s)", stated(author, "(anonymous)", "(unspecified)")), line("Subject", stated(subject, "(unspecified)")), line("Keywords", stated(keywords, "(unspecified)")))


def outlines(files: DataFrame) -> DataFrame:
    """path, size and headings of every Markdown file."""
    from ..functions.text import outline

    texts = files.where(F.lower("path").endswith(".md"))
    return texts.select("path", F.octet_length("content").cast("long").alias("size"), outline(F.decode("content", "UTF-8")).alias("outline"))


IMAGE_SCHEMA = "source string, page int, ordinal int, width int, height int, image binary"


def image_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG or JPEG image."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return int.from_bytes(raw[16:20]), int.from_bytes(raw[20:24])
    at = 2 if raw[:2] == b"\xff\xd8" else len(raw)
    while at + 9 < len(raw) and raw[at] == 0xFF:
        if raw[at + 1] in (0xC0, 0xC1, 0xC2):
            return int.from_bytes(raw[at + 7 : at + 9]), int.from_bytes(raw[at + 5 : at + 7])
        at += 2 + int.from_bytes(raw[at + 2 : at + 4])
    return None


def images(files: DataFrame) -> DataFrame:
    """The images that office documents (page 0) and PDF files (path, content) hold: source, page, ordinal, width, height, image."""
    from . import pdf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        for name in sorted(n for n in z.namelist() if "/media/" in n):
                            if size := image_size(raw := z.read(name)):
                                rows.append({"source": path, "page": 0, "ordinal": len(rows), "width": size[0], "height": size[1], "image": raw})
                except zipfile.BadZipFile:  # a broken file has its error row from parse
                    continue
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("source", pa.string()), *((n, pa.int32()) for n in ("page", "ordinal", "width", "height")), ("image", pa.binary())]))

    return files.where(F.lower("path").rlike(r"\.(docx|pptx|xlsx)$")).select("path", "content").mapInArrow(run, IMAGE_SCHEMA).unionByName(pdf.images(files))


def image_captions(images: DataFrame, caption: F.Column, min_size: int = 100, most: int = 20) -> DataFrame:
    """Documents of images (source, page, ordinal, width, height, ...) that are large enough, ``most`` captions a file."""
    from pyspark.sql import Window

    large = images.where((F.col("width") >= min_size) & (F.col("height") >= min_size)).withColumn("caption", caption)
    said = large.where(F.coalesce(F.trim("caption"), F.lit("")) != "")
    first = said.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("page", "ordinal"))).where(F.col("_n") <= most)
    return first.select("source", "page", F.concat(F.lit(fixed.IMAGE_CAPTION), F.col("caption")).alias("content"), F.lit("image").alias("type"))
