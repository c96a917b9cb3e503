"""Document files as rows: detection and text of DOCX archives; PDF through an adapter where one is installed."""

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_extension
from ..operators.vision import DPI, LEAST_SIDE, LONGEST_SIDE

#: What is accepted, bytes at most, and pages at most.
SUPPORTED, MAX_BYTES, MAX_PAGES = (".pdf", ".docx", ".doc"), 50 << 20, 100
#: Characters that a page of a PDF needs to have text; share of its area; pages looked at.
TEXT_CHARS, TEXT_SHARE, SNIFFED = 50, 0.1, 5
#: Characters of a page where a format has none.
CHARS_PER_PAGE = 2000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def detect(files: DataFrame) -> DataFrame:
    """files with `extension` and `error`: null for an accepted one. Nothing is raised; bad files are rows."""
    ext = file_extension("path")
    error = F.when(~ext.isin(*SUPPORTED), F.concat(F.lit("unsupported extension "), ext)).when(F.col("length") > MAX_BYTES, "file too large")
    return files.withColumns({"extension": ext, "error": error})


def within_pages(files: DataFrame, counts: DataFrame) -> DataFrame:
    """files (path, error) with `error` also for those of more than MAX_PAGES pages. counts: doc_id, page_count."""
    many = counts.where(F.col("page_count") > MAX_PAGES).select(F.col("doc_id").alias("path"), F.lit(f"more than {MAX_PAGES} pages").alias("_many"))
    return files.join(many, "path", "left").withColumn("error", F.coalesce("error", "_many")).drop("_many")


def arrivals(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """scan() as a stream: files that drop into a folder, each once."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).schema(schema).load(folder)


def estimated_pages(blocks: DataFrame) -> DataFrame:
    """doc_id, page_count of files that have no pages: characters of their blocks by CHARS_PER_PAGE, at least 1."""
    chars = F.sum(F.coalesce(F.length("text"), F.lit(0)))
    return blocks.groupBy("doc_id").agg(F.greatest(F.lit(1), F.floor(chars / CHARS_PER_PAGE)).cast("int").alias("page_count"))


def known_metadata(*pairs: tuple[str, Column]) -> Column:
    """A map of what a file says about itself; keys without value, or with an empty one, are left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def pdf_metadata(raw: DataFrame) -> DataFrame:
    """doc_id, metadata of rows with a library's names for them (title, author, subject, creator, producer, creationDate,
    modDate)."""
    names = {"title": "title", "author": "author", "subject": "subject", "creator": "creator", "producer": "producer", "creation_date": "creationDate", "mod_date": "modDate"}
    return raw.select("doc_id", known_metadata(*[(k, F.col(v)) for k, v in names.items()]).alias("metadata"))


_CORE = {"title": "{http://purl.org/dc/elements/1.1/}title", "author": "{http://purl.org/dc/elements/1.1/}creator", "subject": "{http://purl.org/dc/elements/1.1/}subject", "created": "{http://purl.org/dc/terms/}created", "modified": "{http://purl.org/dc/terms/}modified"}


def docx_info(files: DataFrame) -> DataFrame:
    """doc_id, has_text, has_images, page_count, metadata (title, author, subject, created, modified, empty ones left out)
    and error of DOCX files (path, content)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        names = z.namelist()
                        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in names else None
                    texts = [t for t, *_ in _paragraphs(bytes(content))]
                    meta = {k: v for k, tag in _CORE.items() if core is not None and (v := core.findtext(tag))}
                    out.append((path, bool(texts), any(n.startswith("word/media/") for n in names), max(1, sum(map(len, texts)) // CHARS_PER_PAGE), meta, None))
                except Exception as e:  # noqa: BLE001 - any broken archive
                    out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "has_text", "has_images", "page_count", "metadata", "error"])

    return files.select("path", "content").mapInPandas(rows, "doc_id string, has_text boolean, has_images boolean, page_count int, metadata map<string,string>, error string")


def image_size(image: bytes) -> tuple[int, int]:
    """Width and height by the header of a PNG, GIF, BMP or JPEG; (0, 0) for others."""
    if image[:8] == b"\x89PNG\r\n\x1a\n" and len(image) >= 24:
        return struct.unpack(">II", image[16:24])
    if image[:6] in (b"GIF87a", b"GIF89a") and len(image) >= 10:
        return struct.unpack("<HH", image[6:10])
    if image[:2] == b"BM" and len(image) >= 26:
        width, height = struct.unpack("<ii", image[18:26])
        return abs(width), abs(height)
    if image[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(image) and image[at] == 0xFF:
            kind, length = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", image[at + 5 : at + 9])
                return width, height
            at += 2 + length
    return 0, 0


def classify_pdf(sniff: DataFrame) -> DataFrame:
    """doc_id, doc_type of PDFs by their first pages: doc_id, page, text, n_images, text_area, page_area."""
    first = sniff.where(F.col("page") <= SNIFFED)
    text = F.length(F.trim(F.coalesce("text", F.lit("")))) > TEXT_CHARS
    ratio = F.when(F.col("page_area") > 0, F.col("text_area") / F.col("page_area")).otherwise(0.0)
    g = first.groupBy("doc_id").agg(F.bool_or(text).alias("t"), F.bool_or(F.col("n_images") > 0).alias("i"), F.avg(ratio).alias("r"))
    kind = F.when(~F.col("t") & F.col("i"), "pdf_scanned").when(F.col("t") & F.col("i") & (F.col("r") < TEXT_SHARE), "pdf_mixed").otherwise("pdf_native")
    return g.select("doc_id", kind.alias("doc_type"))


def _paragraphs(content: bytes) -> list[tuple[str, float, bool, bool]]:
    """(text, size, bold, italic) of non-blank paragraphs; the first run gives the font, 12 points without size. Tables
    are not read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    body = root.find(f"{_W}body")
    for p in body.findall(f"{_W}p") if body is not None else ():
        text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
        if not text.strip():
            continue
        run = p.find(f"{_W}r")
        props = run.find(f"{_W}rPr") if run is not None else None
        size = props.find(f"{_W}sz") if props is not None else None
        on = lambda tag, props=props: props is not None and (e := props.find(f"{_W}{tag}")) is not None and e.get(f"{_W}val", "true") not in ("0", "false")
        out.append((text, float(size.get(f"{_W}val")) / 2 if size is not None else 12.0, on("b"), on("i")))
    return out


BLOCKS = "doc_id string, page int, block_idx int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double,page:int>, font_name string, font_size double, is_bold boolean, is_italic boolean, error string"


def docx_blocks(files: DataFrame) -> DataFrame:
    """Blocks of DOCX files (path, content): one page, boxes from 0 to 500 stacked by size plus 5. A file that can't be
    read is one row with `error`."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    y = 0.0
                    for i, (text, size, bold, italic) in enumerate(_paragraphs(bytes(content))):
                        out.append((path, 1, i, text, {"x0": 0.0, "y0": y, "x1": 500.0, "y1": y + size, "page": 1}, None, size, bold, italic, None))
                        y += size + 5
                except Exception as e:  # noqa: BLE001 - any broken archive
                    out.append((path, 1, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page", "block_idx", "text", "bbox", "font_name", "font_size", "is_bold", "is_italic", "error"])

    return files.select("path", "content").mapInPandas(rows, BLOCKS)


def pages_of(blocks: DataFrame, between: str = "\n\n") -> DataFrame:
    """doc_id, page, raw_text, has_text, text_coverage of blocks."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda b: b["text"]), between)
    return blocks.where("text is not null").groupBy("doc_id", "page").agg(text.alias("raw_text")).select("*", F.lit(True).alias("has_text"), F.lit(1.0).alias("text_coverage"))


def docx_images(files: DataFrame, least: int = LEAST_SIDE) -> DataFrame:
    """doc_id, page (1), idx, name, format, width, height, image of the media of DOCX files; those with a side of fewer than
    `least` pixels are left out, those whose size can't be told (0) stay. A broken archive has none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        idx = 0
                        for n in sorted(n for n in z.namelist() if n.startswith("word/media/")):
                            data = z.read(n)
                            width, height = image_size(data)
                            if not width or (width >= least and height >= least):
                                out.append((path, 1, idx, n.rpartition("/")[2], n.rpartition(".")[2].lower(), width, height, data))
                                idx += 1
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["doc_id", "page", "idx", "name", "format", "width", "height", "image"])

    return files.select("path", "content").mapInPandas(rows, "doc_id string, page int, idx int, name string, format string, width int, height int, image binary")


def _pdf_library():
    try:
        import fitz
    except ImportError as e:
        raise NotImplementedError("no PDF library is installed; give spans or blocks as a table") from e
    return fitz


SPANS = "doc_id string, page int, block_idx int, line_idx int, span_idx int, text string, font string, size double, bbox struct<x0:double,y0:double,x1:double,y1:double>, error string"


def pdf_spans(files: DataFrame) -> DataFrame:
    """Spans of PDFs (path, content), as lines() takes them; needs a PDF library in driver and executors, which this project
    does not bring. A file of more than MAX_PAGES pages, or one that can't be read, is one row with `error`."""
    _pdf_library()

    def spans_of(path: str, content: bytes) -> Iterator[tuple]:
        with _pdf_library().open(stream=content, filetype="pdf") as doc:
            if doc.page_count > MAX_PAGES:
                raise ValueError(f"more than {MAX_PAGES} pages")
            for number, page in enumerate(doc, 1):
                for b, block in enumerate(page.get_text("dict")["blocks"]):
                    for k, line in enumerate(block.get("lines", ())):
                        box = dict(zip(("x0", "y0", "x1", "y1"), line["bbox"]))
                        for i, span in enumerate(line["spans"]):
                            yield path, number, b, k, i, span["text"], span["font"], float(span["size"]), box, None

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += list(spans_of(path, bytes(content)))
                except Exception as e:  # noqa: BLE001 - any broken file
                    out.append((path, *[None] * 8, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page", "block_idx", "line_idx", "span_idx", "text", "font", "size", "bbox", "error"])

    return files.select("path", "content").mapInPandas(rows, SPANS)


def render_pages(files: DataFrame, routed: DataFrame) -> DataFrame:
    """doc_id, page, image (PNG) of the routed pages (doc_id, page) only, at DPI and with no side beyond LONGEST_SIDE;
    needs a PDF library as pdf_spans() does."""
    _pdf_library()
    wanted = routed.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitz = _pdf_library()
        for pdf in batches:
            out = []
            for path, content, pages in zip(pdf["path"], pdf["content"], pdf["pages"]):
                with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                    for number in pages:
                        if 1 <= number <= doc.page_count:
                            page = doc[int(number) - 1]
                            zoom = min(DPI / 72, LONGEST_SIDE / max(page.rect.width, page.rect.height))
                            out.append((path, int(number), page.get_pixmap(matrix=fitz.Matrix(zoom, zoom)).tobytes("png")))
            yield pd.DataFrame(out, columns=["doc_id", "page", "image"])

    return files.select("path", "content").join(wanted.withColumnRenamed("doc_id", "path"), "path").mapInPandas(rows, "doc_id string, page int, image binary")


def lines(spans: DataFrame) -> DataFrame:
    """Blocks from spans (doc_id, page, block_idx, line_idx, span_idx, text, font, size, bbox): blank spans dropped, mean
    size, most frequent font (of equals the first), bold and italic by the font's name."""
    full = spans.where(F.trim("text") != "")
    at = ("doc_id", "page", "block_idx", "line_idx")
    fonts = full.groupBy(*at, "font").agg(F.count("*").alias("n"), F.min("span_idx").alias("first")).groupBy(*at).agg(F.max_by("font", F.struct("n", -F.col("first"), "font")).alias("font_name"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_idx", "text"))), lambda s: s["text"]), "")
    low = F.lower("font")
    g = full.groupBy(*at).agg(text.alias("text"), F.avg("size").alias("font_size"), F.bool_or(low.rlike("bold|black")).alias("is_bold"), F.bool_or(low.rlike("italic|oblique")).alias("is_italic"), F.first("bbox").alias("bbox"))
    return g.join(fonts, [*at])
