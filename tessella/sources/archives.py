"""Publications and reports as rows: EPUB, DOCX, JATS, XLSX, PDF text.

Files are read through Spark's binaryFile source, so any store that Spark reads will do; each task parses its own files.
A file that can't be parsed gives one row with its error and no content.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources import pdf_text

PART = "path string, part string, ordinal int, kind string, content string, error string"
_NAMES = ["path", "part", "ordinal", "kind", "content", "error"]
Part = tuple[str, str, str]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _safe_xml(raw: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in raw[:100_000].upper():
        raise ValueError("entity declarations are not read")
    return ElementTree.fromstring(raw)


def epub_parts(raw: bytes) -> Iterator[Part]:
    """(name, kind, text): the package file, then documents in reading order, then the other texts of the manifest."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        container = _safe_xml(z.read("META-INF/container.xml"))
        package = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
        opf = z.read(package)
        yield package, "package", opf.decode("utf-8", "replace")
        root = _safe_xml(opf)
        items = {e.attrib["id"]: e.attrib for e in root.iter() if _local(e.tag) == "item"}
        order = [e.attrib["idref"] for e in root.iter() if _local(e.tag) == "itemref"]
        rest = [i for i in items if i not in order]
        have = set(z.namelist())
        for i in [*order, *rest]:
            item = items.get(i, {})
            name = posixpath.normpath(posixpath.join(posixpath.dirname(package), item.get("href", "")))
            if name in have and re.search("html|css|xml|ncx", item.get("media-type", "")):
                yield name, "spine" if i in order else "resource", z.read(name).decode("utf-8", "replace")


def docx_parts(raw: bytes) -> Iterator[Part]:
    """A part for each paragraph: its style and text."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = _safe_xml(z.read("word/document.xml"))
    for n, p in enumerate(e for e in root.iter() if _local(e.tag) == "p"):
        style = next((v for e in p.iter() if _local(e.tag) == "pStyle" for k, v in e.attrib.items() if _local(k) == "val"), "Normal")
        text = "".join({"t": e.text or "", "tab": "\t", "br": "\n"}.get(_local(e.tag), "") for e in p.iter())
        yield f"p{n}", style, text


def jats_parts(raw: bytes) -> Iterator[Part]:
    """Title, abstract, paragraphs with their section's title, references."""
    root = _safe_xml(raw)

    def text(e: ElementTree.Element) -> str:
        return re.sub(r"\s+", " ", "".join(e.itertext())).strip()

    for e in root.iter():
        if _local(e.tag) in ("article-title", "abstract") and e is not None:
            yield _local(e.tag), _local(e.tag), text(e)
    for body in (e for e in root.iter() if _local(e.tag) == "body"):
        for section in (e for e in body.iter() if _local(e.tag) in ("sec", "body")):
            title = next((text(c) for c in section if _local(c.tag) == "title"), "")
            for c in section:
                if _local(c.tag) == "p":
                    yield title, "paragraph", text(c)
    for n, r in enumerate(e for e in root.iter() if _local(e.tag) == "ref"):
        yield r.attrib.get("id", f"ref{n}"), "reference", text(r)


def xlsx_parts(raw: bytes) -> Iterator[Part]:
    """A part for each row of each sheet: cells joined by tabs."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in _safe_xml(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        for sheet in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in (e for e in _safe_xml(z.read(sheet)).iter() if _local(e.tag) == "row"):
                cells = []
                for c in (e for e in row if _local(e.tag) == "c"):
                    v = next((e.text or "" for e in c.iter() if _local(e.tag) in ("v", "t")), "")
                    cells.append(shared[int(v)] if c.attrib.get("t") == "s" and v else v)
                yield posixpath.basename(sheet), row.attrib.get("r", ""), "\t".join(cells)


def pdf_parts(raw: bytes) -> Iterator[Part]:
    """A part for each content stream: the strings that it shows, codes read through the map of their font."""
    if not raw.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    for name, text in pdf_text.streams(raw):
        yield name, "text", text


PARSERS: dict[str, Callable[[bytes], Iterator[Part]]] = {"epub": epub_parts, "docx": docx_parts, "jats": jats_parts, "xlsx": xlsx_parts, "pdf": pdf_parts}


def read_parts(spark: SparkSession, folder: str, kind: str, pattern: str | None = None) -> DataFrame:
    """path, part, ordinal, kind, content, error of the files of a folder; kind: epub, docx, jats, xlsx or pdf."""
    parse = PARSERS[kind]
    ending = {"jats": "xml"}.get(kind, kind)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern or f"*.{ending}").option("recursiveFileLookup", "true").load(folder)

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(path, p, n, k, c, None) for n, (p, k, c) in enumerate(parse(raw))]
                except Exception as e:  # a broken file is a row, not the end of the job
                    rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}"[:300])]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], _NAMES)

    return files.select("path", "content").mapInArrow(run, PART)


def reference_lookup(citations: DataFrame, dimension: DataFrame, doi: str = "doi") -> DataFrame:
    """citations with the columns of a table of known works by DOI, lower case; what a remote lookup would answer."""
    d = dimension.withColumn("_doi", F.lower(doi)).drop(doi)
    return citations.join(d, F.lower(citations[doi]) == F.col("_doi"), "left").drop("_doi")
