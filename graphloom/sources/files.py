"""Sources and sinks on files: distillers by extension, labelled JSON lines, processed files, settings, tables and images."""

from __future__ import annotations

import csv
import io
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.spread import numbered

# Parts of a word-processor file.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".gif", ".tiff", ".tif")
OCR_FAILED = "OCR Error"


class Distiller:
    """What a document format provides (SRC1): text, images and tables from the bytes of a file. All run inside tasks."""

    def text(self, content: bytes) -> str:
        """The text, unfiltered."""
        raise NotImplementedError

    def blocks(self, content: bytes) -> list[str]:
        """The candidate blocks: lines, unless the format has blocks of its own."""
        return self.text(content).split("\n")

    def images(self, content: bytes) -> Iterator[tuple[int, int, Callable[[], bytes]]]:
        """(page, index, a call that reads it) of each image; page is 0 where the format has no pages. An image that cannot be read keeps its index."""
        return iter(())

    def tables(self, content: bytes) -> list[list[list[str]]]:
        return []


class PlainText(Distiller):
    def text(self, content: bytes) -> str:
        return content.decode("utf-8", "replace")


class Docx(Distiller):
    """Word-processor files, read with the standard library (SRC3, SRC4, SRC6, SRC10)."""

    def _root(self, content: bytes) -> ElementTree.Element | None:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return ElementTree.fromstring(z.read("word/document.xml")) if "word/document.xml" in z.namelist() else None

    def text(self, content: bytes) -> str:
        root = self._root(content)
        if root is None:
            return ""
        made = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
        paragraphs = ["".join(t.text or "" if t.tag == f"{WORD}t" else made.get(t.tag, "") for t in p.iter()) for p in root.iter(f"{WORD}p")]
        return "\n".join(paragraphs)

    def images(self, content: bytes) -> Iterator[tuple[int, int, Callable[[], bytes]]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i, n in enumerate(sorted(n for n in z.namelist() if n.startswith("word/media/") and n.lower().endswith(IMAGES))):
                yield 0, i, lambda n=n: z.read(n)

    def tables(self, content: bytes) -> list[list[list[str]]]:
        root = self._root(content)
        if root is None:
            return []
        cell = lambda c: "".join(t.text or "" for t in c.iter(f"{WORD}t")).strip()
        found = [[[cell(c) for c in r.iter(f"{WORD}tc")] for r in t.iter(f"{WORD}tr")] for t in root.iter(f"{WORD}tbl")]
        return [t for t in found if t]


class Pdf(Distiller):
    """Portable documents (SRC2, SRC5, SRC7-SRC9), where the libraries that read them are installed on the executors.

    ``ruling``: None for all tables; "lines" for tables with ruled lines; "rows" for horizontal rules only. With a ruling, tables without a filled row are left out.
    """

    # Settings of the table finder.
    RULINGS = {
        "lines": {"vertical_strategy": "lines", "horizontal_strategy": "lines", "snap_tolerance": 3, "join_tolerance": 3},
        "rows": {"vertical_strategy": "text", "horizontal_strategy": "lines", "snap_tolerance": 5, "join_tolerance": 5},
    }

    def __init__(self, ruling: str | None = None):
        self.ruling = ruling

    def blocks(self, content: bytes) -> list[str]:
        """Blocks of all pages in order, with the line feeds that they have inside."""
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            return [b[4] for page in doc for b in page.get_text("blocks")]

    def text(self, content: bytes) -> str:
        return "\n".join(self.blocks(content))

    def images(self, content: bytes) -> Iterator[tuple[int, int, Callable[[], bytes]]]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            for number, page in enumerate(doc, 1):
                for i, x in enumerate(page.get_images(full=True)):
                    yield number, i, lambda x=x: doc.extract_image(x[0])["image"]

    def tables(self, content: bytes) -> list[list[list[str]]]:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as doc:
            found = [[[c or "" for c in r] for r in t] for page in doc.pages for t in page.extract_tables(self.RULINGS.get(self.ruling, {}))]
        return [t for t in found if self.ruling is None or any(t)]


DISTILLERS: dict[str, Distiller] = {".txt": PlainText(), ".md": PlainText(), ".docx": Docx(), ".pdf": Pdf()}


def register_distiller(extension: str, distiller: Distiller) -> None:
    """Make a format known."""
    DISTILLERS[extension.lower()] = distiller


def _per_file(files: DataFrame, each: Callable[[Distiller, str, bytes], list[dict]], schema: str) -> DataFrame:
    """``each`` applied to every file of a known extension; a file that cannot be read gives a row with only path and error."""
    known = dict(DISTILLERS)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows: list[dict] = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                d = known.get(PurePosixPath(path).suffix.lower())
                if d is None:
                    rows.append({"path": path, "error": "unknown extension"})
                    continue
                try:
                    rows += [{"path": path, **r} for r in each(d, path, bytes(content))]
                except Exception as e:  # one broken file does not stop the others
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None) if rows else pd.DataFrame({n: [] for n in names})

    return files.select("path", "content").mapInPandas(run, schema)


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content, ...) of files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def documents(files: DataFrame) -> DataFrame:
    """(path, text, blocks, error) of each file; apply ``text_blocks`` to the texts, or ``listed_blocks`` to the blocks where these may hold line feeds."""

    def read(d: Distiller, _: str, c: bytes) -> list[dict]:
        found = d.blocks(c)
        return [{"text": "\n".join(found), "blocks": found}]

    return _per_file(files, read, "path string, text string, blocks array<string>, error string")


def tables(files: DataFrame) -> DataFrame:
    """(path, table_idx, row_idx, cells, error) of each row of each table; nested tables also stand on their own."""
    each = lambda d, _, c: [{"table_idx": i, "row_idx": j, "cells": row} for i, t in enumerate(d.tables(c)) for j, row in enumerate(t)]
    return _per_file(files, each, "path string, table_idx int, row_idx int, cells array<string>, error string")


def images(files: DataFrame, ocr: Callable[[bytes], list[str]] | None = None, readable: Callable[[bytes], object] | None = None) -> DataFrame:
    """(path, page, image_idx, image, ocr_text, error) of each image.

    ``ocr`` gives the lines of an image; where it fails the text says so. An image that cannot be taken out of its file, or that ``readable`` raises for, is left out;
    those behind it keep their index.
    """

    def text_of(image: bytes) -> str:
        try:
            return "\n".join(ocr(image)) if ocr else ""
        except Exception:
            return OCR_FAILED

    def each(d: Distiller, _: str, c: bytes) -> list[dict]:
        rows = []
        for page, i, read in d.images(c):
            try:
                image = read()
                if readable:
                    readable(image)
            except Exception:
                continue
            rows.append({"page": page, "image_idx": i, "image": image, "ocr_text": text_of(image)})
        return rows

    return _per_file(files, each, "path string, page int, image_idx int, image binary, ocr_text string, error string")


def table_csv(rows: list[list[str]], index: int) -> str:
    """A table as text: a heading, the rows as CSV, and an empty line (SNK8)."""
    out = io.StringIO()
    out.write(f"Table {index}:\n")
    csv.writer(out, lineterminator="\n").writerows(rows)
    out.write("\n")
    return out.getvalue()


def csv_line(cells: Column) -> Column:
    """An array of cells as one line of CSV: a cell with a comma, a quote or a line end stands in quotes."""
    one = lambda c: F.when(F.rlike(c, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    whole = F.array_join(F.transform(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), one), ",")
    return F.when((F.size(cells) == 1) & (whole == ""), F.lit('""')).otherwise(whole)


def table_lines(found: DataFrame) -> DataFrame:
    """(path, table_idx, row_idx, line) of ``tables``: a heading (row_idx -1), each row as CSV, and an empty line behind the last one."""
    rows = found.filter(F.col("error").isNull() & F.col("table_idx").isNotNull())
    ends = rows.groupBy("path", "table_idx").agg((F.max("row_idx") + 1).alias("last")).select("path", "table_idx", F.explode(F.array(F.struct(F.lit(-1).alias("row_idx"), F.format_string("Table %d:", "table_idx").alias("line")), F.struct(F.col("last").alias("row_idx"), F.lit("").alias("line")))).alias("x"))
    return rows.select("path", "table_idx", "row_idx", csv_line(F.col("cells")).alias("line")).unionByName(ends.select("path", "table_idx", "x.row_idx", "x.line"))


def write_tables(found: DataFrame, path: str) -> None:
    """One text file for each table, in folders by file and table, its lines in order (SNK8)."""
    lines = table_lines(found).repartition("path", "table_idx").sortWithinPartitions("path", "table_idx", "row_idx")
    lines.select("path", "table_idx", "line").write.partitionBy("path", "table_idx").mode("append").text(path)


def json_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(line_no, v) of each line that is JSON, v as a variant; see ``lenient`` (SRC11). Lines count from 0 through all files in order of path."""
    # Within a part of a file the id grows; parts are put in order by their file and place.
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    lines = numbered(spark.read.text(path).select(F.lit(0).alias("_all"), at.alias("_place"), F.col("value").alias("line")), "_all", "_place", "line_no")
    return lenient(lines.select("line_no", "line"), limit)


def lenient(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """(line_no, v) from (line_no, line): blank lines and lines that are not JSON are skipped, then the first ``limit`` stay."""
    rows = lines.select("line_no", F.try_parse_json("line").alias("v")).filter(F.col("v").isNotNull())
    return rows.orderBy("line_no").limit(limit) if limit is not None else rows


def at_value(v, path: str):
    """A string, or the string under "@value" where an object stands in its place."""
    return F.coalesce(F.try_variant_get(v, f"{path}['@value']", "string"), F.try_variant_get(v, path, "string"))


def labelled_rows(corpus: DataFrame) -> DataFrame:
    """(doc_id, ord, subject, subject_type, object, object_type, predicate) of each entry of spo_list in (line_no, v)."""
    items = F.from_json(F.to_json(F.try_variant_get("v", "$.spo_list", "variant")), "array<variant>")
    each = corpus.select(F.col("line_no").alias("doc_id"), F.posexplode(items).alias("ord", "x"))
    text = lambda k: F.try_variant_get("x", f"$.{k}", "string")
    return each.select("doc_id", "ord", text("subject").alias("subject"), at_value("x", "$.subject_type").alias("subject_type"), at_value("x", "$.object").alias("object"), at_value("x", "$.object_type").alias("object_type"), text("predicate").alias("predicate"))


def truth_entities(rows: DataFrame) -> DataFrame:
    """(doc_id, ord, name, label): subject before object of each entry (D6); ``entity_lists`` keeps the first of each name."""
    e = lambda n, l: F.struct(F.col(n).alias("name"), F.col(l).alias("label"))
    both = rows.select("doc_id", F.col("ord").alias("r"), F.posexplode(F.array(e("subject", "subject_type"), e("object", "object_type"))).alias("k", "e"))
    return both.select("doc_id", (2 * F.col("r") + F.col("k")).alias("ord"), "e.name", "e.label").filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("label", F.lit("")) != ""))


def new_files(found: DataFrame, processed: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``found`` whose key was not processed yet (SRC13)."""
    return found.join(processed.select(key).distinct(), key, "left_anti").select(found.columns)


def settings(path: str) -> dict:
    """The file of settings; an error if there is none (SRC12)."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def provider(config: dict) -> tuple[str, dict]:
    """(name, its section) of the chosen provider; "openai" if none is named."""
    name = config.get("disk", {}).get("llm", "openai")
    return name, config.get(name, {})
