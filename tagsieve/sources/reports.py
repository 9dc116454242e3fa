"""Report files to (doc_id, nome, texto).

Files come as (path, content BINARY), which is what Spark's binary file source
gives. Only ``.docx`` unpacking needs Python, one Arrow batch of files at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.functions import text
from tagsieve.session import stored

PASTED_NAME = "texto_colado"


@dataclass(frozen=True)
class Intake:
    reports: DataFrame  # doc_id, nome, texto
    rejected: DataFrame  # path, reason


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of every file below ``path`` whose name matches."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content")


def read_folder(spark: SparkSession, path: str, strict: bool = False) -> Intake:
    """``intake`` of a folder. Each content is read once: the names pick the files of a kind, and for
    rejected ones only the names are read."""
    return _assemble(
        _with_kind(read_files(spark, path, "*.[tT][xX][tT]")),
        _with_kind(read_files(spark, path, "*.[dD][oO][cC][xX]")),
        _with_kind(read_files(spark, path)),
        strict,
    )


def _with_kind(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    extension = F.when(name.contains("."), F.lower(F.regexp_extract(name, r"([^.]*)$", 1))).otherwise("")
    return files.select("path", "content", name.alias("name"), extension.alias("extension"))


def _unpacker(max_bytes: int):
    """Function over batches of .docx files; unreadable ones give a reason, not a failure.

    The text part is unpacked and parsed piece by piece, and finished paragraphs are let go, so a worker
    holds one paragraph and the text so far. A file that unpacks to more than ``max_bytes`` is
    given up there. Nested, so that it travels to the workers without this package.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        # Fixed value: the namespace of word-processing documents.
        space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        breaks = {space + "tab": "\t", space + "br": "\n", space + "cr": "\n", space + "noBreakHyphen": "-"}

        def run_text(run):
            pieces = []
            for node in run:
                if node.tag == space + "t":
                    pieces.append(node.text or "")
                elif node.tag == space + "br" and node.get(space + "type", "textWrapping") != "textWrapping":
                    continue  # page and column breaks are layout, not text
                elif node.tag in breaks:
                    pieces.append(breaks[node.tag])
            return "".join(pieces)

        def paragraph_text(paragraph):
            runs = []
            for node in paragraph:
                if node.tag == space + "r":
                    runs.append(run_text(node))
                elif node.tag == space + "hyperlink":
                    runs.extend(run_text(run) for run in node.findall(space + "r"))
            return "".join(runs).strip()

        class TooLarge(Exception):
            pass

        class Bounded:
            """A stream that ends with an error after max_bytes."""

            def __init__(self, stream):
                self.stream, self.left = stream, max_bytes

            def read(self, size=-1):
                data = self.stream.read(min(size, 65536) if size >= 0 else 65536)
                self.left -= len(data)
                if self.left < 0:
                    raise TooLarge
                return data

        def body_lines(stream):
            """The stripped texts of the paragraphs directly in the first body."""
            open_tags, bodies, keep = [], 0, False
            for event, node in ElementTree.iterparse(Bounded(stream), events=("start", "end")):
                if event == "start":
                    open_tags.append(node)
                    in_body = len(open_tags) > 1 and open_tags[1].tag == space + "body" and bodies == 0
                    if len(open_tags) == 3:
                        keep = in_body and node.tag == space + "p"
                    continue
                open_tags.pop()
                if len(open_tags) == 2 and keep:
                    yield paragraph_text(node)
                if len(open_tags) == 1 and node.tag == space + "body":
                    bodies += 1
                if len(open_tags) <= 2 or not keep:
                    # what is done or of no use takes no memory
                    node.clear()
                    if open_tags:
                        open_tags[-1].remove(node)
            if not bodies:
                raise ValueError("no body")

        def read(content):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as package, package.open("word/document.xml") as stream:
                    return "\n\n".join(line for line in body_lines(stream) if line), None
            except TooLarge:
                return None, f".docx file that unpacks to more than {max_bytes} bytes"
            except Exception as error:  # whatever is wrong with one file must not stop the others
                return None, f"unreadable .docx file ({type(error).__name__})"

        for batch in batches:
            read_all = [read(content) for content in batch["content"]]
            yield pd.DataFrame(
                {
                    "path": batch["path"],
                    "name": batch["name"],
                    "texto": pd.Series([body for body, _ in read_all], dtype=object),
                    "reason": pd.Series([reason for _, reason in read_all], dtype=object),
                }
            )

    return unpack


def read_docx(files: DataFrame, max_bytes: int = config.MAX_DOCX_BYTES) -> DataFrame:
    """(path, name, texto, reason) of (path, name, content) .docx files: the body's
    paragraphs, stripped, blanks dropped, joined by a blank line."""
    slim = files.select("path", "name", "content")
    return slim.mapInPandas(_unpacker(max_bytes), "path string, name string, texto string, reason string")


def intake(files: DataFrame, strict: bool = False) -> Intake:
    """Turn files into reports; unsupported or unreadable ones are listed with the reason.

    Bytes that are not UTF-8 are replaced, or an error where ``strict``. Files
    without any text are dropped.
    """
    kinds = _with_kind(files)
    return _assemble(kinds, kinds, kinds, strict)


def _assemble(txt_files: DataFrame, docx_files: DataFrame, all_files: DataFrame, strict: bool) -> Intake:
    """Every file is read once: texts and rejections are rows of one frame, stored for its two readers."""
    raw = F.col("content").cast("string")
    plain = txt_files.filter("extension = 'txt'").select(
        "path",
        "name",
        (F.validate_utf8(raw) if strict else F.make_valid_utf8(raw)).alias("texto"),
        F.lit(None).cast("string").alias("reason"),
    )
    documents = read_docx(docx_files.filter("extension = 'docx'"))
    unsupported = all_files.filter("extension not in ('txt', 'docx')")
    reason = F.when(F.col("extension") == "doc", "old .doc files are not supported: save as .docx").otherwise(
        F.concat(F.lit("format '."), F.col("extension"), F.lit("' is not supported: send .txt or .docx"))
    )
    nothing = F.lit(None).cast("string")
    refused = unsupported.select("path", "name", nothing.alias("texto"), reason.alias("reason"))
    found = stored(plain.unionByName(documents).unionByName(refused))
    reports = found.filter(F.col("reason").isNull() & (text.strip(F.col("texto")) != "")).select(
        F.col("path").alias("doc_id"), F.regexp_replace("name", r"\.[^.]*$", "").alias("nome"), "texto"
    )
    return Intake(reports, found.filter("reason is not null").select("path", "reason"))


def pasted(texts: DataFrame) -> DataFrame:
    """Reports from pasted text (doc_id, texto); blank ones are dropped."""
    kept = texts.filter(text.strip(F.col("texto")) != "")
    return kept.select("doc_id", F.lit(PASTED_NAME).alias("nome"), "texto")
