"""Files to rows (path, text, metadata), by extension; every reader is a lazy plan over Spark's file sources."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import html_to_text, strip

Reader = Callable[[DataFrame], DataFrame]


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, extension, content) of files and of all files below folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "content")


def _text(files: DataFrame) -> DataFrame:
    """Bytes as UTF-8, bad ones as U+FFFD."""
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _with(df: DataFrame, kind: str, **more) -> DataFrame:
    given = {"source": F.col("path"), "type": F.lit(kind)} | more
    return df.select("path", "text", F.create_map(*(x for k, v in given.items() for x in (F.lit(k), v.cast("string")))).alias("metadata"))


def read_text(files: DataFrame) -> DataFrame:
    return _with(_text(files), "text")


def read_html(files: DataFrame) -> DataFrame:
    return _with(_text(files).withColumn("text", html_to_text(F.col("text"))), "html")


def read_markdown(files: DataFrame) -> DataFrame:
    return _with(_text(files), "markdown")


HEADER = r"^(#{1,6})\s+(.+)$"


def markdown_sections(df: DataFrame) -> DataFrame:
    """(path, text, metadata) of each section under a header of texts (path, text); what comes before the first goes.

    A text without headers stays whole.
    """
    parts = F.filter(F.split("text", rf"(?m)(?={HEADER})"), lambda p: p.rlike(rf"^{HEADER[1:-1]}"))
    rows = df.select("path", F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array("text"))).alias("section"))
    pick = lambda k: F.regexp_extract("section", rf"(?m)\A{HEADER}", k)
    has = F.length(pick(1)) > 0
    return rows.select(
        "path",
        F.when(has, strip(F.regexp_replace("section", rf"(?m)\A{HEADER}\n?", ""))).otherwise(F.col("section")).alias("text"),
        F.when(has, F.create_map(F.lit("source"), "path", F.lit("type"), F.lit("markdown"), F.lit("header"), strip(pick(2)), F.lit("level"), F.length(pick(1)).cast("string"))).otherwise(F.create_map(F.lit("source"), "path", F.lit("type"), F.lit("markdown"))).alias("metadata"),
    )


def row_text(df: DataFrame, columns: list[str] | None = None):
    """A column: name: value of each cell that is neither null nor empty, or the bare values of some columns."""
    cell = lambda c: F.col(f"`{c}`").cast("string")
    shown = [F.when(cell(c) != "", cell(c) if columns else F.concat(F.lit(f"{c}: "), cell(c))) for c in columns or df.columns]
    return F.concat_ws("\n", *shown)


def read_csv(files: DataFrame, columns: list[str] | None = None, delimiter: str = ",") -> DataFrame:
    """A text for each row of each file; row counts all rows of the file from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made: list[tuple[str, int]] = []
                for n, row in enumerate(csv.DictReader(io.StringIO(text), delimiter=delimiter)):
                    if columns:
                        shown = [row[c] for c in columns if row.get(c)]
                    else:
                        shown = [f"{k}: {v}" for k, v in row.items() if v and k is not None]
                    if shown:
                        made.append(("\n".join(shown), n))
                if made:
                    yield pa.record_batch([pa.array([path] * len(made)), pa.array([m[0] for m in made]), pa.array([m[1] for m in made])], ["path", "text", "row"])

    rows = _text(files).mapInArrow(run, "path string, text string, row bigint")
    return _with(rows, "csv", row=F.col("row"))


def read_pdf(files: DataFrame, tables: bool = False) -> DataFrame:
    """A text for each page that has any; needs pypdf, or pdfplumber for tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            try:
                if tables:
                    import pdfplumber
                else:
                    import pypdf
            except ImportError as missing:
                raise ImportError(f"install {missing.name} to read PDF files") from missing
            for path, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                out: list[tuple[str, int]] = []
                if tables:
                    with pdfplumber.open(io.BytesIO(content)) as book:
                        for n, page in enumerate(book.pages, 1):
                            text = page.extract_text() or ""
                            for table in page.extract_tables():
                                text += "\n[Table]\n" + "\n".join(" | ".join(c or "" for c in row) for row in table)
                            out.append((text, n))
                else:
                    out = [(page.extract_text() or "", n) for n, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1)]
                out = [o for o in out if o[0].strip()]
                if out:
                    yield pa.record_batch([pa.array([path] * len(out)), pa.array([o[0] for o in out]), pa.array([o[1] for o in out])], ["path", "text", "page"])

    return _with(files.mapInArrow(run, "path string, text string, page bigint"), "pdf", page=F.col("page"))


READERS: dict[str, Reader] = {"txt": read_text, "html": read_html, "htm": read_html, "md": read_markdown, "csv": read_csv, "pdf": read_pdf}


def register(extension: str, reader: Reader) -> None:
    """reader: rows (path, extension, content) to rows (path, text, metadata)."""
    READERS[extension.lower().lstrip(".")] = reader


def load(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text, metadata) of files, by extension; others are read as text. Of folders only known kinds are read."""
    given = [paths] if isinstance(paths, str) else list(paths)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there, folders = [], []
    for p in given:
        path = jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(conf)
        if system.exists(path):  # missing ones are left out
            (folders if system.getFileStatus(path).isDirectory() else there).append(p)
    parts = []
    for some, is_folder in ((there, False), (folders, True)):
        if not some:
            continue
        files = _files(spark, some)
        known = F.col("extension").isin(*READERS)
        for extension, reader in READERS.items():
            parts.append(reader(files.where(F.col("extension") == extension)))
        if not is_folder:
            parts.append(read_text(files.where(~known)))
    if not parts:
        return spark.createDataFrame([], "path string, text string, metadata map<string,string>")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
