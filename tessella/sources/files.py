"""Texts from files: plain, markdown, HTML, word processor and spreadsheet files, one row per file.

Reading is distributed over the files; a file that can't be read gives a row with `error` instead of ending the job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.cleaning import Cleaning, clean, strip_markdown
from tessella.functions.html_text import page_text
from tessella.operators.training import with_offsets
from tessella.runtime import arrow_path, materialize

_word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_sheet = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(data: bytes) -> str:
    """Paragraphs with text, a blank line between them."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(_word + "t")) for p in root.iter(_word + "p"))
    return "\n\n".join(p for p in paragraphs if p.strip())


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = 26 * n + ord(ch.upper()) - 64
    return n - 1


def markdown_table(rows: list[list[str]]) -> str:
    """Rows of cells as a Markdown table; short rows are filled up, empty cells hold a space."""
    rows = [[(c or "").replace("\n", " ").strip() or " " for c in r] for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join(cells) + " |"
    full = [line(r + [" "] * (width - len(r))) for r in rows]
    return "\n".join([full[0], line(["---"] * width), *full[1:]])


def xlsx_text(data: bytes) -> str:
    """Every sheet as heading and table; rows without text are left out."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(_sheet + "t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(_sheet + "si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    parts = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_sheet + "sheet"):
        rows = []
        target = targets[sheet.get(_rel + "id")].lstrip("/")
        for row in ElementTree.fromstring(book.read(target if target.startswith("xl/") else "xl/" + target)).iter(_sheet + "row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(_sheet + "c")):
                v, inline = c.find(_sheet + "v"), c.find(_sheet + "is")
                text = "".join(t.text or "" for t in inline.iter(_sheet + "t")) if inline is not None else (v.text or "") if v is not None else ""
                cells[_column(c.get("r")) if c.get("r") else k] = shared[int(text)] if c.get("t") == "s" and text else text
            line = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
            if any(x.strip() for x in line):
                rows.append(line)
        if table := markdown_table(rows):
            parts.append(f"## {sheet.get('name')}\n\n{table}")
    return "\n\n".join(parts)


def _plain(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")


#: Extractors by file ending.  PDF and image extractors need libraries that aren't here; register one to enable them.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"txt": _plain, "md": _plain, "markdown": _plain, "html": lambda d: page_text(_plain(d)), "htm": lambda d: page_text(_plain(d)), "docx": docx_text, "xlsx": xlsx_text}
MARKDOWN = ("md", "markdown")


def register(ending: str, extractor: Callable[[bytes], str]) -> None:
    """Add an extractor, for example of PDF pages or of scanned images."""
    EXTRACTORS[ending.lower().lstrip(".")] = extractor


def ending(path: str) -> str:
    """The known ending of a path; an unknown one is a ValueError."""
    got = path.rpartition(".")[2].lower()
    if got not in EXTRACTORS:
        raise ValueError(f"no extractor for {path!r}")
    return got


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(spark: SparkSession, place: str, recursive: bool) -> DataFrame:
    """(path) of the files of a folder, of a file or of a glob; hidden ones are left out.

    Folders are listed level by level in tasks, so that the driver holds no list of files.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    starts = [(x.getPath().toString(), x.isDirectory()) for x in system.globStatus(where) or []]
    if not starts:
        raise FileNotFoundError(place)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                fs, path = arrow_path(folder)
                got = [x for x in fs.get_file_info(FileSelector(path)) if x.type in (FileType.File, FileType.Directory) and not _hidden(x.base_name)]
                yield pa.record_batch([pa.array([f"{folder.rstrip('/')}/{x.base_name}" for x in got], pa.string()), pa.array([x.type == FileType.Directory for x in got], pa.bool_())], names=["path", "is_folder"])

    level = spark.createDataFrame(starts, "path string, is_folder boolean")
    files, folders = level.filter("not is_folder"), level.filter("is_folder").select("path")
    n = sum(x[1] for x in starts)
    while n:
        parts = min(n, 4 * spark.sparkContext.defaultParallelism)
        level = materialize(folders.repartition(parts).mapInArrow(entries, "path string, is_folder boolean"), "listing")
        files, folders = files.unionByName(level.filter("not is_folder")), level.filter("is_folder").select("path")
        n = folders.count() if recursive else 0
    return files.select("path")


#: A batch of read files is passed on once it holds so many bytes.
BATCH_BYTES = 4 << 20


def _contents(files: DataFrame) -> DataFrame:
    """`files`(path, ..) with their bytes as `content`, in two tasks for a core, whatever their number.  Materialized."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, data = 0, 0, []
            for k, place in enumerate(batch.column("path").to_pylist()):
                fs, path = arrow_path(place)
                with fs.open_input_stream(path) as f:
                    data.append(f.read())
                held += len(data[-1])
                if held > BATCH_BYTES or k + 1 == batch.num_rows:
                    own = batch.slice(start, len(data))
                    yield pa.record_batch([*own.columns, pa.array(data, pa.binary())], names=[*own.schema.names, "content"])
                    start, held, data = k + 1, 0, []

    spark = files.sparkSession
    dealt = files.repartition(2 * spark.sparkContext.defaultParallelism, "path")
    return materialize(dealt.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in files.dtypes) + ", content binary"), "contents")


def _numbered(names: DataFrame) -> DataFrame:
    """`names`(path, input, ..) with `doc_idx`, their place by input and path; names are numbered in ranges, not in one task."""
    keyed = names.withColumn("_one", F.lit(1)).withColumn("_at", F.concat(F.lpad(F.col("input").cast("string"), 6, "0"), F.lit("|"), "path"))
    return with_offsets(keyed, "_one", "_at").withColumn("doc_idx", F.col("start_off").cast("int")).drop("_one", "_at", "start_off", "end_off")


def read_files(spark: SparkSession, paths: str | list[str], recursive: bool = False, level: Cleaning = Cleaning.STANDARD) -> DataFrame:
    """(path, stem, ending, text, error, doc_idx) of the files of known endings, in the order of the paths given.

    `stem` is made unique: a second file of the same stem takes its ending along.
    """
    paths = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    parts = []
    extractors = dict(EXTRACTORS)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    for k, p in enumerate(paths):
        parts.append(_listed(spark, p, recursive).select("path", F.lit(k).alias("input")))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)

    @F.pandas_udf("text string, error string")
    def extract(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        texts, errors = [], []
        for data, e in zip(content, kind):
            try:
                texts.append(extractors[e](data))
                errors.append(None)
            except Exception as x:  # any broken file is reported, not fatal
                texts.append(None)
                errors.append(f"{type(x).__name__}: {x}"[:200])
        return pd.DataFrame({"text": texts, "error": errors})

    listed = found.select("path", "input", kind.alias("ending"), F.regexp_replace(name, r"\.[^.]+$", "").alias("_stem")).filter(F.col("ending").isin(list(extractors)))
    listed = materialize(listed, "file-names")
    twin = F.row_number().over(Window.partitionBy("_stem").orderBy("input", "path"))
    named = listed.select("path", "input", "ending", F.when(twin == 1, F.col("_stem")).otherwise(F.concat_ws("_", "_stem", "ending")).alias("stem"))
    listed = materialize(_numbered(named), "files-in-order")
    d = _contents(listed).withColumn("r", extract("content", "ending"))
    raw = F.when(F.col("ending").isin(list(MARKDOWN)), strip_markdown(F.col("r.text"))).otherwise(F.col("r.text"))
    return d.select("path", "stem", "ending", clean(raw, level).alias("text"), F.col("r.error").alias("error"), "doc_idx")


def read_texts(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, text, doc_idx) of the .txt files under the folders, sorted within each; a folder without any is an error."""
    parts = []
    for k, folder in enumerate(folders):
        parts.append(_listed(spark, folder, True).filter(F.col("path").endswith(".txt")).select("path", F.lit(k).alias("input")))
        if parts[-1].isEmpty():
            raise FileNotFoundError(f"no .txt files under {folder}")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    listed = materialize(_numbered(out), "files-in-order")
    return _contents(listed).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "doc_idx")


def ingest(spark: SparkSession, source: str | list[str], target: str, recursive: bool = False, level: Cleaning = Cleaning.STANDARD) -> int:
    """Read all files of the source, clean them, and write (path, stem, ending, text, error, doc_idx) to `target`.

    Web addresses are refused: fetching is left to a fetcher that writes files.  Returns the number of files with an error.
    """
    named = [source] if isinstance(source, str) else source
    web = [x for x in named if x.split("://")[0].lower() in ("http", "https")]
    if web:
        raise ValueError(f"fetch {web[0]} to a folder first")
    read_files(spark, source, recursive, level).write.parquet(target)
    return spark.read.parquet(target).filter("error is not null").count()
