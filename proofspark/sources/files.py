"""Raw files: format gate, text decoding, DOCX paragraphs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from proofspark import constants as K
from proofspark.functions.text import explode_rows
from proofspark.session import opened, written

# --- fixed values: media types and archive limits ---
MEDIA_TYPES = {
    "txt": ["text/plain"],
    "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip"],
    "pdf": ["application/pdf"],
}
ANY_MEDIA_TYPES = ["", "application/octet-stream"]
MAX_ENTRIES = 1_000
MAX_UNZIPPED = 50 * 1024 * 1024
MAX_BODY = 10 * 1024 * 1024
#: Files and bytes that one task reads, about; bytes of contents in one batch of rows.
TASK_FILES, TASK_BYTES, BATCH_BYTES = 10_000, 128 << 20, 8 << 20
#: Files in one folder of many that tasks write, about.
FOLDER_FILES = 1_000


def media_type_allowed(media_type: Column, document_format: Column) -> Column:
    bare = F.lower(F.trim(F.split(F.coalesce(media_type, F.lit("")), ";")[0]))
    allowed = bare.isin(ANY_MEDIA_TYPES)
    for name, types in MEDIA_TYPES.items():
        allowed = allowed | ((document_format == name) & bare.isin(types))
    return allowed


def write_files(rows: DataFrame, folder: str) -> int:
    """One file for each (doc_id, name, content), written by the tasks into folders of about ``FOLDER_FILES``; how many.

    The subfolder follows from doc_id, so a task that is run again replaces its files.
    """
    most = rows.count() // FOLDER_FILES + 1
    placed = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(most)).alias("part"), "name", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        made = set()
        for b in batches:
            for part, name, content in zip(*(b.column(k).to_pylist() for k in range(3))):
                if part not in made:
                    store.create_dir(f"{root}/{part}", recursive=True)
                    made.add(part)
                with store.open_output_stream(f"{root}/{part}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["files"])

    return placed.mapInArrow(run, "files bigint").agg(F.sum("files")).first()[0] or 0


def _listing(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for b in batches:
            for inside in b.column(0).to_pylist():
                base = root.rstrip("/") + inside
                names, sizes, folders = [], [], []
                for info in store.get_file_info(pyarrow.fs.FileSelector(base or "/")):
                    name = info.base_name
                    if name.startswith(("_", ".")) and not (name.startswith("_") and "=" in name) or name.endswith("._COPYING_"):
                        continue  # hidden from Spark's readers as well
                    names.append(f"{inside}/{name}")
                    sizes.append(info.size)
                    folders.append(info.type == pyarrow.fs.FileType.Directory)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(folders, pa.bool_())], ["name", "length", "folder"])

    return run


def _contents(folder: str):
    names = ["name", "length", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))], names)

        for b in batches:
            for name, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_stream(root.rstrip("/") + name) as source:
                    content = source.read()
                rows.append((name, length, content))
                held += len(content)
                if held >= BATCH_BYTES or len(rows) >= 4096:
                    yield batch()
                    rows, held = [], 0
        yield batch()

    return run


def read_files(spark: SparkSession, path: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, length) of all files below a folder, and (path, length, content) of those of at most ``most`` bytes.

    The tasks list the folder, a level of subfolders at a time, and read the files: neither their names nor their number
    reach the driver. Names that Spark's readers hide are left out, and empty files, as there. Patterns, single files and stores that Arrow has no
    file system for are left to Spark's reader.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = store.makeQualified(root).toString().rstrip("/")
    try:
        opened(path)
        own = store.exists(root) and store.getFileStatus(root).isDirectory()
    except (ValueError, OSError):
        own = False
    if not own:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        few = raw if most is None else raw.where(F.col("length") <= most)
        return raw.select("path", "length"), few.select("path", "length", "content")
    slots = spark.sparkContext.defaultParallelism
    level, names = spark.range(1).select(F.lit("").alias("name")), None
    while True:
        found = written(level.mapInArrow(_listing(path), "name string, length bigint, folder boolean"), "files-listed")
        files = found.where("not folder and length > 0").select("name", "length")
        names = files if names is None else names.unionByName(files)
        level = found.where("folder").select("name")
        if level.isEmpty():
            break
        level = level.repartition(slots, "name")
    few = names if most is None else names.where(F.col("length") <= most)
    n, size = few.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(slots, n), -(-n // TASK_FILES), -(-size // TASK_BYTES))
    read = few.repartition(tasks, "name").mapInArrow(_contents(path), "name string, length bigint, content binary")
    full = F.concat(F.lit(whole), F.col("name")).alias("path")
    return names.select(full, "length"), read.select(full, "length", "content")


def scan_files(spark: SparkSession, path: str, media_types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, rejects) of a folder.

    Too large files are told by their length alone, their content is never read. All others are read once, and the
    accepted ones stored in the shared scratch folder as rows. ``media_types`` (path, media_type) holds declared types.
    """
    listed, read = read_files(spark, path, K.MAX_UPLOAD_BYTES)
    too_large = listed.where(F.col("length") > K.MAX_UPLOAD_BYTES).select("path", F.lit("FILE_TOO_LARGE").alias("error_code"))
    name = F.regexp_extract("path", r"[^/]*\z", 0)
    small = read.select(
        "path", name.alias("original_name"), F.col("length").alias("size_bytes"), "content",
        F.lower(F.regexp_extract(name, r"\A.+\.([^.]*)\z", 1)).alias("document_format"))
    if media_types is None:
        typed = small.withColumn("media_type", F.lit(None).cast("string"))
    else:
        typed = small.join(media_types.select("path", "media_type"), "path", "left")
    body = F.col("content")
    is_docx = (
        F.startswith(body, F.lit(b"PK")) & F.contains(body, F.lit(b"[Content_Types].xml")) & F.contains(body, F.lit(b"word/document.xml"))
    )
    fmt = F.col("document_format")
    matches = (fmt == "txt") | ((fmt == "docx") & is_docx) | ((fmt == "pdf") & F.startswith(body, F.lit(b"%PDF-")))
    code = (
        F.when(~matches | ~media_type_allowed(F.col("media_type"), fmt), "UNSUPPORTED_FORMAT")
        .when(fmt == "pdf", "PDF_NOT_SUPPORTED")
    )
    judged = typed.withColumn("error_code", code)
    judged = written(judged.withColumn("content", F.when(F.col("error_code").isNull(), body)), "files-judged")
    rejects = too_large.unionByName(judged.where(F.col("error_code").isNotNull()).select("path", "error_code"))
    return judged.where(F.col("error_code").isNull()).drop("error_code", "media_type"), rejects


def _decode_gb18030(content: Column) -> Column:
    def one(value):
        try:
            return None if value is None else bytes(value).decode("gb18030")
        except UnicodeDecodeError:
            return None

    def decode(batch: pd.Series) -> pd.Series:
        return batch.map(one)

    return F.pandas_udf(decode, "string", F.PandasUDFType.SCALAR)(content)


def clean_lines(text: Column) -> Column:
    """Unix line breaks, without the blank lines at the end; the last written line stays as it is."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(unix, r"(?U)(?<=\S|\A)([^\S\n]*+)\n\s*+\z", "$1")


def decode_txt(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, text) of text files, and rejects: UTF-8 first, the rest strictly as GB18030.

    Only the files that are not UTF-8 travel through Python.
    """
    as_text = F.col("content").cast("string")
    valid = F.is_valid_utf8(as_text)
    legacy = _decode_gb18030(F.when(~valid, F.col("content")))
    decoded = files.select("path", F.when(valid, F.regexp_replace(as_text, "\\A\uFEFF+", "")).otherwise(legacy).alias("text"))
    rejects = decoded.where(F.col("text").isNull()).select("path", F.lit("EXTRACTION_FAILED").alias("error_code"))
    return decoded.where(F.col("text").isNotNull()).select("path", clean_lines(F.col("text")).alias("text")), rejects


def txt_lines(texts: DataFrame) -> DataFrame:
    """Numbered lines of decoded texts."""
    rows = explode_rows(texts, F.split("text", "\n", -1), "at", "line_text", ["doc_id"])
    return rows.select("doc_id", (F.col("at") + 1).alias("line_no"), F.col("line_text").alias("text"),
                       F.lit(None).cast("int").alias("page"), F.lit(False).alias("paragraph_break_after"))


def docx_body(content: bytes) -> bytes:
    """The main part of a DOCX archive; raises ValueError for anything malformed or beyond the limits."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        entries = archive.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_UNZIPPED:
            raise ValueError("archive too large")
        member = archive.getinfo("word/document.xml")
        if member.file_size > MAX_BODY:
            raise ValueError("body too large")
        with archive.open(member) as stream:
            body = stream.read(MAX_BODY + 1)
    except (zipfile.BadZipFile, KeyError, OSError, EOFError, NotImplementedError, RuntimeError) as error:
        raise ValueError("not a readable archive") from error
    if len(body) > MAX_BODY:
        raise ValueError("body too large")
    return body


def _kind(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _below(element: ElementTree.Element, shut: set[str]) -> Iterator[ElementTree.Element]:
    """Elements below one, in document order, without what lies inside the kinds in ``shut``."""
    waiting = list(reversed(element))
    while waiting:
        e = waiting.pop()
        yield e
        if _kind(e) not in shut:
            waiting.extend(reversed(e))


#: What a text element, a tab and a break stand for.
_SHOWS = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n"}


def docx_paragraphs(content: bytes) -> list[str]:
    """Visible paragraphs of a DOCX file in document order, up to the last one that isn't blank.

    A paragraph is a ``p`` element with anything in it; it shows the texts, tabs and breaks of its runs, without deleted
    ones, properties, and paragraphs nested in it, which stand for themselves. Character references and CDATA are text; a
    document type, and with it entities of its own, makes a file malformed. Raises ValueError for malformed files.
    """
    body = docx_body(content)
    if b"<!DOCTYPE" in body:
        raise ValueError("document type in the body")
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError as error:
        raise ValueError("body is not XML") from error
    paragraphs = [p for p in _below(root, {"del"}) if _kind(p) == "p" and len(p)]
    texts = ["".join(_SHOWS[_kind(e)](e) for e in _below(p, {"del", "p", "pPr", "rPr"}) if _kind(e) in _SHOWS) for p in paragraphs]
    while len(texts) > 1 and not texts[-1].strip():
        texts.pop()
    return texts


PARAGRAPHS = "path string, line_no int, text string, paragraph_break_after boolean, error_code string"


def _docx_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("path", pa.string()), ("line_no", pa.int32()), ("text", pa.string()), ("paragraph_break_after", pa.bool_()), ("error_code", pa.string())]
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            try:
                found = docx_paragraphs(content)
                rows += [(path, i + 1, p, i + 1 < len(found), None) for i, p in enumerate(found)]
            except ValueError:
                rows.append((path, 0, None, False, "EXTRACTION_FAILED"))
        columns = list(zip(*rows)) or [()] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def extract_docx(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paragraph rows, rejects) of DOCX files; a paragraph is followed by a blank line, it has no line number."""
    rows = files.where("document_format = 'docx'").select("path", "content").mapInArrow(_docx_rows, PARAGRAPHS)
    rejects = rows.where(F.col("error_code").isNotNull()).select("path", "error_code")
    good = rows.where(F.col("error_code").isNull()).select(
        "path", "line_no", "text", F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("line"), "paragraph_break_after")
    return good, rejects
