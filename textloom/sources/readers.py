"""Files as documents (doc_id, text, url, metadata). Schemas are given, never inferred; the file's format is told by its suffix."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DOCUMENT

SUFFIXES = {".txt": "text", ".md": "text", ".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".html": "html", ".htm": "html", ".pdf": "pdf"}
FORMATS = tuple(dict.fromkeys(SUFFIXES.values()))


class LoaderError(Exception):
    pass


def _fs_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return fs.exists(p)


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCUMENT)


def _reader(spark, glob: str | None, recursive: bool):
    r = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return r.option("pathGlobFilter", glob) if glob else r


def _decoded(name: str) -> Column:
    """A file's name or path as it was given; Spark has it as in a url."""
    return F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _stem():
    return F.regexp_replace(_decoded("_metadata.file_name"), r"\.[^.]*$", "")


def _placed(df: DataFrame, place: bool) -> DataFrame:
    """With the file's path in ``_path`` if ``place``; where a document has no url of its own its url is that."""
    return df.withColumn("_path", F.col("url")) if place else df


def _valid(df: DataFrame, drop: bool = True, place: bool = False) -> DataFrame:
    """Casts and defaults of a document; rows without the required fields drop."""
    d = df.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()) if drop else df
    return d.select(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), *([_decoded("_metadata.file_path").alias("_path")] if place else []))


def read_jsonl(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = "*.jsonl", place: bool = False) -> DataFrame:
    """JSON lines. A line that can't be read, or has no doc_id or text, drops; the rest of its file stays."""
    return _valid(_reader(spark, glob, recursive).schema(DOCUMENT).option("mode", "DROPMALFORMED").json(path), place=place)


def read_json(spark: SparkSession, path: str, strict: bool = True, recursive: bool = False, glob: str | None = None, place: bool = False) -> DataFrame:
    """Files of one object or an array of objects. strict: a file that can't be read, or an object without a required field,
    is an error when it's read; else it drops."""
    schema = T.StructType([*DOCUMENT.fields, T.StructField("_bad", T.StringType())])
    r = _reader(spark, glob, recursive).schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    d = r.json(path)
    if strict:
        bad = F.col("_bad").isNotNull() | F.col("doc_id").isNull() | F.col("text").isNull() | F.col("url").isNull()
        d = d.withColumn("doc_id", F.when(bad, F.raise_error(F.concat(F.lit("not a document: "), F.col("_metadata.file_path"))).cast("string")).otherwise(F.col("doc_id")))
    else:
        d = d.where("_bad is null")
    return _valid(d, not strict, place)


def read_text(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None, place: bool = False) -> DataFrame:
    """A document a file (.txt, .md): id is the file's stem, url its path."""
    d = _reader(spark, glob, recursive).text(path, wholetext=True)
    return _placed(d.select(_stem().alias("doc_id"), F.col("value").alias("text"), _decoded("_metadata.file_path").alias("url"), F.create_map().cast("map<string,string>").alias("metadata")), place)


def read_html(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None, place: bool = False) -> DataFrame:
    """A document a page: its text without tags, scripts and styles."""
    d = read_text(spark, path, recursive, glob, place)
    bare = F.regexp_replace(F.col("text"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    title = F.regexp_extract("text", r"(?is)<title[^>]*>(.*?)</title>", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", "\n"), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")
    return d.withColumn("metadata", F.create_map(F.lit("title"), F.trim(title))).withColumn("text", bare)


#: Most columns of a CSV file.
MOST_COLUMNS = 20_000


def read_csv(spark: SparkSession, path: str, sep: str = ",", recursive: bool = False, glob: str | None = None, place: bool = False) -> DataFrame:
    """A document a row, named stem_r{row} by its number in its file: its text has a line ``column: value`` for each column of the
    file's own header, and for values beyond it a line with the column's number. A file is read by one task, as a stream, since
    quoted values may have line ends; how many columns the widest line can have is counted beforehand."""
    lines = _reader(spark, glob, recursive).text(path)
    width = lines.agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(sep), F.lit(""))))).first()[0]
    if width is None:
        return _placed(empty(spark), place)
    names = [f"c{i}" for i in range(min(width + 1, MOST_COLUMNS))]
    r = _reader(spark, glob, recursive).option("sep", sep).option("multiLine", "true").option("escape", '"').option("maxColumns", len(names) + 1)
    d = r.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    d = d.select(F.array(*names).alias("row"), _stem().alias("stem"), _decoded("_metadata.file_path").alias("path"))

    def documents(batches):
        at, header, n = None, [], 0
        for b in batches:
            out = []
            for row, stem, url in zip(b["row"], b["stem"], b["path"]):
                last = next((i for i in range(len(row), 0, -1) if row[i - 1] is not None), 0)
                row = ["" if x is None else x for x in row[:last]]
                if url != at:
                    at, header, n = url, [x.lstrip("\ufeff") for x in row], 0
                    continue
                row += [""] * (len(header) - len(row))
                text = "\n".join(f"{header[i] if i < len(header) else i + 1}: {x}" for i, x in enumerate(row))
                out.append((f"{stem}_r{n}", text, url, {}))
                n += 1
            yield pd.DataFrame(out, columns=DOCUMENT.names)

    return _placed(d.mapInPandas(documents, DOCUMENT), place)


def read_pdf(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None, place: bool = False) -> DataFrame:
    """A document a page, named stem_p{page}. Needs the optional library pypdf on the executors."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise LoaderError("reading .pdf needs pypdf, which isn't installed") from e

    def pages(batches):
        import io

        from pypdf import PdfReader

        for b in batches:
            for stem, url, content in zip(b["stem"], b["url"], b["content"]):
                rows = [(f"{stem}_p{i}", p.extract_text() or "", url, {}) for i, p in enumerate(PdfReader(io.BytesIO(content)).pages)]
                yield pd.DataFrame(rows, columns=DOCUMENT.names)

    d = _reader(spark, glob, recursive).format("binaryFile").load(path).select(_stem().alias("stem"), F.col("path").alias("url"), "content")
    return _placed(d.mapInPandas(pages, DOCUMENT), place)


READERS = {"text": read_text, "csv": read_csv, "tsv": lambda s, p, **k: read_csv(s, p, sep="\t", **k), "json": lambda s, p, **k: read_json(s, p, strict=False, **k), "jsonl": read_jsonl, "html": read_html, "pdf": read_pdf}


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """One file, by its suffix."""
    if not exists(spark, path):
        raise LoaderError(f"there is no {path}")
    suffix = "." + path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in SUFFIXES:
        raise LoaderError(f"files of type {suffix!r} aren't supported")
    if suffix == ".json":
        return read_json(spark, path)
    return READERS[SUFFIXES[suffix]](spark, path, glob=None) if suffix == ".jsonl" else READERS[SUFFIXES[suffix]](spark, path)


def _path_pattern(pattern: str, recursive: bool) -> str:
    """A regular expression for what follows the directory in a file's path. ``**`` stands for any directories; with ``recursive``
    the pattern may begin in any of them."""
    out, i = ("(?:.*/)?" if recursive else ""), 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            to = pattern.index("]", i + 2)
            out, i = out + "[" + pattern[i + 1 : to].replace("!", "^", 1).replace("\\", "\\\\") + "]", to + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i])), i + 1
    return out + "$"


def load_directory(spark: SparkSession, path: str, pattern: str = "*", format: str | None = None, recursive: bool = True, ordered: bool = False) -> DataFrame:
    """All files of a directory that match the pattern, which may have directories (``sub/*.txt``, ``**/*.md``); of one format, or each
    by its suffix. ``ordered``: in order of the files' paths, rows in order of their place; that sorts the texts, so it isn't the
    default. Files of other types are left out, .pdf files without pypdf with a warning of their number; no match gives no
    rows."""
    if not is_directory(spark, path):
        raise LoaderError(f"{path} is no directory")
    if format is not None and format not in FORMATS:
        raise LoaderError(f"format {format!r} isn't one of {', '.join(FORMATS)}")
    pattern = pattern.removeprefix("./")
    glob = pattern.rsplit("/", 1)[-1]
    deep = recursive or "/" in pattern
    out = _placed(empty(spark), True)
    for suffix in [None] if format is not None else _suffixes(spark, path, deep):
        # Spark's own filter is on the file's name, with {a,b} for a choice.
        names = glob if suffix is None or glob.endswith(suffix) else f"{glob}{suffix}" if glob.endswith("*") else None
        if names and suffix == ".pdf" and not _has_pdf():
            if n := _reader(spark, names, deep).format("binaryFile").load(path).select("path").count():
                warnings.warn(f"{n} .pdf files of {path} are skipped: reading them needs pypdf, which isn't installed", stacklevel=2)
        elif names:
            out = out.unionByName(READERS[format or SUFFIXES[suffix]](spark, path, recursive=deep, glob=names, place=True))
    if "/" in pattern:
        fs, p = _fs_path(spark, path)
        base = fs.makeQualified(p).toUri().getPath().rstrip("/")
        at = F.regexp_replace("_path", r"^[a-z0-9]+:(//[^/]*)?/*", "/")
        out = out.where(at.rlike("^" + re.escape(base) + "/" + _path_pattern(pattern, recursive)))
    if ordered:
        out = out.withColumn("_row", F.monotonically_increasing_id()).orderBy("_path", "_row")
    return out.select(*DOCUMENT.names)


def _suffixes(spark, path: str, recursive: bool) -> list[str]:
    """The suffixes that occur, by one listing."""
    fs, p = _fs_path(spark, path)
    files, found = fs.listFiles(p, recursive), set()
    while files.hasNext() and len(found) < len(SUFFIXES):
        name = files.next().getPath().getName()
        found |= {x for x in SUFFIXES if name.endswith(x)}
    return [x for x in SUFFIXES if x in found]


def _has_pdf() -> bool:
    import importlib.util

    return importlib.util.find_spec("pypdf") is not None


def from_rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Documents from dictionaries; the first that lacks a field is named in the error."""
    out = []
    for i, r in enumerate(rows):
        missing = [k for k in ("doc_id", "text", "url") if k not in r]
        if missing:
            raise LoaderError(f"row {i} has no {', '.join(missing)}")
        out.append((str(r["doc_id"]), str(r["text"]), str(r["url"]), {k: str(v) for k, v in (r.get("metadata") or {}).items()}))
    return spark.createDataFrame(out, DOCUMENT)


def from_external(df: DataFrame) -> DataFrame:
    """Rows (text, metadata) of another loader as documents: id is the stem of metadata.source and ``_p{page}`` if there is a
    page, else a hash; url is metadata.url or the source; source and url leave the metadata."""
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    stem = F.regexp_replace(F.regexp_extract(m("source"), r"([^/]*)$", 1), r"\.[^.]*$", "")
    base = F.when(F.coalesce(stem, F.lit("")) != "", stem).otherwise(F.substring(F.sha2("text", 256), 1, 16))
    doc_id = F.concat(base, F.coalesce(F.concat(F.lit("_p"), m("page")), F.lit("")))
    url = F.coalesce(m("url"), m("source"), F.lit(""))
    return df.select(doc_id.alias("doc_id"), "text", url.alias("url"), F.map_filter("metadata", lambda k, v: ~k.isin("source", "url")).alias("metadata"))


def load_or(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    """JSON lines and other files of a directory together, ids not made unique; the fallback if there are none."""
    if not is_directory(spark, path):
        return fallback
    found = load_directory(spark, path)
    return found if found.head(1) else fallback


def by_id(docs: DataFrame, doc_id: str) -> DataFrame:
    """The row of one document; no row if there's none. The filter reaches the scan."""
    return docs.where(F.col("doc_id") == doc_id)
