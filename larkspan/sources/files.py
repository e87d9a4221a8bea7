"""File inventories and the text of binary documents."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote
from xml.sax.saxutils import unescape

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions import names, texts
from larkspan.session import settle

# Parts of a word-processing archive, in the order they are tried.
MAIN_PART = "word/document.xml"
TEXT_PARTS = [MAIN_PART, "word/document2.xml", "word/header1.xml", "word/footer1.xml"]
RUN = re.compile(r"<w:t[^>]*>(.*?)</w:t>", re.DOTALL)
# What a task holds of a file that it digests.
PIECE_BYTES = 8 << 20
# Text of archives that a task holds before it is handed on.
ARCHIVE_BYTES = 4 << 20
PARAGRAPH = re.compile(r"<w:p[ >].*?</w:p>", re.DOTALL)


def inventory(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """A5. Path, name, size and time of files, empty ones included. No content is read."""
    found = _binary(spark, path, recursive, glob).select(
        "path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime")
    )
    return found.unionByName(empty_files(spark, path, recursive, glob)).select(
        "path", names.basename(F.col("path")).alias("name"), "size", "mtime"
    )


def empty_files(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """A5. Path, size 0 and time of the empty files, which Spark's file sources leave out.

    ``path`` is a folder, a file or a pattern of either. Folders are listed in tasks, one level of the tree at a time; as in Spark, names that begin with a dot or an
    underscore are hidden. The store must be one that pyarrow reaches.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    matched = store.globStatus(root) or []
    roots = [(s.getPath().toString(),) for s in matched if s.isDirectory()]
    wanted = F.lit(True) if glob is None else names.basename(F.col("path")).rlike(fnmatch.translate(glob))
    empty = [(s.getPath().toString(), 0, s.getModificationTime() / 1e3) for s in matched if s.isFile() and s.getLen() == 0]
    empty = [row for row in empty if row[0].rsplit("/", 1)[-1][0] not in "._"]
    found = spark.createDataFrame(empty, "path string, size long, mtime double").where(wanted)
    folders = spark.createDataFrame(roots, "path string")
    while roots:
        listed = settle(folders.repartition("path").mapInPandas(_listed, "path string, folder boolean, size long, mtime double"))
        found = found.unionByName(listed.where(~F.col("folder") & (F.col("size") == 0) & wanted).select("path", "size", "mtime"))
        folders = listed.where("folder").select("path")
        if not recursive or folders.isEmpty():
            break
    return found


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of each folder."""
    for batch in batches:
        for folder in batch["path"]:
            store, place = _opened(folder)
            rows = [
                (f"{folder.rstrip('/')}/{i.base_name}", i.type == fs.FileType.Directory, i.size or 0, i.mtime_ns / 1e9 if i.mtime_ns else None)
                for i in store.get_file_info(fs.FileSelector(place))
                if i.base_name[0] not in "._"
            ]
            yield pd.DataFrame(rows, columns=["path", "folder", "size", "mtime"])


def _opened(folder_or_file: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Hadoop writes it, and the place in it."""
    # Hadoop writes a local path as file:/a and leaves blanks as they are, pyarrow wants file:///a and %20.
    return fs.FileSystem.from_uri(quote(re.sub(r"^([a-z0-9]+):/(?!/)", r"\1:///", folder_or_file), safe="/:@"))


def digests(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None, piece: int = PIECE_BYTES) -> DataFrame:
    """B20, A5. Path, name, size and MD5, SHA-256 and CRC-32 of files of any size, empty ones included.

    Tasks open the files of an inventory and digest them piece by piece as they read, so a file needs no more
    memory than a piece and may be larger than a row can be. The store must be one that pyarrow reaches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_digest(place, piece) for place in batch["path"]]
            yield batch.assign(**pd.DataFrame(rows, columns=["md5", "sha256", "crc32"]).to_dict("list"))

    found = inventory(spark, path, recursive, glob).select("path", "name", "size")
    # Files of one task would else be those of a part of the listing.
    spread = found.repartition("path")
    return spread.mapInPandas(run, "path string, name string, size long, md5 string, sha256 string, crc32 long")


def _digest(place: str, piece: int) -> tuple[str, str, int]:
    store, inner = _opened(place)
    md5, sha256, crc = hashlib.md5(usedforsecurity=False), hashlib.sha256(), 0
    # Without a buffer of its own the stream reads just what is asked for.
    with store.open_input_stream(inner, compression=None, buffer_size=0) as stream:
        while data := stream.read(piece):
            md5.update(data)
            sha256.update(data)
            crc = zlib.crc32(data, crc)
    return md5.hexdigest(), sha256.hexdigest(), crc


def contents(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Files with their bytes, for hashing, typing and extraction."""
    return _binary(spark, path, recursive, glob).select(
        "path", names.basename(F.col("path")).alias("name"), F.col("length").alias("size"), "content"
    )


def _binary(spark: SparkSession, path: str, recursive: bool, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def _archive_text(content: bytes) -> tuple[bool, str | None, str | None, str | None]:
    """(holds the main part, text by runs, text by paragraphs, error) of one archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            listing = archive.namelist()
            is_document = any(MAIN_PART in name for name in listing)

            def part(name: str) -> str:
                try:
                    return archive.read(name).decode("utf-8", errors="replace")
                except (KeyError, zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError, EOFError):
                    return ""

            found = [xml for xml in map(part, TEXT_PARTS) if "<w:t" in xml]
            if not found:
                found = [xml for name in listing if name.endswith(".xml") and "<w:t" in (xml := part(name))]
            if not found:
                return is_document, None, None, "no text in the archive"
            paragraphs = [unescape("".join(RUN.findall(p))) for p in PARAGRAPH.findall(part(MAIN_PART))]
            by_paragraph = "\n".join(p for p in paragraphs if p.strip())
            return is_document, "\n".join(" ".join(RUN.findall(xml)) for xml in found), by_paragraph, None
    except (zipfile.BadZipFile, OSError, ValueError) as error:
        return False, None, None, f"damaged archive: {error}"


ARCHIVE = T.StructType(
    [
        T.StructField("is_document", T.BooleanType()),
        T.StructField("run_text", T.StringType()),
        T.StructField("paragraph_text", T.StringType()),
        T.StructField("zip_error", T.StringType()),
    ]
)


def archive_texts(batches: Iterator[pd.Series], limit: int = ARCHIVE_BYTES) -> Iterator[pd.DataFrame]:
    """Text of archives in frames of some ``limit`` bytes of text, however many rows a batch has."""
    for batch in batches:
        rows, held = [], 0
        for data in batch:
            rows.append((None, None, None, None) if data is None else _archive_text(data))
            held += sum(len(text) for text in rows[-1][1:] if text)
            if held >= limit:
                yield pd.DataFrame(rows, columns=ARCHIVE.names, dtype=object)
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=ARCHIVE.names, dtype=object)


@F.pandas_udf(ARCHIVE)
def open_archive(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """B31. Text of the zip archives; NULL stays NULL."""
    return archive_texts(content)


def documents(files: DataFrame) -> DataFrame:
    """B19, B31, B32. Format, text, method and errors of each file in ``contents``, read once.

    Only zip archives are sent to Python; everything else is typed and cleaned in Spark. The chain is:
    text runs of the archive, its paragraphs, RTF clean-up. Old binary .doc files have no built-in
    method and end with an error.
    """
    signature = F.col("signature")
    # Bytes that are no UTF-8 are dropped, as a lenient text reader does.
    rtf_source = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    no_method = F.when(~signature.isin("zip", "rtf"), F.concat(F.lit("no method for "), signature))
    opened = (
        files.withColumn("signature", texts.signature_format(F.col("content")))
        .withColumn("archive", open_archive(F.when(signature == "zip", F.col("content"))))
        .withColumn("rtf_text", F.when(signature == "rtf", texts.rtf_to_text(rtf_source)))
    )
    chain = [
        ("runs", F.col("archive.run_text"), F.col("archive.zip_error")),
        ("paragraphs", F.col("archive.paragraph_text"), F.col("archive.zip_error")),
        ("rtf", F.col("rtf_text"), no_method),
    ]
    kind = F.when(signature != "zip", signature).otherwise(
        F.when(F.col("archive.is_document"), "docx").otherwise("unknown")
    )
    return opened.select("path", "name", kind.alias("format"), texts.first_success(chain).alias("outcome")).select(
        "path", "name", "format", "outcome.*"
    )
