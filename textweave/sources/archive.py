"""Documents from files and ZIP archives."""

from __future__ import annotations

import io
import os
import posixpath
import re
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.functions.text import decode_text, extension, utf8_prefix

SUPPORTED = (".txt", ".doc", ".docx")
MAX_FILES, MAX_BYTES = 20_000, 10 << 30
ENTRIES = "archive string, path string, data binary"
_RELATIVE = re.compile(r"[^/\\\0][^\\\0]*")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def safe_entry_name(name: str) -> bool:
    """Relative, without NUL or backslash, and inside the target once "." and ".." are resolved."""
    return bool(_RELATIVE.fullmatch(name)) and not (posixpath.normpath(name) + "/").startswith("../")


def entries(data: bytes, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> Iterator[tuple[str, bytes]]:
    """Files of one archive; an unsafe name or a limit passed refuses all of it. Sizes are those read, not those declared."""
    total = 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if len(infos) > max_files:
            raise ValueError(f"more than {max_files} entries")
        if bad := next((i.filename for i in infos if not safe_entry_name(i.orig_filename)), None):
            raise ValueError(f"unsafe entry name: {bad!r}")
        for info in infos:
            if not info.is_dir():
                with z.open(info) as f:
                    content = f.read(max_bytes - total + 1)
                total += len(content)
                if total > max_bytes:
                    raise ValueError(f"more than {max_bytes} bytes unpacked")
                yield posixpath.normpath(info.filename), content


def read_zips(spark: SparkSession, path: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(archive, path, data) of every file in the archives at ``path``; archives are unpacked in parallel."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"], strict=True):
                for name, content in entries(bytes(data), max_files, max_bytes):
                    yield pd.DataFrame({"archive": [archive], "path": [name], "data": [content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, ENTRIES)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.lit("").alias("archive"), "path", F.col("content").alias("data"))


def docx_text(data: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))


def converted(data: bytes, command: Sequence[str], seconds: float = 120.0) -> str | None:
    """The text that an outside converter makes of a document, or None. {input}, {folder} and {output} in ``command`` stand for the document, its folder, and the text file to be made there."""
    with tempfile.TemporaryDirectory() as folder:
        paths = {"input": f"{folder}/document.doc", "folder": folder, "output": f"{folder}/document.txt"}
        with open(paths["input"], "wb") as f:
            f.write(data)
        try:
            subprocess.run([x.format(**paths) for x in command], check=True, timeout=seconds, capture_output=True)
        except (OSError, subprocess.SubprocessError):
            return None
        if not os.path.exists(paths["output"]):
            return None
        with open(paths["output"], "rb") as f:
            return f.read().decode("utf-8-sig", "replace")


def _is(kind: str) -> Column:
    return extension(F.col("path")) == kind


def extract(files: DataFrame, converter: Sequence[str] | None = None) -> DataFrame:
    """Files of supported kinds with ``text``, ``preview`` (240 bytes of it) and ``skipped``, the reason if there is no text.

    .txt is decoded as UTF-8 or else Windows-1251, .docx is read from its XML. .doc needs an outside
    ``converter``, a command as ``converted`` takes it, there on every executor; without one, or if it
    fails, such files are skipped and said so.
    """

    @F.pandas_udf("string")
    def from_docx(data: pd.Series) -> pd.Series:
        return data.map(lambda x: docx_text(bytes(x)))

    @F.pandas_udf("string")
    def from_doc(data: pd.Series) -> pd.Series:
        return data.map(lambda x: converted(bytes(x), converter) if len(x) else None)

    def of(kind: str) -> Column:
        return F.when(_is(kind), F.col("data")).otherwise(F.lit(b""))

    kept = files.filter(extension(F.col("path")).isin(*SUPPORTED))
    text = F.when(_is(".txt"), decode_text(F.col("data"))).when(_is(".docx"), from_docx(of(".docx")))
    text = text.when(_is(".doc"), from_doc(of(".doc"))) if converter else text
    out = kept.withColumn("text", text).withColumn("skipped", F.when(F.col("text").isNull(), "convert_failed_no_txt"))
    return out.withColumn("preview", utf8_prefix(F.coalesce("text", F.lit("")), 240)).drop("data")
