"""Text of plain, Word and PowerPoint files as an Arrow-batched function over their bytes.

Each file is read on its own with limits on what it may unpack; one that can't be read gets a
reason and never fails the job.
"""

from __future__ import annotations

import io
import zipfile
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

# Kinds by extension, limits, and the namespaces of the formats.
KINDS = {".txt": "text", ".md": "text", ".csv": "text", ".docx": "docx", ".pptx": "pptx"}
KEPT_CHARS, SNIFF_BYTES = 4000, 64 << 10
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, MAX_SLIDES = 5000, 50 << 20, 100 << 20, 1000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
HIDDEN = frozenset((f"{W}del", f"{W}moveFrom", f"{MC}Fallback"))
TEXT = StructType([StructField("text", StringType()), StructField("chars", IntegerType()), StructField("truncated", BooleanType()), StructField("has_text", BooleanType()), StructField("reason", StringType())])


def kind_of(ext: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.lower(ext))


def decode_text(data: bytes) -> str:
    """By byte-order mark, else UTF-8, else strict Big5, else windows-1252; the head decides."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    head = data[:SNIFF_BYTES]
    cut = len(data) > len(head)
    for name in ("utf-8", "big5"):
        for end in range(len(head), max(-1, len(head) - 4), -1) if cut else (len(head),):
            try:
                head[:end].decode(name)
            except UnicodeDecodeError:
                continue
            return data.decode(name, "replace")
    return data.decode("cp1252", "replace")


def _open(data: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(data))
    entries = archive.infolist()
    if len(entries) > MAX_ENTRIES or sum(x.file_size for x in entries) > MAX_TOTAL:
        raise ValueError("the archive is too large")
    return archive


def _part(archive: zipfile.ZipFile, name: str) -> bytes:
    if archive.getinfo(name).file_size > MAX_ENTRY:
        raise ValueError("a part is too large")
    with archive.open(name) as part:
        data = part.read(MAX_ENTRY + 1)
    if len(data) > MAX_ENTRY:
        raise ValueError("a part is too large")
    return data


def _word(node: ElementTree.Element, out: list[str]) -> None:
    if node.tag in HIDDEN:
        return
    if node.tag == f"{W}r":
        properties = node.find(f"{W}rPr")
        hidden = None if properties is None else properties.find(f"{W}vanish")
        if hidden is not None and hidden.get(f"{W}val") not in ("0", "false", "off"):
            return
    out.append({f"{W}t": node.text or "", f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}.get(node.tag, "") if node.tag != f"{W}tabs" else "")
    if node.tag not in (f"{W}pPr", f"{W}rPr"):
        for child in node:
            _word(child, out)
    if node.tag == f"{W}p":
        out.append("\n")


def docx_text(data: bytes) -> str:
    """Visible runs of the body, one paragraph a line."""
    with _open(data) as archive:
        out: list[str] = []
        _word(ElementTree.fromstring(_part(archive, "word/document.xml")), out)
    return "".join(out).strip()


def pptx_text(data: bytes) -> str:
    """Slides in the order of the presentation, each once, a blank line between them."""
    with _open(data) as archive:
        links = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(_part(archive, "ppt/_rels/presentation.xml.rels"))}
        order = [links.get(x.get(f"{R}id"), "") for x in ElementTree.fromstring(_part(archive, "ppt/presentation.xml")).iter(f"{P}sldId")]
        slides = []
        for target in list(dict.fromkeys(order))[:MAX_SLIDES]:
            name = target.lstrip("/") if target.startswith("/") else str(PurePosixPath("ppt") / target)
            if name not in archive.namelist():
                continue
            lines = ("".join((t.text or "") if t.tag == f"{A}t" else "\n" for t in p.iter() if t.tag in (f"{A}t", f"{A}br")) for p in ElementTree.fromstring(_part(archive, name)).iter(f"{A}p"))
            slides.append("\n".join(x for x in lines if x.strip()))
    return "\n\n".join(x for x in slides if x)


READERS = {"text": decode_text, "docx": docx_text, "pptx": pptx_text}


@F.pandas_udf(TEXT)
def text_of(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    """struct(text, chars, truncated, has_text, reason); the first 4000 characters are kept."""
    rows = []
    for k, data in zip(kind, content, strict=True):
        try:
            if k not in READERS:
                raise ValueError("no reader for this kind")
            text = READERS[k](bytes(data or b""))
            rows.append((text[:KEPT_CHARS], len(text), len(text) > KEPT_CHARS, bool(text.strip()), None))
        except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, EOFError, OSError, RuntimeError, NotImplementedError) as why:
            rows.append((None, None, None, False, f"{type(why).__name__}: {why}"))
    return pd.DataFrame(rows, columns=TEXT.names).astype({"chars": "Int32", "truncated": "boolean"})


def read_texts(files: DataFrame) -> DataFrame:
    """``files(path, ext, content, ...)`` that have a reader, with what it found."""
    kinds = files.withColumn("kind", kind_of(F.col("ext"))).where("kind is not null")
    return kinds.withColumn("read", text_of("kind", "content")).drop("content").select("*", "read.*").drop("read")
