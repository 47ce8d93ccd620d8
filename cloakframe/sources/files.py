"""Readers of document files, and writers. Binary containers need only the standard library here; formats that need an outside
engine (PDF, images) take an extractor, and without one they fail by name."""

from __future__ import annotations

import io
import re
import shutil
import uuid
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rewrite import rtf_escaped
from . import pdf

PLUGGED: dict[str, Callable[[bytes], str]] = {}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def register_extractor(suffix: str, extract: Callable[[bytes], str]) -> None:
    """For formats such as pdf or png: bytes to text. Sent to the executors with each read."""
    PLUGGED[suffix.lower().lstrip(".")] = extract


def docx_text(content: bytes) -> str:
    """The body's own paragraphs, a line each; tables, headers and footers are not part of the flat text."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    inline = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
    return "\n".join("".join(inline[e.tag](e) for e in p.iter() if e.tag in inline) for p in body.findall(f"{_W}p"))


def odt_text(content: bytes) -> str:
    """Each paragraph's text and that of its direct children."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("content.xml"))
    one = lambda p: (p.text or "") + "".join((c.text or "") + "".join(g.tail or "" for g in c) + (c.tail or "") for c in p)
    return "\n".join(one(p) for p in root.iter(f"{_T}p"))


_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)", re.IGNORECASE)
_SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "generator"}


def rtf_text(content: bytes) -> str:
    """Text without control words; hidden groups are skipped, code points and code page bytes decoded."""
    out, stack, silent, skip = [], [], False, 0
    for word, number, byte, symbol, brace, plain in _RTF.findall(content.decode("utf-8", "replace")):
        if brace == "{":
            stack.append(silent)
        elif brace == "}":
            silent = stack.pop() if stack else False
        elif word in _SILENT or symbol == "*":
            silent = True
        elif silent:
            continue
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 0x110000))
            skip = 1
        elif byte:
            if not skip:
                out.append(bytes.fromhex(byte).decode("cp1250", "replace"))
            skip = 0
        elif symbol in ("\\", "{", "}"):
            out.append(symbol)
        elif plain:
            out.append(plain[skip:])
            skip = 0
    return "".join(out)


def pdf_text(content: bytes) -> str:
    """The pages' texts, a line feed between; a page taken for a scan gives what it has."""
    return "\n".join(text for _, text, _ in pdf.pages_of(content))


READERS = {"txt": lambda b: b.decode("utf-8", "replace"), "docx": docx_text, "odt": odt_text, "rtf": rtf_text, "pdf": pdf_text}
#: Formats that need an outside engine, and its command.
ENGINES = {"png": "tesseract", "jpg": "tesseract", "jpeg": "tesseract", "tif": "tesseract", "tiff": "tesseract"}


def readable() -> dict[str, bool]:
    """Which formats can be read here: those of this module, those plugged in, and whether the others' engine is installed."""
    return {**{k: shutil.which(v) is not None for k, v in ENGINES.items()}, **dict.fromkeys([*READERS, *PLUGGED], True)}


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, suffix, text, error) of every file. An unknown format or a broken file has a null text and its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path)
    readers = {**READERS, **PLUGGED}

    def extract(batches):
        for pdf in batches:
            text, error = [], []
            for suffix, content in zip(pdf["suffix"], pdf["content"]):
                try:
                    if suffix not in readers:
                        raise ValueError(f"unknown format {suffix!r}: no extractor is registered")
                    text.append(readers[suffix](bytes(content)))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  a file's own fault is its row's
                    text.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf["path"], "suffix": pdf["suffix"], "text": text, "error": error})

    return files.select("path", suffix_of(F.col("path")).alias("suffix"), "content").mapInPandas(extract, "path string, suffix string, text string, error string")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text, scan, error) of the pages of every PDF; scan: too little text, the page needs recognition."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)

    def extract(batches):
        for pdf_ in batches:
            rows = []
            for name, content in zip(pdf_["path"], pdf_["content"]):
                try:
                    rows += [(name, n, text, scan, None) for n, text, scan in pdf.pages_of(bytes(content))]
                except Exception as e:  # noqa: BLE001  a file's own fault is its row's
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["path", "page", "text", "scan", "error"])
            yield out.astype({"page": "Int32", "scan": "boolean"})

    return files.select("path", "content").mapInPandas(extract, "path string, page int, text string, scan boolean, error string")


def dictionary(spark: SparkSession, path: str, kind: str, lang: str) -> DataFrame:
    """(kind, lang, entry) of a list with a line each: trimmed, in lower case, without blanks and repeats."""
    e = spark.read.text(path).select(F.lit(kind).alias("kind"), F.lit(lang).alias("lang"), F.lower(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).alias("entry"))
    return e.where("entry <> ''").distinct()


def output_name(path: Column, ending: str = "_anon", suffix: str | None = None) -> Column:
    """<stem><ending><suffix>, by default with the file's own suffix."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    own = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(ending), F.lit(suffix) if suffix else own)


def rtf_document(text: Column) -> Column:
    return F.concat(F.lit("{\\rtf1\\ansi\\deff0{\\fonttbl{\\f0 Arial;}}\\f0\\fs22 "), rtf_escaped(text), F.lit("}"))


def docx_bytes(text: str) -> bytes:
    """A paragraph for each line."""
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def odt_bytes(text: str) -> bytes:
    from xml.sax.saxutils import escape

    body = "".join(f"<text:p>{escape(line)}</text:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.text")
        z.writestr("META-INF/manifest.xml", '<?xml version="1.0"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="application/vnd.oasis.opendocument.text"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>')
        z.writestr("content.xml", f'<?xml version="1.0"?><office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="{_T[1:-1]}" office:version="1.2"><office:body><office:text>{body}</office:text></office:body></office:document-content>')
    return out.getvalue()


def rtf_bytes(text: str) -> bytes:
    one = lambda c: "\\" + c if c in "\\{}" else f"\\u{ord(c)}?" if ord(c) > 127 else c
    body = "\\par\n".join("".join(map(one, line)) for line in text.split("\n"))
    return ("{\\rtf1\\ansi\\deff0{\\fonttbl{\\f0 Arial;}}\\f0\\fs22 " + body + "}").encode("ascii")


WRITERS = {"txt": str.encode, "docx": docx_bytes, "odt": odt_bytes, "rtf": rtf_bytes, "pdf": pdf.pdf_bytes}


def encoded(texts: DataFrame) -> DataFrame:
    """(name, content, error) of texts (name, text): bytes in the format of the name's suffix. An unknown format has an error, as has a
    null text."""

    def run(batches):
        for rows in batches:
            content, error = [], []
            for name, text in zip(rows["name"], rows["text"]):
                suffix = name.rpartition(".")[2].lower()
                try:
                    if suffix not in WRITERS:
                        raise ValueError(f"unknown format {suffix!r}: there is no writer")
                    if text is None:
                        raise ValueError("there is no text")
                    content.append(WRITERS[suffix](text))
                    error.append(None)
                except Exception as e:  # noqa: BLE001
                    content.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"name": rows["name"], "content": content, "error": error})

    return texts.select("name", "text").mapInPandas(run, "name string, content binary, error string")


def write_bytes(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each row's content (name, content, error) to folder/name and gives (name, bytes, error) back, one pass over rows.

    A file is written beside its name and moved there when it is whole, so a task that runs again leaves no part of one. Rows with an
    error are passed on.
    """

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        store.create_dir(root, recursive=True)
        for part in batches:
            sizes = []
            for name, content, error in zip(part["name"], part["content"], part["error"]):
                if error is not None:
                    sizes.append(None)
                    continue
                own = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(bytes(content))
                store.move(own, f"{root}/{name}")
                sizes.append(len(content))
            yield pd.DataFrame({"name": part["name"], "bytes": pd.array(sizes, "Int64"), "error": part["error"]})

    return rows.select("name", "content", "error").mapInPandas(run, "name string, bytes long, error string")
