"""DOCX in place: the paragraphs of a document's parts as segments of runs, and the way back into the same bytes.

A file's text segments are ordered body, tables (cell by cell, nested ones too), headers, footers. What runs of a paragraph say is
replaced inside them, so their formatting stays; everything else of the file is copied as it is.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"


def _parts(z: zipfile.ZipFile) -> list[str]:
    names = sorted(z.namelist())
    return ["word/document.xml", *(n for kind in ("header", "footer") for n in names if re.fullmatch(rf"word/{kind}\d*\.xml", n))]


def _paragraphs(part: str, root: ElementTree.Element):
    """(kind, paragraph) of one part: first those outside tables, then those in tables."""
    kind = "header" if "/header" in part else "footer" if "/footer" in part else "body"
    inside = {id(p) for t in root.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    every = list(root.iter(f"{_W}p"))
    yield from ((kind, p) for p in every if id(p) not in inside)
    yield from (("table" if kind == "body" else kind, p) for p in every if id(p) in inside)


def _texts(paragraph: ElementTree.Element) -> list[ElementTree.Element]:
    """The text elements of a paragraph's own runs, in order, those of nested paragraphs (text boxes) not among them."""
    nested = {id(t) for p in paragraph.iter(f"{_W}p") if p is not paragraph for t in p.iter(f"{_W}t")}
    return [t for r in paragraph.iter(f"{_W}r") for t in r.findall(f"{_W}t") if id(t) not in nested]


def _open(content: bytes):
    for _, (prefix, uri) in ((e, x) for n in ("word/document.xml",) for e, x in ElementTree.iterparse(zipfile.ZipFile(io.BytesIO(content)).open(n), ["start-ns"])):
        if not re.fullmatch(r"ns\d+", prefix):
            ElementTree.register_namespace(prefix, uri)
    return zipfile.ZipFile(io.BytesIO(content))


def runs_of(content: bytes) -> list[tuple[int, str, int, str]]:
    """(segment, kind, run, text) of every run with text."""
    out, segment = [], 0
    with _open(content) as z:
        for part in _parts(z):
            for kind, p in _paragraphs(part, ElementTree.fromstring(z.read(part))):
                out += [(segment, kind, k, t.text or "") for k, t in enumerate(_texts(p))]
                segment += 1
    return out


def with_runs(content: bytes, texts: dict[tuple[int, int], str], prompt: str = "") -> bytes:
    """The file with the runs' new texts by (segment, run); runs that aren't named stay. prompt: lines that become paragraphs before
    the body."""
    segment, out = 0, io.BytesIO()
    with _open(content) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        changed = {}
        for part in _parts(z):
            root = ElementTree.fromstring(z.read(part))
            for _, p in _paragraphs(part, root):
                for k, t in enumerate(_texts(p)):
                    if (segment, k) in texts:
                        t.text = texts[segment, k]
                        t.set(_SPACE, "preserve")
                segment += 1
            if part == "word/document.xml" and prompt:
                body = root.find(f"{_W}body")
                for n, line in enumerate(prompt.strip("\n").split("\n")):
                    p = ElementTree.Element(f"{_W}p")
                    t = ElementTree.SubElement(ElementTree.SubElement(p, f"{_W}r"), f"{_W}t")
                    t.text = line
                    t.set(_SPACE, "preserve")
                    body.insert(n, p)
            changed[part] = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
        for item in z.infolist():
            new.writestr(item, changed.get(item.filename, z.read(item.filename)))
    return out.getvalue()
