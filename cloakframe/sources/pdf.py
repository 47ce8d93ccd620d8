"""PDF: text of pages, and pages from text, for files without an outside engine.

Read are pages whose content streams are plain or deflated and whose fonts have a ToUnicode map or a one-byte Latin encoding; a page
that gives less than SCAN characters is taken for a scan. Written are A4 pages of a standard font, whose encoding gets the Latin
letters that the text needs. Other files take an extractor (see files.register_extractor).
"""

from __future__ import annotations

import re
import unicodedata
import zlib

#: Characters below which a page is a scan; A4 in points; font size.
SCAN = 20
WIDTH, HEIGHT, SIZE, MARGIN = 595, 842, 11, 50
LEADING = 15
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]<>()]+|[-+.\d]+|[A-Za-z'\"*]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _objects(content: bytes) -> dict[int, bytes]:
    """Every object's bytes, those of object streams too."""
    found = {int(n): body for n, body in _OBJECT.findall(content)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            data = _data(body)
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = [int(x) for x in data[:first].split()]
            for n, at, end in zip(heads[::2], heads[1::2], [*heads[3::2], len(data) - first]):
                found.setdefault(n, data[first + at : first + end])
    return found


def _data(body: bytes) -> bytes:
    m = _STREAM.search(body)
    raw = m[1] if m else b""
    return zlib.decompressobj().decompress(raw) if b"/FlateDecode" in body[: m.start() if m else 0] else raw


def _refs(value: bytes) -> list[int]:
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", value)]


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """In the order of the page tree."""
    catalogue = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    out, seen = [], set()

    def walk(n):
        body = objects.get(n, b"")
        if n in seen:
            return
        seen.add(n)
        if re.search(rb"/Type\s*/Pages\b", body):
            for k in _refs(m[1]) if (m := re.search(rb"/Kids\s*\[(.*?)\]", body, re.DOTALL)) else ():
                walk(k)
        elif re.search(rb"/Type\s*/Page\b", body):
            out.append(body)

    root = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", catalogue or b"")
    if root is None:
        raise ValueError("no page tree")
    walk(int(root[1]))
    return out


def _map(objects: dict[int, bytes], font: bytes) -> tuple[int, dict[int, str]]:
    """(bytes of a code, characters by code) of a font."""
    to = re.search(rb"/ToUnicode\s+(\d+)", font)
    if to:
        text, out = _data(objects.get(int(to[1]), b"")), {}
        size = len((re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", text) or [b"", b"00"])[1]) // 2
        chars = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.DOTALL):
            out |= {int(a, 16): chars(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.DOTALL):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                base = chars(c)
                out |= {k: base[:-1] + chr(ord(base[-1]) + k - int(a, 16)) for k in range(int(a, 16), int(b, 16) + 1)}
        return size, out
    out = {k: bytes([k]).decode("cp1252", "replace") for k in range(256)}
    named = re.search(rb"/Encoding\s+(\d+)\s+\d+\s+R", font)
    shown = objects.get(int(named[1]), b"") if named else font
    if m := re.search(rb"/Differences\s*\[(.*?)\]", shown, re.DOTALL):
        code = 0
        for x in re.findall(rb"/[^\s/\[\]]+|\d+", m[1]):
            if x.startswith(b"/uni"):
                out[code] = chr(int(x[4:], 16))
            code = int(x) if x.isdigit() else code + 1
    return 1, out


def _literal(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1].strip(b"\r\n"))
    return re.sub(rb"\\([0-7]{1,3}|.|\r?\n)", one, token[1:-1], flags=re.DOTALL)


def _shown(stream: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """The text that a content stream shows; a move to another line is a line feed, a wide gap in an array a space."""
    out, stack, font = [], [], (1, {k: bytes([k]).decode("cp1252", "replace") for k in range(256)})

    def text(token):
        raw, (size, chars) = _literal(token), font
        return "".join(chars.get(int.from_bytes(raw[k : k + size], "big"), "") for k in range(0, len(raw), size))

    for token in _TOKEN.findall(stream):
        if not token[:1].isalpha() and token not in (b"'", b'"'):
            stack.append(token)
            continue
        if token == b"Tf" and len(stack) >= 2:
            font = fonts.get(stack[-2][1:], font)
        elif token in (b"Tj", b"'", b'"') and stack:
            out.append(("\n" if token != b"Tj" else "") + text(stack[-1]))
        elif token == b"TJ":
            for t in stack:
                if t[:1] in (b"(", b"<"):
                    out.append(text(t))
                elif re.fullmatch(rb"-\d+(\.\d+)?", t) and float(t) < -200:
                    out.append(" ")
        elif token in (b"T*", b"ET") or token in (b"Td", b"TD") and len(stack) >= 2 and float(stack[-1]) != 0:
            out.append("\n")
        stack = []
    return re.sub(r"\n+", "\n", "".join(out)).strip("\n")


def pages_of(content: bytes) -> list[tuple[int, str, bool]]:
    """(page from 0, text, whether it is taken for a scan)."""
    if b"/Encrypt" in content[-2048:]:
        raise ValueError("the file is encrypted")
    objects, out = _objects(content), []
    for n, page in enumerate(_pages(objects)):
        resources = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page)
        held = objects.get(int(resources[1]), b"") if resources else page
        if m := re.search(rb"/Font\s+(\d+)\s+\d+\s+R", held):
            held = objects.get(int(m[1]), b"")
        fonts = {name: _map(objects, objects[int(k)]) for name, k in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", held) if b"/Font" in objects.get(int(k), b"")}
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.DOTALL)
        text = _shown(b"\n".join(_data(objects.get(k, b"")) for k in _refs(m[1])) if m else b"", fonts)
        out.append((n, text, len(text.strip()) < SCAN))
    return out


def wrapped(line: str, width: int) -> list[str]:
    """A line as pieces of at most width characters, cut at spaces; a longer word stays whole."""
    out = []
    for word in line.split(" "):
        if out and len(out[-1]) + 1 + len(word) <= width:
            out[-1] += " " + word
        else:
            out.append(word)
    return out


def pdf_bytes(text: str) -> bytes:
    """A4 pages of a text; each character beyond ASCII gets a code of the font's own (at most 127 kinds, the rest become '?')."""
    text = unicodedata.normalize("NFC", text)
    extra = {c: 128 + k for k, c in enumerate(sorted({c for c in text if ord(c) > 126})[:127])}
    lines = [piece for line in text.split("\n") for piece in wrapped(line, (WIDTH - 2 * MARGIN) * 2 // SIZE)]
    per = (HEIGHT - 2 * MARGIN) // LEADING

    def shown(line):
        codes = bytes(extra.get(c, 63) if ord(c) > 126 else max(32, ord(c)) for c in line)
        return b"(" + re.sub(rb"([\\()])", rb"\\\1", codes) + b") Tj T*"

    glyphs = " ".join(f"{code} /uni{ord(c):04X}" for c, code in extra.items() if ord(c) < 65536)
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Type /Encoding /BaseEncoding /WinAnsiEncoding /Differences [" + glyphs.encode() + b"] >> >>"]
    kids = []
    for k in range(0, max(1, len(lines)), per):
        data = zlib.compress(b"BT /F1 %d Tf %d TL %d %d Td\n" % (SIZE, LEADING, MARGIN, HEIGHT - MARGIN) + b"\n".join(map(shown, lines[k : k + per])) + b"\nET")
        bodies.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream")
        kids.append(len(bodies) + 1)
        bodies.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (WIDTH, HEIGHT, len(bodies)))
    bodies[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, at = [b"%PDF-1.4\n"], []
    for n, body in enumerate(bodies, 1):
        at.append(sum(map(len, out)))
        out.append(b"%d 0 obj\n%s\nendobj\n" % (n, body))
    start = sum(map(len, out))
    out.append(b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at))
    out.append(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, start))
    return b"".join(out)
