"""Small PDF files from lines of text, by which the reader of PDF files is tried."""

from __future__ import annotations

import zlib


def _escaped(text: str) -> bytes:
    return text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def text_page(lines: list[str], left: float = 50, top: float = 740, step: float = 14, size: float = 10) -> bytes:
    """The operators that show lines below each other."""
    if len(said := _escaped("\n".join(lines)).split(b"\n")) != len(lines):  # there are lines with a line's end in them, or none
        said = [_escaped(x) for x in lines]
    shown = b"".join([b"(", b") Tj T*\n(".join(said), b") Tj T*\n"]) if said else b""
    return f"BT /F1 {size} Tf {step} TL {left} {top} Td\n".encode() + shown + b"ET\n"


def grid_page(cells: list[list[str]], left: float = 60, top: float = 700, width: float = 90, height: float = 20) -> bytes:
    """The operators that draw a table with lines around its cells."""
    rows, columns = len(cells), len(cells[0])
    out = [f"{left} {top - r * height} m {left + columns * width} {top - r * height} l S" for r in range(rows + 1)]
    out += [f"{left + c * width} {top} m {left + c * width} {top - rows * height} l S" for c in range(columns + 1)]
    shown = [b"BT /F1 9 Tf %g %g Td (%s) Tj ET" % (left + c * width + 4, top - r * height - 14, _escaped(x)) for r, row in enumerate(cells) for c, x in enumerate(row)]
    return "\n".join(out).encode() + b"\n" + b"\n".join(shown) + b"\n"


def made_pdf(contents: list[bytes], facts: dict[str, str] | None = None, packed: bool = False, broken_table: bool = False, objects: dict[str, bytes] | None = None) -> bytes:
    """A file with a page for each content; ``packed`` deflates contents, ``objects`` (name, whole object) are images to draw."""
    held: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    named = {}
    for name, body in (objects or {}).items():
        held.append(body)
        named[name] = len(held)
    drawn = b" ".join(b"/%s %d 0 R" % (n.encode(), i) for n, i in named.items())
    kids = []
    for content in contents:
        body = zlib.compress(content) if packed else content
        held.append(b"<< /Length %d %s>>\nstream\n" % (len(body), b"/Filter /FlateDecode " if packed else b"") + body + b"\nendstream")
        held.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> /XObject << %s >> >> >>" % (len(held), drawn))
        kids.append(len(held))
    held[1] = b"<< /Type /Pages /MediaBox [0 0 612 792] /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    info = b""
    if facts:
        held.append(b"<< " + b" ".join(b"/%s (%s)" % (k.encode(), _escaped(v)) for k, v in facts.items()) + b" >>")
        info = b"/Info %d 0 R " % len(held)
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(held, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    at = len(out) + (7 if broken_table else 0)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(held) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R %s>>\nstartxref\n%d\n%%%%EOF\n" % (len(held) + 1, info, at))
