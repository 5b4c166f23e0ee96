"""Small office files made from rows, as inputs of round-trip queries and tests. Not a general writer."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

from leafpress.sources.office import number_to_letters

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def relations(targets: list[str]) -> str:
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"<Relationship Id={quoteattr(f'rId{k}')} Target={quoteattr(t)}/>" for k, t in enumerate(targets, 1))}</Relationships>'


def xlsx(sheets: list[tuple[str, list[list], list[str]]]) -> bytes:
    """Sheets of (name, rows, merged ranges). A value is None, bool, number, text, or (formula, cached value)."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def cell(r, c, v):
        at = f"{number_to_letters(c)}{r}"
        if v is None:
            return ""
        if isinstance(v, tuple):
            return f'<c r="{at}"><f>{escape(v[0].lstrip("="))}</f>{"" if v[1] is None else f"<v>{v[1]}</v>"}</c>'
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    parts = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{REL}"><sheets>{"".join(f"<sheet name={quoteattr(n)} sheetId={quoteattr(str(k))} r:id={quoteattr(f'rId{k}')}/>" for k, (n, _, _) in enumerate(sheets, 1))}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations([f"worksheets/sheet{k}.xml" for k in range(1, len(sheets) + 1)])
    }
    for k, (_, rows, merged) in enumerate(sheets, 1):
        body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {ns}><sheetData>{body}</sheetData>" + (
            f"<mergeCells>{''.join(f'<mergeCell ref={quoteattr(m)}/>' for m in merged)}</mergeCells>" if merged else ""
        ) + "</worksheet>"
    return package(parts)


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="' + REL + '"'


def paragraph(text: str, style: str = "", extra: str = "") -> str:
    props = (f"<w:pStyle w:val={quoteattr(style)}/>" if style else "") + extra
    return f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def table(rows: list[list]) -> str:
    """Rows of cells: text, or (text or XML, colspan, vertical merge: '', 'restart' or 'continue')."""
    out = ""
    for row in rows:
        out += "<w:tr>"
        for c in row:
            text, span, merge = c if isinstance(c, tuple) else (c, 1, "")
            props = (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + (f'<w:vMerge w:val="{merge}"/>' if merge else "")
            out += f"<w:tc><w:tcPr>{props}</w:tcPr>{text if text.startswith('<w:') else paragraph(text)}</w:tc>"
        out += "</w:tr>"
    return f"<w:tbl>{out}</w:tbl>"


def docx(body: str, images: int = 0) -> bytes:
    styles = "".join(
        f'<w:style w:styleId="H{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 10)
    ) + '<w:style w:styleId="LB"><w:name w:val="List Bullet"/></w:style>'
    return package(
        {
            "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
            "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>",
            "word/_rels/document.xml.rels": relations([f"media/image{k}.png" for k in range(1, images + 1)])
        }
    )


P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="' + REL + '"'


def text_body(text: str, tag: str = "p:txBody") -> str:
    return f"<{tag}>{''.join(f'<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>' for t in text.split(chr(10)))}</{tag}>"


def shape(text: str, kind: str = "") -> str:
    return f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type={quoteattr(kind)}/>" if kind else ""}</p:nvPr></p:nvSpPr>{text_body(text)}</p:sp>'


def slide_table(rows: list[list[str]]) -> str:
    return f"<p:graphicFrame><a:graphic><a:tbl>{''.join(f'<a:tr>{"".join(f"<a:tc>{text_body(c, 'a:txBody')}</a:tc>" for c in r)}</a:tr>' for r in rows)}</a:tbl></a:graphic></p:graphicFrame>"


def pptx(slides: list[str]) -> bytes:
    ids = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>' for k in range(1, len(slides) + 1))
    parts = {
        "ppt/presentation.xml": f"<p:presentation {P}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": relations([f"slides/slide{k}.xml" for k in range(1, len(slides) + 1)])
    }
    return package(
        parts
        | {f"ppt/slides/slide{k}.xml": f"<p:sld {P}><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>" for k, s in enumerate(slides, 1)}
    )


# --- PDF and XLS


def pdf(pages: list[list[tuple]], title: str = "", *, packed: bool = False, images: int = 0) -> bytes:
    """Pages of marks: ('text', x, top, text, size), ('rect', x, top, width, height), ('line', x0, top0, x1, top1), in points from the top left.

    Texts are written in a two-byte font with a map to Unicode; ``packed`` puts objects into compressed object streams.
    """
    import zlib

    height, objects = 792, {}
    stream = lambda data, more="": b"<< /Length %d /Filter /FlateDecode %s>>\nstream\n%s\nendstream" % (
        len(z := zlib.compress(data)), more.encode(), z
    )
    chars = sorted({c for page in pages for m in page if m[0] == "text" for c in m[3]})
    code = {c: k for k, c in enumerate(chars, 1)}
    rows = "\n".join(f"<{k:04x}> <{c.encode('utf-16-be').hex()}>" for c, k in code.items())
    objects[4] = stream(f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(code)} beginbfchar\n{rows}\nendbfchar".encode())
    widths = " ".join(f"{k} [{550 if ord(c) < 128 else 1000}]" for c, k in code.items())
    objects[5] = f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /F /DW 1000 /W [{widths}] >>".encode()
    objects[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 4 0 R >>"
    objects[6] = stream(b"\0\0\0", "/Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceRGB /BitsPerComponent 8 ")
    kids = []
    for k, page in enumerate(pages):
        out = []
        for m in page:
            if m[0] == "text":
                _, x, top, text, size = m
                out.append(f"BT /F1 {size} Tf 1 0 0 1 {x} {height - top - 0.8 * size:.3f} Tm <{''.join(f'{code[c]:04x}' for c in text)}> Tj ET")
            elif m[0] == "rect":
                out.append(f"{m[1]} {height - m[2] - m[4]} {m[3]} {m[4]} re S")
            else:
                out.append(f"{m[1]} {height - m[2]} m {m[3]} {height - m[4]} l S")
        out += ["q 50 0 0 50 400 600 cm /I1 Do Q"] * images
        objects[11 + 2 * k] = stream("\n".join(out).encode())
        objects[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>".encode()
        kids.append(f"{10 + 2 * k} 0 R")
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} /MediaBox [0 0 612 {height}] /Resources << /Font << /F1 3 0 R >> /XObject << /I1 6 0 R >> >> >>".encode()
    objects[7] = b"<< /Title <feff%s> >>" % title.encode("utf-16-be").hex().encode()
    if packed:
        plain = {n: o for n, o in objects.items() if b"stream" not in o}
        at, body = [], b""
        for n, o in plain.items():
            at.append(f"{n} {len(body)}")
            body += o + b" "
        head = " ".join(at).encode() + b" "
        objects = {n: o for n, o in objects.items() if n not in plain} | {
            8: stream(head + body, f"/Type /ObjStm /N {len(plain)} /First {len(head)} ")
        }
    out = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in sorted(objects.items()))
    return out + b"trailer << /Root 1 0 R /Info 7 0 R >>\n%%EOF"


def grid_marks(rows: list[list], xs: list[float], top: float, step: float, size: float = 9.0) -> list[tuple]:
    """A ruled table as marks: a cell is text, None where the one to its left goes on, or (text, rows) for one that spans rows."""
    marks: list[tuple] = []
    held: dict[int, int] = {}
    for r, row in enumerate(rows):
        y, c = top + r * step, 0
        while c < len(row):
            if held.get(c, 0) > 0:
                held[c] -= 1
                c += 1
                continue
            end = c + 1
            while end < len(row) and row[end] is None:
                end += 1
            text, down = row[c] if isinstance(row[c], tuple) else (row[c], 1)
            held |= {k: down - 1 for k in range(c, end)}
            marks.append(("rect", xs[c], y, xs[end] - xs[c], step * down))
            if text:
                marks.append(("text", xs[c] + 3, y + 2, text, size))
            c = end
    return marks


def xls(sheets: list[tuple[str, list[list], list[tuple[int, int, int, int]]]]) -> bytes:
    """Sheets of (name, rows, merged ranges as first and last row, first and last column from 0) as BIFF8 in a compound file.

    A value is None, bool, number, text, a date as ('date', serial), an error as ('error', code) or a formula's text as ('formula', text).
    """
    import struct

    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    text16 = lambda s: struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")
    texts = list(dict.fromkeys(v for _, rows, _ in sheets for row in rows for v in row if isinstance(v, str)))
    strings, part, parts = struct.pack("<II", len(texts), len(texts)), b"", []
    part = strings
    for t in texts:  # long tables go on in further records, each with a flag of its own
        raw = text16(t)
        while len(part) + len(raw) > 8000:
            if len(part) > 7990:
                parts.append(part)
                part = b""
                continue
            room = max(5, (8000 - len(part) - 3) // 2 * 2 + 3)
            parts.append(part + raw[:room])
            part, raw = b"\x01", raw[room:]
        part += raw
    parts.append(part)
    xf = b"".join(rec(0xE0, struct.pack("<HHH", 0, f, 0) + bytes(14)) for f in (0, 14))
    globals_ = [rec(0x809, struct.pack("<HH", 0x600, 5) + bytes(12)), xf, rec(0xFC, parts[0]), *(rec(0x3C, p) for p in parts[1:]), rec(0x0A, b"")]
    bodies = []
    for _, rows, merged in sheets:
        body = rec(0x809, struct.pack("<HH", 0x600, 0x10) + bytes(12))
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                at = struct.pack("<HHH", r, c, 0)
                if isinstance(v, bool):
                    body += rec(0x205, at + struct.pack("<BB", v, 0))
                elif isinstance(v, int) and abs(v) < 1 << 29:
                    body += rec(0x27E, at + struct.pack("<I", (v << 2 | 2) & 0xFFFFFFFF))
                elif isinstance(v, int | float):
                    body += rec(0x203, at + struct.pack("<d", v))
                elif isinstance(v, str):
                    body += rec(0xFD, at + struct.pack("<I", texts.index(v)))
                elif isinstance(v, tuple) and v[0] == "date":
                    body += rec(0x203, struct.pack("<HHHd", r, c, 1, v[1]))
                elif isinstance(v, tuple) and v[0] == "error":
                    body += rec(0x205, at + struct.pack("<BB", v[1], 1))
                elif isinstance(v, tuple):
                    body += rec(0x06, at + b"\0" * 6 + b"\xff\xff" + bytes(8)) + rec(0x207, text16(v[1]))
        if merged:
            body += rec(0xE5, struct.pack("<H", len(merged)) + b"".join(struct.pack("<4H", *m) for m in merged))
        bodies.append(body + rec(0x0A, b""))
    named = lambda at: b"".join(
        rec(0x85, struct.pack("<IBBBB", p, 0, 0, len(n), 1) + n.encode("utf-16-le")) for (n, *_), p in zip(sheets, at, strict=True)
    )
    before = sum(map(len, globals_)) + len(named([0] * len(sheets)))
    at = [before + sum(map(len, bodies[:k])) for k in range(len(bodies))]
    book = b"".join([globals_[0], named(at), *globals_[1:], *bodies])
    book += bytes(max(0, 4096 - len(book)))
    n = -(-len(book) // 512)
    n_fat = -(-(n + 2) // 127)
    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + bytes(64))[:64] + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack(
        "<iii", -1, 1 if kind == 5 else -1, -1
    ) + bytes(36) + struct.pack("<IQ", start, size)
    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, n_fat + 1, len(book))).ljust(512, b"\0")
    fat = [0xFFFFFFFD] * n_fat + [0xFFFFFFFE] + [n_fat + 2 + k for k in range(n - 1)] + [0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 * n_fat - len(fat))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack(
        "<IIIIIII", n_fat, n_fat, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE
    ) + struct.pack("<I", 0)
    head += struct.pack("<109I", *range(n_fat), *[0xFFFFFFFF] * (109 - n_fat))
    return head + struct.pack(f"<{len(fat)}I", *fat) + directory + book.ljust(512 * n, b"\0")
