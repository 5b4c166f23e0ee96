"""Office files from their zipped XML, with the standard library only: each reader turns bytes into block dicts."""

from __future__ import annotations

import datetime as dt
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from leafpress.operators.tables import COLUMN_CAP, RECORD_CAP, ROW_CAP

OLE = bytes.fromhex("D0CF11E0A1B11AE1")
HEADING = re.compile(r"(?i)(?:heading|标题|標題)\s*(\d+)")
BUILT_IN_DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


#: Names of core properties, and where they stand.
CORE = {"title": "title", "author": "creator", "subject": "subject", "created": "created", "modified": "modified"}


class EncryptedError(ValueError):
    """The container is an encrypted or legacy one."""


class Package:
    """A zip of parts with relations."""

    def __init__(self, data: bytes):
        if data[:8] == OLE:
            raise EncryptedError("the file is encrypted or of the legacy format")
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def relations(self, name: str) -> dict[str, str]:
        folder, base = posixpath.split(name)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            out[r.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        return out

    def core(self) -> dict[str, str | None]:
        """The core properties that are kept."""
        root = self.xml("docProps/core.xml")
        found = {} if root is None else {local(e): e.text for e in root.iter() if e.text}
        return {name: found.get(part) for name, part in CORE.items()}

    def title(self) -> str | None:
        return self.core()["title"]


def each(e: ET.Element | None) -> list[ET.Element]:
    """The children of an element that may be absent."""
    return [] if e is None else list(e)


def as_json(metadata: dict) -> str:
    return json.dumps(metadata, ensure_ascii=False)


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def attr(e: ET.Element | None, name: str) -> str | None:
    """An attribute by its local name."""
    if e is None:
        return None
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next((x for x in e if local(x) == name), None) if e is not None else None
    return e


def collapse(text: str) -> str:
    """``functions.text.collapse`` for one string."""
    return " / ".join(x for line in re.sub("\r\n?", "\n", text).split("\n") if (x := line.strip()))


# --- word processing


def paragraph_text(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        kind = local(e)
        if kind == "t":
            out.append(e.text or "")
        elif kind == "tab":
            out.append("\t") if attr(e, "val") is None and attr(e, "pos") is None else None
        elif kind in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def cell_text(tc: ET.Element) -> str:
    parts = []
    for e in tc:
        if local(e) == "p":
            parts.append(collapse(paragraph_text(e)))
        elif local(e) == "tbl":
            parts += [
                " | ".join(collapse("\n".join(paragraph_text(p) for p in c if local(p) == "p")) for c in row if local(c) == "tc")
                for row in e if local(row) == "tr"
            ]
    return collapse("\n".join(p for p in parts if p))


def table_cells(tbl: ET.Element) -> tuple[list[dict], int, int]:
    """Anchors (row, col, rowspan, colspan, text) of a table with merged cells, its rows and columns."""
    anchors: list[dict] = []
    open_: dict[int, dict] = {}
    n_cols = r = 0
    for row in (e for e in tbl if local(e) == "tr"):
        r += 1
        col = 1 + int(attr(child(row, "trPr", "gridBefore"), "val") or 0)
        for tc in (e for e in row if local(e) == "tc"):
            span = int(attr(child(tc, "tcPr", "gridSpan"), "val") or 1)
            merge = child(tc, "tcPr", "vMerge")
            if merge is not None and (attr(merge, "val") or "continue") == "continue" and col in open_:
                open_[col]["rowspan"] = r - open_[col]["row"] + 1
            else:
                own = {"row": r, "col": col, "rowspan": 1, "colspan": span, "text": cell_text(tc)}
                anchors.append(own)
                open_.pop(col, None)
                if merge is not None:
                    open_[col] = own
            col += span
        n_cols = max(n_cols, col - 1)
    return anchors, r, n_cols


def grid_of(cells: list[dict], rows: int, cols: int) -> list[list[str]]:
    out = [[""] * cols for _ in range(rows)]
    for c in cells:
        out[c["row"] - 1][c["col"] - 1] = c["text"]
    return out


def read_docx(data: bytes) -> tuple[dict, list[dict]]:
    pack = Package(data)
    body = child(pack.xml("word/document.xml"), "body")
    if body is None:
        raise ValueError("no document part")
    links = pack.relations("word/document.xml")
    styles = {}
    for s in each(pack.xml("word/styles.xml")):
        if local(s) == "style":
            styles[attr(s, "styleId")] = attr(child(s, "name"), "val") or ""
    blocks, first, n_par, n_tab = [], None, 0, 0
    for e in body:
        if local(e) == "tbl":
            n_tab += 1
            cells, rows, cols = table_cells(e)
            blocks.append(
                {
                    "block_type": "table", "table_index": n_tab, "grid": grid_of(cells, rows, cols), "n_rows": rows, "n_cols": cols,
                    "merged": [
                        f"{c['row']},{c['col']},{c['rowspan']},{c['colspan']}" for c in cells if c["rowspan"] > 1 or c["colspan"] > 1
                    ]
                }
            )
        elif local(e) == "p":
            n_par += 1
            text = paragraph_text(e).strip()
            images = [x for b in e.iter() if local(b) == "blip" and (x := attr(b, "embed")) in links]
            if images:
                blocks.append({"block_type": "image_reference", "paragraph_index": n_par, "image_count": len(images)})
            if not text:
                continue
            props = child(e, "pPr")
            style = attr(child(props, "pStyle"), "val") or ""
            name = styles.get(style, "").strip()
            heading = HEADING.fullmatch(name) or HEADING.fullmatch(style)
            outline = attr(child(props, "outlineLvl"), "val")
            level = int(heading[1]) if heading else int(outline) + 1 if outline and outline.isdigit() else None
            if level is not None:
                first = first or text
                blocks.append({"block_type": "heading", "text": text, "paragraph_index": n_par, "level": level})
                continue
            number = child(props, "numPr")
            depth = attr(child(number, "ilvl"), "val")
            if number is not None or "list" in name.lower():
                blocks.append(
                    {
                        "block_type": "list_item", "text": text, "paragraph_index": n_par,
                        "list_level": int(depth) if depth and depth.isdigit() else 0
                    }
                )
            else:
                blocks.append({"block_type": "paragraph", "text": text, "paragraph_index": n_par})
    sections = [e for e in body.iter() if local(e) == "sectPr"]
    core = pack.core()
    counts = {f"{k}_count": sum(b["block_type"] == k for b in blocks) for k in ("heading", "paragraph", "list_item", "table", "image_reference")}
    metadata = {
        "title": core["title"] or first, **counts, "section_count": len(sections),
        "sections": [section(k, e) for k, e in enumerate(sections, 1)], "core_properties": core
    }
    return {"title": metadata["title"], "content": "\n".join(b["text"] for b in blocks if b.get("text")), "metadata": as_json(metadata)}, blocks


def section(index: int, e: ET.Element) -> dict:
    """A section's page, in twentieths of a point."""
    size = child(e, "pgSz")
    whole = lambda name: int(x) if (x := attr(size, name)) and x.isdigit() else None
    return {"index": index, "orientation": (attr(size, "orient") or "portrait").upper(), "page_width": whole("w"), "page_height": whole("h")}


# --- spreadsheets


def letters_to_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def number_to_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def date_text(serial: float, epoch_1904: bool) -> str:
    start = dt.datetime(1904, 1, 1) if epoch_1904 else dt.datetime(1899, 12, 30) if serial >= 60 else dt.datetime(1899, 12, 31)
    return (start + dt.timedelta(seconds=round(serial * 86400))).isoformat()


def shown(value) -> str:
    return "" if value is None else "True" if value is True else "False" if value is False else str(value)


def date_styles(pack: Package) -> set[int]:
    root = pack.xml("xl/styles.xml")
    custom = {}
    for f in () if root is None else root.iter():
        if local(f) == "numFmt":
            custom[int(attr(f, "numFmtId") or 0)] = attr(f, "formatCode") or ""
    out = set()
    for k, xf in enumerate(each(child(root, "cellXfs"))):
        n = int(attr(xf, "numFmtId") or 0)
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(n, "")).lower()
        if n in BUILT_IN_DATES or re.search("[ymdhs]", code):
            out.add(k)
    return out


def sheet_cells(root: ET.Element, strings: list[str], dates: set[int], epoch: bool) -> Iterator[tuple[int, int, object, str | None]]:
    """(row, column, value, formula) of the cells that hold something."""
    r = 0
    for row in each(child(root, "sheetData")):
        r = int(attr(row, "r") or r + 1)
        c = 0
        for cell in row:
            place = re.match(r"[A-Z]+", attr(cell, "r") or "")
            c = letters_to_number(place[0]) if place else c + 1
            kind, raw, f = attr(cell, "t") or "n", child(cell, "v"), child(cell, "f")
            text = raw.text if raw is not None else None
            value: object = None
            if kind == "inlineStr":
                value = "".join(x.text or "" for x in cell.iter() if local(x) == "t")
            elif text is not None:
                if kind == "s":
                    value = strings[int(text)]
                elif kind == "b":
                    value = text == "1"
                elif kind in ("str", "e", "d"):
                    value = text
                else:
                    number = float(text)
                    value = date_text(number, epoch) if int(attr(cell, "s") or 0) in dates else int(number) if number.is_integer() and not re.search("[.eE]", text) else number
            yield r, c, value, None if f is None else "=" + (f.text or "")


def read_xlsx(data: bytes) -> tuple[dict, list[dict]]:
    pack = Package(data)
    book = pack.xml("xl/workbook.xml")
    if book is None:
        raise ValueError("no workbook part")
    links, dates = pack.relations("xl/workbook.xml"), date_styles(pack)
    epoch = attr(child(book, "workbookPr"), "date1904") in ("1", "true")
    strings = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in each(pack.xml("xl/sharedStrings.xml"))]
    blocks, content, about = [], [], []
    for sheet in each(child(book, "sheets")):
        name, root = attr(sheet, "name") or "", pack.xml(links.get(attr(sheet, "id") or "", ""))
        if root is None:
            continue
        held = list(sheet_cells(root, strings, dates, epoch))
        last_row, last_col = max((h[0] for h in held), default=1), max((h[1] for h in held), default=1)
        merged = [attr(m, "ref") or "" for m in each(child(root, "mergeCells"))]
        for ref in merged:  # a merged range belongs to the used range
            end = re.fullmatch(r"([A-Z]+)(\d+)", ref.rpartition(":")[2])
            if end:
                last_row, last_col = max(last_row, int(end[2])), max(last_col, letters_to_number(end[1]))
        first = (min((h[0] for h in held), default=1), min((h[1] for h in held), default=1))
        rows, cols = min(last_row, ROW_CAP), min(last_col, COLUMN_CAP)
        grid = [[""] * cols for _ in range(rows)]
        records, cut = [], False
        for r, c, value, formula in sorted(held, key=lambda h: h[:2]):
            if r > rows or c > cols:
                continue
            grid[r - 1][c - 1] = shown(value)
            if value is None and formula is None:
                continue
            if len(records) >= RECORD_CAP:
                cut = True
            else:
                records.append({"address": f"{number_to_letters(c)}{r}", "row": r, "col": c, "value": value, "formula": formula})
        dims = attr(child(root, "dimension"), "ref") or f"{number_to_letters(first[1])}{first[0]}:{number_to_letters(last_col)}{last_row}"
        blocks.append(
            {
                "block_type": "table", "sheet": name, "cell_range": dims, "grid": grid, "n_rows": rows, "n_cols": cols, "merged": merged,
                "rows_truncated": last_row > rows, "columns_truncated": last_col > cols, "cells_truncated": cut, "records": records
            }
        )
        about.append(
            {
                "name": name, "dimensions": dims, "max_row": last_row, "max_column": last_col, "merged_count": len(merged),
                "non_empty_cells": len(records)
            }
        )
        content.append(f"[Sheet {name}] {dims}")
        content += [line for row in grid[:50] if (line := "\t".join(row).rstrip("\t"))]
    view = next((e for e in each(child(book, "bookViews")) if local(e) == "workbookView"), None)
    names = [attr(e, "name") or "" for e in each(child(book, "sheets"))]
    active = int(attr(view, "activeTab") or 0)
    metadata = {"title": pack.title(), "sheet_count": len(about), "sheets": about, "active_sheet": names[active] if active < len(names) else None}
    return {"title": pack.title(), "content": "\n".join(content), "metadata": as_json(metadata)}, blocks


# --- presentations


def read_pptx(data: bytes) -> tuple[dict, list[dict]]:
    pack = Package(data)
    show = pack.xml("ppt/presentation.xml")
    if show is None:
        raise ValueError("no presentation part")
    links = pack.relations("ppt/presentation.xml")
    blocks: list[dict] = []
    content: list[str] = []
    about = []
    for k, ref in enumerate(each(child(show, "sldIdLst")), 1):
        # the relation's attribute is namespaced, the slide's own id is not
        rid = next((v for name, v in ref.attrib.items() if name.endswith("}id")), "")
        slide = pack.xml(links.get(rid, ""))
        tree = child(slide, "cSld", "spTree")
        title = None
        for sp in each(tree):
            kind = attr(child(sp, "nvSpPr", "nvPr", "ph"), "type")
            if kind in ("title", "ctrTitle"):
                title = body_text(sp).strip() or None
                break
        where = links.get(rid, "")
        layout = next((pack.xml(x) for x in pack.relations(where).values() if "slideLayout" in x), None) if where else None
        mine = {"index": k, "title": title, "layout": attr(child(layout, "cSld"), "name"), "textbox_count": 0, "table_count": 0, "image_count": 0}
        about.append(mine)
        blocks.append({"block_type": "slide", "text": title, "slide": k})
        content.append(f"[Slide {k}] {title or ''}".rstrip())
        count = tables = 0
        todo = [e for e in reversed(each(tree)) if local(e) in SHAPES]
        while todo:
            e = todo.pop()
            count += 1
            if local(e) == "grpSp":
                todo += [x for x in reversed(list(e)) if local(x) in SHAPES]
            elif local(e) == "graphicFrame":
                tbl = next((x for x in e.iter() if local(x) == "tbl"), None)
                if tbl is not None:
                    tables += 1
                    mine["table_count"] += 1
                    grid = [[body_text(tc).strip() for tc in tr if local(tc) == "tc"] for tr in tbl if local(tr) == "tr"]
                    blocks.append(
                        {
                            "block_type": "table", "slide": k, "shape_index": count, "table_index": tables, "grid": grid,
                            "n_rows": len(grid), "n_cols": len(grid[0]) if grid else 0
                        }
                    )
            elif local(e) == "pic":
                mine["image_count"] += 1
                blocks.append({"block_type": "image_reference", "slide": k, "shape_index": count, "image_count": 1})
            elif (text := body_text(e)).strip():
                mine["textbox_count"] += 1
                blocks.append({"block_type": "textbox", "text": text, "slide": k, "shape_index": count})
                content.append(text)
    title = about[0]["title"] if about else None
    return {"title": title, "content": "\n".join(content), "metadata": as_json({"title": title, "slide_count": len(about), "slides": about})}, blocks


SHAPES = ("sp", "pic", "graphicFrame", "grpSp", "cxnSp")


def body_text(e: ET.Element) -> str:
    body = next((x for x in e.iter() if local(x) == "txBody"), None)
    return "\n".join(
        "".join(t.text or "" if local(t) == "t" else "\v" for t in p.iter() if local(t) in ("t", "br"))
        for p in (body if body is not None else ()) if local(p) == "p"
    )
