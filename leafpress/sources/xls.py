"""Binary spreadsheets (BIFF8 in a compound file) with the standard library: each sheet to a grid of texts."""

from __future__ import annotations

import datetime as dt
import json
import re
import struct
from collections.abc import Iterator

from leafpress.functions.values import BLANK, BOOLEAN, DATE, EMPTY, ERROR, NUMBER, TEXT, spreadsheet_text
from leafpress.sources.office import BUILT_IN_DATES, OLE, EncryptedError, number_to_letters

FREE = 0xFFFFFFFA  # sector numbers from here on mark ends and free places
#: Record numbers of the format.
BOF, EOF, FILEPASS, DATEMODE, CONTINUE, BOUNDSHEET, FORMAT, XF, SST = 0x809, 0x0A, 0x2F, 0x22, 0x3C, 0x85, 0x41E, 0xE0, 0xFC
LABELSST, LABEL, NUMBER_CELL, RK, MULRK, BOOLERR, FORMULA, STRING, MERGED = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207, 0xE5


class Compound:
    """A compound file's streams."""

    def __init__(self, data: bytes):
        if data[:8] != OLE:
            raise ValueError("not a compound file")
        self.data = data
        self.size, self.mini_size = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        n_fat, directory, _, self.cutoff, mini_fat, _, extra, n_extra = struct.unpack_from("<I I I I I I I I", data, 44)
        sectors = list(struct.unpack_from("<109I", data, 76))
        for _ in range(n_extra):
            if extra >= FREE:
                break
            more = self.numbers(self.sector(extra))
            sectors += more[:-1]
            extra = more[-1]
        self.fat: list[int] = []
        for s in sectors[:n_fat]:
            if s < FREE:
                self.fat += self.numbers(self.sector(s))
        self.mini_fat = self.numbers(self.chain(mini_fat))
        self.entries = {}
        held = self.chain(directory)
        for k in range(0, len(held) - 127, 128):
            used, kind = struct.unpack_from("<HB", held, k + 64)
            name = held[k : k + max(0, used - 2)].decode("utf-16-le", "replace")
            start, size = struct.unpack_from("<IQ", held, k + 116)
            if kind in (2, 5):
                self.entries.setdefault("\0root" if kind == 5 else name, (start, size & 0xFFFFFFFF))
        self.mini = self.chain(self.entries.get("\0root", (FREE, 0))[0])

    def sector(self, k: int) -> bytes:
        return self.data[(k + 1) * self.size : (k + 2) * self.size]

    @staticmethod
    def numbers(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def chain(self, k: int) -> bytes:
        out, left = [], len(self.fat)
        while k < len(self.fat) and left >= 0:
            out.append(self.sector(k))
            k, left = self.fat[k], left - 1
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self.chain(start)[:size]
        out, k, left = [], start, len(self.mini_fat)
        while k < len(self.mini_fat) and left >= 0:
            out.append(self.mini[k * self.mini_size : (k + 1) * self.mini_size])
            k, left = self.mini_fat[k], left - 1
        return b"".join(out)[:size]


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        yield kind, data[at + 4 : at + 4 + size]
        at += 4 + size


def short_string(raw: bytes, at: int, wide_length: bool) -> str:
    """A string of one record: its length, a flag for two-byte characters, the characters."""
    n = struct.unpack_from("<H" if wide_length else "<B", raw, at)[0]
    at += 2 if wide_length else 1
    flags, at = raw[at], at + 1
    at += 2 if flags & 8 else 0
    at += 4 if flags & 4 else 0
    return raw[at : at + 2 * n].decode("utf-16-le", "replace") if flags & 1 else raw[at : at + n].decode("latin-1")


def shared_strings(parts: list[bytes]) -> list[str]:
    """The table of strings, whose characters may go on in further records, each with a flag of its own."""
    out: list[str] = []
    part, at = 0, 8
    total = struct.unpack_from("<I", parts[0], 4)[0]

    def take(n: int) -> bytes:
        nonlocal part, at
        held = b""
        while len(held) < n and part < len(parts):
            piece = parts[part][at : at + n - len(held)]
            held += piece
            at += len(piece)
            if at >= len(parts[part]) and len(held) < n:
                part, at = part + 1, 0
        return held

    for _ in range(total):
        head = take(3)
        if len(head) < 3:
            break
        n, flags = struct.unpack("<HB", head)
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        text, wide = "", flags & 1
        while n and part < len(parts):
            if at >= len(parts[part]):
                part, at = part + 1, 1
                if part >= len(parts):
                    break
                wide = parts[part][0] & 1
            size = 2 if wide else 1
            fits = min(n, (len(parts[part]) - at) // size)
            text += parts[part][at : at + fits * size].decode("utf-16-le" if wide else "latin-1", "replace")
            at, n = at + fits * size, n - fits
            if n and not fits:
                at = len(parts[part])
        take(4 * runs + extra)
        out.append(text)
    return out


def rk(raw: int) -> float:
    value = float((raw if raw < 1 << 31 else raw - (1 << 32)) >> 2) if raw & 2 else struct.unpack(
        "<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32)
    )[0]
    return value / 100 if raw & 1 else value


def cell_text(kind: int, value, epoch_1904: bool = False) -> str:
    """``functions.values.binary_cell`` for one cell."""
    if kind in (EMPTY, BLANK):
        return ""
    if kind == ERROR:
        return f"#ERROR({int(value)})"
    if kind == BOOLEAN:
        return spreadsheet_text(bool(value))
    if kind == DATE:
        start = dt.datetime(1904, 1, 1) if epoch_1904 else dt.datetime(1899, 12, 30)
        try:
            return spreadsheet_text(start + dt.timedelta(seconds=round(value * 86400)))
        except OverflowError:
            return spreadsheet_text(value)
    return spreadsheet_text(value)


class Book:
    def __init__(self, data: bytes):
        box = Compound(data)
        self.data = box.stream("Workbook") or box.stream("Book")
        if self.data is None:
            raise EncryptedError("the file is encrypted") if "EncryptedPackage" in box.entries else ValueError("no workbook stream")
        self.sheets, self.strings, self.epoch, formats, styles, parts, last = [], [], False, {}, [], [], 0
        version = struct.unpack_from("<H", self.data, 4)[0]
        if version != 0x600:
            raise ValueError("only the format of 1997 and later is read")
        for kind, raw in records(self.data):
            if kind == FILEPASS:
                raise EncryptedError("the workbook is encrypted")
            if kind == DATEMODE:
                self.epoch = raw[:2] == b"\x01\x00"
            elif kind == BOUNDSHEET and raw[5] == 0:
                self.sheets.append((short_string(raw, 6, False), struct.unpack_from("<I", raw)[0]))
            elif kind == FORMAT:
                formats[struct.unpack_from("<H", raw)[0]] = short_string(raw, 2, True)
            elif kind == XF:
                styles.append(struct.unpack_from("<H", raw, 2)[0])
            elif kind == SST or (kind == CONTINUE and last == SST):
                parts.append(raw)
            last = SST if kind == CONTINUE and last == SST else kind
            if kind == EOF:
                break
        if parts:
            self.strings = shared_strings(parts)
        plain = {k: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f).lower() for k, f in formats.items()}
        self.dates = {k for k, f in enumerate(styles) if f in BUILT_IN_DATES or re.search("[ymdhs]", plain.get(f, ""))}

    def cells(self, at: int) -> tuple[dict[tuple[int, int], str], list[str]]:
        """Texts of a sheet's cells by (row, column) from 0, and its merged ranges."""
        out: dict[tuple[int, int], str] = {}
        merged: list[str] = []
        waiting = None

        def put(row: int, col: int, style: int, kind: int, value) -> None:
            kind = DATE if kind == NUMBER and style in self.dates else kind
            out[row, col] = cell_text(kind, value, self.epoch)

        for kind, raw in records(self.data, at):
            if kind == EOF:
                break
            if kind == MERGED:
                for k in range(struct.unpack_from("<H", raw)[0]):
                    r0, r1, c0, c1 = struct.unpack_from("<4H", raw, 2 + 8 * k)
                    merged.append(f"{number_to_letters(c0 + 1)}{r0 + 1}:{number_to_letters(c1 + 1)}{r1 + 1}")
                continue
            if kind == STRING and waiting:
                put(*waiting, TEXT, short_string(raw, 0, True))
                waiting = None
                continue
            if kind not in (LABELSST, LABEL, NUMBER_CELL, RK, MULRK, BOOLERR, FORMULA):
                continue
            row, col, style = struct.unpack_from("<3H", raw)
            if kind == LABELSST:
                n = struct.unpack_from("<I", raw, 6)[0]
                put(row, col, style, TEXT, self.strings[n] if n < len(self.strings) else "")
            elif kind == LABEL:
                put(row, col, style, TEXT, short_string(raw, 6, True))
            elif kind == NUMBER_CELL:
                put(row, col, style, NUMBER, struct.unpack_from("<d", raw, 6)[0])
            elif kind == RK:
                put(row, col, style, NUMBER, rk(struct.unpack_from("<I", raw, 6)[0]))
            elif kind == MULRK:
                for k in range((len(raw) - 6) // 6):
                    style, n = struct.unpack_from("<HI", raw, 4 + 6 * k)
                    put(row, col + k, style, NUMBER, rk(n))
            elif kind == BOOLERR:
                put(row, col, style, ERROR if raw[7] else BOOLEAN, raw[6])
            elif raw[12:14] != b"\xff\xff":  # a formula's value: a number, or one of four others
                put(row, col, style, NUMBER, struct.unpack_from("<d", raw, 6)[0])
            elif raw[6] == 0:
                waiting = (row, col, style)
            elif raw[6] in (1, 2):
                put(row, col, style, BOOLEAN if raw[6] == 1 else ERROR, raw[8])
        return out, merged


def read_xls(data: bytes) -> tuple[dict, list[dict]]:
    """A table per sheet: rows without their trailing empty cells, blank rows left out."""
    book = Book(data)
    blocks, about, content = [], [], []
    for name, at in book.sheets:
        cells, merged = book.cells(at)
        rows, cols = max((r for r, _ in cells), default=-1) + 1, max((c for _, c in cells), default=-1) + 1
        grid = []
        for r in range(rows):
            row = [cells.get((r, c), "") for c in range(cols)]
            while row and not row[-1]:
                row.pop()
            if row:
                grid.append(row)
        wide = max(map(len, grid), default=0)
        place = f"A1:{number_to_letters(max(wide, 1))}{max(len(grid), 1)}"
        blocks.append(
            {
                "block_type": "table", "sheet": name, "cell_range": place, "grid": grid, "n_rows": len(grid), "n_cols": wide,
                "merged": merged, "extraction_method": "biff8"
            }
        )
        about.append({"name": name, "max_row": rows, "max_column": cols, "merged_count": len(merged)})
        content.append(f"[Sheet {name}] {place}")
        content += ["\t".join(row) for row in grid[:50]]
    metadata = {"title": None, "sheet_count": len(about), "sheets": about}
    return {"title": None, "content": "\n".join(content), "metadata": json.dumps(metadata, ensure_ascii=False)}, blocks
