"""Tables in HTML: rows of cells with spans, and their grid."""

from __future__ import annotations

from html.parser import HTMLParser


def positive(value: str | None) -> int:
    try:
        n = int((value or "").strip())
    except ValueError:
        return 1
    return n if n > 0 else 1


class TableRows(HTMLParser):
    """``rows``: lists of (text, rowspan, colspan)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, int, int]]] = []
        self._text: list[str] | None = None
        self._spans = (1, 1)

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._close()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            named = dict(attrs)
            self._text, self._spans = [], (positive(named.get("rowspan")), positive(named.get("colspan")))
        elif tag == "br" and self._text is not None:
            self._text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self._text is not None:
            self._text.append(data)

    def close(self):
        super().close()
        self._close()

    def _close(self):
        if self._text is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(("".join(self._text).strip(), *self._spans))
            self._text = None


def rows_of(html: str | None) -> list[list[tuple[str, int, int]]]:
    parser = TableRows()
    parser.feed(html or "")
    parser.close()
    return parser.rows


def grid(html: str | None) -> list[list[str]]:
    """The table as a grid: a cell's text at its anchor, trailing empty values and blank rows left out."""
    taken: dict[tuple[int, int], str] = {}
    out = []
    for r, cells in enumerate(rows_of(html)):
        c = 0
        for text, rowspan, colspan in cells:
            while (r, c) in taken:
                c += 1
            taken.update({(r + i, c + j): "" for i in range(rowspan) for j in range(colspan)})
            taken[r, c] = text
            c += colspan
        width = max((j for i, j in taken if i == r), default=-1) + 1
        row = [taken.get((r, j), "") for j in range(width)]
        while row and not row[-1]:
            row.pop()
        if row:
            out.append(row)
    return out


def cells(html: str | None) -> list[dict]:
    """The table's cells with 1-based places and spans; the first row is the header."""
    until: dict[int, int] = {}
    out = []
    for r, own in enumerate(rows_of(html), 1):
        c = 1
        for text, rowspan, colspan in own:
            while until.get(c, 0) >= r:
                c += 1
            out.append({"row": r, "col": c, "rowspan": rowspan, "colspan": colspan, "text": " ".join(text.split()), "is_header": r == 1})
            for j in range(c, c + colspan) if rowspan > 1 else ():
                until[j] = r + rowspan - 1
            c += colspan
    return out
