"""Cells of the first sheet of one .xlsx workbook, as text.

A small codec that runs inside Spark tasks, one workbook at a time. Rows come
out as they are parsed; the sheet is never held as a document tree.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from posixpath import join, normpath
from xml.etree import ElementTree
from xml.parsers.expat import ParserCreate

_CHUNK = 1 << 20

# Built-in number formats that show a date or a time (fixed values).
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _name(element) -> str:
    return element.tag.rpartition("}")[2]


def _children(element, name: str):
    return [child for child in element if _name(child) == name]


def _attribute(element, name: str) -> str | None:
    return next((v for k, v in element.items() if k.rpartition("}")[2] == name), None)


def _text(element) -> str:
    """Text of a string item without its phonetic hints."""
    parts = []
    for child in element:
        if _name(child) == "t":
            parts.append(child.text or "")
        elif _name(child) == "r":
            parts.extend(t.text or "" for t in _children(child, "t"))
    return "".join(parts)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    strings = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, element in ElementTree.iterparse(part):
            if _name(element) == "si":
                strings.append(_text(element))
                element.clear()
    return strings


def _is_date_code(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code, flags=re.I)
    return re.search("[dmyhs]", bare, re.I) is not None


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    formats = set(DATE_FORMATS)
    for group in _children(root, "numFmts"):
        for custom in group:
            if _is_date_code(custom.get("formatCode", "")):
                formats.add(int(custom.get("numFmtId")))
    return {
        index
        for group in _children(root, "cellXfs")
        for index, style in enumerate(group)
        if int(style.get("numFmtId", 0)) in formats
    }


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """Path of the first sheet, and whether dates count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = _children(_children(root, "sheets")[0], "sheet")[0]
    flags = [p.get("date1904", "0") for p in _children(root, "workbookPr")]
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    wanted = _attribute(sheet, "id")
    target = next(link.get("Target") for link in links if link.get("Id") == wanted)
    path = target[1:] if target.startswith("/") else normpath(join("xl", target))
    return path, bool(flags) and flags[0] in ("1", "true")


def _moment(text: str, from_1904: bool) -> str | None:
    """ISO text of a serial day number, to the millisecond; None if it is no date."""
    try:
        return _iso(float(text), from_1904)
    except (ValueError, OverflowError):
        return None


def _iso(serial: float, from_1904: bool) -> str:
    if from_1904:
        start = datetime(1904, 1, 1)
    else:  # the 1900 calendar has a 29 February that never was
        start = datetime(1899, 12, 31 if serial < 60 else 30)
    moment = start + timedelta(milliseconds=round(serial * 86_400_000))
    return moment.isoformat(sep=" ")


def _number(text: str) -> str:
    """Whole numbers without fraction or exponent, others as written."""
    try:
        value = float(text)
    except ValueError:
        return text
    return str(int(value)) if value.is_integer() else text


def _column(letters: str) -> int:
    index = 0
    for letter in letters:
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


class _SheetReader:
    """Collects the raw cells of each row as the parser meets them."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, list]] = []
        self.number = -1
        self.cells: list[tuple[int, str, str, str]] = []
        self.text: list[str] | None = None
        self.hints = 0
        self.columns: dict[str, int] = {}
        self.parser = ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler = self.start
        self.parser.EndElementHandler = self.end
        self.parser.CharacterDataHandler = self.characters

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        tag = tag.rpartition(":")[2]
        if tag == "c":
            self.cell = attributes
            self.parts: list[str] = []
        elif tag == "v" or (tag == "t" and not self.hints):
            self.text = self.parts
        elif tag == "row":
            self.number = int(attributes.get("r", self.number + 2)) - 1
            self.cells = []
        elif tag == "rPh":
            self.hints += 1

    def characters(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def end(self, tag: str) -> None:
        tag = tag.rpartition(":")[2]
        if tag in ("v", "t"):
            self.text = None
        elif tag == "c":
            get = self.cell.get
            where = get("r")
            if where:
                letters = where.rstrip("0123456789")
                if letters not in self.columns:
                    self.columns[letters] = _column(letters)
                position = self.columns[letters]
            else:
                position = self.cells[-1][0] + 1 if self.cells else 0
            if self.parts:
                kind, style = get("t", "n"), get("s", "0")
                self.cells.append((position, kind, style, "".join(self.parts)))
        elif tag == "row":
            self.rows.append((self.number, self.cells))
        elif tag == "rPh":
            self.hints -= 1

    def feed(self, chunk: bytes) -> list[tuple[int, list]]:
        """Rows completed by this chunk; an empty chunk ends the sheet."""
        self.parser.Parse(chunk, not chunk)
        done, self.rows = self.rows, []
        return done


def read_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """Row number (from 0) and cell texts of each non-empty row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        path, from_1904 = _first_sheet(book)
        strings = _shared_strings(book)
        dates = {str(style) for style in _date_styles(book)}

        def value(kind: str, style: str, text: str) -> str | None:
            if kind == "s":
                text = strings[int(text)]
            elif kind == "n":
                return _moment(text, from_1904) if style in dates else _number(text)
            elif kind == "b":
                return "TRUE" if text == "1" else "FALSE"
            elif kind == "e":
                return None
            return text.strip() or None

        reader = _SheetReader()
        with book.open(path) as part:
            chunk = part.read(_CHUNK)
            while True:
                for number, raw in reader.feed(chunk):
                    cells: list[str | None] = []
                    for position, *cell in raw:
                        cells.extend([None] * (position - len(cells)))
                        cells.append(value(*cell))
                    if any(text is not None for text in cells):
                        yield number, cells
                if not chunk:
                    break
                chunk = part.read(_CHUNK)
