"""Workbook files by the standard library: a reader, a writer, and a Spark data source.

``spark.read.format("workbook").load(path)`` gives a row per cell of the used range (from A1 to the last row and
column that hold anything), blank cells included. ``path`` is a file or a folder; ``.xlsx`` and ``.xlsm`` are read.
Option ``table``: cells (default), named_ranges, skipped or merged. One input partition per file.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from urllib.parse import unquote
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.formula import column_index, column_letters
from . import schema

SUFFIXES = (".xlsx", ".xlsm")
FILES = "*.[xX][lL][sS][xXmM]"
#: Rows of a workbook that are handed on at a time.
ROWS = 20_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REF = re.compile(r"\$?([A-Z]{1,3})\$?(\d+)")
#: The number formats that the file format numbers itself, as far as they are read here.
_BUILTIN_FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "mm-dd-yy", 22: "m/d/yy h:mm", 49: "@"}
_DATE_BUILTIN = set(range(14, 23)) | {45, 46, 47}
_LITERAL_PARTS = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')

LET_OR_LAMBDA = r"(?i)\b(LET|LAMBDA)\s*\("
#: A table's name and one column; nested brackets and empty ones aren't logged.
STRUCTURED = r"[A-Za-z_][A-Za-z0-9_]*\[[^\[\]]+\]"


def check_suffix(path: str) -> None:
    if os.path.splitext(path)[1].lower() not in SUFFIXES:
        raise ValueError(f"unsupported workbook type {os.path.splitext(path)[1]!r}: expected one of {', '.join(SUFFIXES)}")


def workbook_name(file: str, root: str = "") -> str:
    """A workbook's name: the file's path below ``root`` (its name alone where the root is the file or isn't given, the whole path where it lies elsewhere)
    without a final ``.xlsx``. Any other ending stays, so files of one stem are different workbooks."""
    bare = lambda path: unquote(path.split("://")[-1].removeprefix("file:")) if ":/" in path else path
    file, root = bare(file), bare(root).rstrip("/")
    if root and file.startswith(root + "/"):
        file = file[len(root) + 1 :]
    elif not root or file == root:
        file = file.rsplit("/", 1)[-1]
    stem, suffix = os.path.splitext(file)
    return stem if suffix == ".xlsx" and os.path.splitext(stem)[1].lower() not in SUFFIXES else file


def _at(ref: str) -> tuple[int, int]:
    m = _REF.fullmatch(ref)
    if not m:
        raise ValueError(f"bad cell reference {ref!r}")
    return int(m[2]), column_index(m[1])


_SHIFT = re.compile(r"""("(?:[^"]|"")*"|'(?:[^']|'')*'!)|(?<![A-Za-z0-9_.$])(\$?)([A-Za-z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_.(!])""")


def shifted(formula: str, rows: int, cols: int) -> str:
    """A shared formula's text for a cell so many rows and columns away from its master."""

    def move(m: re.Match) -> str:
        if m[1]:
            return m[0]
        col = m[3] if m[2] else column_letters(column_index(m[3]) + cols)
        row = m[5] if m[4] else str(int(m[5]) + rows)
        return f"{m[2]}{col}{m[4]}{row}"

    return _SHIFT.sub(move, formula)


class Workbook:
    """The parts of one file; sheets are parsed on demand."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        targets = {}
        for rel in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels")):
            target = rel.get("Target", "")
            targets[rel.get("Id")] = target[1:] if target.startswith("/") else f"xl/{target}"
        self.sheets = [(s.get("name"), targets.get(s.get(f"{_REL}id"))) for s in book.iter(f"{_MAIN}sheet")]
        self.sheets = [(n, t) for n, t in self.sheets if t in self.zip.namelist()]
        pr = book.find(f"{_MAIN}workbookPr")
        self.epoch = datetime(1904, 1, 1) if pr is not None and pr.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        order = [s.get("name") for s in book.iter(f"{_MAIN}sheet")]
        names = [(d.get("name"), d.text or "", d.get("localSheetId")) for d in book.iter(f"{_MAIN}definedName")]
        # workbook scope first, then sheet by sheet
        self.names = [(n, t, "workbook") for n, t, k in names if k is None]
        self.names += [(n, t, s) for i, s in enumerate(order) for n, t, k in names if k is not None and int(k) == i]
        self.strings = self._strings()
        self.formats = self._formats()

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        root = ET.fromstring(self.zip.read("xl/sharedStrings.xml"))
        return [_rich(si) for si in root.iter(f"{_MAIN}si")]

    def _formats(self) -> list[tuple[str, bool]]:
        """(number format, whether it shows a date) by style index."""
        if "xl/styles.xml" not in self.zip.namelist():
            return [("General", False)]
        root = ET.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(f"{_MAIN}numFmt")}
        out = []
        for xf in root.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf"):
            k = int(xf.get("numFmtId", 0))
            code = own.get(k) or _BUILTIN_FORMATS.get(k, "General")
            out.append((code, k in _DATE_BUILTIN or (k in own and bool(re.search("[ymdhs]", _LITERAL_PARTS.sub("", code), re.I)))))
        return out or [("General", False)]

    def merged(self, target: str) -> list[tuple[int, int, int, int]]:
        out = []
        for m in ET.fromstring(self.zip.read(target)).iter(f"{_MAIN}mergeCell"):
            a, _, b = m.get("ref").partition(":")
            out.append((*_at(a), *_at(b or a)))
        return out

    def cells(self, target: str) -> Iterator[tuple[int, int, dict | None, str | None]]:
        """(row, col, cell, error) of the stored cells; a cell that can't be read has an error instead."""
        shared: dict[str, tuple[str, int, int]] = {}
        row = col = 0
        for kind, element in _cells_of(self.zip.read(target)):
            if kind == "row":
                row, col = int(element.get("r", row + 1)), 0
                continue
            try:
                r, c = _at(element.get("r")) if element.get("r") else (row, col + 1)
            except ValueError as e:
                yield row, col + 1, None, repr(e)
                col += 1
                continue
            row, col = r, c
            try:
                yield r, c, self._cell(element, r, c, shared), None
            except Exception as e:  # noqa: BLE001  a cell that can't be read is a row of the skip log
                yield r, c, None, repr(e)

    def _cell(self, element, row: int, col: int, shared: dict) -> dict:
        style = int(element.get("s", 0))
        code, is_date = self.formats[style] if style < len(self.formats) else ("General", False)
        out = {"number_format": code, "formula": None, "array": False, "value": None}
        f = element.find(f"{_MAIN}f")
        if f is not None:
            text = f.text
            if f.get("t") == "shared":
                if text:
                    shared[f.get("si")] = (text, row, col)
                else:
                    text, r0, c0 = shared[f.get("si")]
                    text = shifted(text, row - r0, col - c0)
            out["array"] = f.get("t") == "array"
            out["formula"] = "=" + (text or "")
            return out
        kind, v = element.get("t", "n"), element.find(f"{_MAIN}v")
        if kind == "inlineStr":
            inline = element.find(f"{_MAIN}is")
            out["value"] = _rich(inline) if inline is not None else None
        elif v is None or v.text is None:
            out["value"] = None
        elif kind == "s":
            out["value"] = self.strings[int(v.text)]
        elif kind == "b":
            out["value"] = v.text.strip() in ("1", "true")
        elif kind in ("str", "e"):
            out["value"] = v.text
        elif kind == "d":
            out["value"] = datetime.fromisoformat(v.text.rstrip("Z"))
        else:
            number = float(v.text)
            whole = re.fullmatch(r"\s*-?\d+\s*", v.text) is not None
            out["value"] = self.epoch + timedelta(days=number) if is_date else int(v.text) if whole else number
        return out


def _cells_of(data: bytes) -> Iterator[tuple[str, ET.Element]]:
    for event, element in ET.iterparse(io.BytesIO(data), ("start", "end")):
        if event == "start" and element.tag == f"{_MAIN}row":
            yield "row", element
        elif event == "end" and element.tag == f"{_MAIN}c":
            yield "c", element
        elif event == "end" and element.tag == f"{_MAIN}row":
            element.clear()


def _rich(element) -> str:
    """The text of a string item; phonetic runs don't count."""
    out = []
    for child in element:
        if child.tag == f"{_MAIN}t":
            out.append(child.text or "")
        elif child.tag == f"{_MAIN}r":
            out += [t.text or "" for t in child.iterfind(f"{_MAIN}t")]
    return "".join(out)


def value_columns(value) -> dict:
    """A literal as the tagged union of the cell table."""
    out = dict.fromkeys(("value_type", "value_num", "is_int", "value_str", "value_bool", "value_ts"))
    if isinstance(value, bool):
        out |= {"value_type": "bool", "value_bool": value}
    elif isinstance(value, (int, float)):
        out |= {"value_type": "num", "value_num": float(value), "is_int": isinstance(value, int)}
    elif isinstance(value, datetime):
        out |= {"value_type": "ts", "value_ts": value}
    elif value is not None:
        out |= {"value_type": "str", "value_str": str(value)}
    return out


def skip_reasons(formula: str | None, array: bool) -> list[str]:
    if formula is None:
        return []
    out = ["array formula"] if array else []
    if re.search(LET_OR_LAMBDA, formula):
        out.append("LET or LAMBDA")
    if re.search(STRUCTURED, formula):
        out.append("structured reference")
    return out


def workbook_rows(name: str, data: bytes, table: str) -> Iterator[tuple]:
    """Rows of one of the four tables."""
    book = Workbook(data)
    if table == "named_ranges":
        yield from ((name, n, t, scope) for n, t, scope in book.names)
        return
    for index, (sheet, target) in enumerate(book.sheets):
        merged = book.merged(target)
        if table == "merged":
            yield from ((name, sheet, *m) for m in merged)
            continue
        stored, errors = {}, []
        for row, col, cell, error in book.cells(target):
            if error is None:
                stored[row, col] = cell
            else:
                errors.append((row, col, f"unparseable cell: {error}"))
        if table == "skipped":
            yield from ((name, sheet, r, c, why) for r, c, why in errors)
            yield from ((name, sheet, r, c, why) for (r, c), cell in stored.items() for why in skip_reasons(cell["formula"], cell["array"]))
            continue
        bad = {(r, c) for r, c, _ in errors}
        known = [*stored, *bad, *((m[2], m[3]) for m in merged)]
        if not known:
            continue
        blank = {"number_format": "General", "formula": None, "value": None}
        waiting, spans, width = sorted(merged, reverse=True), [], max(c for _, c in known)
        for row in range(1, max(r for r, _ in known) + 1):
            # the merged ranges that reach into this row: bounds, never their cells
            spans = [m for m in spans if m[2] >= row]
            while waiting and waiting[-1][0] <= row:
                spans.append(waiting.pop())
            for col in range(1, width + 1):
                if (row, col) in bad:
                    continue
                cell = stored.get((row, col), blank)
                own = next((m for m in spans if m[1] <= col <= m[3]), None)
                hidden = own is not None and (row, col) != (own[0], own[1])
                values = value_columns(None if hidden else cell["value"])
                yield (name, sheet, index, row, col, None if hidden else cell["formula"], *values.values(), cell["number_format"], own is not None)


class _File(InputPartition):
    def __init__(self, path: str, root: str):
        super().__init__(path)
        self.path, self.root = path, root


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options.get("path", ""), options.get("table", "cells")

    def partitions(self):
        store, path = _store(self.path)
        if store.get_file_info(path).type == fs.FileType.Directory:
            found = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and os.path.splitext(f.path)[1].lower() in SUFFIXES)
            return [_File(p, path) for p in found]
        check_suffix(path)
        return [_File(path, path)]

    def read(self, partition):
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as f:
            yield from workbook_rows(workbook_name(partition.path, partition.root), f.read(), self.table)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


class WorkbookSource(DataSource):
    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        tables = {"cells": schema.CELLS, "named_ranges": schema.NAMED_RANGES, "skipped": schema.SKIPPED, "merged": schema.MERGED}
        return tables[self.options.get("table", "cells")]

    def reader(self, schema):
        return _Reader(dict(self.options))


def read_workbooks(spark, path: str, table: str = "cells"):
    """A table of the workbooks at a path that Spark reads (any store): one file at a time per task."""
    tables = {"cells": schema.CELLS, "named_ranges": schema.NAMED_RANGES, "skipped": schema.SKIPPED, "merged": schema.MERGED}
    if os.path.splitext(path)[1]:
        check_suffix(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", FILES).load(path).select("path", "content")
    return files.mapInPandas(frames(table, path), tables[table])


def frames(table: str, root: str):
    """A function for mapInPandas: (path, content) of workbook files to the rows of a table, ROWS at a time."""
    tables = {"cells": schema.CELLS, "named_ranges": schema.NAMED_RANGES, "skipped": schema.SKIPPED, "merged": schema.MERGED}
    names = [part.split()[0] for part in tables[table].split(", ")]

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = workbook_rows(workbook_name(file, root), content, table)
                while some := list(islice(rows, ROWS)):
                    frame = pd.DataFrame(some, columns=names).astype(object)
                    yield frame.where(frame.notna(), None)

    return parse


def write_workbook(path: str, sheets: dict[str, dict[tuple[int, int], object]], merged: dict[str, list[str]] | None = None, names: list[tuple[str, str, str | None]] = (), formats: dict[str, dict[tuple[int, int], str]] | None = None, arrays: dict[str, dict[tuple[int, int], str]] | None = None) -> None:
    """sheets: name -> {(row, col): value}; a text that begins with = is a formula. names: (name, target, sheet or None)."""
    merged, formats, arrays = merged or {}, formats or {}, arrays or {}
    codes = sorted({c for f in formats.values() for c in f.values()})
    style = {c: i + 1 for i, c in enumerate(codes)}
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        local = {n: i for i, n in enumerate(sheets)}
        defined = "".join(f"<definedName name={quoteattr(n)}" + (f' localSheetId="{local[s]}"' if s else "") + f">{escape(t)}</definedName>" for n, t, s in names)
        z.writestr("xl/workbook.xml", f'{head}<workbook {main} xmlns:r="{rel}"><sheets>{listed}</sheets>' + (f"<definedNames>{defined}</definedNames>" if defined else "") + "</workbook>")
        rels = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}<Relationship Id="rId{len(sheets) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        own = "".join(f'<numFmt numFmtId="{163 + i}" formatCode={quoteattr(c)}/>' for c, i in style.items())
        xfs = '<xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{163 + i}" applyNumberFormat="1"/>' for i in style.values())
        z.writestr("xl/styles.xml", f'{head}<styleSheet {main}><numFmts count="{len(style)}">{own}</numFmts><cellXfs count="{len(style) + 1}">{xfs}</cellXfs></styleSheet>')
        for i, (name, cells) in enumerate(sheets.items(), 1):
            rows: dict[int, list[str]] = {}
            for (r, c), value in sorted(cells.items()):
                s = style.get(formats.get(name, {}).get((r, c)), 0)
                rows.setdefault(r, []).append(_cell_xml(f"{column_letters(c)}{r}", value, s, arrays.get(name, {}).get((r, c))))
            body = "".join(f'<row r="{r}">{"".join(x)}</row>' for r, x in rows.items())
            spans = merged.get(name, [])
            joined = f'<mergeCells count="{len(spans)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in spans) + "</mergeCells>" if spans else ""
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"{head}<worksheet {main}><sheetData>{body}</sheetData>{joined}</worksheet>")


def _cell_xml(ref: str, value, style: int, array: str | None) -> str:
    s = f' s="{style}"' if style else ""
    if isinstance(value, bool):
        return f'<c r="{ref}"{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"{s}><v>{value!r}</v></c>'
    if isinstance(value, str) and value.startswith("="):
        more = f' t="array" ref="{array}"' if array else ""
        return f'<c r="{ref}"{s}><f{more}>{escape(value[1:])}</f></c>'
    if value is None:
        return f'<c r="{ref}"{s}/>'
    return f'<c r="{ref}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
