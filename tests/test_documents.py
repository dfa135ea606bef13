"""Office files with sheets out of order, and files that are damaged: read right or without text, never an end of the job."""

import io
import zipfile

from graphloom.sources import documents

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(sheets, rels=True, shared=("one", "two"), cell='<c t="s"><v>{}</v></c>'):
    """A workbook: (title, file, cell values) in its own order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>" + "".join(f'<sheet name="{t}" r:id="r{i}"/>' for i, (t, _, _) in enumerate(sheets)) + "</sheets></workbook>")
        if rels:
            z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{f}"/>' for i, (_, f, _) in enumerate(sheets)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
        for _, f, values in sheets:
            z.writestr(f.lstrip("/") if f.startswith("/") else f"xl/{f}", f"<worksheet {MAIN}><sheetData><row>" + "".join(cell.format(v) for v in values) + "</row></sheetData></worksheet>")
    return out.getvalue()


def test_sheets_by_relations():
    sheets = [("Last", "worksheets/sheet2.xml", [1]), ("First", "/xl/worksheets/sheet1.xml", [0, 1])]
    assert documents.parse(book(sheets), "xlsx") == "## Sheet: Last\ntwo\n## Sheet: First\none\ttwo"
    plain = [("A", "worksheets/sheet1.xml", [0]), ("B", "worksheets/sheet2.xml", [1])]
    assert documents.parse(book(plain, rels=False), "xlsx") == "## Sheet: A\none\n## Sheet: B\ntwo"


def test_damaged_files():
    good = book([("A", "worksheets/sheet1.xml", [0])])
    assert documents.parse(book([("A", "worksheets/sheet1.xml", [9])]), "xlsx") is None  # no such shared string
    assert documents.parse(book([("A", "worksheets/sheet1.xml", ["x"])]), "xlsx") is None
    for ext in ("xlsx", "docx"):
        for content in (b"", b"PK", b"no archive", good[: len(good) // 2], good[:-30] + bytes(30), b"".join(bytes([b ^ (i % 97 == 50)]) for i, b in enumerate(good))):
            assert documents.parse(content, ext) is None or isinstance(documents.parse(content, ext), str)
    assert documents.parse(b"%PDF-1.4 stream\nx\nendstream", "pdf") == ""
