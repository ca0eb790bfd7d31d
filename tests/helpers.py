"""Helpers of the tests; fixtures are in conftest.py."""

import zipfile
from xml.sax.saxutils import escape


def rows(df, *order):
    """Collected rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_xlsx(path, sheets: dict[str, list[list]]):
    """A minimal workbook; a ('date', serial) cell is written with a date format."""
    strings: list[str] = []

    def cell(value, ref):
        if value is None:
            return ""
        if isinstance(value, tuple):
            return f'<c r="{ref}" s="1"><v>{value[1]}</v></c>'
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{ref}"><v>{value}</v></c>'
        if value not in strings:
            strings.append(value)
        return f'<c r="{ref}" t="s"><v>{strings.index(value)}</v></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        for n, (name, grid) in enumerate(sheets.items(), 1):
            body = "".join(
                f'<row r="{i + 1}">' + "".join(cell(v, f"{column_name(j)}{i + 1}") for j, v in enumerate(line)) + "</row>"
                for i, line in enumerate(grid) if line
            )
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        tags = "".join(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="rId{n}"/>' for n, name in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>{tags}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{n}" Type="worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        items = "".join(f"<si><t>{escape(s)}</t></si>" for s in strings)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{items}</sst>")
