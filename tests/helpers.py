from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from kelvane.config import COLUMNS, FIELDS

T1, T2, T3 = "Tier 1 - Direkt", "Tier 2 - Nachbar", "Tier 3 - Beobachten"
# A detail row before its header row, ids of three spellings, a page title as address, a broken encoding and tiers of two spellings.
MASTER_ROWS = [
    {"company_id": "7.0", "company": "Quillfern", "product_name": "Quillfern Bench", "row_kind": "Product", "sub_category": "Testing & Validation", "url": "https://quillfern.at/bench", "competitor_tier": T1},
    {"company_id": "7.0", "company": "Quillfern", "row_kind": "Company information", "key_categories": "2. Simulation & Analysis (CAE)", "url": "https://quillfern.at | Graz", "founding_year": "2011", "location": "Graz", "competitor_tier": "tier 1 nah", "beachhead": "Machinery"},
    {"company_id": "9.5", "company": "Ostrava Loom", "product_name": "Loom Lite", "row_kind": "Product", "remarks": "n/a laut FÃ¶hn", "url": "https://loom.example", "competitor_tier": T3},
    {"company_id": "12", "company": "Brack & Sohn", "row_kind": "Company information", "sub_category": "AI & ML Tools", "url": "Startseite - Brack", "competitor_tier": T2},
]
SCHEMA = "row_idx long, company_id_is_float boolean, " + ", ".join(f"{f} string" for f in FIELDS)


def master_frame(spark, rows=MASTER_ROWS):
    return spark.createDataFrame([(i, "." in (r.get("company_id") or ""), *[r.get(f) for f in FIELDS]) for i, r in enumerate(rows)], SCHEMA)


def column(i: int) -> str:
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def write_xlsx(path, rows, sheet="Competitors_All-Master", headers=None, blank_rows=5):
    """A workbook with shared, inline and numeric cells, blank rows at the end and a second sheet."""
    headers = headers or [h for _, h in COLUMNS]
    shared: list[str] = []

    def cell(ref, v, inline):
        if v is None:
            return ""
        if v.replace(".", "", 1).isdigit() and "." in v:
            return f'<c r="{ref}"><v>{v}</v></c>'
        if inline:
            return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        if v not in shared:
            shared.append(v)
        return f'<c r="{ref}" t="s"><v>{shared.index(v)}</v></c>'

    table = [headers, *[[r.get(f) for f in FIELDS] for r in rows], *[[None] * len(headers)] * blank_rows]
    body = "".join(f'<row r="{n}">' + "".join(cell(f"{column(i)}{n}", v, i % 2) for i, v in enumerate(r)) + "</row>" for n, r in enumerate(table, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/><sheet name="Legend_Categories" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/worksheet" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
