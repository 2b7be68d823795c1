from __future__ import annotations

import zipfile

import pytest

from attesta.sources import documents, spreadsheets
from attesta.streaming import backlog

HEADER = "NO.,YEAR,AUTHORS,DOCUMENT TITLE,LINK,ABSTRACT\n"


def test_csv_with_a_title_row_quotes_and_bom(spark, tmp_path):
    path = tmp_path / "papers.csv"
    path.write_text("Library export,,,,,\n" + HEADER + '1,2021,"Smith, J.","A ""quoted""\ntitle",https://doi.org/10.1/a,Text\n2,2020,Lee,,https://x.org,\n', encoding="utf-8-sig")
    rows = {r.original_row_number: r for r in spreadsheets.library_table(spark, str(path)).collect()}
    assert rows["1"].title == 'A "quoted"\ntitle' and rows["1"].valid and not rows["2"].valid


def test_latin_1_and_tabs(spark, tmp_path):
    path = tmp_path / "papers.tsv"
    path.write_bytes("TITLE\tURL\nCafé\thttps://x.org\n".encode("latin-1"))
    assert [r.title for r in spreadsheets.library_table(spark, str(path)).collect()] == ["Café"]


def test_missing_columns_are_told(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("A,B\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        spreadsheets.library_table(spark, str(path))
    with pytest.raises(ValueError, match="unknown kind"):
        spreadsheets.library_table(spark, "x.pdf")


def test_xlsx_with_two_sheets(spark, tmp_path):
    path = tmp_path / "papers.xlsx"
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def sheet(rows):
        body = "".join(f'<row r="{i}">' + "".join(f'<c r="{"ABC"[j]}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v) + "</row>" for i, r in enumerate(rows, 1))
        return f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/><sheet name="Bad" r:id="r3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in (1, 2, 3)) + "</Relationships>")
        z.writestr("xl/worksheets/s1.xml", sheet([["About"], ["Title", "Link"], ["A", "https://a.org"]]))
        z.writestr("xl/worksheets/s2.xml", sheet([["Link", None, "Title"], ["https://b.org", None, "B"]]))
        z.writestr("xl/worksheets/s3.xml", "<broken")
    rows = {r.sheet: (r.title, r.source_link) for r in spreadsheets.library_table(spark, str(path)).collect()}
    assert rows == {"One": ("A", "https://a.org"), "Two": ("B", "https://b.org")}
    (bad,) = spreadsheets.rejected_sheets(spark, str(path)).collect()
    assert bad.sheet == "Bad" and "cannot be read" in bad.reason
    with zipfile.ZipFile(tmp_path / "none.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in (1, 2)) + "</Relationships>")
        z.writestr("xl/worksheets/s1.xml", sheet([["Nothing", "useful"]]))
        z.writestr("xl/worksheets/s2.xml", sheet([]))
    with pytest.raises(ValueError, match="No sheet contained the required columns. sheet 'One': missing columns"):
        spreadsheets.library_table(spark, str(tmp_path / "none.xlsx"))


def test_files_of_several_kinds_in_a_folder(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    (folder / "a.csv").write_text("Title,Link\nOne,https://a.org\n\nTwo,https://b.org,more,cells\n")
    (folder / "b.csv").write_bytes("note\nLink,Title\nhttps://c.org,Café\n".encode("latin-1"))
    rows = spreadsheets.text_rows(spark, str(folder))
    assert sorted((r.row_no, r.cells[0], r.cells[1]) for r in rows.collect()) == [(0, "Title", "Link"), (0, "note", None), (1, "Link", "Title"), (1, "One", "https://a.org"), (2, "Two", "https://b.org"), (2, "https://c.org", "Café")]


def test_markdown_and_text(spark, tmp_path):
    (tmp_path / "d.md").write_text("# Introduction\n\nOne line\nand another.\n\n\nLast.\n")
    (tmp_path / "d.txt").write_text("# Not a heading\n\nText.")
    got = [(r.text, r.is_heading) for r in documents.paragraphs(spark, str(tmp_path / "d.md")).orderBy("paragraph_index").collect()]
    assert got == [("Introduction", True), ("One line and another.", False), ("Last.", False)]
    assert [r.is_heading for r in documents.paragraphs(spark, str(tmp_path / "d.txt")).collect()] == [False, False]


def test_docx_reads_body_then_tables_and_no_pictures(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    path = tmp_path / "d.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body>{p("Intro", "H1")}<w:tbl><w:tr><w:tc>{p("cell")}</w:tc></w:tr></w:tbl>{p("Body")}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/media/image1.png", b"not a picture")
    got = [(r.text, r.is_heading) for r in documents.paragraphs(spark, str(path)).orderBy("paragraph_index").collect()]
    assert got == [("Intro", True), ("Body", False), ("cell", False)]


def test_backlog_is_embedded_once(spark, tmp_path):
    arriving, embedded, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "ref_id long, title string, abstract string, author_keywords array<string>, index_keywords array<string>"
    embed = lambda df: df.selectExpr("ref_id", "content_hash", "array(1.0f) as vector")
    for rows in ([(1, "a", "x", ["k"], None), (2, "b", None, None, None)], [(3, "c", "y", None, None)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(arriving)
        backlog.drain(spark, arriving, embedded, checkpoint, embed).awaitTermination(120)
    backlog.drain(spark, arriving, embedded, checkpoint, embed).awaitTermination(120)
    assert sorted(r.ref_id for r in spark.read.parquet(embedded).collect()) == [1, 3]
