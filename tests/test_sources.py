from __future__ import annotations

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tagsieve.sources import reports, sinks, tables

SPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


PARAGRAPH = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("word/document.xml", f'<w:document xmlns:w="{SPACE}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


BODY = (
    "<w:p><w:r><w:t>  First </w:t></w:r><w:r><w:t>part&amp;</w:t><w:tab/><w:t>x</w:t></w:r></w:p>"
    "<w:p/><w:p><w:r><w:t>  </w:t></w:r></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    '<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:br/><w:t>next</w:t><w:br w:type="page"/></w:r></w:p>'
)


@pytest.fixture()
def files(spark):
    return spark.createDataFrame(
        [
            ("in/a.TXT", "olá".encode()),
            ("in/b.c.docx", docx(BODY)),
            ("in/c.doc", b"x"),
            ("in.d/d.pdf", b"x"),
            ("in.d/noext", b"x"),
            ("in/empty.txt", b" \n\t"),
            ("in/bad.txt", b"ab\xff\xfecd"),
            ("in/broken.docx", b"not a zip"),
        ],
        "path string, content binary",
    )


def test_intake(files):
    result = reports.intake(files)
    texts = {r["nome"]: r["texto"] for r in result.reports.collect()}
    assert texts == {"a": "olá", "b.c": "First part&\tx\n\nlink\nnext", "bad": b"ab\xff\xfecd".decode(errors="replace")}
    reasons = {r["path"]: r["reason"] for r in result.rejected.collect()}
    assert reasons.keys() == {"in/c.doc", "in.d/d.pdf", "in.d/noext", "in/broken.docx"}
    assert "'.pdf'" in reasons["in.d/d.pdf"] and "'.'" in reasons["in.d/noext"]


def test_strict_intake_rejects_bad_bytes(files):
    good = files.filter("path = 'in/a.TXT'")
    assert reports.intake(good, strict=True).reports.count() == 1
    with pytest.raises(Exception, match="UTF"):
        reports.intake(files, strict=True).reports.collect()


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.txt").write_bytes("linha 1\r\nlinha 2".encode())
    (tmp_path / "sub" / "two.docx").write_bytes(docx("<w:p><w:r><w:t>dois</w:t></w:r></w:p>"))
    (tmp_path / "three.TxT").write_bytes(b"tres")
    (tmp_path / "four.pdf").write_bytes(b"x")
    found = reports.read_folder(spark, str(tmp_path))
    texts = {r["nome"]: r["texto"] for r in found.reports.collect()}
    assert texts == {"one": "linha 1\r\nlinha 2", "two": "dois", "three": "tres"}
    assert [r["path"].rsplit("/", 1)[-1] for r in found.rejected.collect()] == ["four.pdf"]
    alike = reports.intake(reports.read_files(spark, str(tmp_path))).reports
    assert {r["nome"]: r["texto"] for r in alike.collect()} == texts


def test_a_docx_that_unpacks_to_gigabytes_is_a_reason(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as package:
        with package.open("word/document.xml", "w", force_zip64=True) as part:
            part.write(b"<w:document>")
            for _ in range(2048):
                part.write(b" " * (1 << 20))
    nested = docx("<w:tbl><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tbl>" + PARAGRAPH.format("after"))
    rows = [("in/bomb.docx", out.getvalue()), ("in/wide.docx", docx(PARAGRAPH.format("x" * 90_000))), ("in/a.docx", nested)]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    found = reports.read_docx(reports._with_kind(files), max_bytes=100_000).collect()
    by_name = {r["path"]: (r["texto"], r["reason"]) for r in found}
    assert by_name["in/a.docx"] == ("after", None) and by_name["in/wide.docx"] == ("x" * 90_000, None)
    assert len(out.getvalue()) < 20_000_000 and by_name["in/bomb.docx"][0] is None
    small = reports.read_docx(reports._with_kind(files), max_bytes=10_000).filter("path = 'in/wide.docx'").first()
    assert small["texto"] is None and "10000 bytes" in small["reason"]


def test_pasted(spark):
    rows = spark.createDataFrame([(1, "text"), (2, " \n")], "doc_id int, texto string")
    assert [tuple(r) for r in reports.pasted(rows).collect()] == [(1, "texto_colado", "text")]


def test_quotations_need_their_columns(spark, tmp_path):
    path = f"{tmp_path}/q.csv"
    with open(path, "w", encoding="utf-8") as out:
        out.write('ref_pos,quotation,codes,extra\n1,"two\nlines, ""quoted""",a;b,z\n')
    found = tables.as_quotations(tables.read_table(spark, path))
    assert [tuple(r) for r in found.collect()] == [(1, 'two\nlines, "quoted"', "a;b")]
    with pytest.raises(ValueError, match="codes"):
        tables.as_quotations(found.drop("codes"))
    assert tables.as_reviews(None) is None and tables.as_reviews(found.drop("codes")) is None
    assert tables.as_reviews(found).columns == ["quotation", "codes"]
    stamped = found.withColumn("data_revisao", F.lit("2024-01-02 03:04"))
    assert tables.as_reviews(stamped, "data_revisao").columns == ["quotation", "codes", "data_revisao"]
    assert tables.as_reviews(found, "ref_pos").columns == ["seq", "quotation", "codes"]


def test_labels_and_frequencies(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_text("  b: x \n\n a\n", encoding="utf-8")
    vocab = tables.read_labels(spark, str(path))
    assert [tuple(r) for r in vocab.orderBy("idx").collect()] == [(0, "b: x"), (1, "a")]
    assert {tuple(r) for r in tables.tag_frequencies(None, vocab).collect()} == {("b: x", None), ("a", None)}
    stored = tables.read_table(spark, _csv(tmp_path), "tag string, n bigint")
    assert [tuple(r) for r in tables.tag_frequencies(stored, vocab).collect()] == [("a", 7)]


def _csv(folder):
    path = folder / "f.csv"
    path.write_text("tag,n\na,7\n", encoding="utf-8")
    return str(path)


def test_taxonomy(spark):
    rows = tables.taxonomy(spark).orderBy("block_pos", "tag_pos").collect()
    assert len(rows) == 44 and [r["full_tag"] for r in rows] == tables.full_tags()
    assert rows[0]["full_tag"] == "Métodos de avaliação: Estudos de caso"
    assert rows[-1]["full_tag"] == "Nível de Influência Geográfica: Todos os níveis"


def test_sinks(spark, tmp_path):
    when = datetime(2024, 5, 6, 7, 8)
    assert sinks.output_name(["r"], when) == "resultado_r_20240506_0708"
    name = sinks.output_name(["r", "s", "t"], when)
    assert name == "resultado_3_relatorios_20240506_0708"
    results = spark.createDataFrame([(1, 'a "b"\nc', [0.5, 0.25])], "doc_id int, trecho string, probs array<double>")
    freq = spark.createDataFrame([("a", 7)], "tag string, n bigint")
    paths = sinks.write_results(results, freq, str(tmp_path), name)
    assert spark.read.parquet(paths["resultados"]).collect() == results.collect()
    assert spark.read.parquet(paths["frequencia_tags"]).collect() == freq.collect()
    path = sinks.write_csv(results, str(tmp_path), name)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    assert [tuple(r) for r in reader.csv(path).collect()] == [("1", 'a "b"\nc', "0.5 | 0.25")]
    reviews = spark.createDataFrame([("q", "a")], "quotation string, codes string")
    for _ in range(2):
        sinks.write_reviews(reviews, f"{tmp_path}/reviews")
    assert spark.read.parquet(f"{tmp_path}/reviews").count() == 2
    written = sinks.write_label_tables(f"{tmp_path}/m", freq, freq, freq.limit(0))
    assert set(written) == {"labels", "frequencia_tags"}
    written = sinks.write_label_tables(f"{tmp_path}/n", freq, freq, freq)
    assert spark.read.parquet(written["tags_removidas"]).count() == 1


def test_any_damaged_docx_is_a_reason(spark):
    sound = docx("<w:p><w:r><w:t>text that is long enough to be compressed, text that is long</w:t></w:r></w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("word/document.xml", "<a>" + "b" * 5000 + "</a>")
    packed = bytearray(out.getvalue())
    start = packed.index(b"word/document.xml") + len("word/document.xml")
    packed[start : start + 8] = b"\xff" * 8
    locked = bytearray(sound)
    for sign, offset in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(sign) + offset] |= 1
    rows = [("in/sound.docx", sound), ("in/torn.docx", bytes(packed)), ("in/locked.docx", bytes(locked)), ("in/empty.docx", b"")]
    rows += [("in/null.docx", None), ("in/cut.docx", sound[: len(sound) // 2])]
    result = reports.intake(spark.createDataFrame(rows, "path string, content binary"))
    assert [r["nome"] for r in result.reports.collect()] == ["sound"]
    assert {r["path"] for r in result.rejected.collect()} == {p for p, _ in rows[1:]}
