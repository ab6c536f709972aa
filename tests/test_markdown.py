import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helpers import files, markdown
from lexifold.sources import markdown as markdown_source
from lexifold.sources.markdown import parse_markdown, read_markdown_folder

VALID = markdown("iade-v2", "# İade\n\n## 2. Süre\n\n30 gün.\n", key="iade", title="İade Politikası", version="2.0", date="2025-06-01", supersedes="iade-v1")


def parse(spark, text):
    return parse_markdown(files(spark, x=text)).first()


def test_fields_and_hash_ignore_line_ends_and_bom(spark):
    row = parse(spark, "﻿" + VALID.replace("\n", "\r\n"))
    assert (row.source_id, row.document_key, row.title, row.version) == ("iade-v2", "iade", "İade Politikası", "2.0")
    assert (row.effective_date, row.status, row.category, row.supersedes) == (datetime.date(2025, 6, 1), "active", "politika", "iade-v1")
    assert row.error is None
    assert row.content_hash == parse(spark, VALID).content_hash
    assert row.content_hash != parse(spark, VALID.replace("30 gün", "45 gün")).content_hash
    assert len(row.content_hash) == 64 and row.content_hash == row.content_hash.upper()


def test_quoting_comments_and_empty_supersedes(spark):
    text = VALID.replace("supersedes: iade-v1", "supersedes: ''").replace("title: İade Politikası", "title: 'Müşteri''nin: hakkı' # not")
    row = parse(spark, text.replace("status: active", "status: ACTIVE   # şimdilik\nowner: ekip\ntags:\n  - a"))
    assert row.error is None and row.supersedes is None
    assert row.title == "Müşteri'nin: hakkı" and row.status == "active"
    assert parse(spark, VALID.replace("supersedes: iade-v1", "supersedes: ~")).supersedes is None


@pytest.mark.parametrize(
    ("old", "new", "error"),
    [
        ("documentKey: iade\n", "", "field_missing:documentKey"),
        ("id: iade-v2", "id: ", "field_missing:id"),
        ("title: İade Politikası", 'title: "  "', "field_missing:title"),
        ('version: "2.0"', "versiyon: 2.0", "field_missing:version"),
        ("status: active", "status: draft", "status_unknown"),
        ("category: politika", "category: blog", "category_unknown"),
        ("effectiveDate: 2025-06-01", "effectiveDate: 01.06.2025", "date_invalid"),
        ("effectiveDate: 2025-06-01", "effectiveDate: 2025-02-30", "date_invalid"),
        ("30 gün.", "", "section_missing"),
        ("\n---\n\n", "\n--\n\n", "front_matter_unclosed"),
        ("---\nid", "id", "front_matter_missing"),
        ("status: active", "status: active\nstatus: superseded", "front_matter_unreadable"),
        ("status: active", "status active", "front_matter_unreadable"),
    ],
)
def test_rejections(spark, old, new, error):
    assert old in VALID
    assert parse(spark, VALID.replace(old, new, 1)).error == error


def test_folder_scan(spark, tmp_path):
    (tmp_path / "b.md").write_text(markdown("b", "## A\nmetin"))
    (tmp_path / "a.md").write_text(markdown("a", "## A\nmetin"))
    (tmp_path / "not.txt").write_text("başka")
    (tmp_path / "alt").mkdir()
    (tmp_path / "alt" / "c.md").write_text(markdown("c", "## A\nmetin"))
    rows = parse_markdown(read_markdown_folder(spark, str(tmp_path))).orderBy("file_name").collect()
    assert [(r.file_name, r.source_id, r.error) for r in rows] == [("a.md", "a", None), ("b.md", "b", None)]


def test_a_folder_is_listed_by_tasks_and_not_in_the_driver(spark, tmp_path):
    """What Spark's reader finds, with bytes that are no UTF-8, odd names, hidden and empty files; no list of files in the plan."""
    for name in ("a.md", "b c+d%20.md", "ö=1.md", "_x.md", "_k=v.md", ".h.md", "A.MD", "n.md.txt"):
        (tmp_path / name).write_bytes(b"\xef\xbb\xbf" + name.encode() + b"\r\n\xff\x80 \n")
    (tmp_path / "leer.md").write_bytes(b"")
    (tmp_path / "ordner.md").mkdir()
    for i in range(40):
        (tmp_path / f"n{i}.md").write_text(f"{i} " * (i + 1))
    columns = "file_name", F.hex(F.col("text").cast("binary")).alias("octets")
    by_reader = markdown_source._texts(spark.read.text(str(tmp_path), wholetext=True, pathGlobFilter="*.md")).select(*columns)
    for folder in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        found = read_markdown_folder(spark, folder)
        rows = [tuple(r) for r in found.select(*columns).collect()]
        assert sorted(rows) == sorted(map(tuple, by_reader.collect())) and len(rows) == 44
        assert found.inputFiles() == [] and "FileScan" not in found._jdf.queryExecution().executedPlan().toString()


def test_missing_folder_is_named(spark, tmp_path):
    with pytest.raises(AnalysisException, match="yok"):
        read_markdown_folder(spark, str(tmp_path / "yok"))


def test_values_that_are_not_flat_are_rejected(spark):
    for written in ("title: >\n  uzun", "title: |\n  uzun", "title: &x [a, b]", "title: *x", "title: !!str a", "title: [a, b]", "title: {a: b}", "title: bir\n  iki", "title:\n  ic: x"):
        assert parse(spark, VALID.replace("title: İade Politikası", written)).error == "front_matter_unreadable", written
    for written in ("title: bir > iki & üç", "title: 'a' # not\n# satır", "title: a\netiket: [x, y]\nliste:\n  - bir"):
        assert parse(spark, VALID.replace("title: İade Politikası", written)).error is None, written
