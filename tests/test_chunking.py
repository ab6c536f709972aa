from pyspark.sql import functions as F

from lexifold.operators.chunking import chunk_documents, has_section


def chunks(spark, body, title="Belge", max_chars=1200):
    rows = spark.createDataFrame([("d", title, body)], "source_id string, title string, body string")
    return [(r.chunk_order, r.section_path, r.content) for r in chunk_documents(rows, max_chars).orderBy("chunk_order").collect()]


def test_nested_headings(spark):
    body = "## Alet\n### Kürek ###\nsap\n#### Bakım\nyağla\n### Tırmık\n\ndiş\n## Tohum\nfide\n"
    assert chunks(spark, body) == [
        (0, "Alet > Kürek", "sap"), (1, "Alet > Kürek > Bakım", "yağla"), (2, "Alet > Tırmık", "diş"), (3, "Tohum", "fide"),
    ]


def test_text_above_all_sections_takes_the_title(spark):
    assert chunks(spark, "\r\nöndeki satır\r\nikincisi\r\n## Çit\r\ntahta", title="Bahçe") == [
        (0, "Bahçe", "öndeki satır\nikincisi"), (1, "Çit", "tahta"),
    ]
    assert chunks(spark, "# Kapak\naltı\n## Çit\n# Arka kapak\nsonu", title="Bahçe") == [(0, "Bahçe", "altı"), (1, "Bahçe", "sonu")]


def test_skipped_levels_and_level_one_resets(spark):
    body = "## A\n#### D\nbir\n### C\niki\n# Yeni\nüç\n### E\ndört\n####### yedi\n#bitişik"
    assert chunks(spark, body) == [
        (0, "A > D", "bir"),
        (1, "A > C", "iki"),
        (2, "Belge", "üç"),
        (3, "E", "dört\n####### yedi\n#bitişik"),
    ]


def test_no_code_fence_awareness(spark):
    assert chunks(spark, "## A\n```\n# yorum\nkod\n```") == [(0, "A", "```"), (1, "Belge", "kod\n```")]


def test_long_sections_break_between_paragraphs(spark):
    words = ["elma armut", "kiraz", "ayva nar incir", "dut", "üzüm " * 9, "erik"]
    body = "## Meyve\n" + "\n\t \n\n".join(words)
    # 10 + 2 + 5 fit in 20 characters, 14 + 2 + 3 too; the fifth is longer than the limit and stays whole
    assert [c for _, _, c in chunks(spark, body, max_chars=20)] == [
        "elma armut\n\nkiraz", "ayva nar incir\n\ndut", ("üzüm " * 9).strip(), "erik",
    ]
    assert {p for _, p, _ in chunks(spark, body, max_chars=20)} == {"Meyve"}
    assert len(chunks(spark, body, max_chars=1000)) == 1


def test_time_grows_with_the_length(spark):
    """Twice the sections, or paragraphs, may take three times as long, not four."""
    import time

    def seconds(body):
        started = time.perf_counter()
        n = len(chunks(spark, body, max_chars=60))
        return n, time.perf_counter() - started

    for one in ("## H {0}\ntext {0}\n", "a paragraph with number {0}\n\n"):
        seconds(one.format(1))
        (n, short), (m, long) = (seconds("".join(one.format(i) for i in range(k))) for k in (8000, 16000))
        assert m == 2 * n and long < 3 * short + 2


def test_limit_counts_utf16_units(spark):
    assert len(chunks(spark, "## A\n\n" + "😀" * 5 + "\n\n" + "😀" * 5, max_chars=21)) == 2
    assert len(chunks(spark, "## A\n\n" + "😀" * 5 + "\n\n" + "😀" * 5, max_chars=22)) == 1


def test_paragraphs_survive_packing(spark):
    paragraphs = [f"Paragraf {i} " + "söz " * (i % 17) for i in range(200)]
    got = chunks(spark, "## A\n\n" + "\n\n".join(paragraphs), max_chars=200)
    assert "\n\n".join(c for _, _, c in got).split("\n\n") == [p.strip() for p in paragraphs]
    assert all(len(c) <= 200 for _, _, c in got)


def test_has_section(spark):
    bodies = ["", "\n \n", "## A\n\n### B\n", "## A\nmetin", "metin", "#\n", "## \n"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, b string")
    got = [r.y for r in rows.select("i", has_section(F.col("b")).alias("y")).orderBy("i").collect()]
    counted = [len(chunks(spark, b)) > 0 for b in bodies]
    assert got == counted == [False, False, False, True, True, True, True]
