"""Versions on each question's own day, against a plain loop; logs and folder scans that are repeated."""

import datetime
import random

from lexifold.operators.versioning import resolve_versions, version_intervals, versions_on
from lexifold.sources.audit_log import append_audit_log, compact_audit_log, read_audit_log
from lexifold.sources.markdown import folder_manifest, read_changed_markdown, read_markdown_folder, write_markdown_folder
from pyspark.sql import functions as F

DAY = datetime.date(2020, 1, 1)
VERSIONS = "document_key string, source_id string, file_name string, title string, version string, effective_date date, status string"


def versions(n, families, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        family = "hot" if rng.random() < 0.4 else f"f{rng.randrange(families)}"
        day = DAY + datetime.timedelta(days=rng.randrange(900)) if rng.random() < 0.95 else None
        version = rng.choice(["1.0", "1.9", "1.10", "2.0", "2.0.1", "draft"])
        rows.append((family, f"s{i}", f"s{i:04d}.md", "T", version, day, rng.choice(["active", "active", "superseded"])))
    return rows


def key(version):
    parts = version.split(".")
    return tuple(int(p) for p in parts) + (-1,) * (4 - len(parts)) if all(p.isdigit() for p in parts) else (0, 0, -1, -1)


def in_effect(rows, family, day):
    usable = [r for r in rows if r[0] == family and r[6] != "superseded" and r[5] is not None and day is not None and r[5] <= day]
    usable.sort(key=lambda r: r[2])
    usable.sort(key=lambda r: (r[5], key(r[4])), reverse=True)
    return usable[0][1] if usable else None


def test_every_day_of_every_family(spark):
    rows = versions(400, 20, 1)
    df = spark.createDataFrame(rows, VERSIONS).repartition(5)
    days = [None, *[DAY + datetime.timedelta(days=d) for d in range(-40, 2000, 37)]]
    families = sorted({r[0] for r in rows}) + ["unknown"]
    asked = spark.createDataFrame([(f, d) for f in families for d in days], "document_key string, as_of date")
    got = {(r["document_key"], r["as_of"]): (r["n_versions"], r["current"] and r["current"]["source_id"]) for r in versions_on(asked, df).collect()}
    sizes = {f: sum(r[0] == f for r in rows) or None for f in families}
    assert got == {(f, d): (sizes[f], in_effect(rows, f, d)) for f in families for d in days}
    per_day = version_intervals(df).groupBy("document_key", "valid_from").count()
    assert per_day.where("count > 1").isEmpty()
    assert versions_on(asked.limit(0), df).isEmpty() and versions_on(asked, df.limit(0)).where("current is not null").isEmpty()


def test_hits_on_one_day_are_resolved_as_by_that_day(spark):
    rows = versions(120, 10, 2)
    df = spark.createDataFrame(rows, VERSIONS)
    rng = random.Random(3)
    hits = spark.createDataFrame([(q, k + 1, *rng.choice(rows)) for q in range(30) for k in range(8)], f"query_id int, rank int, {VERSIONS}")
    day = datetime.date(2021, 2, 3)
    columns = ("query_id", "rank", "source_id", "multi_version", "kept", "reason", "needs_substitution")
    one = resolve_versions(hits, df, day).hits.select(*columns)
    own = resolve_versions(hits.withColumn("as_of", F.lit(day)), df, None).hits.select(*columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, own.collect()))
    nulls = resolve_versions(hits.withColumn("as_of", F.lit(None).cast("date")), df, None).hits
    assert nulls.count() == hits.count() and nulls.where("kept and multi_version").isEmpty()


def test_a_repeated_batch_is_logged_once(spark, tmp_path):
    path = str(tmp_path / "log")
    names = "query_id int, question string, answerable boolean, refusal_reason string, model string, latency_ms long, response_json string, status int"
    answers = spark.createDataFrame([(i, f"q{i}", True, "", "m", 5, "{}", 400 if i == 3 else 200) for i in range(8)], names)
    stamp = datetime.datetime(2024, 5, 6, 7)
    append_audit_log(answers.where("query_id < 5"), path, stamp, "a")  # an attempt that stopped half way
    append_audit_log(answers, path, stamp, "a")
    append_audit_log(answers, path, datetime.datetime(2024, 5, 7), "a")
    append_audit_log(answers, path, stamp, "b")
    append_audit_log(answers, path, stamp)
    log = [(r["batch_id"], r["query_id"]) for r in read_audit_log(spark, path).collect()]
    assert sorted(log, key=str) == sorted([(b, i) for b in ("a", "b", None) for i in range(8) if i != 3], key=str)
    append_audit_log(answers, path, datetime.datetime(2024, 5, 8), "c")
    day = tmp_path / "log" / "created_on=2024-05-06"
    assert len(list(day.glob("*.parquet"))) > 1
    compact_audit_log(spark, path, datetime.date(2024, 5, 6))
    spark.catalog.refreshByPath(path)
    assert len(list(day.glob("*.parquet"))) == 1 and read_audit_log(spark, path).count() == 28
    compact_audit_log(spark, str(tmp_path / "nothing"), datetime.date(2024, 5, 6))


def test_only_changed_files_are_read(spark, tmp_path):
    folder = str(tmp_path / "kb")
    texts = {f"belge {i} ş.md": f"metin {i}\n" for i in range(6)} | {"a+b%41[1].md": "x"}
    write_markdown_folder(spark.createDataFrame(list(texts.items()), "file_name string, text string").repartition(3), folder)
    (tmp_path / "kb" / "note.txt").write_text("no")
    scanned = {r["file_name"]: r["text"] for r in read_markdown_folder(spark, folder).collect()}
    assert scanned == {n: t or "" for n, t in texts.items()}
    manifest = folder_manifest(spark, folder)
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert manifest.count() == 7
    unchanged, gone = read_changed_markdown(spark, folder, manifest)
    assert unchanged.isEmpty() and gone.isEmpty()
    (tmp_path / "kb" / "belge 2 ş.md").write_text("uzun yeni metin\n")
    (tmp_path / "kb" / "a+b%41[1].md").write_text("yeni")
    (tmp_path / "kb" / "belge 4 ş.md").unlink()
    for most in (1000, 1):
        changed, gone = read_changed_markdown(spark, folder, manifest, max_named=most)
        assert {r["file_name"]: r["text"] for r in changed.collect()} == {"belge 2 ş.md": "uzun yeni metin\n", "a+b%41[1].md": "yeni"}
        assert gone.count() == 1
