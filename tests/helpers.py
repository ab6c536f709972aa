"""Small stores and markdown texts for the tests."""

import datetime

from lexifold.sources.store import CHUNK_SCHEMA, DOCUMENT_SCHEMA, Store


def markdown(
    doc_id, body, key=None, title=None, version="1.0", date="2025-01-01", status="active", category="politika", supersedes='""'
):
    return (
        f"---\nid: {doc_id}\ndocumentKey: {key or doc_id}\ntitle: {title or 'Belge ' + doc_id}\nversion: \"{version}\"\n"
        f"effectiveDate: {date}\nstatus: {status}\nsupersedes: {supersedes}\ncategory: {category}\n---\n\n{body}"
    )


def files(spark, **texts):
    return spark.createDataFrame([(f"{name}.md", text) for name, text in texts.items()], "file_name string, text string")


def store(spark, *documents):
    """``documents``: (id, key, version, date, status, category, title, [(path, content[, vector, model])])."""
    rows, chunks = [], []
    for doc_id, key, version, date, status, category, title, sections in documents:
        rows.append(
            (doc_id, f"{doc_id}.md", key, title, version, datetime.date.fromisoformat(date), status, category, None, f"H-{doc_id}", None, None)
        )
        for order, section in enumerate(sections):
            path, content, vector, model = (*section, None, None)[:4]
            chunks.append((doc_id, order, path, content, vector, model))
    return Store(spark.createDataFrame(rows, DOCUMENT_SCHEMA), spark.createDataFrame(chunks, CHUNK_SCHEMA))


def garden_store(spark):
    """Rules of a community garden in an old, a valid and a coming version, a compost guide, and an outdated FAQ."""
    return store(
        spark,
        ("kompost", "kompost", "1.0", "2025-04-10", "active", "kilavuz", "Kompost rehberi", [
            ("Teslim günü", "Kompost torbaları cumartesi kapıdan verilir."),
        ]),
        ("parsel-2023", "parsel", "1.0", "2023-03-01", "superseded", "prosedur", "Parsel kuralları", [
            ("Sulama", "Parseller akşamları kovayla sulanır."),
            ("Anahtar", "Anahtar depozitosu istenmez."),
        ]),
        ("parsel-2025", "parsel", "1.5", "2025-03-01", "active", "prosedur", "Parsel kuralları", [
            ("Anahtar", "Anahtar depozitosu yüz liradır."),
            ("Sulama", "Parseller sabah yediden önce damlama hattıyla sulanır."),
        ]),
        ("parsel-2027", "parsel", "2.0", "2027-03-01", "active", "prosedur", "Parsel kuralları", [
            ("Sulama", "Parseller yalnız yağmur suyuyla sulanır."),
        ]),
        ("soru-cevap", "soru-cevap", "1.0", "2024-09-05", "active", "sss", "Sorular", [
            ("Giriş > Anahtar için ne ödenir", "Anahtar depozitosu istenmez."),
        ]),
    )


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")
