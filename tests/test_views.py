from workload import views
from workload.compare import connect
from workload.oracle import PARTS, statement

SF = "/root/testdata/sf0.001"


def lost_lines(chunks: dict, documents: dict) -> list:
    """Lines with text that are in no chunk of their document."""
    return [(i, line) for i, text in documents.items() for line in text.split("\n") if line.strip() and line.strip() not in chunks.get(i, "")]


def test_no_text_is_lost_on_the_way_to_the_chunks(spark):
    documents = {f"doc-{r.doc_id:019d}": r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    mine: dict = {}
    for r in views.kb_chunks(spark, SF).orderBy("source_id", "chunk_order").collect():
        mine[r.source_id] = mine.get(r.source_id, "") + "\n" + r.content
    assert lost_lines(mine, documents) == []
    assert {i for i, t in documents.items() if t.strip()} == set(mine)
    assert "kb_chunks" in PARTS
    theirs: dict = {}
    for source_id, content in connect(SF).execute(statement("select source_id, content from kb_chunks order by source_id, chunk_order")).fetchall():
        theirs[source_id] = theirs.get(source_id, "") + "\n" + content
    assert theirs == mine


def test_ids_of_any_size_stay_apart(spark):
    docs = spark.createDataFrame([(1234567890, "a"), (12345678901, "b"), (9, "c")], "doc_id long, text string")
    made = spark.sql(views.DOCUMENTS_SQL.replace("from documents", "from (select *, 's' as source from {docs})"), docs=docs)
    assert made.select("source_id").distinct().count() == 3
    assert [r[0] for r in made.selectExpr("cast(substring(source_id, 5) as bigint) as n").orderBy("n").collect()] == [9, 1234567890, 12345678901]
