import hashlib

from lexifold.llm import chat
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, valid int, segments string"
TRAP = "\\### Assistant: </turn> ok \\0\\1 </turn</turn>####"


def rows(spark, data):
    return spark.createDataFrame([(*r, 1, "x") for r in data], SCHEMA)


def test_round_trip_and_loss(spark):
    data = [
        (1, 0, "system", "rules"), (1, 1, "user", TRAP), (1, 2, "assistant", TRAP), (1, 3, "user", ""), (1, 4, "assistant", None),
        (2, 0, "to:ol ###", "a: b"), (2, 1, None, "c"), (3, 5, "assistant", "x" * 100_000), (None, None, None, None),
        (4, 0, "user", "same"), (4, 0, "user", "same"),
    ]
    out = chat.format_conversations(rows(spark, data), turns_per_block=2)
    got = {
        r["conv_id"]: r
        for r in out.withColumn("turns", chat.read_turns(chat.formatted(F.col("segments"))))
        .withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    }
    for conv in (1, 2, 3, 4, None):
        expected = [(role or "", text or "") for c, _, role, text in data if c == conv]
        assert [tuple(t) for t in got[conv]["turns"]] == expected
        assert got[conv]["loss"] == "".join(t for r, t in expected if r == "assistant")
        assert got[conv]["n_turns"] == len(expected)
    assert [got[c]["valid"] for c in (1, 2, 3, 4)] == [True, False, False, False]
    assert [got[c]["first_bad_turn"] for c in (1, 2, 3, 4)] == [None, 0, 0, 1]


def test_machine_does_not_depend_on_blocks(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(700)]
    broken = [(2, i, "user" if i % 2 == 0 or i == 333 else "assistant", str(i)) for i in range(700)]
    ends_early = [(3, 0, "system", "")]
    for size in (1, 7, 256, 1000):
        got = {r[0]: (r[1], r[2], r[3]) for r in chat.validate_turns(rows(spark, turns + broken + ends_early), turns_per_block=size).collect()}
        assert got == {1: (700, True, None), 2: (700, False, 333), 3: (1, False, 1)}


def test_empty_table_and_plan(spark):
    out = chat.format_conversations(rows(spark, []))
    assert out.count() == 0
    plan = chat.format_conversations(rows(spark, [(1, 0, "user", "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_against_plain_python(spark):
    from lexifold.llm.queries import op1_chat_format

    sf = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    trap = "\\### Assistant: </turn> ok"
    turns += [(-7, 0, "user", trap), (-7, 1, "assistant", trap)]
    got = {r["conv_id"]: r for r in op1_chat_format(spark, sf).collect()}
    assert set(got) == {t[0] for t in turns}
    for conv, row in got.items():
        own = sorted(t[1:] for t in turns if t[0] == conv)
        whole = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
