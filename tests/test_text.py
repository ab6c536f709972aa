import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexifold.functions.text import (
    STOPWORDS,
    embedding_text,
    normalize,
    query_embedding_text,
    tokens,
    unicode_trim,
    utf16_length,
)


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", expression(F.col("x")).alias("y"))
    return [r["y"] for r in rows.orderBy("i").collect()]


def plain_normalize(text):
    """Character by character, as a check of the expression."""
    out, gap = [], False
    lowered = "".join({"I": "ı", "İ": "i"}.get(c, c.lower() if len(c.lower()) == 1 else c) for c in text)
    for c in unicodedata.normalize("NFD", lowered):
        category = unicodedata.category(c)
        if category == "Mn" and ord(c) < 0x10000:
            continue
        c = "i" if c == "ı" else c
        if ord(c) >= 0x10000 or not (category[0] == "L" or category == "Nd"):
            gap = True
            continue
        out.append(" " + c if gap and out else c)
        gap = False
    return "".join(out)


def test_normalize_cases(spark):
    cases = {
        "İADE Süresi": "iade suresi",
        "IŞIK": "isik",
        "Garanti süresi kaç gün?": "garanti suresi kac gun",
        "Wi-Fi'ye 2.4 GHz": "wi fi ye 2 4 ghz",
        "  çok   boşluk\n\tvar  ": "cok bosluk var",
        "": "",
        " \t ": "",
        "…!?": "",
        "ΣΑΣ": "σασ",
        "a😀b": "a b",
    }
    assert column(spark, cases, normalize) == list(cases.values())
    assert column(spark, [None], normalize) == [""]


# Characters whose case or age differs between Unicode tables are left out.
LETTERS = st.text(
    alphabet=st.one_of(
        st.characters(min_codepoint=0x20, max_codepoint=0x24F),
        st.sampled_from("\n\t…—“”çğıöşüÇĞİÖŞÜẞ가힣각ΣςΩ한०٣́̈😀𝐀"),
        st.characters(min_codepoint=0x370, max_codepoint=0x4FF, categories=("Ll", "Lu")),
    ),
    max_size=40,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LETTERS, min_size=20, max_size=60))
def test_normalize_equals_character_walk(spark, texts):
    assert column(spark, texts, normalize) == [plain_normalize(t) for t in texts]


def test_tokens(spark):
    cases = {
        "Ürünü kaç gün içinde iade edebilirim?": ["urunu", "gun", "iade", "edebi"],
        "iade suresi kac gun": ["iade", "sures", "gun"],
        "İade süresi kaç gün?": ["iade", "sures", "gun"],
        "E-posta 2.4 GHz ve 750 TL": ["posta", "2", "4", "ghz", "750", "tl"],
        "kargo kargo": ["kargo", "kargo"],
        "": [],
    }
    assert column(spark, cases, tokens) == list(cases.values())
    assert column(spark, [" ".join(STOPWORDS)], tokens) == [[]]
    assert len(STOPWORDS) == len(set(STOPWORDS))


def test_long_runs_of_separators_do_not_overflow(spark):
    assert column(spark, ["a1" + "!" * 200_000 + "b2"], normalize) == ["a1 b2"]


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\r", " ", " ", "　", "\u0085"])
def test_trim_knows_every_blank(spark, blank):
    assert column(spark, [f"{blank}a{blank}b{blank}"], unicode_trim) == [f"a{blank}b"]


def test_utf16_length(spark):
    assert column(spark, ["abc", "çğş", "a😀b", ""], utf16_length) == [3, 3, 4, 0]


def test_embedding_text(spark):
    row = spark.createDataFrame([("Başlık", "A > B", "Metin")], "t string, p string, c string").select(
        embedding_text(F.col("t"), F.col("p"), F.col("c"), "title: {title} | text: ").alias("d"),
        query_embedding_text(F.col("c"), "query: ").alias("q"),
    ).first()
    assert row["d"] == "title: Başlık | text: Başlık > A > B\nMetin"
    assert row["q"] == "query: Metin"
