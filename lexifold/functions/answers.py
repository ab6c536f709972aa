"""Expressions on model replies: labels, markers, quotes, authority, prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexifold.functions.text import normalize, unicode_trim

# Source markers and blanks removed from answers, and the elision signs inside quotes.
MARKER_PATTERN = r"(?U)\s*(\[\s*C\d+[^\]]*\]|\(\s*C\d+(\s*,\s*C\d+)*\s*\))"
REPEATED_BLANKS_PATTERN = r"[ \t]{2,}"
ELLIPSIS_PATTERN = r"\.\.\.|…"

# Words of the prompt sent to the answer generator.
PROMPT_SOURCES = "KAYNAKLAR:\n\n"
PROMPT_VERSION = " | sürüm "
PROMPT_EFFECTIVE = " | yürürlük "
PROMPT_CATEGORY = " | tür: "
PROMPT_SECTION = "Bölüm: "
PROMPT_QUESTION = "SORU: "

# Reply schema.
REPLY_SCHEMA = T.StructType(
    [
        T.StructField("answerable", T.BooleanType()),
        T.StructField("answer", T.StringType()),
        T.StructField(
            "citations",
            T.ArrayType(T.StructType([T.StructField("chunkId", T.StringType()), T.StructField("quote", T.StringType())])),
        ),
        T.StructField("missingInformation", T.StringType()),
        T.StructField(
            "conflicts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("topic", T.StringType()),
                        T.StructField("chosenChunkId", T.StringType()),
                        T.StructField("rejectedChunkIds", T.ArrayType(T.StringType())),
                        T.StructField("reason", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
_CORRUPT = "_unparsed"


def source_label(label: Column) -> Column:
    """``c1``, ``[C1]``, ``(1)`` and ``1`` all mean ``C1``."""
    bare = unicode_trim(F.btrim(unicode_trim(label), F.lit("[]()")))
    return F.when(bare.rlike(r"^\p{Nd}+$"), F.concat(F.lit("C"), bare)).otherwise(F.upper(bare))


def clean_answer(answer: Column, cited_quotes: Column | None = None) -> Column:
    """Remove source markers and, when given, quoted copies of the cited text."""
    text = answer
    if cited_quotes is not None:
        filled = F.filter(cited_quotes, lambda quote: quote != "")

        def without(current: Column, quote: Column) -> Column:
            for opening, closing in (('"', '"'), ("“", "”")):
                current = F.replace(current, F.concat(F.lit(opening), quote, F.lit(closing)), F.lit(""))
            return current

        text = F.aggregate(filled, text, without)
    text = F.regexp_replace(text, MARKER_PATTERN, "")
    return unicode_trim(F.regexp_replace(text, REPEATED_BLANKS_PATTERN, " "))


def is_verbatim(quote: Column, normalized_source: Column) -> Column:
    """Every fragment between elisions occurs in the (already normalised) source; no fragment is not a quote."""
    fragments = F.filter(F.transform(F.split(quote, ELLIPSIS_PATTERN), normalize), lambda fragment: fragment != "")
    return (F.size(fragments) > 0) & F.forall(fragments, lambda fragment: F.contains(normalized_source, fragment))


def authority_rank(category: Column) -> Column:
    """Lower is more authoritative."""
    # Order of the document categories.
    return F.when(category.isin("politika", "prosedur"), 0).when(category == "kilavuz", 1).otherwise(2)


def outranks(category: Column, effective: Column, other_category: Column, other_effective: Column) -> Column:
    mine, other = authority_rank(category), authority_rank(other_category)
    return F.when(mine != other, mine < other).otherwise(effective >= other_effective)


def prompt_text(question: Column, sources: Column) -> Column:
    """``sources``: array of (label, title, version, effective_date, category, section_path, content) in context order."""

    def block(s: Column) -> Column:
        return F.concat(
            F.lit("["), s["label"], F.lit("] "), s["title"],
            F.lit(PROMPT_VERSION), s["version"],
            F.lit(PROMPT_EFFECTIVE), F.date_format(s["effective_date"], "yyyy-MM-dd"),
            F.lit(PROMPT_CATEGORY), s["category"], F.lit("\n"),
            F.lit(PROMPT_SECTION), s["section_path"], F.lit("\n"),
            s["content"], F.lit("\n\n"),
        )

    return F.concat(F.lit(PROMPT_SOURCES), F.array_join(F.transform(sources, block), ""), F.lit(PROMPT_QUESTION), question)


def parse_reply(reply: Column) -> Column:
    """Reply text -> struct with ``valid``; missing texts become empty, citations without a label are dropped."""
    schema = T.StructType([*REPLY_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(reply, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    valid = F.coalesce(parsed.isNotNull() & parsed[_CORRUPT].isNull() & unicode_trim(reply).startswith("{"), F.lit(False))
    empty = F.lit("")
    citations = F.transform(
        F.filter(
            F.coalesce(parsed["citations"], F.array().cast(REPLY_SCHEMA["citations"].dataType)),
            lambda c: F.coalesce(unicode_trim(c["chunkId"]), empty) != "",
        ),
        lambda c: F.struct(c["chunkId"].alias("label"), F.coalesce(c["quote"], empty).alias("quote")),
    )
    conflicts = F.transform(
        F.filter(
            F.coalesce(parsed["conflicts"], F.array().cast(REPLY_SCHEMA["conflicts"].dataType)),
            lambda c: c.isNotNull(),
        ),
        lambda c: F.struct(
            F.coalesce(c["topic"], empty).alias("topic"),
            F.coalesce(c["chosenChunkId"], empty).alias("chosen"),
            F.coalesce(c["rejectedChunkIds"], F.array().cast("array<string>")).alias("rejected"),
            F.coalesce(c["reason"], empty).alias("reason"),
        ),
    )
    return F.struct(
        valid.alias("valid"),
        (valid & F.coalesce(parsed["answerable"], F.lit(False))).alias("answerable"),
        F.when(valid, F.coalesce(parsed["answer"], empty)).otherwise(empty).alias("answer"),
        F.when(valid, citations).otherwise(F.array()).alias("citations"),
        F.when(valid, F.coalesce(parsed["missingInformation"], empty)).otherwise(empty).alias("missing_information"),
        F.when(valid, conflicts).otherwise(F.array()).alias("conflicts"),
    )
