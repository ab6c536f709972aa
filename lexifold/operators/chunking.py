"""Markdown body -> heading-addressed chunks.

A body sits whole in one row, so sections, heading paths and paragraph packing
are array expressions on that row: no shuffle, no window over lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexifold.functions.text import unicode_trim, utf16_length
from lexifold.options import MAX_CHUNK_CHARS

# What a heading line and a paragraph break look like.
HEADING_PATTERN = r"(?dU)^(#{1,6})\s+(.+?)\s*#*\s*$"
PARAGRAPH_BREAK_PATTERN = r"\n[ \t]*\n"

# A line is a heading exactly when a blank and one more character follow the hash signs.
_HEADING_AHEAD = r"(?dmU)^(?=#{1,6}[^\S\n][^\n])"
_TEXT_LINE = r"(?dmU)^(?!#{1,6}[^\S\n][^\n])[^\n]*\S"
_CHUNK_LIST = "array<struct<section_path:string,content:string>>"
_OPEN_HEADINGS = "array<struct<level:int,text:string>>"
PATH_SEPARATOR = " > "

# Sizing: items that a fold takes together, see ``_fold``.
FOLD_GROUP = 64


def has_section(body: Column) -> Column:
    """True when some line outside the headings has text, so at least one chunk results."""
    return body.rlike(_TEXT_LINE)


def heading_sections(body: Column) -> Column:
    """Array of (level, text, content); text before the first heading has level 0."""

    def section(piece: Column) -> Column:
        first_line = F.substring_index(piece, "\n", 1)
        level = F.length(F.regexp_extract(first_line, HEADING_PATTERN, 1))
        below = F.when(level > 0, F.substr(piece, F.length(first_line) + 2)).otherwise(piece)
        return F.struct(
            level.alias("level"),
            unicode_trim(F.regexp_extract(first_line, HEADING_PATTERN, 2)).alias("text"),
            unicode_trim(below).alias("content"),
        )

    return F.transform(F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), _HEADING_AHEAD), section)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; a lambda that uses an expression twice evaluates it twice."""
    return F.transform(F.array(value), body)[0]


def _fold(items: Column, carry: Column, kind: str, step) -> Column:
    """(carry, out) after all ``items``; ``step(carry, item)`` gives the next carry and an array to append to ``out``.

    Appending copies what is there already. So ``out`` grows by groups of items, each an array of its own, and is
    flattened once at the end: the time of a document grows with its length, not with the square.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(state: Column, item: Column) -> Column:
        return _let(step(state["carry"], item), lambda made: F.struct(
            made["carry"].alias("carry"), F.concat(state["out"], made["out"]).alias("out")
        ))

    def group(state: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(state["carry"].alias("carry"), none.alias("out")), one)
        return _let(done, lambda d: F.struct(d["carry"].alias("carry"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    def grouped(items: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(FOLD_GROUP))
        return F.transform(firsts, lambda first: F.slice(items, first, F.lit(FOLD_GROUP)))

    start = F.struct(carry.alias("carry"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(_let(items, grouped), start, group, lambda s: F.struct(s["carry"].alias("carry"), F.flatten(s["out"]).alias("out")))


def addressed_sections(sections: Column, title: Column) -> Column:
    """Array of (section_path, content) of the sections that have text of their own.

    What the fold carries is the list of headings still open; a heading closes
    those of its own level and deeper. Level 1 repeats the title and is not
    part of the path.
    """
    none = F.array().cast(_CHUNK_LIST)

    def follow(still: Column, section: Column) -> Column:
        heading = F.struct(section["level"].alias("level"), section["text"].alias("text"))
        kept = F.filter(still, lambda h: h["level"] < section["level"])
        return F.when(section["level"] > 0, F.concat(kept, F.array(heading))).otherwise(still)

    def emit(still: Column, section: Column) -> Column:
        def entry(now: Column) -> Column:
            below_title = F.transform(F.filter(now, lambda h: h["level"] > 1), lambda h: h["text"])
            path = F.when(F.size(below_title) > 0, F.array_join(below_title, PATH_SEPARATOR)).otherwise(title)
            made = F.array(F.struct(path.alias("section_path"), section["content"].alias("content")))
            return F.struct(now.alias("carry"), F.when(section["content"] != "", made).otherwise(none).alias("out"))

        return _let(follow(still, section), entry)

    return _fold(sections, F.array().cast(_OPEN_HEADINGS), "struct<section_path:string,content:string>", emit)["out"]


def pack_paragraphs(content: Column, max_chars: int = MAX_CHUNK_CHARS) -> Column:
    """A section within the limit stays whole; a longer one is cut between paragraphs, never inside one."""
    paragraphs = F.filter(
        F.transform(F.split(content, PARAGRAPH_BREAK_PATTERN), unicode_trim), lambda paragraph: paragraph != ""
    )
    none = F.array().cast("array<string>")

    def pack(last: Column, paragraph: Column) -> Column:
        fits = (last != "") & (utf16_length(last) + 2 + utf16_length(paragraph) <= max_chars)
        return F.struct(
            F.when(fits, F.concat(last, F.lit("\n\n"), paragraph)).otherwise(paragraph).alias("carry"),
            F.when(fits | (last == ""), none).otherwise(F.array(last)).alias("out"),
        )

    packed = _let(_fold(paragraphs, F.lit(""), "string", pack), lambda p: F.when(p["carry"] == "", p["out"]).otherwise(
        F.concat(p["out"], F.array(p["carry"]))
    ))
    return F.when(utf16_length(content) <= max_chars, F.array(content)).otherwise(packed)


def chunk_array(body: Column, title: Column, max_chars: int = MAX_CHUNK_CHARS) -> Column:
    """Array of (section_path, content) chunks in document order."""

    def split_section(section: Column) -> Column:
        return F.transform(
            pack_paragraphs(section["content"], max_chars),
            lambda part: F.struct(section["section_path"].alias("section_path"), part.alias("content")),
        )

    return F.flatten(F.transform(addressed_sections(heading_sections(body), title), split_section))


def chunk_documents(documents: DataFrame, max_chars: int = MAX_CHUNK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``source_id, title, body`` -> ``source_id, chunk_order, section_path, content`` and columns to ``keep``; the order counts from 0."""
    return documents.select(
        "source_id", *keep,
        F.posexplode(chunk_array(F.col("body"), F.col("title"), max_chars)).alias("chunk_order", "chunk"),
    ).select("source_id", "chunk_order", "chunk.section_path", "chunk.content", *keep)
