"""Chat formatting: a finite-state machine over roles checks the turns, a declarative template marks them.

Everything here is column expressions and aggregates; no Python runs on the executors.

The machine is a table of transitions. Each block of ``turns_per_block`` turns is folded from every state at
once into a small map *state before -> state after*; these maps compose, so a conversation of any length is
checked from its blocks, and no task has to hold all turns of one conversation to judge it.

Defined results: null text and null role count as empty; turns are ordered by ``(turn, role, text)``, nulls
first, so ties and repeated rows have a fixed place and all stay; rows of a null ``conv_id`` form one
conversation; an empty table gives an empty table; columns other than the four named are ignored.
Conversations that break the turn order are formatted like the others and carry ``valid = false`` with the
place of the first turn that did not fit (one past the last turn if they merely end too early).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are written and which order of roles is right.

    ``header`` and ``footer`` frame each text; ``{role}`` takes the role's label, an unknown role is written
    after a question mark. ``controls`` are the strings that may not stay in a text; every one is replaced by a
    backslash and its number, a backslash itself by ``\\0``, which can be undone. ``transitions`` maps
    (state, role) to the next state; whatever is missing there is an error, from which no state leads out.
    """

    header: str = "### {role}: "
    footer: str = "</turn>\n"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    controls: tuple = ("###", "</turn>")
    loss_roles: tuple = ("assistant",)
    start: str = "start"
    accept: tuple = ("asked", "answered")
    transitions: dict = field(default_factory=lambda: {
        ("start", "system"): "instructed", ("start", "user"): "asked", ("instructed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })

    def states(self) -> list[str]:
        """All states, the error state first."""
        named = dict.fromkeys([self.start, *self.accept, *(s for s, _ in self.transitions), *self.transitions.values()])
        return ["", *named]


def escape(text: Column, template: ChatTemplate) -> Column:
    """Control strings and backslashes as backslash codes."""
    text = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for code, control in enumerate(template.controls, 1):
        text = F.replace(text, F.lit(control), F.lit(f"\\{code}"))
    return text


def unescape(text: Column, template: ChatTemplate) -> Column:
    for code, control in reversed(list(enumerate(template.controls, 1))):
        text = F.replace(text, F.lit(f"\\{code}"), F.lit(control))
    return F.replace(text, F.lit("\\0"), F.lit("\\"))


def _label(role: Column, template: ChatTemplate) -> Column:
    """A role's label; an unknown role is escaped, its colons too, so that the header's end can be found."""
    other = F.concat(F.lit("?"), F.replace(escape(role, template), F.lit(":"), F.lit("\\c")))
    return F.coalesce(*[F.when(role == name, F.lit(label)) for name, label in template.labels.items()], other)


def _role(label: Column, template: ChatTemplate) -> Column:
    other = unescape(F.replace(F.substr(label, F.lit(2)), F.lit("\\c"), F.lit(":")), template)
    return F.coalesce(*[F.when(label == shown, F.lit(name)) for name, shown in template.labels.items()], other)


def _clean(turns: DataFrame) -> DataFrame:
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def turn_segments(role: Column, text: Column, template: ChatTemplate) -> Column:
    """The segments of one turn: header, text, footer, each with its loss flag."""
    before, after = template.header.split("{role}")
    parts = (
        (F.concat(F.lit(before), _label(role, template), F.lit(after)), F.lit(False)),
        (escape(text, template), role.isin(*template.loss_roles)),
        (F.lit(template.footer), F.lit(False)),
    )
    return F.array(*[F.struct(t.alias("text"), loss.alias("loss")) for t, loss in parts])


def format_turns(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with the segments of each turn; no row is moved."""
    turns = _clean(turns)
    return turns.withColumn("segments", turn_segments(F.col("role"), F.col("text"), template))


def _blocks(turns: DataFrame, turns_per_block: int) -> DataFrame:
    return turns.withColumn("block", F.floor(F.col("turn") / turns_per_block))


def validate_turns(turns: DataFrame, template: ChatTemplate = ChatTemplate(), turns_per_block: int = BLOCK) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid, first_bad_turn`` (counted from 0, null if valid)."""
    states = template.states()
    number = {s: i for i, s in enumerate(states)}
    roles = list(dict.fromkeys(r for _, r in template.transitions))
    # next state by state and role; the last role stands for all others, the first state for an error
    table = [number[template.transitions.get((s, r), "")] for s in states for r in [*roles, None]]
    code = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(roles)], F.lit(len(roles)))
    steps = F.array(*[F.lit(x) for x in table])
    begin = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("right"))

    def fold(state: int) -> Column:
        def step(at, turn):
            after = F.element_at(steps, at["state"] * (len(roles) + 1) + turn["code"] + 1)
            return F.struct(after.alias("state"), (at["right"] + F.when(after > 0, 1).otherwise(0)).alias("right"))

        return F.aggregate("codes", begin.withField("state", F.lit(state)), step)

    by_block = (
        _blocks(_clean(turns), turns_per_block)
        .select("conv_id", "block", F.struct("turn", "role", code.alias("code")).alias("step"))
        .groupBy("conv_id", "block")
        .agg(F.sort_array(F.collect_list("step")).alias("codes"))
    )
    maps = by_block.select(
        "conv_id", "block", F.size("codes").cast("long").alias("n"), F.array(*[fold(i) for i in range(len(states))]).alias("ends")
    )

    def follow(at, block):
        end = F.element_at(block["ends"], at["state"] + 1)
        return F.struct(end["state"].alias("state"), (at["right"] + end["right"]).alias("right"))

    whole = maps.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("block", "ends"))).alias("blocks")
    ).withColumn("end", F.aggregate("blocks", begin.withField("state", F.lit(number[template.start])), follow))
    valid = F.col("end.state").isin(*[number[s] for s in template.accept])
    return whole.select(
        "conv_id", "n_turns", valid.alias("valid"), F.when(~valid, F.col("end.right")).alias("first_bad_turn")
    )


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate(), turns_per_block: int = BLOCK) -> DataFrame:
    """One row per conversation: ``conv_id, segments, n_turns, valid, first_bad_turn``.

    Segments are gathered in two steps, first by block of turns, so a long conversation is ordered in pieces.
    ``segments`` is the whole conversation in one cell, which Spark bounds at 2 GB; beyond that use ``format_turns``.
    """
    turns = format_turns(turns, template)
    blocks = (
        _blocks(turns, turns_per_block)
        .select("conv_id", "block", F.struct("turn", "role", "text", "segments").alias("row"))
        .groupBy("conv_id", "block")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["segments"])).alias("segments"))
    )
    whole = blocks.groupBy("conv_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "segments"))), lambda b: b["segments"])).alias("segments")
    )
    checked = validate_turns(turns, template, turns_per_block).withColumnRenamed("conv_id", "checked_id")
    same = F.col("conv_id").eqNullSafe(F.col("checked_id"))
    return whole.join(checked, same, "left").select("conv_id", "segments", "n_turns", "valid", "first_bad_turn")


def formatted(segments: Column) -> Column:
    """The text of all segments."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns of a formatted text: array of (role, text), with control strings restored."""
    before, after = template.header.split("{role}")
    parts = F.split(text, f"\\Q{template.footer}\\E")
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part):
        cut = F.locate(after, part, len(before) + 1)
        label = F.substr(part, F.lit(len(before) + 1), cut - len(before) - 1)
        return F.struct(
            _role(label, template).alias("role"), unescape(F.substr(part, cut + len(after)), template).alias("text")
        )

    return F.transform(turns, turn)


def loss_text(segments: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, control strings restored."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"], template)), "")
