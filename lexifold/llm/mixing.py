"""Mixing sources to target weights, by budgets in a tree.

The tree has one level per column of ``levels`` (domain, language, source). A token budget starts at the root and is
divided at every node among its children by their weights, where no child gets more than its capacity: the tokens of
all documents below it, times ``max_epochs``. What a child cannot take goes to its siblings in proportion to their
weights; only what none of them can take was never given to their parent, whose own siblings have it. So shortages
are met by siblings before ancestors. All amounts are whole numbers, and the children of a node get exactly its budget.

A leaf with more budget than tokens takes whole epochs first. The rest is a prefix of the documents in the order of
a hash of (seed, epoch, doc_id): documents that start before the budget is reached; of the last one the first
``take_tokens`` tokens complete the budget. To find the end of the prefix, tokens are summed by leaf and by the first
three hexadecimal digits of the hash (one of 4096 slices), and only the slice in which the budget ends is sorted, so
a leaf with a third of all documents is never one task.

Defined results: a null level is the node ``''``; documents without a token, among them null and empty texts, cost
nothing and are taken like their neighbours in the order; rows of one ``doc_id`` (or of a null one) stand in one
place and are each taken from its start; an empty table gives an empty table; a node that ``weights`` does not name
has weight 1; a node of weight 0 gets nothing, nor does anything below it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexifold.sources.scratch import materialize

SLICE = 3  # hexadecimal digits


@dataclass(frozen=True)
class Mixture:
    """``budget``: tokens, or None for ``percent`` of all tokens. ``weights``: whole numbers by path, e.g. ``"web"``, ``"web/en"``, ``"web/en/src0"``; ``*`` stands for any node
    of its place: ``"*/en"``. The whole path counts before one with stars."""

    budget: int | None = None
    percent: int = 50
    weights: dict = field(default_factory=dict)
    levels: tuple = ("domain", "lang", "source")
    max_epochs: int = 4
    seed: int = 17


def n_words(text: Column) -> Column:
    """Words of a text, as a count of tokens: starts of runs of anything but ``\\x20\\x09-\\x0D``."""
    spaces = " \t\n\x0b\x0c\r"
    squeezed = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), spaces, " " * 6), " +", " ")
    bare = F.trim(squeezed)
    return F.when(bare == "", F.lit(0)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def _weight(names: list[str], mixture: Mixture) -> Column:
    """The weight of the node whose path is in the columns ``names``."""
    own = F.concat_ws("/", *names)
    out, starred = None, []
    for path, weight in mixture.weights.items():
        parts = path.split("/")
        if len(parts) != len(names):
            continue
        if "*" in parts:
            starred.append((parts, weight))
        else:
            out = F.when(own == path, weight) if out is None else out.when(own == path, weight)
    for parts, weight in sorted(starred, key=lambda p: p[0].count("*")):
        fits = F.lit(True)
        for name, part in zip(names, parts, strict=True):
            fits = fits & (F.lit(True) if part == "*" else F.col(name) == part)
        out = F.when(fits, weight) if out is None else out.when(fits, weight)
    return (F.lit(1) if out is None else out.otherwise(1)).cast("long")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given`` to ``children`` (parent columns, ``name``, ``capacity``, ``weight``, ``budget`` of the parent).

    Children in the order of capacity by weight are full as long as their share of what is left exceeds their
    capacity; the others divide the rest by weight, rounded so that the sum is exact.
    """
    big = "decimal(38,0)"
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy(ratio, name)
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    taken = F.coalesce(F.sum(F.col("capacity").cast(big)).over(before), F.lit(0).cast(big))
    rows = children.withColumn("left", F.col("budget").cast(big) - taken).withColumn("open", F.sum("weight").over(onward))
    fits = F.expr("weight > 0 and cast(capacity as decimal(38,0)) * open <= left * weight")
    rows = rows.withColumn("full", fits)
    alike = Window.partitionBy(*parent, "full")
    rows = (
        rows.withColumn("upto", F.sum("weight").over(alike.orderBy(ratio, name).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("whole", F.sum("weight").over(alike))
        .withColumn("rest", F.max("left").over(alike))  # what is left at the first child that is not full
    )

    def share(weight: str) -> str:
        return f"((cast(rest as decimal(38,0)) * cast({weight} as decimal(18,0))) div cast(whole as decimal(18,0)))"

    given = F.expr(f"case when full then capacity when whole > 0 then {share('upto')} - {share('upto - weight')} else 0 end")
    return rows.withColumn("given", given.cast("long")).drop("left", "open", "full", "upto", "whole", "rest")


def leaf_budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """``leaves`` (level columns, ``tokens``) with the column ``budget``: one row per leaf, however many documents."""
    names = [f"level{i}" for i in range(len(mixture.levels))]
    paths = [names[: i + 1] for i in range(len(names))]
    named = leaves.select(*[F.col(c).alias(n) for c, n in zip(mixture.levels, names, strict=True)], "tokens")
    usable = F.lit(True)
    for path in paths:
        usable = usable & (_weight(path, mixture) > 0)
    base = named.withColumn("capacity", F.when(usable, F.col("tokens") * mixture.max_epochs).otherwise(0).cast("long"))
    asked = F.lit(mixture.budget) if mixture.budget is not None else F.expr(f"sum(tokens) * {mixture.percent} div 100")
    total = base.agg(F.least(F.sum("capacity"), asked).cast("long")).first()[0] or 0
    parents, on = None, ["root"]
    for path in paths:
        nodes = base.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(path, mixture)).withColumn("root", F.lit(0))
        nodes = nodes.withColumn("budget", F.lit(total)) if parents is None else nodes.join(parents, on)
        shared = share_out(nodes, on, path[-1])
        on = ["root", *path]
        parents = shared.select(*on, F.col("given").alias("budget"), *(["tokens"] if path == names else []))
    return parents.select(*[F.col(n).alias(c) for c, n in zip(mixture.levels, names, strict=True)], "tokens", "budget")


def _key(epoch: Column, seed: int) -> Column:
    """Where a document stands in the order of an epoch."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("_id"), F.lit(""))), 256)


def cutoffs(marked: DataFrame, mixture: Mixture) -> DataFrame:
    """What every leaf takes: ``leaf, whole_epochs, rest, cut_key, cut_start`` (null where no part of an epoch is taken).

    ``marked``: ``leaf`` (the levels), ``_id``, ``n_tokens`` of every document; it has no texts.
    """
    levels = mixture.levels
    leaves = marked.groupBy("leaf").agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves.select("leaf.*", "tokens"), mixture)
    parts = F.expr("case when tokens > 0 then budget div tokens else 0 end"), F.expr("case when tokens > 0 then budget % tokens else 0 end")
    plan = budgets.select(F.struct(*levels).alias("leaf"), "budget", parts[0].alias("whole_epochs"), parts[1].alias("rest"))
    plan = materialize(plan, "budgets")
    open_leaves = plan.where("rest > 0").select("leaf", "whole_epochs", "rest")
    keyed = marked.join(open_leaves, "leaf").withColumn("key", _key(F.col("whole_epochs"), mixture.seed))
    keyed = keyed.withColumn("slice", F.substring("key", 1, SLICE))
    before = Window.partitionBy("leaf").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = keyed.groupBy("leaf", "rest", "slice").agg(F.sum("n_tokens").alias("n"))
    slices = slices.withColumn("slice_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    edges = materialize(slices.where("slice_start < rest and rest <= slice_start + n").select("leaf", "slice", "slice_start"), "edges")
    near = keyed.join(edges, ["leaf", "slice"]).groupBy("leaf", "rest", "slice_start", "key").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("leaf").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("start", F.col("slice_start") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ends = near.where("start < rest").groupBy("leaf").agg(F.max(F.struct("key", "start")).alias("cut"))
    return materialize(plan.join(ends, "leaf", "left").select(
        "leaf", "whole_epochs", "rest", F.col("cut.key").alias("cut_key"), F.col("cut.start").alias("cut_start")
    ), "cutoffs")


def mix(documents: DataFrame, mixture: Mixture, tokens: Column | None = None, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` that the mixture takes, once per epoch, with ``epoch``, ``n_tokens``, ``take_tokens``.

    ``tokens``: the documents' count of tokens (words of ``text`` if not given). Columns of these names in
    ``documents`` are replaced. Texts are not shuffled: each row is compared with where its leaf ends.
    """
    kept = [c for c in documents.columns if c not in ("epoch", "n_tokens", "take_tokens")]
    counted = F.coalesce(n_words(F.col("text")) if tokens is None else tokens, F.lit(0)).cast("long")
    leaf = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in mixture.levels])
    row = documents.select(F.struct(*kept).alias("row"), leaf.alias("leaf"), F.col(doc_id).cast("string").alias("_id"), counted.alias("n_tokens"))
    ends = cutoffs(materialize(row.select("leaf", "_id", "n_tokens"), "marked"), mixture)
    rows = row.join(ends, "leaf").withColumn("key", _key(F.col("whole_epochs"), mixture.seed))
    none = F.array().cast("array<long>")
    last = F.when(F.col("key") <= F.col("cut_key"), F.array("whole_epochs")).otherwise(none)
    whole = F.when(F.col("whole_epochs") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole_epochs") - 1)).otherwise(none)
    # Counts of tokens are derived after the rows are multiplied, so a caller who drops them does not pay for them.
    out = rows.select("*", F.explode(F.concat(whole, last)).alias("epoch"))
    ends_here = (F.col("epoch") == F.col("whole_epochs")) & (F.col("key") == F.col("cut_key"))
    take = F.when(ends_here, F.least("n_tokens", F.col("rest") - F.col("cut_start"))).otherwise(F.col("n_tokens"))
    return out.select("row.*", "epoch", "n_tokens", take.alias("take_tokens"))
