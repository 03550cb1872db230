"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Tokens are budgeted down a tree (domain, language, source). Children share their parent's budget by their
weights; a child that can't use its share (its tokens times the epochs allowed) passes the shortage to its
siblings. As a parent is never given more than its children can use, a shortage reaches a cousin only
through the parent's own share: siblings come before ancestors. A leaf's budget buys whole epochs and then
the prefix of one more, in the order of a hash seeded by the epoch. The end of that prefix is found by
radix: sums over 1024 ranges of the hash, again within the range where the budget ends, then by hash.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import text_of, written

#: Bits of a key, of those the first that tell its range, and as many that tell the range within it.
KEY_BITS, BITS = 60, 10
#: Leaves up to this many are broadcast; beyond, they are joined by shuffle.
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Mixture:
    """weights: for a column of the tree its values' weights relative to their siblings, 1 for those not named."""

    tree: tuple[str, ...] = ("domain", "lang", "source")
    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    share: float = 0.5
    total_tokens: int | None = None
    max_epochs: int = 2
    seed: int = 0


def words_and_end(text: Column) -> Column:
    """The default count of tokens: words and one end mark, so at least 1."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long") + 1


def bytes_and_end(text: Column) -> Column:
    """Bytes of UTF-8 and an end: where a byte-level tokenizer packs what is mixed, its tokens follow bytes more closely
    than words across languages."""
    return F.octet_length(text).cast("long") + 1


def _leaf(mixture: Mixture) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"_{k}") for k, c in enumerate(mixture.tree)]


def budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """leaves: _0, _1, ... and _tokens. Adds _budget, the tokens of each leaf, as a whole number.

    Windows run over siblings, which are aggregated rows, not documents.
    """
    levels = [f"_{k}" for k in range(len(mixture.tree))]
    rows = leaves
    weight: list[str] = []
    for k, c in enumerate(mixture.tree):
        w = F.lit(1.0)
        for value, x in mixture.weights.get(c, {}).items():
            w = F.when(F.col(levels[k]) == value, float(x)).otherwise(w)
        rows = rows.withColumn(f"_w{k}", w)
        weight.append(f"_w{k}")
    usable = F.lit(True)
    for w in weight:
        usable = usable & (F.col(w) > 0)
    rows = rows.withColumn("_cap", F.when(usable, F.col("_tokens").cast("double") * mixture.max_epochs).otherwise(0.0))
    everything = rows.agg(F.sum("_tokens").alias("_all"), F.sum("_cap").alias("_most"))
    wanted = F.lit(float(mixture.total_tokens)) if mixture.total_tokens is not None else F.col("_all") * mixture.share
    rows = rows.crossJoin(F.broadcast(everything.select(F.least(wanted, F.col("_most")).alias("_given"))))  # one row
    for k in range(len(levels)):
        parent, own = levels[:k], levels[: k + 1]
        nodes = rows.groupBy(*own, weight[k], "_given").agg(F.sum("_cap").alias("_node_cap"))
        nodes = nodes.withColumn("_ratio", F.when(F.col(weight[k]) > 0, F.col("_node_cap") / F.col(weight[k])).otherwise(F.lit(float("inf"))))
        order = Window.partitionBy(*parent).orderBy("_ratio", levels[k]) if parent else Window.orderBy("_ratio", levels[k])
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.withColumn("_spent", F.coalesce(F.sum("_node_cap").over(before), F.lit(0.0))).withColumn("_rest_w", F.sum(weight[k]).over(after))
        full = (F.col("_rest_w") <= 0) | (F.col("_ratio") <= (F.col("_given") - F.col("_spent")) / F.nullif("_rest_w", F.lit(0.0)))
        nodes = nodes.withColumn("_full", F.coalesce(full, F.lit(True)))
        siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        taken = F.sum(F.when(F.col("_full"), F.col("_node_cap")).otherwise(0.0)).over(siblings)
        open_w = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col(weight[k]))).over(siblings)
        level = (F.col("_given") - taken) / F.nullif(open_w, F.lit(0.0))
        nodes = nodes.withColumn("_next", F.when(F.col("_full"), F.col("_node_cap")).otherwise(F.least(F.col("_node_cap"), F.greatest(F.lit(0.0), F.col(weight[k]) * level))))
        rows = rows.drop("_given").join(nodes.select(*own, F.col("_next").alias("_given")), own)
    return rows.select(*levels, "_tokens", F.floor(F.col("_given") + 1e-6).cast("long").alias("_budget"))


def _digits(text: Column) -> Column:
    """The first 15 hexadecimal digits of a hash."""
    return F.substring(F.md5(text.cast("binary")), 1, 15)


def _key(base: str, mixture: Mixture) -> Column:
    """The place of a row in the order of an epoch: 60 bits of a hash."""
    return F.conv(_digits(F.concat_ws(":", F.col(base), F.lit(mixture.seed), F.col("_epochs"))), 16, 10).cast("long")


def cuts(sizes: DataFrame, leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """leaves: with _budget. For each leaf _epochs, how many whole ones, and _cut: of the next, rows with keys up to it."""
    levels = [f"_{k}" for k in range(len(mixture.tree))]
    # A budget may exceed the tokens there are by the rounding only, so epochs are never more than allowed.
    plan = leaves.withColumn("_epochs", F.floor(F.col("_budget") / F.col("_tokens")).cast("long"))
    plan = plan.withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("_tokens"))
    ends: DataFrame = plan.select(*levels, "_epochs", "_rest")
    small = F.broadcast if leaves.count() <= BROADCAST_LEAVES else lambda x: x
    rows = sizes.join(small(ends), levels).where("_rest > 0").withColumn("_key", _key("_hash", mixture))
    found = plan.where("_rest > 0").select(*levels, "_rest")
    at = levels
    for name, shift in (("_b1", KEY_BITS - BITS), ("_b2", KEY_BITS - 2 * BITS)):
        rows = rows.withColumn(name, F.shiftright("_key", shift))
        sums = rows.groupBy(*at, name).agg(F.sum("_n").alias("_n"))
        order = Window.partitionBy(*levels).orderBy(name)
        sums = sums.join(small(found), at).withColumn("_upto", F.sum("_n").over(order))
        over = sums.where(F.col("_upto") > F.col("_rest"))
        first = over.groupBy(*levels).agg(F.min_by(F.struct(name, *( ["_b1"] if name == "_b2" else []), (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_rest")), name).alias("_s"))
        found = first.select(*levels, *(["_s._b1"] if name == "_b2" else []), f"_s.{name}", "_s._rest")
        at = [*at, name]
        rows = rows.join(small(found.select(*at)), at, "left_semi")
    exact = rows.groupBy(*at, "_key").agg(F.sum("_n").alias("_n")).join(small(found), at)
    exact = exact.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*levels).orderBy("_key")))
    cut = exact.groupBy(*levels).agg(F.max(F.when(F.col("_upto") <= F.col("_rest"), F.col("_key"))).alias("_last"), (F.first("_b2") * F.lit(1 << KEY_BITS - 2 * BITS)).alias("_low"))
    # Where not even the first row of the last range fits, the prefix ends before that range.
    cut = cut.select(*levels, F.coalesce(F.col("_last"), F.col("_low") - 1).alias("_cut"))
    return ends.select(*levels, "_epochs").join(cut, levels, "left")


def mix(docs: DataFrame, mixture: Mixture = Mixture(), tokens=words_and_end, epoch: str | None = "_epoch") -> DataFrame:
    """Rows of docs (doc_id, text and the columns of the tree) as often as they are chosen, with a column epoch, from 0;
    without one, all columns of docs stay and no other, where it is None.

    Null values of a tree's column are one node, a null text is empty, rows of equal doc_id and text are
    chosen together, a node of weight 0 gets nothing, an empty table gives no rows. No budget is exceeded;
    each leaf falls short of its own by less than the next row. All columns are kept, whatever their names, but
    that one of the name epoch is replaced.
    Texts are read twice and never shuffled; a table of hash and token count for each row is written.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if epoch is None or c.lower() != epoch.lower()])
    hash_ = _digits(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_of()))
    levels = [f"_{k}" for k in range(len(mixture.tree))]
    sizes = written(docs.select(*_leaf(mixture), hash_.alias("_hash"), tokens(text_of()).alias("_n")), "mixing-sizes")
    totals = sizes.groupBy(*levels).agg(F.sum("_n").alias("_tokens"))
    leaves = written(budgets(totals, mixture), "mixing-budgets")
    plan = written(cuts(sizes, leaves, mixture), "mixing-cuts")
    small = F.broadcast if plan.count() <= BROADCAST_LEAVES else lambda x: x
    rows = docs.select(kept.alias("_row"), *_leaf(mixture), hash_.alias("_hash")).join(small(plan), levels)
    copies = F.col("_epochs") + F.coalesce(_key("_hash", mixture) <= F.col("_cut"), F.lit(False)).cast("long")
    rows = rows.withColumn("_copies", copies).where("_copies > 0")
    rows = rows.select("_row", F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))).alias("_nth"))
    return rows.select("_row.*", *([] if epoch is None else [F.col("_nth").alias(epoch)]))
