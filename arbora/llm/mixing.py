"""Mixing sources to target weights, by budgets on a tree of domains, languages and sources.

The root's budget is shared by weight among its children, theirs among their children, and
so on to the leaves. What a child can't use, because its documents times the most epochs
are fewer, goes to its siblings; a parent gets no more than its leaves can use, so only
what all siblings together can't use goes to the parent's siblings. Everything is counted
in whole tokens, with exact integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import WORD, stored, text_or_empty
from arbora.runtime import BROADCAST_ROWS

MAX_EPOCHS = 2
SEED = 7
# Hex digits of a document's place in an epoch by which its leaf is summed: 4,096 ranges.
RANGE_DIGITS = 3

Weights = dict[tuple[int, str], int]


def word_count(text: str = "text") -> Column:
    """Tokens of a text, here its words; a null text has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def shared(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share ``budget`` of each parent among rows ``(*parent, name, capacity, weight)``.

    Water filling: in the order of capacity over weight, a child is full if its share of
    what is left exceeds its capacity. The others share the rest by weight, rounded down;
    tokens lost by rounding go one each to the first names. Replaces ``budget``.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("capacity") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    wide = "decimal(38,0)"
    step = children.select(
        "*",
        F.coalesce(F.sum("capacity").over(order), F.lit(0)).alias("caps_before"),
        (F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(order), F.lit(0))).alias("weights_left"),
    )
    left = (F.col("budget") - F.col("caps_before")).cast(wide)
    full = F.col("capacity").cast(wide) * F.col("weights_left") <= left * F.col("weight")
    step = step.withColumn("full", full)
    step = step.select(
        *children.columns, "full",
        (F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(by)).alias("rest"),
        F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(by).alias("weights"),
    )
    part = F.expr("case when full then capacity else cast((cast(weight as decimal(38,0)) * rest) div weights as bigint) end")
    step = step.withColumn("part", part)
    lost = F.col("budget") - F.sum("part").over(by)
    rank = F.sum(F.when(F.col("full"), 0).otherwise(1)).over(by.orderBy(name))
    extra = (~F.col("full") & (rank <= lost)).cast("bigint")
    rest = [c for c in children.columns if c != "budget"]
    return step.select(*rest, (F.col("part") + extra).alias("budget"))


def leaf_budgets(leaves: DataFrame, path: list[str], weights: Weights, percent: int, epochs: int) -> DataFrame:
    """``(*path, tokens, budget)`` for leaves ``(*path, tokens)``.

    ``percent`` of all tokens is the root's budget. Nodes without a weight have weight 1.
    """
    if any(w < 1 for w in weights.values()) or epochs < 1 or percent < 0:
        raise ValueError("weights and epochs must be at least 1, the percentage at least 0")
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budgets = leaves.sparkSession.range(1).select(
        F.lit(0).alias("root"), F.lit(min(total * percent // 100, total * epochs)).cast("bigint").alias("budget")
    )
    for depth, name in enumerate(path):
        parent, own = path[:depth], path[: depth + 1]
        nodes = leaves.groupBy(*own).agg(F.sum("capacity").alias("capacity"))
        weight = F.lit(1)
        for (level, value), w in weights.items():
            weight = F.when(F.col(name) == value, F.lit(w)).otherwise(weight) if level == depth else weight
        nodes = nodes.withColumn("weight", weight.cast("bigint")).withColumn("root", F.lit(0))
        nodes = nodes.join(budgets, parent or ["root"])
        budgets = stored(shared(nodes, parent or ["root"], name).select(*own, "budget"))
    return leaves.select(*path, "tokens").join(budgets, path)


def place_in_epoch(seed: int, epoch: Column, id: str) -> Column:
    """Hex digest by which a leaf's documents are ordered in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col(id).cast("string")).cast("binary"))


def mix(
    docs: DataFrame,
    path: dict[str, Column],
    weights: Weights,
    percent: int = 100,
    epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc, node, epoch, n_tokens, tokens_used)``: one row per use of a document.

    ``doc`` holds the columns of ``docs``, ``node`` those of ``path``: the names of a
    document's leaf, from the root down (null and empty names are one). A leaf uses its
    documents in seeded order, epoch after epoch, until its budget is met; the last one may
    count in part (``tokens_used``). Rows that repeat an id have one place and are ordered
    by their tokens. A leaf without tokens has no budget, so nothing of it is used; nor is
    anything of an empty table.

    Texts are not shuffled but for the one range of a leaf's order in which its budget ends.
    """
    names = [f"__{n}" for n in path]
    row = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col(id).cast("string").alias("__id"), word_count(text).alias("n_tokens"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, path.values())],
    )
    narrow = stored(row.drop("doc"))
    leaves = narrow.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    depths = {(level, name): w for (level, name), w in weights.items()}
    leaves = leaf_budgets(stored(leaves), names, depths, percent, epochs).where("budget > 0")
    leaves = stored(
        leaves.select(*names, (F.expr("budget div tokens")).alias("rounds"), (F.col("budget") % F.col("tokens")).alias("rest"))
    )
    small = leaves.count() <= BROADCAST_ROWS
    known = F.broadcast(leaves) if small else leaves
    digest = place_in_epoch(seed, F.col("rounds"), "__id")
    ranges = narrow.join(known, names).withColumn("range", F.substring(digest, 1, RANGE_DIGITS))
    ranges = ranges.groupBy(*names, "range").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    before = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = ranges.where("before < rest and before + n >= rest").select(*names, "range", "before")
    plan = stored(leaves.join(ends, names, "left"))
    known = F.broadcast(plan) if small else plan
    rows = row.join(known, names).withColumn("digest", digest)
    place = F.substring("digest", 1, RANGE_DIGITS)
    node = F.struct(*[F.col(n).alias(p) for n, p in zip(names, path)])
    whole_rounds = F.when(F.col("rounds") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("rounds") - 1))
    whole_rounds = F.coalesce(whole_rounds, F.array().cast("array<bigint>"))
    last = F.when((F.col("rest") > 0) & (place < F.col("range")), F.array("rounds"))
    used = F.concat(whole_rounds, F.coalesce(last, F.array().cast("array<bigint>")))
    whole = rows.select("doc", node.alias("node"), F.explode(used).alias("epoch"), "n_tokens")
    whole = whole.withColumn("tokens_used", F.col("n_tokens"))
    ending = rows.where((F.col("rest") > 0) & (place == F.col("range")))
    order = Window.partitionBy(*names).orderBy("digest", "__id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    ending = ending.withColumn("start", start).where("start < rest")
    part = ending.select(
        "doc", node.alias("node"), F.col("rounds").alias("epoch"), "n_tokens",
        F.least(F.col("n_tokens"), F.col("rest") - F.col("start")).alias("tokens_used"),
    )
    return whole.unionByName(part)


# How the documents table is laid out as a tree: a source's domain by its number, and the
# weights of domains (depth 0) and languages (depth 1). Sources weigh the same.
DOMAINS = ("web", "news", "books")
WEIGHTS: Weights = {
    (0, "web"): 5, (0, "news"): 3, (0, "books"): 2, (1, "en"): 4, (1, "de"): 2, (1, "fr"): 2, (1, "es"): 2,
}


def document_tree(source: str = "source", lang: str = "lang") -> dict[str, Column]:
    number = F.regexp_extract(F.col(source), r"(\d+)$", 1).try_cast("bigint") % len(DOMAINS)
    domain = F.lit("")
    for i, name in enumerate(DOMAINS):
        domain = F.when(number == i, F.lit(name)).otherwise(domain)
    return {"domain": domain, "lang": F.col(lang), "source": F.col(source)}


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix of ``document_tree`` uses them, with all columns."""
    return mix(docs, document_tree(), WEIGHTS).select("doc.*")
