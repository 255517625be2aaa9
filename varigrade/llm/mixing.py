"""Mixing sources to target weights over a tree such as domain - language - source, with DataFrame functions only.

Every node divides its token budget among its children by weight. No child gets more than its subtree can supply
(tokens times epochs); what it can't take goes to its siblings by weight, and a node's own budget is bounded by what its
subtree can supply, so a shortage reaches the parent's siblings only after all siblings are full. Each leaf then takes
the first tokens of a stream of epochs, each epoch in its own seeded order.

The order of a leaf is cut into hash ranges: sums per range, a running sum over the ranges, then a running sum inside each
range. A source that holds most of the corpus is so spread over ``16**digits`` windows per epoch. Texts are read once, for
their token counts, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varigrade.session import materialize

WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_out(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Divide ``budget`` (equal within a parent) over children by ``weight``, at most ``cap`` each: adds ``got``.

    Children in ascending order of cap / weight fill up first. The running sum of the real shares is rounded, so the whole
    numbers add up to the budget.
    """
    order = Window.partitionBy(*parent).orderBy("fill", "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(*parent)
    ranked = children.withColumn("fill", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(0.0))
    ranked = ranked.withColumns({
        "spent": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    ranked = ranked.withColumn("level", F.when(F.col("rest") > 0, (F.col("budget") - F.col("spent")) / F.col("rest"))
                               .otherwise(0.0))
    ranked = ranked.withColumn("full", F.col("fill") <= F.col("level"))
    line = F.max(F.when(~F.col("full"), F.col("level"))).over(group)
    ranked = ranked.withColumn("real", F.when(F.col("full"), F.col("cap").cast("double"))
                               .otherwise(F.col("weight") * line))
    ranked = ranked.withColumn("sum_real", F.sum("real").over(upto))
    rounded = F.floor(F.col("sum_real") + F.lit(1e-6))
    return ranked.withColumn("got", rounded - F.coalesce(F.lag(rounded).over(order), F.lit(0))).drop(
        "fill", "spent", "rest", "level", "full", "real", "sum_real")


def leaf_budgets(leaves: DataFrame, tree: Sequence[str], weights: Sequence[Column], share: float,
                 epochs: int) -> DataFrame:
    """(tree..., supply, budget) from (tree..., supply): tokens each leaf contributes."""
    nodes = leaves.withColumns({f"w_{c}": F.greatest(F.coalesce(w.cast("double"), F.lit(1.0)), F.lit(0.0))
                                for c, w in zip(tree, weights)})
    open_path = F.lit(True)
    for c in tree:
        open_path = open_path & (F.col(f"w_{c}") > 0)
    nodes = nodes.withColumn("cap", F.when(open_path, F.col("supply") * epochs).otherwise(F.lit(0)))
    total = leaves.agg(F.floor(F.coalesce(F.sum("supply"), F.lit(0)) * F.lit(float(share))).alias("whole"))
    given = nodes.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("most")).join(F.broadcast(total)).select(  # one row each
        F.least("whole", "most").alias("budget"))
    shared = None
    for depth, column in enumerate(tree):
        path = list(tree[: depth + 1])
        level = nodes.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first(f"w_{column}").alias("weight"))
        level = level.withColumns({"name": F.col(column), "root": F.lit(0)})
        level = level.join(F.broadcast(given)) if shared is None else level.join(shared, path[:-1])
        shared = share_out(level, ["root", *path[:-1]]).select(*path, F.col("got").alias("budget"))
    return leaves.join(shared, list(tree))


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _place(key: str, seed: int, epoch: Column) -> Column:
    """A document's place in the order of an epoch."""
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), ident).cast("binary"))


def mix_sources(docs: DataFrame, tree: Sequence[str], weights: Sequence[Column], share: float = 0.5, epochs: int = 1,
                seed: int = 0, digits: int = 3, key: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """The chosen documents: key, tree columns, epoch, start (tokens of its leaf before it), n_tokens, taken.

    ``weights`` gives for each level a column over the tree columns, relative to siblings; null counts as 1, and a node
    of weight 0 or less gets nothing. The budget is ``share`` of all tokens, at most what all open leaves can supply. The
    last document of a leaf may be taken in part (``taken < n_tokens``). A null tree value is the empty name. Documents
    without tokens are never chosen. Repeated rows each count. An empty table gives no rows.
    """
    named = docs.select(F.col(key), *[_name(c).alias(c) for c in tree],
                        (word_count("text") if tokens is None else tokens).alias("n_tokens"))
    counted = materialize(named.filter("n_tokens > 0"))
    leaves = counted.groupBy(*tree).agg(F.sum("n_tokens").alias("supply"))
    budgets = materialize(leaf_budgets(leaves, tree, weights, share, epochs)).filter("budget > 0")
    streams = counted.join(budgets, list(tree)).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("budget") - 1) / F.col("supply")).cast("int"))))
    order = _place(key, seed, F.col("epoch"))
    streams = streams.withColumns({"place": order, "range": F.substring(order, 1, digits)})
    path = [*tree, "epoch"]
    sums = streams.groupBy(*path, "range").agg(F.sum("n_tokens").alias("in_range"))
    ahead = Window.partitionBy(*path).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select(*path, "range", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*path, "range").orderBy("place", key, "n_tokens").rowsBetween(
        Window.unboundedPreceding, -1)
    start = (F.col("epoch") * F.col("supply") + F.col("ahead")
             + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = streams.join(ranges, [*path, "range"]).filter(
        F.col("epoch") * F.col("supply") + F.col("ahead") < F.col("budget")).withColumn("start", start)
    return placed.filter(F.col("start") < F.col("budget")).select(
        key, *tree, "epoch", "start", "n_tokens", F.least("n_tokens", F.col("budget") - F.col("start")).alias("taken"))


def keep_mixed(docs: DataFrame, tree: dict[str, Column], weights: Sequence[Column], share: float = 0.5, seed: int = 0,
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that one epoch of ``mix_sources`` chooses, with their own columns only.

    ``tree`` names the levels and gives each a column over ``docs``. A leaf's choice is the head of its order, so one
    limit per leaf tells the chosen rows; texts are filtered where they are read. The document at the limit stays
    whole, and so do all rows of its id.
    """
    levels = list(tree)
    narrow = docs.select(F.col(key), F.col(text).alias("text"), *[c.alias(n) for n, c in tree.items()])
    chosen = mix_sources(narrow, levels, weights, share, 1, seed, key=key)
    limits = chosen.groupBy(*levels).agg(F.max(_place(key, seed, F.lit(0))).alias("_limit")).select(
        "_limit", *[F.col(n).alias(f"_leaf_{n}") for n in levels])
    marked = docs.withColumns({f"_own_{n}": F.coalesce(c.cast("string"), F.lit("")) for n, c in tree.items()})
    same = [F.col(f"_own_{n}") == F.col(f"_leaf_{n}") for n in levels]
    return marked.join(limits, same).filter(
        (_place(key, seed, F.lit(0)) <= F.col("_limit")) & F.col(text).rlike(WORD)).select(*docs.columns)
