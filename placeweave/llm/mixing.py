"""Mixing sources to target weights: hierarchical budgets, then seeded token prefixes; built-in functions only.

The token budget flows down a tree domain -> language -> source by weight. A child that cannot use its share (its
tokens times the number of epochs allowed) keeps what it can, and the rest goes to its siblings by weight; only what
a whole subtree cannot use passes to the subtree's own siblings. A leaf then takes whole epochs and, of one more
seeded shuffle, the longest prefix whose tokens fit.

Defined results: a null domain, language or source goes by the name ``null``; weights not named are 1 and may be 0,
which selects nothing; texts without tokens cost nothing and follow their leaf's epochs, and a leaf without any token
selects nothing; texts of any length are counted whole; rows with one id, or none, are in the order of a hash of the
row; equal rows share one decision; an empty table gives an empty table. Other columns pass through under any names;
those called m_domain, m_lang, m_source, mix_tokens and epochs are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.shared import materialize, numbered, packed, row_hash, running_offsets, unpacked
from placeweave.llm.sharding import shuffle_key

LEVELS = ["m_domain", "m_lang", "m_source"]
BIG = "decimal(38,0)"


def word_tokens(text: Column) -> Column:
    """The default token count: words of text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds budget to children (parent columns, name, w > 0, cap, and parent_budget up to the sum of caps).

    Children in the order of cap / w fill up first; child i is full if the level at which it fills costs no more
    than the budget. The others share what is left by weight: floors, then one more by largest remainder, then name.
    """
    order = [F.col("cap") / F.col("w"), F.col(name)]
    w = Window.partitionBy(*parent).orderBy(*order)
    big = lambda c: F.col(c).cast(BIG)
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    out = children.withColumns({"_c": F.sum("cap").over(upto), "_w": F.coalesce(F.sum("w").over(after), F.lit(0))})
    out = out.withColumn("_full", (big("_c") * big("w")).cast(BIG) + (big("cap") * big("_w")).cast(BIG) <= (big("parent_budget") * big("w")).cast(BIG))
    all_of = Window.partitionBy(*parent)
    out = out.withColumns({
        "_left": F.col("parent_budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(all_of),
        "_open": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("w"))).over(all_of), F.lit(1)),
    })
    share = (big("w") * big("_left")).cast(BIG)
    out = out.withColumns({"_floor": F.expr(f"cast(cast(w as {BIG}) * cast(_left as {BIG}) as {BIG}) div _open").cast("long"), "_rest": (share % big("_open")).cast(BIG)})
    out = out.withColumn("_floor", F.when(F.col("_full"), F.col("cap")).otherwise(F.col("_floor")))
    spare = F.col("parent_budget") - F.sum("_floor").over(all_of)
    turn = F.row_number().over(Window.partitionBy(*parent, "_full").orderBy(F.desc("_rest"), F.col(name)))
    out = out.withColumn("_spare", spare).withColumn("_turn", turn)
    extra = F.when(~F.col("_full") & (F.col("_turn") <= F.col("_spare")), 1).otherwise(0)
    return out.withColumn("budget", (F.col("_floor") + extra).cast("long")).select(*children.columns, "budget")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: Mapping[str, int], max_epochs: int) -> DataFrame:
    """leaves: m_domain, m_lang, m_source, tokens. Adds budget. weights: by path, like ``web``, ``web/en``, ``web/en/a``."""
    known = F.create_map(*[F.lit(x) for item in weights.items() for x in item]) if weights else None

    def weight(*path: str) -> Column:
        return F.coalesce(F.get(F.array(known), F.lit(0))[F.concat_ws("/", *path)], F.lit(1)).cast("long") if weights else F.lit(1).cast("long")

    leaves = leaves.withColumns({"w3": weight(*LEVELS), "w2": weight(*LEVELS[:2]), "w1": weight(*LEVELS[:1]), "cap": F.col("tokens") * max_epochs})
    live = leaves.where("w1 > 0 and w2 > 0 and w3 > 0 and cap > 0")
    langs = live.groupBy(*LEVELS[:2]).agg(F.sum("cap").alias("cap"), F.max("w2").alias("w"), F.max("w1").alias("w1"))
    domains = langs.groupBy(*LEVELS[:1]).agg(F.sum("cap").alias("cap"), F.max("w1").alias("w"))
    root = domains.agg(F.sum("cap").alias("all"))
    domains = domains.crossJoin(F.broadcast(root)).withColumn("parent_budget", F.least(budget.cast("long"), F.col("all"))).drop("all")  # one row
    domains = water_fill(domains, [], LEVELS[0]).select(LEVELS[0], F.col("budget").alias("parent_budget"))
    langs = water_fill(langs.drop("w1").join(domains, LEVELS[0]), LEVELS[:1], LEVELS[1]).select(*LEVELS[:2], F.col("budget").alias("parent_budget"))
    under = live.select(*LEVELS, "tokens", "cap", F.col("w3").alias("w")).join(langs, LEVELS[:2])
    return water_fill(under, LEVELS[:2], LEVELS[2]).select(*LEVELS, "tokens", "budget")


def mix_sources(
    docs: DataFrame, domain: Column, lang: Column, source: Column, weights: Mapping[str, int], budget_percent: int,
    max_epochs: int = 1, seed: int = 29, id_col: str = "doc_id", n_tokens: Column | None = None,
) -> DataFrame:
    """Adds m_domain, m_lang, m_source, mix_tokens and epochs: how often each row is taken (0: not at all).

    The budget is budget_percent of all tokens in docs.
    """
    row = packed(docs)
    named = {c: F.coalesce(v.cast("string"), F.lit("null")) for c, v in zip(LEVELS, (domain, lang, source), strict=True)}
    tokens = word_tokens(F.col("text")) if n_tokens is None else n_tokens
    own = {"id": F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), "row_hash": row_hash(docs), "mix_tokens": F.coalesce(tokens, F.lit(0)).cast("long")}
    rows = docs.select(row.alias("row"), *[v.alias(k) for k, v in (own | named).items()])
    # Equal rows are one from here on; a row's hash covers all of its columns, the id and the leaf among them.
    slim = rows.groupBy("id", "row_hash", *LEVELS).agg(F.sum("mix_tokens").alias("tokens"))
    slim = materialize(slim, "mix-tokens")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    total = slim.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]  # one number
    budgets = leaf_budgets(leaves, F.lit(total * budget_percent // 100), weights, max_epochs)
    shares = budgets.select(*LEVELS, F.expr("budget div tokens").alias("whole"), (F.col("budget") % F.col("tokens")).alias("part"))
    taken = slim.join(shares, LEVELS).withColumn("h", shuffle_key(seed, F.col("whole") + 1, F.col("id")))
    # A leaf's rows in the order of the shuffle lie in one task after another: sums within tasks, then of tasks.
    ranked = numbered(taken, *LEVELS, "h", "row_hash")
    sums = materialize(ranked.groupBy(*LEVELS, "task").agg(F.sum("tokens").alias("task_tokens")), "mix-tasks")
    sums = running_offsets(sums, LEVELS, ["task"], "task_tokens").drop("task_tokens")
    so_far = F.sum("tokens").over(Window.partitionBy(*LEVELS, "task").orderBy("at"))
    epochs = F.col("whole") + F.when(F.col("before") + so_far <= F.col("part"), 1).otherwise(0)
    chosen = materialize(ranked.join(sums, [*LEVELS, "task"]).select("id", "row_hash", epochs.cast("int").alias("epochs")), "mix-chosen")
    out = rows.join(chosen, ["id", "row_hash"], "left")
    return out.select(*unpacked(F.col("row"), docs.columns, (*LEVELS, "mix_tokens", "epochs")), *LEVELS, "mix_tokens", F.coalesce("epochs", F.lit(0)).alias("epochs"))
