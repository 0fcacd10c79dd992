"""Mixing sources to target weights, by hierarchical budgets.

Sources hang in a tree domain > language > source.  The token budget is dealt
from the root: the children of a node get shares in proportion to their weights
but never more than their documents give in ``max_epochs`` passes; what a child
cannot take goes to its siblings first, and only what a whole node cannot take
goes to the node's own siblings.  A node can take what its children can, and a
child of weight 0 can take nothing, so a shortage below always reaches the
siblings above.  Each node's shares are one water level, found by prefix sums over
its children sorted by capacity for weight; children of equal capacity and weight
are one row there.  The capacities of a node's children add up to no more than all
tokens T times ``max_epochs``, so even a node with millions of children has at most
about sqrt(2 T ``max_epochs``) such rows a weight.  Levels are compared as exact
fractions.

A leaf then runs through its documents in seeded orders, one an epoch: all of
them for each full epoch, and of the last epoch the longest beginning whose
tokens fit.  The cut of the last epoch is one key for each leaf: tokens are
summed by slice of the key space, the slice that holds the cut is found digit by
digit, and only its keys are ordered.  Rows are never gathered by leaf: the plan
is broadcast, and beyond the bound of a broadcast only its hot leaves are.

Only DataFrame operations are used.  Tokens are white-space separated words.

Defined results: null text has no token, texts of any length count whole; null
domain, language or source are leaves of their own, named ``?``; weights that
are missing or null count 1, those below 0 count 0, those that are no integers
are an error, and of several for a node the largest counts; a weight of 0 takes
nothing, and a node whose children all weigh 0 takes nothing; rows that repeat
an id share its place and stay or go together, and so do those without an id of
the same text; an empty table gives an empty table; the other columns of
``docs`` pass through, but for columns called ``epoch`` or ``mix_tokens``, which
give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import columns_of, gathered, is_light, settle, words_column

SEED = 2024
MAX_EPOCHS = 4
#: Hexadecimal digits of the key that name a slice (65,536 slices a leaf).
SLICE_DIGITS = 4
#: Rows above which a leaf's plan is broadcast though the whole plan is not; there are no more such leaves than rows / HOT_ROWS.
HOT_ROWS = 1_000_000

LEVELS = ("domain", "language", "origin")


def place(name: Column, epoch: Column, seed: int) -> Column:
    """Sort key of a document in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name).cast("binary"))


def domain_of(source: Column) -> Column:
    """Domain of a source: its name without the last digit."""
    return F.regexp_replace(source, "[0-9]$", "")


def checked_weights(weights: DataFrame) -> DataFrame:
    """(domain, language, origin, weight) with one row for each path; a row that is none is an error."""
    domain, language, source = (F.col(c).cast("string") for c in ("domain", "language", "source"))
    given = F.col("weight").cast("double")
    fault = F.when(domain.isNull() | language.isNull() & source.isNotNull(), F.lit("a weight names a domain, a language of it, or a source of both")).when(given != F.floor(given), F.concat(F.lit("weights must be integers, scale them: "), given.cast("string")))
    if bad := weights.select(fault.alias("fault")).filter("fault is not null").head(1):
        raise ValueError(bad[0].fault)
    named = weights.select(domain.alias("domain"), language.alias("language"), source.alias("origin"), F.greatest(F.col("weight").cast("long"), F.lit(0)).alias("weight"))
    return gathered(settle(named.groupBy(*LEVELS).agg(F.max("weight").alias("weight")), "weights"))


def _weighed(nodes: DataFrame, weights: DataFrame | None, depth: int) -> DataFrame:
    """Adds the weight of each node at ``depth``, looked up by its whole path; ``cap`` is 0 where the weight is."""
    keys = list(LEVELS[:depth])
    if weights is None:
        return nodes.withColumn("weight", F.lit(1).cast("long"))
    kind = weights.filter(" and ".join([f"{k} is not null" for k in keys] + [f"{k} is null" for k in LEVELS[depth:]])).select(*keys, "weight")
    found = nodes.join(kind, keys, "left").withColumn("weight", F.coalesce("weight", F.lit(1)).cast("long"))
    return found.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0).cast("long"))


def deal(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget`` to children (parent, cap, weight, pot): the water level ``num / den`` of their parent's ``pot``."""
    wide = lambda x: x.cast("decimal(19,0)")
    alike = nodes.filter("cap > 0").groupBy(*parent, "cap", "weight").agg(F.max("pot").alias("pot"), F.sum("cap").alias("caps"), F.sum("weight").alias("weights"))
    # each parent's distinct (cap, weight) rows, see above; full are those before the first that holds the level
    ranked = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), "cap")
    below = F.coalesce(F.sum("caps").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rising = alike.withColumns({"num": F.greatest(F.col("pot") - below, F.lit(0)), "den": F.sum("weights").over(ranked.rowsBetween(0, Window.unboundedFollowing))})
    holds = wide(F.col("num")) * wide(F.col("weight")) <= wide(F.col("cap")) * wide(F.col("den"))
    level = rising.filter(holds).groupBy(*parent).agg(F.min_by(F.struct("num", "den"), F.struct(F.col("cap") / F.col("weight"), F.col("cap"))).alias("level"))
    share = F.expr("cast(level.num as decimal(19,0)) * cast(weight as decimal(19,0)) div level.den")
    budget = F.when(F.col("cap") <= 0, 0).otherwise(F.least(F.col("cap"), F.coalesce(share, F.col("cap"))))
    return nodes.join(level, parent, "left").withColumn("budget", budget.cast("long")).drop("level")


def leaf_budgets(leaves: DataFrame, budget: int | None, weights: DataFrame | None, max_epochs: int) -> DataFrame:
    """The leaves (domain, language, origin, tokens, ...) with their ``budget``."""
    tree = [_weighed(leaves.withColumn("cap", F.col("tokens") * max_epochs), weights, 3)]
    for depth in (2, 1):
        tree.insert(0, _weighed(tree[0].groupBy(*LEVELS[:depth]).agg(F.sum("cap").alias("cap")), weights, depth))
    pot = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] if budget is None else budget
    held = tree[0].select(F.lit("root").alias("root"), "*", F.lit(pot).cast("long").alias("pot"))
    for depth, parent in ((1, ["root"]), (2, ["domain"]), (3, ["domain", "language"])):
        dealt = deal(held, parent)
        if depth < 3:
            held = tree[depth].join(dealt.select(*LEVELS[:depth], F.col("budget").alias("pot")), list(LEVELS[:depth]))
    return dealt.drop("pot", "cap", "weight")


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` joined to the settled ``plan`` on their leaf; no leaf's rows meet in one task."""
    leaf = list(LEVELS)
    if is_light(plan):
        return rows.join(F.broadcast(plan), leaf)
    hot = plan.filter(F.col("held") > HOT_ROWS)
    cold = rows.join(F.broadcast(hot.select(*leaf)), leaf, "left_anti").join(plan.filter(F.col("held") <= HOT_ROWS), leaf)
    return rows.join(F.broadcast(hot), leaf).unionByName(cold)


def _cuts(last: DataFrame) -> DataFrame:
    """(leaf, cut) from (leaf, key, tokens, rest): the first key of a leaf that no longer fits; none where all do."""
    leaf = list(LEVELS)
    slices = gathered(settle(last.groupBy(*leaf, F.substring("key", 1, SLICE_DIGITS).alias("slice")).agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest")), "slices"))
    edge = None
    for depth in range(1, SLICE_DIGITS + 1):
        part = slices.withColumn("up", F.substring("slice", 1, depth - 1)).withColumn("slice", F.substring("slice", 1, depth))
        part = part.withColumn("before", F.lit(0).cast("long")) if edge is None else part.join(edge, [*leaf, "up"])
        each = part.groupBy(*leaf, "slice").agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"), F.max("before").alias("before"))
        # at most 16 digits a leaf
        upto = F.col("before") + F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
        edge = each.withColumn("upto", upto).filter("upto > rest and upto - tokens <= rest").select(*leaf, F.col("slice").alias("up"), (F.col("upto") - F.col("tokens")).alias("before"))
    edge = edge.withColumnRenamed("up", "slice")
    keys = last.withColumn("slice", F.substring("key", 1, SLICE_DIGITS)).join(edge, [*leaf, "slice"]).groupBy(*leaf, "key").agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    return keys.withColumn("upto", upto).groupBy(*leaf).agg(F.min(F.when(F.col("upto") > F.col("rest"), F.col("key"))).alias("cut"))


def mix(docs: DataFrame, weights: DataFrame | None = None, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: str | None = None) -> DataFrame:
    """All columns of ``docs`` and (epoch, mix_tokens), one row for each copy taken.

    ``weights`` has (domain, language, source, weight): the integer weight of the
    node at that path among its siblings, inner nodes with null below; ``budget``
    is in tokens (the tokens there are when None); ``domain`` names a column of
    ``docs`` (else it is derived from the source)."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    used = ("doc_id", "text", "lang", "source", *([domain] if domain else []))
    at = dict(zip(used, columns_of(names, *used), strict=True))
    filled = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    text, source = at["text"].cast("string"), at["source"].cast("string")
    name = F.coalesce(at["doc_id"].cast("string"), F.concat(F.lit("?"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    rows = plain.select("*", name.alias("name"), filled(at[domain] if domain else domain_of(source)).alias("domain"), filled(at["lang"]).alias("language"), filled(source).alias("origin"), F.coalesce(words_column(text), F.lit(0)).cast("long").alias("tokens"))
    leaf = list(LEVELS)
    weights = None if weights is None else checked_weights(weights)
    thin = settle(rows.select("name", *leaf, "tokens"), "tokens")
    leaves = thin.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("held"))
    budgets = leaf_budgets(gathered(settle(leaves, "leaves")), budget, weights, max_epochs).withColumnRenamed("tokens", "__all")
    some = F.col("__all") > 0
    plan = settle(budgets.select(*leaf, "held", F.when(some, F.expr("budget div __all")).otherwise(0).cast("int").alias("full"), F.when(some, F.col("budget") % F.col("__all")).otherwise(0).cast("long").alias("rest")), "plan")

    last = _planned(thin, plan).filter("rest > 0").withColumn("key", place(F.col("name"), F.col("full"), seed)).select(*leaf, "key", "tokens", "rest")
    # without a cut the whole order fits: every key comes before "g"
    final = settle(plan.join(_cuts(last), leaf, "left").withColumn("cut", F.when(F.col("rest") > 0, F.coalesce("cut", F.lit("g")))), "cuts")
    partial = F.coalesce(place(F.col("name"), F.col("full"), seed) < F.col("cut"), F.lit(False))
    copies = F.col("full") + F.when(partial, 1).otherwise(0)
    each = _planned(rows, final).filter(copies > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    kept = [F.col(f"__c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in ("epoch", "mix_tokens")]
    return each.select(*kept, F.col("__epoch").alias("epoch"), F.col("tokens").alias("mix_tokens"))
