"""Mixing sources to target weights by temperature.

With token shares p_i, source i gets the weight p_i^a / sum p_j^a.  Lowering the
exponent a from 1 flattens the mixture.  a is bisected over [0, 1] for
* a target entropy: the largest a whose weights reach that entropy (in nats), or
* a repetition limit: the least a at which no source needs more epochs than the limit.
The budget (by default the tokens of all documents) is then split by weight and a
source's part is met with *block permutations*: block b is the source's documents
in an order of its own (a hash of row, block and seed).  Every block has its order, and a
row's place in it is the tokens ahead of it: full blocks take every document once, in
their order; the last block takes the longest prefix of its order that stays within what
is left of the source's budget.

Everything is DataFrame expressions.  Token counts are aggregated map-side; the
bisection runs over one row holding the sources' counts (sources are a bounded
list, their rows are not).  The places of a block need running sums: a
block's order is cut into hash ranges, as many as its rows ask for, range totals are
summed, and rows are summed within a range only, so a source with a third of all
rows spreads over all ranges.  Rows that repeat are counted, not listed.

Tokens are white-space separated words.  Nulls: a null text has no words; a null
source is a source of its own.  Documents without words come in every full block
and in a last block's prefix as long as it lasts.  Repeated rows (same id and
text) are one document of that multiplicity: they share their places.  An empty
table gives an empty result.  A source without tokens has weight 0 and no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.llm.common import SPACES, whole
from edgeloom.plans.lineage import cut

STEPS = 60
#: Sources up to which their table is broadcast to the rows.
FEW_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Words of a text: its white space made single, its ends trimmed, and the spaces counted."""
    flat = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " "))
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def _weights(a: Column, shares: Column) -> Column:
    """p^a / sum p^a over an array of shares; a share of 0 keeps 0."""
    raised = F.transform(shares, lambda p: F.when(p > 0, F.pow(p, a)).otherwise(0.0))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def _entropy(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def _epochs(w: Column, shares: Column, scale: Column) -> Column:
    """Most epochs any source needs: its part of the budget over its tokens."""
    return F.aggregate(F.zip_with(w, shares, lambda x, p: F.when(p > 0, x * scale / p).otherwise(0.0)), F.lit(0.0), lambda s, x: F.greatest(s, x))


def source_weights(counts: DataFrame, budget: int | None, entropy: float | None, max_epochs: float | None) -> DataFrame:
    """(source, tokens, weight, exponent, budget) of each source.  counts: (source, tokens)."""
    if (entropy is None) == (max_epochs is None):
        raise ValueError("give a target entropy or a repetition limit")
    if max_epochs is not None and max_epochs < 1 and budget is None:
        raise ValueError("a repetition limit below 1 can't fill the budget")
    one = counts.agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("all"), F.sum("tokens").alias("total"))
    one = one.where("total > 0").withColumn("shares", F.transform("all", lambda x: x["tokens"] / F.col("total")))
    one = one.withColumn("budget", F.lit(budget).cast("bigint") if budget is not None else F.col("total"))
    scale = F.col("budget") / F.col("total")

    def step(state: Column, _: Column) -> Column:
        a = (state["low"] + state["high"]) / 2
        w = _weights(a, F.col("shares"))
        # The entropy falls and the epochs fall as a grows.
        fits_low = _entropy(w) >= F.lit(float(entropy)) if entropy is not None else _epochs(w, F.col("shares"), scale) > F.lit(float(max_epochs))
        return F.struct(F.when(fits_low, a).otherwise(state["low"]).alias("low"), F.when(fits_low, state["high"]).otherwise(a).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    # The side of the last interval that meets the target; a = 0 where even equal weights respect a limit.
    if entropy is not None:
        a = found["low"]
    else:
        a = F.when(_epochs(_weights(F.lit(0.0), F.col("shares")), F.col("shares"), scale) <= F.lit(float(max_epochs)), 0.0).otherwise(found["high"])
    one = one.withColumn("exponent", a).withColumn("weights", _weights(F.col("exponent"), F.col("shares")))
    rows = one.select(F.explode(F.arrays_zip("all", "weights")).alias("x"), "exponent", "budget")
    return rows.select(F.col("x.all.source").alias("source"), F.col("x.all.tokens").alias("tokens"), F.col("x.weights").alias("weight"), "exponent", F.floor(F.col("x.weights") * F.col("budget")).alias("budget"))


def order_key(row: Column, block: Column, seed: int) -> Column:
    """A row's place in a block's permutation: 32 hex digits that any SQL engine can make."""
    return F.md5(F.concat_ws(":", row.cast("string"), block.cast("string"), F.lit(str(seed))))


def _beside(weights: DataFrame) -> DataFrame:
    """The sources' table for a join with rows: broadcast while it is small, else Spark joins by source and splits hot ones."""
    return F.broadcast(weights) if weights.count() <= FEW_SOURCES else weights


def block_plan(weights: DataFrame) -> DataFrame:
    """(s, tokens, weight, exponent, full, left) of each source: its full blocks and the tokens left for the last one."""
    plan = weights.where("tokens > 0").withColumn("full", F.floor(F.col("budget") / F.col("tokens"))).withColumn("left", F.col("budget") - F.col("full") * F.col("tokens"))
    return plan.select(F.col("source").alias("s"), "tokens", "weight", "exponent", "full", "left")


def ordered(joined: DataFrame, seed: int, ranges: int) -> DataFrame:
    """The kinds of documents of each block's order, with key, before and taken.

    joined: kinds (source, row, mark, n_tokens, m: distinct documents and how often each
    comes) with a block and its room in tokens.  before: tokens of the order ahead of the
    kind's first place; taken: how many of its m places the block gives.  After the first
    kind that isn't taken whole there is room for none.
    """
    part = joined.withColumn("key", order_key(F.col("row"), F.col("block"), seed))
    part = part.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * F.lit(ranges), 32))
    tokens = F.col("m") * F.col("n_tokens")
    totals = part.groupBy("source", "block", "range").agg(F.sum(tokens).alias("t"))
    ahead = totals.select("source", "block", "range", (F.sum("t").over(Window.partitionBy("source", "block").orderBy("range")) - F.col("t")).alias("ahead"))
    order = Window.partitionBy("source", "block", "range").orderBy("key", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = part.withColumn("within", F.sum(tokens).over(order) - tokens)
    same = part["source"].eqNullSafe(ahead["source"]) & (part["block"] == ahead["block"]) & (part["range"] == ahead["range"])
    placed = part.join(ahead, same).select(*[part[c] for c in part.columns if c != "range"], "ahead").withColumn("before", F.col("ahead") + F.col("within"))
    room = F.col("room") - F.col("before")
    fits = F.when(room < 0, 0).when(F.col("n_tokens") == 0, F.col("m")).otherwise(F.least(F.col("m"), F.floor(room / F.col("n_tokens"))))
    return placed.withColumn("taken", fits.cast("bigint")).drop("ahead", "within")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float | None = None, max_epochs: float | None = None, budget: int | None = None, seed: int = 17, range_rows: int = 50_000, carry: bool = False, places: bool = False) -> DataFrame:
    """The mixture: one row per place of a document.

    Columns: the id, source, block (0, 1, ... within its source), n_tokens, weight
    and exponent, before (tokens ahead in the block's order) and full (is the block one
    that takes all documents); with ``carry``, all columns of ``docs`` instead, and with
    ``places``, these as a struct ``doc`` beside source, block and place, by which a block's
    rows are in order.  range_rows: rows of a range of a block's order, which one task sums.
    Of rows that repeat id, source and text, of which a last block takes only some,
    ``carry`` gives one's columns as often as the block has places.
    """
    source, row, text = F.col(source_col).cast("string"), F.coalesce(F.col(id_col).cast("bigint").cast("string"), F.lit("null")), F.col(text_col).cast("string")
    # Words are counted once; the permutation needs no text.  Rows that repeat are one kind, reduced map-side.
    slim = docs.select(source.alias("source"), F.col(id_col).cast("bigint").alias("doc_id"), n_words(text).alias("n_tokens"), row.alias("row"), F.xxhash64(text).alias("mark"))
    kinds = cut(slim.groupBy(*slim.columns).agg(F.count("*").alias("m")), "tokens")
    counts = cut(kinds.groupBy("source").agg(F.sum(F.col("m") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("kinds")), "counts")
    ranges = max(1, -(-(counts.agg(F.sum("kinds")).first()[0] or 0) // range_rows))
    weights = cut(source_weights(counts, budget, entropy, max_epochs), "weights")
    plan = cut(block_plan(weights), "plan")
    joined = kinds.join(_beside(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    zero = F.lit(0).cast("bigint")
    if not carry:
        every = joined.withColumn("block", F.explode(F.sequence(zero, F.col("full")))).withColumn("whole", F.col("block") < F.col("full"))
        every = every.withColumn("room", F.when(F.col("whole"), F.col("tokens")).otherwise(F.col("left"))).where("whole or left > 0")
        met = ordered(every, seed, ranges).where("taken > 0").withColumn("copy", F.explode(F.sequence(zero, F.col("taken") - 1))).withColumn("before", F.col("before") + F.col("copy") * F.col("n_tokens"))
        return met.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "block", "n_tokens", F.round("weight", 9).alias("weight"), F.round("exponent", 9).alias("exponent"), "before", F.col("whole").alias("full"))
    last = ordered(joined.where("left > 0").withColumn("block", F.col("full")).withColumn("room", F.col("left")), seed, ranges)
    # A last block ends at the first kind it does not take whole; that place, one for each source, is all that comes back, and documents do not move.
    stop = last.where("taken < m").groupBy("source").agg(F.min(F.struct("key", "mark", "taken")).alias("stop")).select(F.col("source").alias("e"), "stop")
    ends = cut(plan.join(stop, F.col("s").eqNullSafe(F.col("e")), "left").select("s", "full", "left", "stop"), "ends")
    rows = docs.select(source.alias("source"), row.alias("row"), F.xxhash64(text).alias("mark"), whole(docs).alias("doc"))
    met = rows.join(_beside(ends), F.col("source").eqNullSafe(F.col("s"))).withColumn("place", F.struct(order_key(F.col("row"), F.col("full"), seed).alias("key"), "mark"))
    end = F.struct(F.col("stop.key").alias("key"), F.col("stop.mark").alias("mark"))
    copies = F.col("full") + F.when((F.col("left") > 0) & (F.col("stop").isNull() | (F.col("place") < end)), 1).otherwise(0)
    shown = ["doc", "source", "block", order_key(F.col("row"), F.col("block"), seed).alias("place")] if places else ["doc.*"]
    every = met.where(copies > 0).withColumn("block", F.explode(F.sequence(zero, copies - 1))).select(*shown)
    if ends.where("stop.taken > 0").isEmpty():
        return every
    some = met.where((F.col("stop.taken") > 0) & (F.col("place") == end)).groupBy("source", "row", "mark").agg(F.first("doc").alias("doc"), F.first("stop.taken").alias("taken"), F.first("full").alias("block"))
    return every.unionByName(some.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("taken")))).select(*shown))


def even_entropy(n: int) -> float:
    """The entropy of n equal weights, the most a target can be."""
    return math.log(n)
