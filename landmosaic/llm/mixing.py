"""Mixing sources to target weights: bisected temperature, then budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: Up to so many sources the exponent is bisected in one row; beyond, each halving is a sum over the table of sources.
ONE_ROW = 100_000
#: Halvings of the exponent's interval.
STEPS = 50


def words(text: Column) -> Column:
    """Tokens of a text for the weights: words [^\\x20\\x09-\\x0D]+; null and empty texts have none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def _bisect(too_high) -> Column:
    """The largest exponent in [0, 1] that isn't too high, by halving; too_high is a condition that holds from some exponent on."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        return F.when(too_high(mid), F.struct(acc["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), acc["hi"].alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["lo"]
    return F.when(too_high(F.lit(1.0)), found).otherwise(F.lit(1.0))


def weights(sized: DataFrame, entropy: float = 0.9, repetition: float = 4.0) -> DataFrame:
    """mix_key, docs, tokens, share, exponent, weight, budget of each source; one without tokens has share, weight and budget 0.

    Weights are shares^exponent, normalised. The exponent is the largest in [0, 1] whose weights have at least `entropy`
    times the greatest entropy (ln of the number of sources); where that would repeat a source more than `repetition`
    times while the least repeated one is seen once, it is raised to the least exponent that doesn't. budget is in tokens; the
    scale is such that the least repeated source is seen exactly once, so no document is lost.
    """
    every = written(sized.groupBy("mix_key").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")))
    by_source = every.where("tokens > 0")
    n, total = by_source.agg(F.count("*"), F.sum("tokens")).first()
    p = F.col("tokens").cast("double") / F.lit(float(total or 1))
    if n <= ONE_ROW:
        # the shares in order of size in one row: sums in a fixed order
        row = by_source.agg(F.array_sort(F.collect_list("tokens")).alias("sizes")).select(F.transform("sizes", lambda t: t.cast("double") / F.lit(float(total or 1))).alias("p"))
        fold = lambda f: F.aggregate("p", F.lit(0.0), lambda acc, x: acc + f(x))

        def entropy_of(e: Column) -> Column:
            s = fold(lambda x: F.pow(x, e))
            return F.log(s) - e * fold(lambda x: F.pow(x, e) * F.log(x)) / s

        target = F.log(F.size("p").cast("double")) * F.lit(float(entropy))
        spread = F.array_min("p") / F.array_max("p")
        flat = _bisect(lambda e: entropy_of(e) < target)
        chosen = row.select("p", F.greatest(flat, _limit(spread, repetition)).alias("exponent"))
        one = chosen.select("exponent", fold(lambda x: F.pow(x, F.col("exponent"))).alias("norm"), F.array_max("p").alias("top"))
    else:
        shares = written(by_source.select(p.alias("p")))
        least, most = shares.agg(F.min("p"), F.max("p")).first()

        def sums(e: float) -> tuple[float, float]:
            return shares.agg(F.sum(F.pow("p", F.lit(e))), F.sum(F.pow("p", F.lit(e)) * F.log("p"))).first()

        def low(e: float) -> bool:
            s, t = sums(e)
            return math.log(s) - e * t / s < entropy * math.log(n)

        lo, hi = 0.0, 1.0
        for _ in range(STEPS if low(1.0) else 0):
            lo, hi = (lo, (lo + hi) / 2) if low((lo + hi) / 2) else ((lo + hi) / 2, hi)
        flat = lo if hi < 1 or lo > 0 else 1.0
        one = sized.sparkSession.range(1).select(F.greatest(F.lit(flat), _limit(F.lit(least / most), repetition)).alias("exponent"), F.lit(most).alias("top"))
        norm = sums(one.first()["exponent"])[0]
        one = one.withColumn("norm", F.lit(norm))
    weight = F.pow(p, F.col("exponent")) / F.col("norm")
    scale = F.lit(float(total or 1)) * F.col("top") / (F.pow("top", "exponent") / F.col("norm"))
    has = F.col("tokens") > 0
    budget = F.when(has, F.greatest(F.round(weight * scale), F.lit(1.0))).otherwise(0.0)
    return written(every.crossJoin(F.broadcast(written(one))).select("mix_key", "docs", "tokens", p.alias("share"), "exponent", F.when(has, weight).otherwise(0.0).alias("weight"), budget.alias("budget")))


def _limit(spread: Column, repetition: float) -> Column:
    """The least exponent that repeats no source more than `repetition` times; spread is the least share over the largest."""
    most = F.lit(float(repetition))
    return F.when(F.pow(spread, F.lit(-1.0)) <= most, F.lit(0.0)).otherwise(_bisect(lambda e: F.pow(spread, e - 1) <= most))


def _key() -> Column:
    return F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, mix_key, n_tokens of each document; a null source is a source of its own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _key().alias("mix_key"), words(F.col("text")).alias("n_tokens"))


def _draw(*parts) -> Column:
    return F.md5(F.concat_ws("/", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts)).cast("binary"))


def _dealt(sized: DataFrame, plan: DataFrame, seed: int, block: int) -> DataFrame:
    """sized with tokens, budget, epochs of its source and the block of its document (about `block` documents each, by hash)."""
    last = F.when(F.col("tokens") > 0, F.greatest(F.ceil(F.col("budget") / F.col("tokens")) - 1, F.lit(0))).otherwise(0)
    plan = plan.select("mix_key", F.ceil(F.col("docs") / block).alias("blocks"), "tokens", "budget", F.sequence(F.lit(0).cast("long"), last.cast("long")).alias("epochs"))
    number = F.conv(F.substring(_draw(F.lit(str(seed)), "doc_id"), 1, 8), 16, 10).cast("long")
    return sized.join(small(plan), "mix_key").withColumn("block", F.pmod(number, "blocks"))


def _placed(dealt: DataFrame, seed: int) -> DataFrame:
    """mix_key, block, epoch, begin, in_block, budget: where each block starts in its source's order of blocks, if that is before the budget."""
    sums = dealt.groupBy("mix_key", "block").agg(F.sum("n_tokens").alias("in_block"), F.first("tokens").alias("tokens"), F.first("budget").alias("budget"), F.first("epochs").alias("epochs"))
    sums = sums.withColumn("epoch", F.explode("epochs")).withColumn("turn", _draw(F.lit(str(seed)), "epoch", "mix_key", "block"))
    before = Window.partitionBy("mix_key", "epoch").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("epoch") * F.col("tokens") + F.coalesce(F.sum("in_block").over(before), F.lit(0))
    return written(sums.withColumn("begin", begin).where((F.col("begin") < F.col("budget")) | (F.col("epoch") == 0)).select("mix_key", "block", "epoch", "begin", "in_block", "budget"))


def _copies(dealt: DataFrame, placed: DataFrame, seed: int) -> DataFrame:
    """One row per copy of a document of the placed blocks: its place `at`, and whether it is taken (before the budget, or of the first epoch)."""
    copies = dealt.withColumn("epoch", F.explode("epochs")).join(small(placed.select("mix_key", "block", "epoch", "begin")), ["mix_key", "block", "epoch"]).withColumn("turn", _draw(F.lit(str(seed)), "epoch", "doc_id"))
    inside = Window.partitionBy("mix_key", "epoch", "block").orderBy("turn", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("begin") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return copies.withColumn("at", at).withColumn("taken", (F.col("at") < F.col("budget")) | (F.col("epoch") == 0))


def mixture(docs: DataFrame, entropy: float = 0.9, repetition: float = 4.0, seed: int = 1, block: int = 1024) -> DataFrame:
    """One row per copy of a document in the mixture: doc_id, source, epoch, n_tokens, mix_order (0 to 1).

    Sources are read in epochs, each a fresh permutation of the source's blocks (about `block` documents, dealt by hash)
    and of the documents in each block, until the source's budget of tokens is used up; the document that crosses
    it is the last. mix_order is the share of the budget that lies before a copy, so sorting by it interleaves the sources at
    their weights. Prefix sums go over a source's blocks, then over a block's documents, never over all its documents.

    Every document is there in the first epoch: null text has no tokens and takes no room, and a source without any token
    has one epoch, with mix_order 0. Repeated rows are documents of their own. An empty table gives no rows.
    """
    sized = written(sizes(docs))
    dealt = written(_dealt(sized, weights(sized, entropy, repetition), seed, block))
    copies = _copies(dealt, _placed(dealt, seed), seed).where("taken")
    order = F.when(F.col("budget") > 0, F.col("at") / F.col("budget")).otherwise(0.0)
    return copies.select("doc_id", "source", "epoch", "n_tokens", order.alias("mix_order"))


def mixed(docs: DataFrame, entropy: float = 0.9, repetition: float = 4.0, seed: int = 1, block: int = 1024) -> DataFrame:
    """docs with each row as often as mixture() takes it (rows alike in doc_id and source share their copies evenly, rounded up).

    Only the one block of each source that its budget ends in is looked at document by document; the others are in or out as
    a whole. So the rows of docs meet two small tables (blocks, documents of those last blocks) and aren't shuffled.
    """
    sized = written(sizes(docs))
    plan = weights(sized, entropy, repetition)
    dealt = written(_dealt(sized, plan, seed, block))
    placed = _placed(dealt, seed)
    crossed = (F.col("epoch") > 0) & (F.col("begin") + F.col("in_block") > F.col("budget"))
    whole = written(placed.where(~crossed).groupBy("mix_key", "block").agg(F.count("*").alias("mix_whole")))
    last = written(placed.where(crossed))
    within = dealt.join(small(last.select("mix_key", "block")), ["mix_key", "block"], "left_semi")
    part = _copies(within, last, seed).groupBy("mix_key", "doc_id").agg(F.ceil(F.count_if("taken") / F.count("*")).alias("mix_part"))
    part = written(part.select(F.col("mix_key").alias("part_key"), F.col("doc_id").alias("part_id"), "mix_part"))
    keyed = docs.select(F.struct("*").alias("mix_row"), _key().alias("mix_key"), F.col("doc_id").cast("long").alias("doc_id"))
    keyed = _dealt(keyed, plan, seed, block).select("mix_row", "mix_key", "doc_id", "block")
    keyed = keyed.join(small(whole), ["mix_key", "block"], "left")
    keyed = keyed.join(small(part), (F.col("mix_key") == F.col("part_key")) & F.col("doc_id").eqNullSafe(F.col("part_id")), "left")
    times = F.coalesce("mix_whole", F.lit(0)) + F.coalesce("mix_part", F.lit(0))
    return keyed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("mix_row.*")
