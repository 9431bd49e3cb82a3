"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Sources by code point (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at
three times its source's size and the excess is shared anew by weight. Words are handed out in
blocks of equal size: blocks go to sources, then within a source to shards of its documents, each
time by the highest quotients value / (2 k + 1). A source has as many shards as its own words fill
with many blocks. What is over three times a shard goes to the source's shards that have room, so a
source gets its blocks whole. In a shard, documents stand in an order seeded by a hash; its quota
takes the whole shard as often as it fits (three times at most), then blocks from the front of that order.

Only quotients near the last one that gets a block are compared: what surely gets one is counted
by rounding. So the work depends on the numbers of sources and shards, not on that of blocks.

Cases: a null text has size 0; a source without words gets nothing; null keys are ordered by
their texts; repeated rows count each on its own; ties go to the earlier source or shard; an empty table
gives none; other columns pass through unseen in mix() and are ignored by plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideway.llm.common import WORD, materialise, text_of

REPEATS = 3
SEED = 7
#: Documents of a shard, about; the largest block in words; and the fewest blocks of a shard where its source has several.
SHARD_ROWS, LARGEST_BLOCK, SHARD_BLOCKS = 4_000, 4096, 32
P = "__mix_"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_of(key: str, text: str, seed: int) -> Column:
    """Where a document stands: by a digest of its key, of its text if it has none."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.concat(F.lit("n"), F.md5(text_of(text))))))


def targets(sources: DataFrame) -> DataFrame:
    """sources (src, source, source_size) with target: one row for each source, so a window over all of them is small."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    before = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("w", ((F.col("rank") - 1) % 3 + 1).cast("long"))
    # 6 / w is whole, so the order in which targets reach their cap is exact.
    ranked = ranked.withColumn("cap", F.col("source_size") * REPEATS).withColumn("fill", F.expr("source_size * (6 div w)"))
    ranked = ranked.withColumn("all_words", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    left = F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_w = F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0))
    wide = lambda c: c.cast("decimal(19,0)")
    ranked = ranked.withColumn("full", wide(F.col("cap")) * wide(left_w) < wide(F.col("w")) * wide(left))
    ranked = ranked.withColumn("rest", F.col("all_words") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every))
    ranked = ranked.withColumn("rest_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every))
    share = (F.col("w") * F.col("rest")).cast("double") / F.nullif(F.col("rest_w"), F.lit(0)).cast("double")
    return ranked.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.coalesce(share, F.lit(0.0))))


def apportion(items: DataFrame, group: list[str], item: list[str], value: str, seats: str, out: str) -> DataFrame:
    """items with a column out: how many of a group's seats each item gets."""
    w = Window.partitionBy(*group)
    some = F.col(value) > 0
    x = items.withColumn("_n", F.sum(F.when(some, 1).otherwise(0)).over(w)).withColumn("_v", F.sum(F.col(value).cast("double")).over(w))
    scaled = lambda sign: F.col(value) * (F.col(seats) + sign * F.col("_n") / 2) / F.col("_v") + 0.5
    # Rounding with divisor _v / (seats - n/2) gives too few seats in sum, with _v / (seats + n/2) too many; one more either way for inexact division.
    x = x.withColumn("_lo", F.when(some, F.greatest(F.lit(0), F.floor(scaled(-1)) - 1)).otherwise(0).cast("long"))
    x = x.withColumn("_hi", F.when(some, F.ceil(scaled(1)) + 1).otherwise(0).cast("long"))
    x = x.withColumn("_open", F.col(seats) - F.sum("_lo").over(w))
    tries = x.filter("_hi > _lo and _v > 0").select(*group, *item, "_lo", "_open", (F.col(value).cast("double")).alias("_value"), F.explode(F.expr("sequence(_lo, _hi - 1)")).alias("_k"))
    best = Window.partitionBy(*group).orderBy((F.col("_value") / (2 * F.col("_k") + 1)).desc(), *item, "_k")
    won = tries.withColumn("_place", F.row_number().over(best)).filter("_place <= _open").groupBy(*group, *item).agg(F.count("*").alias("_more"))
    return x.join(won, [*group, *item], "left").withColumn(out, F.col("_lo") + F.coalesce("_more", F.lit(0))).drop("_n", "_v", "_lo", "_hi", "_open", "_more")


def refilled(shards: DataFrame) -> DataFrame:
    """shards (src, shard, shard_size, block, shard_seats) with quota: words of the seats, and what is over three times a shard given to the source's shards with room, in order."""
    source = Window.partitionBy("src")
    before = source.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    won, most = F.col("shard_seats") * F.col("block"), F.col("shard_size") * REPEATS
    x = shards.withColumn("_room", F.greatest(F.lit(0), most - won)).withColumn("_over", F.sum(F.greatest(F.lit(0), won - most)).over(source))
    more = F.least(F.col("_room"), F.greatest(F.lit(0), F.col("_over") - F.coalesce(F.sum("_room").over(before), F.lit(0))))
    return x.withColumn("quota", F.least(won, most) + more).drop("_room", "_over")


def quotas(rows: DataFrame, n: int) -> DataFrame:
    """(src, cell, shard, source_size, target, shard_size, quota) for rows (src, source, cell, size), cells below n: the shard of each cell and its quota in words, at most three times its size."""
    # What documents tell is summed before it is dealt out: a row for each source and cell.
    cells = materialise(rows.groupBy(f"{P}src", f"{P}cell").agg(F.sum(f"{P}size").alias("cell_size"), F.first(f"{P}source").alias("source")).withColumnsRenamed({f"{P}src": "src", f"{P}cell": "cell"}), "cells")
    sources = cells.groupBy("src", "source").agg(F.sum("cell_size").alias("source_size"))
    aimed = targets(sources)
    every = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    aimed = aimed.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(LARGEST_BLOCK), F.floor(F.coalesce(least, F.lit(0.0)) / 100))).cast("long"))
    aimed = aimed.withColumn("blocks", F.floor(F.col("all_words") / F.col("block") + 0.5).cast("long")).withColumn("all", F.lit(1))
    # A small source beside a large corpus would have shards of less than a block.
    aimed = aimed.withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(n), F.expr(f"source_size div (block * {SHARD_BLOCKS})"))).cast("long"))
    per_source = materialise(apportion(aimed, ["all"], ["rank"], "target", "blocks", "seats").select("src", "source_size", "target", "block", "shards", "seats"), "sources")
    sharded = cells.join(per_source, "src").withColumn("shard", F.col("cell") % F.col("shards"))
    shards = sharded.groupBy("src", "shard", "block", "seats").agg(F.sum("cell_size").alias("shard_size"))
    spread = refilled(apportion(shards, ["src"], ["shard"], "shard_size", "seats", "shard_seats"))
    return sharded.select("src", "cell", "shard", "source_size", "target").join(spread.select("src", "shard", "shard_size", "quota"), ["src", "shard"])


def _take(rows: DataFrame, key: str, source: str) -> DataFrame:
    """rows, which have a size and a place in the order under P, with source_size, target and taken under P."""
    n = max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn(f"{P}source", F.col(source).cast("string")).withColumn(f"{P}src", F.coalesce(F.concat(F.lit("s"), f"{P}source"), F.lit("n")))
    rows = rows.withColumn(f"{P}cell", F.conv(F.substring(f"{P}at", 1, 8), 16, 10).cast("long") % n)
    found = materialise(quotas(rows, n), "quotas").select(F.col("src").alias(f"{P}q_src"), F.col("cell").alias(f"{P}q_cell"), *[F.col(c).alias(f"{P}{c}") for c in ("shard", "source_size", "target", "shard_size", "quota")])
    joined = rows.join(found, (F.col(f"{P}src") == F.col(f"{P}q_src")) & (F.col(f"{P}cell") == F.col(f"{P}q_cell")))
    # Rows without words get none wherever they stand: they keep to their cells, as no words bound their number in a shard.
    joined = joined.withColumn(f"{P}part", F.when(F.col(f"{P}size") > 0, -1).otherwise(F.col(f"{P}cell")))
    before = Window.partitionBy(f"{P}src", f"{P}shard", f"{P}part").orderBy(f"{P}at", key, f"{P}size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(f"{P}size").over(before), F.lit(0))
    whole = F.coalesce(F.expr(f"{P}quota div nullif({P}shard_size, 0)"), F.lit(0))
    rest = F.col(f"{P}quota") - whole * F.col(f"{P}shard_size")
    return joined.withColumn(f"{P}taken", whole * F.col(f"{P}size") + F.least(F.col(f"{P}size"), F.greatest(F.lit(0), rest - ahead)))


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """(key, source, size, source_size, target, taken): the words that the mix takes of every document."""
    sizes = materialise(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), size_of(text).alias(f"{P}size"), order_of(key, text, seed).alias(f"{P}at")), "sizes")
    out = _take(sizes, "key", "source")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), *[F.col(f"{P}{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """The mixed rows with the columns of docs: each as often as the words taken of it come to, rounded to whole copies."""
    taken = _take(docs.withColumns({f"{P}size": size_of(text), f"{P}at": order_of(key, text, seed)}), key, source)
    copies = F.floor(F.col(f"{P}taken") / F.nullif(F.col(f"{P}size"), F.lit(0)) + 0.5)
    # Rows of which nothing is taken go before copies are made.
    return taken.withColumn(f"{P}copies", copies.cast("int")).filter(f"{P}copies >= 1").withColumn(f"{P}copy", F.explode(F.expr(f"sequence(1, {P}copies)"))).select(*[F.col(f"`{c}`") for c in docs.columns])
