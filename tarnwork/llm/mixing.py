"""Mixing sources to target weights."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.tokens import token_count

BLOCK_TOKENS = 256
SHARD_TOKENS = 50_000_000
#: Up to so many target rows their quotas go to every task; beyond, documents are joined with them by source.
BROADCAST_TARGETS = 100_000


def apportion(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Sainte-Lague: each seat goes to the highest quotient votes / (2 * held + 1) among those below their cap.

    A common divisor places all but a few seats at once, the rest go one by one, so the number
    of seats doesn't matter. Ties go to the earlier entry. Seats beyond all caps stay empty.
    """
    caps = [max(0, c) for c in caps] if caps is not None else [seats] * len(votes)
    good = [v if v and v > 0 and math.isfinite(v) else 0.0 for v in votes]
    seats = min(seats, sum(c for v, c in zip(good, caps) if v > 0))
    if seats <= 0:
        return [0] * len(votes)

    def at(divisor: float) -> list[int]:
        return [min(c, math.floor(v / divisor + 0.5)) if v > 0 else 0 for v, c in zip(good, caps)]

    low, high = min(v for v in good if v > 0) / (2.0 * max(caps) + 2), max(good) * 4
    for _ in range(200):
        mid = (low + high) / 2
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    held = at(high)
    heap = [(-v / (2 * h + 1), i) for i, (v, h, c) in enumerate(zip(good, held, caps)) if v > 0 and h < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(held)):
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < caps[i]:
            heapq.heappush(heap, (-good[i] / (2 * held[i] + 1), i))
    return held


def sized(documents: DataFrame, key: str, text: str, source: str, path: str | None = None) -> DataFrame:
    """key, source and tokens of each document with at least one token."""
    return documents.select(F.col(key), F.col(source).alias("source"), token_count(F.col(text), path).alias("tokens")).where("tokens > 0")


def mix(sizes: DataFrame, key: str, targets: DataFrame, seed: int = 17, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """mix_name, key, source, tokens, repeats: the documents of each mix and how often each occurs.

    Sources of a mix get equal-token blocks by highest quotients until the wanted size is
    reached; a source stops at max_repeats times its own blocks and the others take what is
    left. A source's blocks are split over its shards in the same way. Within a shard whole
    passes come first; the remaining blocks are the first ones in an order drawn with the seed.

    `sizes` is read twice and should be written or checkpointed.
    - Only the number of target rows comes to the driver. The sources of one mix, and the shards of
      one source, are apportioned in one task each.
    - Null, negative or NaN shares count as 0, a null max_repeats as 1; of repeated targets
      for one source the largest share holds. Sources without documents get nothing.
    - Documents with a null or unlisted source, or without tokens, are in no mix.
    """
    wanted = targets.groupBy("mix_name", "source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"), F.max("total_ratio").alias("ratio"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("have"))
    total = F.broadcast(sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")))  # one row

    def blocks_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """The blocks of each source of one mix."""
        pdf = pdf.sort_values("source")
        ratio = pdf["ratio"].max()
        seats = round(int(pdf["total"].iloc[0]) * (ratio if ratio == ratio else 0) / block_tokens)
        caps = [math.ceil(max(0, int(r)) * int(h) / block_tokens) for h, r in zip(pdf["have"], pdf["repeats"])]
        pdf["blocks"] = apportion([float(x) if x == x else 0.0 for x in pdf["share"]], seats, caps)
        pdf["shards"] = [max(1, math.ceil(int(h) / shard_tokens)) for h in pdf["have"]]
        return pdf.loc[pdf["blocks"] > 0, ["mix_name", "source", "repeats", "blocks", "shards"]]

    met = wanted.join(have, "source", "left").fillna(0, ["have"]).join(total)
    quotas = met.groupBy("mix_name").applyInPandas(blocks_of, "mix_name string, source string, repeats int, blocks bigint, shards bigint").withColumnRenamed("repeats", "repeats_max")
    quotas = F.broadcast(quotas) if targets.count() <= BROADCAST_TARGETS else quotas
    draw = F.xxhash64(F.lit(seed), F.col(key))
    rows = sizes.join(quotas, "source").withColumn("shard", F.pmod(F.shiftright(draw, 20), F.col("shards")))
    group = ["mix_name", "source"]
    shard_sizes = rows.groupBy(*group, "shard").agg(F.sum("tokens").alias("shard_tokens"), F.max("blocks").alias("blocks"), F.max("repeats_max").alias("repeats_max"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        caps = [math.floor(r * t / block_tokens) + 1 for r, t in zip(pdf["repeats_max"], pdf["shard_tokens"])]
        pdf["shard_blocks"] = apportion([float(t) for t in pdf["shard_tokens"]], int(pdf["blocks"].iloc[0]), caps)
        return pdf[[*group, "shard", "shard_tokens", "shard_blocks"]]

    parts = shard_sizes.groupBy(*group).applyInPandas(split, "mix_name string, source string, shard bigint, shard_tokens bigint, shard_blocks bigint")
    got = rows.join(parts, [*group, "shard"])
    order = Window.partitionBy(*group, "shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col(key)), key)
    goal = F.col("shard_blocks") * block_tokens
    passes = F.least(F.floor(goal / F.col("shard_tokens")), F.col("repeats_max"))
    rest = F.floor((goal - passes * F.col("shard_tokens")) / block_tokens)
    block = F.floor((F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") / 2) / block_tokens)
    repeats = passes + F.when((passes < F.col("repeats_max")) & (block < rest), 1).otherwise(0)
    return got.withColumn("repeats", repeats.cast("int")).where("repeats > 0").select("mix_name", key, "source", "tokens", "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and listed source the target and the share reached, in tokens; sources without documents have 0."""
    got = mixed.groupBy("mix_name", "source").agg(F.count("*").alias("docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("mix_tokens"), F.max("repeats").alias("most_repeats"))
    listed = targets.groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"))
    met = listed.join(got, ["mix_name", "source"], "left").fillna(0, ["docs", "mix_tokens", "most_repeats"])
    whole = F.sum("mix_tokens").over(Window.partitionBy("mix_name"))
    return met.withColumn("share", F.when(whole > 0, F.col("mix_tokens") / whole).otherwise(0.0))
