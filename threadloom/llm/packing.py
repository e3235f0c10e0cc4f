"""Problem 8: documents into packs of fixed capacity with little space left over."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from .tokens import FOLDER, VOCABULARY, with_tokens

#: Documents packed together.
BLOCK = 50_000
#: Share of a pack that may stay empty before its items are packed again with those of other blocks.
SLACK = 0.02


class OpenBins:
    """Segment tree over the remaining capacities 0..capacity; a leaf holds the open bins with just that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity).bit_length()
        self.any = bytearray(2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, number: int) -> None:
        at = self.bins.get(room)
        if at:
            at.append(number)
            return
        self.bins[room] = [number]
        k = self.size + room
        tree = self.any
        while k and not tree[k]:
            tree[k] = 1
            k >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the bin with the least room of need or more."""
        tree, k = self.any, self.size + need
        while not tree[k]:
            while k & 1:  # a right child: what lies further right is above
                k >>= 1
            if not k:
                return None
            k += 1
            if k & (k - 1) == 0:  # past the last leaf of this level
                return None
        while k < self.size:
            k <<= 1
            if not tree[k]:
                k += 1
        room = k - self.size
        at = self.bins[room]
        number = at.pop()
        if not at:
            del self.bins[room]
            while k:
                tree[k] = 0
                k >>= 1
                if tree[2 * k] or tree[2 * k + 1]:
                    break
        return room, number


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; sizes come in falling order, each at most capacity."""
    bins, out, made = OpenBins(capacity), [], 0
    for s in sizes:
        found = bins.tightest(s) if s else None
        if found is None:
            room, number, made = capacity, made, made + 1
        else:
            room, number = found
        out.append(number)
        if room > s:
            bins.add(room - s, number)
    return out


def pack(items: DataFrame, capacities: DataFrame, key: str, size: str, *, name: str = "pack_name", capacity: str = "capacity", block: int = BLOCK) -> DataFrame:
    """(name, pack_id, key, piece, n_tokens): which pack each item, or each piece of an item longer than a pack, lies in.

    Items are packed in blocks of about `block` items chosen by a hash of their key, each by best-fit decreasing, so no task
    grows with the table. Of each block only packs filled up to SLACK stay; the items of the others, few in a block, are packed
    again together, in fewer blocks, until one block holds them all. Only items above capacity are cut: into full packs and a
    rest. Items of size 0 or null need no room and come back with pack_id null. Capacities that are null or below 1 and items
    with a null key are left out; keys are taken as unique.
    """
    items = items.select(F.col(key).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("n")).where("item is not null")
    caps = capacities.select(F.col(name).alias("pack"), F.col(capacity).cast("int").alias("cap")).where("cap >= 1").distinct()
    each = items.where("n > 0").crossJoin(F.broadcast(caps)).withColumn("pieces", F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("cap")).cast("int") - 1))
    each = each.select("pack", "cap", "item", F.explode("pieces").alias("piece"), "n").withColumn("n_tokens", F.least("cap", F.col("n") - F.col("piece") * F.col("cap"))).drop("n")

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(pdf["cap"].iloc[0])
        pdf = pdf.sort_values(["n_tokens", "item", "piece"], ascending=[False, True, True])
        bins = pd.Series(best_fit_decreasing(pdf["n_tokens"].tolist(), cap), index=pdf.index)
        load = pdf["n_tokens"].groupby(bins).transform("sum")
        return pd.DataFrame({"pack": key[0], "cap": cap, "item": pdf["item"], "piece": pdf["piece"], "n_tokens": pdf["n_tokens"], "pack_id": [f"{key[2]}-{key[1]}-{b}" for b in bins], "full": load >= (1 - SLACK) * cap})

    kind = dict(items.dtypes)["item"]
    schema = f"pack string, cap int, item {kind}, piece int, n_tokens int, pack_id string, full boolean"
    packed, rest, level, before = None, each, 0, math.inf
    while True:
        rows = rest.groupBy("pack").count().agg(F.max("count")).first()[0] or 0
        blocks = max(1, math.ceil(rows / block))
        last = blocks == 1 or blocks >= before  # the second: packs that don't fill, such as items of more than half a pack
        cells = rest.withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)).cast("int")).withColumn("level", F.lit(level))
        made = cells.groupBy("pack", "block", "level").applyInPandas(fill, schema)
        made = made if last else cut(made)
        done = made if last else made.where("full")
        packed = done if packed is None else packed.unionByName(done)
        if last:
            break
        rest, before, level = made.where("not full").select("pack", "cap", "item", "piece", "n_tokens"), blocks, level + 1
    packed = packed.select("pack", "pack_id", "item", "piece", "n_tokens")
    none = items.where("n <= 0").crossJoin(F.broadcast(caps)).select("pack", F.lit(None).cast("string").alias("pack_id"), "item", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"))
    return packed.unionByName(none).select(F.col("pack").alias(name), "pack_id", F.col("item").alias(key), "piece", "n_tokens")


def packed_documents(spark: SparkSession, folder: str, *, tokenizers: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    sizes = cut(with_tokens(table(spark, folder, "documents"), ["doc_id"], folder=tokenizers, vocabulary=vocabulary))
    return pack(sizes, table(spark, folder, "pack_sizes"), "doc_id", "n_tokens", capacity="capacity_tokens")


def p8_packs(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(spark, folder)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of pack: packs used, the least number possible by volume, and the share of room filled."""
    packs = packed_documents(spark, folder).where("pack_id is not null").groupBy("pack_name", "pack_id").agg(F.sum("n_tokens").alias("n"))
    total = packs.groupBy("pack_name").agg(F.count("*").alias("packs"), F.sum("n").alias("tokens"))
    caps = table(spark, folder, "pack_sizes")
    return total.join(F.broadcast(caps), "pack_name").select("pack_name", "packs", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), "tokens", F.round(F.col("tokens") / (F.col("packs") * F.col("capacity_tokens")), 4).alias("filled"))


QUERIES = {"p8_packs": p8_packs, "p8_fill": p8_fill}
ORACLE: dict[str, str] = {}
