"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level a document draws -ln(u) / weight for every child of the node it is in, u being a hash of its id and the
child's name, and goes to the child with the smallest draw. A child's draw depends on nothing but the document, the
name and the weight: if one weight grows, only documents that move into that child move at all, and subtrees whose
weights stay keep their inner placement. A tree therefore grows by opening a new region; what enters it comes from all
others in proportion, and nothing moves between old shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import numbered, whole

SHARDS = 24
RACKS_PER_REGION = 3
SHARDS_PER_RACK = 2


@dataclass(frozen=True)
class Leaf:
    """A shard and the names of the subtrees it hangs in."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def regular_tree(shards: int = SHARDS) -> list[Leaf]:
    """Equal shards, filled region by region."""
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    return [Leaf(f"r{s // per_region}", f"r{s // per_region}k{s % per_region // SHARDS_PER_RACK}", s) for s in range(shards)]


def grown(tree: list[Leaf]) -> list[Leaf]:
    """The tree with one more shard, alone in a region of its own."""
    new = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(f"g{new}", f"g{new}k0", new)]


def draw(key: Column, name: str, weight: float) -> Column:
    """Exponential draw of rate ``weight``: the smallest of several is each one's with chance in proportion to its weight."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}"))), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(2.0**48)) / F.lit(weight)


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key (a string column); ties of draws go to the first name. Shards of weight 0 get nothing."""
    tree = [leaf for leaf in tree if leaf.weight > 0]

    def smallest(children: dict[str, tuple[float, Column]]) -> Column:
        if len(children) == 1:
            return next(iter(children.values()))[1]
        ranks = sorted(children)
        winner = F.array_min(F.array(*(F.struct(draw(key, name, children[name][0]).alias("draw"), F.lit(at).alias("at"))
                                       for at, name in enumerate(ranks))))["at"]
        return F.element_at(F.array(*(children[name][1] for name in ranks)), winner + 1)

    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    by_region = {}
    for region, racks in regions.items():
        by_rack = {}
        for rack, leaves in racks.items():
            by_shard = {f"s{leaf.shard}": (leaf.weight, F.lit(leaf.shard)) for leaf in leaves}
            by_rack[rack] = (sum(leaf.weight for leaf in leaves), smallest(by_shard))
        by_region[region] = (sum(weight for weight, _ in by_rack.values()), smallest(by_rack))
    return smallest(by_region)


def sharded(docs: DataFrame, tree: list[Leaf], after: list[Leaf] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard, slot) of every document row.

    The id alone decides the shard (a null id counts as the empty string); ``grown_shard`` is the shard in the tree
    ``after``. Slots are gapless from 0 in each shard, in an order by hash; rows of one id keep neighbouring places in
    no particular order. Size is 8 plus the UTF-8 bytes of the text (null: 8). Extra columns are ignored; an empty
    table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(whole()) + 8).cast("long").alias("size"), F.crc32(whole().cast("binary")).alias("text_crc32"),
        place(key, tree).cast("int").alias("shard"), place(key, after or tree).cast("int").alias("grown_shard"))
    return numbered(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def op6_sharding(docs: DataFrame) -> DataFrame:
    tree = regular_tree(SHARDS)
    return sharded(docs, tree, grown(tree)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
