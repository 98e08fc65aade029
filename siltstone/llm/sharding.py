"""Hierarchical weighted hash tree: region, rack and shard are chosen level by level by weighted hash draws.

At each node every child draws -ln(u) / weight with u hashed from (key, path of the child); the least draw wins,
so a child wins with probability weight / sum of weights, and raising one child's weight moves keys only to it.
Movement is therefore confined to subtrees whose weights change. A shard added as a subtree of its own (as in
``grown``) takes rows only into itself; added to an existing rack, it also lets rows move inside that region.

Nulls: a null key draws like any value (all such rows share a shard); a null text has no bytes and checksum 0.
Repeated rows keep one slot each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import positions
from siltstone.llm.storage import written

#: {region: {rack: {shard: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(regions: int = 3, racks: int = 2, shards: int = 4) -> Tree:
    """regions x racks x shards leaves of weight 1, numbered from 0."""
    return {f"region{r}": {f"rack{k}": {(r * racks + k) * shards + s: 1.0 for s in range(shards)} for k in range(racks)} for r in range(regions)}


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return tree | {f"region-of-{shard}": {"rack0": {shard: weight}}}


def weight(node) -> float:
    return float(sum(map(weight, node.values()))) if isinstance(node, dict) else float(node)


def place(key: Column, tree: Tree) -> Column:
    """The shard of each key: three draws, each among the children of one node."""

    def descend(node, path: str) -> Column:
        children = [(name, child) for name, child in node.items() if weight(child) > 0]
        below = [descend(child, f"{path}/{name}") if isinstance(child, dict) else F.lit(int(name)) for name, child in children]
        if len(children) == 1:
            return below[0]
        draws = []
        for i, (name, child) in enumerate(children):
            h = F.xxhash64(F.lit(f"{path}/{name}"), key)
            u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)
            draws.append(F.struct((-F.log(u) / weight(child)).alias("draw"), F.lit(i).alias("child")))
        won = F.array_min(F.array(*draws))["child"]
        if not isinstance(children[0][1], dict):
            return F.element_at(F.array(*below), won + 1)
        out = F.when(won == 0, below[0])
        for i in range(1, len(children)):
            out = out.when(won == i, below[i])
        return out

    return descend(tree, "")


def assign(docs: DataFrame, tree: Tree, grown_tree: Tree) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; law ``key``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place(F.col("doc_id"), tree).alias("shard"), place(F.col("doc_id"), grown_tree).alias("grown_shard"))
    rows = written(rows.withColumn("_h", F.xxhash64("doc_id", "text_crc32", "size")), "sharded")
    bits = positions.bits_for(rows.count())
    rows = rows.withColumn("_bucket", positions.hash_bucket(F.col("_h"), bits))
    shards = sum(len(rack) for racks in tree.values() for rack in racks.values())
    placed = positions.running(rows, ["shard"], "_bucket", ["_h", "doc_id", "text_crc32", "size"], F.lit(1).cast("long"), "slot", buckets=shards << bits, nulls=False)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
