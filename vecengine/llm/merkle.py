"""A Merkle manifest of a table: a leaf a row, a tree a source, and a tree over the sources' roots.

Consecutive nodes are hashed three at a time.  A level is a pass of windows: in rows ordered by
place, the nodes of level ``l`` stand ``3 ** l`` rows apart, so lag and lead columns by that offset
and twice it, masked by a node's slot in its run, are its siblings; a run's first row hashes the
run into the parent, and carries it on.  A window holds ``3 ** 7`` rows, which all runs of seven
levels fit exactly, so the largest source is many windows; the tops of the windows are the leaves
of the next seven levels.

Defined results: a null value is ``-`` in a leaf.  Rows of one source go by id, null ids first;
rows with one id go by leaf, so rows that repeat in all columns are leaves of their own that hash
alike.  Null sources are one source, before all others.  A source of one row has its leaf as root.
An empty table has no rows and no root.  Other columns are ignored, but for those asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Nodes of a run, and levels that one window holds.
FANOUT, LEVELS = 3, 7
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*values: Column) -> Column:
    """The leaf of a row: each value's length in bytes and its text, ``-`` for a null."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, each one's place in its group from 0, and ``n``, the group's size.

    Rows are dealt out in ranges of (group, order) and stored; a range's rows of one group are
    counted, and a running sum over those counts (as many as there are ranges and groups) tells
    where each range starts.  So a group of any size is ranked by many tasks.
    """
    by = [F.col(group), *[F.col(c) for c in order]]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ranged = stored(ranged, "merkle-ranged")
    part = F.shiftright("at", 33)
    counts = ranged.groupBy(part.alias("part"), F.col(group).alias("of")).agg(F.min("at").alias("lo"), F.count("*").alias("c"))
    whole = Window.partitionBy("of")
    before = F.coalesce(F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.select("part", "of", (before - F.col("lo")).alias("shift"), F.sum("c").over(whole).alias("n")), "merkle-starts")
    met = ranged.withColumn("of", F.col(group)).withColumn("part", part).join(starts, ["part", "of"])
    return met.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def _windows(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with ``top``, set where a window's highest node stands, and ``path``, the siblings before and after in each level."""
    w = Window.partitionBy("g", "block").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps, rows = [], nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**LEVELS)).withColumn("h0", F.col("node"))
    for level in range(levels):
        own, off = f"h{level}", FANOUT**level
        slot = F.floor(F.col("pos") / off) % FANOUT
        rows = rows.select(
            "*", *[F.lag(own, k * off).over(w).alias(f"lag{k}") for k in (1, 2)], *[F.lead(own, k * off).over(w).alias(f"lead{k}") for k in (1, 2)]
        )
        text = lambda c: F.coalesce(c, F.lit(""))
        before = F.when(slot == 1, text(F.col("lag1"))).when(slot == 2, F.concat(text(F.col("lag2")), text(F.col("lag1")))).otherwise(F.lit(""))
        after = F.when(slot == 0, F.concat(text(F.col("lead1")), text(F.col("lead2")))).when(slot == 1, text(F.col("lead1"))).otherwise(F.lit(""))
        here = (F.col("pos") % off == 0) & (F.col("n") > off)  # a node stands here, and is not the last one left
        parent = F.when(F.col("pos") % (off * FANOUT) == 0, F.when(F.col("n") > off, F.sha2(F.concat(own, after), 256)).otherwise(F.col(own)))
        rows = rows.withColumns({f"s{level}": F.when(here, F.struct(before.alias("before"), after.alias("after"))), f"h{level + 1}": parent})
        # a node's siblings are those of all rows below it
        rows = rows.withColumn(f"s{level}", F.last(f"s{level}", ignorenulls=True).over(so_far)).drop("lag1", "lag2", "lead1", "lead2", own)
        steps.append(F.when(F.col("n") > off, F.col(f"s{level}")))
    return rows.select(*nodes.columns, "block", F.col(f"h{levels}").alias("top"), F.array_compact(F.array(*steps)).alias("path"))


def _climb(nodes: DataFrame, most: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` ``(g, pos, n, node, ...)`` with ``path``, and the columns that ``crown`` adds to each group's last node.

    ``crown`` takes ``(g, pos, n, node)`` of those and gives ``(g, pos, path, ...)``; its path follows the group's.
    """
    levels = 0
    while FANOUT**levels < most and levels < LEVELS:
        levels += 1
    if levels == 0:
        return nodes.join(crown(nodes.select("g", "pos", "n", "node")), ["g", "pos"])
    rows = _windows(nodes, levels)
    size = FANOUT**LEVELS
    tops = rows.where(F.col("top").isNotNull()).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node"))
    tops = stored(tops, "merkle-tops")
    above = _climb(tops, -(-most // size), crown).drop("n", "node").withColumnsRenamed({"pos": "block", "path": "rest"})
    return rows.join(above, ["g", "block"]).withColumn("path", F.concat("path", "rest")).drop("block", "top", "rest")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, order: str = "doc_id", group: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, leaf, path, subroot, root)`` of every row, and the columns of ``keep``.

    ``path`` has a struct ``(before, after)`` a level that a row's node is hashed in, from its leaf
    to the root: the hashes of its run before and after it, put together.  ``keep`` columns are
    functions of a row's fields and come back under their names.
    """
    # '-' sorts before '=', so the null source comes first, and the others by their bytes
    key = F.when(F.col(group).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    kept = [F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)]
    leaves = docs.select(key.alias("g"), F.col(order).alias("id"), leaf_hash(*[F.col(c) for c in fields]).alias("node"), *kept)
    leaves = stored(leaves, "merkle-leaves")
    placed = places(leaves, "g", ["id", "node"])
    discard(leaves)

    def over_all(subroots: DataFrame) -> DataFrame:
        """Each source's last node, a row a source, as a leaf of the tree over the sources."""
        own = stored(subroots.select("g", "pos", F.col("node").alias("subroot")), "merkle-subroots")
        ranked = places(own.select(F.lit(0).alias("all"), "g", "subroot"), "all", ["g"])
        nodes = ranked.select(F.lit("").alias("g"), F.col("g").alias("source_key"), "pos", "n", F.col("subroot").alias("node"))
        last = lambda root: root.select("g", "pos", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("node").alias("root"))
        found = _climb(nodes, _most(nodes), last)
        return found.select(F.col("source_key").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root")

    found = _climb(placed, _most(placed), over_all)
    source = F.when(F.col("g") != "-", F.substr("g", F.lit(2)))
    return found.select(
        F.col("id").alias(order), source.alias(group), F.col("node").alias("leaf"), "path", "subroot", "root", *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)]
    )


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 1


def proof(path: Column) -> Column:
    """All siblings of a path in order, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
