"""A Merkle manifest of a table: one digest per row, per group and for everything, with proofs.

Rows are leaves. A group's leaves, in order, are hashed in runs of three to
parents, these again, until one digest, the group's subroot, is left; the
subroots, in order, lead to the root in the same way.

A leaf's position comes from a range partitioning: partitions are sorted, rows
numbered inside them, and prefix sums over the partitions' counts make the
numbers global, so a group of any size is never sorted in one task. Positions are
then cut into blocks of 3^7 consecutive rows, and each block is a window
partition. On it, level l has lag and lead columns of the fixed offsets 3^l and
2 * 3^l, masked by slot and run length: they are a node's siblings. Rows that
start a run hash their parent. A block never cuts a run, so seven levels need one
shuffle; the blocks' roots are the leaves of the next round, with 2187 times
fewer rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answergauge.llm.base import stored

FANOUT = 3
LEVELS = 7  # levels per window: blocks of 2187 rows


def leaf_digest(*values: Column) -> Column:
    """sha256 of values, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value as text."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, values)), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """sha256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, group: str, order: str, leaf: str) -> DataFrame:
    """``rows`` with the columns subroot, root and steps; one row per input row.

    ``steps`` lists the siblings from the leaf to the root, per level those to the
    left and those to the right as concatenated hex digests (empty where the run
    has none on that side); a level of one node has no step. Groups are ordered
    null first, then by the bytes of their text; leaves by ``order``, null first,
    equal ones by their digest. Repeated rows are leaves of their own. The columns
    subroot, root, steps and names that start with ``_merkle`` are replaced.
    An empty table gives an empty result.
    """
    own = [c for c in rows.columns if c.lower() not in ("subroot", "root", "steps") and not c.startswith("_merkle")]
    text = F.col(group).cast("string")
    # the tie-breaker only splits rows that are equal in all that is hashed
    leaves = stored(rows.select(
        *own, F.when(text.isNull(), "0").otherwise(F.concat(F.lit("1"), text)).alias("_merkle_group"),
        F.monotonically_increasing_id().alias("_merkle_tie")), "merkle-leaves")
    placed = _positions(leaves, [order, leaf, "_merkle_tie"])
    climbed, tops = _climb(placed.withColumn("_merkle_hash", F.col(leaf)))

    subroots = tops.select(F.lit("").alias("_merkle_group"), F.col("_merkle_group").alias("_merkle_source"), "_merkle_hash")
    upper, roots = _climb(_positions(subroots, ["_merkle_source"]))
    root = roots.select(F.col("_merkle_hash").alias("root"))
    above = upper.select(
        F.col("_merkle_source").alias("_merkle_group"), F.col("_merkle_hash").alias("subroot"),
        F.col("_merkle_steps").alias("_merkle_above"))
    # a single row, or none where the table is empty
    above = above.withColumn("_merkle_one", F.lit(1)).join(root.withColumn("_merkle_one", F.lit(1)), "_merkle_one")
    return climbed.join(above, "_merkle_group").select(
        *own, "subroot", "root", F.concat("_merkle_steps", "_merkle_above").alias("steps"))


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_merkle_pos``, the 0-based place in the group, and ``_merkle_n``, the group's size."""
    keys = ["_merkle_group", *order]
    part, at = F.shiftright("_merkle_id", 33), F.col("_merkle_id").bitwiseAND(F.lit((1 << 33) - 1))
    ranged = stored(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_merkle_id", F.monotonically_increasing_id()), "merkle-order")
    ranged = ranged.withColumns({"_merkle_part": part, "_merkle_at": at})
    counts = ranged.groupBy("_merkle_group", "_merkle_part").agg(
        F.min("_merkle_at").alias("_merkle_first"), F.count("*").alias("_merkle_rows"))
    of_group = Window.partitionBy("_merkle_group")
    before = of_group.orderBy("_merkle_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "_merkle_group", "_merkle_part",
        (F.coalesce(F.sum("_merkle_rows").over(before), F.lit(0)) - F.col("_merkle_first")).alias("_merkle_shift"),
        F.sum("_merkle_rows").over(of_group).alias("_merkle_n"))
    return ranged.join(shifts, ["_merkle_group", "_merkle_part"]).withColumn(
        "_merkle_pos", F.col("_merkle_at") + F.col("_merkle_shift")).drop(
            "_merkle_id", "_merkle_part", "_merkle_at", "_merkle_shift")


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From nodes (_merkle_group, _merkle_pos, _merkle_n, _merkle_hash, ...) to the tops of their groups.

    Returns the nodes with ``_merkle_steps``, and one row (_merkle_group,
    _merkle_hash) per group. Each round climbs LEVELS levels; the number of
    rounds is the logarithm of the largest group to the base 2187.
    """
    span = FANOUT ** LEVELS
    rounds = []
    while True:
        block = stored(_climb_block(nodes), "merkle-levels")
        rounds.append(block)
        nodes = block.where(F.col("_merkle_top").isNotNull()).select(
            "_merkle_group", _quotient("_merkle_pos", span).alias("_merkle_pos"),
            _nodes_at(span).alias("_merkle_n"), F.col("_merkle_top").alias("_merkle_hash"))
        if (nodes.agg(F.max("_merkle_n")).first()[0] or 1) <= 1:
            break
    steps = rounds[-1].drop("_merkle_top")
    for lower in reversed(rounds[:-1]):
        upper = steps.select(
            "_merkle_group", F.col("_merkle_pos").alias("_merkle_block"), F.col("_merkle_steps").alias("_merkle_above"))
        steps = lower.drop("_merkle_top").withColumn("_merkle_block", _quotient("_merkle_pos", span)).join(
            upper, ["_merkle_group", "_merkle_block"]).withColumn(
                "_merkle_steps", F.concat("_merkle_steps", "_merkle_above")).drop("_merkle_block", "_merkle_above")
    return steps, nodes.select("_merkle_group", "_merkle_hash")


def _quotient(column: str, divisor: int) -> Column:
    return F.expr(f"{column} div {divisor}L")


def _nodes_at(step: int) -> Column:
    """Nodes of the group at the level where each stands for ``step`` of its rows."""
    return F.expr(f"(_merkle_n + {step - 1}L) div {step}L")


def _climb_block(nodes: DataFrame) -> DataFrame:
    """One window partition per block; ``_merkle_top`` is set on the block's first row."""
    out = nodes.withColumn("_merkle_block", _quotient("_merkle_pos", FANOUT ** LEVELS))
    block = Window.partitionBy("_merkle_group", "_merkle_block").orderBy("_merkle_pos")
    nothing = F.lit("")
    out = out.withColumn("_merkle_h0", F.col("_merkle_hash"))
    for level in range(LEVELS):
        step = FANOUT ** level
        digest, at = F.col(f"_merkle_h{level}"), _quotient("_merkle_pos", step)
        size, slot = _nodes_at(step), at % FANOUT
        run = F.least(F.lit(FANOUT), size - (at - slot))
        left = [F.when(slot >= k, F.lag(digest, k * step).over(block)) for k in range(FANOUT - 1, 0, -1)]
        right = [F.when(slot + k < run, F.lead(digest, k * step).over(block)) for k in range(1, FANOUT)]
        starts, alone = F.col("_merkle_pos") % step == 0, size <= 1
        out = out.withColumns({
            f"_merkle_s{level}": F.when(starts, F.struct(
                F.concat(*(F.coalesce(x, nothing) for x in left)).alias("left"),
                F.concat(*(F.coalesce(x, nothing) for x in right)).alias("right"), alone.alias("alone")))})
        siblings = F.col(f"_merkle_s{level}")
        out = out.withColumn(f"_merkle_h{level + 1}", F.when(
            starts & (slot == 0), F.when(alone, digest).otherwise(F.sha2(F.concat(digest, siblings["right"]), 256))))
    # a node's siblings stand on its first row; its other rows take them from there
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.array(*(F.last(f"_merkle_s{level}", ignorenulls=True).over(so_far) for level in range(LEVELS)))
    out = out.withColumn("_merkle_held", held)
    steps = F.transform(
        F.filter("_merkle_held", lambda s: ~s["alone"]), lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))
    return out.withColumns({"_merkle_steps": steps, "_merkle_top": F.col(f"_merkle_h{LEVELS}")}).drop(
        "_merkle_block", "_merkle_held", *(f"_merkle_s{i}" for i in range(LEVELS)),
        *(f"_merkle_h{i}" for i in range(LEVELS + 1)))
