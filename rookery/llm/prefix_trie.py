"""Trie of conversations by their first turns, by ROLLUP over positional columns of turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rookery.llm.storage import cut, drop_cut, join_dictionary

#: Turns in a block: positional columns of one ROLLUP. Longer conversations have more blocks.
BLOCK = 8
#: Turns in a range, of which a task takes one.
RANGE_ROWS = 200_000
#: Rows of one conversation that a window holds together; sums over more go by such stretches.
STRETCH = 4096
#: Neighbouring conv_ids, as a power of two, whose list is one piece of what is hashed.
PIECE_BITS = 12
POSITION = [f"t{i + 1}" for i in range(BLOCK)]


def _turn_id(role: Column, text: Column) -> Column:
    """20 bytes: MD5 of the turn, and the number of code points of its text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws("", F.length(role), F.lit(":"), role, text).cast("binary")))
    return F.concat(digest, F.unhex(F.lpad(F.hex(F.length(text).cast("long")), 8, "0")))


def _chars(turn_id: Column) -> Column:
    return F.conv(F.hex(F.substring(turn_id, 17, 4)), 16, 10).cast("long")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id): turns of each conversation numbered from 1 by turn, null first, then by id. Rows are dealt into ranges of
    conversation and turn, and a conversation that goes on from range to range brings its count along, so none is one task."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _turn_id(F.col("role"), F.col("text")).alias("id"))
    ids = cut(rows.where("conv_id IS NOT NULL"), "turn-ids")
    ranges = max(8, -(-ids.count() // RANGE_ROWS))
    dealt = cut(ids.repartitionByRange(ranges, "conv_id", "turn", "id").withColumn("part", F.spark_partition_id()), "turn-ranges")
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = cut(counts.select(F.struct("conv_id", "part").alias("cell"), so_far.alias("before")).where("before > 0"), "turn-offsets")
    inside = F.row_number().over(W.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "id"))
    placed = join_dictionary(dealt.withColumn("k", inside).withColumn("cell", F.struct("conv_id", "part")), offsets, "cell")
    turns = cut(placed.select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "id"), "turns")
    for table in (ids, dealt, offsets):
        drop_cut(table)
    return turns


def rebuilt_turns(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, id, n) of rebuilt conversations, conv_ids without any turn): conversation c takes the first h turns of c - c % group,
    h being the unsigned crc32 of its decimal id modulo `heads`, and goes on with its own turns after its first h."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    convs = cut(convs.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")), "conversations")
    bases = convs.where("conv_id = base").select("base", F.col("own").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    lent = convs.select("conv_id", "base", "h", "n").join(first, "base").where("pos <= h").select("conv_id", "pos", "id", "n")
    kept = turns.join(convs.select("conv_id", "h", "taken", "n"), "conv_id").where("pos > h")
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "n")
    return lent.union(kept), convs.where("n = 0").select("conv_id")


def with_before(df: DataFrame, by: str, at: str, values: list[str], combine: Callable[[str], Column]) -> DataFrame:
    """df, made by cut(), with <value>_before: `combine` of the value over rows of the same `by` with a smaller `at`, 0 without any.
    Rows of one `by` are taken in stretches of `at`, whose totals go before them, so no key is one window of all its rows."""
    df = df.withColumn("cell", F.struct(F.col(by).alias("of"), F.floor(F.col(at) / STRETCH).alias("k")))
    totals = df.groupBy("cell").agg(*[combine(v).alias(v) for v in values])
    past = W.partitionBy("cell.of").orderBy("cell.k").rowsBetween(W.unboundedPreceding, -1)
    totals = cut(totals.select("cell", *[combine(v).over(past).alias(f"{v}_0") for v in values]).where("cell.k > 0"), "stretches")
    inside = W.partitionBy("cell").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    df = join_dictionary(df.withColumns({f"{v}_1": combine(v).over(inside) for v in values}), totals, "cell")
    for v in values:
        both = [F.coalesce(f"{v}_{i}", F.lit(0).cast("long")) for i in (0, 1)]
        df = df.withColumn(f"{v}_before", both[0].bitwiseXOR(both[1]) if combine is F.bit_xor else both[0] + both[1])
    return df.drop("cell", *[f"{v}_{i}" for v in values for i in (0, 1)])


def _hash(which: int, pos: Column, turn_id: Column) -> Column:
    """Half a turn's share of a node's number; a node's number is the exclusive or of its turns' shares at their places."""
    return F.xxhash64(F.lit(which), pos.cast("long"), turn_id)


def turn_blocks(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """(conv_id, block, a, b, t1.., reach) per conversation and block of its turns: (a, b) is the number, 128 bits, of the node at which
    the block before ends; reach is how many turns the block has, or BLOCK + 1 if the conversation goes on behind it."""
    pos = F.col("pos")
    turns = turns.withColumn("block", F.floor((pos - 1) / BLOCK)).withColumn("k", (pos - 1) % BLOCK)
    blocks = turns.groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("k") == i, F.col("id"))).alias(t) for i, t in enumerate(POSITION)],
        F.bit_xor(_hash(1, pos, F.col("id"))).alias("a"), F.bit_xor(_hash(2, pos, F.col("id"))).alias("b"), F.max("n").alias("n"),
    )
    blocks = with_before(cut(blocks, "blocks"), "conv_id", "block", ["a", "b"], F.bit_xor)
    reach = F.least(F.col("n") - F.col("block") * BLOCK, F.lit(BLOCK + 1)).cast("int")
    blocks = blocks.select("conv_id", "block", F.col("a_before").alias("a"), F.col("b_before").alias("b"), *POSITION, reach.alias("reach"))
    none = [F.lit(0).cast("long").alias(c) for c in ("block", "a", "b")]
    return cut(blocks.union(turnless.select("conv_id", *none, *[F.lit(None).cast("binary").alias(t) for t in POSITION], F.lit(0).alias("reach"))), "turn-blocks")


def _node(which: int, start: str, upto: Column) -> Column:
    """The number of the node `upto` turns into a block that begins at `start`."""
    shares = [F.when(F.lit(i + 1) <= upto, _hash(which, F.col("block") * BLOCK + i + 1, F.col(t))).otherwise(F.lit(0).cast("long")) for i, t in enumerate(POSITION)]
    out = F.col(start)
    for s in shares:
        out = out.bitwiseXOR(s)
    return out


def _rolled_up(blocks: DataFrame, sums: str = "") -> DataFrame:
    """A row per node: all prefixes of all blocks by one ROLLUP. The level follows from grouping_id; groups of conversations that have
    ended before the level aren't nodes, and level 0 is one only in the first block, as the root."""
    rows = blocks.sparkSession.sql(
        f"""
        SELECT block, a, b, {", ".join(POSITION)}, {BLOCK} - bit_count(grouping_id()) AS level,
          count(*) AS n_convs, min(conv_id) AS conv_id, max(reach) AS reach {sums}
        FROM {{blocks}} GROUP BY block, a, b, ROLLUP ({", ".join(POSITION)})
        """,
        blocks=blocks,
    )
    last = F.element_at(F.array(F.lit(None).cast("binary"), *POSITION), F.col("level") + 1)
    rows = rows.withColumn("last", last).where("last IS NOT NULL OR level = 0 AND block = 0")
    level, parent = F.col("level"), F.col("level") - 1
    return rows.select(
        _node(1, "a", level).alias("node_a"), _node(2, "b", level).alias("node_b"), _node(1, "a", parent).alias("up_a"), _node(2, "b", parent).alias("up_b"),
        (F.col("block") * BLOCK + level).alias("depth"), "conv_id", "n_convs", (F.col("reach") == level).alias("childless"),
        ((F.col("n_convs") - 1) * F.coalesce(_chars(F.col("last")), F.lit(0))).alias("saved"), *[c for c in ("sum_saved", "n_leaves") if c in rows.columns],
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come one after the other: only the node at hand is open."""
    node, state = None, None
    schema = pa.schema([("end_a", pa.int64()), ("end_b", pa.int64()), ("ends_sha256", pa.string())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("end_a", "end_b", "ids")), strict=True):
            if (a, b) == node:
                state.update(b"," + ids.encode())
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(ids.encode())
        yield rows(done)
    if node is not None:
        yield rows([(*node, state.hexdigest())])


def end_digests(blocks: DataFrame) -> DataFrame:
    """(end_a, end_b, ends_sha256) per node at which a conversation ends: the hash of the decimal conv_ids, ascending, with commas between.
    Ids are joined to pieces by neighbourhood first. One hash is one sequence by nature, so a node's pieces go through one task, in
    order, and in bounded memory; they aren't gathered."""
    ends = blocks.where(F.col("reach") <= BLOCK)
    ends = ends.select("conv_id", _node(1, "a", F.col("reach")).alias("end_a"), _node(2, "b", F.col("reach")).alias("end_b"), F.shiftright("conv_id", PIECE_BITS).alias("piece"))
    pieces = ends.groupBy("end_a", "end_b", "piece").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    pieces = pieces.repartition("end_a", "end_b").sortWithinPartitions("end_a", "end_b", "piece")
    return pieces.select("end_a", "end_b", "ids").mapInArrow(_digests, "end_a bigint, end_b bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node of the trie of rebuilt conversations.

    A node is a sequence of first turns (role, text) that some rebuilt conversation begins with; the root, of depth 0, has all as members.
    conv_id is the smallest member, with depth it names the node. n_leaves counts childless nodes of its subtree, itself included;
    saved_tokens sums (n_convs - 1) * code points of the last text over the subtree; ends_sha256 is of the members that end here.

    Turns are put into positional columns, BLOCK of them a row; one ROLLUP over them, keyed by the node at which the block before ends,
    counts all prefixes of all blocks. Every node counts for the member of smallest id, so a second ROLLUP that sums
    what each conversation stands for gives the sums over subtrees, without a walk down the trie.

    Null roles and texts are empty. Rows of one conversation with equal turns stand in the order of their ids, a hash of role and text;
    repeated rows are turns of their own. Rows without conv_id belong to no conversation. An empty table has no node.
    Turns and nodes are told apart by 128 bits. Other columns are left out.
    """
    turns = numbered_turns(conversations)
    blocks = turn_blocks(*rebuilt_turns(turns))
    first = _rolled_up(blocks)
    stands_for = cut(first.groupBy("conv_id").agg(F.sum("saved").alias("own_saved"), F.max(F.col("childless").cast("long")).alias("own_leaf")), "stands-for")
    nodes = _rolled_up(blocks.join(stands_for, "conv_id", "left"), ", coalesce(sum(own_saved), 0) AS sum_saved, coalesce(sum(own_leaf), 0) AS n_leaves")
    nodes = with_before(cut(nodes, "nodes"), "conv_id", "depth", ["saved"], F.sum).withColumn("saved_tokens", F.col("sum_saved") - F.col("saved_before"))
    nodes = cut(nodes.drop("saved", "saved_before", "sum_saved", "childless"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("node_a"), F.col("up_b").alias("node_b")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = end_digests(blocks).withColumnsRenamed({"end_a": "node_a", "end_b": "node_b"})
    parents = nodes.select(F.col("node_a").alias("up_a"), F.col("node_b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(children, ["node_a", "node_b"], "left").join(ends, ["node_a", "node_b"], "left").join(parents, ["up_a", "up_b", "depth"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
