"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rookery.llm.storage import cut, join_dictionary, let, uniform

#: The contract's words: runs of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, n, target), one row per source.

    Sources in code-point order, null last, take the weights in turn. The targets share all sizes by weight; one
    that would pass `most` times its source's size stops there and the rest is shared again. That ends at
    target = least(most * size, level * weight); the level is the first one, with sources ordered by how early
    they stop, at which the next source doesn't stop. Without any size all targets are 0.
    """
    src = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("w", F.element_at(F.lit(list(weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    src = src.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("stops", F.col("cap") / F.col("w"))
    every, before = W.partitionBy(), W.orderBy("stops", F.col("source").asc_nulls_last())
    past = before.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(past), F.lit(0.0))
    open_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(past), F.lit(0.0))
    src = src.withColumn("level", left / open_w)
    first = F.first(F.when(F.col("level") <= F.col("stops"), F.col("level")), ignorenulls=True)
    level = first.over(before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("w"))
    return cut(src.select("source", "source_size", "n", target.alias("target")), "targets")


def _pair(h: Column, x: Column, seed: int) -> Column:
    """One pivotal step on two fractional rows: struct(out, hold). The mass size * p of the two together stays,
    each row's expectation of p stays, and `out` is the row that became integral."""
    up_most = F.least((1 - h["p"]) * h["size"], x["p"] * x["size"])
    down_most = F.least(h["p"] * h["size"], (1 - x["p"]) * x["size"])
    draw = uniform(h["id"], h["row"], x["id"], x["row"], seed)

    def moved(m: Column) -> Column:
        up = m["draw"] * (m["a"] + m["b"]) < m["b"]
        h_ends = F.when(up, (1 - h["p"]) * h["size"] <= x["p"] * x["size"]).otherwise(h["p"] * h["size"] <= (1 - x["p"]) * x["size"])
        h_p = F.when(up, h["p"] + m["a"] / h["size"]).otherwise(h["p"] - m["b"] / h["size"])
        x_p = F.when(up, x["p"] - m["a"] / x["size"]).otherwise(x["p"] + m["b"] / x["size"])
        keep = lambda r, p: F.struct(r["id"].alias("id"), r["row"].alias("row"), r["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), r["base"].alias("base"))
        end_h = keep(h, F.when(up, 1.0).otherwise(0.0))
        end_x = keep(x, F.when(up, 0.0).otherwise(1.0))
        return F.struct(F.when(h_ends, end_h).otherwise(end_x).alias("out"), F.when(h_ends, keep(x, x_p)).otherwise(keep(h, h_p)).alias("hold"))

    return let(F.struct(up_most.alias("a"), down_most.alias("b"), draw.alias("draw")), moved)


def _fold(item: str, seed: int):
    """Step of a fold over a block: acc holds one fractional row and those that became integral."""

    def fold(acc: Column, x: Column) -> Column:
        def after(s: Column) -> Column:
            return F.struct(s["hold"].cast(item).alias("hold"), F.concat(acc["outs"], F.array(s["out"].cast(item))).alias("outs"))

        return F.when(acc["hold"].isNull(), F.struct(x.alias("hold"), acc["outs"].alias("outs"))).otherwise(let(_pair(acc["hold"], x, seed), after))

    return fold


def pivotal_copies(sized: DataFrame, targets: DataFrame, seed: int = 7, fan_in: int = 64, split_last: bool = True) -> DataFrame:
    """(id, row, source, size, source_size, target, copies, part): whole copies of each row and words of one partial copy.

    sized has (id, row, source, size); `row` tells rows with equal ids apart. A row is wanted target / source_size
    times; the whole part is granted and the fraction is rounded. Rows meet in blocks of about fan_in of one source;
    inside a block a fold pairs the fraction it holds with the next row's and passes on what remains fractional, and
    the residuals of all blocks meet in the blocks of the next level, until one is left per source: a reduction tree
    of depth log(n, fan_in). Every pairing keeps the words of the source, so its taken words miss the target only by
    the last residual: that row gets the words left over as a partial copy (split_last) or is rounded by a draw.
    Equal inputs give equal results whatever the partitions. Rows of size 0 are rounded by their own draw.
    """
    rows = join_dictionary(sized, targets, "source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    free = F.col("size") == 0
    alone = rows.where(free | (F.col("p") == 0)).select("source", "id", "row", "size", "base", F.when(uniform(F.col("id"), F.col("row"), seed) < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    item = "struct<id:bigint,row:bigint,size:bigint,p:double,base:bigint>"
    level_rows = rows.where(~free & (F.col("p") > 0)).select("source", F.col("n").alias("left"), F.struct("id", "row", "size", "p", "base").cast(item).alias("x"))
    most = targets.agg(F.max("n")).first()[0] or 0
    decided, level = [alone], 0
    while True:
        blocks = F.ceil(F.col("left") / fan_in)
        block = F.pmod(F.xxhash64(F.col("x.id"), F.col("x.row"), F.lit(level)), blocks)
        held = level_rows.groupBy("source", block.alias("block"), blocks.alias("left")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
        start = F.struct(F.lit(None).cast(item).alias("hold"), F.expr(f"cast(array() as array<{item}>)").alias("outs"))

        done = held.select("source", "left", F.aggregate("xs", start, _fold(item, seed + level)).alias("s"))
        last = most <= fan_in
        done = cut(done, "level")
        decided.append(done.select("source", F.explode("s.outs").alias("x")).select("source", "x.id", "x.row", "x.size", "x.base", "x.p"))
        level_rows = done.select("source", "left", F.col("s.hold").alias("x"))
        if last:
            decided.append(level_rows.select("source", "x.id", "x.row", "x.size", "x.base", "x.p"))
            break
        most, level = -(-most // fan_in), level + 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    if not split_last:
        whole = F.when(F.col("p").isin(0.0, 1.0), F.col("p")).otherwise(F.when(uniform(F.col("id"), F.col("row"), seed + 1000) < F.col("p"), 1.0).otherwise(0.0))
        out = out.withColumn("p", whole)
    out = join_dictionary(out, targets, "source")
    return out.select("id", "row", "source", "size", "source_size", "target", (F.col("base") + F.floor("p")).alias("copies"), F.round((F.col("p") - F.floor("p")) * F.col("size")).cast("long").alias("part"))


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, row, source, size in words); row counts rows that agree in all of these."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    same = rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    return cut(same.select("id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("row")), "sized")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """Copies per document for a mixture of sources; see source_targets and pivotal_copies.

    Null texts count 0 words, a null source is a source of its own and null ids are allowed. Repeated rows are
    rounded each for itself. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    sized = sized_rows(docs)
    return pivotal_copies(sized, source_targets(sized, weights, most), seed)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, whole copies only, in docs' own columns.

    Rows that agree in doc_id, source and size share their copies as evenly as whole numbers allow, the odd ones by order of
    their texts' hashes; all other rows, those that share a doc_id only too, get their own.
    """
    sized = sized_rows(docs)
    copies = pivotal_copies(sized, source_targets(sized, weights, most), seed, split_last=False)
    copies = copies.groupBy(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"))
    copies = cut(copies.agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")), "copies")
    same_id = docs["doc_id"].eqNullSafe(copies["__id"])
    unique = copies.groupBy("__id").count().where("count > 1").isEmpty() and copies.where("__rows > 1").isEmpty()
    if unique:
        joined = docs.join(copies.where("__copies > 0"), same_id)
        nth = F.col("__copies")
    else:
        counted = docs.withColumn("__words", word_count(F.col("text")))
        same = same_id & counted["source"].eqNullSafe(copies["__source"]) & (counted["__words"] == copies["__size"])
        joined = counted.join(copies.where("__copies > 0"), same)
        place = F.row_number().over(W.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64("text"), "text"))
        nth = F.floor(F.col("__copies") / F.col("__rows")) + F.when(place <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
        joined = joined.withColumn("__nth", nth)
        nth = F.col("__nth")
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), nth.cast("int"))).alias("__copy")).drop("__copy")
