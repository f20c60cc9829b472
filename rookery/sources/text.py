"""Readers of result files, rating tables, logs and metrics, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators.ratings import RESULTS

def parse_game_text(df: DataFrame, text: str = "value") -> DataFrame:
    """(white, black, result) from one game's tag lines per row: the last White and Black tags count; rows without both,
    or with a result that isn't one of the three, are dropped."""
    last = lambda tag: F.regexp_extract(F.col(text), rf'(?s)^.*\[{tag} "([^"\n]*)"\]', 1)
    rows = df.select(last("White").alias("white"), last("Black").alias("black"), last("Result").alias("result"))
    return rows.where((F.col("white") != "") & (F.col("black") != "") & F.col("result").isin(*RESULTS))


def read_game_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Games of PGN files: each file is split at its Event tags, so large files are read in parallel."""
    return parse_game_text(spark.read.text(paths, lineSep="[Event "))


def parse_rating_lines(df: DataFrame, text: str = "value") -> DataFrame:
    """(net, run_id, epoch, elo, elo_error) of lines that name a net; lines whose numbers can't be read are dropped."""
    f = F.split(F.trim(F.col(text)), r"\s+")
    rows = df.where(F.col(text).contains("nn-epoch")).select(F.get(f, F.lit(1)).alias("net"), F.get(f, F.lit(3)).try_cast("double").alias("elo"), F.get(f, F.lit(4)).try_cast("double").alias("elo_error"))
    number = lambda p: F.regexp_extract("net", p, 1).try_cast("int")
    rows = rows.select("net", number(r"run_(\d+)").alias("run_id"), number(r"nn-epoch(\d+)").alias("epoch"), "elo", "elo_error")
    return rows.where("elo IS NOT NULL AND elo_error IS NOT NULL")


def read_rating_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_rating_lines(spark.read.text(paths))


def rating_lines(standings: DataFrame, anchor: str = "master") -> DataFrame:
    """(place, line): the fixed-width line of each player of a leaderboard; the anchor shows 0.0 and ----."""
    own = F.col("player") == anchor
    elo_text = F.when(own, "0.0").otherwise(F.format_string("%.1f", "elo"))
    error_text = F.when(own, "----").otherwise(F.format_string("%.1f", "elo_error"))
    share = F.format_string("%d", F.rint(F.col("score_rate") * 100).cast("int"))
    line = F.concat(
        F.lit("   "), F.lpad(F.col("place").cast("string"), 2, " "), F.lit(" "), F.when(F.length("player") < 26, F.rpad("player", 26, " ")).otherwise(F.col("player")),
        F.lit(" : "), F.lpad(elo_text, 7, " "), F.lit(" "), F.lpad(error_text, 6, " "), F.lit(" "), F.lpad(F.format_string("%.1f", "points"), 9, " "),
        F.lit(" "), F.lpad(F.col("games").cast("string"), 7, " "), F.lit(" "), F.lpad(share, 4, " "),
    )
    return standings.select("place", line.alias("line"))


def write_rating_table(standings: DataFrame, path: str, anchor: str = "master") -> None:
    """One text file of ranked lines under a heading; it has a line per player, so one task writes it."""
    head = standings.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit("    # PLAYER                     :  RATING  ERROR    POINTS  PLAYED  (%)").alias("line"))
    head.unionByName(rating_lines(standings, anchor)).coalesce(1).sortWithinPartitions("place").select("line").write.text(path)


def parse_training_log(df: DataFrame, text: str = "value") -> DataFrame:
    """df's lines as (epoch, step, steps_total, rate, loss, message, out_of_memory). A progress line has the first five:
    `Epoch N ... step/total [times, R it/s, loss=L, ...]`, with `loss` or `train_loss`; all others are messages.

    A line is cut at its bracket, the part before it at blanks and bars, the part behind it at commas and equal signs.
    """
    line = F.col(text)
    halves = F.split(line, r"\[", 2)
    head = F.filter(F.split(F.get(halves, F.lit(0)), r"[ |]"), lambda w: w != "")
    fields = F.transform(F.split(F.replace(F.get(halves, F.lit(1)), F.lit("]"), F.lit("")), ","), lambda f: F.trim(f))
    rate = F.get(F.filter(fields, lambda f: f.endswith("it/s")), F.lit(0))
    loss = F.get(F.filter(fields, lambda f: F.substring_index(f, "=", 1).isin("loss", "train_loss")), F.lit(0))
    done = F.split(F.element_at(head, -1), "/")
    parts = {
        "epoch": F.when(F.get(head, F.lit(0)) == "Epoch", F.rtrim(F.get(head, F.lit(1)), F.lit(":"))).try_cast("int"),
        "step": F.get(done, F.lit(0)).try_cast("bigint"), "steps_total": F.get(done, F.lit(1)).try_cast("bigint"),
        "rate": F.substring_index(rate, "it/s", 1).try_cast("double"), "loss": F.substring_index(loss, "=", -1).try_cast("double"),
    }
    rows = df.withColumn("__p", F.struct(*[c.alias(n) for n, c in parts.items()]))
    whole = F.lit(True)
    for n in parts:
        whole = whole & F.col(f"__p.{n}").isNotNull()
    oom = line.contains("CUDA_ERROR_OUT_OF_MEMORY") | line.contains("CUDA out of memory")
    other = [c for c in df.columns if c != text]
    return rows.select(*other, *[F.when(whole, F.col(f"__p.{n}")).alias(n) for n in parts], F.when(~whole, line).alias("message"), oom.alias("out_of_memory"))


def read_training_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Parsed lines of log files; with stream, of a folder as files arrive."""
    lines = spark.readStream.text(path) if stream else spark.read.text(path)
    return parse_training_log(lines)


def parse_match_progress(df: DataFrame, text: str = "value") -> DataFrame:
    """(run_id, epoch, wins, losses, draws, score_rate) of `Score of master vs net: losses - wins - draws` lines, as the net sees it.

    A line is cut at its colon; the net's name before it is cut at slashes, the counts behind it at blanks.
    """
    halves = F.split(F.col(text), ": ", 2)
    named = F.split(F.substring_index(F.get(halves, F.lit(0)), " ", -1), "/")
    count = F.split(F.trim(F.get(halves, F.lit(1))), " +")
    after = lambda start: F.get(F.filter(named, lambda x: x.startswith(start)), F.lit(0))
    number = lambda i: F.get(count, F.lit(i)).try_cast("int")
    rows = df.where(F.col(text).startswith("Score of ") & (F.get(count, F.lit(1)) == "-") & (F.get(count, F.lit(3)) == "-")).select(
        F.substring(after("run_"), 5, 20).try_cast("int").alias("run_id"), F.replace(F.substring(after("nn-epoch"), 9, 40), F.lit(".nnue"), F.lit("")).try_cast("int").alias("epoch"),
        number(2).alias("wins"), number(0).alias("losses"), number(4).alias("draws"),
    )
    rows = rows.where("run_id IS NOT NULL AND epoch IS NOT NULL AND wins IS NOT NULL AND losses IS NOT NULL AND draws IS NOT NULL")
    n = F.col("wins") + F.col("losses") + F.col("draws")
    return rows.withColumn("score_rate", F.when(n > 0, (F.col("wins") + F.col("draws") * F.lit(0.5)) / n))


def read_match_progress(spark: SparkSession, path: str) -> DataFrame:
    return parse_match_progress(spark.read.text(path))


def read_metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, epoch, step, name, value) from CSV files whose headers differ; missing and unreadable values give no row.

    Files are read as lines, once for each use; the line that names the columns is that at a file's start, told by the least number of a
    file's lines, so that no line is sorted or held to find it, and every other line meets it in a join by path. The heads, one line a
    file, are sent to all tasks.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("line")).where("trim(line) <> ''")
    firsts = lines.where("block = 0").groupBy("path").agg(F.min("k").alias("k"))
    heads = lines.where("block = 0").join(F.broadcast(firsts), ["path", "k"])
    head = heads.select("path", F.split(F.regexp_replace("line", r"\r$", ""), ",").alias("names"))
    rows = lines.join(F.broadcast(head), "path").withColumn("values", F.split(F.regexp_replace("line", r"\r$", ""), ",")).where("values <> names")
    cells = rows.select("path", F.map_from_arrays(F.slice("names", F.lit(1), F.least(F.size("names"), F.size("values"))), F.slice("values", F.lit(1), F.least(F.size("names"), F.size("values")))).alias("m"))
    long = cells.select("path", F.col("m")["epoch"].try_cast("int").alias("epoch"), F.col("m")["step"].try_cast("bigint").alias("step"), F.explode("m").alias("name", "text"))
    return long.where(~F.col("name").isin("epoch", "step")).select("path", "epoch", "step", "name", F.col("text").try_cast("double").alias("value")).where("value IS NOT NULL")


def parse_artifact_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """df with kind, run_id and epoch from its paths: nn-epochN.nnue and epoch=N….ckpt; last.ckpt has no epoch."""
    p = F.col(path)
    epoch = F.coalesce(F.nullif(F.regexp_extract(p, r"nn-epoch(\d+)\.nnue$", 1), F.lit("")), F.nullif(F.regexp_extract(p, r"epoch=(\d+)[^/]*\.ckpt$", 1), F.lit("")))
    return df.withColumns({"kind": F.regexp_extract(p, r"\.(nnue|ckpt)$", 1), "run_id": F.regexp_extract(p, r"run_(\d+)", 1).try_cast("int"), "epoch": epoch.try_cast("int")})


def scan_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, length, kind, run_id, epoch) of nets and checkpoints below root. File contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{nnue,ckpt}").load(root)
    return parse_artifact_paths(files.select("path", F.unix_micros("modificationTime").alias("mtime"), "length"))


def append_games(new: DataFrame, table_path: str, round_id: int) -> None:
    """This round's games added to a Parquet table, unless the table has the round already: a repeated call adds nothing."""
    spark = new.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    rows = new.withColumn("round_id", F.lit(round_id))
    if there:
        rows = rows.join(spark.read.parquet(table_path).select("round_id").distinct(), "round_id", "left_anti").select(*rows.columns)
    rows.write.mode("append").parquet(table_path)
