"""Readers and writers of row files: JSON lines, game records and engine transcripts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.operators.sequences import sessions_by_counter
from quarrymill.session import Scratch

SOURCE = T.StructType([
    T.StructField("game", T.StringType()), T.StructField("ply", T.IntegerType()), T.StructField("fen", T.StringType()), T.StructField("cp", T.IntegerType()),
    T.StructField("res", T.DoubleType()), T.StructField("label_authority", T.StringType()), T.StructField("game_unknown", T.BooleanType()),
])
#: Results of finished games, from white's side. Fixed values.
RESULTS = {"1-0": 1.0, "0-1": 0.0, "1/2-1/2": 0.5}


#: Up to so many splits of files are broadcast with their counts; more are joined by a shuffle.
BROADCAST_SPLITS = 50_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_row, row, value): the lines of text files that aren't blank, with their number in the file, from 0, and over all files in order of their paths.

    Files are read in splits, as many tasks as they have: a first pass counts each split's lines, and a second one adds
    what lies before the split. So no task has a file, and no line is moved unless there are very many splits.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    lines = lines.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__start"), F.spark_partition_id().alias("__task"), F.monotonically_increasing_id().alias("__id"))
    splits = lines.groupBy("source_file", "__start").agg(F.min("__id").alias("__first"), F.min("__task").alias("__of"), F.count(F.lit(1)).alias("n"))
    # One row a split, so the order over all of them is small.
    before = lambda *by: F.sum("n").over(Window.partitionBy(*by).orderBy("source_file", "__start")) - F.col("n")
    splits = Scratch(spark).table(splits.select("*", before("source_file").alias("__in_file"), before().alias("__in_all")).drop("n"), "splits")
    few = splits.count() <= BROADCAST_SPLITS
    found = lines.join(F.broadcast(splits) if few else splits, ["source_file", "__start"])
    # Both passes must have cut the files alike; changed settings or files between them would show here.
    at = F.when(F.col("__task") == F.col("__of"), F.col("__id") - F.col("__first")).otherwise(F.raise_error(F.lit("files or their splits changed while they were read")).cast("long"))
    return found.select("source_file", (F.col("__in_file") + at).alias("source_row"), (F.col("__in_all") + at).alias("row"), "value")


def read_rows(spark: SparkSession, path: str, schema: T.StructType = SOURCE) -> DataFrame:
    """Rows of JSON-lines files with the file they come from, their number in it from 0 (``source_row``) and over all files (``row``).

    Blank lines are no rows. Malformed lines have nulls and keep their text in ``_bad``.
    """
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"}).alias("__r")
    return numbered_lines(spark, path).select(parsed, "source_file", "source_row", "row").select("__r.*", "source_file", "source_row", "row")


def snapshot(rows: DataFrame, game: str = "game", counter: str = "ply") -> dict[str, int | str]:
    """What identifies an import: rows, games and a hash over every row with its place.

    rows: as ``read_rows`` gives them. A row's game is the named one, or else begins where the counter of its file
    doesn't advance; an empty name is none. The hash sums hashes of rows, so no task has the file.
    """
    named = rows.withColumn("__game", F.nullif(F.col(game), F.lit("")))
    games = sessions_by_counter(named.select("source_file", "source_row", counter, "__game"), "source_file", ["source_row"], counter, "__game")
    body = F.to_json(F.struct(*sorted(c for c in rows.columns if c not in ("source_file", "row"))), {"ignoreNullFields": "false"})
    files = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), content_hash(body).alias("h"))
    # Names of files don't count, but their order does, as rows are numbered by it.
    whole = files.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), content_hash(F.col("h")).alias("content_hash")).first()
    # Games that begin by counters are told apart by their file; named ones go by their name.
    count = games.select(F.coalesce("__game", F.concat_ws("/", "source_file", "session"))).distinct().count()
    return {"rows": whole["rows"], "games": count, "content_hash": whole["content_hash"]}


def write_rows(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; refuses to overwrite."""
    df.write.mode("errorifexists").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, for verification against a manifest."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def outcome(game_outcome: Column, res: Column, white_score: Column | None = None, is_struct: Column | None = None) -> Column:
    """A game's result: a struct's white score where the outcome is a struct (null, if that is), else the plain outcome, else ``res``.

    0.0 is a result, and only null falls back. ``is_struct`` tells where the outcome is a struct; without it, it is one where its score is known.
    """
    plain = F.coalesce(game_outcome, res)
    if white_score is None:
        return plain
    return F.when(is_struct if is_struct is not None else white_score.isNotNull(), white_score).otherwise(plain)


def merged_files(files: DataFrame) -> DataFrame:
    """Files (path, bytes, sha256) of equal content as one row: sha256, bytes, first path and the number of places."""
    return files.groupBy("sha256").agg(F.first("bytes").alias("bytes"), F.min("path").alias("path"), F.count(F.lit(1)).alias("places"))


TAG = re.compile(r'\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]\s*')
#: A comment, a bracket of a variation, an annotation, a move number, a result, or a move.
PART = re.compile(r"\{[^}]*\}|;[^\n]*|([()])|\$\d+|\d+\.+|(1-0|0-1|1/2-1/2|\*)|([^\s.(){}]+)")


def _moves(text: str) -> list[str]:
    """The moves of the game itself, without those of variations at any depth."""
    depth, out = 0, []
    for m in PART.finditer(text):
        depth = max(0, depth + (m[1] == "(") - (m[1] == ")"))
        if m[3] and not depth:
            out.append(m[3])
    return out


def parse_game(text: str) -> tuple | None:
    """(event, white, black, date, result, moves) of one game's text; None where it has neither tags nor moves."""
    tags, at = {}, len(text) - len(text.lstrip())
    # Tags stand before the moves; a bracket later on is part of a comment.
    while m := TAG.match(text, at):
        tags[m[1]], at = m[2], m.end()
    moves = _moves(text[at:])
    if tags or moves:
        return tags.get("Event"), tags.get("White"), tags.get("Black"), tags.get("Date"), RESULTS.get(tags.get("Result", "*")), moves
    return None


GAME = "event string, white string, black string, date string, result double, moves array<string>"


def _games(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        found = [game for text in batch["value"] if (game := parse_game(text))]
        yield pd.DataFrame(found, columns=["event", "white", "black", "date", "result", "moves"])


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Games of PGN files: tags, result (null if unfinished) and moves in their notation. One file may hold any number."""
    # Records end before each Event tag, whichever line ends the file has.
    texts = spark.read.option("lineSep", "[Event ").text(path).where(F.length(F.trim("value")) > 0)
    texts = texts.select(F.concat(F.lit("[Event "), F.regexp_replace("value", "\r\n?", "\n")).alias("value"))
    return texts.mapInPandas(_games, GAME)


def sampled_plies(games: DataFrame, every: int = 4, least: int = 8) -> DataFrame:
    """(game columns, ply, move) at each ply that is a multiple of ``every`` and at least ``least``."""
    body = [c for c in games.columns if c != "moves"]
    return games.select(*body, F.posexplode("moves").alias("ply", "move")).where((F.col("ply") >= least) & (F.pmod("ply", F.lit(every)) == 0))


def parse_info(line: Column) -> Column:
    """An engine's "info" line as a struct: depth, seldepth, multipv, nodes, time, hashfull, cp, mate and pv; null fields where a token is missing."""
    number = lambda key: F.nullif(F.regexp_extract(line, rf"\b{key} (-?\d+)", 1), F.lit("")).cast("long")
    pv = F.regexp_extract(line, r"\bpv (.+)$", 1)
    plain = [number(k).alias(k) for k in ("depth", "seldepth", "multipv", "nodes", "time", "hashfull")]
    return F.struct(*plain, number("score cp").alias("cp"), number("score mate").alias("mate"), F.when(pv != "", F.split(pv, " ")).alias("pv"))


def best_move(line: Column) -> Column:
    """The move of an engine's "bestmove" line; null for other lines and for (none)."""
    return F.nullif(F.nullif(F.regexp_extract(line, r"^bestmove (\S+)", 1), F.lit("")), F.lit("(none)"))


def canonical_lines(df: DataFrame) -> DataFrame:
    """(line) with each row as JSON, columns sorted by name and nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def content_hash(text: Column, times: Column | None = None) -> Column:
    """An aggregate: a hash of all texts of a group, with their repeats and whatever their order; ``times`` tells how often a text is there.

    The eight 32-bit lanes of the texts' SHA-256 are summed, which combines before the shuffle and needs no task with all
    rows, and the sums are hashed.
    """
    digest = F.sha2(text, 256)
    part = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10)
    each = lambda i: part(i).cast("decimal(28,0)") if times is None else (part(i).cast("decimal(10,0)") * times.cast("decimal(17,0)"))
    lane = lambda i: F.sum(each(i)).cast("string")
    return F.sha2(F.concat_ws(",", *map(lane, range(8))), 256)


def write_lines(df: DataFrame, path: str) -> tuple[int, str]:
    """Writes canonical lines once, refusing to overwrite; gives back the number of rows and the hash of their content."""
    canonical_lines(df).write.mode("errorifexists").text(path)
    row = df.sparkSession.read.text(path).agg(F.count(F.lit(1)).alias("rows"), content_hash(F.col("value")).alias("sha256")).first()
    return row["rows"], row["sha256"]
