"""Landing files with records that can't be read set aside.

Files come as json lines or csv with a declared schema.  A record that doesn't fit it -- cut off, a text
where a number belongs, too many fields -- is kept as text in a table of its own, with the name of its
file, and never fails the read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

BAD = "_bad_record"
#: Shapes of the landing files.
TEAM = "id bigint, full_name string, abbreviation string"
ROSTER = "PLAYER string, PLAYER_ID bigint, TEAM_ID bigint"
PLAYER = "id bigint, full_name string, team_id bigint"
INFO = "PERSON_ID bigint, DISPLAY_FIRST_LAST string, POSITION string, HEIGHT string, TEAM_ID bigint"


def read_landing(spark: SparkSession, path: str, schema: str, fmt: str = "json", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows that fit ``schema``, and (file, record) of those that don't."""
    declared = StructType.fromDDL(schema)
    r = spark.read.schema(StructType([*declared.fields]).add(BAD, StringType())).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    rows = r.option("header", header).csv(path) if fmt == "csv" else r.json(path)
    # Spark refuses plans that ask a file for the bad records alone (a count, say), so every plan asks for the other columns too
    rows = rows.withColumn("__file", F.input_file_name()).where(F.pmod(F.xxhash64(*declared.names), F.lit(2)) >= 0)
    return rows.where(F.col(BAD).isNull()).drop(BAD, "__file"), rows.where(F.col(BAD).isNotNull()).select(
        F.regexp_extract("__file", "[^/]*$", 0).alias("file"), F.col(BAD).alias("record"))


def store_bad(bad: DataFrame, path: str, source: str) -> None:
    """Append set-aside records to their table, partitioned by where they came from."""
    bad.withColumn("source", F.lit(source)).write.mode("append").partitionBy("source").parquet(path)


def read_teams(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """A1."""
    return read_landing(spark, path, TEAM, fmt)


def read_players(spark: SparkSession, paths: dict[str, str], fmt: str = "json", team_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A2: (id, name, team_id) from files of both shapes, ``{shape: path}`` with shapes ``roster`` and ``player``."""
    good, bad = None, None
    for shape, path in paths.items():
        rows, wrong = read_landing(spark, path, {"roster": ROSTER, "player": PLAYER}[shape], fmt)
        rows = (rows.select(F.col("PLAYER_ID").alias("id"), F.col("PLAYER").alias("name"), F.col("TEAM_ID").alias("team_id")) if shape == "roster"
                else rows.select("id", F.col("full_name").alias("name"), "team_id"))
        good, bad = (rows, wrong) if good is None else (good.unionByName(rows), bad.unionByName(wrong))
    return (good if team_id is None else good.where(F.col("team_id") == team_id)), bad


def read_player_info(spark: SparkSession, path: str, players: DataFrame | int, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """A3: the info of one player, or of all in a table with a column ``id``."""
    good, bad = read_landing(spark, path, INFO, fmt)
    if isinstance(players, int):
        return good.where(F.col("PERSON_ID") == players), bad
    ids = players.select(F.col("id").alias("__id")).distinct()
    return good.join(ids, F.col("PERSON_ID") == F.col("__id"), "left_semi"), bad
