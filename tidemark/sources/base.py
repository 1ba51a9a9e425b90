"""What every session source gives: sessions, messages, events and usage, as DataFrames.

sessions: reader, session_id, path, modified, persona, channel, seat, agent, machine, dedupe_key
messages: path, seq, role, content (variant), name
events:   path, seq, kind, ts, tool_name, detail
usage:    path, seq, model, cost, input_tokens, output_tokens (one row for each priced response)

seq orders the rows of one file. Lines that are no JSON are left out.
"""

from __future__ import annotations

import os
import re
from abc import ABC, abstractmethod
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import content as C
from tidemark.functions import text as X

SESSIONS = "reader string, session_id string, path string, modified timestamp, persona string, channel string, seat string, agent string, machine string, dedupe_key string"
MESSAGES = "path string, seq long, role string, content variant, name string"
EVENTS = "path string, seq long, kind string, ts timestamp, tool_name string, detail string"
USAGE = "path string, seq long, model string, cost decimal(28,12), input_tokens long, output_tokens long"
MODEL_COSTS = "path string, model string, cost decimal(28,12)"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def fitted(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the schema's columns; those it lacks are null."""
    out = []
    for field in schema.split(", "):
        name, _, kind = field.partition(" ")
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def existing(spark: SparkSession, roots: Sequence[str]) -> list[str]:
    """The roots (paths or globs) that there are: one that is missing must not cost the others."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for r in roots:
        path = jvm.org.apache.hadoop.fs.Path(r) if r else None
        if path and path.getFileSystem(conf).globStatus(path):
            out.append(r)
    return out


def escaped(path: str) -> str:
    """A path as a glob that fits only itself."""
    return re.sub(r"([\[\]{}*?\\,])", r"\\\1", path)


def _path_columns() -> list[Column]:
    path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    return [path.alias("path"), F.date_trunc("second", "_metadata.file_modification_time").alias("modified")]


def listed_files(spark: SparkSession, roots: Sequence[str], pattern: str, names: str = "*.jsonl") -> DataFrame:
    """path and modified (whole seconds) of the files whose path matches; none is opened."""
    kept = existing(spark, roots)
    if not kept:
        return spark.createDataFrame([], "path string, modified timestamp")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(kept)
    return found.filter(F.col("_metadata.file_path").rlike(pattern)).select(*_path_columns())


def text_lines(spark: SparkSession, roots: Sequence[str], pattern: str, names: str = "*.jsonl") -> DataFrame:
    """path, modified (whole seconds), seq and line of every line of files whose path matches.

    Files are pruned by path before any is read. A large file may be read in
    several splits: lines go by where their split begins, then by their place in it.
    """
    kept = existing(spark, roots)
    if not kept:
        return spark.createDataFrame([], "path string, modified timestamp, seq long, line string")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).option("lineSep", "\n").text(kept)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    named = raw.filter(F.col("_metadata.file_path").rlike(pattern)).select(*_path_columns(), place.alias("place"), F.regexp_replace("value", "\r$", "").alias("line"))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("place")).cast("long")
    return named.select("path", "modified", seq.alias("seq"), "line")


def json_lines(lines: DataFrame) -> DataFrame:
    """The lines that are JSON, with their value as v."""
    return lines.withColumn("v", F.try_parse_json("line")).filter("v IS NOT NULL").drop("line")


def directory(path: Column, up: int = 1) -> Column:
    """The name of the directory that holds path, or of one further up."""
    return F.element_at(F.split(path, "/"), -1 - up)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def long_at(v: Column, path: str) -> Column:
    """A whole number that is not negative, else 0."""
    found = F.try_variant_get(v, path, "long")
    number = C.kind(C.at(v, path)) == "number"
    return F.coalesce(F.when(number & (found >= 0), found), F.lit(0).cast("long"))


def decimal_at(v: Column, path: str) -> Column:
    """A JSON number or numeric string, by its text."""
    return X.exact_decimal(C.as_string(C.at(v, path)))


@F.pandas_udf(StringType())
def canonical(paths: pd.Series) -> pd.Series:
    """A local file's path without links; other paths as they are."""
    return paths.map(lambda p: "file://" + os.path.realpath(p.removeprefix("file:").replace("//", "/", 1) if p.startswith("file://") else p.removeprefix("file:")) if p.startswith("file:") else p)


class Reader(ABC):
    """A source of sessions; subclasses say where its files are and what their lines mean.

    sessions() lists files without reading them. After only(), messages, events and
    usage read no folders but those of the chosen sessions.
    """

    name = "reader"
    pattern, names = "[.]jsonl$", "*.jsonl"

    def __init__(self, spark: SparkSession, roots: Sequence[str]):
        self.spark = spark
        self.roots = list(roots)
        self.chosen: list[str] | None = None

    def only(self, paths: Sequence[str]) -> None:
        """Limits what is read to the folders of these session files."""
        self.chosen = sorted({escaped(p.rsplit("/", 1)[0]) for p in paths})

    def _lines(self, pattern: str | None = None, names: str | None = None) -> DataFrame:
        return text_lines(self.spark, self.roots if self.chosen is None else self.chosen, pattern or self.pattern, names or self.names)

    def _listed(self, pattern: str | None = None, names: str | None = None) -> DataFrame:
        return listed_files(self.spark, self.roots, pattern or self.pattern, names or self.names)

    @abstractmethod
    def sessions(self) -> DataFrame: ...

    @abstractmethod
    def messages(self) -> DataFrame: ...

    def events(self) -> DataFrame:
        return empty(self.spark, EVENTS)

    def usage(self) -> DataFrame:
        return empty(self.spark, USAGE)

    def model_costs(self) -> DataFrame:
        """Costs by model that usage() does not give by row: path, model, cost."""
        return empty(self.spark, MODEL_COSTS)

    def since(self, cutoff: Column) -> DataFrame:
        """Sessions modified at or after the cutoff, by path."""
        return self.sessions().filter(F.col("modified") >= cutoff).orderBy("path")

    def _named(self, files: DataFrame, session_id: Column, **more: Column) -> DataFrame:
        listed = files.select("path", "modified").withColumns({"reader": F.lit(self.name), "session_id": session_id} | more)
        if "dedupe_key" not in more:
            listed = listed.withColumn("dedupe_key", F.col("session_id"))
        return fitted(listed, SESSIONS)
