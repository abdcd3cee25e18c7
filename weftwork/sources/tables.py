"""Readers and writers for the file formats the pipelines use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from weftwork.functions import text as T


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",", fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """A delimited table with header, or parquet.

    ``multi_line``: quoted fields may hold line breaks; each file is then read by one task.

    Without a schema all CSV columns are strings: no extra pass over the data to guess types.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_json_records(spark: SparkSession, path: str, fields: Sequence[str], schema: StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """JSON arrays of records, reduced to the listed fields: one array a file, or with ``multi_line``
    off one array a line, which lets several tasks share a file."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path).select(*fields)


def json_fields(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Fields of a JSON string column as columns; malformed text gives nulls."""
    return df.withColumn("_j", F.from_json(col, schema)).select(*df.columns, "_j.*")


def parse_annotations(df: DataFrame, text: str) -> DataFrame:
    """White-space tokens in lower case without 'n/a'; ``label`` tells whether any is left."""
    codes = F.filter(T.split_ws(F.lower(text)), lambda c: c != "n/a")
    return df.withColumn("codes", codes).withColumn("label", (F.size("codes") > 0).cast("int"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One file per item, named by its id: (item, codes, label)."""
    files = spark.read.text(path, wholetext=True).withColumn("_f", F.input_file_name())
    item = F.regexp_extract("_f", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return parse_annotations(files.select(item.alias("item"), F.col("value").alias("text")), "text").drop("text")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(T.strip(F.col("value")).alias("id")).filter("id <> ''")


def file_catalog(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files below ``root`` matching ``glob``: path, label (parent folder), size, time. The files
    themselves are not read, since only metadata columns are selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"), "length", "modificationTime")


def resolve_column(df: DataFrame, name: str, alternatives: Sequence[str]) -> DataFrame:
    """Rename the first present alternative to ``name``; fail when there is none."""
    for c in [name, *alternatives]:
        if c in df.columns:
            return df if c == name else df.withColumnRenamed(c, name)
    raise ValueError(f"none of {[name, *alternatives]} in {df.columns}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def submission(df: DataFrame, id_col: str, p: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(p).cast("double").alias("prediction"))


def save_model(model: MLWritable, path: str) -> None:
    wrapped = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    wrapped.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
