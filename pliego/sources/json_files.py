"""JSON data sets in their three shapes, and JSON and CSV writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, record, keys): the records of JSON files, each as text with its own field names.

    A file is a list of records, an object with the records under ``data``, or that with its
    metadata under ``meta``. keys tells a field that is null from one that is absent. A file
    that is no JSON stops the job.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.parse_json("value").alias("v"))
    listed = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(F.variant_get("v", "$.data", "variant"))
    rows = files.select("file", F.posexplode(F.try_variant_get(listed, "$", "array<variant>")).alias("position", "r"))
    rows = rows.select("file", "position", F.to_json("r").alias("record"))
    return rows.withColumn("keys", F.json_object_keys("record"))


def typed(records: DataFrame, schema: str) -> DataFrame:
    """records with the fields of a schema as columns."""
    return records.withColumn("_r", F.from_json("record", schema)).select("*", "_r.*").drop("_r")


def last_by_id(records: DataFrame, ident: str = "id") -> DataFrame:
    """The last record of each id; records without one go."""
    last = F.max_by(F.struct(*records.columns), F.struct("file", "position"))
    return records.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("_id")).agg(last.alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str, arrays: list[str] = ()) -> None:
    """Semicolon-separated, all fields quoted, quotes doubled, arrays joined by commas."""
    flat = df.withColumns({c: F.array_join(c, ",") for c in arrays}) if arrays else df
    flat.write.mode("overwrite").option("header", True).csv(path, sep=";", quoteAll=True, escape='"')


def write_envelope(df: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Records as JSON lines under data/, and one line of metadata with their number under meta/."""
    df.write.mode("overwrite").json(f"{path}/data")
    counted = df.agg(F.count("*").alias("records")).select("*", *(F.lit(v).alias(k) for k, v in meta.items()))
    counted.write.mode("overwrite").json(f"{path}/meta")


def write_document(rows: DataFrame, path: str, meta: dict, position: str, name: str = "data") -> None:
    """One JSON document {"meta": ..., name: [rows]} as text: its part files joined in the order of their names.

    Rows are sorted by ``position``, which must be unique, over all tasks. The metadata gets
    the number of records.
    """
    spark = rows.sparkSession
    n, first = rows.agg(F.count("*"), F.min(position)).first()
    told = json.dumps(meta | {"records": n}, ensure_ascii=False)
    record = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    body = rows.select(F.when(F.col(position) == first, record).otherwise(F.concat(F.lit(","), record)).alias("line"), F.lit(1).alias("_part"), F.col(position).alias("_at"))
    ends = spark.createDataFrame([(f'{{"meta":{told},{json.dumps(name)}:[', 0), ("]}", 2)], "line string, _part int").withColumn("_at", F.lit(None).cast(rows.schema[position].dataType))
    body.unionByName(ends).orderBy("_part", "_at").select("line").write.mode("overwrite").text(path)
