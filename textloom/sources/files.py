"""File sources and sinks with fixed schemas."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "version_id string, bill_id long, bill_type string, format_type string, chunks int, chars long, contiguous string"
GOLD = (
    "versionId string, billType string, format string, labelStatus string, parserUsed string, summary string, "
    "sections array<struct<index: int, identifier: string, heading: string, kind: string, charLength: int, description: string>>, "
    "groups array<struct<groupId: string, sectionIndices: array<int>, conceptLabel: string, taxonomyNodeIds: array<string>>>"
)
RETRIEVAL = "queryId string, text string, versionId string, conceptLabel string, relevant array<struct<versionId: string, sectionIndex: int>>"
SUBJECTS = "versionId string, billId long, congress int, billType string, number string, policyArea string, subjects array<string>"


def corpus(spark: SparkSession, manifest: str, texts: str) -> DataFrame:
    """The manifest's rows with the text of ``<version_id>.txt`` in the folder ``texts``; a malformed row is fatal."""
    rows = spark.read.csv(manifest, schema=MANIFEST, sep="\t", header=True, mode="FAILFAST")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    bodies = spark.read.text(f"{texts}/*.txt", wholetext=True).select(name.alias("version_id"), F.col("value").alias("content"))
    return rows.join(bodies, "version_id")


def tsv3(spark: SparkSession, path: str) -> DataFrame:
    """(version_id, bill_type, text) of a file of three columns; the text may hold tabs, rows of blank text are dropped."""
    parts = F.split("value", "\t", 3)
    rows = spark.read.text(path).select(parts[0].alias("version_id"), parts[1].alias("bill_type"), parts[2].alias("text"))
    return rows.where(F.trim("text") != "")


def base64_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(version_id, bill_type, format_type, text) of a file whose fourth column is base64 of UTF-8; empty texts are dropped."""
    p = F.split("value", "\t", 4)
    rows = spark.read.text(path).select(p[0].alias("version_id"), p[1].alias("bill_type"), p[2].alias("format_type"), F.decode(F.unbase64(p[3]), "UTF-8").alias("text"))
    return rows.where("text <> ''")


def write_base64_tsv(df: DataFrame, path: str) -> None:
    """The inverse of ``base64_tsv``."""
    encoded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"[\r\n]", "")
    df.select(F.concat_ws("\t", "version_id", "bill_type", "format_type", encoded)).write.mode("overwrite").text(path)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """One labelled document per file; anything that does not fit the schema is fatal."""
    return spark.read.schema(GOLD).json(path, multiLine=True, mode="FAILFAST")


def retrieval_gold(spark: SparkSession, path: str) -> DataFrame:
    """The queries of a file that holds a list of them."""
    return spark.read.schema(RETRIEVAL).json(path, multiLine=True, mode="FAILFAST")


def subjects(spark: SparkSession, path: str) -> DataFrame:
    """(versionId, subjects) per file; a bad or missing list is empty."""
    return spark.read.schema(SUBJECTS).json(path, multiLine=True, mode="PERMISSIVE").select("versionId", F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"))


def pdf_texts(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """(path, text, error) of binary files by a pluggable extractor; content that is no PDF is an error, not a failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"]):
                try:
                    if not bytes(data).lstrip().startswith(b"%PDF"):
                        raise ValueError("not a PDF")
                    rows.append((name, extract(bytes(data)), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")


def directory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, compressed, ratio) of every file under a folder that holds anything, at any depth; ratio is compressed by plain size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            small = [len(zlib.compress(bytes(c), 6)) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "size": batch["length"], "compressed": small})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "content").mapInPandas(run, "path string, size long, compressed long").withColumn("ratio", F.col("compressed") / F.col("size"))


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 16, **options: str) -> DataFrame:
    """A table read in parallel ranges of a numeric key."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options)
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **options: str) -> None:
    """Rows appended to a table, in batches by every task."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode(mode).save()


def stats_artifact(path: str, dim: int) -> tuple[list[float], list[float]]:
    """(mean, std) of a statistics artifact, dimensions checked."""
    try:
        data = json.loads(Path(path).read_text())
    except ValueError as e:
        raise ValueError(f"statistics: not JSON: {e}") from e
    for name in ("mean", "std"):
        if name not in data:
            raise ValueError(f"statistics: missing field {name}")
        if len(data[name]) != dim:
            raise ValueError(f"statistics: {name} has {len(data[name])} components, not {dim}")
    return data["mean"], data["std"]


def idf_artifact(spark: SparkSession, path: str) -> DataFrame:
    """(term, idf) of an artifact {n, idf: {term: value}}."""
    rows = spark.read.schema("n int, idf map<string, double>").json(path, multiLine=True, mode="FAILFAST")
    return rows.select(F.explode("idf").alias("term", "idf"))


def markdown_table(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small result as a Markdown table; it is brought to the driver, so more than ``most`` rows are an error."""
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    rows = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def check_schema(df: DataFrame, expected: dict[str, tuple[str, bool]]) -> list[str]:
    """What a table lacks of a contract {column: (type, nullable)}; more columns are allowed, a required column may not be nullable."""
    have = {f.name: (f.dataType.simpleString(), f.nullable) for f in df.schema.fields}
    out = []
    for name, (kind, nullable) in expected.items():
        if name not in have:
            out.append(f"{name}: missing")
        elif have[name][0] != kind:
            out.append(f"{name}: {have[name][0]}, not {kind}")
        elif not nullable and have[name][1]:
            out.append(f"{name}: nullable")
    return out


def cached_embeddings(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], path: str) -> DataFrame:
    """(key, embedding) of every row, read from the table at ``path`` where it is there; the rest is computed once and added."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    missing = df.join(spark.read.parquet(path).select(key), key, "left_anti") if there else df
    embed(missing.dropDuplicates([key]), key, text, model).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(df.select(key).distinct(), key, "left_semi")


def embed(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 64, most: int | None = 4000) -> DataFrame:
    """(key, embedding) by a pluggable model, ``batch`` texts at a time, the first ``most`` characters of each as the model takes them; None for all."""
    rows = df.select(F.col(key).alias("key"), (F.substring(F.col(text), 1, most) if most else F.col(text)).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i: i + batch]
                yield pd.DataFrame({"key": part["key"], "embedding": model(part["text"].fillna("").tolist())})

    return rows.mapInPandas(run, f"key {rows.dtypes[0][1]}, embedding array<float>").withColumnRenamed("key", key)
