"""The batch pipeline run on arriving chunks: versions are put together over all batches, parsed and merged into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import relational as R
from ..operators import structure as S

KEYS = ["version_id", "section_index"]
CHUNK = ["version_id", "chunk_index", "content"]


def merged(target: DataFrame | None, chunks: DataFrame) -> DataFrame:
    """The section table after the chunks of some versions: their sections replace what is stored.

    ``chunks`` holds all that is known of those versions; those still incomplete change nothing. A column
    ``format_type``, if there is one, routes the parser; without it contents are texts.
    """
    whole = S.reassemble(chunks.select(*CHUNK).distinct()).where("content is not null")
    if "format_type" in chunks.columns:
        label = chunks.groupBy("version_id").agg(F.max("format_type").alias("format_type"))
        new = S.parse_document(whole.join(label, "version_id"), "version_id", "content", "format_type")
    else:
        new = S.parse_text(whole, "version_id", "content")
    new = new.select("version_id", "section_index", "section_identifier", "kind", "content")
    return new if target is None else R.replace_children(target, new, "version_id")


def start(stream: DataFrame, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Merge each micro-batch of ``stream`` into the parquet table at ``table``.

    Arriving chunks are kept by batch; the versions that a batch touches are put together again from all their
    chunks, so a version whose chunks arrive apart is parsed when its last one is there; a chunk that is delivered
    again replaces the one before. A batch writes a new
    generation beside the old one and then names it in ``_current``; a batch that is run again after a failure
    gives the same files, so replays change nothing. Generations before the last two are removed.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        current = _current(spark, table)
        if current is not None and current >= number:
            return
        kept = [c for c in (*CHUNK, "format_type") if c in batch.columns]
        batch.where("version_id is not null").select(*kept).write.mode("overwrite").parquet(f"{table}/chunks/batch={number}")
        every = spark.read.parquet(f"{table}/chunks").where(F.col("batch") <= number)
        chunks = every.join(every.where(F.col("batch") == number).select("version_id").distinct(), "version_id", "left_semi")
        chunks = R.latest(chunks, ["version_id", "chunk_index"], ["batch", "content"]).drop("batch")
        target = spark.read.parquet(f"{table}/g{current}") if current is not None else None
        merged(target, chunks).write.mode("overwrite").parquet(f"{table}/g{number}")
        spark.createDataFrame([(number,)], "generation long").coalesce(1).write.mode("overwrite").parquet(f"{table}/_current")
        _swept(spark, table, {current, number})

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _swept(spark: SparkSession, table: str, keep: set[int | None]) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in files.listStatus(path):
        name = entry.getPath().getName()
        if name[:1] == "g" and name[1:].isdigit() and int(name[1:]) not in keep:
            files.delete(entry.getPath(), True)


def _current(spark: SparkSession, table: str) -> int | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/_current")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("generation long").parquet(f"{table}/_current").agg(F.max("generation")).first()[0]


def read(spark: SparkSession, table: str) -> DataFrame:
    """The section table's last generation."""
    return spark.read.parquet(f"{table}/g{_current(spark, table)}")
