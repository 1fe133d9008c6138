"""Catalogues report texts as they arrive: what came in, from where, and whether its content was there before.

Tools deliver their reports as text, often the same one again. Before anything parses them, this job takes each new text
once: its SHA-256 (the catalog's key of a source file), size, lines, words, how many figures it holds, and the text
that first had this content. A table's files are a stream with a checkpoint, so a run takes only files that no run before
took, and ends when there are no more.

    python -m jobs.text_intake --config jobs/text_intake.json [--input DIR] [--output DIR] [--checkpoint DIR]

``output/texts`` is partitioned by table, source and batch, ``output/contents`` (contents first seen, one row each) by table and
batch. A batch that is run again after a failure, which has the same number and files, replaces its own partitions, so a rerun
changes nothing. Contents are first had by the earlier batch, then by the smaller id.

Defined results: a null text is empty; a null id is kept and is nobody's first unless all of that content lack one (then
``first_id`` is null and no row counts as a repeat); rows of one id and content are one text delivered twice: neither repeats
the other; a null source is kept; an empty table gives no rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main

WORD = r"[^\x20\x09-\x0D]+"
FIGURE = r"[0-9]+(\.[0-9]+)?"
DESCRIBED = "id long, source string, sha256 string, n_bytes long, n_lines long, n_words long, n_figures long"
TEXTS = "id long, sha256 string, n_bytes long, n_lines long, n_words long, n_figures long, first_id long, repeated boolean, table string, source string, batch long"
CONTENTS = "sha256 string, first_id long, table string, batch long"


def described(rows: DataFrame, table: dict) -> DataFrame:
    """A row a text, without the text: all that is told of one text alone. Narrow: no shuffle."""
    text = F.coalesce(F.col(table["text"]).cast("string"), F.lit(""))
    source = F.col(table["source"]).cast("string") if table.get("source") else F.lit(None).cast("string")
    rows = rows.select(F.col(table["id"]).cast("long").alias("id"), source.alias("source"), text.alias("text"))
    return rows.select(
        "id", "source",
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.regexp_count("text", F.lit(FIGURE)).cast("long").alias("n_figures"),
    )


def _earlier(spark: SparkSession, output: str, table: str, batch: int) -> DataFrame:
    """Contents first seen in the batches before, of a table."""
    try:
        found = spark.read.schema(CONTENTS).parquet(f"{output}/contents")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CONTENTS)
    return found.where((F.col("table") == table) & (F.col("batch") < batch)).select("sha256", F.col("first_id").alias("known_id"), F.lit(True).alias("known"))


def take(rows: DataFrame, batch: int, table: dict, output: str) -> None:
    """Writes one batch of a table's new rows; writing it again replaces what it wrote."""
    spark, name = rows.sparkSession, table["table"]
    mine = {"table": F.lit(name), "batch": F.lit(batch).cast("long")}
    # what is told of a text is written before it is used twice: the texts themselves are read once
    described(rows, table).write.mode("overwrite").parquet(f"{output}/_described/{name}")
    texts = spark.read.schema(DESCRIBED).parquet(f"{output}/_described/{name}")
    # a content's copies are added up before they are shuffled; rows meet one row a content
    own = texts.groupBy("sha256").agg(F.min("id").alias("own_id"))
    contents = own.join(_earlier(spark, output, name, batch), "sha256", "left").select("sha256", F.when(F.col("known"), F.col("known_id")).otherwise(F.col("own_id")).alias("first_id"), F.coalesce("known", F.lit(False)).alias("known"))
    repeated = F.coalesce(F.col("id") != F.col("first_id"), F.col("first_id").isNotNull())
    out = texts.join(contents, "sha256").withColumn("repeated", repeated).withColumns(mine)
    write = lambda df, folder, keys: df.hint("rebalance", *keys[:2]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{output}/{folder}")
    write(out.select(*[c.split()[0] for c in TEXTS.split(", ")]), "texts", ["table", "source", "batch"])
    write(contents.where(~F.col("known")).withColumns(mine).select("sha256", "first_id", "table", "batch"), "contents", ["table", "batch"])
    done = spark.read.schema(TEXTS).parquet(f"{output}/texts").where((F.col("table") == name) & (F.col("batch") == batch))
    n = done.agg(F.count("*").alias("texts"), F.count_if("repeated").alias("repeated"), F.sum("n_bytes").alias("bytes")).first()
    log.info("%s, batch %d: read and wrote %d texts of %d bytes, %d with a content known before", name, batch, n.texts, n.bytes or 0, n.repeated)


def run(spark: SparkSession, input: str, output: str, checkpoint: str, tables: list[dict], files_per_batch: int = 1000) -> DataFrame:
    """Takes all files of the tables under ``input`` that no run with this checkpoint took; returns the whole catalogue."""
    for table in tables:
        path = f"{input.rstrip('/')}/{table['table']}.parquet"
        schema = spark.read.parquet(path).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path.replace(".parquet", "[.]parquet"))  # a pattern: streams take a single file by a pattern only
        log.info("%s: reads new files of %s", table["table"], path)
        query = stream.writeStream.foreachBatch(lambda df, n, table=table: take(df, n, table, output)).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{table['table']}").trigger(availableNow=True).start()
        query.awaitTermination()
        log.info("%s: wrote %s", table["table"], f"{output}/texts")
    return spark.read.schema(TEXTS).parquet(f"{output}/texts")


if __name__ == "__main__":
    main("text intake", str(Path(__file__).with_suffix(".json")), lambda spark, c: run(spark, c["input"], c["output"], c["checkpoint"], c["tables"], c["files_per_batch"]), ["input", "output", "checkpoint"])
