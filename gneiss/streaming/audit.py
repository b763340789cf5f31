"""The incremental audit over a stream of files: keyed state tells what is new, and that goes to the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.facts import lines as L
from gneiss.functions.core import content_hash
from gneiss.plans.audit import incremental
from gneiss.rules import base
from gneiss.sources.config import rule_fingerprint
from gneiss.streaming.ledger import rules_due


def file_stream(spark: SparkSession, root: str, most_files: int = 1000) -> DataFrame:
    """path, text, version of files as they appear under root; the version is the time of their last change."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_files)
    return raw.schema("value string").load(root).select(F.regexp_replace(F.input_file_name(), "^.*?/+" + root.strip("/").removeprefix("file:").strip("/") + "/", "").alias("path"), F.col("value").alias("text"), F.unix_millis("_metadata.file_modification_time").alias("version"))


def audit_stream(files: DataFrame, index, repo: str, checkpoint: str, config: dict | None = None):
    """Starts the query over files(path, text, version), null text for a file that is gone.

    The ledger's state lets through only files whose content or settings are new and that are not late; these are audited with all that is
    known.  A batch without any starts no audit.  A batch that runs again after a failure gives the same index.
    """
    settings = F.create_map(F.lit("*"), F.lit(rule_fingerprint("", config or {})))
    events = files.select(F.lit(repo).alias("repo"), "path", "version", F.when(F.col("text").isNotNull(), content_hash(F.col("text"))).alias("sha"), settings.alias("rules"), "text")

    def step(batch: DataFrame, _id: int) -> None:
        new = batch.checkpoint()
        if not new.isEmpty():
            gone = new.where("reason = 'gone'").select("path")
            incremental(new.sparkSession, index, repo, new.where("reason <> 'gone'").select("path", "text"), config, whole=False, removed=gone)

    return rules_due(events).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_hits(lines: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of shell rules per window over a stream of lines(ts, path, line, text), late data up to the watermark."""
    hits = None
    for r in base.load().values():
        if r.language == "shell":
            h = r.run(lines).select("ts", F.lit(r.rule_id).alias("rule_id"))
            hits = h if hits is None else hits.unionByName(h)
    return hits.withWatermark("ts", late).groupBy(F.window("ts", width), "rule_id").count()


def stream_lines(files: DataFrame) -> DataFrame:
    return L.lines(files)
