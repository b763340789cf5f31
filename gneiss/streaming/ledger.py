"""The ledger of a stream of files: keyed state instead of tables that are read again for each batch.

State of a (repository, path): the newest version seen, its content's hash (none once the file is gone) and the fingerprint of each rule
that has run on it.  Events are ordered by (version, hash, fingerprints), whatever batch brings them, so a late event changes nothing,
an event that comes twice says nothing the second time, and after a restart the state ends where one batch over all events would.  A
batch costs what its events cost.  A file that is gone keeps its version, so that an older event does not bring it back: state grows with
the paths ever seen, a few hundred bytes each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["repo", "path"]
EVENT = "repo string, path string, version long, sha string, rules map<string, string>, text string"
STATE = "version long, sha string, rules map<string, string>"
DUE = "repo string, path string, version long, sha string, rule_id string, fingerprint string, reason string, text string"


def place(version, sha, rules) -> tuple:
    """What events of one path are ordered by; rules: a dictionary or pairs."""
    return (version, sha is not None, sha or "", sorted(dict(rules or ()).items()))


def due(old: tuple | None, sha: str | None, rules: dict) -> list[tuple]:
    """(rule_id, fingerprint, reason) after the event, against the state (version, sha, rules) before it.

    content: the file is new or its content is (rule_id null if no rule runs on it); rule: the rule's fingerprint is new; off: the rule
    no longer runs here; gone: the file.
    """
    before, ran = (old[1], dict(old[2] or ())) if old else (None, {})
    if sha is None:
        return [(None, None, "gone")] if before is not None else []
    off = [(r, None, "off") for r in sorted(ran.keys() - rules.keys())]
    if sha != before:
        return ([(r, f, "content") for r, f in sorted(rules.items())] or [(None, None, "content")]) + off
    return [(r, f, "rule") for r, f in sorted(rules.items()) if ran.get(r) != f] + off


class FileLedger(StatefulProcessor):
    """Rows of DUE from rows of EVENT of one key; a batch's newest event counts."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", STATE)

    def handleInputRows(self, key, rows, timers):
        newest = None
        for r in rows:  # one at a time: a hot path's events are never held together
            at = place(r.version, r.sha, r.rules)
            if newest is None or at > newest[0]:
                newest = (at, r)
        old = self.seen.get() if self.seen.exists() else None
        if old is not None and newest[0] <= place(*old):
            return
        r = newest[1]
        rules = dict(r.rules or ()) if r.sha is not None else {}
        self.seen.update((r.version, r.sha, rules))
        for i, (rule, fingerprint, reason) in enumerate(due(old, r.sha, rules)):
            yield Row(repo=key[0], path=key[1], version=r.version, sha=r.sha, rule_id=rule, fingerprint=fingerprint, reason=reason, text=None if i else r.text)

    def handleInitialState(self, key, known, timers) -> None:
        self.seen.update((known.version, known.sha, dict(known.rules or ())))

    def close(self) -> None:
        pass


def rules_due(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """DUE from events(repo, path, version, sha, rules[, text]), a stream or a table: what must run, what is off and which files are gone.

    sha null: the file is gone.  known(repo, path, version, sha, rules): one row a path, the state that a new stream starts from.  Of a
    path's rows the first carries the text.  Null paths or versions are no events.  Sets the session's state store to RocksDB, which keyed
    state needs.
    """
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    text = F.col("text") if "text" in events.columns else F.lit(None).cast("string")
    e = events.where("repo is not null and path is not null and version is not null").select(*KEYS, F.col("version").cast("long").alias("version"), "sha", "rules", text.alias("text"))
    start = None if known is None else known.select(*KEYS, F.col("version").cast("long").alias("version"), "sha", "rules").groupBy(*KEYS)
    return e.groupBy(*KEYS).transformWithState(FileLedger(), DUE, "Append", "None", start)


def run_to_table(spark: SparkSession, stream: DataFrame, root: str) -> DataFrame:
    """Runs the stream over what is there now and returns all that it has written below root, `batch` with it.

    A batch that runs again after a failure overwrites its own folder, so each counts once.
    """
    schema = stream.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/out/batch=-1")

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).parquet(f"{root}/out")


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
