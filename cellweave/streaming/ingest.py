"""Files dropped in a folder, read by rules or a parser into rows as they come, and live views of event streams."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.cells import uploader
from ..operators.history import NO_TX
from ..sources.merged import MergeStore
from ..sources.parsers import Parser, good, parsed, quarantined, told
from ..sources.rules import Rules, canonical, keyed, rows_of
from ..sources.store import Store, archive
from .manifest import Manifest, Write, attempted, written_by_chunks


def _name(file: F.Column) -> F.Column:
    return F.url_decode(F.element_at(F.split(file, "/"), -1))


def signed(rows: DataFrame, source: str) -> DataFrame:
    """``rows`` of a ``file`` with ``tx``, a hash of its path so that a repeated batch writes the same, ``source`` and ``updated_by``."""
    who = uploader(_name(F.col("file")))
    return rows.withColumns({"tx": F.md5("file"), "source": F.when(who.isNotNull(), "user").otherwise(source), "updated_by": F.coalesce(who, F.lit(source))})


def ingest(
    spark: SparkSession, folder: str, rules: Rules | Parser, key: str, checkpoint: str, write: Write, source: str = "batch_ingester", display: list[str] | None = None,
    archives: str | None = None, quarantine: Write | None = None, files_a_batch: int = 1000, manifest: str | None = None, chunk: int | None = None, dead: Write | None = None,
) -> StreamingQuery:
    """Each new file of ``folder`` once: its rows go to ``write(rows, batch_id)`` with ``tx, source, updated_by``.

    Rows without a business key are left out. By ``rules`` they have the rules'
    columns, by a parser a map ``row``. Files that can't be read go to
    ``quarantine`` with the error and stay where they are. When a batch is written,
    its other files move to ``archives``. Steps that are done are marked in the
    ``manifest`` folder (by default beside the checkpoint), where what a batch's files
    have is kept too: a batch that failed goes on where it stopped, with the same rows,
    whichever of its files have moved.

    Without ``chunk``, a batch is written as a whole or fails. With it, lines of a file
    are written or not in chunks of so many: those that ``write`` fails for go to
    ``dead`` with the error, the others are written.
    """
    found = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_a_batch).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    log = Manifest(spark, manifest or f"{checkpoint.rstrip('/')}-manifest")

    def batch(part: DataFrame, batch_id: int) -> None:
        files = part.select(F.col("path").alias("file"), "content")
        if isinstance(rules, Rules):
            every = attempted(lambda: log.kept(batch_id, "texts", lambda: told(files)))
            # Spark names files by URIs; rules see the names users gave
            rows = keyed(canonical(rows_of(good(every), rules), display or []), key)
        else:
            every = attempted(lambda: log.kept(batch_id, "parsed", lambda: parsed(files, rules)))
            own = F.filter(F.map_entries("row"), lambda e: F.lower(e["key"]) == key.lower())
            rows = good(every).withColumn("business_key", F.btrim(F.element_at(own, -1)["value"])).where("business_key IS NOT NULL")
        rows, bad = signed(rows, source), quarantined(every)
        names = log.kept(batch_id, "names", lambda: files.select("file"))
        if chunk is None:
            log.once(batch_id, "written", lambda: write(rows, batch_id))
        else:
            log.once(batch_id, "written", lambda: written_by_chunks(log, rows, batch_id, write, dead or (lambda *_: None), chunk))
        if quarantine is not None:
            log.once(batch_id, "quarantined", lambda: quarantine(bad, batch_id))
        if archives is not None:

            def moved() -> None:
                # at most ``files_a_batch`` names
                for f in names.join(bad.select("file").distinct(), "file", "left_anti").collect():
                    archive(spark, f.file, archives, int(time.time()))

            log.once(batch_id, "moved", moved)

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_all(store: Store, write: Callable[[str, DataFrame, int], None], parsers: dict[str, Parser] | None = None, keys: dict[str, str] | None = None) -> dict[str, StreamingQuery]:
    """A stream for each table's folder that has a configuration or a registered parser; others are passed over."""
    queries = {}
    for table in store.tables:
        folder = store.workspace(table)
        config, parser = store.configuration(table), (parsers or {}).get(table)
        if config is None and parser is None:
            continue
        rules = parser or Rules.of(config)
        name = (config or {}).get("table_name") or table
        queries[table] = ingest(
            store.spark, f"{folder}/raws", rules, (keys or {}).get(table, "id"), f"{folder}/checkpoint", lambda rows, i, name=name: write(name, rows, i),
            "custom_script" if parser else "batch_ingester", store.tables[table], f"{folder}/archives",
        )
    return queries


def counts_by_window(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Entries by window and type; late ones beyond ``late`` are left out of a stream. An extension."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def live_groups(entries: DataFrame, most: int = 500) -> DataFrame:
    """Live audit groups ``tx, seq, total_count, n_logs`` of a stream of entries (``seq, transaction_id``), for update or complete mode.

    The state is a row for each transaction; each batch gives the groups it has changed.
    """
    tx = F.coalesce("transaction_id", F.lit(NO_TX)).alias("tx")
    n = F.count("*")
    return entries.groupBy(tx).agg(F.max("seq").alias("seq"), n.alias("total_count"), F.least(F.lit(most).cast("bigint"), n).alias("n_logs"))


def followed(groups: DataFrame, store: MergeStore, name: str, checkpoint: str) -> StreamingQuery:
    """Puts changed groups into a store's table as they come, each batch once; a view of them is the table's last version."""

    def batch(part: DataFrame, batch_id: int) -> None:
        data = F.create_map(*(x for c in ("seq", "total_count", "n_logs") for x in (F.lit(c), F.col(c).cast("string"))))
        none = F.lit(None).cast("timestamp")
        rows = part.select(F.lit(name).alias("table_name"), F.col("tx").alias("row_id"), F.lit(None).cast("string").alias("business_key"), data.alias("data"), none.alias("created_at"), none.alias("updated_at"))
        store.applied(rows, stream=(name, batch_id))

    return groups.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
