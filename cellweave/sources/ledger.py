"""Batches of updates committed whole: rows, cell events and audit entries of a batch count together, or none of them does."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import layering, writes
from ..operators.layering import CELL
from ..storage import scratch, stored
from .merged import KEY, MergeStore

EVENT = "seq bigint, tx string, table_name string, row_id string, col string, source string, value string, updated_by string"
AUDIT = ", ".join(f"{c} {'timestamp' if c == 'timestamp' else 'string'}" for c in writes.ENTRY)


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in schema.split(", "))))


def _cells(values: DataFrame) -> DataFrame:
    """``KEY, cells``: a map for each row of ``CELL, value``; a row has as many entries as columns."""
    return values.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("cells"))


@dataclass(frozen=True)
class Ledger:
    """A :class:`MergeStore` whose rows follow the cell events appended beside them, with the audit log.

    A batch rewrites no row but those it changes. It looks through the events of
    all times for those of its own cells.
    """

    store: MergeStore

    def rows(self, version: int | None = None) -> DataFrame:
        """Rows, with the effective value of each cell in ``data``."""
        return self.store.read(version=version)

    def events(self, version: int | None = None) -> DataFrame:
        return self.store.part("events", EVENT, version)

    def audit(self, version: int | None = None) -> DataFrame:
        return self.store.part("audit", AUDIT, version)

    def begun(self, rows: DataFrame, events: DataFrame) -> int:
        """The first version, from ``writes.ROW`` rows and their past events; events of other rows are kept, too."""
        with scratch(self.store.spark):
            data = _cells(layering.effective(events).select(*CELL, "value"))
            whole = rows.select(*writes.ROW).join(data, KEY, "left").withColumn("data", F.coalesce("cells", F.create_map().cast("map<string,string>")))
            return self.store.applied(whole.drop("cells"), parts_to_append={"events": _shaped(events, EVENT)}, on=0)

    def committed(self, updates: DataFrame, tx: str, at: Column, key_column: str | None = None, stream: tuple[str, int] | None = None) -> int:
        """A version with a batch of updates, see :func:`~cellweave.operators.writes.applied`.

        What the batch did was computed on the last version; if another writer makes
        one meanwhile, it is a :class:`~.merged.Conflict` and nothing counts. A batch of
        a ``stream`` that was committed before is passed over.
        """
        before = (self.store.versions() or [0])[-1]
        if stream and self.store.took(stream):
            return before
        with scratch(self.store.spark):
            old = self.rows(before)
            batch = writes.applied(old.select(*writes.ROW), self.events(before), updates, tx, at, key_column)
            touched = stored(batch.rows)
            last = batch.changed.groupBy(*CELL).agg(F.max_by(F.struct("new_value"), "seq")["new_value"].alias("value"))
            known = old.select(*KEY, F.col("business_key").alias("old_key"), F.col("data").alias("old_data"))
            changed = touched.join(known, KEY, "left").join(_cells(last), KEY, "left").where("is_new OR n_changed > 0 OR NOT business_key <=> old_key")
            none = F.create_map().cast("map<string,string>")
            new = F.coalesce("cells", none)
            rest = F.map_filter(F.coalesce("old_data", none), lambda k, _: ~F.array_contains(F.map_keys(new), k))
            upserts = changed.select(*writes.ROW, F.map_concat(rest, new).alias("data"))
            parts = {"events": _shaped(batch.events, EVENT), "audit": _shaped(batch.audit, AUDIT)}
            return self.store.applied(upserts, stream=stream, parts_to_append=parts, on=before)
