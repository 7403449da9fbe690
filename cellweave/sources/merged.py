"""A store that is written by parts: sorted base files, delta files beside them, and a log of which files count.

Every file holds a range of keys ``(table_name, row_id)``. A batch writes its own rows,
and marks of those it deletes, as delta files; no other file is touched. A reader
takes base files whose ranges meet no delta as they are, and merges the others with
the deltas, of which the latest row of a key counts. Compaction rewrites just these
others; the rest keep their names. A version is a list of files; it counts once its
entry stands in the log, which only one of two writers can add.

What the driver holds of a version is a line for each file, as catalogues of files do.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch, stored
from .store import SCHEMA

KEY = ["table_name", "row_id"]
COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.replace("map<string,string>", "map").split(",")]
_ROW = f"{SCHEMA}, deleted boolean, version bigint"
_SPAN = "struct<table_name:string,row_id:string>"
_FILE = f"path string, kind string, version bigint, lo {_SPAN}, hi {_SPAN}, n_rows bigint"

Key = tuple[str, str]


class Conflict(RuntimeError):
    """Another writer has made this version meanwhile; read again and repeat."""


@dataclass(frozen=True)
class File:
    path: str
    kind: str  #: ``base`` or ``delta``
    version: int
    lo: Key
    hi: Key
    n_rows: int


def meeting(files: list[File], spans: list[tuple[Key, Key]]) -> set[str]:
    """The files, by path, whose ranges meet any of the spans; in time ``n log n``."""
    joined: list[list[Key]] = []
    for lo, hi in sorted(spans):
        if joined and lo <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], hi)
        else:
            joined.append([lo, hi])
    begins = [s[0] for s in joined]
    at = lambda f: bisect_right(begins, f.hi) - 1
    return {f.path for f in files if at(f) >= 0 and joined[at(f)][1] >= f.lo}


@dataclass(frozen=True)
class MergeStore:
    """Versions 1, 2, ... below ``path``. ``files`` is how many files a write makes; by default as many as Spark finds fit."""

    spark: SparkSession
    path: str
    files: int | None = None

    # ---- the log

    def _fs(self, name: str):  # noqa: ANN202 - Java objects
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs("log")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def _entry(self, version: int) -> dict:
        if not version:
            return {"files": None, "streams": {}}
        fs, p = self._fs(f"log/{version}.json")
        size = fs.getFileStatus(p).getLen()
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readNBytes(size)).decode())
        finally:
            stream.close()

    def _current(self) -> int:
        return (self.versions() or [0])[-1]

    def catalogue(self, version: int | None = None) -> list[File]:
        """The files of a version, the last by default."""
        at = self._entry(self._current() if version is None else version)["files"]
        if at is None:
            return []
        rows = self.spark.read.schema(_FILE).parquet(f"{self.path}/{at}").collect()
        return [File(r.path, r.kind, r.version, tuple(r.lo), tuple(r.hi), r.n_rows) for r in rows]

    def took(self, stream: tuple[str, int]) -> bool:
        """Whether the batch of a source was applied."""
        return self._entry(self._current())["streams"].get(stream[0], -1) >= stream[1]

    def _commit(self, before: int, files: list[File], stream: tuple[str, int] | None, parts: dict[str, str] | None = None) -> int:
        at = f"files/{uuid.uuid4().hex}"
        rows = [(f.path, f.kind, f.version, f.lo, f.hi, f.n_rows) for f in files]
        self.spark.createDataFrame(rows, _FILE).coalesce(1).write.parquet(f"{self.path}/{at}")
        streams = self._entry(before)["streams"] | ({stream[0]: stream[1]} if stream else {})
        fs, p = self._fs(f"log/{before + 1}.json")
        try:
            out = fs.create(p, False)  # fails if it is there
        except Exception as e:
            raise Conflict(f"version {before + 1} is there") from e
        out.write(bytearray(json.dumps({"files": at, "streams": streams, "parts": parts or {}}).encode()))
        out.close()
        return before + 1

    # ---- writing

    def _written(self, rows: DataFrame, kind: str) -> list[File]:
        """``rows`` as sorted files of disjoint ranges, with what a catalogue says of them."""
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        with scratch(self.spark):
            # ranges are drawn from the rows before they are dealt, which would compute them twice
            once = stored(rows)
            parts = once.repartitionByRange(self.files, *KEY) if self.files else once.repartitionByRange(*KEY)
            parts.sortWithinPartitions(*KEY).write.parquet(at)
        key = F.struct(*KEY)
        stats = self.spark.read.schema(_ROW).parquet(at).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"), F.max("version").alias("version"))
        return [File(r.path, kind, r.version, tuple(r.lo), tuple(r.hi), r.n) for r in stats.collect()]

    def _checked(self, rows: DataFrame, version: int, deleted: bool) -> DataFrame:
        """One row for each key; that of the latest time, then of the last key, counts."""
        named = rows.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a row without {c}"))) for c in KEY})
        if deleted:
            none = {c: F.lit(None).cast(t) for c, t in (("business_key", "string"), ("data", "map<string,string>"), ("created_at", "timestamp"), ("updated_at", "timestamp"))}
            return named.select(*KEY).distinct().withColumns(none).select(*COLUMNS, F.lit(True).alias("deleted"), F.lit(version).cast("bigint").alias("version"))
        rest = [c for c in COLUMNS if c not in KEY]
        order = F.struct(F.coalesce("updated_at", "created_at").alias("t"), F.col("business_key").alias("k"), F.to_json("data").alias("d"))
        last = named.select(*COLUMNS).groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("r"))
        return last.select(*KEY, "r.*").select(*COLUMNS, F.lit(False).alias("deleted"), F.lit(version).cast("bigint").alias("version"))

    def applied(
        self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, stream: tuple[str, int] | None = None,
        parts_to_append: dict[str, DataFrame] | None = None, on: int | None = None,
    ) -> int:
        """A version with rows put (the columns of a store's rows) and keys deleted (``KEY``); a key in both is put.

        ``stream`` names a source and its batch: one that was applied before is passed
        over, so a repeated batch is written once. ``parts_to_append`` are tables that grow by
        what is given, see :meth:`part`; they count together with the rows or not at
        all. With ``on``, another last version than this one is a :class:`Conflict`.
        """
        before = self._current()
        if stream and self.took(stream):
            return before
        if on is not None and on != before:
            raise Conflict(f"version {before} is there, not {on}")
        appended = {}
        for name, df in (parts_to_append or {}).items():
            appended[name] = f"parts/{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{appended[name]}")
        parts = []
        if upserts is not None:
            parts.append(self._checked(upserts, before + 1, False))
        if deletes is not None:
            gone = self._checked(deletes, before + 1, True)
            parts.append(gone.join(parts[0].select(*KEY), KEY, "left_anti").select(*gone.columns) if parts else gone)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        old = self.catalogue(before)
        return self._commit(before, old + self._written(rows, "delta" if old else "base"), stream, appended)

    def compacted(self) -> int:
        """A version without deltas: base files whose ranges meet one are rewritten, the others are the same files."""
        before = self._current()
        base, deltas, touched = self._split(self.catalogue(before))
        if not deltas:
            return before
        merged = self._merged([f for f in base if f.path in touched], deltas)
        return self._commit(before, [f for f in base if f.path not in touched] + self._written(merged, "base"), None)

    # ---- reading

    @staticmethod
    def _split(files: list[File]) -> tuple[list[File], list[File], set[str]]:
        base, deltas = ([f for f in files if f.kind == k] for k in ("base", "delta"))
        return base, deltas, meeting(base, [(f.lo, f.hi) for f in deltas])

    def _of(self, files: list[File]) -> DataFrame:
        return self.spark.read.schema(_ROW).parquet(*(f.path for f in files)) if files else self.spark.createDataFrame([], _ROW)

    def _merged(self, base: list[File], deltas: list[File]) -> DataFrame:
        new = self._of(deltas)
        last = new.groupBy(*KEY).agg(F.max_by(F.struct(*new.columns), "version").alias("r"))
        kept = self._of(base).join(last.select(*KEY), KEY, "left_anti").select(*new.columns)
        return kept.where("NOT deleted").unionByName(last.where("NOT r.deleted").select("r.*"))

    def _rows(self, files: list[File]) -> DataFrame:
        base, deltas, touched = self._split(files)
        plain = self._of([f for f in base if f.path not in touched]).where("NOT deleted")
        return plain if not deltas else plain.unionByName(self._merged([f for f in base if f.path in touched], deltas))

    def read(self, table: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default, or of it one table, of which only files with its keys are read."""
        files = self.catalogue(version)
        if table is not None:
            files = [f for f in files if f.lo[0] <= table <= f.hi[0]]
        rows = self._rows(files).select(*COLUMNS)
        return rows if table is None else rows.where(F.col("table_name") == table)

    def part(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """What was appended to a part up to a version; the driver reads an entry of the log for each version."""
        last = self._current() if version is None else version
        added = [self._entry(v).get("parts", {}).get(name) for v in self.versions() if v <= last]
        paths = [f"{self.path}/{p}" for p in added if p]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def found(self, table: str, row_id: str, version: int | None = None) -> DataFrame:
        """The row of a key, from the files whose ranges hold it."""
        files = [f for f in self.catalogue(version) if f.lo <= (table, row_id) <= f.hi]
        return self._rows(files).where((F.col("table_name") == table) & (F.col("row_id") == row_id)).select(*COLUMNS)

    def changes_between(self, old: int, new: int) -> DataFrame:
        """``KEY, event, before, after`` of rows that differ between two versions: ``create``, ``update`` or ``delete``.

        Only keys in files that one version has and the other has not can differ; of
        them rows are compared by their hashes, so files that were merely rewritten
        give no events.
        """
        a, b = self.catalogue(old), self.catalogue(new)
        both = {f.path for f in a} & {f.path for f in b}
        apart = [f for f in a + b if f.path not in both]
        if not apart:
            pair = "struct<business_key:string,data:map<string,string>,created_at:timestamp,updated_at:timestamp>"
            return self.spark.createDataFrame([], f"table_name string, row_id string, event string, before {pair}, after {pair}")
        spans = [(f.lo, f.hi) for f in apart]
        keys = self._of(apart).select(*KEY).distinct()
        rest = [c for c in COLUMNS if c not in KEY]
        # maps have no order that counts
        content = F.xxhash64(*(F.array_sort(F.map_entries(c)) if c == "data" else F.col(c) for c in rest))

        def side(files: list[File], name: str) -> DataFrame:
            near = meeting(files, spans)
            rows = self._rows([f for f in files if f.path in near]).join(keys, KEY, "left_semi")
            return rows.select(*KEY, F.struct(*rest).alias(name), content.alias(f"{name}_hash"))

        joined = side(a, "before").join(side(b, "after"), KEY, "full").where("NOT before_hash <=> after_hash")
        event = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").otherwise("update")
        return joined.select(*KEY, event.alias("event"), "before", "after")
