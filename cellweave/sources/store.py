"""A store of logical tables: Parquet snapshots, partitioned by table name, and the folders files come in through."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.grid import backfilled

#: Fixed columns of a row; cells are texts by column name.
SCHEMA = "table_name string, row_id string, business_key string, data map<string,string>, created_at timestamp, updated_at timestamp"
FOLDERS = ("config", "scripts", "raws", "archives")


@dataclass(frozen=True)
class Store:
    """Snapshots ``v=1, v=2, ...`` below ``path``; each is whole, and a reader sees the last one that was finished.

    ``tables`` is the catalogue: the configured tables, in their order, with the
    columns they show.
    """

    spark: SparkSession
    path: str
    tables: dict[str, list[str]] = field(default_factory=dict)

    def _at(self, name: str):  # noqa: ANN202 - a Java object
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def catalog(self) -> DataFrame:
        """``n, table_name`` in the order of the configuration."""
        return self.spark.createDataFrame(list(enumerate(self.tables)), "n int, table_name string")

    def versions(self) -> list[int]:
        fs, p = self._at("")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(self._at(f"{n}/_SUCCESS")[1]))

    def create(self) -> None:
        """An empty first snapshot, if there is none."""
        if not self.versions():
            self.write(self.spark.createDataFrame([], SCHEMA))

    def write(self, rows: DataFrame) -> int:
        """A new snapshot; what is read from an older one may go into it."""
        version = (self.versions() or [0])[-1] + 1
        rows.repartition("table_name", F.pmod(F.xxhash64("row_id"), F.lit(64))).write.partitionBy("table_name").parquet(f"{self.path}/v={version}")
        return version

    def read(self, table: str | None = None, version: int | None = None, more: dict[str, str] | None = None) -> DataFrame:
        """A snapshot, the last by default, or of it one table, of which only its own files are read.

        ``more`` names later columns (name to type); where the snapshot lacks them, they are null.
        """
        schema = ", ".join([SCHEMA, *(f"{c} {t}" for c, t in (more or {}).items())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/v={version or self.versions()[-1]}").parquet(f"{self.path}/v={version or self.versions()[-1]}")
        return rows if table is None else rows.where(F.col("table_name") == table)

    def statistics(self) -> DataFrame:
        """``table_name, n_rows, n_keys, last_at`` of the last snapshot, in one grouped scan."""
        last = F.max(F.coalesce("updated_at", "created_at"))
        return self.read().groupBy("table_name").agg(F.count("*").alias("n_rows"), F.count("business_key").alias("n_keys"), last.alias("last_at"))

    def backfill(self) -> int:
        """A snapshot whose null ``updated_at`` are those of creation."""
        return self.write(backfilled(self.read()))

    def reset(self, sure: bool = False) -> None:
        """Deletes all snapshots and makes an empty one; only if ``sure``."""
        if not sure:
            raise ValueError("reset deletes all snapshots; pass sure=True")
        fs, p = self._at("")
        fs.delete(p, True)
        self.create()

    # ---- folders of files

    def workspace(self, table: str) -> str:
        """The table's folder, with those for configuration, scripts, incoming and archived files."""
        for name in FOLDERS:
            fs, p = self._at(f"workspace/{table}/{name}")
            fs.mkdirs(p)
        return f"{self.path}/workspace/{table}"

    def configure(self, table: str, config: dict) -> None:
        self._put(f"workspace/{table}/config/config.json", json.dumps(config).encode())

    def configuration(self, table: str) -> dict | None:
        """The table's ``config.json``, else another JSON file of its folder, else none."""
        fs, p = self._at(f"workspace/{table}/config")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return None
        name = "config.json" if "config.json" in names else names[0]
        return json.loads(self.spark.read.text(f"{self.path}/workspace/{table}/config/{name}", wholetext=True).first().value)

    def upload(self, table: str, name: str, content: bytes, user: str | None = None) -> str:
        """Puts a file where the table's stream finds it, named after its user and made unique; gives its name."""
        base, dot, ext = name.rpartition(".")
        base, ext = (base, dot + ext) if dot else (name, "")
        made = f"{f'user({user})_' if user else ''}{base}_{uuid.uuid4().hex[:8]}{ext}"
        self._put(f"workspace/{table}/raws/{made}", content)
        return made

    def paste(self, table: str, text: str, user: str | None = None) -> str:
        """A clipboard's text as a log file for the table's stream."""
        return self.upload(table, "paste.log", text.encode(), user)

    def _put(self, name: str, content: bytes) -> None:
        # under a hidden name first, so that no stream reads half a file
        folder, _, last = name.rpartition("/")
        fs, tmp = self._at(f"{folder}/.{last}")
        out = fs.create(tmp, True)
        out.write(bytearray(content))
        out.close()
        p = self._at(name)[1]
        fs.delete(p, False)
        fs.rename(tmp, p)


def archive(spark: SparkSession, file: str, folder: str, at: int) -> str:
    """Moves a file to a folder; if its name is taken, ``_<at>`` is added to it. Gives the new path; a file that is gone is let be."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    src = jvm.Path(file)
    fs = src.getFileSystem(conf)
    fs.mkdirs(jvm.Path(folder))
    name = src.getName()
    dest = jvm.Path(f"{folder}/{name}")
    if fs.exists(dest):
        base, dot, ext = name.rpartition(".")
        dest = jvm.Path(f"{folder}/{base}_{at}.{ext}" if dot else f"{folder}/{name}_{at}")
    if fs.exists(src):
        fs.rename(src, dest)
    return dest.toString()


def copied_over_jdbc(
    spark: SparkSession, source: dict[str, str], target: dict[str, str], tables: dict[str, dict[str, str]], keys: dict[str, list[str]] | None = None
) -> None:
    """Copies tables from one database to another, texts without invalid UTF-8.

    ``source`` and ``target`` are JDBC options (``url, driver, user, ...``); ``tables``
    has options for reading each table, such as ``partitionColumn, numPartitions``, by
    which executors read it side by side. Bounds that aren't given are asked for.

    ``keys`` names the columns, never null, that tell a table's rows apart. Of such a
    table only rows are written whose keys the target lacks, so a copy that was stopped
    goes on with the rest when it is called again. Other tables are appended whole.
    """
    from ..functions.cells import sanitised

    for name, options in tables.items():
        options = _with_bounds(spark, source, name, options)
        rows = spark.read.format("jdbc").options(**source, **options, dbtable=name).load()
        clean: dict[str, Column] = {f.name: sanitised(F.col(f"`{f.name}`")) for f in rows.schema.fields if isinstance(f.dataType, T.StringType)}
        rows = rows.withColumns(clean)
        own = (keys or {}).get(name)
        if own:
            there = spark.read.format("jdbc").options(**target, **options, dbtable=name).load()
            rows = rows.join(there.select(*(F.col(f"`{c}`") for c in own)), own, "left_anti").select(*(F.col(f"`{c}`") for c in rows.columns))
        rows.write.format("jdbc").options(**target, dbtable=name).mode("append").save()


def _with_bounds(spark: SparkSession, source: dict[str, str], name: str, options: dict[str, str]) -> dict[str, str]:
    """Options with the least and greatest value of ``partitionColumn`` as bounds; without both if the table is empty."""
    column = options.get("partitionColumn")
    if column is None or "lowerBound" in options:
        return options
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(source["url"]).quoteIdentifier(column)
    span = spark.read.format("jdbc").options(**source, dbtable=f"(SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {name}) span").load().first()
    if span[0] is None:
        return {k: v for k, v in options.items() if k not in ("partitionColumn", "numPartitions")}
    return options | {"lowerBound": str(span[0]), "upperBound": str(span[1])}
