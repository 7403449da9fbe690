"""What became of each batch of files: a folder for a batch, in which every step leaves a mark once it is done.

A batch goes through steps: its files are read and kept, their rows written, bad files
set apart, the others moved. A batch that is repeated goes on after its last mark and
reads what was kept, so files that have moved meanwhile aren't missed. Between a step
and its mark a failure repeats the step; writers that know a batch by its number, as
:meth:`~cellweave.sources.merged.MergeStore.applied` does, then write it once.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
Write = Callable[[DataFrame, int], None]
_WHOLE = (0, 1 << 30)


@dataclass(frozen=True)
class Manifest:
    spark: SparkSession
    path: str

    def folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def _at(self, batch: int, step: str):  # noqa: ANN202 - Java objects
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder(batch)}/{step}.done")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def done(self, batch: int, step: str) -> bool:
        fs, p = self._at(batch, step)
        return fs.exists(p)

    def mark(self, batch: int, step: str) -> None:
        fs, p = self._at(batch, step)
        fs.create(p, True).close()

    def once(self, batch: int, step: str, do: Callable[[], object]) -> None:
        """Does a step and marks it, unless it is marked."""
        if not self.done(batch, step):
            do()
            self.mark(batch, step)

    def kept(self, batch: int, name: str, made: Callable[[], DataFrame]) -> DataFrame:
        """A table that a batch keeps; made the first time, read from then on."""
        at = f"{self.folder(batch)}/{name}"
        self.once(batch, name, lambda: made().write.mode("overwrite").parquet(at))
        return self.spark.read.parquet(at)


def attempted(do: Callable[[], T], attempts: int = 3, wait: float = 1.0) -> T:
    """``do()``, tried again if it fails, such as for a file that another program still holds."""
    for left in range(attempts - 1, -1, -1):
        try:
            return do()
        except Exception:
            if not left:
                raise
            time.sleep(wait)
    raise AssertionError


def written_by_chunks(log: Manifest, rows: DataFrame, batch: int, write: Write, dead: Write, size: int) -> None:
    """Writes ``rows`` (``file, n, ...``); chunks of ``size`` lines of a file that can't be written go to ``dead`` with the ``error``.

    All rows are tried at once. If that fails, halves of the chunks are, by a hash, and
    so on down to the chunks that fail by themselves; the others are written. So
    ``write`` may be called several times for a batch, never twice for a chunk it took.
    """
    chunk = F.floor(F.col("n") / size)
    place = F.pmod(F.xxhash64("file", chunk), F.lit(_WHOLE[1]))

    def part(lo: int, hi: int) -> None:
        step = f"written-{lo}-{hi}"
        own = rows if (lo, hi) == _WHOLE else rows.where((place >= lo) & (place < hi))
        if log.done(batch, step):
            return
        if not log.done(batch, f"{step}-split"):
            try:
                write(own, batch)
            except Exception as e:  # noqa: BLE001 - whatever a writer raises is its chunks' error
                n = own.select("file", chunk).distinct().limit(2).count()
                if n == 1 or hi - lo == 1:
                    dead(own.withColumn("error", F.lit(f"{type(e).__name__}: {e}"[:500])), batch)
                    log.mark(batch, step)
                elif n:
                    log.mark(batch, f"{step}-split")
                else:
                    raise
            else:
                log.mark(batch, step)
        if log.done(batch, f"{step}-split"):
            mid = (lo + hi) // 2
            for a, b in ((lo, mid), (mid, hi)):
                if not rows.where((place >= a) & (place < b)).isEmpty():
                    part(a, b)

    part(*_WHOLE)
