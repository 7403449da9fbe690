"""URLs judged against a list of canonical URLs, by a blocked Bloom filter and an exact join.

A listed entry is a host and a path, ``example.com/en/``: it fits its host and
all subdomains if the URL's path starts with its path. The list is turned into two
blocked Bloom filters, tables of 512-bit blocks in which a key sets one bit in each
of eight words of its block: one of the hosts, one of the whole entries.

Distinct pairs of host and path are expanded to the suffixes of the host. Those that
pass the first filter are joined with the listed hosts, and expanded by the lengths
of the paths that the list has for this host, so long lists of other hosts cost
nothing. What passes the second filter, nearly all true hits, is joined with the
list itself, which removes the rest. The longest fitting entry decides (ties: the
longer host, then block). List and filters are stored, so that Spark knows their
sizes in bytes and broadcasts them only below its limit.

Edge cases: a null URL, or one without ``://`` or host, is judged apart, without
a join, and fits no entry; URLs of any length are read whole; repeated rows and null
ids get their row each; an empty list lets all URLs pass; of repeated entries the
higher rank, then block counts; an empty table gives no rows. Columns named like the
added ones (``ADDED``) are replaced, all others are carried in a struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table

BITS_A_KEY, BLOCK_BITS = 16, 512
ADDED = ("host", "path", "entry", "entry_rank", "entry_verdict")

# Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Hosts listed for what they sell, blocked where no rule decides.
LISTED = (
    ("spam-farm.example.org", "/"),
    ("spam-farm.example.net", "/"),
    ("spam-farm.example.com", "/"),
    ("cheap-pills.example.org", "/"),
    ("cheap-pills.example.net", "/"),
    ("cheap-pills.example.com", "/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def canonical(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host, lower-cased, and path."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(url, _PARTS, 2)


def _mask(key: str, word: int) -> str:
    return f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 'bits'), {6 * word}) & 63 AS int))"


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """``block, w0 .. w7`` for a column ``key``."""
    masks = keys.select(F.expr(f"pmod(xxhash64(key), {n_blocks})").alias("block"), *(F.expr(_mask("key", i)).alias(f"m{i}") for i in range(8)))
    return masks.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(8)))


def _passing(rows: DataFrame, key: F.Column, listed: DataFrame, n: int) -> DataFrame:
    """``rows`` whose ``key`` may be among the ``n`` of ``listed`` (a column ``key``)."""
    n_blocks = max(1, -(-n * BITS_A_KEY // BLOCK_BITS))
    blocks = stored(bloom_blocks(listed, n_blocks))[0]
    out = rows.withColumn("key", key).withColumn("block", F.expr(f"pmod(xxhash64(key), {n_blocks})")).join(blocks, "block")
    for i in range(8):
        out = out.where(F.expr(f"(w{i} & {_mask('key', i)}) = {_mask('key', i)}"))
    return out.select(*rows.columns)


def judged(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """``pages`` and ``ADDED``; ``listed`` has ``host, path, verdict, rank``.

    Among fitting entries the highest ``rank`` wins, then the longest.
    """
    whole = lambda host, path: F.concat(host, F.lit("\0"), path)
    entries = stored(
        listed.where("host IS NOT NULL AND path IS NOT NULL").groupBy(F.col("host").alias("l_host"), F.col("path").alias("l_path"))
        .agg(F.max(F.struct("rank", (F.col("verdict") == "block").alias("b"), "verdict")).alias("e"))
    )[0]
    lengths = stored(entries.groupBy("l_host").agg(F.collect_set(F.length("l_path")).alias("lengths")))[0]

    host, path = canonical(F.col("url"))
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns if c not in ADDED)).alias("row")
    urls = pages.select(row, host.alias("host"), path.alias("path"))
    pairs = urls.where("host <> ''").select("host", "path").distinct()
    parts = "split(host, '[.]')"
    suffixes = pairs.select("host", "path", F.explode(F.expr(f"transform({parts}, (x, i) -> array_join(slice({parts}, i + 1, size({parts}) - i), '.'))")).alias("suffix"))
    known = _passing(suffixes, F.col("suffix"), lengths.select(F.col("l_host").alias("key")), lengths.count())
    starts = known.join(lengths, F.col("suffix") == F.col("l_host")).select(
        "host", "path", "suffix", F.explode(F.expr("transform(filter(lengths, n -> n <= length(path)), n -> left(path, n))")).alias("start")
    )
    passed = _passing(starts, whole(F.col("suffix"), F.col("start")), entries.select(whole(F.col("l_host"), F.col("l_path")).alias("key")), entries.count())
    hits = passed.join(entries, (F.col("suffix") == F.col("l_host")) & (F.col("start") == F.col("l_path")))
    entry = F.concat("l_host", "l_path")
    rank = F.struct("e.rank", F.length(entry).alias("n"), F.length("l_host").alias("h"), "e.b", entry.alias("entry"), "e.verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    with_host = urls.where("host <> ''").join(best, ["host", "path"], "left").select("row", "host", "path", "best.entry", F.col("best.rank").alias("entry_rank"), F.col("best.verdict").alias("entry_verdict"))
    none = {"entry": F.lit(None).cast("string"), "entry_rank": F.lit(None).cast("int"), "entry_verdict": F.lit(None).cast("string")}
    return with_host.unionByName(urls.where("host = ''").withColumns(none)).select("row.*", *ADDED)


def url_list(spark: SparkSession) -> DataFrame:
    rows = [(h, p, v, 1) for h, p, v in RULES] + [(h, p, "block", 0) for h, p in LISTED]
    return spark.createDataFrame(rows, "host string, path string, verdict string, rank int")


def op8_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "pages").select("page_id", "url"), url_list(spark))
    return found.select(
        "page_id", "host", "path", F.expr("IF(entry_rank = 1, entry, NULL)").alias("rule"), F.coalesce("entry_verdict", F.lit("allow")).alias("verdict")
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


OP8_SQL = f"""
WITH rules(rh, rp, rv, rank) AS (VALUES {_values([(*r, 1) for r in RULES] + [(*r, 'block', 0) for r in LISTED])}),
split AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
         row_number() OVER () AS n
  FROM pages),
fit AS (
  SELECT n, rh || rp AS entry, rv, rank,
         row_number() OVER (PARTITION BY n ORDER BY rank DESC, length(rh || rp) DESC, length(rh) DESC, rv DESC) AS nth
  FROM split JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, CASE WHEN rank = 1 THEN entry END AS rule, coalesce(rv, 'allow') AS verdict
FROM split LEFT JOIN fit ON split.n = fit.n AND fit.nth = 1
"""
