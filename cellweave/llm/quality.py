"""Quality rules whose cutoffs are chosen from labelled rows at a controlled risk.

Words are runs of anything but ASCII white space. A text fails the base rules
with fewer than 50 words, or if over half of its words stand in runs of three
words that occur twice or more (runs are compared by 64-bit hashes). Further
rules reject a text whose share on some measure reaches a cutoff. Each stratum
(``lang``) and measure has its own cutoff, or none.

Labelled rows are halved by a hash of ``doc_id``. The tuning half ranks all pairs of
measure and cutoff of a stratum by the share of good rows among those they reject,
and leaves out those that cost more good rows than they are worth (``cost``). Taken
in this order, the pairs make rules that grow ever stricter. The other half, the
holdout, tests them in this order by the exact binomial (Clopper-Pearson) bound, up
to the first rule for which its good rows don't prove that at most
``max_false_rejection`` of good texts are rejected. A sequence fixed beforehand needs
no correction within a stratum; ``delta`` is divided by the number of strata
(Bonferroni). So with probability 1 - ``delta`` no stratum loses more than
``max_false_rejection`` of its good texts to these rules. A stratum with few labels
proves nothing and rejects nothing.

Edge cases: null and empty texts have no words and fail; texts of any length are
read whole; a null ``lang`` is a stratum of its own; ties in rank go to the pair that
rejects more, then by measure and step; of repeated labels the worse counts;
repeated rows are judged each; without labels only the base rules hold; an empty
table gives no rows. :func:`measured` adds columns and expects that documents have
none of their names; :func:`keep_good` carries all columns in a struct, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import keep, stored, table

MAX_FALSE_REJECTION, DELTA, COST = 0.02, 0.05, 2
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_GAP, _BLANKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"

#: Measures and the width of a step between their cutoffs; cutoffs are steps 1 to STEPS.
MEASURES = {
    "symbol_share": ("n_symbols / n_words", 0.05),
    "capital_share": ("n_capitals / word_chars", 0.02),
    "exclamation_share": ("n_exclamations / n_words", 0.02),
    "dup_line_share": ("n_dup_lines / n_lines", 0.02),
    "repeat_share": ("n_repeat_words / n_words", 0.02),
    "mean_word_length": ("word_chars / n_words", 0.25),
}
STEPS = 64


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with counts of each text and ``steps``: for each measure how many steps it reaches."""
    text = F.coalesce(F.col("text"), F.lit(""))
    only = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("bigint")
    bare = F.btrim(text, F.lit(_BLANKS))
    out = docs.withColumn("__words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP)))
    out = out.withColumn("__lines", F.expr(r"filter(split(coalesce(text, ''), '\n'), x -> btrim(x, ' \t\n\u000b\u000c\r') <> '')"))
    window = "xxhash64(x, get(__words, i + 1), get(__words, i + 2))"
    out = out.withColumn("__hashes", F.expr(f"IF(size(__words) < 3, array(), transform(slice(__words, 1, size(__words) - 2), (x, i) -> {window}))"))
    # few texts repeat a window, so only these are sorted
    runs = "array_sort(transform(__hashes, (h, i) -> struct(h AS h, i AS i)))"
    out = out.withColumn("__runs", F.expr(f"IF(size(array_distinct(__hashes)) = size(__hashes), NULL, {runs})"))
    twice = "get(__runs, j - 1).h = r.h OR get(__runs, j + 1).h = r.h"
    out = out.withColumn("__at", F.expr(f"array_sort(filter(transform(__runs, (r, j) -> IF({twice}, r.i, NULL)), p -> p IS NOT NULL))"))
    repeated = "aggregate(transform(__at, (p, k) -> least(3, coalesce(get(__at, k + 1) - p, 3))), 0L, (a, x) -> a + x)"
    out = out.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": F.length(F.regexp_replace(text, _GAP, "")).cast("bigint"),
        "n_symbols": only("#*$%&|<>"),
        "n_capitals": only("A-Z"),
        "n_exclamations": only("!"),
        "n_lines": F.size("__lines").cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_repeat_words": F.expr(f"coalesce({repeated}, 0L)"),
    })
    steps = ", ".join(f"least(coalesce(floor(try_divide({share.split(' / ')[0]}, {share.split(' / ')[1]}) / {width}), 0), {STEPS})" for share, width in MEASURES.values())
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.drop("__words", "__lines", "__hashes", "__runs", "__at").withColumns({"steps": F.expr(f"transform(array({steps}), x -> cast(x AS int))"), "base_failed": failed})


def binomial_cdf(x: str, n: str, p: str) -> str:
    """SQL for the probability of at most ``x`` of ``n``, for ``x`` up to ``n * p``; in logarithms, and 1 beyond that."""
    first = f"{n} * ln(1 - {p})"
    term = f"a.t + ln(({n} - k + 1) / k) + ln({p} / (1 - {p}))"
    log = (
        f"aggregate(IF({x} < 1, cast(array() AS array<bigint>), sequence(1L, cast({x} AS bigint))), named_struct('t', {first}, 's', {first}),"
        f" (a, k) -> named_struct('t', {term}, 's', greatest(a.s, {term}) + log1p(exp(-abs(a.s - ({term}))))), a -> a.s)"
    )
    return f"IF({x} > {n} * {p}, 1D, exp({log}))"


def cutoffs(
    measures: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA, cost: float = COST
) -> DataFrame:
    """``stratum`` and ``least``: for each measure the number of steps from which a text is rejected, or null.

    ``measures`` has ``doc_id, stratum, steps, base_failed``; texts that fail the base rules teach nothing.
    """
    said = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    rows = measures.where("NOT base_failed").select("doc_id", "stratum", "steps").join(said, "doc_id")
    rows = keep(rows.withColumn("holdout", F.pmod(F.xxhash64("doc_id", F.lit("holdout")), F.lit(2)) == 1))
    tuning, holdout = rows.where("NOT holdout"), rows.where("holdout")

    # at most STEPS + 1 rows for each stratum and measure from here on
    count = lambda cond: F.sum(F.expr(cond).cast("bigint"))
    bins = tuning.select("stratum", "good", F.posexplode("steps").alias("measure", "step")).groupBy("stratum", "measure", "step")
    down = W.partitionBy("stratum", "measure").orderBy(F.desc("step"))
    tails = bins.agg(count("good").alias("g"), count("NOT good").alias("b")).select("stratum", "measure", "step", F.sum("g").over(down).alias("x"), F.sum("b").over(down).alias("hit"))
    rate = (F.col("x") + 1) / (F.col("x") + F.col("hit") + 2)
    order = W.partitionBy("stratum").orderBy(rate, F.desc("hit"), "measure", F.desc("step"))
    worth = tails.where((F.col("step") > 0) & (F.col("hit") > F.lit(cost) * F.col("x")))
    ranked = keep(worth.select("stratum", "measure", "step", F.row_number().over(order).alias("rank")))

    # the first rule of the sequence that rejects a text, from the steps it reaches
    entries = ranked.groupBy("stratum").agg(F.collect_list(F.struct("measure", "step", "rank")).alias("e"))
    first = f"transform(sequence(0, {len(MEASURES) - 1}), m -> transform(sequence(0, {STEPS}), s -> array_min(transform(filter(e, c -> c.measure = m AND c.step <= s), c -> c.rank))))"
    firsts = entries.select(F.col("stratum").alias("s"), F.expr(first).alias("first"))
    good = holdout.where("good").join(firsts, F.col("stratum").eqNullSafe(F.col("s")), "left")
    rejected = good.select("stratum", F.expr("array_min(zip_with(steps, first, (x, f) -> f[x]))").alias("rank"))
    by_rank = keep(rejected.groupBy("stratum", "rank").agg(F.count("*").alias("x")))
    n = by_rank.groupBy(F.col("stratum").alias("s")).agg(F.sum("x").alias("n"))
    strata = max(1, n.count())

    up = W.partitionBy("stratum").orderBy("rank")
    seen = by_rank.where("rank IS NOT NULL").select(F.col("stratum").alias("h_s"), F.col("rank").alias("h_r"), "x")
    rules = ranked.join(seen, F.col("stratum").eqNullSafe(F.col("h_s")) & (F.col("rank") == F.col("h_r")), "left").join(n, F.col("stratum").eqNullSafe(F.col("s")))
    tested = rules.select("stratum", "measure", "step", "rank", "n", F.sum(F.coalesce("x", F.lit(0))).over(up).alias("x"))
    proved = F.expr(binomial_cdf("x", "cast(n AS double)", f"{max_false_rejection!r}D")) <= F.lit(delta / strata)
    sound = tested.withColumn("ok", F.min(proved).over(up)).where("ok")
    chosen = sound.groupBy("stratum", "measure").agg(F.min("step").alias("step"))
    as_map = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("measure", "step"))).alias("m"))
    return as_map.select("stratum", F.expr(f"transform(sequence(0, {len(MEASURES) - 1}), i -> m[i])").alias("least"))


def verdicts(measures: DataFrame, chosen: DataFrame) -> DataFrame:
    """``measures`` with ``kept``. The cutoffs are stored, so that Spark knows their size and broadcasts them if it is small."""
    chosen = stored(chosen.select(F.col("stratum").alias("__s"), F.col("least").alias("__least")))[0]
    joined = measures.join(chosen, F.col("stratum").eqNullSafe(F.col("__s")), "left")
    over = F.expr("coalesce(exists(zip_with(steps, __least, (x, y) -> coalesce(x >= y, false)), z -> z), false)")
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("__s", "__least")


def op9_risk_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    measures = stored(measured(docs.select("doc_id", F.col("lang").alias("stratum"), "text")).drop("text"))[0]
    out = verdicts(measures, cutoffs(measures, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the texts that the rules reject; texts are measured once, beside their rows, and stored."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "doc_id", F.col("lang").alias("stratum"), "text")
    judged = stored(measured(own).select("__row", "doc_id", "stratum", "steps", "base_failed"))[0]
    return verdicts(judged, cutoffs(judged, labels.select("doc_id", "quality"))).where("kept").select("__row.*")
