"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. *Features.* Words, and word beginnings of 4 to 10 bytes, each at the levels "once",
   "twice" and "four times or more" in a text. From labelled texts those are taken that
   tell the classes apart by the likelihood ratio, at a false discovery rate of
   ``FDR``; the ratio goes on growing with the labels for words of one class only.
2. *Voters.* A word list by language and category, and patterns (shouting, runs of
   exclamation marks, masked words, stretched words), vote where they find
   something. The learnt features are dealt to banks by kind and by how surely they
   speak for a class; a bank has three voters, which vote if one, two, or four of its
   features are in the text. A voter that finds nothing abstains. All texts vote;
   equal ballots are counted together.
3. *Label model.* Expectation maximisation over the ballots of all texts estimates how
   often each voter votes in either class, and the voters' pairwise correlations in
   both classes; a voter's say is divided by the number of voters it repeats.
   Labelled texts count in their class and so fix what the classes mean; all other
   texts count by their posterior, together as much as the labelled ones at most.
4. *Classifier.* Logistic regression over all features, trained on the posterior that
   the votes alone give, for labelled and unlabelled texts alike. No label is a target.

A score depends on the text alone. Labels are read only for texts outside the
held-out fold. At most about ``MAX_LABELLED`` labelled texts teach features and
classifier, and ``MAX_UNLABELLED`` others the classifier, taken by a hash of
``doc_id``; votes, ballots, the label model and scores cover all rows.

Edge cases: null and empty texts have no features and get the base rate; texts of
any length are read whole; repeated rows score the same; a label for a null
``doc_id`` is ignored, of repeated labels the worse counts; labels of one class only
teach nothing, and all scores are 0; an empty table gives no rows. Columns besides
``doc_id, text`` and ``doc_id, toxic`` are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep, table
from .tokens import ALNUM, Words, chunks, mix, string_hash

MAX_LABELLED, MAX_UNLABELLED = 20_000, 20_000
FDR, MIN_TEXTS, ROUNDS, MIN_CORRELATION, L2, THRESHOLD = 0.05, 4, 8, 0.1, 0.3, 0.7
PREFIXES = (4, 5, 6, 7, 8, 9, 10)
LEVELS = (1, 2, 4)

# Words of abuse by language and category; each group is one voter.
LISTED = {
    "en insult": "idiot idiots moron morons stupid dumb imbecile cretin fool loser losers clown halfwit",
    "en contempt": "trash scum garbage filth filthy vermin worthless pathetic disgusting despicable repulsive",
    "en profanity": "shit shitty bullshit fuck fucking fucker bitch bastard asshole crap piss",
    "en threat": "kys slit strangle lynch exterminate behead",
    "de insult": "idiot idioten dumm dummkopf trottel depp vollidiot arschloch versager schwachkopf",
    "de contempt": "abschaum dreck widerlich erbärmlich wertlos ekelhaft scheiße scheisse missgeburt",
    "fr insult": "idiot idiote imbécile crétin abruti débile connard connasse bouffon",
    "fr contempt": "ordure merde minable pathétique dégoûtant racaille raclure salaud salope",
    "es insult": "idiota imbécil estúpido estúpida tonto tonta cretino payaso gilipollas",
    "es contempt": "basura escoria mierda patético asqueroso asquerosa inútil cabrón puta",
}
N_PATTERNS = 4
#: Kinds of features (words, beginnings of up to 6 bytes, longer ones), and the least precision of each bank of a kind.
KINDS, BANDS = 3, (0.8, 0.6, 0.4, 0.2, 0.0)
N_BANKS = KINDS * len(BANDS) + 1  #: the last one speaks for the clean class
N_VOTERS = len(LISTED) + N_PATTERNS + N_BANKS * len(LEVELS)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def patterns(w: Words, bounds: np.ndarray) -> np.ndarray:
    """For each text whether it shouts, has runs of exclamation marks, masks letters in words, stretches words."""
    d, n = w.data, w.n_texts
    of = np.repeat(np.arange(n), np.diff(bounds))
    upper, lower = (d >= 0x41) & (d <= 0x5A), (d >= 0x61) & (d <= 0x7A)
    count = lambda m: np.bincount(of[m], minlength=n)
    caps, letters = count(upper), count(upper | lower)
    bang = d == 0x21
    runs = np.zeros(len(d), bool)
    runs[1:] = bang[1:] & bang[:-1]
    masked = np.zeros(len(d), bool)
    if len(d) > 2:
        masked[1:-1] = np.isin(d[1:-1], [0x2A, 0x40, 0x24, 0x23]) & (upper | lower)[:-2] & (upper | lower)[2:]
    low = np.where(upper, d + 0x20, d)
    stretched = np.zeros(len(d), bool)
    if len(d) > 3:
        stretched[3:] = (upper | lower)[3:] & (low[3:] == low[2:-1]) & (low[3:] == low[1:-2]) & (low[3:] == low[:-3])
    return np.stack([(caps * 10 > letters * 3) & (letters >= 20), count(runs) >= 3, count(masked) >= 1, count(stretched) >= 1], axis=1)


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of their beginnings, the numbers of their kinds, and their texts."""
    hashes, kinds, texts = [w.hash], [np.zeros(len(w.hash), np.int8)], [w.text]
    for k in PREFIXES:
        at = np.flatnonzero(w.end - w.start > k)
        hashes.append(mix(w.prefix_hash(w.start[at], k) ^ np.uint64(k)))
        kinds.append(np.full(len(at), 1 if k <= 6 else 2, np.int8))
        texts.append(w.text[at])
    return np.concatenate(hashes), np.concatenate(kinds), np.concatenate(texts)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in columns that are sorted together."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


@dataclass
class Lexicon:
    """Features by the sorted ``hashes`` they are at a level of; ``place`` has a row for each hash, -1 where a level isn't one."""

    hashes: np.ndarray
    place: np.ndarray
    bank: np.ndarray  #: of each feature; -1 for words of the list
    group: np.ndarray  #: of each hash the groups of the list it is in, as bits
    n_toxic: int
    n_labelled: int

    @property
    def n_features(self) -> int:
        return len(self.bank)


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of ``rows`` at most, by a hash of ``doc_id``."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, text, toxic`` of labelled texts outside the held-out fold."""
    said = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = _sampled(said.where(~held_out()), most)
    # about ``most`` short rows at most
    return keep(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))


_COUNTS = ("n", "t", "rows")


def feature_counts(sample: DataFrame) -> DataFrame:
    """``h, kind, level, n, t, rows``: texts that have a feature, toxic ones, and a sum that names these texts."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h, kind, level, *counts = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((level, kind, h))
        h, kind, level = h[order], kind[order], level[order]
        at = _starts(h, kind, level)
        return h[at], kind[at], level[at], *(np.add.reduceat(c[order], at) if len(at) else c for c in counts)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            h, kind, level, n, t, rows = merged(parts)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind), pa.array(level), *map(pa.array, (n, t, rows))], ["h", "kind", "level", *_COUNTS])

        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            row = batch.column("row").to_numpy()
            for w in chunks(batch.column("text"), ALNUM):
                h, kind, text = features(w)
                order = np.lexsort((text, kind, h))
                h, kind, text = h[order], kind[order], text[order]
                at = _starts(h, kind, text)
                often = np.diff(np.append(at, len(h)))
                for level in LEVELS:
                    own = at[often >= level]
                    doc = w.first + text[own]
                    ones = np.ones(len(own), np.int64)
                    parts.append(merged([(h[own], kind[own], np.full(len(own), level, np.int8), ones, toxic[doc], row[doc])]))
                    size += len(parts[-1][0])
                if size > 4_000_000:
                    yield sent()
                    parts, size = [], 0
        if size:
            yield sent()

    # 40 bits each, so that no sum overflows
    numbered = sample.select("text", "toxic", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 24).alias("row"))
    return (
        numbered.mapInArrow(counted, "h bigint, kind tinyint, level tinyint, n bigint, t bigint, rows bigint")
        .groupBy("h", "kind", "level").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    )


def _likelihood(k: str, m: str) -> str:
    """SQL for the logarithm of the greatest likelihood of ``k`` of ``m``."""
    part = lambda x: f"IF({x} > 0, {x} * ln({x} / {m}), 0D)"
    return f"({part(k)} + {part(f'({m} - {k})')})"


def significance(counts: dict[int, int], tested: int, fdr: float = FDR) -> int | None:
    """The least whole likelihood ratio from which on at most ``fdr`` of the features are expected by chance.

    ``counts`` has the number of features by the whole part of twice the log ratio.
    """
    above, least = 0, None
    for g in sorted(counts, reverse=True):
        above += counts[g]
        if g < 1 or tested * math.erfc(math.sqrt(g / 2)) > fdr * above:
            break
        least = g
    return least


def lexicon_of(sample: DataFrame, fdr: float = FDR) -> Lexicon:
    """The features that tell the classes apart, and the listed words; empty if the labels are all of one class."""
    sizes = sample.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("bigint")).alias("t")).first()
    n, t = int(sizes.n), int(sizes.t or 0)
    none = np.zeros(0, np.int64)
    if not t or t == n:
        return Lexicon(none.view(np.uint64), np.zeros((0, len(LEVELS)), np.int64), none, none, t, n)
    ratio = f"2 * ({_likelihood('t', 'n')} + {_likelihood(f'({t} - t)', f'({n} - n)')} - {_likelihood(str(t), str(n))})"
    rated = keep(feature_counts(sample).where(f"n >= {MIN_TEXTS}").withColumn("g", F.expr(ratio)))
    # at most 1,001 rows
    by_g = {r.g: r["count"] for r in rated.groupBy(F.least(F.floor("g"), F.lit(1000)).cast("int").alias("g")).count().collect()}
    least = significance(by_g, sum(by_g.values()), fdr)
    # of features of a kind in the same texts, such as a word's beginnings, one will do; the sample bounds how many pass
    chosen = rated.where(F.col("g") >= (F.lit(least) if least is not None else F.lit(float("inf"))))
    rows = chosen.groupBy("kind", *_COUNTS).agg(F.min(F.struct("level", "h")).alias("f")).select("kind", "n", "t", "f.level", "f.h").orderBy("h", "level").collect()

    groups: dict[int, int] = {}
    for i, words in enumerate(LISTED.values()):
        for h in string_hash(words):
            groups[h] = groups.get(h, 0) | 1 << i
    hashes = np.unique(np.array([r.h & 0xFFFFFFFFFFFFFFFF for r in rows] + list(groups), dtype=np.uint64))
    place = np.full((len(hashes), len(LEVELS)), -1)
    bank: list[int] = []
    for r in rows:
        place[np.searchsorted(hashes, np.uint64(r.h & 0xFFFFFFFFFFFFFFFF)), LEVELS.index(r.level)] = len(bank)
        bank.append(_bank(r.kind, r.t, r.n, t / n))
    group = np.zeros(len(hashes), np.int64)
    for h, bits in groups.items():
        at = np.searchsorted(hashes, np.uint64(h))
        group[at] = bits
        if place[at, 0] < 0:
            place[at, 0] = len(bank)
            bank.append(-1)
    return Lexicon(hashes, place, np.array(bank), group, t, n)


def _bank(kind: int, t: int, n: int, base: float) -> int:
    """By the precision less one standard error (Wilson); features of the clean class share one."""
    if t < base * n:
        return N_BANKS - 1
    p = t / n
    low = (p + 0.5 / n - math.sqrt(p * (1 - p) / n + 0.25 / n / n)) / (1 + 1 / n)
    return kind * len(BANDS) + next(i for i, least in enumerate(BANDS) if low >= least)


def _found(w: Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by text: texts and their features; and for each text the groups of the list it has words of."""
    h, _, text = features(w)
    group = np.zeros(w.n_texts, np.int64)
    if not len(lexicon.hashes) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), group
    at = np.minimum(np.searchsorted(lexicon.hashes, h), len(lexicon.hashes) - 1)
    hit = lexicon.hashes[at] == h
    pair, often = np.unique(text[hit] * len(lexicon.hashes) + at[hit], return_counts=True)
    text, at = pair // len(lexicon.hashes), pair % len(lexicon.hashes)
    np.bitwise_or.at(group, text, lexicon.group[at])
    there = (often[:, None] >= np.array(LEVELS)) & (lexicon.place[at] >= 0)
    return np.repeat(text, there.sum(axis=1)), lexicon.place[at][there], group


def found_features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` without ``text``, with ``hits`` (features) and ``ballot`` (a bit for each voter)."""
    others = [f for f in docs.schema.fields if f.name != "text"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column("text"), ALNUM):
                text, hits, ballot = _found(w, lexicon)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(w.n_texts + 1)), pa.int32()), pa.array(hits, pa.int32()))
                for i, p in enumerate(patterns(w, w.bounds).T):
                    ballot |= p.astype(np.int64) << (len(LISTED) + i)
                learnt = lexicon.bank[hits] >= 0
                banks = np.bincount(text[learnt] * N_BANKS + lexicon.bank[hits[learnt]], minlength=w.n_texts * N_BANKS).reshape(w.n_texts, N_BANKS)
                bit = len(LISTED) + N_PATTERNS
                for level in LEVELS:
                    for b in range(N_BANKS):
                        ballot |= (banks[:, b] >= level).astype(np.int64) << bit
                        bit += 1
                same = [batch.column(f.name).slice(w.first, w.n_texts) for f in others]
                yield pa.RecordBatch.from_arrays([*same, lists, pa.array(ballot)], [*(f.name for f in others), "hits", "ballot"])

    own = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in others)
    return docs.mapInArrow(made, own + "hits array<int>, ballot bigint")


@dataclass
class LabelModel:
    base: float  #: share of toxic texts
    votes: np.ndarray  #: of each voter the share of texts it votes for: clean ones, toxic ones
    weight: np.ndarray  #: one over the number of voters that it repeats
    correlation: np.ndarray  #: of each pair of voters, among clean and among toxic texts

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """For ballots (rows of 0 and 1)."""
        clean, toxic = self.votes
        yes, no = np.log(toxic / clean), np.log((1 - toxic) / (1 - clean))
        return np.log(self.base / (1 - self.base)) + (x * yes + (1 - x) * no) @ self.weight

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def _bits(ballots: np.ndarray) -> np.ndarray:
    return ((ballots[:, None] >> np.arange(N_VOTERS)) & 1).astype(np.float64)


def _sums(x: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For both classes how much the ballots ``x`` weigh, the votes of each voter, and those of each pair."""
    return np.concatenate([np.concatenate([[r.sum()], r @ x, ((x * r[:, None]).T @ x).ravel()]) for r in (clean, toxic)])


def _estimated(sums: np.ndarray) -> LabelModel:
    """The label model that :func:`_sums` over all ballots give."""
    m = N_VOTERS
    (n0, n1), votes, both = sums.reshape(2, -1)[:, 0], sums.reshape(2, -1)[:, 1 : 1 + m], sums.reshape(2, -1)[:, 1 + m :].reshape(2, m, m)
    n = np.maximum([n0, n1], 1e-9)[:, None]
    mean = votes / n
    cov = both / n[:, :, None] - mean[:, :, None] * mean[:, None, :]
    sd = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 1e-9))
    corr = np.clip(cov / (sd[:, :, None] * sd[:, None, :]), -1, 1)
    corr[:, np.arange(m), np.arange(m)] = 1
    repeated = corr.max(axis=0)
    weight = 1 / np.where(repeated >= MIN_CORRELATION, repeated, 0).sum(axis=1)
    return LabelModel(min(max((n1 + 1) / (n0 + n1 + 2), 1e-6), 0.5), (votes + 0.5) / (n + 1), weight, corr)


def label_model(ballots: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS) -> LabelModel:
    """From ``ballot, n_clean, n_toxic, n`` (how many labelled clean, labelled toxic and other texts have it)."""
    size = 2 * (1 + N_VOTERS + N_VOTERS**2)
    # texts without a label weigh as much as those with one at most, so that the hidden label stays the labels' own
    total = ballots.agg(F.sum("n")).first()[0] or 0
    share = min(1.0, lexicon.n_labelled / max(1, total))

    def part(model: LabelModel | None) -> np.ndarray:
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                x = _bits(batch.column("ballot").to_numpy())
                clean, toxic, n = (batch.column(c).to_numpy().astype(float) for c in ("n_clean", "n_toxic", "n"))
                if model is not None:
                    p = model.posterior(x)
                    clean, toxic = clean + share * n * (1 - p), toxic + share * n * p
                out += _sums(x, clean, toxic)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(out)], ["i", "v"])

        rows = ballots.mapInArrow(made, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        v = np.zeros(size)
        v[rows["i"]] = rows["v"]
        return v

    model = _estimated(part(None))
    for _ in range(rounds):
        newer = _estimated(part(model))
        moved = np.abs(newer.votes - model.votes).max()
        model = newer
        if moved < 1e-4:
            break
    return model


@dataclass
class Classifier:
    bias: float
    weights: np.ndarray  #: of each feature


def fitted(n_hits: np.ndarray, hits: np.ndarray, target: np.ndarray, n_features: int, l2: float = L2, rounds: int = 1000) -> Classifier:
    """Logistic regression on soft targets, by accelerated gradient steps with a bound on the curvature, until steps are tiny.

    ``n_hits`` are the numbers of features of each text, ``hits`` the features, text after text.
    """
    n = len(n_hits)
    row = np.repeat(np.arange(n, dtype=np.int32), n_hits)
    w, b = np.zeros(n_features), 0.0
    step = 1 / (0.25 * np.maximum(np.bincount(hits, weights=(n_hits + 1.0)[row], minlength=n_features), 1) + l2)
    step_b = 1 / (0.25 * max(1.0, (n_hits + 1.0).sum()))
    w1, b1, t = w, b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b1 + np.bincount(row, weights=w1[hits], minlength=n), -500, 500)))
        g = p - target
        w2 = w1 - step * (np.bincount(hits, weights=g[row], minlength=n_features) + l2 * w1)
        b2 = b1 - step_b * g.sum()
        moved = max(np.abs(w2 - w).max(initial=0), abs(b2 - b))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w1, b1 = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
        if moved < 1e-4:
            break
    return Classifier(float(b), w)


def learned(found: DataFrame, lexicon: Lexicon) -> tuple[LabelModel, Classifier]:
    """From ``doc_id, toxic, hits, ballot`` of all texts; ``toxic`` is null for texts whose label isn't known."""
    of = lambda cond: F.sum(F.expr(cond).cast("bigint"))
    ballots = keep(found.groupBy("ballot").agg(of("toxic IS NOT NULL AND NOT toxic").alias("n_clean"), of("coalesce(toxic, false)").alias("n_toxic"), of("toxic IS NULL").alias("n")))
    model = label_model(ballots, lexicon)
    # two samples of bounded size
    own = found.where("toxic IS NOT NULL").unionByName(_sampled(found.where("toxic IS NULL"), MAX_UNLABELLED))
    rows = own.select("doc_id", "hits", "ballot").toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("ballot", "ascending")])
    if not rows.num_rows:
        return model, Classifier(0.0, np.zeros(lexicon.n_features))
    lists = rows.column("hits").combine_chunks()
    target = model.posterior(_bits(rows.column("ballot").to_numpy()))
    return model, fitted(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), target, lexicon.n_features)


def scored(found: DataFrame, classifier: Classifier) -> DataFrame:
    """``found`` with ``score``."""
    w, b = classifier.weights, classifier.bias

    @F.pandas_udf("double")
    def of(hits: pd.Series) -> pd.Series:
        n = np.array([len(x) for x in hits], dtype=np.int64)
        row = np.repeat(np.arange(len(n)), n)
        col = np.concatenate(list(hits)).astype(np.int64) if len(row) else row
        return pd.Series(1 / (1 + np.exp(-np.clip(b + np.bincount(row, weights=w[col], minlength=len(n)), -500, 500))))

    return found.withColumn("score", of("hits"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score`` for each row of ``docs``."""
    sample = labelled_sample(docs, labels)
    lexicon = lexicon_of(sample)
    if not len(lexicon.hashes):
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(0.0).alias("score"))
    known = sample.select(F.col("doc_id").alias("k_id"), "toxic").distinct()
    found = found_features(docs.select("doc_id", "text"), lexicon)
    # about MAX_LABELLED short rows at most
    found = keep(found.join(F.broadcast(known), F.col("doc_id") == F.col("k_id"), "left").drop("k_id"))
    _, classifier = learned(found, lexicon)
    return scored(found, classifier).select("doc_id", held_out().alias("held_out"), "score")


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
