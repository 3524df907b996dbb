"""Quality rules: counts of every text, and robust outliers by minimum covariance determinant per language and source.

The covariance estimates come from concentration steps that run as aggregations: distances of all rows to the current
estimate, the cut that keeps the closest share of each group (read off a histogram of the distances, so no group is sorted or
gathered), then sums and cross products of the rows kept. A group of any size meets only as its sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.llm import bytewise as B
from recordmill.llm.tables import texts
from recordmill.session import stage

WINDOW = 8
KEPT_SHARE = 0.75          # of a group's rows, those its estimate is made of
STEPS = 5                  # concentration steps
MIN_GROUP = 40             # smaller groups are judged by the next wider one: language, then all
FLOOR = 0.02               # least variance of a transformed statistic, so that constant ones don't reject what barely differs
CUT = 60.0                 # squared Mahalanobis distance beyond which a row is an outlier
# Median of the squared distance under a normal law, by number of statistics.
_CHI2_MEDIAN = {4: 3.357}
_BINS_PER_UNIT = 64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, at = B.words(data, offsets)
    n_words = np.diff(at)
    prefix = B.prefix_hash(data)
    inside = ~B.SPACE[data]
    word_chars = B.sums(inside & ~_CONTINUES[data], offsets)
    n_symbols = B.sums(_SYMBOL[data], offsets)

    # Lines end at a \n or with their text.
    breaks = np.flatnonzero(data == 0x0A)
    edge = np.concatenate([breaks + 1, offsets[:-1]])
    stop = np.concatenate([breaks, offsets[1:]])
    edge.sort()
    stop.sort()
    holds = np.searchsorted(starts, stop) > np.searchsorted(starts, edge)
    edge, stop = edge[holds], stop[holds]
    owner = np.searchsorted(offsets, edge, "right") - 1
    again = ~B.first_seen(owner, B.range_hash(prefix, edge, stop))
    n_dup_lines = np.bincount(owner[again], minlength=len(n_words))

    windows, window_at = B.shingles(B.range_hash(prefix, starts, ends), at, WINDOW)
    owner = B.owners(window_at)
    key = windows ^ B.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    first_word = np.arange(len(key)) - window_at[:-1][owner] + at[:-1][owner]
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, first_word[twice], 1)
    np.subtract.at(depth, first_word[twice] + WINDOW, 1)
    n_repeat = B.sums(np.cumsum(depth)[:-1] > 0, at)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat]


def count_texts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in B.runs(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(first, last - first) for i in (0, 2, 3)]
                    + [pa.array(v.astype(np.int64)) for v in _count(data, offsets)],
                    ["doc_id", "lang", "source", *COUNTS],
                )

    return texts(docs, "lang", "source").mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def transformed() -> list[Column]:
    """Bounded or logarithmic forms of the counts, in which ordinary documents are roughly elliptic."""
    n = F.greatest("n_words", F.lit(1))
    return [
        F.col("word_chars") / n / 4,
        F.sqrt(F.col("n_symbols") / n) * 2,
        F.sqrt(F.col("n_repeat_words") / n) * 2,
        F.log1p(F.col("n_dup_lines") / n * 20) * 2,
    ]


_PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
_MODEL = T.StructType([T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType()))])


def _sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """Row count, sums and cross products of the statistics, added up before the shuffle."""
    x = F.col("x")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(x[i]) for i in range(4)]).alias("one"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in _PAIRS]).alias("two"),
    )


def _fit(n: int, one: list[float], two: list[float]) -> tuple[list[float], list[float]]:
    """Mean, and inverse covariance as a flat matrix, of one group's sums."""
    mean = np.array(one) / n
    cov = np.empty((4, 4))
    for (i, j), s in zip(_PAIRS, two, strict=True):
        cov[i, j] = cov[j, i] = s / n - mean[i] * mean[j]
    values, axes = np.linalg.eigh(cov)
    return mean.tolist(), ((axes / np.maximum(values, FLOOR)) @ axes.T).ravel().tolist()


def _models(sums: DataFrame, by: list[str]) -> DataFrame:
    fit = F.udf(_fit, _MODEL)
    return sums.select(*by, fit("n", "one", "two").alias("model"))


def _distance(model: Column) -> Column:
    """Squared Mahalanobis distance of ``x``."""
    d = [F.col("x")[i] - model["mean"][i] for i in range(4)]
    total = F.lit(0.0)
    for i in range(4):
        for j in range(4):
            total = total + d[i] * d[j] * model["inverse"][4 * i + j]
    return F.greatest(total, F.lit(0.0))


def _bin(distance: Column) -> Column:
    """Logarithmic bin of a squared distance; about 1.6 % wide."""
    return F.floor(F.log(distance + 1e-3) * _BINS_PER_UNIT).cast("long")


def _binned(rows: DataFrame, models: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(models, by).withColumn("bin", _bin(_distance(F.col("model"))))


def _cuts(binned: DataFrame, by: list[str], share: float) -> DataFrame:
    """The bin up to which at least ``share`` of each group's rows lie; groups come as counts by bin."""
    counts = binned.groupBy(*by, "bin").count().groupBy(*by).agg(
        F.sum("count").alias("all"), F.sort_array(F.collect_list(F.struct("bin", "count"))).alias("bins"))
    running = F.aggregate(
        "bins", F.struct(F.lit(0).cast("long").alias("so_far"), F.lit(None).cast("long").alias("cut")),
        lambda a, b: F.struct(
            (a["so_far"] + b["count"]).alias("so_far"),
            F.when(a["cut"].isNotNull(), a["cut"]).when(a["so_far"] + b["count"] >= share * F.col("all"), b["bin"]).alias("cut"),
        ),
    )
    return counts.select(*by, running["cut"].alias("cut"))


def robust_models(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: mean and inverse covariance of its most concentrated share, and the scale that makes distances comparable.

    Starts from each statistic's median and spread, which a minority of odd rows cannot move, then repeats: keep the closest
    ``KEPT_SHARE``, estimate anew. Each step cannot raise the determinant of the covariance.
    """
    x = F.col("x")
    spread = rows.groupBy(*by).agg(*[F.percentile_approx(x[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q{i}") for i in range(4)])
    scale = [F.greatest(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2, F.lit(FLOOR)) for i in range(4)]
    start = F.struct(
        F.array(*[F.col(f"q{i}")[1] for i in range(4)]).alias("mean"),
        F.array(*[1 / scale[i] if i == j else F.lit(0.0) for i in range(4) for j in range(4)]).alias("inverse"),
    )
    models = stage(spread.select(*by, start.alias("model")), "models")
    for _ in range(STEPS):
        binned = _binned(rows, models, by)
        closest = binned.join(_cuts(binned, by, KEPT_SHARE), by).where("bin <= cut")
        models = stage(_models(_sums(closest, by), by), "models")
    half = _cuts(_binned(rows, models, by), by, 0.5)
    # The kept share's covariance is too small; the median distance says by how much.
    factor = F.greatest(F.exp((F.col("cut") + 0.5) / _BINS_PER_UNIT) / _CHI2_MEDIAN[4], F.lit(1.0))
    return stage(models.join(half, by).select(*by, "model", factor.alias("factor")), "models")


def quality_rules(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Base counts and rules, then rejection of outliers of the document's language and source.

    Returns doc_id, the five counts, base_failed (fewer than 20 words, or over 30 % of the words in an 8-word window that
    repeats), distance (squared, scaled; null if base_failed) and kept. Estimates take rows that pass the base rules. Null lang
    and null source are groups of their own; a group of fewer than MIN_GROUP rows is judged by its language, or by all rows;
    where even those are fewer, only the base rules decide. Null and empty texts have no words and so fail. Repeated rows are
    judged alike. Other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    counted = count_texts(docs).withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    counted = counted.withColumns({
        # null-safe join keys
        "l": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "s": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
        "x": F.when(~F.col("base_failed"), F.array(*transformed())),
    })
    counted = stage(counted, "counted")
    passing = counted.where("NOT base_failed")
    sizes = passing.groupBy("l", "s").count()
    langs = sizes.groupBy("l").agg(F.sum("count").alias("in_lang"))
    total = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("in_all"))
    level = (
        sizes.join(langs, "l").join(total)
        .select(
            F.col("l"), F.col("s"),
            F.when(F.col("count") >= MIN_GROUP, F.struct(F.lit(1).alias("level"), F.col("l").alias("a"), F.col("s").alias("b")))
            .when(F.col("in_lang") >= MIN_GROUP, F.struct(F.lit(2).alias("level"), F.col("l").alias("a"), F.lit("").alias("b")))
            .when(F.col("in_all") >= MIN_GROUP, F.struct(F.lit(3).alias("level"), F.lit("").alias("a"), F.lit("").alias("b"))).alias("g"),
        )
        .select("l", "s", "g.*")
    )
    level = stage(level, "levels")
    # A row counts in its own group, and in the wider ones that some group looks to.
    used = level.where("level is not null").select("level", "a", "b").distinct()
    wide = passing.select("x", F.explode(F.array(
        F.struct(F.lit(1).alias("level"), F.col("l").alias("a"), F.col("s").alias("b")),
        F.struct(F.lit(2).alias("level"), F.col("l").alias("a"), F.lit("").alias("b")),
        F.struct(F.lit(3).alias("level"), F.lit("").alias("a"), F.lit("").alias("b")),
    )).alias("g")).select("x", "g.*")
    by = ["level", "a", "b"]
    models = robust_models(wide.join(used, by, "left_semi"), by)
    judged = counted.join(level.join(models, by).select("l", "s", "model", "factor"), ["l", "s"], "left")
    distance = F.when(~F.col("base_failed"), _distance(F.col("model")) / F.col("factor"))
    return (
        judged.select("doc_id", *COUNTS, "base_failed", distance.alias("distance"))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True)))
    )
