"""Quality rules: plain limits, then robust multivariate outliers.

Each text gives a few counts. Texts that pass the base limits are grouped by language
and source; per group the centre and scatter of their transformed rates are those of
minimum covariance determinant: the half of the rows whose scatter has the least
determinant. From several starts (quartiles, covariance of hyperbolic tangents, sign
covariance) concentration steps take the half nearest by Mahalanobis distance and
estimate anew from it; after two steps the start of least determinant is kept and
concentrated until its determinant falls no more. One reweighting follows, and rows
beyond a chi-square quantile are outliers.

A step is two aggregations (a histogram of the distances, then moments), so a group of
any size is spread over tasks and no result hangs on the order of rows; only the groups'
estimates, not their rows, meet in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readroute.llm.common import SPACE, materialize, mix64, pick, text_chunks, text_sums, word_bounds, word_keys

MIN_WORDS = 50
#: A base failure: more than this share (percent) of words in repeated windows.
MAX_REPEAT_PERCENT = 50
#: Share of a group's rows that the determinant is taken of: half bears the most junk.
SUPPORT = 0.5
#: Chi-square share of the rows that the reweighted estimate is taken of.
REWEIGHT = 0.975
#: Share of normal rows beyond the cutoff.
TAIL = 1e-6
#: Steps of all starts before the best goes on alone.
FIRST_STEPS = 2
#: Bins of a distance for a factor of two; bins of a rate for its least deviation.
DISTANCE_BINS, RATE_BINS = 32, 16
#: Groups up to which their estimates are broadcast; more are joined by key.
BROADCAST_GROUPS = 10_000
#: Least standard deviation of each transformed rate, so constant rates don't make all else an outlier.
FLOORS = (0.08, 0.5, 0.16, 0.08, 0.1)
_DIM = len(FLOORS)
#: Rows a group needs for an estimate of its own: half of them must outnumber the rates.
MIN_GROUP = 2 * _DIM + 2
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i, _DIM)]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def chi_square(x: float, more: int = 0) -> float:
    """Share of chi-square over x, of five degrees of freedom and of seven with `more`."""
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3 + more * x * x / 15)


def chi_square_quantile(tail: float) -> float:
    """The x over which a share `tail` of chi-square of five degrees of freedom lies."""
    low, high = 0.0, 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) > tail else (low, middle)
    return low


def consistency(share: float) -> float:
    """What the scatter of the nearest `share` of normal rows must be multiplied by to be that of all."""
    return share / (1 - chi_square(chi_square_quantile(1 - share), 1))


def _repeat_words(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each word, whether it stands in a 3-word window found twice or more in its text."""
    covered = np.zeros(len(keys), bool)
    if len(keys) < 3:
        return covered
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    window = keys[:-2] * np.uint64(3) + mix64(keys[1:-1]) * np.uint64(5) + mix64(keys[2:] + np.uint64(11))
    at = np.flatnonzero(owner[:-2] == owner[2:])
    window = mix64(window[at] + owner[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(window)
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = at[twice]
    for k in range(3):
        covered[hit + k] = True
    return covered


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_chunks(batch, "text"):
            starts, ends, bounds = word_bounds(data, offsets)
            characters = (data & 0xC0) != 0x80
            repeated = _repeat_words(word_keys(data, starts, ends, fold=False), bounds)
            raw = data.tobytes()
            n_lines, dup = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
                n_lines.append(len(lines))
                dup.append(len(lines) - len(set(lines)))
            stats = [np.diff(bounds), text_sums(characters & ~SPACE[data], offsets), text_sums(_SYMBOLS[data], offsets), np.array(dup), text_sums(repeated, bounds), np.array(n_lines), text_sums((data >= 65) & (data <= 90), offsets)]
            columns = [rows.column(i) for i in range(3)] + [pa.array(x.astype(np.int64)) for x in stats]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang", "source", *_STATS])


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, counts..., base_failed) of each whole text; a null text has no words."""
    picked = pick(docs, id=id_col, lang=lang_col, source=source_col, text=text_col).withColumns({c: F.col(c).cast("string") for c in ("lang", "source")})
    kind = picked.schema["id"].dataType.simpleString()
    counted = picked.mapInArrow(_count, f"id {kind}, lang string, source string, " + ", ".join(f"{s} long" for s in _STATS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def rates() -> list[Column]:
    """The transformed rates: word length, symbols, repeated lines, repeated words, capitals."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(chars / words).alias("x0"),
        F.log1p(200 * F.col("n_symbols") / chars).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / words).alias("x3"),
        F.sqrt(F.col("n_upper") / chars).alias("x4"),
    ]


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(_DIM)]
    return sum(((1 if i == j else 2) * F.col(f"p{i}{j}") * d[i] * d[j] for i, j in _PAIRS), F.lit(0.0)).alias("d2")


_ESTIMATE = "g string, s int, n long, fall double, " + ", ".join([f"m{i} double" for i in range(_DIM)] + [f"p{i}{j} double" for i, j in _PAIRS])


def _estimates(g: pd.Series, s: int | pd.Series, n: pd.Series, centre: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    """Rows of estimates; `fall` is the logarithm of the determinant."""
    scatter = scatter + np.diag(np.square(FLOORS))
    inverse = np.linalg.inv(scatter)
    out = {"g": g, "s": s, "n": n, "fall": np.linalg.slogdet(scatter)[1]}
    out |= {f"m{i}": centre[:, i] for i in range(_DIM)} | {f"p{i}{j}": inverse[:, i, j] for i, j in _PAIRS}
    return pd.DataFrame(out)


def _square(rows: pd.DataFrame, name: str) -> np.ndarray:
    """Symmetric matrices of the columns name00, name01, ..."""
    out = np.zeros((len(rows), _DIM, _DIM))
    for i, j in _PAIRS:
        out[:, i, j] = out[:, j, i] = rows[f"{name}{i}{j}"]
    return out


def _from_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        n = rows["n"].to_numpy(float)[:, None, None]
        centre = np.stack([rows[f"q{i}"] for i in range(_DIM)], 1)
        spread = np.stack([rows[f"w{i}"] for i in range(_DIM)], 1)
        both = spread[:, :, None] * spread[:, None, :]
        mean = np.stack([rows[f"t{i}"] for i in range(_DIM)], 1) / n[:, :, 0]
        bent = _square(rows, "t") / n - mean[:, :, None] * mean[:, None, :]
        sign = _DIM * _square(rows, "u") / n
        for s, scatter in enumerate((both * np.eye(_DIM), both * bent, both * sign)):
            yield _estimates(rows["g"], s, rows["n"], centre, scatter)


def _from_moments(grow: float):
    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            k = rows["k"].to_numpy(float)
            centre = np.stack([rows[f"s{i}"] / k for i in range(_DIM)], 1)
            scatter = _square(rows, "c") / k[:, None, None] - centre[:, :, None] * centre[:, None, :]
            yield _estimates(rows["g"], rows["s"], rows["n"], centre, scatter * grow)

    return moments


def _beside(groups: DataFrame, few: bool) -> DataFrame:
    """A table of groups, sent to every task if they are few: a hot group's rows then stay where they are."""
    return F.broadcast(groups) if few else groups


def _reached(counts: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, r0, r1, ...): the first bin at which each share of a key's rows is reached, of (keys, bin, k) rows."""
    upto = Window.partitionBy(*keys).orderBy("bin")
    seen = counts.withColumns({"upto": F.sum("k").over(upto), "all": F.sum("k").over(Window.partitionBy(*keys))})
    return seen.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))).alias(f"r{i}") for i, q in enumerate(shares)])


def starts(vectors: DataFrame, few: bool) -> DataFrame:
    """Estimates of each group from which the concentration begins, numbered by s."""
    step = [f / RATE_BINS for f in FLOORS]
    binned = vectors.select("g", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") / step[i]) for i in range(_DIM)])).alias("dim", "bin"))
    quarters = _reached(binned.groupBy("g", "dim", "bin").agg(F.count("*").alias("k")), ["g", "dim"], [0.25, 0.5, 0.75])
    at = lambda i, c: F.max(F.when(F.col("dim") == i, c))
    shape = quarters.groupBy("g").agg(
        *[at(i, (F.col("r1") + 0.5) * step[i]).alias(f"q{i}") for i in range(_DIM)],
        *[at(i, F.greatest((F.col("r2") - F.col("r0")) * step[i] / 1.349, F.lit(FLOORS[i]))).alias(f"w{i}") for i in range(_DIM)],
    )
    scaled = vectors.join(_beside(materialize(shape), few), "g").withColumns({f"z{i}": (F.col(f"x{i}") - F.col(f"q{i}")) / F.col(f"w{i}") for i in range(_DIM)})
    norm = F.greatest(F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(_DIM)), F.lit(0.0))), F.lit(1e-9))
    scaled = scaled.withColumn("norm", norm).withColumns({f"h{i}": F.tanh(f"z{i}") for i in range(_DIM)})
    sums = scaled.groupBy("g").agg(
        F.count("*").alias("n"), *[F.first(f"{c}{i}").alias(f"{c}{i}") for c in "qw" for i in range(_DIM)], *[F.sum(f"h{i}").alias(f"t{i}") for i in range(_DIM)],
        *[F.sum(F.col(f"h{i}") * F.col(f"h{j}")).alias(f"t{i}{j}") for i, j in _PAIRS], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm") ** 2).alias(f"u{i}{j}") for i, j in _PAIRS],
    )
    return materialize(sums.mapInPandas(_from_starts, _ESTIMATE))


def _moments(near: DataFrame, grow: float) -> DataFrame:
    """Estimates of each group and start from its rows in `near`."""
    sums = near.groupBy("g", "s").agg(
        F.first("n").alias("n"), F.count("*").alias("k"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(_DIM)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}{j}") for i, j in _PAIRS]
    )
    return sums.mapInPandas(_from_moments(grow), _ESTIMATE)


def concentrate(vectors: DataFrame, found: DataFrame, few: bool, support: float = SUPPORT, grow: float = 1.0) -> DataFrame:
    """One concentration step: estimates from the `support` of each group's rows nearest to those in `found`."""
    place = F.floor(F.log2(F.greatest(_distance(), F.lit(1e-9))) * DISTANCE_BINS).alias("bin")
    far = vectors.join(_beside(found, few), "g").select("g", "s", place)
    limits = _reached(far.groupBy("g", "s", "bin").agg(F.count("*").alias("k")), ["g", "s"], [support]).withColumnRenamed("r0", "most")
    limits = limits.join(_beside(found, few), ["g", "s"])
    near = vectors.join(_beside(limits, few), "g").withColumn("bin", place).filter("bin <= most")
    return _moments(near, grow)


def estimate(vectors: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(g, n, centre m*, inverse scatter p*) of each group of (g, x0..x4) rows."""
    few = vectors.select("g").distinct().count() <= BROADCAST_GROUPS
    found = starts(vectors, few)
    for _ in range(FIRST_STEPS):
        found = materialize(concentrate(vectors, found, few, support))
    found = materialize(found.groupBy("g").agg(F.min_by(F.struct(*found.columns[1:]), F.struct("fall", "s")).alias("best")).select("g", "best.*"))
    going, rested = found, []
    while True:  # what falls no more is at rest
        now = concentrate(vectors, going, few, support)
        before = going.select("g", F.struct(*going.columns[1:]).alias("old"))
        both = now.select("g", F.struct(*now.columns[1:]).alias("new")).join(before, "g")
        fell = F.col("old.fall") - F.col("new.fall") > 1e-9
        both = materialize(both.select("g", fell.alias("fell"), F.when(fell, F.col("new")).otherwise(F.col("old")).alias("best")))
        going = both.filter("fell").select("g", "best.*")
        rested.append(both.filter("not fell").select("g", "best.*"))
        if going.isEmpty():
            break
    found = reduce(DataFrame.unionAll, rested)
    raw = concentrate(vectors, found, few, support, consistency(support))
    near = vectors.join(_beside(raw, few), "g").withColumn("d2", _distance()).filter(F.col("d2") <= chi_square_quantile(1 - REWEIGHT))
    return materialize(_moments(near, consistency(REWEIGHT)).drop("s", "fall"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """Counts and verdict of each text: (id, counts..., base_failed, distance, kept).

    distance is the squared Mahalanobis distance to the group's estimate (null for base
    failures); a text is kept up to the chi-square quantile of `tail`. A null or empty
    text has no words and fails. Texts of any length are counted whole. A null language
    or source is a group like any other; groups of fewer than MIN_GROUP passing rows have
    no half to estimate from and use the estimate of all. Texts of equal counts in one
    group have equal distances and verdicts. One row for each input row, repeated ids
    included; other columns are not read, whatever their names.
    """
    stats = materialize(text_stats(docs, id_col, text_col, lang_col, source_col).withColumn("g", F.to_json(F.struct("lang", "source"))))
    passed = stats.filter(~F.col("base_failed")).select("g", *rates())
    own = estimate(passed.unionAll(passed.withColumn("g", F.lit(""))))
    pooled = own.filter("g = ''").drop("g", "n").first()  # one row
    own = own.filter((F.col("g") != "") & (F.col("n") >= MIN_GROUP)).drop("n")
    joined = stats.join(_beside(own, own.count() <= BROADCAST_GROUPS), "g", "left").select(
        "id", *_STATS, "base_failed", *rates(), *[F.coalesce(c, F.lit(pooled[c] if pooled else None).cast("double")).alias(c) for c in own.columns if c != "g"]
    )
    found = joined.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi_square_quantile(tail))
    return found.select(F.col("id").alias(id_col), *_STATS, "base_failed", "distance", kept.alias("kept"))
