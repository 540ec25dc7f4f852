"""URL filters: allow and block rules, then naive Bayes over segmented host and path tokens.

A host is cut into words by unigram Viterbi: of all ways to split its letter runs, the
one of highest probability under the word counts of the pages' own texts. Multinomial
naive Bayes over the words of host and path, hashed into a table of fixed size, learns
from the pages that the rules decide (and from hosts with a seed word, if any are given),
and judges the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readroute.llm.common import materialize, pick

#: (verdict, host and path): a rule holds for the host and all below it.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Words that may be given as `seeds`: they make a host a block example where no rule decides.
SEEDS = ("spam", "casino", "pills", "bets", "adult", "ads")
#: Longest known word that segmentation looks up, in letters: a label of a host name has no more (fixed by DNS).
LONGEST = 63
#: Buckets of hashed tokens: bounds what is collected and broadcast.
BUCKETS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEN = math.log(10)
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for null or without `://`."""
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        top, slash, rest = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(judged)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, n) over the visible text (column html) of all pages, lower-cased."""
    words = F.split(F.lower(F.regexp_replace("html", "<[^>]*>", " ")), r"[^\p{L}]+")
    return pages.select(F.explode(words).alias("word")).filter((F.col("word") != "") & (F.length("word") <= longest)).groupBy("word").agg(F.count("*").alias("n"))


def segment(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of a letter run.

    An unknown word of any length costs tenfold for each letter. Of equal splits the one
    whose last word is longest counts, then of the rest likewise.
    """
    sizes = sorted({len(w) for w in counts}, reverse=True)
    best: list[tuple[float, int]] = [(0.0, 0)]
    unknown, since = 0.0, 0  # the best start of an unknown word, by value plus its letters' cost
    for end in range(1, len(run) + 1):
        found = (unknown - end * _TEN + math.log(1 / total), since)
        for size in sizes:
            if size <= end and (n := counts.get(run[end - size : end])):
                p = best[end - size][0] + math.log(n / total)
                if p > found[0] or p == found[0] and end - size < found[1]:
                    found = (p, end - size)
        best.append(found)
        if found[0] + end * _TEN > unknown:
            unknown, since = found[0] + end * _TEN, end
    words, end = [], len(run)
    while end:
        words.append(run[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def run_words(runs: DataFrame, counts: DataFrame, total: int, longest: int = LONGEST) -> DataFrame:
    """(run, words): distinct letter runs with the words they split into.

    Each run meets the counts of its own substrings only, so the vocabulary is joined,
    never broadcast; a run that many hosts have is split once.
    """
    n = F.length("run")
    at = runs.select("run", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    parts = at.select("run", "s", F.explode(F.sequence(F.lit(1), F.least(n - F.col("s") + 1, F.lit(longest)))).alias("k"))
    known = parts.select("run", F.substring("run", F.col("s"), F.col("k")).alias("word")).join(counts, "word").groupBy("run").agg(F.collect_set(F.struct("word", "n")).alias("known"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own = [{x["word"]: x["n"] for x in found} if found is not None else {} for found in rows["known"]]
            yield pd.DataFrame({"run": rows["run"], "words": [segment(run, found, total) for run, found in zip(rows["run"], own, strict=True)]})

    return runs.join(known, "run", "left").mapInPandas(split, "run string, words array<string>")


def host_words(hosts: DataFrame, counts: DataFrame, total: int, longest: int = LONGEST) -> DataFrame:
    """(host, words): distinct hosts with the words of their letter runs, in order."""
    runs = F.filter(F.split("host", r"[^\p{L}]+"), lambda x: x != "")
    placed = hosts.select("host", F.posexplode(runs).alias("pos", "run"))
    split = run_words(placed.select("run").distinct(), counts, total, longest)
    whole = placed.join(split, "run").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"))
    return hosts.join(whole, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def bayes(examples: DataFrame) -> np.ndarray:
    """Log odds of block for each bucket, and last those of the classes, from (block, tokens) rows."""
    hashed = examples.select("block", F.explode("tokens").alias("bucket")).groupBy("bucket", "block").agg(F.count("*").alias("n"))
    n = np.zeros((2, BUCKETS))
    for r in hashed.collect():  # at most two rows for each bucket
        n[int(r["block"]), r["bucket"]] = r["n"]
    rows = {r["block"]: r["n"] for r in examples.groupBy("block").agg(F.count("*").alias("n")).collect()}
    seen = n.sum(0) > 0
    if not rows.get(True) or not rows.get(False):
        return np.append(np.zeros(BUCKETS), (1.0 if rows.get(True) else -1.0))
    odds = np.log((n[1] + 1) / (n[1].sum() + seen.sum())) - np.log((n[0] + 1) / (n[0].sum() + seen.sum()))
    odds[~seen] = 0
    return np.append(odds, math.log(rows[True] / rows[False]))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = (), id_col: str = "page_id", url_col: str = "url", html_col: str = "html", longest: int = LONGEST) -> DataFrame:
    """(id, host, path, rule, verdict, score, host_words) of each page.

    score is naive Bayes' log odds of block; the verdict is the rule's if one fits,
    else block above 0. A null url or one without `://` has no host, path or token.
    Null html has no words; urls and html of any length are read whole. Without examples
    of both classes the verdict is that of the class there is, else allow; at odds of 0 it
    is allow. `seeds` make block examples of hosts that no rule decides; `longest` is the
    most letters of a known word in a host. One row for each input row, repeated ids
    included; other columns are not read, whatever their names.
    """
    host, path = url_parts(F.col("url"))
    read = pick(pages, id=id_col, url=url_col, html=html_col)
    picked = read.select("id", host.alias("host"), path.alias("path"))
    counts = word_counts(read.select("html"), longest)
    spark = pages.sparkSession
    known = materialize(counts.unionByName(spark.createDataFrame([(w, 1) for w in seeds], "word string, n long")).groupBy("word").agg(F.sum("n").alias("n")))
    total = known.agg(F.sum("n")).first()[0] or 1
    words = materialize(host_words(picked.select("host").distinct(), known, total, longest))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    path_words = F.filter(F.split(F.lower(F.regexp_replace("path", r"\p{N}+", " 0 ")), r"[^\p{L}0]+"), lambda x: x != "")
    tokens = F.concat(F.transform("words", lambda x: F.concat(F.lit("h "), x)), F.transform(path_words, lambda x: F.concat(F.lit("p "), x)))
    full = picked.join(words, "host", "left").select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "words", F.transform(tokens, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")).alias("tokens"))
    seeded = F.arrays_overlap("words", F.array(*[F.lit(w) for w in seeds])) if seeds else F.lit(False)
    label = F.coalesce(F.col("ruled") == "block", F.when(seeded, F.lit(True)))
    shared = spark.sparkContext.broadcast(bayes(full.select(label.alias("block"), "tokens").filter("block is not null")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = shared.value
        for batch in batches:
            lists = batch.column(6)
            bounds = np.asarray(lists.offsets)
            sums = np.append(0.0, np.cumsum(odds[np.asarray(lists.values)[bounds[0] : bounds[-1]]])) if len(lists) else np.zeros(1)
            score = odds[-1] + sums[bounds[1:] - bounds[0]] - sums[bounds[:-1] - bounds[0]]
            judged = pa.compute.coalesce(batch.column(4), pa.array(np.where(score > 0, "block", "allow"), pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], judged, pa.array(score), batch.column(5)], names=["id", "host", "path", "rule", "verdict", "score", "host_words"])

    kind = picked.schema["id"].dataType.simpleString()
    found = full.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, score double, host_words array<string>")
    return found.withColumnRenamed("id", id_col)
