"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

A document is described by whole-number signals, of which more means worse: symbols, capitals, punctuation, repeats, unusual word lengths. A
rule rejects a document whose signal is above a cutoff. The cutoffs of all rules move together, level by level: from beyond every good
document to a share of the good documents that each rule may reject on its own. Labels are dealt into a fit half, which gives the cutoffs of each level,
and a holdout half, which says how many good documents the rules reject together at that level.

For each stratum the levels are tested from the mildest on: the exact binomial tail of the holdout's false rejections, under the hypothesis that more than
``alpha`` of the good documents are rejected, has to be at most ``delta`` over the number of strata. Testing stops at the first level that fails
(a fixed sequence, which needs no correction within a stratum; Bonferroni corrects for the strata). So with probability 1 - ``delta`` no
stratum loses more than ``alpha`` of its good documents. Among the levels that pass, the fit half chooses the one that
tells good from bad best; a stratum with too few labels for any level rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.llm.common import WORD, stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: The mildest levels: cutoffs beyond every good document of the fit half, by so many times the way from their median to their greatest signal.
MARGINS = (1.0, 0.25)

#: The levels after those: share of the good documents that a rule may reject on its own.
SHARES = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02)
LEVELS = len(MARGINS) + len(SHARES)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SIGNALS = ("symbols", "dup_lines", "repeats", "capitals", "punctuation", "long_words", "short_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(places: Column, width: int) -> Column:
    """How many places windows of ``width`` that begin at the sorted ``places`` cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda at, place: F.struct((at["n"] + place + width - F.greatest(place, at["end"])).alias("n"), (place + width).alias("end"))
    return F.aggregate(places, start, step, lambda at: at["n"])


def _repeated(words: Column, width: int) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more. Windows are compared by a 64-bit hash, within one text."""

    def twins(ranked: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ranked, k)["hash"] == x["hash"], F.lit(False))
        return F.filter(ranked, lambda x, k: ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))) | same(x, k + 1))

    def count(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))
        places = _let(ranked, lambda r: F.sort_array(F.transform(twins(r), lambda x: x["place"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(places, width))

    def windows(hashes: Column) -> Column:
        ahead = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, width)]))
        return F.slice(ahead, F.lit(1), F.size(hashes) - (width - 1))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(_let(_let(hashed, windows), count))


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), width: int = 5) -> DataFrame:
    """The columns ``keep``, the base counts (long) and the signals (long), one row for each row of ``docs``.

    n_words: words, that is runs of other characters than white space. word_chars: their code points. n_symbols: characters of ``#*$%&|<>``. n_dup_lines:
    lines with a word that equal an earlier line. n_repeat_words: words in windows of ``width`` words found twice or more in the text, the first
    included. A null text counts as empty. Signals are in thousandths of the word characters, lines or words; word lengths in hundredths.
    Everything is computed within the row, in time n log n of the text; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    letters = lambda w: F.aggregate(w, F.lit(0), lambda n, word: n + F.length(word))
    facts = [
        _let(words, lambda w: F.struct(F.size(w).alias("n_words"), letters(w).alias("word_chars"), _repeated(w, width).alias("n_repeat_words"))).alias("words"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOL)).alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_capitals"),
        F.regexp_count(text, F.lit(r"\p{P}")).alias("n_punctuation"),
    ]
    counts = docs.select(*keep, *facts).select(*keep, "words.*", "lines.*", "n_symbols", "n_capitals", "n_punctuation")
    share = lambda n, of, unit=1000: F.when(F.col(of) > 0, F.floor(F.col(n) * F.lit(unit).cast("long") / F.col(of))).otherwise(F.lit(0))
    signals = {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "punctuation": share("n_punctuation", "word_chars"),
        "long_words": share("word_chars", "n_words", 100),
        "short_words": -share("word_chars", "n_words", 100),
    }
    return counts.select(*keep, *[F.col(c).cast("long").alias(c) for c in BASE], *[signals[c].cast("long").alias(c) for c in SIGNALS])


def base_failed() -> Column:
    """The fixed rules: too few words, or more than a fifth of them repeated."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


# --- binomial bound -------------------------------------------------------------------------------


def _log_factorial(n: Column) -> Column:
    """log n!, by Stirling's series nine places up, exact to about 12 digits."""
    x = n + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    ahead = F.log(n + 1.0)
    for i in range(2, 9):
        ahead = ahead + F.log(n + float(i))
    return series - ahead


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """The probability of at most ``k`` of ``n`` with chance ``p`` each; 1 for k at or above the mean, where no test passes.

    Terms are added from the k-th down. Below the mean they fall, and those more than 12 deviations away are below 1e-30 of the first.
    """
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    reach = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 60).cast("int")
    ratio = lambda j: (k - j + 1.0) * (1 - p) / ((n - k + j) * p)
    step = lambda at, j: F.struct((at["term"] * ratio(j)).alias("term"), (at["sum"] + at["term"] * ratio(j)).alias("sum"))
    terms = F.when(reach > 0, F.sequence(F.lit(1), reach)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step, lambda at: at["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


# --- cutoffs --------------------------------------------------------------------------------------


def _stratum(name: str) -> Column:
    """The stratum as a text without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _cutoffs(good: DataFrame) -> DataFrame:
    """For each stratum the cutoffs of each signal, by level: beyond the greatest value of ``good``, then the least value that at most a share of ``good`` exceeds.

    Values are counted before they are ranked, so a stratum of any size is ranked as at most one row for each value.
    """
    values = good.select("stratum", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in SIGNALS])).alias("x")).select("stratum", "x.*")
    counted = values.groupBy("stratum", "signal", "value").agg(F.count("*").alias("n"))
    signal = Window.partitionBy("stratum", "signal")
    above = F.coalesce(F.sum("n").over(signal.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.select("stratum", "signal", "value", above.alias("above"), F.sum("n").over(signal).alias("all"))
    exceeded = lambda share: F.min(F.when(F.col("above") <= F.col("all") * share, F.col("value")))
    beyond = [(exceeded(0.0) + F.ceil(m * (exceeded(0.0) - exceeded(0.5)))).cast("long") for m in MARGINS]
    at = ranked.groupBy("stratum", "signal").agg(F.array(*beyond, *map(exceeded, SHARES)).alias("cutoffs"))
    return at.groupBy("stratum").agg(*[F.max(F.when(F.col("signal") == s, F.col("cutoffs"))).alias(f"at_{s}") for s in SIGNALS])


def _level() -> Column:
    """The mildest level, from 0, at which any rule rejects the row; LEVELS if none does."""
    rejected = lambda i: F.exists(F.array(*[F.struct(F.col(s).alias("v"), F.col(f"at_{s}").alias("c")) for s in SIGNALS]), lambda x: x["v"] > F.get(x["c"], F.lit(i)))
    level = F.lit(LEVELS)
    for i in reversed(range(LEVELS)):
        level = F.when(rejected(i), F.lit(i)).otherwise(level)
    return level


def thresholds(facts: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, cost: float = 5.0) -> DataFrame:
    """For each stratum with a level that may be used: stratum, level, n_good, n_lost (of the holdout), tail, and a cutoff column at_<signal> for each signal.

    ``facts`` are :func:`measures` with doc_id and the stratum, ``labels`` have doc_id and quality (1 good, 0 bad). Labelled documents that fail the
    fixed rules take no part. A document with several labels is good if all are; null labels and null numbers are left out. Documents
    are dealt to the halves by a hash of doc_id. All labels are used. Among the levels that pass, the share of bad documents rejected less ``cost`` times that of good ones decides, ties to the mildest.
    """
    judged = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    rows = facts.where(~base_failed()).join(judged, F.col("doc_id") == F.col("label_id"))
    fit = F.md5(F.col("label_id").cast("string")) < "8"
    rows = stored(rows.select(_stratum(stratum).alias("stratum"), (F.col("quality") > 0).alias("good"), fit.alias("fit"), *SIGNALS), "labelled")
    cutoffs = _cutoffs(rows.where("good and fit"))
    met = rows.join(cutoffs, "stratum").groupBy("stratum", "good", "fit", _level().alias("level")).agg(F.count("*").alias("n"))
    share = lambda good, fit: F.sum(F.when((F.col("good") == good) & (F.col("fit") == fit), F.col("n")).otherwise(F.lit(0)))
    counts = met.groupBy("stratum", "level").agg(share(True, False).alias("lost"), share(True, True).alias("fit_good"), share(False, True).alias("fit_bad"))
    every = counts.select("stratum").distinct().select("stratum", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    counts = every.join(counts, ["stratum", "level"], "left").na.fill(0)
    of = Window.partitionBy("stratum")
    upto = of.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strata = F.size(F.collect_set("stratum").over(Window.partitionBy(F.lit(0))))
    rejected = lambda c: F.coalesce(F.sum(c).over(upto) / F.nullif(F.sum(c).over(of), F.lit(0)), F.lit(0.0))
    gain = rejected("fit_bad") - cost * rejected("fit_good")
    tested = counts.select("stratum", "level", F.sum("lost").over(upto).alias("n_lost"), F.sum("lost").over(of).alias("n_good"), gain.alias("gain"), strata.alias("strata")).where(F.col("level") < LEVELS)
    tested = tested.withColumn("tail", binomial_tail(F.col("n_good"), F.col("n_lost"), alpha))
    passed = F.max(F.when(F.col("tail") > F.lit(delta) / F.col("strata"), 1).otherwise(0)).over(upto) == 0
    best = Window.partitionBy("stratum").orderBy(F.desc("gain"), "level")
    usable = tested.withColumn("passed", passed).where("passed and gain > 0").withColumn("k", F.row_number().over(best)).where("k = 1")
    cut = [F.get(f"at_{s}", F.col("level")).alias(f"at_{s}") for s in SIGNALS]
    return usable.join(cutoffs, "stratum").select("stratum", "level", "n_good", "n_lost", "tail", *cut)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Columns doc_id, the stratum, the base counts, base_failed, the signals, rejected_by (names of the rules that reject) and kept; one row for each row of ``docs``.

    A document is kept if it passes the fixed rules and no rule's signal is above the cutoff of its stratum. Null texts are empty
    and fail; a null stratum is a stratum of its own; rows with a null doc_id are judged but never fitted on; repeated rows get equal
    results. Without labels only the fixed rules reject. An empty table gives an empty result. Columns other than doc_id, text and the stratum are not read.
    """
    facts = stored(measures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum_name"), "text"), ("doc_id", "stratum_name")), "measures")
    cutoffs = stored(thresholds(facts, labels, "stratum_name", alpha, delta), "thresholds").withColumnRenamed("stratum", "of")
    rows = facts.join(cutoffs, _stratum("stratum_name") == F.col("of"), "left")
    rejects = F.array_compact(F.array(*[F.when(F.col(s) > F.col(f"at_{s}"), F.lit(s)) for s in SIGNALS]))
    rows = rows.withColumn("rejected_by", F.array_join(rejects, ",")).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("rejected_by") == "")
    return rows.select("doc_id", F.col("stratum_name").alias(stratum), *BASE, "base_failed", *SIGNALS, "rejected_by", kept.alias("kept"))
