"""Quality rules (operator 10): base rules and robust multivariate outliers. DataFrame functions only.

Five statistics of a text are transformed and compared with a minimum-covariance-determinant estimate of
their centre and scatter for the document's language and source:

* the logarithm of the logarithm of its words;
* the mean letters of a word less the language's median of it, shrunk by the root of the words where a text
  has fewer than REFERENCE of them, so that short texts spread no more than others;
* symbols, repeated lines, and repeated words in units of two windows, each scaled down to REFERENCE words
  where a text has more, as twice the root of the count and 3/8. A Poisson count so transformed has variance
  one whatever its mean (Anscombe), so that counting error is added to the estimate's scatter for these
  three: it keeps the estimate regular where most texts have none of something.

Each is rounded to a grid, so equal vectors meet: rows are counted by group and vector before anything is
fitted, and what the fit works on is bounded by the grid, not by the rows.  A group is fitted from many
starts (medians and median deviations; mean and covariance of all; RANDOM_STARTS of six cells each, dealt
by a hash).  A concentration step takes the ceil(share * rows) rows of least distance exactly: equal vectors
have equal distances, so of the last vector as many rows count as are wanted, whichever they are.  After two
steps the KEPT_STARTS of least determinant go on, until no determinant falls by a factor of LEAST_FALL.  Groups with fewer than
`least_rows` usable rows take the estimate of their language, or else of all rows.  A document whose squared
distance lies beyond the chi-square quantile of `tail` is rejected.

Cases: a null text has no words and fails the base rules; null language or source are a group of their
own; repeated rows count each time and are judged alike; an empty table gives an empty result; the
input's other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import SMALL_ROWS, saved, small

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Words of a text to which counts and means are scaled.
REFERENCE = 250
#: Grid of each transformed statistic: values are kept as whole multiples of 1 / GRID.
GRID = (64, 64, 8, 8, 8)
#: Steps of the grid beyond which values are clipped, so that sums of squares of 8 * 10**9 rows fit 64 bits.
MOST = 32767
#: Variance that is added to the scatter: rounding for the first two, counting error for the counts.
ERROR = (1 / (12 * 64**2), 1 / (12 * 64**2), 1.0, 1.0, 1.0)
#: Bins of distance for each factor e, in which the last of the nearest rows are sought.
BINS = 8
P = 5
#: Starts of a group from six of its cells each.
RANDOM_STARTS = 24
#: Starts of least determinant that go on after two steps.
KEPT_STARTS = 8
#: Cells that a task takes at least: sums by group, start and bin are made within tasks first, and shrink little where each has a few cells only. Tables of fits are saved in as many parts as their cells.
CELLS_EACH = 4_000
#: A fit whose log determinant falls by less has converged.
LEAST_FALL = 1e-2


def let(value: Column, body) -> Column:
    """body(value), with value computed once, also where body uses it within another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words in windows of eight words that are found twice or more in the text."""
    zero = F.lit(0).cast("long")

    def covered(s: Column) -> Column:
        n = F.size(s)
        same = lambda k, j: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        marked = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(same(k, k - 1) | same(k, k + 1), F.get(s, k)["i"]))
        begin = F.struct(zero.alias("total"), F.lit(-WINDOW).cast("long").alias("last"))
        step = lambda a, i: F.struct((a["total"] + F.least(F.lit(WINDOW).cast("long"), i - a["last"])).alias("total"), i.alias("last"))
        return F.aggregate(F.array_sort(F.filter(marked, lambda x: x.isNotNull())), begin, step, lambda a: a["total"])

    def of_windows(h: Column) -> Column:
        sorted_ = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(let(sorted_, covered))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(x, i, WINDOW))))
    return F.when(F.size(words) < WINDOW, zero).otherwise(let(windows, of_windows))


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.withColumns({"_words": F.array_remove(F.split(text, SPACES), ""), "_lines": lines, "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long")})
    out = read.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
    }).drop("_words", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def transformed(centre: Column) -> list[Column]:
    """The five statistics on their grids; centre: the language's letters a word."""
    n = F.greatest(F.col("n_words"), F.lit(3)).cast("double")
    most = F.lit(float(REFERENCE))
    few = F.least(F.lit(1.0), most / n)
    count = lambda x: 2 * F.sqrt(x * few + F.lit(0.375))
    letters = (F.col("word_chars") / n - centre) * F.sqrt(F.least(n, most) / most)
    stats = [F.log(F.log(n)), letters, count(F.col("n_symbols")), count(F.col("n_dup_lines")), count(F.col("n_repeat_words") / F.lit(2.0 * WINDOW))]
    return [F.round(F.greatest(F.least(x * g, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long") for x, g in zip(stats, GRID, strict=True)]


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function, by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    i = 1
    while term > total * 1e-16:
        term *= z / (a + i)
        total += term
        i += 1
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(share: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid > 0 and chi2_cdf(mid, k) < share else (lo, mid) if mid > 0 else (mid, hi)
    return hi


def consistency(share: float, k: int) -> float:
    """Factor that makes the scatter of the nearest share of normal rows that of all of them."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
Q = [f"q{i}" for i in range(P)]
SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}{j}" for i, j in PAIRS)]
FIT = [*(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i, j in PAIRS), "logdet"]


def sums(n: Column) -> list[Column]:
    """Exact sums over cells that n rows share each."""
    q = [F.col(c) for c in Q]
    return [F.sum(n).alias("n"), *(F.sum(q[i] * n).alias(f"s{i}") for i in range(P)), *(F.sum(q[i] * q[j] * n).alias(f"s{i}{j}") for i, j in PAIRS)]


def scatter(df: DataFrame, factor: float) -> DataFrame:
    """Centre m and whitening w of the scatter, with its error added, from sums; logdet."""
    n = F.col("n").cast("double")
    df = df.withColumns({f"m{i}": F.col(f"s{i}").cast("double") / n / GRID[i] for i in range(P)})
    moment = lambda i, j: F.col(f"s{i}{j}").cast("double") / n / (GRID[i] * GRID[j]) - F.col(f"m{i}") * F.col(f"m{j}")
    return whitened(df.withColumns({f"c{i}{j}": factor * moment(i, j) + F.lit(ERROR[i] if i == j else 0.0) for i, j in PAIRS}))


def whitened(df: DataFrame) -> DataFrame:
    """df with the inverse w of the Cholesky factor of the scatter c, and the scatter's log determinant."""
    for j in range(P):
        less = lambda i: F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))  # noqa: B023
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(less(j), F.lit(ERROR[j] / 2))))
        if j + 1 < P:
            df = df.withColumns({f"l{i}{j}": less(i) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    for i in range(P):
        below = lambda j: sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))  # noqa: B023
        df = df.withColumns({f"w{i}{j}": (1 if i == j else -below(j)) / F.col(f"l{i}{i}") for j in range(i + 1)})
    return df.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)))


def distance(df: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance d2 of a cell from the fit beside it."""
    apart = [F.col(f"q{i}") / GRID[i] - F.col(f"m{i}") for i in range(P)]
    y = [sum((F.col(f"w{i}{j}") * apart[j] for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return df.withColumn("d2", sum((F.pow(x, F.lit(2.0)) for x in y), F.lit(0.0)))


def first_fits(cells: DataFrame, tasks: int) -> DataFrame:
    """(g, start, rows, FIT): where the concentration steps of each group begin. tasks: see saved."""
    whole = saved(cells.groupBy("g").agg(*sums(F.col("n")), *(F.percentile(c, F.lit(0.5), F.col("n")).alias(f"med{i}") for i, c in enumerate(Q))), tasks)
    apart = lambda i: F.percentile(F.abs(F.col(f"q{i}") - F.col(f"med{i}")), F.lit(0.5), F.col("n"))
    medians = cells.join(small(whole.select("g", *(f"med{i}" for i in range(P)))), "g").groupBy("g").agg(*(apart(i).alias(f"mad{i}") for i in range(P)))
    robust = medians.join(small(whole.select("g", "n", *(f"med{i}" for i in range(P)))), "g").withColumns({f"m{i}": F.col(f"med{i}") / GRID[i] for i in range(P)})
    spread = lambda i: F.pow(1.4826 * F.col(f"mad{i}") / GRID[i], 2) + ERROR[i]
    robust = whitened(robust.withColumns({f"c{i}{j}": spread(i) if i == j else F.lit(0.0) for i, j in PAIRS}))
    dealt = Window.partitionBy("g").orderBy(F.xxhash64("g", *Q), *Q)
    six = cells.withColumn("at", F.row_number().over(dealt)).where(F.col("at") <= RANDOM_STARTS * (P + 1)).withColumn("start", F.expr(f"2 + (at - 1) div {P + 1}"))
    few = scatter(six.groupBy("g", "start").agg(*sums(F.lit(1).cast("long"))), 1.0).join(small(whole.select("g", F.col("n").alias("rows"))), "g")
    named = lambda df, start, rows: df.select("g", start.cast("int").alias("start"), F.col(rows).alias("rows"), *FIT[:-1], F.lit(math.inf).alias("logdet"))
    return named(robust, F.lit(0), "n").union(named(scatter(whole, 1.0), F.lit(1), "n")).union(named(few, F.col("start"), "rows"))


def concentrated(cells: DataFrame, fits: DataFrame, share: float, factor: float, beside: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One concentration step: the fits to the nearest ceil(share * rows) rows of each. beside: how tables of no more rows than the fits are joined."""
    wanted = F.ceil(F.col("rows") * F.lit(share))
    near = distance(cells.join(beside(fits), "g")).withColumn("bin", F.floor(F.log(F.greatest("d2", F.lit(1e-12))) * BINS))
    bins = near.groupBy("g", "start", "bin").agg(F.max("rows").alias("rows"), *sums(F.col("n")))
    upto = F.sum("n").over(Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumn("upto", upto).where(F.col("upto") - F.col("n") < wanted)
    # the last bin is taken in part: its cells in the order of their distances
    last = bins.where(F.col("upto") > wanted).select("g", "start", "bin", (wanted - F.col("upto") + F.col("n")).alias("more"))
    order = Window.partitionBy("g", "start").orderBy("d2", *Q).rowsBetween(Window.unboundedPreceding, -1)
    part = near.join(beside(last), ["g", "start", "bin"]).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    part = part.where("before < more").groupBy("g", "start", "rows").agg(*sums(F.least(F.col("n"), F.col("more") - F.col("before"))))
    core = bins.where(F.col("upto") <= wanted).select("g", "start", "rows", *SUMS).union(part.select("g", "start", "rows", *SUMS))
    return scatter(core.groupBy("g", "start", "rows").agg(*(F.sum(c).alias(c) for c in SUMS)), factor).select("g", "start", "rows", *FIT)


def in_fewer(cells: DataFrame) -> DataFrame:
    """Saved cells in no more partitions than have CELLS_EACH of them on average; nothing is shuffled."""
    return cells.coalesce(max(1, -(-cells.count() // CELLS_EACH)))


def fit_groups(cells: DataFrame, share: float, most_steps: int) -> DataFrame:
    """Fits by group of cells (g, q0 .., n rows): g, rows, centre, factor and logdet."""
    factor = consistency(share, P)
    tasks = -(-cells.count() // CELLS_EACH)
    fits = saved(first_fits(cells, tasks), tasks)
    beside = F.broadcast if fits.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else lambda df: df
    for step in range(most_steps):
        new = concentrated(cells, fits, share, factor, beside)
        both = new.join(beside(fits.select("g", "start", F.struct(*FIT).alias("old"))), ["g", "start"]).withColumn("fell", F.col("logdet") < F.col("old.logdet") - LEAST_FALL)
        both = both.select("g", "start", "rows", *(F.when(F.col("fell"), F.col(c)).otherwise(F.col(f"old.{c}")).alias(c) for c in FIT), "fell")
        if step == 1:
            both = both.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("logdet", "start"))).where(F.col("place") <= KEPT_STARTS).drop("place")
        both = saved(both, tasks)
        fits = both.drop("fell")
        if not both.where("fell").limit(1).count():
            break
    best = fits.groupBy("g").agg(F.min_by(F.struct("rows", *FIT), F.struct("logdet", "start")).alias("f"))
    return best.select("g", "f.*")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, tail: float = 1e-5, least_rows: int = 60, most_steps: int = 20) -> DataFrame:
    """Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and d2 (null if the base rules failed).

    tail: the share of normal statistics that lie beyond the distance at which a document is rejected.
    most_steps bounds the concentration steps.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("-")).alias("lang"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")).alias("source"))
    stats = saved(base_statistics(rows).drop("text"))
    letters = F.round(F.col("word_chars") / F.greatest("n_words", F.lit(1)) * GRID[1]).cast("long")
    typical = stats.where("NOT base_failed").rollup("lang").agg(F.percentile(letters, F.lit(0.5)).alias("centre"), F.count(F.lit(1)).alias("own"))
    typical = saved(typical.withColumn("lang", F.coalesce("lang", F.lit("*"))), 1)
    overall, usable = (x or 0 for x in typical.where("lang = '*'").agg(F.max("centre"), F.max("own")).first())
    centres = typical.where(f"lang <> '*' AND own >= {least_rows}").select("lang", (F.col("centre") / GRID[1]).alias("centre"))
    stats = stats.join(small(centres), "lang", "left")
    stats = stats.withColumns(dict(zip(Q, transformed(F.coalesce("centre", F.lit(overall / GRID[1]))), strict=True))).drop("centre")
    name = [F.lit("*"), F.concat(F.lit("l"), "lang"), F.concat(F.lit("s"), F.length("lang").cast("string"), "lang", "source")]
    finest = stats.where("NOT base_failed").groupBy("lang", "source", *Q).agg(F.count(F.lit(1)).alias("n"))
    cells = finest.select(F.explode(F.array(*name)).alias("g"), *Q, "n").groupBy("g", *Q).agg(F.sum("n").alias("n"))
    cells = saved(cells, -(-len(name) * usable // CELLS_EACH))
    fits = saved(fit_groups(in_fewer(cells), share, most_steps), 1)
    # The estimate that a language and source use: their own, the language's or that of all rows.
    pairs = stats.where("NOT base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("own"))
    named = pairs.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(i).alias("level"), g.alias("g")) for i, g in enumerate(name)))).alias("x")).select("lang", "source", "x.*")
    able = named.join(small(fits), "g").where((F.col("rows") >= least_rows) | (F.col("level") == 0))
    chosen = saved(able.groupBy("lang", "source").agg(F.max_by(F.struct(*FIT), "level").alias("f")).select("lang", "source", "f.*"), 1)
    out = distance(stats.join(small(chosen), ["lang", "source"], "left"))
    cutoff = chi2_quantile(1 - tail, P)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(False))).alias("kept"), F.when(~F.col("base_failed"), F.round("d2", 6)).alias("d2"))


def accepted(docs: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of docs that are kept. Rows of one id are judged together: any rejection rejects the id; null ids are judged by nothing but stay."""
    out = judge(docs, id_col=id_col, **more).where(~F.col("kept")).select(id_col).distinct()
    return docs.join(out, id_col, "left_anti")
