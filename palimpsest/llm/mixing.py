"""Mixing sources to target weights by soft domain membership, in DataFrame functions alone.

Domains come from the labelled table: ``good`` (quality 1), ``poor`` (quality 0) and ``toxic``. A
classifier fitted on a bounded sample of labelled rows predicts for every document its posteriors
p_d. It is a linear discriminant over shares of characters and words: class means and one pooled
covariance, both sums of a single aggregation. A document of t tokens (words between white space and
ASCII punctuation) then counts t p_d towards domain d, and nonnegative rates r, how often a document is used, are fitted so that the
expected totals, the sums of r t p_d, match the targets. The least-squares problem is solved by
projected gradient steps from r = 1, in the metric in which every token counts alike (a document's
gradient t (p . residual) is divided by its t, so that long documents aren't repeated in place of
many short ones) and scaled by the inverse Gram matrix of the rows whose rate isn't held at 0:
r <- max(0, r - p . v), with v the scaled residual. A step is one distributed aggregation of as
many numbers as there are domains; rates stay an expression over the steps' vectors. Steps end when
the targets are met, or when they bring the totals no nearer: then the rates are the nearest, and the
residual is returned with them. Steps that do neither raise an error.

Defined results: a null or empty text has no tokens, its features are 0 and its rate stays 1;
repeated rows each have a rate; without labels of a class that class has no mass, and targets are
scaled over the classes that have; an empty table gives none; further columns pass through, but for
those that are called like the results (``tokens``, ``p_<domain>``, ``rate``), which these replace. Rows of
labels with nulls don't count, and several labels of a document make it toxic, poor or good, in
that order. Characters U+0001 to U+0003 of a text, which stand for classes of characters here, count
towards its length alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, settle, table

DOMAINS = ("good", "poor", "toxic")
#: Shares of the tokens that the mixture shall have.
TARGETS = {"good": 0.90, "poor": 0.09, "toxic": 0.01}
#: Labelled rows that the classifier is fitted on, at most; they bound the words that tell toxic texts.
LABELLED = 20_000
#: Steps after which rates that still change are an error.
ROUNDS = 200
FEATURES = ("f_mark", "f_upper", "f_digit", "f_line", "f_toxic")
#: Characters of mark-up and noise.
MARKS = "|!%$&*#"


_SPLIT = "\t\n\x0b\f\r" + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _words(text: Column) -> Column:
    """Lower-case words between white space and punctuation, with empty ones among them."""
    return F.split(F.translate(F.lower(text), _SPLIT, " " * len(_SPLIT)), " ")


def _features(text: Column, toxic: list[str]) -> dict[str, Column]:
    chars = F.greatest(F.length(text), F.lit(1))
    # one pass turns each class of characters into one character, whose share is then cheap to take
    sets = {"\x01": MARKS, "\x02": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\x03": "0123456789"}
    classed = F.translate(text, "".join(sets.values()) + "".join(sets), "".join(k * len(v) for k, v in sets.items()))

    def count(of: Column, c: str) -> Column:
        return F.length(of) - F.length(F.replace(of, F.lit(c), F.lit("")))

    def found(words: Column) -> Column:
        return F.size(F.array_distinct(F.filter(words, lambda w: w.isin(*toxic)))) if toxic else F.lit(0)

    return {
        "classed": classed,
        "f_mark": lambda x, w: F.sqrt(count(x, "\x01") / chars),
        "f_upper": lambda x, w: F.sqrt(count(x, "\x02") / chars),
        "f_digit": lambda x, w: F.sqrt(count(x, "\x03") / chars),
        "f_line": F.sqrt(count(text, "\n") / chars),
        "f_toxic": lambda x, w: F.least(found(w) / F.lit(3.0), F.lit(1.0)),
        "tokens": lambda x, w: F.size(F.array_remove(w, "")),
    }


def _feature_row(text: Column, toxic: list[str]) -> Column:
    """An array of one struct of the features."""
    f = _features(text, toxic)
    classed = f.pop("classed")
    both = F.array(F.struct(classed.alias("classed"), _words(text).alias("words")))
    return F.transform(both, lambda x: F.struct(*[(c(x["classed"], x["words"]) if callable(c) else c).cast("double").alias(k) for k, c in f.items()]))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(t, y): texts of the bounded sample of labelled rows and their domain's number."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    y = F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).otherwise(1)
    few = known.select(F.col("doc_id").cast("long").alias("_id"), y.alias("y")).orderBy(F.xxhash64("_id"), "_id", "y").limit(LABELLED)
    few = few.groupBy("_id").agg(F.max("y").alias("y"))
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(few), "_id").select("t", "y")


def toxic_words(sample: DataFrame) -> list[str]:
    """The words that occur in toxic texts of the sample far beyond their share of others."""
    n = {r["y"]: r["n"] for r in sample.groupBy((F.col("y") == 2).alias("y")).agg(F.count("*").alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return []
    each = sample.select((F.col("y") == 2).alias("y"), F.explode(F.array_distinct(_words(F.col("t")))).alias("w")).where("w <> ''")
    by = each.groupBy("w").agg(F.count_if("y").alias("a"), F.count_if(~F.col("y")).alias("b"))
    odd = by.where((F.col("a") >= 3) & (F.col("a") * n[False] > 8 * F.col("b") * n[True]))
    return [r["w"] for r in odd.orderBy("w").select("w").collect()]


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination with pivoting, for a handful of unknowns."""
    n = len(b)
    m = [[*row, y] for row, y in zip(a, b, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(n):
            if r != i:
                k = m[r][i] / m[i][i]
                m[r] = [x - k * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][n] / m[i][i] for i in range(n)]


def fit_classifier(sample: DataFrame, toxic: list[str]) -> dict[str, tuple[float, dict[str, float]]]:
    """For each domain that has rows, the constant and weights of its log-posterior."""
    f = list(FEATURES)
    rows = sample.select("y", F.inline(_feature_row(F.col("t"), toxic)))
    sums = rows.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in f], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(f) for b in f[i:]]).collect()
    total = sum(r["n"] for r in sums)
    means = {r["y"]: [r[c] / r["n"] for c in f] for r in sums}
    cov = [[sum(r[f"{f[min(i, j)]}_{f[max(i, j)]}"] - r["n"] * means[r["y"]][i] * means[r["y"]][j] for r in sums) / max(1, total) for j in range(len(f))] for i in range(len(f))]
    for i in range(len(f)):
        cov[i][i] += 1e-4
    out = {}
    for r in sums:
        w = _solve(cov, means[r["y"]])
        out[DOMAINS[r["y"]]] = (math.log(r["n"] / total) - sum(x * m for x, m in zip(w, means[r["y"]], strict=True)) / 2, dict(zip(f, w, strict=True)))
    return out


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` and the columns ``p_<domain>``, which sum to 1."""
    sample = settle(_sample(docs, labels, id_col, text_col))
    toxic = toxic_words(sample)
    model = fit_classifier(sample, toxic)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # each step is bound once, so that a filter on the outcome doesn't repeat the features below it
    features = _feature_row(text, toxic)

    def logs(x):
        one = {d: F.lit(c) + sum((F.lit(w) * x[k] for k, w in ws.items()), F.lit(0.0)) for d, (c, ws) in model.items()} or {DOMAINS[0]: F.lit(0.0)}
        return F.struct(x["tokens"].alias("tokens"), *[one.get(d, F.lit(float("-inf"))).alias(d) for d in DOMAINS])

    def shares(x):
        powers = {d: F.exp(x[d] - F.greatest(*[x[e] for e in DOMAINS])) for d in DOMAINS}
        return F.struct(x["tokens"].alias("tokens"), *[(powers[d] / sum(powers.values(), F.lit(0.0))).alias(f"p_{d}") for d in DOMAINS])

    bound = F.element_at(F.transform(F.transform(features, logs), shares), 1)
    own = {"tokens", *(f"p_{d}" for d in DOMAINS)}
    kept = [x for c, x in zip(docs.columns, columns_of(docs), strict=True) if c not in own]
    return docs.select(*kept, bound.alias("_m")).select(*kept, "_m.*")


def rate(steps: list[list[float]]) -> Column:
    """The rate of a row after the steps, folded over their vectors so that the expression stays small."""
    if not steps:
        return F.lit(1.0)
    row = F.array(F.struct(*[F.col(f"p_{d}").alias(d) for d in DOMAINS]))
    vectors = F.array(*[F.struct(*[F.lit(float(x)).alias(d) for x, d in zip(v, DOMAINS, strict=True)]) for v in steps])

    def fold(x):
        return F.aggregate(vectors, F.lit(1.0), lambda r, v: F.greatest(F.lit(0.0), r - sum((v[d] * x[d] for d in DOMAINS), F.lit(0.0))))

    return F.element_at(F.transform(row, fold), 1)


#: Times its own tokens that the spared domain has at least.
SPARE = 1.02
#: Tokens are counted in units of this in the steps, which keeps the numbers near 1.
SCALE = 1000.0


@dataclass
class Rates:
    """The steps' vectors, and how far each domain's total stays from its target, in shares of the budget."""

    steps: list[list[float]] = field(default_factory=list)
    residual: dict[str, float] = field(default_factory=dict)


def fit_rates(members: DataFrame, targets: dict[str, float] | None = None, rounds: int = ROUNDS, close: float = 1e-6, spare: str | None = "good") -> Rates:
    """The rates of rows (tokens, p_<domain>), as steps, with the residual.

    The budget is the corpus's own tokens, and more where domain ``spare`` would else lose any.
    """
    targets = targets or TARGETS
    w = [F.col("tokens") / F.lit(SCALE) * F.col(f"p_{d}") for d in DOMAINS]
    n = len(DOMAINS)
    scale = [(f"g{i}_{j}", w[i] * F.col(f"p_{DOMAINS[j]}")) for i in range(n) for j in range(i, n)]
    g = members.agg(*[F.sum(x).alias(f"t{i}") for i, x in enumerate(w)], *[F.sum(x).alias(k) for k, x in scale]).first()
    have = [g[f"t{i}"] or 0.0 for i in range(n)]
    live = [i for i in range(n) if have[i] > 1e-9 * max(1e-300, sum(have)) and targets.get(DOMAINS[i], 0) > 0]
    if not live:
        return Rates()
    share = {i: targets[DOMAINS[i]] / sum(targets[DOMAINS[j]] for j in live) for i in live}
    budget = sum(have[i] for i in live)
    if spare in DOMAINS and (s := DOMAINS.index(spare)) in live:
        budget = max(budget, SPARE * have[s] / share[s])
    want = [share.get(i, 0.0) * budget if i in live else have[i] for i in range(n)]
    steps: list[list[float]] = []
    now, gram = have, g
    best, idle = Rates(), 0
    nearest = math.inf
    for _ in range(rounds):
        short = [now[i] - want[i] for i in live]
        far = math.hypot(*short)
        idle = 0 if far < nearest * (1 - 1e-4) else idle + 1
        if far < nearest:
            nearest, best = far, Rates(list(steps), {DOMAINS[i]: x / budget for i, x in zip(live, short, strict=True)})
        if far <= close * budget or idle == 6:
            return best
        # the Gram matrix of the rows that aren't held at 0
        least = 1e-9 * max(1e-300, *(g[f"g{k}_{k}"] for k in live))
        m = [[(gram[f"g{min(i, j)}_{max(i, j)}"] or 0.0) + (least if i == j else 0.0) for j in live] for i in live]
        v = dict(zip(live, _solve(m, short), strict=True))
        steps.append([v.get(i, 0.0) for i in range(n)])
        at = members.withColumn("_r", rate(steps))
        gram = at.agg(*[F.sum(F.col("_r") * x).alias(f"t{i}") for i, x in enumerate(w)], *[F.sum(F.when(F.col("_r") > 0, x)).alias(k) for k, x in scale]).first()
        now = [gram[f"t{i}"] or 0.0 for i in range(n)]
    raise RuntimeError(f"rates still change after {rounds} steps")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``tokens``, ``p_<domain>`` and ``rate``; the text itself is read but once."""
    members = settle(posteriors(docs, labels, id_col, text_col).drop(text_col))
    return members.withColumn("rate", rate(fit_rates(members, targets).steps))


def resampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its rate says: the whole part, and once more with the
    chance of the rest, drawn from a hash of the row."""
    rows = docs.select(F.struct(*columns_of(docs)).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # settled with the rows, so that texts are read for their features but once
    with_p = settle(posteriors(rows, labels, "_id", "_text").drop("_text"))
    drawn = F.pmod(F.xxhash64(F.lit("mix"), "_id", F.col(f"_row.{text_col}")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(rate(fit_rates(with_p, targets).steps) + drawn).cast("int")
    return with_p.withColumn("_c", F.explode(F.array_repeat(F.lit(1), times))).select("_row.*")


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs, table(spark, sf_dir, "labels"))
