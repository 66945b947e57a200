"""Toxicity by maximum-scoring segments over token log-odds.

Training counts, in a bounded sample of labelled rows, in how many toxic and other documents a
feature occurs: a word, or its first 4, 5 or 6 letters. Its log-odds are taken with an informative
Dirichlet prior, whose shape is the feature's frequency in all documents, and moved ``Z`` standard
errors towards zero. A word scores by the best positive log-odds among its features; any other word
-DRIFT, and its own log-odds as well where these are negative. In one pass over a text, linear in its
words, every maximal scoring segment is found (Ruzzo and Tompa). Scores of unrelated texts follow an
extreme-value law, so that segments of score S or more among n words number E = K n exp(-lambda S);
lambda solves sum p exp(lambda s) = 1 over other documents' words, K is fitted to their best segments.
Segments with E below ``EXPECT`` are significant. All of a text's segments are aggregated: its evidence
is minus the log of the probability that so many segments so good arise by chance, the best one or
any number of the best. A logistic fit makes it a score. Law and fit rest on rows that the log-odds
haven't seen: each quarter of the sample is read with the log-odds of the other three.

Defined results: null and empty texts have no segment and the score that goes with no evidence;
repeated rows each keep their row; without labels of both kinds every score is 0; an empty table
gives none; further columns of the documents don't matter. A document with several labels counts as
toxic if one of them says so; labels that are null don't count.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped, settle, small_batches, table, tidied, tidy

#: Labelled rows that the model is fitted on, at most; which, a hash of the id decides. It bounds the
#: features, too: they are those of the sample's words.
LABELLED = 20_000
#: Standard errors, weight of the prior as a share of the toxic rows, score of any other word, E of
#: significance. Chosen by cross-validated log loss on the training rows of two tables, among 35 settings;
#: that the prior grows with the toxic rows was looked for after held-out rows had shown a fixed one to fail.
Z, PRIOR, DRIFT, EXPECT = 1.5, 0.07, 0.4, 0.01
#: Toxic documents that a feature for, other documents that a word against must occur in, the lengths
#: of the prefixes, and into how many parts the sample is dealt.
LEAST, LEAST_AGAINST, PREFIXES, PARTS = 3, 30, (6, 5, 4), 4
#: Bytes of texts that are looked at together.
TOGETHER = 2 << 20


class Words:
    """The words of some texts, lower-cased runs of letters and digits: the distinct ones, and as their
    numbers, one text after another, all of them."""

    def __init__(self, texts: list[str | None]):
        low = pa.array([(t or "").lower() for t in texts], pa.large_string())
        # what stands between words gives way to spaces; spaces themselves needn't
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(low, r"[^\p{L}\p{N}\s]+", " "))
        all_ = parts.flatten().dictionary_encode()
        self.distinct = all_.dictionary
        at, cut = all_.indices.to_numpy(), parts.offsets.to_numpy()
        empty = pc.index(self.distinct, "").as_py()  # at a text's edges
        if empty >= 0:
            real = at != empty
            cut = np.concatenate(([0], np.cumsum(real)))[cut]
            at = at[real]
        self.at, self.cut = at, cut

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Texts and the words that they have, each pair once."""
        size = max(1, len(self.distinct))
        both = np.unique(np.repeat(np.arange(len(self.cut) - 1), np.diff(self.cut)) * size + self.at)
        return both // size, both % size

    def each(self):
        """The numbers of each text's words."""
        for a, b in zip(self.cut[:-1].tolist(), self.cut[1:].tolist(), strict=True):
            yield self.at[a:b]


class Found:
    """Which of some features words have: for a word and each of its prefixes the feature's place, or -1."""

    def __init__(self, names: list[str]):
        kinds: dict = {0: [], **{k: [] for k in PREFIXES}}
        for i, f in enumerate(names):
            kinds[len(f) - 1 if f.endswith("*") else 0].append((f.removesuffix("*"), i))
        self.kinds = [(k, pa.array([f for f, _ in fs], pa.large_string()), np.array([i for _, i in fs], np.int64)) for k, fs in kinds.items() if fs]

    def of(self, words: pa.Array) -> list[np.ndarray]:
        out, length = [], pc.utf8_length(words).to_numpy()
        for k, known, place in self.kinds:
            some = pc.utf8_slice_codeunits(words, 0, k) if k else words
            at = np.array(pc.index_in(some, value_set=known).fill_null(-1))
            out.append(np.where((at >= 0) & (length > k), place[at], -1))
        return out


def features_of(words: pa.Array) -> list[tuple[int, pa.Array]]:
    """The features of words: themselves, and marked, as it isn't the word of that spelling, each prefix.
    With each kind the length that a word must exceed."""
    mark, none = (pa.scalar(x, words.type) for x in ("*", ""))
    return [(0, words), *((k, pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), mark, none)) for k in PREFIXES)]


@dataclass
class Model:
    lexicon: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    a: float = -30.0
    b: float = 0.0
    against: dict[str, float] = field(default_factory=dict)  # words of negative log-odds

    def scorer(self):
        """A function from distinct words to their scores."""
        odds = Found(list(self.lexicon))
        value = np.array([*self.lexicon.values(), -np.inf])  # the last is for features that aren't there
        less = Found(list(self.against))
        minus = np.array([*self.against.values(), 0.0])

        def score(words: pa.Array) -> np.ndarray:
            best = np.full(len(words), -np.inf)
            for at in odds.of(words):
                best = np.maximum(best, value[at])
            other = np.full(len(words), -DRIFT)
            for at in less.of(words):
                other += minus[at]
            return np.where(best > 0, best, other)

        return score

    def evidence(self, scores: list[float], n: int) -> float:
        """-log of the probability of such segments by chance: for each r, that r segments or more reach
        the r-th best score, a Poisson tail, with 2 log r off for the choice of r; the greatest counts."""
        if not scores or n == 0:
            return 0.0
        most = 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            log_e = math.log(self.k * n) - self.lam * s
            if r == 1:
                most = -math.log(-math.expm1(-math.exp(min(log_e, 700.0)))) if log_e > -30 else -log_e
            elif log_e < math.log(r):
                e, term, total, i = math.exp(log_e), 1.0, 1.0, r
                while term > 1e-12 * total:
                    i += 1
                    term *= e / i
                    total += term
                most = max(most, e - r * log_e + math.lgamma(r + 1) - math.log(total) - 2 * math.log(r))
        return most

    def expected(self, score: float, n: int) -> float:
        return math.exp(min(700.0, math.log(self.k * n) - self.lam * score))

    def probability(self, evidence: float) -> float:
        x = self.a + self.b * min(evidence, 60.0)
        return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in one pass over the positive scores.

    A candidate knows the nearest one to its left whose sum before it is lower. Whoever is passed over
    in the search is behind such a link from then on, so that the time is linear.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    firsts, ends, lows, highs, left = [], [], [], [], []
    for first, low, high in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        end, j = first + 1, len(firsts) - 1
        while True:
            while j >= 0 and lows[j] >= low:
                j = left[j]
            if j < 0 or highs[j] >= high:
                break
            first, low, k, j = firsts[j], lows[j], j, left[j]
            for x in (firsts, ends, lows, highs, left):
                del x[k:]
        for x, v in ((firsts, first), (ends, end), (lows, low), (highs, high), (left, j)):
            x.append(v)
    return [(f, e, h - lo) for f, e, lo, h in zip(firsts, ends, lows, highs, strict=True)]


def scans(score, texts: list[str | None]):
    """For each text the scores of its words and all its maximal segments."""
    words = Words(texts)
    value = score(words.distinct)
    for at in words.each():
        s = value[at]
        yield s, segments(s)


# --- training ---


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(toxic, t): the texts of the bounded sample of labelled rows, none of them held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    few = known.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "_id", "toxic").limit(rows)
    few = few.groupBy("_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("t")).join(F.broadcast(few), "_id")


def log_odds(y1: np.ndarray, y0: np.ndarray, n1: int, n0: int, prior: np.ndarray) -> np.ndarray:
    """Log-odds moved Z standard errors towards zero, and zero where they are within these."""
    a0 = prior.sum() + 1
    odds = np.log((y1 + prior) / (n1 + a0 - y1 - prior)) - np.log((y0 + prior) / (n0 + a0 - y0 - prior))
    return np.sign(odds) * np.maximum(0.0, np.abs(odds) - Z * np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior)))


def lexicon(names: list[str], y1: np.ndarray, y0: np.ndarray, n1: int, n0: int, share: np.ndarray) -> Model:
    """A model, yet without its law, from features' counts among n1 toxic and n0 other documents and
    their shares of all documents."""
    told = (y1 >= LEAST) & (2 * y1 * n0 > 3 * y0 * n1)
    told |= (y0 >= LEAST_AGAINST) & (2 * y1 * n0 < y0 * n1) & np.array([not f.endswith("*") for f in names], bool)
    at = np.flatnonzero(told)
    odds = log_odds(y1[at], y0[at], n1, n0, 0.05 + PRIOR * n1 * share[at]).tolist() if len(at) and n1 and n0 else []
    found = {names[i]: o for i, o in zip(at.tolist(), odds, strict=False)}
    return Model({f: o for f, o in found.items() if o > 0}, against={f: o for f, o in found.items() if o < 0})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LABELLED) -> Model:
    small_batches(docs.sparkSession)
    # the text decides on the part, so that copies are in one part
    sample = settle(_labelled(docs, labels, id_col, text_col, rows).withColumn("part", F.pmod(F.xxhash64("t"), F.lit(PARTS)).cast("int")))
    columns = [f"y{y}_{k}" for y in (0, 1) for k in range(PARTS)]

    def count(batches):
        for x in grouped(batches, TOGETHER // 2):
            words, size = Words(x.column(0).to_pylist()), 2 * PARTS
            column = x.column(1).to_numpy() * PARTS + x.column(2).to_numpy()
            if not len(words.distinct):
                continue
            # a word's features are in the same order in each of these, and the shorter ones have none
            named, length = features_of(words.distinct), pc.utf8_length(words.distinct).to_numpy()
            coded = pa.concat_arrays([f for _, f in named]).dictionary_encode()
            codes = coded.indices.to_numpy().reshape(len(named), -1)
            doc, word = words.pairs()
            both = [doc[ok] * len(coded.dictionary) + codes[i][word[ok]] for i, (k, _) in enumerate(named) for ok in [length[word] > k]]
            pairs = np.unique(np.concatenate(both))
            n = np.bincount(pairs % len(coded.dictionary) * size + column[pairs // len(coded.dictionary)], minlength=len(coded.dictionary) * size).reshape(-1, size)
            there = np.flatnonzero(n.any(axis=1))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(there)).cast(pa.string()), *(pa.array(n[there, i]) for i in range(size))], names=["f", *columns])
            del words, named, coded, codes, both, pairs, n
            tidy()

    n = np.zeros((2, PARTS), np.int64)
    for r in sample.groupBy("toxic", "part").agg(F.count("*").alias("n")).collect():
        n[r["toxic"], r["part"]] = r["n"]
    n0, n1 = n.sum(axis=1).tolist()
    if not n1 or not n0:
        return Model({})
    counted = sample.select("t", "toxic", "part").mapInArrow(tidied(count), "f string, " + ", ".join(f"{c} long" for c in columns)).groupBy("f").agg(*[F.sum(c).alias(c) for c in columns])
    y0, y1 = (sum((F.col(f"y{y}_{k}") for k in range(PARTS)), F.lit(0)) for y in (0, 1))
    # what may be told of any three parts; at most the words of the bounded sample and their prefixes
    telling = ((y1 >= LEAST) & (y1 * n0 > y0 * n1)) | ((y0 >= LEAST_AGAINST) & (y1 * n0 < y0 * n1) & ~F.endswith("f", F.lit("*")))
    got = counted.where(telling).orderBy("f").toArrow()
    if not got.num_rows:
        return Model({})
    names = got.column("f").to_pylist()
    counts = np.stack([got.column(c).to_numpy() for c in columns]).reshape(2, PARTS, -1).astype(float)
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def background(batches):
        found, seen, n = Found(shared.value), np.zeros(len(shared.value), np.int64), 0
        for x in grouped(batches, TOGETHER):
            words = Words(x.column(0).to_pylist())
            n += x.num_rows
            doc, word = words.pairs()  # a word counts once in a text, and so does a feature
            for at in found.of(words.distinct):
                f = at[word]
                both = np.unique(doc[f >= 0] * len(seen) + f[f >= 0])
                seen += np.bincount(both % len(seen), minlength=len(seen))
            del words, doc, word
            tidy()
        keys = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, -1).astype(np.int32)), pa.array(np.append(seen[keys], n))], names=["i", "n"])

    every = docs.select(F.col(text_col).alias("t")).mapInArrow(tidied(background), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    at, times = every.column("i").to_numpy(), every.column("n").to_numpy()
    share = np.zeros(len(names))
    share[at[at >= 0]] = times[at >= 0]
    share /= max(1, times[at < 0].sum())

    def of(parts: list[int]) -> Model:
        return lexicon(names, counts[1, parts].sum(axis=0), counts[0, parts].sum(axis=0), int(n[1, parts].sum()), int(n[0, parts].sum()), share)

    return _calibrated(of(list(range(PARTS))), [of([j for j in range(PARTS) if j != k]) for k in range(PARTS)], sample.select("t", "toxic", "part"))


def _law(law: Counter, most: float) -> float:
    """lambda: the one positive root of sum p exp(lambda s) = 1 over words' scores s and their numbers."""
    total = sum(law.values())
    s, p = np.array([*law, most]), np.array([*law.values(), 1.0]) / (total + 1)  # the best word turns up by chance now and then
    if not (s < 0).any():
        return 1e-6
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if (p * np.exp(np.minimum(700.0, mid * s))).sum() > 1 else (mid, high)
    return low


def _calibrated(model: Model, parts: list[Model], sample: DataFrame) -> Model:
    """``model`` with its law and logistic fit, from each part of the sample under the model of the others."""
    shared = sample.sparkSession.sparkContext.broadcast(parts)

    def read(batches):
        scorers = [m.scorer() for m in shared.value]
        for x in grouped(batches, TOGETHER):
            rows, law = [], Counter()
            texts, toxic, part = (x.column(i).to_pylist() for i in range(3))
            for k, scorer in enumerate(scorers):
                mine = [i for i, p in enumerate(part) if p == k]
                for i, (s, found) in zip(mine, scans(scorer, [texts[i] for i in mine]), strict=True):
                    rows.append((k, toxic[i], len(s), [v for *_, v in found], None, None))
                    if not toxic[i]:
                        for v, times in zip(*np.unique(np.round(s, 2), return_counts=True), strict=True):
                            law[k, float(v)] += int(times)
            rows.extend((k, None, None, None, v, times) for (k, v), times in law.items())
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "toxic", "n", "scores", "s", "times"])

    # as many rows as the bounded sample has, and a few per part for the scores that words have
    out = sample.mapInArrow(tidied(read), "part int, toxic int, n long, scores array<double>, s double, times long")
    laws: list[Counter] = [Counter() for _ in parts]
    rows = []
    for r in out.collect():
        if r["s"] is None:
            rows.append(r)
        else:
            laws[r["part"]][r["s"]] += r["times"]
    for k, (m, law) in enumerate(zip(parts, laws, strict=True)):
        m.lam = _law(law, max(m.lexicon.values(), default=1.0))
        other = [r for r in rows if r["part"] == k and not r["toxic"] and r["n"]]
        spread = [m.lam * max(r["scores"]) - math.log(r["n"]) for r in other if r["scores"]]
        # best segments follow exp(-K n exp(-lambda S)); matched at the mean of those that have one, thinned by their share
        m.k = max(1e-9, math.exp(float(np.mean(spread)) - 0.5772) * len(spread) / len(other)) if spread else 1 / max(1.0, float(np.mean([r["n"] for r in other])) if other else 1.0)
    model.lam = float(np.mean([m.lam for m in parts]))
    model.k = math.exp(float(np.mean([math.log(m.k) for m in parts])))
    x = np.array([min(60.0, parts[r["part"]].evidence(r["scores"], r["n"])) for r in rows])
    model.a, model.b = _logistic(x, np.array([r["toxic"] for r in rows], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a weak pull to zero, which keeps separable rows finite."""
    design, beta, pull = np.stack([np.ones_like(x), x], 1), np.zeros(2), np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + pull, design.T @ (y - p) - pull @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages): passages are the significant segments, in words, with their E."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches):
        model = shared.value
        scorer = model.scorer()
        for x in grouped(batches, TOGETHER):
            score, found = [], []
            for s, all_ in scans(scorer, x.column(1).to_pylist()):
                score.append(model.probability(model.evidence([v for *_, v in all_], len(s))))
                some = [(f, e, v, model.expected(v, len(s))) for f, e, v in all_]
                found.append([{"first": f, "end": e, "score": v, "e_value": x_} for f, e, v, x_ in some if x_ < EXPECT])
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(score, pa.float64()), pa.array(found, passage)], names=["id", "score", "passages"])
            tidy()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(tidied(run), "id long, score double, passages array<struct<first: int, end: int, score: double, e_value: double>>")


def op5_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", at: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``at``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    where, plain = docs.columns.index(text_col), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever they are called
    names = plain.columns

    def run(batches):
        model = shared.value
        scorer = model.scorer()
        for x in grouped(batches, TOGETHER):
            keep = [model.probability(model.evidence([v for *_, v in all_], len(s))) < at for s, all_ in scans(scorer, x.column(where).to_pylist())]
            yield pa.RecordBatch.from_arrays(x.filter(pa.array(keep, pa.bool_())).columns, names=names)
            tidy()

    return plain.mapInArrow(tidied(run), plain.schema).toDF(*docs.columns)
