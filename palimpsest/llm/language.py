"""Language identification by rank-order profiles.

Letters n-grams of one to three characters, in lower case and with one blank for whatever stands between
words, are counted in all texts of a language; its ``TOP`` most frequent ones, in order, are its profile.
A document's most frequent n-grams, as many, are compared with each profile by their out-of-place
distance: how many ranks each lies away from its rank there, or ``TOP`` where the profile lacks it. The
least distance names the language, and ties the first name. The score is one less the ratio of the least
distance to the second least.

Profiles are counted over all rows to learn from, by partial sums; what is gathered has at most ``TOP``
rows a language and at most ``LANGUAGES`` of these, of which there are fewer in the world.

Defined results: a text that is null, empty or without letters is ``und`` with score 0, as is every text
where there is nothing to learn; with one language alone the score compares its distance with the worst
possible one; rows without a language or without an id aren't learned from; repeated rows each keep their
row and count each; an empty table gives none; further columns don't matter.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_ranked, grouped, small_batches, table, tidied

#: n-grams a profile, and bytes of texts that are counted together.
TOP, TOGETHER = 400, 2 << 20
LANGUAGES = 10_000
UNKNOWN = "und"
_BITS = 21  # of a character


@functools.cache
def _kinds() -> np.ndarray:
    """Of every character: 1 a letter, 2 a mark that goes on a letter, 0 anything else."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


def _pack(x1, x2, x3) -> np.ndarray:
    return (x1.astype(np.int64) << 2 * _BITS) | (x2.astype(np.int64) << _BITS) | x3.astype(np.int64)


def grams(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, gram, count), by owner and gram, of all texts' n-grams, and which texts have letters.

    ``owner``, from 0 on, is who a text's n-grams are counted for: the text itself, or its language. A gram
    is its characters' code points, 21 bits each.
    """
    low = [t.lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    at = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.concatenate(([1], 1 + np.cumsum(size + 1)))
    kind = _kinds()[at]
    letters = np.concatenate(([0], np.cumsum(kind == 1)))
    lettered = letters[first[1:] - 1] > letters[first[:-1]]
    part = kind > 0
    kept = part | np.concatenate(([True], part[:-1]))  # one blank after each word, and the first
    text = np.repeat(np.arange(len(low)), size + 1)
    who = np.concatenate(([0], owner[text]))[kept] if len(low) else np.zeros(1, np.int64)
    seen = np.zeros(len(_kinds()) + 1, np.int32)
    now = np.where(part, at, 32)[kept]
    seen[now] = 1
    alphabet = np.flatnonzero(seen)
    seen[alphabet] = np.arange(1, len(alphabet) + 1)
    x, blank, many = seen[now].astype(np.int64), now == 32, len(alphabet) + 1
    none = np.zeros(0, np.int64)
    if len(x) < 2:
        return none, none, none, lettered
    whose = np.where(blank, np.concatenate((who[1:], who[-1:])), who)
    if (int(whose.max()) + 1) * many**3 >= 1 << 62:  # never for one owner
        half = np.array_split(np.arange(len(texts)), 2)
        found = [grams([texts[i] for i in h], owner[h]) for h in half]
        o, g, n = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.lexsort((g, o))
        o, g, n = o[order], g[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(o) != 0) | (np.diff(g) != 0))))
        return o[new], g[new], np.add.reduceat(n, new), np.concatenate([f[3] for f in found])
    base = whose * many + x
    one = (base * many * many)[~blank]
    two = (base[:-1] * many + x[1:]) * many
    two = two[~(blank[:-1] & blank[1:])]
    three = ((base[:-2] * many + x[1:-1]) * many + x[2:])[~blank[1:-1]]
    keys = np.concatenate((one, two, three))
    keys.sort()
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    n = np.diff(np.concatenate((new, [len(keys)])))
    keys = keys[new]
    code = np.concatenate(([0], alphabet))
    gram = _pack(code[keys // (many * many) % many], code[keys // many % many], code[keys % many])
    return keys // many**3, gram, n, lettered


def shown(gram: int) -> str:
    """The characters of a gram, blanks as underscores."""
    return "".join(chr(c) for c in (gram >> 2 * _BITS, gram >> _BITS & (1 << _BITS) - 1, gram & (1 << _BITS) - 1) if c).replace(" ", "_")


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(lang, gram, n, rank): the most frequent n-grams of each language, rank from 1; ties by code point."""
    small_batches(docs.sparkSession, size="4m")

    def run(batches):
        for x in grouped(batches, TOGETHER):
            langs = x.column(0).dictionary_encode()
            who, gram, n, _ = grams(x.column(1).to_pylist(), langs.indices.to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(who)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    counted = rows.mapInArrow(tidied(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return first_ranked(counted, ["lang"], [F.desc("n"), F.asc("gram")], top, "rank")


class Profiles:
    """Ranks of all languages' n-grams: a row per n-gram, a column per language, ``top`` where it lacks."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int):
        self.top, self.langs = top, sorted({r[0] for r in rows})
        place = {x: i for i, x in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams), len(self.langs)), top, np.int32)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), place[lang]] = rank - 1

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Out-of-place distances, a row per text and a column per language; how many n-grams each text
        compares; which texts have letters."""
        who, gram, n, lettered = grams(texts, np.arange(len(texts)))
        order = np.lexsort((gram, -n, who))
        who, gram = who[order], gram[order]
        begin = np.searchsorted(who, np.arange(len(texts) + 1))
        rank = np.arange(len(who)) - begin[who]
        kept = rank < self.top
        who, gram, rank = who[kept], gram[kept], rank[kept]
        used = np.bincount(who, minlength=len(texts))
        far = np.zeros((len(texts), len(self.langs)), np.int64)
        step = max(1, (4 << 20) // max(1, len(self.langs)))
        for a in range(0, len(who), step):
            g, w = gram[a : a + step], who[a : a + step]
            at = np.searchsorted(self.grams, g).clip(max=len(self.grams) - 1)
            there = np.where((self.grams[at] == g)[:, None], self.ranks[at], self.top)
            out = np.where(there == self.top, self.top, np.abs(there - rank[a : a + step, None]))
            cut = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            far[w[cut]] += np.add.reduceat(out, cut, axis=0)
        return far, used, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        far, used, lettered = self.distances(texts)
        best = far.argmin(axis=1)  # the first of equals
        least = far[np.arange(len(texts)), best]
        second = np.partition(far, 1, axis=1)[:, 1] if len(self.langs) > 1 else used * self.top
        score = np.where(lettered & (second > 0), 1 - least / np.maximum(second, 1), 0.0)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score


def learned(rows: DataFrame, top: int = TOP) -> Profiles:
    """The profiles as an object for tasks, once their number is known to be bounded."""
    found = rows.select("lang", "gram", "rank").limit(LANGUAGES * top + 1).collect()
    if len(found) > LANGUAGES * top:
        raise ValueError(f"more than {LANGUAGES} languages: is this a column of languages?")
    return Profiles([tuple(r) for r in found], top)


def identified(docs: DataFrame, known: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): a row per row."""
    small_batches(docs.sparkSession, size="4m")
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for x in grouped(batches, TOGETHER):
            lang, score = sent.value.predict([t or "" for t in x.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(tidied(run), "id long, lang_pred string, score double")


def _held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 4 == 2, F.lit(False))


def op13_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = learned(profiles(docs.where(F.col("doc_id").isNotNull() & ~_held_out())))
    return identified(docs, known).select(F.col("id").alias("doc_id"), _held_out("id").alias("held_out"), "lang_pred", "score")
