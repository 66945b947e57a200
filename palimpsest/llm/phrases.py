"""Phrase collocations by suffix automata over words.

A shard's pieces, stretches of text between marks, make one generalised suffix automaton, bounded in depth
and held in arrays. Its substrings are found level by level: one of k words is a transition, by its last word,
from its first k-1 words, and its suffix link goes to its last k-1; how many end positions (endpos) it has is
its count in the shard. Substrings of one state share their endpos, so a substring whose count equals that
of a longer one it ends is not the longest of its state. Counts are summed over all shards, and the same
two edges decide on subsumption: a phrase goes if a candidate that has it as its suffix link or as the source
of its transition is as frequent.

A phrase that reaches the least count has only parts that do. So the automata are built in rounds of growing
depth, and a round enumerates only what the sums of the rounds before, words, pairs, triples, leave
possible. What they leave is held as a bitmap of hashes of bounded size, which lets a few more through; the last
round counts words as they are spelled, and its sums alone are results.

Defined results: null and empty texts have no words; a null language is ``und``, and joins rows that say
``und``; repeated rows, of an id too, count each; equal scores come in order of count, then of bytes; an empty
table, or one without phrases of the least count, gives none; further columns don't matter.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bits, first_ranked, grouped, hot_join, settle, small_batches, table, tidied, tidy

#: Fixed values of the contract: least count, words of a phrase, phrases of a language.
LEAST, LONGEST, FIRST = 100, 5, 2000
#: Bytes of texts a shard; counts that a task adds up before it passes them on.
SHARD, HELD = 6 << 20, 2 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, their bits spread (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shard:
    """Words of some texts: ``words`` the distinct ones, ``word`` the place there of each, ``lang`` of each, ``follows``
    whether it comes right after the one before it in a piece, ``hash`` of language and word."""

    def __init__(self, texts: list[str], langs: np.ndarray, lang_hash: np.ndarray):
        told = [t.encode("utf-8", "surrogatepass") for t in texts]
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in told]))).astype(np.int64)
        at = np.frombuffer((b"\n".join(told) + b"\n").translate(_LOWER), np.uint8)
        kind = _KIND[at]
        part = kind == 0
        begin = np.flatnonzero(part & ~np.concatenate(([False], part[:-1])))
        length = np.flatnonzero(part & ~np.concatenate((part[1:], [False]))) + 1 - begin
        bounds = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
        spelled = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(at[part].tobytes())]).dictionary_encode()
        self.words, self.word = spelled.dictionary, spelled.indices.to_numpy().astype(np.int64)
        self.lang = langs[np.searchsorted(first, begin, side="right") - 1]
        piece = np.cumsum(kind == 2, dtype=np.int64)[begin]
        self.follows = np.concatenate(([False], piece[1:] == piece[:-1])) if len(begin) else np.zeros(0, bool)
        own = np.fromiter(map(xxhash.xxh64_intdigest, self.words.to_pylist()), np.uint64, len(self.words))
        self.hash = _mixed(own[self.word] ^ lang_hash[self.lang])


class Automaton:
    """A shard's generalised suffix automaton down to ``depth`` words, of what ``allowed`` lets pass.

    ``levels[k]`` has the substrings of k words: ``at`` the place of one's last word, ``count`` its end positions,
    ``source`` and ``link`` the substrings of k-1 words that it goes on from and that it ends in, ``hash``.
    ``allowed(k, hashes)`` says which substrings of k words are wanted; longer ones that hold others aren't built.
    """

    def __init__(self, shard: Shard, depth: int, allowed):
        self.levels: list[dict] = [{}]
        ok = allowed(1, shard.hash)
        key, at, state, n = np.unique(np.where(ok, shard.lang * (len(shard.words) + 1) + shard.word, -1), return_index=True, return_inverse=True, return_counts=True)
        state = state.reshape(-1)
        if len(key) and key[0] == -1:
            at, state, n = at[1:], state - 1, n[1:]
        self.levels.append({"at": at, "count": n, "hash": shard.hash[at]})
        ends = np.flatnonzero(state >= 0)  # the places where a substring of this level ends
        for k in range(2, depth + 1):
            ends = ends[shard.follows[ends]]
            ends = ends[state[ends - 1] >= 0]  # its first k-1 words; its last ones are there as well
            source, link = state[ends - 1], state[ends]
            # what goes on from a substring by a word: source and link name it
            _, first, own, n = np.unique(source * (len(self.levels[-1]["at"]) + 1) + link, return_index=True, return_inverse=True, return_counts=True)
            hashes = _mixed(self.levels[-1]["hash"][source[first]] * _ODD + shard.hash[ends[first]])
            good = allowed(k, hashes)
            number = np.where(good, np.cumsum(good) - 1, -1)
            self.levels.append({"at": ends[first[good]], "count": n[good], "source": source[first[good]], "link": link[first[good]], "hash": hashes[good]})
            state = np.full(len(shard.word), -1)
            state[ends] = number[own.reshape(-1)]
            ends = ends[state[ends] >= 0]

    def longest(self, k: int) -> np.ndarray:
        """Which substrings of k words are the longest of their states, as far as the depth shows: no longer one that
        they end has the same end positions."""
        out = np.ones(len(self.levels[k]["at"]), bool)
        if k + 1 < len(self.levels):
            up = self.levels[k + 1]
            out[up["link"][up["count"] == self.levels[k]["count"][up["link"]]]] = False
        return out


def _spelled(shard: Shard, at: np.ndarray, k: int) -> pa.Array:
    """The phrases of k words that end at the given words, joined by blanks."""
    words = [shard.words.take(pa.array(shard.word[at - k + 1 + i])) for i in range(k)]
    return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if k > 1 else words[0]


def _shards(batches):
    """(shard, names of its languages), of about ``SHARD`` bytes of texts."""
    for x in grouped(batches, SHARD):
        langs = x.column(0).dictionary_encode()
        seeds = np.fromiter((xxhash.xxh64_intdigest(v, 1) for v in langs.dictionary.to_pylist()), np.uint64, len(langs.dictionary))
        texts = x.column(1).to_pylist()
        del x
        yield Shard(texts, langs.indices.to_numpy().astype(np.int64), seeds), langs.dictionary
        tidy()


def _rows(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession, size="4m")
    return docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("t"))


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n, h): the words with at least ``least`` occurrences, and a row with a null phrase per language:
    all its words."""

    def run(batches):
        for shard, names in _shards(batches):
            key, at, n = np.unique(shard.lang * (len(shard.words) + 1) + shard.word, return_index=True, return_counts=True)
            lang = shard.lang[at]
            every = np.bincount(shard.lang, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)), shard.words.take(pa.array(shard.word[at])).cast(pa.binary()), pa.array(n.astype(np.int64)), pa.array(shard.hash[at].view(np.int64))], names=["lang", "phrase", "n", "h"])
            yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.binary()), pa.array(every.astype(np.int64)), pa.nulls(len(names), pa.int64())], names=["lang", "phrase", "n", "h"])

    counted = rows.mapInArrow(tidied(run), "lang string, phrase binary, n long, h long").groupBy("lang", "phrase")
    return counted.agg(F.sum("n").alias("n"), F.first("h").alias("h")).where(F.col("phrase").isNull() | (F.col("n") >= least))


def _passing(filters):
    """What ``Automaton`` asks, for a task: levels without a filter let all pass."""
    return lambda k, hashes: filters[k].has(hashes) if k in filters else np.ones(len(hashes), bool)


def possible(rows: DataFrame, filters: dict, k: int, least: int) -> DataFrame:
    """(h): hashes of the substrings of k words whose counts may reach ``least``.

    A task adds up the counts of its shards; one row a task and substring is left to be summed, so that no
    key is hot and nothing is gained by adding up once more before the shuffle.
    """
    sent = rows.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for shard in chain((s for s, _ in _shards(batches)), [None]):
            if shard is not None:
                level = Automaton(shard, k, _passing(sent.value)).levels[k]
                h, back = np.unique(np.concatenate((h, level["hash"])), return_inverse=True)
                n = np.bincount(back.reshape(-1), np.concatenate((n, level["count"])), len(h)).astype(np.int64)
            if shard is None or len(h) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
                h, n = h[:0], n[:0]

    counted = rows.mapInArrow(tidied(run), "h long, n long").repartition("h")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def phrase_counts(rows: DataFrame, filters: dict, longest: int, least: int) -> DataFrame:
    """(lang, phrase, k, n): the phrases of 2 to ``longest`` words with at least ``least`` occurrences."""
    sent = rows.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for shard, names in _shards(batches):
            made = Automaton(shard, longest, _passing(sent.value))
            for k in range(2, longest + 1):
                level = made.levels[k]
                for a in range(0, len(level["at"]), 1 << 18):
                    at, n = level["at"][a : a + (1 << 18)], level["count"][a : a + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(shard.lang[at])), _spelled(shard, at, k).cast(pa.binary()), pa.array(np.full(len(at), k, np.int32)), pa.array(n.astype(np.int64))], names=["lang", "phrase", "k", "n"])

    counted = rows.mapInArrow(tidied(run), "lang string, phrase binary, k int, n long").groupBy("lang", "phrase", "k")
    return counted.agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by the score of their worst cut."""
    rows = _rows(docs, lang_col, text_col)
    words = settle(word_counts(rows, least))
    filters = {1: Bits(words.where(F.col("phrase").isNotNull()), "h")}
    for k in (2, 3):
        filters[k] = Bits(settle(possible(rows, filters, k, least)), "h")
    found = settle(phrase_counts(rows, filters, longest, least))
    key = F.struct("lang", "phrase")
    counts = found.select(key.alias("key"), F.col("n").alias("f")).unionByName(words.where(F.col("phrase").isNotNull()).select(key.alias("key"), F.col("n").alias("f")))
    totals = words.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("total"))
    # both parts of every cut; the places of blanks are where a phrase can be cut
    parts = F.split(F.decode("phrase", "UTF-8"), " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    cuts = found.select("lang", "phrase", "k", F.col("n").alias("a"), cut.alias("j"), parts.alias("w"))
    part = lambda a, b: F.encode(F.array_join(F.slice("w", a, b), " "), "UTF-8")
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("j")).alias("part")), F.struct(F.lit("r").alias("side"), part(F.col("j") + 1, F.col("k") - F.col("j")).alias("part"))))
    asked = cuts.select("lang", "phrase", "k", "a", "j", sides.alias("s")).select("lang", "phrase", "k", "a", "j", "s.side", F.struct("lang", F.col("s.part").alias("phrase")).alias("key"))
    asked = settle(asked)
    many = asked.groupBy("key").agg(F.count("*").alias("m"))
    met = settle(hot_join(asked, counts.join(many, "key"), "key", "m", asked.count(), "phrase"))
    # a phrase's first words are its transition's source, its last ones its suffix link
    edge = ((F.col("side") == "l") & (F.col("j") == F.col("k") - 1)) | ((F.col("side") == "r") & (F.col("j") == 1))
    inside = met.where((F.col("k") > 2) & edge & (F.lit(100) * F.col("a") >= F.lit(100) * F.col("f"))).select("key").distinct()
    scored = met.groupBy("lang", "phrase", "k", "a", "j").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    scored = scored.join(F.broadcast(totals), "lang")  # a row a language
    exact = "cast((cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(total as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)"
    scored = scored.withColumn("score", F.expr(exact))
    worst = scored.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "j", "l", "r")).alias("x"))
    left = worst.withColumn("key", F.struct("lang", "phrase")).join(inside, "key", "left_anti")
    left = left.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    out = first_ranked(left, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], first, "rank")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), F.decode("phrase", "UTF-8").alias("phrase"), "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
