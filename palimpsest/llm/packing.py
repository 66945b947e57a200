"""Best-fit packing of tokenized documents into sequences, with swap-based local search.

Lengths are at most the capacity, so that the plan needs only how many pieces there are of each
length. On that histogram best fit, lengths in no order of size, gives classes of equally filled bins;
local search then lets bins that aren't full move a piece, exchange one for one, two for one or one
for two, always so that the fuller bin gains and thus the sum of squared fills grows, until bins are
empty and leave, no exchange gains, or as few bins are left as the total needs. An exchange is applied
to all bins of both classes at once. The plan's size depends on the capacity, not on the documents;
pieces find their place in it by their rank among those of their length, which comes from a
range-partitioned order and counts per partition and length.

Defined results: a null text is empty; every document ends with the end id, so an empty one has one
piece of length 1; rows that repeat an id are packed each; an empty table gives no pieces; further
columns of the documents don't matter.
"""

from __future__ import annotations

import functools
import os
import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped, settle, small_batches, table, tidied, tidy

CAPACITY, END = 2048, 0
#: Bytes of texts that are split together; more of them have fewer distinct words in all.
TOGETHER = 4 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- tokens ---


class Tokens:
    """Ids of texts as arrays of unsigned 32-bit integers.

    The vocabulary splits texts into words before its merges: at white space, around marks, and between
    digits. So a batch is split in array operations, each distinct word is encoded once, many at a time
    (a word's last id, and no other, ends a word), and all ids are gathered from one pool. Texts with
    characters outside a range in which splitting is known to be the same here are encoded whole. What
    is known is forgotten at ``most`` words.
    """

    _MARKS = r"('s|'t|'re|'ve|'m|'ll|'d|[0-9]+|[^\p{L}0-9\s]+)"
    _KNOWN = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧]*")

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.most = Tokenizer.from_file(path), most
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([""], pa.large_string())  # the empty one stands at a text's edges
        self.first, self.size, self.pool, self.used = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1 << 16, "<u4"), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, new: pa.Array) -> None:
        for at in range(0, len(new), 4096):
            words = new.slice(at, 4096).to_pylist()
            ids = self._ids(" ".join(words))
            # every digit is a word of its own
            n = np.fromiter((len(w) if "0" <= w[0] <= "9" else 1 for w in words), np.int64, len(words))
            stop = (np.flatnonzero(self.ends[ids]) + 1)[np.cumsum(n) - 1]
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(ids)), "<u4")))
            self.pool[self.used : self.used + len(ids)] = ids
            self.first = np.concatenate((self.first, self.used + np.concatenate(([0], stop[:-1]))))
            self.size = np.concatenate((self.size, np.diff(stop, prepend=0)))
            self.used += len(ids)
        self.words = pa.concat_arrays([self.words, new])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if "<|" not in t and self._KNOWN.fullmatch(t)]
        out: list = [None] * len(texts)
        if plain:
            low = pa.array([texts[i].lower() for i in plain], pa.large_string())
            parts = pc.ascii_split_whitespace(pc.replace_substring_regex(low, self._MARKS, r" \1 "))
            del low
            words = parts.flatten().dictionary_encode()
            if len(self.words) + len(words.dictionary) > self.most:
                self._forget()
            place = pc.index_in(words.dictionary, value_set=self.words)
            if place.null_count:
                new = words.dictionary.filter(pc.is_null(place))
                at = len(self.words)
                self._learn(new)
                place = np.array(place.fill_null(-1))
                place[place < 0] = np.arange(at, at + len(new))
            place = np.asarray(place).astype(np.int32)[words.indices.to_numpy()]
            size = self.size[place]
            start = np.concatenate(([0], np.cumsum(size)))
            at = np.repeat((self.first[place] - start[:-1]).astype(np.int32), size)
            at += np.arange(len(at), dtype=np.int32)
            ids = self.pool[at]
            cut = start[parts.offsets.to_numpy()].tolist()
            for i, a, b in zip(plain, cut[:-1], cut[1:], strict=True):
                out[i] = ids[a:b]
        return [self._ids(t) if x is None else x for t, x in zip(texts, out, strict=True)]


@functools.lru_cache(maxsize=1)
def _tokens(path: str) -> Tokens:
    """One per Python worker, which keeps what it has learned for the next task."""
    return Tokens(path)


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids): documents cut into pieces of at most ``capacity`` tokens.

    ``path``: the vocabulary's file, there on every executor; None takes the installed package's.
    """
    small_batches(docs.sparkSession, size="4m")
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        tokens, last = _tokens(path or tokenizer_path()), np.array([end], "<u4").tobytes()
        for x in grouped(batches, TOGETHER):
            rows: list = []
            for i, found in zip(x.column(0).to_pylist(), tokens.batch([t or "" for t in x.column(1).to_pylist()]), strict=True):
                ids = found.tobytes() + last
                rows.extend((i, k, at // 4, len(ids[at : at + 4 * capacity]) // 4, ids[at : at + 4 * capacity]) for k, at in enumerate(range(0, len(ids), 4 * capacity)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            del rows, x
            tidy()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(tidied(run), "id long, piece int, start long, length long, ids binary")


# --- the plan: classes of bins with equal contents ---


class Plan:
    """Classes of bins: contents, a sorted tuple of lengths, to how many bins hold just these.

    ``exchanges`` and ``emptied`` count what local search did: bins that took part, bins that left.
    """

    def __init__(self, capacity: int):
        self.capacity, self.classes, self.exchanges, self.emptied = capacity, Counter(), 0, 0

    def bins(self) -> int:
        return sum(self.classes.values())

    def squares(self) -> int:
        return sum(n * sum(c) ** 2 for c, n in self.classes.items())

    def least(self) -> int:
        """As many bins as the total needs, however it is packed."""
        return -(-sum(n * sum(c) for c, n in self.classes.items()) // self.capacity)


def best_fit(lengths: dict[int, int], capacity: int, order: list[int]) -> Plan:
    """Best fit over a histogram, lengths in the given order: each piece goes to the fullest bin that
    has room.

    A bin that took a piece is fuller than before and so takes the next of that length too, while
    it has room: bins of one class fill one after another and leave at most two classes.
    """
    by_room: defaultdict = defaultdict(Counter)
    done: Counter = Counter()
    rooms: list[int] = []  # sorted: the rooms for which there are bins

    def put(contents, n, room):
        if n and room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room][contents] += n
        elif n:
            done[contents] += n

    for length in order:
        left = lengths[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                put((length,) * each, full, capacity - each * length)
                put((length,) * rest, 1 if rest else 0, capacity - rest * length)
                break
            room = rooms[i]
            contents, n = next(iter(by_room[room].items()))
            each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            used = full + (1 if rest else 0)
            del by_room[room][contents]
            if n > used:
                by_room[room][contents] = n - used
            if not by_room[room]:
                rooms.pop(i)
            put((*contents, *(length,) * each), full, room - each * length)
            if rest:
                put((*contents, *(length,) * rest), 1, room - rest * length)
            left -= full * each + rest
    for room in rooms:
        done.update(by_room[room])
    plan = Plan(capacity)
    for contents, n in done.items():
        plan.classes[tuple(sorted(contents, reverse=True))] += n
    return plan


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> Plan:
    return best_fit(lengths, capacity, sorted(lengths, reverse=True))


def best_fit_mixed(lengths: dict[int, int], capacity: int) -> Plan:
    """Best fit with lengths in no order of size, as documents come."""
    return best_fit(lengths, capacity, sorted(lengths, key=lambda x: (x * 0x9E3779B1 & 0xFFFFFFFF, x)))


def _sums(contents: tuple) -> dict[int, tuple[int, int]]:
    """The sums of two pieces of a bin, each with one such pair."""
    many = Counter(contents)
    kinds = sorted(many)
    return {x + y: (x, y) for i, x in enumerate(kinds) for y in kinds[i:] if x != y or many[x] > 1}


class _Held:
    """Which open class holds what: for each size of a given part the classes that have one, least
    filled first, and all sizes as the bits of one number."""

    def __init__(self, open_: dict):
        self.open, self.heaps, self.bits = open_, defaultdict(list), 0

    def add(self, size: int, fill: int, contents: tuple) -> None:
        heappush(self.heaps[size], (fill, contents))
        self.bits |= 1 << size

    def below(self, most: int) -> int:
        """The largest size up to ``most``, or -1."""
        return (self.bits & ((2 << most) - 1)).bit_length() - 1

    def giver(self, size: int, other_than: tuple | None) -> tuple[int, tuple] | None:
        """(fill, contents) of the least filled class that has a part of this size."""
        heap, aside = self.heaps[size], None
        while heap:
            if heap[0][1] not in self.open or (aside and heap[0] == aside):
                heappop(heap)
            elif heap[0][1] == other_than:
                aside = heappop(heap)
            else:
                break
        found = heap[0] if heap else None
        if aside:
            heappush(heap, aside)
        if not heap:
            self.bits &= ~(1 << size)
        return found


def local_search(plan: Plan) -> Plan:
    """Exchanges between bins that aren't full, until as few are left as the total needs or none gains.

    The fullest open bin comes first. It takes a piece, or one for one, two for one or one for two of
    its own, from whichever other bin lets it fill up most, of these the least filled, so that the sum
    of squared fills grows with every exchange and bins at the other end run empty. An exchange is
    applied to all bins of both classes at once. What each class can give is indexed by its size, so
    that no pair of classes is tried that has nothing to exchange; passes go on until one of them
    changes nothing. No effort is capped: squares grow by at least 2 each time, and are bounded.
    """
    capacity, bound = plan.capacity, plan.least()
    open_: dict = {}
    out = Plan(capacity)
    one, two = _Held(open_), _Held(open_)
    bins = plan.bins()

    def add(contents, n) -> int:
        """The number of bins that are empty."""
        if not contents:
            return n
        c = tuple(sorted(contents, reverse=True))
        if sum(c) == capacity:
            out.classes[c] += n
        elif c in open_:
            open_[c] += n
        else:
            open_[c] = n
            for size in set(c):
                one.add(size, sum(c), c)
            for size in _sums(c):
                if size <= capacity:
                    two.add(size, sum(c), c)
        return 0

    def best(taker: tuple, fill: int):
        """(gain, giver, size given, whether of two pieces, pieces taken)."""
        room, found = capacity - fill, None
        own = taker if open_[taker] < 2 else None
        takes = [((), 0), *(((x,), x) for x in sorted(set(taker)))]
        ways = [(one, p, t) for p, t in takes] + [(two, p, t) for p, t in takes] + [(one, p, t) for t, p in _sums(taker).items()]
        # large pieces change places first, small ones are spared for what room is left, and moves come last
        ways = sorted((w for w in ways if w[1]), key=lambda w: -w[2]) + [(one, (), 0)]
        for held, taken, t in ways:
            most = t + room
            while (size := held.below(most)) - t > (found[0] if found else 0):
                giver = held.giver(size, own)
                if giver and giver[0] < fill + size - t:  # squares grow
                    found = (size - t, giver[1], size, held is two, taken)
                    break
                most = size - 1
            if found and found[0] == room:
                break
        return found

    for contents, n in sorted(plan.classes.items()):
        add(contents, n)
    changed = True
    while changed and bins > bound:
        changed = False
        for taker in sorted(open_, key=lambda c: (-sum(c), c)):
            fill = sum(taker)
            while bins > bound and taker in open_ and (found := best(taker, fill)):
                _, giver, size, pair, taken = found
                given = _sums(giver)[size] if pair else (size,)
                n = open_[giver] // 2 if taker == giver else min(open_[giver], open_[taker])
                for c in (giver, taker):
                    open_[c] -= n
                    if not open_[c]:
                        del open_[c]
                mine, theirs = Counter(taker), Counter(giver)
                mine.subtract(taken)
                mine.update(given)
                theirs.subtract(given)
                theirs.update(taken)
                empty = add(tuple(theirs.elements()), n)
                add(tuple(mine.elements()), n)
                out.exchanges, out.emptied, bins, changed = out.exchanges + n, out.emptied + empty, bins - empty, True
    out.classes.update(open_)
    return out


def make_plan(lengths: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Local search from best fit of mixed lengths; where that leaves more bins than the total needs,
    from best-fit decreasing as well, and the better of both."""
    plan = local_search(best_fit_mixed(lengths, capacity))
    if plan.bins() > plan.least():
        plan = min(plan, local_search(best_fit_decreasing(lengths, capacity)), key=Plan.bins)
    return plan


def places(plan: Plan) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces a bin, first bin, offset), by first rank."""
    used, out, bin_ = Counter(), defaultdict(list), 0
    for contents, n in sorted(plan.classes.items()):
        offset = 0
        for length, k in Counter(contents).items():
            out[length].append((used[length], k, bin_, offset))
            used[length] += n * k
            offset += k * length
        bin_ += n
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with id, piece, length, and any further small columns) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = settle(pieces)
    order = pieces.withColumn("_h", F.xxhash64("id", "piece")).repartitionByRange("length", "_h").sortWithinPartitions("length", "_h")
    order = settle(order.drop("_h").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # the order is by length, so a row per partition and one more for each length: as many as both together
    counts = order.groupBy("_part", "length").agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("length", "_part").collect()
    lengths: Counter = Counter()
    before = {}
    for r in counts:
        before[r["_part"], r["length"]] = lengths[r["length"]] - r["first"]
        lengths[r["length"]] += r["n"]
    shared = spark.sparkContext.broadcast((places(make_plan(dict(lengths), capacity)), before))
    fields = [f for f in order.schema if f.name not in ("_part", "_at")]
    names = [f.name for f in fields]

    def run(batches):
        found, before = shared.value
        for x in batches:
            length, at = x.column("length").to_numpy(), x.column("_at").to_numpy()
            part = x.column("_part").to_numpy()
            seq, off = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for n in np.unique(length):
                for p in np.unique(part[length == n]):
                    rows = (length == n) & (part == p)
                    rank = at[rows] + before[int(p), int(n)]
                    where = found[int(n)]
                    first, k, bin_, offset = where[np.searchsorted(where[:, 0], rank, side="right") - 1].T
                    seq[rows], off[rows] = bin_ + (rank - first) // k, offset + (rank - first) % k * n
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = order.drop("_part", "_at").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return order.mapInArrow(tidied(run), schema)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenized(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packed(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
