"""Baseline JPEG columns: markers, Huffman scans and DC-only luminance thumbnails, in numpy.

Scans of many segments are decoded in lockstep: every restart segment of every image of a batch that
shares tables and layout takes its next symbol at the same time, so that the work per symbol is a few
array operations over all segments. Scans of few, as ordinary photographs have them, are decoded from
every bit at once: for a window of the scan array operations tell, for each bit and table, where the
symbol that begins there ends and what it skips, and what is left is to follow that chain. Both read
whole scans; of several scans the one with the luminance is decoded.

Bytes can be stored in a JPEG without loss, in the format's own unit, the quantized coefficient:
coefficients of size category 8 are -255..-128 and 128..255, just as many as a byte has values, so
that a byte is the eight extra bits of such a coefficient. With one-bit Huffman codes for that
category, quantizers of 1 and a restart after every block, a block of 64 bytes takes 72 and a marker.

Defined results: null and empty texts are stored as one unit of spaces; repeated rows are stored
each; an image that isn't baseline JPEG or is damaged gets nulls and the reason in ``error``; an
empty table gives none; further columns don't matter. Equal texts give equal files and features.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: A payload is padded with spaces to a positive multiple of this: three blocks.
UNIT = 192
MOST = 8191  # blocks along a side


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, values: dict[int, list[int]]) -> bytes:
    """A DHT body from code lengths to symbols."""
    return bytes([kind, *(len(values.get(n, ())) for n in range(1, 17)), *(v for n in range(1, 17) for v in values.get(n, ()))])


def padded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload, whose length is a positive multiple of 64."""
    layout, blocks = [], []
    for p in payloads:
        n = len(p) // 64
        wide = 3 if n % 3 == 0 and n // 3 <= MOST else max(3, -(-n // MOST))
        high = -(-n // wide)
        layout.append((wide, high, len(p)))
        blocks.append(p + bytes(64 * (wide * high - n)))
    data = np.frombuffer(b"".join(blocks), np.uint8)
    bits = np.zeros((len(data), 9), np.uint8)  # the code 0, then the byte
    bits[:, 1:] = np.unpackbits(data[:, None], axis=1)
    body = np.packbits(bits.reshape(-1, 576), axis=1)
    del bits
    units = np.empty((len(body), 74), np.uint8)
    units[:, :72], units[:, 72] = body, 0xFF
    counts = [w * h for w, h, _ in layout]
    starts = np.concatenate(([0], np.cumsum(counts)))
    units[:, 73] = 0xD0 + (np.arange(len(body)) - np.repeat(starts[:-1], counts)) % 8
    stuffed = units == 0xFF
    stuffed[:, 72:] = False
    ends = np.cumsum(74 + stuffed.sum(axis=1))
    flat = np.repeat(units.ravel(), 1 + stuffed.ravel())
    at = np.flatnonzero(stuffed.ravel())
    flat[at + np.arange(1, len(at) + 1)] = 0
    ends = np.concatenate(([0], ends))
    out = []
    for i, (w, h, n) in enumerate(layout):
        head = b"\xff\xd8" + _segment(0xFE, b"payload %d" % n) + _segment(0xDB, bytes([0] + [1] * 64))
        head += _segment(0xC0, b"\x08" + (8 * h).to_bytes(2, "big") + (8 * w).to_bytes(2, "big") + b"\x01\x01\x11\x00")
        head += _segment(0xC4, _table(0x00, {1: [8]}) + _table(0x10, {1: [8]})) + _segment(0xDD, b"\x00\x01") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
        out.append(head + flat[ends[starts[i]] : ends[starts[i + 1]] - 2].tobytes() + b"\xff\xd9")
    return out


@dataclass
class Scan:
    comps: list  # indices of the image's components, in the scan's order
    dc: list  # Huffman specifications, one per component of the scan
    ac: list
    restart: int
    data: bytes


@dataclass
class Image:
    width: int = 0
    height: int = 0
    quant: dict = field(default_factory=dict)
    comps: list = field(default_factory=list)  # (id, h, v, quantizer)
    comment: bytes = b""
    scan: Scan | None = None  # that of the first component

    def _most(self) -> tuple[int, int]:
        return max(c[1] for c in self.comps), max(c[2] for c in self.comps)

    def size_of(self, k: int) -> tuple[int, int]:
        """Blocks across and down that component k has, without padding."""
        h, v = self._most()
        return -(-(-(-self.width * self.comps[k][1] // h)) // 8), -(-(-(-self.height * self.comps[k][2] // v)) // 8)

    def mcus(self) -> tuple[int, int]:
        """MCUs of the scan across and down; with one component an MCU is a block."""
        if len(self.scan.comps) == 1:
            return self.size_of(self.scan.comps[0])
        h, v = self._most()
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def blocks(self) -> list[int]:
        """For each block of an MCU, which of the scan's components it is of."""
        if len(self.scan.comps) == 1:
            return [0]
        return [i for i, k in enumerate(self.scan.comps) for _ in range(self.comps[k][1] * self.comps[k][2])]


def _scan_end(data: bytes, at: int) -> int:
    """Where the next marker is that doesn't belong to a scan's data."""
    raw = np.frombuffer(data, np.uint8)
    ff = at + np.flatnonzero(raw[at:-1] == 0xFF)
    after = raw[ff + 1]
    stop = ff[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
    if not len(stop):
        raise ValueError("no EOI")
    return int(stop[0])


def parse(data: bytes) -> Image:
    """Reads the markers; raises ValueError if it isn't a baseline JPEG. What follows EOI isn't read."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI")
    image, at, huff, restart, seen = Image(), 2, {}, 0, 0
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            if image.scan is None or seen < len(image.comps):
                raise ValueError("scans are missing")
            return image
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("a segment is cut off")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("not 8 bits a sample")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if not image.width or not image.height or not image.comps or any(not (c[1] and c[2]) for c in image.comps):
                raise ValueError("no dimensions")
        elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            if not image.comps:
                raise ValueError("a scan without a frame")
            ids = [c[0] for c in image.comps]
            picked = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            end = _scan_end(data, at)
            if any(k == 0 for k, _ in picked):
                image.scan = Scan([k for k, _ in picked], [huff[t >> 4] for _, t in picked], [huff[0x10 | t & 15] for _, t in picked], restart, data[at:end])
            seen, at = seen + len(picked), end


def _lookup(spec: bytes) -> np.ndarray:
    """For the next 16 bits: code length << 8 | symbol; 0 where there is no such code."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            first = code << (16 - n)
            out[first : first + (1 << (16 - n))] = n << 8 | spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segments(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing, and where each restart segment starts in it (and the last ends)."""
    raw = np.frombuffer(scan.data, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.empty(0, np.int64)
    after = raw[ff + 1] if len(ff) else np.empty(0, np.uint8)
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    place = np.concatenate(([0], np.cumsum(keep)))
    return raw[keep], np.concatenate(([0], place[marks], [place[-1]])).astype(np.int64)


def _lockstep(word, luts, dc, ac, pos, last, first) -> np.ndarray:
    """Coefficients of all segments, each of which takes a symbol a step."""
    per = len(dc)
    coef = np.zeros(int(first[-1]) * 64, np.int16)
    base, stop = first[:-1] * 64, first[1:] * 64
    k = np.zeros(len(pos), np.int64)  # place in the block
    while len(pos):
        at = pos >> 3
        peek = word[at] >> (16 - (pos & 7)).astype(np.uint32) & 0xFFFF
        if per == 1:
            which = np.where(k == 0, dc[0], ac[0])
        else:
            block = (base >> 6) % per  # within the MCU
            which = np.where(k == 0, dc[block], ac[block])
        found = luts[which + peek]
        length, symbol = found >> 8, found & 0xFF
        if (length == 0).any() or (pos > last).any():
            raise ValueError("a scan is damaged")
        pos = pos + length
        size = symbol & 15
        run = np.where(k == 0, 0, symbol >> 4)
        value = _extra(word, pos, size)
        pos = pos + size
        zrl = (k > 0) & (size == 0) & (run == 15)
        eob = (k > 0) & (size == 0) & (run < 15)
        k = k + run
        put = size > 0
        if (k[put] > 63).any():
            raise ValueError("a block is too long")
        coef[(base + k)[put]] = value[put]
        k = k + 1
        k[eob] = 64
        over = k > 63
        if (zrl & over & (k > 64)).any():
            raise ValueError("a block is too long")
        if over.any():
            base = np.where(over, base + 64, base)
            k[over] = 0
            live = base < stop
            if not live.all():
                pos, last, base, stop, k = (x[live] for x in (pos, last, base, stop, k))
    return coef


def _extra(word, pos, size) -> np.ndarray:
    """The signed values of the ``size`` bits from each position on; 0 for none."""
    extra = ((word[pos >> 3] << (pos & 7).astype(np.uint32)) >> 16 >> (16 - size).astype(np.uint32)).astype(np.int64)
    value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
    value[size == 0] = 0
    return value


#: Bits of a scan that are looked at together, from all of which decoding starts at once.
WINDOW = 1 << 17


def _chased(word, luts, dc, ac, pos, last, first) -> np.ndarray:
    """Coefficients of segments one after another: each window's symbols by array operations, and the
    chain of those that count by following where each ends."""
    coef = np.zeros(int(first[-1]) * 64, np.int16)
    tables = sorted({*dc.tolist(), *ac.tolist()})
    rank = {t: i for i, t in enumerate(tables)}
    dcs, acs, per = [rank[t] for t in dc.tolist()], [rank[t] for t in ac.tolist()], len(dc)
    for at, end, block, stop in zip(pos.tolist(), last.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
        k, done = 0, block  # place in the block; blocks finished
        while done < stop:
            if at > end:
                raise ValueError("a scan is damaged")
            low, high = at, min(at + WINDOW, end + 1)
            bits = np.arange(low, high)
            peek = word[bits >> 3] >> (16 - (bits & 7)).astype(np.uint32) & 0xFFFF
            ends, skips, founds = [], [], []
            for t in tables:
                found = luts[t + peek]
                size, run = found & 15, found >> 4 & 15
                # what an AC symbol skips: run and its own place; 80 ends a block, 116 are sixteen zeros
                skip = np.where(size > 0, run + 1, np.where(run == 15, 116, 80))
                skip[found == 0] = 0
                founds.append(found)
                ends.append((bits + (found >> 8) + size).tolist())
                skips.append(skip.tolist())
            where, heads, whose = [], [], []
            while at < high and done < stop:
                t = dcs[done % per] if k == 0 else acs[done % per]
                skip, ends_t = skips[t], ends[t]
                if k == 0:
                    if not skip[at - low]:
                        raise ValueError("a scan is damaged")
                    where.append(done * 64)
                    heads.append(at)
                    whose.append(t)
                    at, k = ends_t[at - low], 1
                    continue
                while at < high:
                    s = skip[at - low]
                    if 0 < s < 17:
                        k += s
                        if k > 64:
                            raise ValueError("a block is too long")
                        where.append(done * 64 + k - 1)
                        heads.append(at)
                        whose.append(t)
                    elif s == 80:
                        k = 64
                    elif s == 116:
                        k += 16
                        if k > 64:
                            raise ValueError("a block is too long")
                    else:
                        raise ValueError("a scan is damaged")
                    at = ends_t[at - low]
                    if k == 64:
                        k, done = 0, done + 1
                        break
            heads, whose = np.array(heads, np.int64), np.array(whose, np.int64)
            found = np.stack(founds)[whose, heads - low] if len(heads) else np.empty(0, np.int64)
            coef[np.array(where, np.int64)] = _extra(word, heads + (found >> 8), found & 15)
        if at > end:
            raise ValueError("a scan is damaged")
    return coef


#: Scans of fewer segments are followed bit by bit.
FEW = 128


def decode_scans(images: list[Image]) -> list[np.ndarray]:
    """The quantized coefficients of images whose scans share tables, layout of the MCU and restart
    interval: for each an int16 array (MCUs, blocks of an MCU, 64), in zigzag order, DC differences summed up."""
    kinds, scan = images[0].blocks(), images[0].scan
    per = len(kinds)
    tables = sorted({*scan.dc, *scan.ac})
    luts = np.concatenate([_lookup(t) for t in tables])
    dc = np.array([tables.index(scan.dc[k]) << 16 for k in kinds])
    ac = np.array([tables.index(scan.ac[k]) << 16 for k in kinds])
    datas, starts, ends, mcus, shift = [], [], [], [], 0
    for im in images:
        data, cuts = _segments(im.scan)
        across, down = im.mcus()
        each = im.scan.restart or across * down
        n = -(-across * down // each)
        if len(cuts) - 1 != n:
            raise ValueError("restart segments are missing")
        datas += [data]
        starts.append(cuts[:-1] + shift)
        ends.append(cuts[1:] + shift)
        mcus.append(np.minimum(each, across * down - each * np.arange(n)))
        shift += len(data)
    flat = np.concatenate([*datas, np.zeros(8, np.uint8)]).astype(np.uint32)
    word = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]
    start, end, mcus = map(np.concatenate, (starts, ends, mcus))
    first = np.concatenate(([0], np.cumsum(mcus * per)))  # of a segment's blocks
    coef = (_chased if len(start) < FEW else _lockstep)(word, luts, dc, ac, start * 8, end * 8, first)
    blocks = coef.reshape(-1, per, 64)
    # differences of DC are summed up within a segment, for each component on its own
    head = np.repeat(first[:-1] // per, mcus)
    for comp in sorted(set(kinds)):
        mine = [j for j, c in enumerate(kinds) if c == comp]
        run_ = np.cumsum(blocks[:, mine, 0].astype(np.int64).ravel())
        before = np.concatenate(([0], run_))[head * len(mine)]
        blocks[:, mine, 0] = run_.reshape(-1, len(mine)) - before[:, None]
    sizes = [im.mcus()[0] * im.mcus()[1] for im in images]
    return np.split(blocks, np.cumsum(sizes)[:-1])


def thumbnail(image: Image, coefs: np.ndarray) -> np.ndarray:
    """The luminance at an eighth of the size, from DC coefficients alone."""
    across, down = image.mcus()
    _, h, v, q = image.comps[0]
    if len(image.scan.comps) == 1:
        h = v = 1
    mine = [j for j, c in enumerate(image.blocks()) if image.scan.comps[c] == 0]
    dc = coefs[:, mine, 0].astype(np.int64).reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    wide, high = image.size_of(0)
    return np.clip((dc[:high, :wide] * int(image.quant[q][0]) + 4) // 8 + 128, 0, 255).astype(np.uint8)


def hashes(thumb: np.ndarray) -> tuple[str, str]:
    """(SHA-1 of the thumbnail, difference hash of it at 9 x 8)."""
    rows, cols = np.arange(8) * thumb.shape[0] // 8, np.arange(9) * thumb.shape[1] // 9
    small = thumb[rows][:, cols].astype(np.int16)
    return hashlib.sha1(np.array(thumb.shape, "<u4").tobytes() + thumb.tobytes()).hexdigest(), np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


DAMAGE = (ValueError, IndexError, KeyError)


def decode_all(files: list[bytes]) -> list[tuple[Image, np.ndarray] | str]:
    """Each file's image and coefficients, or what is wrong with it."""
    out: list = [None] * len(files)
    alike = defaultdict(list)
    for i, f in enumerate(files):
        try:
            image = parse(f or b"")
            scan = image.scan
            alike[tuple(c[1:3] for c in image.comps), tuple(scan.comps), *scan.dc, *scan.ac, scan.restart].append((i, image))
        except DAMAGE as e:
            out[i] = str(e) or "damaged"
    for group in alike.values():
        try:
            for (i, image), c in zip(group, decode_scans([im for _, im in group]), strict=True):
                out[i] = (image, c)
        except DAMAGE:
            for i, image in group:  # one is damaged: each on its own
                try:
                    out[i] = (image, decode_scans([image])[0])
                except DAMAGE as e:
                    out[i] = str(e) or "damaged"
    return out


def payload_of(image: Image, coefs: np.ndarray) -> bytes:
    """The bytes that ``encode_payloads`` stored."""
    n = int(image.comment.removeprefix(b"payload "))
    flat = coefs.ravel()[:n]
    return np.where(flat > 0, flat, flat + 255).astype(np.uint8).tobytes()


#: Bytes of files that are decoded together.
TOGETHER = 3 << 20


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text in a JPEG."""
    small_batches(docs.sparkSession, rows=500, size="4m")

    def run(batches):
        for x in batches:
            ids, texts = x.column(0), x.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size, part = at, 0, []
                while end < len(texts) and size < TOGETHER:
                    part.append(padded(texts[end]))
                    size += len(part[-1])
                    end += 1
                n = pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts[at:end]], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), n, pa.array(encode_payloads(part), pa.binary())], names=["id", "n_bytes", "media"])
                at = end

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, n_bytes long, media binary")


def media_features(media: DataFrame, payloads: bool = False) -> DataFrame:
    """For rows (id, n_bytes, media): dimensions, thumbnail and its hashes, and what was stored in it:
    (id, n_bytes, width, height, thumbnail, thumb_sha1, dhash, error, media_bytes, media_sha256,
    payload_bytes, payload_sha256, tail_crc32, payload)."""
    small_batches(media.sparkSession, rows=500, size="4m")
    kinds = {"id": "long", "n_bytes": "long", "width": "int", "height": "int", "thumbnail": "binary", "thumb_sha1": "string", "dhash": "string", "error": "string", "media_bytes": "long", "media_sha256": "string", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "payload": "binary"}
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(k, types[v]) for k, v in kinds.items()])

    def row(i, n, data, got):
        out = {"id": i, "n_bytes": n, "media_bytes": len(data or b""), "media_sha256": hashlib.sha256(data or b"").hexdigest()}
        if isinstance(got, str):
            return out | {"error": got}
        image, coefs = got
        thumb = thumbnail(image, coefs)
        sha, dhash = hashes(thumb)
        out |= {"width": image.width, "height": image.height, "thumbnail": thumb.tobytes(), "thumb_sha1": sha, "dhash": dhash}
        if image.comment.startswith(b"payload "):
            p = payload_of(image, coefs)
            out |= {"payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-16:]), "payload": p if payloads else None}
        return out

    def run(batches):
        for x in batches:
            rows = list(zip(*(x.column(c).to_pylist() for c in range(3)), strict=True))
            at = 0
            while at < len(rows):
                end, size = at, 0
                while end < len(rows) and size < TOGETHER:
                    size += len(rows[end][2] or b"")
                    end += 1
                got = decode_all([r[2] for r in rows[at:end]])
                yield pa.RecordBatch.from_pylist([row(*r, g) for r, g in zip(rows[at:end], got, strict=True)], schema)
                at = end

    return media.select("id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def op7_jpeg_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_features(stored(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(";", F.concat_ws("x", "width", "height"), "thumb_sha1", "dhash")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
