"""Progressive JPEG: scans of spectral selection and successive approximation are accumulated into coefficient arrays, which numpy
transforms back to samples; chroma is upsampled and full-resolution RGB tensors are stored.

Entropy-coded data is decoded in lock step: a lane is the part of a scan between two restart markers, and one numpy step decodes the next symbol of every
lane of every image of a group. Correction bits of refinement scans do not steer the decoding, so their places are noted and all of them are applied at once.

`encode_payload` is the inverse for tests and for the query: bytes become quantised coefficients (the unit of this format that is stored without
loss) of a 4:2:0 image with restart markers. A null payload counts as empty. Media that are not whole progressive JPEGs give nulls and an
error text, never an exception.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, map_arrow

UNIT, GROUP_BYTES = 192, 2 << 20


def zigzag() -> np.ndarray:
    """Natural index of each zigzag index."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else -c[0]))
    return np.array([8 * y + x for y, x in cells])


def inverse_transform() -> np.ndarray:
    """Zigzag coefficients to samples, in units of 2^-14 so that float64 products of integers are exact in any order."""
    x, u = np.arange(8), np.arange(8)
    one = np.cos((2 * x[:, None] + 1) * u[None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    two = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)
    return np.rint(two[zigzag()] * (1 << 14))


TRANSFORM = inverse_transform()


# ---------------------------------------------------------------- parsing


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    rows: int = 0  # of the padded grid of blocks
    columns: int = 0
    used_rows: int = 0
    used_columns: int = 0
    first: int = 0  # first block in the group's coefficient array


@dataclass
class Scan:
    components: list[int]
    low: int
    high: int
    before: int
    shift: int
    dc: list[bytes]
    ac: list[bytes]
    restart: int
    data: bytes


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quantisers: dict[int, np.ndarray]
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""


#: Neither a stuffed byte nor a restart marker.
NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


class BadMedia(ValueError):
    """Not a progressive JPEG that can be decoded whole."""


def parse(media: bytes) -> Image:
    """Marker segments and entropy-coded data of one image."""
    if media[:2] != b"\xff\xd8":
        raise BadMedia("no start of image")
    at, image, huffman, restart, comment, quantisers = 2, None, {}, 0, b"", {}
    while True:
        if at + 4 > len(media):
            if media[at : at + 2] == b"\xff\xd9":
                break
            raise BadMedia("cut off")
        if media[at] != 0xFF:
            raise BadMedia("marker expected")
        kind = media[at + 1]
        if kind == 0xD9:
            break
        if kind == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", media, at + 2)[0]
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide, width = body[0] >> 4, 128 if body[0] >> 4 else 64
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + width], ">u2" if wide else "u1").astype(np.float64)
                body = body[1 + width :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif kind == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if not (width and height and n in (1, 3)):
                raise BadMedia("frame not supported")
            image = Image(width, height, parts, quantisers)
            lay_grid(image)
        elif kind in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise BadMedia("not a progressive Huffman frame")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xFE:
            comment = bytes(body)
        elif kind == 0xDA:
            if image is None:
                raise BadMedia("scan before frame")
            n = body[0]
            names = [c.ident for c in image.components]
            chosen = [names.index(body[1 + 2 * k]) for k in range(n)]
            tables = [body[2 + 2 * k] for k in range(n)]
            low, high, approximation = body[1 + 2 * n : 4 + 2 * n]
            found = NEXT_MARKER.search(media, at)
            if not found:
                raise BadMedia("scan cut off")
            end = found.start()
            image.scans.append(Scan(chosen, low, high, approximation >> 4, approximation & 15, [huffman.get(t >> 4, b"") for t in tables], [huffman.get(16 | (t & 15), b"") for t in tables], restart, media[at:end]))
            at = end
    if image is None or not image.scans:
        raise BadMedia("no image data")
    image.comment = comment
    return image


def lay_grid(image: Image) -> None:
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    across, down = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
    for c in image.components:
        c.rows, c.columns = down * c.v, across * c.h
        c.used_rows = -(-(-(-image.height * c.v // most_v)) // 8)
        c.used_columns = -(-(-(-image.width * c.h // most_h)) // 8)


def scan_blocks(image: Image, scan: Scan) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in order, the scan's component of each, and blocks in a minimum coded unit."""
    shape = tuple((c.first - image.components[0].first, c.rows, c.columns, c.used_rows, c.used_columns, c.h, c.v) for c in (image.components[k] for k in scan.components))
    cells, which, unit = (few_blocks if sum(x[1] * x[2] for x in shape) < 2000 else block_order)(shape)
    return cells + image.components[0].first, which, unit


def block_order(shape: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, np.ndarray, int]:
    if len(shape) == 1:
        first, _, columns, used_rows, used_columns, _, _ = shape[0]
        cells = first + np.arange(used_rows)[:, None] * columns + np.arange(used_columns)[None]
        return cells.reshape(-1), np.zeros(cells.size, np.int64), 1
    parts, which = [], []
    for place, (first, rows, columns, _, _, h, v) in enumerate(shape):
        grid = first + np.arange(rows * columns).reshape(rows // v, v, columns // h, h)
        parts.append(grid.transpose(0, 2, 1, 3).reshape(-1, h * v))
        which += [place] * (h * v)
    cells = np.concatenate(parts, axis=1)
    return cells.reshape(-1), np.tile(which, len(cells)), cells.shape[1]


few_blocks = lru_cache(2000)(block_order)


# ---------------------------------------------------------------- entropy decoding in lock step


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead, 256 * code length + symbol; length 17 where no code fits."""
    out = np.full(1 << 16, 17 << 8, np.int32)
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class Tables:
    """Lookups of all Huffman tables seen, end to end."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.all = np.zeros(0, np.int32)

    def __call__(self, table: bytes) -> int:
        if table not in self.place:
            if len(table) < 17:
                raise BadMedia("scan without a table")
            if len(self.place) >= 64:  # a stream of images with tables of their own
                self.place, self.all = {}, np.zeros(0, np.int32)
            self.place[table] = len(self.all)
            self.all = np.concatenate([self.all, lookup(table)])
        return self.place[table]


@dataclass
class Lanes:
    """One scan of each of several images, cut at restart markers."""

    ahead: np.ndarray  # 24 bits from each byte on
    at: np.ndarray  # bit position of each lane
    end: np.ndarray  # bit position where each lane's data ends
    block: np.ndarray  # first place in `blocks`
    stop: np.ndarray
    blocks: np.ndarray
    scan: np.ndarray  # the lane's entry in the lists below
    which: np.ndarray  # component within the scan, along `blocks`


def gather(images: list[Image], scans: list[Scan]) -> Lanes:
    """All entropy-coded data end to end without stuffed bytes and markers, and where each lane begins in it."""
    raw = np.frombuffer(b"".join([s.data for s in scans]) + b"\xff", np.uint8)
    after = np.flatnonzero(raw[:-1] == 0xFF) + 1
    follower = raw[after]
    marks = after[(follower >= 0xD0) & (follower <= 0xD7)]
    kept = np.ones(len(raw) - 1, bool)
    kept[after[follower == 0]] = False
    kept[marks] = kept[marks - 1] = False
    before = np.concatenate([[0], np.cumsum(kept)])
    begins = np.concatenate([[0], np.cumsum([len(s.data) for s in scans])])
    starts = np.sort(np.concatenate([begins[:-1], marks + 1]))
    ends = np.append(starts[1:], len(raw) - 1)
    owner = np.searchsorted(begins, starts, "right") - 1
    blocks, which, first, stop = [], [], [], []
    done = 0
    lanes = np.bincount(owner, minlength=len(scans))
    for image, scan, n in zip(images, scans, lanes.tolist(), strict=True):
        cells, parts, unit = scan_blocks(image, scan)
        each = scan.restart * unit if scan.restart else len(cells)
        if n != -(-len(cells) // each):
            raise BadMedia("restart markers missing")
        first.append(np.arange(n) * each + done)
        stop.append(np.minimum(first[-1] + each, done + len(cells)))
        blocks.append(cells)
        which.append(parts)
        done += len(cells)
    data = np.concatenate([raw[:-1][kept], np.full(8, 0xFF, np.uint8)]).astype(np.int32)
    ahead = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return Lanes(ahead, before[starts] * 8, before[ends] * 8, np.concatenate(first), np.concatenate(stop), np.concatenate(blocks), owner, np.concatenate(which))


def peek(lanes: Lanes, at: np.ndarray) -> np.ndarray:
    """The next 16 bits. Positions behind a lane's end occur only in damaged data, which the decoders notice there."""
    at = np.minimum(at, len(lanes.ahead) * 8 - 1)
    return (lanes.ahead[at >> 3] >> (8 - (at & 7)).astype(np.int32)) & 0xFFFF


def signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Value of so many extra bits: those that begin with 0 are negative."""
    return np.where(bits >> np.maximum(size - 1, 0) == 0, bits - (1 << size) + 1, bits) * (size > 0)


def decode_dc(coefficients: np.ndarray, lanes: Lanes, scans: list[Scan], tables: Tables, offsets: list[list[int]]) -> None:
    at, place = lanes.at.copy(), lanes.block.copy()
    shift, refine = np.array([s.shift for s in scans])[lanes.scan], scans[0].before > 0
    spread = max(len(s.components) for s in scans)
    table = np.array([o + [0] * (spread - len(o)) for o in offsets])[lanes.scan]
    last = np.zeros((len(at), spread), np.int64)
    while len(live := np.flatnonzero(place < lanes.stop)):
        block, now = lanes.blocks[place[live]], at[live]
        if refine:
            coefficients[block, 0] |= (peek(lanes, now) >> 15) << shift[live]
            at[live] += 1
        else:
            part = lanes.which[place[live]]
            found = tables.all[table[live, part] + peek(lanes, now)]
            size = found & 255
            now = now + (found >> 8)
            last[live, part] += signed(peek(lanes, now) >> (16 - size), size)
            at[live] = now + size
            coefficients[block, 0] = last[live, part] << shift[live]
        place[live] += 1
    if (at > lanes.end).any():
        raise BadMedia("scan data cut off")


def decode_ac_first(coefficients: np.ndarray, lanes: Lanes, scans: list[Scan], tables: Tables, offsets: list[list[int]]) -> None:
    flat = coefficients.reshape(-1)
    of = lambda values: np.array(values, np.int64)[lanes.scan]
    low, high, shift, table = of([s.low for s in scans]), of([s.high for s in scans]), of([s.shift for s in scans]), of([o[0] for o in offsets])
    at, place, stop, end, k = lanes.at, lanes.block, lanes.stop, lanes.end, low
    while len(at):
        found = tables.all[table + peek(lanes, at)].astype(np.int64)
        symbol = found & 255
        run, size = symbol >> 4, symbol & 15
        at = at + (found >> 8)
        value = size > 0
        extra = np.where(value, size, np.where(run < 15, run, 0))
        bits = peek(lanes, at) >> (16 - extra)
        at = at + extra
        k = k + run
        if (k[value] > 63).any() or (at > end).any():
            raise BadMedia("scan data cut off")
        flat[lanes.blocks[place[value]] * 64 + k[value]] = signed(bits[value], size[value]) << shift[value]
        over = ~value & (run < 15)
        k = np.where(over, 64, k + 1)
        ended = k > high
        if ended.any():
            place = place + np.where(over, 1 << np.minimum(run, 14), 1) * ended + np.where(over, bits, 0)
            k = np.where(ended, low, k)
            going = place < stop
            if not going.all():
                at, place, stop, end, k, low, high, shift, table = (x[going] for x in (at, place, stop, end, k, low, high, shift, table))


def decode_ac_refine(coefficients: np.ndarray, lanes: Lanes, scans: list[Scan], tables: Tables, offsets: list[list[int]]) -> None:
    of = lambda values: np.array(values, np.int64)[lanes.scan]
    low, high, shift, table = of([s.low for s in scans]), of([s.high for s in scans]), of([s.shift for s in scans]), of([o[0] for o in offsets])
    # per block: zeros of history before each index, and the index of each such zero
    own = coefficients[lanes.blocks]
    zero = own == 0
    before = np.zeros((len(own), 65), np.int8)
    np.cumsum(zero, axis=1, out=before[:, 1:])
    where = np.full((len(own), 65), 64, np.int8)
    r, c = np.nonzero(zero)
    where[r, before[r, c]] = c
    low0, high0 = scans[0].low, scans[0].high
    fixes: list[tuple[np.ndarray, ...]] = []  # (place, from index, to index, bit position, shift): correction bits of nonzero history
    fresh: list[tuple[np.ndarray, ...]] = []
    at, place, stop, end, k, left = lanes.at, lanes.block, lanes.stop, lanes.end, low, np.zeros(len(lanes.at), np.int64)
    while len(at):
        need = left == 0
        found = tables.all[table + peek(lanes, at)].astype(np.int64)
        symbol = found & 255
        run, size = symbol >> 4, symbol & 15
        at = np.where(need, at + (found >> 8), at)
        over = need & (size == 0) & (run < 15)
        bits = peek(lanes, at)
        at = at + np.where(over, run, np.where(need & (size > 0), 1, 0))
        left = np.where(over, (1 << np.minimum(run, 14)) + (bits >> (16 - np.minimum(run, 15))), left)
        skipping = left > 0
        target = np.where(skipping, 64, where[place, np.minimum(before[place, k] + run, 64)].astype(np.int64))
        to = np.minimum(target, high + 1)
        n = to - k - (before[place, to].astype(np.int64) - before[place, k])
        if (at + n > end).any():
            raise BadMedia("scan data cut off")
        fixes.append((place, k, to, at, shift))
        at = at + n
        new = ~skipping & (size > 0)
        if (new & (target > high)).any():
            raise BadMedia("coefficient beyond its band")
        fresh.append((place[new], target[new], np.where(bits[new] >> 15 == 1, 1, -1) << shift[new]))
        k = to + 1
        ended = skipping | (k > high)
        if ended.any():
            left = np.where(skipping, left - 1, left)
            place = place + ended
            k = np.where(ended, low, k)
            going = place < stop
            if not going.all():
                at, place, stop, end, k, left, low, high, shift, table = (x[going] for x in (at, place, stop, end, k, left, low, high, shift, table))
    for block, start, to, bit, by in fixes:
        length = to - start
        # blocks that are nonzero throughout the whole band take one bit each, in a row
        full = (start == low0) & (to == high0 + 1) & (before[block, to] == before[block, start])
        if full.any():
            spot = bit[full][:, None] + np.arange(high0 + 1 - low0)
            add = ((lanes.ahead[spot >> 3] >> (23 - (spot & 7)).astype(np.int32)) & 1) << by[full][:, None].astype(np.int32)
            band = own[block[full], low0 : high0 + 1]
            own[block[full], low0 : high0 + 1] = band + np.where(band < 0, -add, add)
        some = np.flatnonzero((length > 0) & ~full)
        if not len(some):
            continue
        rows = np.repeat(some, length[some])
        index = np.arange(len(rows)) - np.repeat(np.cumsum(length[some]) - length[some], length[some]) + start[rows]
        touched = ~zero[block[rows], index]
        rows, index = rows[touched], index[touched]
        spot = bit[rows] + (index - start[rows]) - (before[block[rows], index].astype(np.int64) - before[block[rows], start[rows]])
        add = ((lanes.ahead[spot >> 3] >> (23 - (spot & 7)).astype(np.int32)) & 1) << by[rows]
        own[block[rows], index] += (np.sign(own[block[rows], index]) * add).astype(own.dtype)
    for block, index, value in fresh:
        own[block, index] = value
    coefficients[lanes.blocks] = own


def accumulate(images: list[Image], tables: Tables) -> np.ndarray:
    """Coefficients [block, zigzag index] of all images of a group; scans of like kind and rank run in lock step."""
    total = 0
    for image in images:
        for c in image.components:
            c.first = total
            total += c.rows * c.columns
    coefficients = np.zeros((total, 64), np.int32)
    for rank in range(max(len(i.scans) for i in images)):
        kinds: dict[tuple, list[Image]] = {}
        for image in images:
            if rank < len(image.scans):
                s = image.scans[rank]
                kinds.setdefault((s.low == 0, s.before > 0), []).append(image)
        for (dc, refine), members in kinds.items():
            scans = [i.scans[rank] for i in members]
            if dc and any(s.high for s in scans) or not dc and any(len(s.components) > 1 or s.high > 63 for s in scans):
                raise BadMedia("scan parameters not allowed")
            offsets = [[0] if dc and refine else [tables(t) for t in (s.dc if dc else s.ac)] for s in scans]
            run = decode_dc if dc else decode_ac_refine if refine else decode_ac_first
            run(coefficients, gather(members, scans), scans, tables, offsets)
    return coefficients


# ---------------------------------------------------------------- samples


def tensor(image: Image, samples: np.ndarray) -> np.ndarray:
    """Full-resolution RGB [height, width, 3] from the group's samples [block, 64]."""
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        plane = samples[c.first : c.first + c.rows * c.columns].reshape(c.rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.columns * 8)
        if (c.h, c.v) != (most_h, most_v):
            plane = plane.repeat(most_v // c.v, axis=0).repeat(most_h // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=2)
    y, blue, red = (p.astype(np.int32) for p in planes)
    blue, red = blue - 128, red - 128
    half = 1 << 15
    # the customary conversion, with factors in units of 2^-16
    rgb = np.stack([y + ((91881 * red + half) >> 16), y - ((22554 * blue + 46802 * red + half) >> 16), y + ((116130 * blue + half) >> 16)], axis=2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def inverse(images: list[Image], coefficients: np.ndarray) -> np.ndarray:
    """Samples [block, 64] of a group as bytes."""
    out = np.empty(coefficients.shape, np.uint8)
    spans = [(c.first, c.rows * c.columns, i.quantisers[c.table]) for i in images for c in i.components]
    scaled = coefficients.astype(np.float64)
    for first, n, quantiser in spans:
        if (quantiser != 1).any():
            scaled[first : first + n] *= quantiser
    for at in range(0, len(out), 1 << 14):
        out[at : at + (1 << 14)] = np.clip(np.floor(scaled[at : at + (1 << 14)] @ TRANSFORM / (1 << 14) + 128.5), 0, 255)
    return out


def decode_group(media: list[bytes], tables: Tables) -> list[tuple[Image, np.ndarray, np.ndarray] | str]:
    """(image, coefficients, tensor) of each medium, or why it can't be decoded."""
    parsed: list[Image | str] = []
    for m in media:
        try:
            parsed.append(parse(m))
        except (BadMedia, IndexError, ValueError, struct.error) as e:
            parsed.append(str(e) or "malformed")
    good = [p for p in parsed if isinstance(p, Image)]
    if not good:
        return parsed
    try:
        coefficients = accumulate(good, tables)
    except (BadMedia, IndexError, ValueError) as e:
        if len(media) == 1:
            return [str(e) or "malformed"]
        return [decode_group([m], tables)[0] for m in media]  # find out which one
    samples = inverse(good, coefficients)
    return [p if isinstance(p, str) else (p, coefficients, tensor(p, samples)) for p in parsed]


# ---------------------------------------------------------------- encoding


def huffman_table(tiers: list[tuple[int, list[int]]]) -> bytes:
    """Table body from (code length, symbols)."""
    count = [0] * 16
    for length, symbols in tiers:
        count[length - 1] = len(symbols)
    return bytes(count) + bytes(s for _, symbols in tiers for s in symbols)


#: Short codes for what text makes: sizes 3, 4 and 6 without a run, then the other sizes and the end of a block.
COMMON, OFTEN = [0x04, 0x03, 0x06], [0x00, 0x01, 0x02, 0x05, 0x07, 0x08, 0x11, 0x14]
AC_TABLE = huffman_table([(3, COMMON), (5, OFTEN), (10, [s for s in range(256) if (s & 15 in range(11) or s == 0xF0) and s not in COMMON + OFTEN])])
DC_TABLE = huffman_table([(4, list(range(12)))])


def codes_of(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, at, value, length = 0, 16, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            value[table[at]], length[table[at]] = code, n
            code, at = code + 1, at + 1
        code <<= 1
    return value, length


AC_CODE, AC_LENGTH = codes_of(AC_TABLE)
DC_CODE, DC_LENGTH = codes_of(DC_TABLE)


def pack(code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of codes as bytes, filled up with ones; and the number of bytes of each row."""
    bits = length.sum(axis=1)
    padded = np.concatenate([length, (-bits % 8)[:, None]], axis=1)
    filled = np.concatenate([code, np.full((len(code), 1), 0xFF, np.uint64)], axis=1)
    flat = padded.reshape(-1)
    some = np.flatnonzero(flat)
    n = flat[some]
    # most codes fit 32 bits, which halves what is moved
    kind = np.uint32 if n.max() <= 32 else np.uint64
    rest = (np.repeat(np.cumsum(n).astype(np.int32), n) - np.arange(1, int(n.sum()) + 1, dtype=np.int32)).astype(np.uint8)
    bit = (np.repeat(filled.reshape(-1)[some].astype(kind), n) >> rest).astype(np.uint8) & np.uint8(1)
    return np.packbits(bit), (bits + 7) // 8


def marked(stream: np.ndarray, row_bytes: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """The scan data of each image, of which `rows` tells the rows: stuffed bytes, and restart markers between rows."""
    ends = np.cumsum(row_bytes)
    final = np.cumsum(rows)
    marks = np.ones(len(ends), bool)
    marks[final - 1] = False
    wide = 1 + (stream == 0xFF)
    stuffed = wide > 1
    wide[ends[marks] - 1] += 2
    out = np.repeat(stream, wide)
    upto = np.cumsum(wide)
    out[(upto - wide)[stuffed] + 1] = 0
    at = upto[ends[marks] - 1]
    number = np.arange(len(ends)) - np.repeat(final - rows, rows)
    out[at - 2], out[at - 1] = 0xFF, 0xD0 | (number[marks] & 7)
    whole, cuts = out.tobytes(), upto[ends[final - 1] - 1].tolist()
    return [whole[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


#: Values of a coefficient or of a difference lie within this; tables are indexed by value + REACH.
REACH = 512
SIZE = np.frexp(np.abs(np.arange(-REACH, REACH + 1)).astype(np.float64))[1].astype(np.int64)


def sizes(value: np.ndarray) -> np.ndarray:
    return SIZE[value + REACH]


def extra_bits(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < 0, value + (1 << size) - 1, value).astype(np.uint64)


#: Code and length of each value without a run ahead of it; zero has none.
PLAIN_LENGTH = np.where(SIZE > 0, AC_LENGTH[SIZE] + SIZE, 0)
PLAIN_CODE = AC_CODE[SIZE] << SIZE.astype(np.uint64) | extra_bits(np.arange(-REACH, REACH + 1), SIZE)


def encode_dc_first(blocks: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows are restart intervals [interval, block]: differences within a component start afresh in each; here a unit of 4 + 1 + 1 blocks."""
    value = blocks[..., 0] >> shift
    step = value.copy()
    step[:, 1:4] -= value[:, 0:3]
    size = sizes(step)
    return DC_CODE[size] << size.astype(np.uint64) | extra_bits(step, size), DC_LENGTH[size] + size


def encode_ac_first(blocks: np.ndarray, low: int, high: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    band = blocks[:, low : high + 1]
    value = np.sign(band) * (np.abs(band) >> shift)
    n, width = value.shape
    there = value != 0
    index = np.where(there, np.arange(width, dtype=np.int8), np.int8(-1))
    last = np.maximum.accumulate(np.concatenate([np.full((n, 1), -1, np.int8), index], axis=1), axis=1)
    code, length = PLAIN_CODE[value + REACH], PLAIN_LENGTH[value + REACH]
    r, c = np.nonzero(there & (last[:, :-1] != np.arange(-1, width - 1, dtype=np.int8)))
    if len(r):  # zeros ahead
        run, size = c - last[r, c] - 1, sizes(value[r, c])
        symbol = (run & 15) << 4 | size
        own, long = AC_CODE[symbol] << size.astype(np.uint64) | extra_bits(value[r, c], size), AC_LENGTH[symbol] + size
        for k in range(1, 4):  # runs of sixteen zeros ahead of the symbol
            longer = run >> 4 >= k
            own[longer] |= AC_CODE[0xF0] << long[longer].astype(np.uint64)
            long[longer] += AC_LENGTH[0xF0]
        code[r, c], length[r, c] = own, long
    ended = last[:, -1] < width - 1
    return np.concatenate([code, np.full((n, 1), AC_CODE[0], np.uint64)], axis=1), np.concatenate([length, np.where(ended, AC_LENGTH[0], 0)[:, None]], axis=1)


def encode_ac_refine(blocks: np.ndarray, low: int, high: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    band = blocks[:, low : high + 1]
    size = np.abs(band) >> shift
    n, width = band.shape
    old, new, zero = size > 1, size == 1, size == 0
    # still-zero coefficients since the last new one; each sixteenth with a new one behind it is a symbol of its own
    zeros = np.cumsum(zero, axis=1)
    base = np.maximum.accumulate(np.where(new, zeros, 0), axis=1)
    since = zeros - np.concatenate([np.zeros((n, 1), zeros.dtype), base[:, :-1]], axis=1)
    later = np.flip(np.maximum.accumulate(np.flip(new, axis=1), axis=1), axis=1)
    long = zero & (since % 16 == 0) & (since > 0) & later
    head = new | long
    symbol = np.where(long, 0xF0, (since % 16) << 4 | 1)
    sign = (band > 0).astype(np.uint64)
    code = np.where(new, AC_CODE[symbol] << np.uint64(1) | sign, np.where(long, AC_CODE[0xF0], (size & 1).astype(np.uint64)))
    length = np.where(new, AC_LENGTH[symbol] + 1, np.where(long, AC_LENGTH[0xF0], old.astype(np.int64)))
    ended = ~head[:, -1]
    code = np.concatenate([np.full((n, 1), AC_CODE[0], np.uint64), code], axis=1)
    length = np.concatenate([np.where(ended, AC_LENGTH[0], 0)[:, None], length], axis=1)
    mixed = np.flatnonzero(head.any(axis=1))
    if len(mixed):  # a symbol precedes the correction bits of the coefficients that it passes
        part = np.cumsum(head[mixed], axis=1)
        order = np.where(head[mixed], (part - 1) * 256, part * 256 + 1 + np.arange(width))
        order = np.concatenate([part[:, -1:] * 256, order], axis=1).argsort(axis=1, kind="stable")
        code[mixed], length[mixed] = np.take_along_axis(code[mixed], order, 1), np.take_along_axis(length[mixed], order, 1)
    return code, length


#: (components, low, high, before, shift)
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), *(((c,), a, b, 0, 1) for c in range(3) for a, b in ((1, 5), (6, 63))), ((0, 1, 2), 0, 0, 1, 0), *(((c,), 1, 63, 1, 0) for c in range(3))]


def segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def dimensions(n_units: int) -> tuple[int, int]:
    """Coded units across and down for so many half units of 192 bytes: narrow strips."""
    whole = -(-n_units // 2)
    across = -(-whole // 4095)
    return across, -(-whole // across)


def raster(component: int, across: int, down: int) -> np.ndarray:
    """Places in payload order (unit, block of the unit) of a component's blocks in scan order."""
    unit = np.arange(across * down).reshape(down, across)
    if component:
        return (unit * 6 + 3 + component).reshape(-1)
    cells = unit[:, None, :, None] * 6 + np.arange(4).reshape(1, 2, 1, 2)
    return cells.reshape(-1)


def encode_payload(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload, whose length is a positive multiple of 192. Byte b is stored as coefficient b - 128."""
    if any(not p or len(p) % UNIT for p in payloads):
        raise ValueError("payloads are positive multiples of 192 bytes")
    shape = [dimensions(len(p) // UNIT) for p in payloads]
    filled = [p + bytes([128]) * (a * d * 2 * UNIT - len(p)) for p, (a, d) in zip(payloads, shape, strict=True)]
    blocks = (np.frombuffer(b"".join(filled), np.uint8).astype(np.int32) - 128).reshape(-1, 64)
    units = np.array([a * d for a, d in shape])
    first = np.concatenate([[0], np.cumsum(units)])
    parts: list[list[bytes]] = [[] for _ in payloads]
    for components, low, high, before, shift in SCRIPT:
        if low == 0:
            rows = blocks.reshape(-1, 6, 64)
            if before:
                code, length = (rows[..., 0] >> shift & 1).astype(np.uint64), np.ones(rows.shape[:2], np.int64)
            else:
                code, length = encode_dc_first(rows, shift)
            coded, per = [pack(code, length)], units
        else:
            c = components[0]
            order = np.concatenate([f * 6 + raster(c, a, d) for f, (a, d) in zip(first[:-1].tolist(), shape, strict=True)])
            coded = []
            for at in range(0, len(order), 1 << 14):
                coded.append(pack(*(encode_ac_refine if before else encode_ac_first)(blocks[order[at : at + (1 << 14)]], low, high, shift)))
            per = units * (1 if c else 4)
        head = segment(0xDA, bytes([len(components), *(x for c in components for x in (c + 1, 0)), low, high, before << 4 | shift]))
        for out, data in zip(parts, marked(*(np.concatenate(x) for x in zip(*coded, strict=True)), per), strict=True):
            out += [head, data]
    begin = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([1]) * 64) + segment(0xC4, bytes([0]) + DC_TABLE + bytes([16]) + AC_TABLE) + segment(0xDD, struct.pack(">H", 1))
    made = []
    for out, (a, d), p in zip(parts, shape, payloads, strict=True):
        frame = segment(0xC2, struct.pack(">BHHB", 8, d * 16, a * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        made.append(begin + segment(0xFE, b"payload=%d" % len(p)) + frame + b"".join(out) + b"\xff\xd9")
    return made


def read_payload(image: Image, coefficients: np.ndarray) -> bytes:
    """The bytes that encode_payload stored, from the decoded coefficients."""
    across, down = image.components[1].columns, image.components[1].rows
    out = np.empty((across * down * 6, 64), np.uint8)
    for k, c in enumerate(image.components):
        out[raster(k, across, down)] = coefficients[c.first : c.first + c.rows * c.columns] + 128
    return out.tobytes()[: int(image.comment.removeprefix(b"payload="))]


# ---------------------------------------------------------------- operators


def grouped(media: list[bytes]) -> list[list[int]]:
    """Consecutive media in groups of bounded bytes; a larger one stands alone."""
    groups: list[list[int]] = [[]]
    size = 0
    for k, m in enumerate(media):
        if groups[-1] and size + len(m) > GROUP_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(k)
        size += len(m)
    return groups


def feature_of(pixels: np.ndarray) -> str:
    """Size and channel sums of a tensor, in whole numbers."""
    sums = pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{pixels.shape[1]}x{pixels.shape[0]} rgb {sums[0]} {sums[1]} {sums[2]}"


def decode_tensors(df: DataFrame, key: str, media: str) -> DataFrame:
    """(key, width, height, tensor, feature, error): full-resolution RGB of each medium, row after row; null media are malformed."""
    kind = df.select(key).dtypes[0][1]

    def make():
        tables = Tables()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            all_media = as_bytes(batch.column(1))
            rows: list[tuple] = []
            for group in grouped(all_media):
                for found in decode_group([all_media[k] for k in group], tables):
                    rows.append((None, None, None, None, found) if isinstance(found, str) else (found[0].width, found[0].height, found[2].tobytes(), feature_of(found[2]), None))
            columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            return pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [key, "width", "height", "tensor", "feature", "error"])

        return each

    return map_arrow(df.select(key, media), make, f"{key} {kind}, width int, height int, tensor binary, feature string, error string")


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded with blanks to whole units, as a progressive JPEG."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(batch.column(1))
            whole = [padded(t) for t in texts]
            media = [m for group in grouped(whole) for m in encode_payload([whole[k] for k in group])]
            return pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

        return each

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, media binary")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(stored: DataFrame) -> DataFrame:
    """Digests of stored media, of the payload read back from them and of their tensors."""

    def make():
        tables = Tables()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            media = as_bytes(batch.column(2))
            rows = []
            for group in grouped(media):
                for k, found in zip(group, decode_group([media[k] for k in group], tables), strict=True):
                    if isinstance(found, str):
                        raise BadMedia(found)
                    payload = read_payload(found[0], found[1])
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media[k]), hashlib.sha256(media[k]).hexdigest(), feature_of(found[2])))
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

        return each

    return map_arrow(stored.select("doc_id", "n_bytes", "media"), make, DIGESTS)
