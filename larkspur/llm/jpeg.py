"""Media columns: a baseline JPEG codec in numpy, with DC-only luminance thumbnails.

``decode`` parses the markers of a baseline (SOF0) file, Huffman-decodes its scans, whether they hold all components or
some, and returns the quantised coefficients of every block; ``thumbnail`` turns the luminance DC terms into one pixel a block. Scans with many
restart intervals are decoded a symbol at a time over all intervals at once; others bit by bit.

``pack`` stores any bytes losslessly in this format's own unit: 64 bytes are the 64 quantised coefficients (signed,
in zigzag order) of one 8x8 block of a grey image, with a restart interval of one block. Blocks that fill up the
last row are zero; an APP4 segment holds the number of bytes stored.

A null or malformed file decodes to null; equal files give equal values, repeated rows stay, and an empty table gives
an empty one. Columns that have the name of one that is made are replaced. In ``op10`` a null text counts as empty.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm._store import read_table, ship
from larkspur.llm._text import raw_bytes, slices

UNIT = 64
_TAG = b"LARK"
_BATCH = 1 << 20


# -- tables by rule ---------------------------------------------------------------------------------------------
#: Code lengths: 4 bits for DC sizes, for AC symbols without a run and for end of block; 9 bits for all others.
_DC_SYMBOLS = [*range(12)]
_AC_SHORT = [*range(11)]
_AC_LONG = [run * 16 + size for run in range(1, 16) for size in range(11) if size or run == 15]


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _dht(cls: int, groups: dict[int, list[int]]) -> bytes:
    return _segment(0xC4, bytes([cls << 4]) + bytes(len(groups.get(n, [])) for n in range(1, 17)) + b"".join(bytes(groups[n]) for n in sorted(groups)))


_OWN_TABLES = _dht(0, {4: _DC_SYMBOLS}) + _dht(1, {4: _AC_SHORT, 9: _AC_LONG})


def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), as the standard derives them."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = code, length
            code += 1
        at += n
        code <<= 1
    return out


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits the length of the code that they begin with, times 256, plus its symbol; 0 if there is none."""
    table = np.zeros(1 << 16, np.int64)
    for s, (code, length) in _codes(counts, symbols).items():
        first = code << (16 - length)
        table[first : first + (1 << (16 - length))] = length << 8 | s
    return table


@lru_cache(maxsize=1)
def _own_codes() -> tuple[np.ndarray, ...]:
    dc = _codes(bytes([0, 0, 0, 12] + [0] * 12), bytes(_DC_SYMBOLS))
    ac = _codes(bytes([0, 0, 0, len(_AC_SHORT), 0, 0, 0, 0, len(_AC_LONG)] + [0] * 7), bytes(_AC_SHORT + _AC_LONG))
    out = []
    for table in (dc, ac):
        code, length = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
        for s, (c, n) in table.items():
            code[s], length[s] = c, n
        out += [code, length]
    return tuple(out)


# -- storing ----------------------------------------------------------------------------------------------------
def _grid(n_blocks: int) -> tuple[int, int]:
    columns = math.isqrt(n_blocks - 1) + 1
    return columns, -(-n_blocks // columns)


_SIZE = np.array([abs(v).bit_length() for v in range(-128, 128)], np.uint64)


def pack(payloads: list[bytes]) -> list[bytes]:
    """A grey JPEG for each payload; its length must be a positive multiple of 64."""
    if not payloads:
        return []
    grids = [_grid(len(p) // UNIT) for p in payloads]
    if max(g[0] for g in grids) > 8191:
        raise ValueError("a payload is too long for one image")
    data = b"".join(p + bytes(UNIT * (c * r) - len(p)) for p, (c, r) in zip(payloads, grids, strict=True))
    blocks = np.frombuffer(data, np.int8).reshape(-1, UNIT)
    n = len(blocks)
    dc_code, dc_len, ac_code, ac_len = _own_codes()
    words = np.zeros((n, 40), np.uint32)
    acc, held, at = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    run = np.zeros(n, np.int64)
    one, full = np.uint64(1), np.uint64(32)

    def put(rows, code, length):
        acc[rows] = (acc[rows] << length) | code
        held[rows] += length

    def flush():
        ready = np.flatnonzero(held >= full)
        if len(ready):
            words[ready, at[ready]] = (acc[ready] >> (held[ready] - full)) & np.uint64(0xFFFFFFFF)
            at[ready] += 1
            held[ready] -= full

    everything = slice(None)
    for k in range(UNIT):
        v = blocks[:, k].astype(np.int64)
        size = _SIZE[v + 128]
        bits = np.where(v < 0, v + (1 << size.astype(np.int64)) - 1, v).astype(np.uint64)
        if k == 0:
            put(everything, (dc_code[size.astype(np.int64)] << size) | bits, dc_len[size.astype(np.int64)] + size)
            continue
        zero = v == 0
        if zero.any():
            rows = np.flatnonzero(~zero)
            for _ in range(3):
                far = rows[run[rows] > 15]
                if not len(far):
                    break
                put(far, ac_code[0xF0], ac_len[0xF0])
                flush()
                run[far] -= 16
            symbol, size, bits = run[rows] * 16 + size[rows].astype(np.int64), size[rows], bits[rows]
            run += 1
            run[rows] = 0
        else:
            rows, symbol = everything, run * 16 + size.astype(np.int64)
            if run.any():
                for _ in range(3):
                    far = np.flatnonzero(run > 15)
                    if not len(far):
                        break
                    put(far, ac_code[0xF0], ac_len[0xF0])
                    flush()
                    run[far] -= 16
                symbol = run * 16 + size.astype(np.int64)
                run[:] = 0
        put(rows, (ac_code[symbol] << size) | bits, ac_len[symbol] + size)
        flush()
    put(np.flatnonzero(run > 0), ac_code[0], ac_len[0])
    flush()
    pad = (np.uint64(8) - held % np.uint64(8)) % np.uint64(8)
    put(everything, (one << pad) - one, pad)
    flush()
    words[np.arange(n), at] = (acc << (full - held)) & np.uint64(0xFFFFFFFF)
    length = at * 4 + (held // np.uint64(8)).astype(np.int64)
    raw = words.astype(">u4").view(np.uint8).reshape(n, -1)
    flat = raw[np.arange(raw.shape[1]) < length[:, None]]
    # Zero after each 0xFF, and a marker after each block: restart, or end of image after the last one.
    ff = flat == 0xFF
    block = np.repeat(np.arange(n), length)
    to = np.arange(len(flat)) + np.cumsum(ff) - ff + 2 * block
    ends = np.cumsum(length + np.bincount(block[ff], minlength=n) + 2)
    stream = np.zeros(int(ends[-1]), np.uint8)
    stream[to] = flat
    counts = np.array([c * r for c, r in grids])
    last = np.cumsum(counts)
    index = np.arange(n) - np.repeat(last - counts, counts)
    stream[ends - 2] = 0xFF
    stream[ends - 1] = 0xD0 + index % 8
    stream[ends[last - 1] - 1] = 0xD9
    scans, out, begin = stream.tobytes(), [], 0
    for p, (c, r), end in zip(payloads, grids, ends[last - 1], strict=True):
        head = (
            b"\xff\xd8" + _segment(0xE4, _TAG + struct.pack(">Q", len(p))) + _segment(0xDB, bytes(1) + b"\x01" * 64)
            + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * r, 8 * c, 1, 1, 0x11, 0)) + _OWN_TABLES
            + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
        )
        out.append(head + scans[begin:end])
        begin = int(end)
    return out


# -- reading ----------------------------------------------------------------------------------------------------
@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0
    rows: int = 0
    columns: int = 0
    blocks: np.ndarray | None = None


@dataclass
class Jpeg:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    restart: int = 0
    stored: int | None = None
    scan: bytes = b""
    #: The largest sampling factors of the frame, and each scan as an image of its own where there are several.
    most: tuple[int, int] = (1, 1)
    scans: list[Jpeg] = field(default_factory=list)

    def shape(self) -> tuple:
        """Files of one shape can be decoded side by side."""
        return (
            self.restart, tuple((c.h, c.v, self.tables[0, c.dc], self.tables[1, c.ac]) for c in self.components)
        )


def parse(data: bytes) -> Jpeg:
    """The segments up to and with the scan of all components, or all scans of some of them."""
    out, at = Jpeg(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if out.scans and data[at : at + 2] == b"\xff\xd9":
            if {c.ident for s in out.scans for c in s.components} != {c.ident for c in out.components}:
                raise ValueError("a component is missing")
            return out
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                counts = body[1:17]
                n = sum(counts)
                out.tables[body[0] >> 4, body[0] & 15] = counts, body[17 : 17 + n]
                body = body[17 + n :]
        elif kind == 0xC0:
            bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not out.width or not out.height:
                raise ValueError("not an 8-bit image of known size")
            out.components = [Component(i, hv >> 4, hv & 15, q) for i, hv, q in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
            if not out.components or any(not c.h or not c.v for c in out.components):
                raise ValueError("a component without size")
            out.most = max(c.h for c in out.components), max(c.v for c in out.components)
        elif 0xC1 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("not a baseline file")
        elif kind == 0xDD:
            (out.restart,) = struct.unpack(">H", body)
        elif kind == 0xE4 and body.startswith(_TAG):
            (out.stored,) = struct.unpack_from(">Q", body, 4)
        elif kind == 0xDA:
            named = {c.ident: c for c in out.components}
            order = []
            for i in range(body[0]):
                c = named[body[1 + 2 * i]]
                c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                order.append(c)
            if len(order) == len(out.components):
                out.scan = data[at:]
                return out
            end = at
            while (end := data.find(b"\xff", end)) >= 0 and data[end + 1 : end + 2] and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 2
            if end < 0:
                raise ValueError("a scan without an end")
            out.scans.append(_part(out, order, data[at:end] + b"\xff\xd9"))
            at = end


def _part(whole: Jpeg, order: list[Component], scan: bytes) -> Jpeg:
    """One scan as an image: a single component's blocks are those that it has pixels for, without padding."""
    width, height = whole.width, whole.height
    if len(order) == 1:
        width, height = -(-width * order[0].h // whole.most[0]), -(-height * order[0].v // whole.most[1])
    return Jpeg(width, height, [replace(c) for c in order], whole.quant, dict(whole.tables), whole.restart, scan=scan, most=whole.most)


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and markers, the first byte of each interval, and the codes of the
    markers that end them."""
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[ff + 1]
    stuffed, markers = ff[after == 0], ff[(after >= 0xD0) & (after <= 0xD9) & (after != 0xD8)]
    keep = np.ones(len(scan), bool)
    keep[stuffed + 1] = keep[markers] = keep[markers + 1] = False
    kept_before = np.cumsum(keep)
    return scan[keep], np.concatenate([[0], kept_before[markers]]), scan[markers + 1]


def _windows(data: np.ndarray) -> np.ndarray:
    """The 64 bits from each byte on; after the end come ones, then zeros."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    n, out = len(data) + 8, np.zeros(len(data) + 8, np.uint64)
    for j in range(8):
        out |= padded[j : j + n] << np.uint64(56 - 8 * j)
    return out


def _extend(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)


def _decode_many(windows: np.ndarray, pos: np.ndarray, blocks: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """One block of every interval: pos are bit positions; blocks takes the coefficients. Returns the new positions."""
    top = np.int64(len(windows) * 8 - 64)

    def read(at, table):
        win = windows[at >> 3] << (at & 7).astype(np.uint64)
        entry = table[(win >> np.uint64(48)).astype(np.int64)]
        length, symbol = entry >> 8, entry & 255
        if not length.all() or (at > top).any():
            raise ValueError("a code that no table has")
        size = symbol & 15
        value = (win << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)
        return at + length + size, symbol, size, _extend(value.astype(np.int64), size)

    pos, _, _, value = read(pos, dc)
    blocks[:, 0] = value
    rows, k = np.arange(len(pos)), np.ones(len(pos), np.int64)
    at = pos.copy()
    while len(rows):
        at, symbol, size, value = read(at, ac)
        k += symbol >> 4
        some = size > 0
        if (k[some] > 63).any():
            raise ValueError("a block of more than 64 coefficients")
        if some.all():
            blocks[rows, k] = value
        else:
            blocks[rows[some], k[some]] = value[some]
        k += 1
        done = (symbol == 0) | (k > 63)
        if done.any():
            pos[rows[done]] = at[done]
            go = ~done
            rows, k, at = rows[go], k[go], at[go]
    return pos


def _decode_one(windows: np.ndarray, pos: int, block: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> int:
    k, table = 0, dc
    while k < 64:
        if pos >> 3 >= len(windows):
            raise ValueError("the scan ends early")
        win = (int(windows[pos >> 3]) << (pos & 7)) & 0xFFFFFFFFFFFFFFFF
        entry = int(table[win >> 48])
        length, run, size = entry >> 8, (entry >> 4) & 15, entry & 15
        if not length:
            raise ValueError("a code that no table has")
        pos += length + size
        if k and not size and run < 15:
            break
        k += run if k else 0
        if size:
            if k > 63:
                raise ValueError("a block of more than 64 coefficients")
            v = (win >> (64 - length - size)) & ((1 << size) - 1)
            block[k] = v if v >> (size - 1) else v - (1 << size) + 1
        k, table = k + 1, ac
    return pos


def _lay_out(images: list[Jpeg]) -> None:
    for j in images:
        hmax, vmax = j.most
        single = len(j.components) == 1
        for c in j.components:
            if single:
                c.h = c.v = 1
                hmax = vmax = 1
            c.columns, c.rows = c.h * -(-j.width // (8 * hmax)), c.v * -(-j.height // (8 * vmax))


def decode(files: list[bytes | None]) -> list[Jpeg | None]:
    """Each file with the quantised coefficients, in zigzag order, of each component's blocks."""
    out: list[Jpeg | None] = [None] * len(files)
    shapes: dict[tuple, list[int]] = {}
    for i, data in enumerate(files):
        try:
            j = parse(data) if data else None
            if j and j.scans:
                _decode_scans(j)
                out[i] = j
            elif j:
                _lay_out([j])
                shapes.setdefault(j.shape(), []).append(i)
                out[i] = j
        except (ValueError, KeyError, IndexError, struct.error):
            out[i] = None
    for (restart, parts), members in shapes.items():
        try:
            _decode_group([out[i] for i in members], restart, parts)
        except (ValueError, IndexError):  # one of them is malformed
            for i in members:
                try:
                    _decode_group([out[i]], restart, parts)
                except (ValueError, IndexError):
                    out[i] = None
    return out


def _decode_scans(j: Jpeg) -> None:
    own = {c.ident: c for c in j.components}
    for part in j.scans:
        _lay_out([part])
        restart, shape = part.shape()
        _decode_group([part], restart, shape)
        for c in part.components:
            own[c.ident].blocks, own[c.ident].rows, own[c.ident].columns = c.blocks, c.rows, c.columns


def _decode_group(images: list[Jpeg], restart: int, parts: tuple) -> None:
    scan = np.frombuffer(b"".join(j.scan for j in images), np.uint8)
    data, first, marks = _intervals(scan)
    windows = _windows(data)
    # How many minimum coded units each interval holds, image after image.
    units, owner = [], []
    for n, j in enumerate(images):
        c = j.components[0]
        total = (c.columns // c.h) * (c.rows // c.v)
        step = restart or total
        own = [step] * (total // step) + ([total % step] if total % step else [])
        units += own
        owner += [n] * len(own)
    if len(marks) < len(units) or (restart and (marks[np.flatnonzero(np.diff(np.array([*owner, -1])))] != 0xD9).any()):
        raise ValueError("intervals are missing")
    pattern = [p for p, (h, v, _, _) in enumerate(parts) for _ in range(h * v)]
    tables = [(_lookup(*dc), _lookup(*ac)) for _, _, dc, ac in parts]
    units_of = np.array(units)
    starts = np.cumsum(units_of) - units_of
    store = np.zeros((int(units_of.sum()), len(pattern), 64), np.int16)
    if len(units) < 16:
        for i, n in enumerate(units):
            pos, before = int(first[i]) * 8, [0] * len(parts)
            for u in range(n):
                for b, p in enumerate(pattern):
                    block = store[starts[i] + u, b]
                    pos = _decode_one(windows, pos, block, *tables[p])
                    before[p] = block[0] = before[p] + int(block[0])
    else:
        pos = first[: len(units)].astype(np.int64) * 8
        before = np.zeros((len(parts), len(units)), np.int64)
        for u in range(int(units_of.max())):
            live = np.flatnonzero(units_of > u)
            for b, p in enumerate(pattern):
                block = np.zeros((len(live), 64), np.int16)
                pos[live] = _decode_many(windows, pos[live], block, *tables[p])
                before[p, live] += block[:, 0]
                block[:, 0] = before[p, live]
                store[starts[live] + u, b] = block
    at = 0
    for j in images:
        c0 = j.components[0]
        across, down = c0.columns // c0.h, c0.rows // c0.v
        own = store[at : at + across * down]
        at += across * down
        b = 0
        for c in j.components:
            part = own[:, b : b + c.h * c.v].reshape(down, across, c.v, c.h, 64)
            c.blocks = part.transpose(0, 2, 1, 3, 4).reshape(c.rows, c.columns, 64)
            b += c.h * c.v


def _blocks(pixels: int, factor: int, most: int) -> int:
    """Blocks in a row or column of a component."""
    return math.ceil(math.ceil(pixels * factor / most) / 8)


def thumbnail(j: Jpeg) -> np.ndarray:
    """One luminance pixel for each 8x8 block that the image has pixels in, from the DC terms only."""
    c = j.components[0]
    hmax, vmax = j.most if len(j.components) > 1 else (c.h, c.v)
    down, across = _blocks(j.height, c.v, vmax), _blocks(j.width, c.h, hmax)
    dc = c.blocks[:down, :across, 0].astype(np.int64) * j.quant[c.quant][0]
    return np.clip((dc + 4) // 8 + 128, 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: whether each cell of an 8x9 grid of means is less than the next in its row."""
    rows = [pixels[(r * len(pixels)) // 8 : max((r * len(pixels)) // 8 + 1, ((r + 1) * len(pixels)) // 8)].mean(0) for r in range(8)]
    grid = np.array([[row[(c * len(row)) // 9 : max((c * len(row)) // 9 + 1, ((c + 1) * len(row)) // 9)].mean() for c in range(9)] for row in rows])
    return f"{int(''.join('1' if x else '0' for x in (grid[:, :-1] < grid[:, 1:]).ravel()), 2):016x}"


def stored_payload(j: Jpeg) -> bytes | None:
    """The bytes that ``pack`` stored, from the decoded coefficients."""
    if j.stored is None:
        return None
    return j.components[0].blocks.astype(np.int8).tobytes()[: j.stored]


def features(j: Jpeg) -> dict:
    t = thumbnail(j)
    return {"width": j.width, "height": j.height, "components": len(j.components), "thumb_hash": difference_hash(t), "thumb_sha256": hashlib.sha256(t.tobytes()).hexdigest()}


# -- columns ----------------------------------------------------------------------------------------------------
def store_text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``media``: the text, zero-padded to a positive multiple of 64, as a JPEG."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), _BATCH):
                data, offsets = raw_bytes(part)
                raw = data.tobytes()
                own = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                media = pack([p + bytes(-len(p) % UNIT if p else UNIT) for p in own])
                yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array([len(p) for p in own], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                at += len(part)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Dimensions, thumbnail hashes and, of files that ``pack`` made, digests of the payload read back; all null
    where the file is null or malformed. Other columns stay."""
    ship(media.sparkSession)
    kinds = [("width", "int"), ("height", "int"), ("components", "int"), ("thumb_hash", "string"), ("thumb_sha256", "string"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string")]
    others = [c for c in media.columns if c != media_col and c not in dict(kinds)]
    arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, column = 0, batch.column(batch.schema.get_field_index(media_col))
            for part in slices(column, 2 * _BATCH):
                files, rows = part.to_pylist(), []
                for data, j in zip(files, decode(files), strict=True):
                    row = dict.fromkeys([k for k, _ in kinds])
                    if data is not None:
                        row |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
                    if j:
                        row |= features(j)
                        if (p := stored_payload(j)) is not None:
                            row |= {"payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-UNIT:])}
                    rows.append(row)
                made = [pa.array([r[k] for r in rows], arrow[t]) for k, t in kinds]
                kept = [batch.column(batch.schema.get_field_index(c)).slice(at, len(part)) for c in others]
                yield pa.record_batch(kept + made, names=others + [k for k, _ in kinds])
                at += len(part)

    schema = ", ".join([f"`{c}` {media.schema[c].dataType.simpleString()}" for c in others] + [f"{k} {t}" for k, t in kinds])
    return media.mapInArrow(run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    read = read_media(store_text_media(docs))
    return read.selectExpr(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        "concat_ws(':', concat(width, 'x', height), components, thumb_hash, left(thumb_sha256, 16)) AS feature",
    )
