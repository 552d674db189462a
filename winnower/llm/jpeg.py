"""Media columns: baseline JPEG, read and written in numpy.

``decode`` parses the markers of baseline images (grey or YCbCr, any Huffman
tables, with or without restart intervals) and Huffman-decodes their scans. All
restart intervals of all images of a batch are decoded in lockstep, one symbol of
each interval at a step, so that the work is vectorised however short one
interval is. The DC coefficients of the luminance give a thumbnail of an eighth of
the size, which is stored by its dimensions and hashes.

``encode_payload`` stores bytes losslessly: each byte is one quantised coefficient
(never 0, so that no run is needed), 64 of them in zigzag order make a block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnower.llm import common

BLOCK = 64
#: Blocks in a restart interval of the images that are written here.
INTERVAL = 8
#: Restart intervals worked on at once; this bounds the memory of a step.
LANES = 8192
#: Code lengths of (size of DC difference) and (size of AC coefficient; 0: end of block).
_DC_LENGTHS = {4: 3, 5: 3, 6: 3, 7: 3, 0: 4, 1: 4, 2: 4, 3: 4, 8: 4, 9: 5}
_AC_LENGTHS = {5: 2, 4: 2, 7: 3, 6: 4, 3: 4, 8: 4, 2: 5, 1: 6, 0: 6}


class BadImage(ValueError):
    pass


def _codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table as the standard assigns them."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if code >= 1 << length:
                raise BadImage("overfull Huffman table")
            out.append((symbols[k], code, length))
            code += 1
            k += 1
        code <<= 1
    return out


def _spec(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(v == n for v in lengths.values()) for n in range(1, 17)], symbols


def _lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16 bits ahead: length * 256 + symbol of the code they begin with; 0 for none."""
    out = np.zeros(1 << 16, dtype=np.int32)
    for symbol, code, length in _codes(counts, symbols):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + symbol
    return out


def _writer(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(16, np.int64), np.zeros(16, np.int64)
    for s, c, n in _codes(*_spec(lengths)):
        code[s], size[s] = c, n
    return code, size


_DC, _AC = _writer(_DC_LENGTHS), _writer(_AC_LENGTHS)
_SPAN = 256


def _written(table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each value from -_SPAN to _SPAN the bits it is written with, and how many."""
    v = np.arange(-_SPAN, _SPAN + 1)
    size = np.array([int(x).bit_length() for x in np.abs(v)])
    bits = (table[0][size] << size) | np.where(v > 0, v, v + (1 << size) - 1)
    return bits.astype(np.int32), (table[1][size] + size).astype(np.int32)


(_DC_BITS, _DC_TOTAL), (_AC_BITS, _AC_TOTAL) = _written(_DC), _written(_AC)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HUFFMAN = b"".join(bytes([kind, *counts, *symbols]) for kind, (counts, symbols) in ((0x00, _spec(_DC_LENGTHS)), (0x10, _spec(_AC_LENGTHS))))


def _header(n_bytes: int, wide: int, high: int) -> bytes:
    # a DC step of 8 makes the thumbnail's range that of the bytes
    return (
        b"\xff\xd8" + _segment(0xFE, b"payload-bytes=%d" % n_bytes) + _segment(0xDB, bytes([0, 8] + [1] * 63))
        + _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + bytes([1, 0x11, 0])) + _segment(0xC4, _HUFFMAN)
        + _segment(0xDD, struct.pack(">H", INTERVAL)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _scan_bytes(values: np.ndarray, filler: np.ndarray, interval_of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks of coefficients, and where each interval ends.

    ``filler``: blocks of zeros; ``interval_of``: the interval of each block, from 0,
    ascending; ``ends``: the two bytes that follow each interval.
    """
    v = values.reshape(-1, BLOCK).copy()
    dc = v[:, 0].copy()
    same = interval_of[1:] == interval_of[:-1]
    v[1:, 0] -= np.where(same, dc[:-1], 0)
    bits, total = _AC_BITS[v + _SPAN], _AC_TOTAL[v + _SPAN]
    bits[:, 0], total[:, 0] = _DC_BITS[v[:, 0] + _SPAN], _DC_TOTAL[v[:, 0] + _SPAN]
    total[filler, 2:] = 0
    bits[filler, 2:] = 0
    n = len(ends)
    first = np.searchsorted(interval_of, np.arange(n))
    own = np.add.reduceat(total.sum(1), first)
    whole = (own + 7) // 8
    starts = np.concatenate([[0], np.cumsum(whole)])
    # bit offsets: the running sum within an interval, from the interval's first byte
    flat = total.ravel()
    before = np.cumsum(flat, dtype=np.int64) - flat
    base = before[first * BLOCK]
    at = before - np.repeat(base - starts[:-1] * 8, np.diff(np.append(first, len(v))) * BLOCK)
    # whatever begins in one byte, 24 bits from its start, is summed (no bits overlap) and then laid down
    shifted = bits.ravel().astype(np.int64) << (24 - flat - (at & 7))
    begun = np.bincount(at >> 3, weights=shifted, minlength=int(starts[-1]) + 3).astype(np.int64)
    out = begun >> 16
    out[1:] += (begun[:-1] >> 8) & 255
    out[2:] += begun[:-2] & 255
    out = out[: starts[-1]].astype(np.uint8)
    out[starts[1:] - 1] |= ((1 << (whole * 8 - own)) - 1).astype(np.uint8)
    # a zero byte follows each 0xFF of the data, and two bytes each interval
    stuffed = out == 0xFF
    room = 1 + stuffed.astype(np.int64)
    room[starts[1:] - 1] += 2
    to = np.cumsum(room) - room
    full = np.zeros(int(room.sum()), dtype=np.uint8)
    full[to] = out
    stop = to[starts[1:] - 1] + room[starts[1:] - 1]
    full[stop - 2], full[stop - 1] = ends[:, 0], ends[:, 1]
    return full, stop


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """An image for each payload; its length must be a positive multiple of 64."""
    out: list[list[bytes]] = []
    runs = []  # (image, first interval, intervals, all intervals, its blocks, blocks with filler)
    for k, p in enumerate(payloads):
        if not p or len(p) % BLOCK:
            raise ValueError("a payload has a positive multiple of 64 bytes")
        n = len(p) // BLOCK
        wide = int(np.ceil(np.sqrt(n)))
        high = -(-n // wide)
        out.append([_header(len(p), wide, high)])
        intervals = -(-wide * high // INTERVAL)
        runs.extend((k, i, min(LANES, intervals - i), intervals, n, wide * high) for i in range(0, intervals, LANES))
    part, size = [], 0
    for r in runs:
        if part and size + r[2] > LANES:
            _encode_runs(part, payloads, out)
            part, size = [], 0
        part.append(r)
        size += r[2]
    if part:
        _encode_runs(part, payloads, out)
    return [b"".join(x) for x in out]


def _encode_runs(part: list, payloads: list[bytes], out: list[list[bytes]]) -> None:
    raw, lengths, data_blocks, filler_blocks, ends = [], [], [], [], []
    for k, i, n_intervals, intervals, n, blocks in part:
        lo, hi = i * INTERVAL, min((i + n_intervals) * INTERVAL, blocks)
        data = payloads[k][lo * BLOCK : min(hi, n) * BLOCK]
        raw += [data, bytes((hi - lo) * BLOCK - len(data))]
        data_blocks.append(len(data) // BLOCK)
        filler_blocks.append(hi - lo - len(data) // BLOCK)
        lengths.append(np.minimum(INTERVAL, hi - lo - INTERVAL * np.arange(n_intervals)))
        end = 0xD0 + (i + np.arange(n_intervals)) % 8
        if i + n_intervals == intervals:
            end[-1] = 0xD9
        ends.append(end)
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    values = np.where(b < 128, b - 128, b - 127)
    counts = np.stack([data_blocks, filler_blocks], axis=1).ravel()
    filler = np.repeat(np.tile([False, True], len(part)), counts)
    values.reshape(-1, BLOCK)[filler] = 0
    lengths, end = np.concatenate(lengths), np.concatenate(ends)
    full, stop = _scan_bytes(values, filler, np.repeat(np.arange(len(lengths)), lengths), np.stack([np.full(len(end), 0xFF), end], axis=1).astype(np.uint8))
    data, lo = full.tobytes(), 0
    for r, last in zip(part, np.cumsum([r[2] for r in part]) - 1, strict=True):
        out[r[0]].append(data[lo : stop[last]])
        lo = int(stop[last])


def payload_of(text: bytes) -> bytes:
    """``text`` with bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


@dataclass
class Image:
    """A baseline image: what its markers say, then its coefficients."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    components: list = field(default_factory=list)  # (id, h, v, quantisation, dc table, ac table)
    quantisation: dict = field(default_factory=dict)
    restart: int = 0
    layout: list[int] = field(default_factory=list)  # the component of each block of an MCU
    mcus: tuple[int, int] = (0, 0)
    intervals: list[bytes] = field(default_factory=list)  # unstuffed
    tables: dict = field(default_factory=dict)
    coefficients: np.ndarray | None = None  # (blocks in scan order, 64), in zigzag order


def parse(data: bytes) -> Image:
    """The markers of one image; BadImage for what isn't a whole baseline image."""
    if data[:2] != b"\xff\xd8":
        raise BadImage("no start of image")
    im, at = Image(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise BadImage("no marker")
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise BadImage("segment without its end")
        at += 2 + size
        try:
            if marker == 0xDA:
                _start_scan(im, body, data, at)
                return im
            _read_segment(im, marker, body)
        except (IndexError, KeyError, struct.error) as e:
            raise BadImage(f"bad segment {marker:02x}") from e


def _read_segment(im: Image, marker: int, body: bytes) -> None:
    if marker == 0xDB:
        k = 0
        while k < len(body):
            wide, name = body[k] >> 4, body[k] & 15
            step = 2 if wide else 1
            im.quantisation[name] = np.frombuffer(body[k + 1 : k + 1 + 64 * step], ">u2" if wide else np.uint8).astype(np.int64)
            if len(im.quantisation[name]) != 64:
                raise BadImage("short quantisation table")
            k += 1 + 64 * step
    elif marker == 0xC4:
        k = 0
        while k < len(body):
            counts = list(body[k + 1 : k + 17])
            n = sum(counts)
            if len(counts) < 16 or k + 17 + n > len(body):
                raise BadImage("short Huffman table")
            im.tables[body[k]] = (tuple(counts), tuple(body[k + 17 : k + 17 + n]))
            k += 17 + n
    elif marker == 0xDD:
        (im.restart,) = struct.unpack(">H", body)
    elif marker == 0xFE:
        im.comment = body
    elif marker in (0xC0, 0xC1):
        bits, im.height, im.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or not im.height or not im.width or not n:
            raise BadImage("not a baseline frame")
        im.components = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k], 0, 0] for k in range(n)]
    elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
        raise BadImage("not baseline")


def _start_scan(im: Image, body: bytes, data: bytes, at: int) -> None:
    if not im.components or body[0] != len(im.components):
        raise BadImage("a scan of some components only")
    for k in range(body[0]):
        c = next(c for c in im.components if c[0] == body[1 + 2 * k])
        c[4], c[5] = body[2 + 2 * k] >> 4, 0x10 | (body[2 + 2 * k] & 15)
        im.tables[c[4]], im.tables[c[5]], im.quantisation[c[3]]  # noqa: B018  KeyError: missing
    if len(im.components) == 1:
        im.layout, h, v = [0], 1, 1
    else:
        im.layout = [k for k, c in enumerate(im.components) for _ in range(c[1] * c[2])]
        h, v = max(c[1] for c in im.components), max(c[2] for c in im.components)
    if not h or not v:
        raise BadImage("bad sampling factors")
    im.mcus = -(-im.width // (8 * h)), -(-im.height // (8 * v))
    raw = np.frombuffer(data, np.uint8)[at:]
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    is_rst = (after >= 0xD0) & (after <= 0xD7)
    ends = ff[(after != 0) & (after != 0xFF) & ~is_rst]
    stop = int(ends[0]) if len(ends) else len(raw)
    keep = np.ones(stop, dtype=bool)
    zeros = ff[after == 0] + 1
    keep[zeros[zeros < stop]] = False
    lo = 0
    for cut in [*(int(x) for x in ff[is_rst] if x < stop), stop]:
        im.intervals.append(raw[lo:cut][keep[lo:cut]].tobytes())
        lo = cut + 2
    total = im.mcus[0] * im.mcus[1]
    if len(im.intervals) != (-(-total // im.restart) if im.restart else 1):
        raise BadImage("missing restart intervals")


def decode(images: list[Image]) -> None:
    """Huffman-decode the scans of parsed images into their coefficients.

    An image whose scan is damaged keeps None.
    """
    lookups: dict = {}
    lanes = []  # (image, first block, blocks, bytes)
    for k, im in enumerate(images):
        per = len(im.layout)
        total = im.mcus[0] * im.mcus[1]
        im.coefficients = np.zeros((total * per, BLOCK), dtype=np.int16)
        step = im.restart or total
        lanes.extend((k, i * step * per, min(step, total - i * step) * per, raw) for i, raw in enumerate(im.intervals))
    bad = set()
    for at in range(0, len(lanes), LANES):
        part = lanes[at : at + LANES]
        coefficients, failed = _lockstep(part, images, lookups)
        row = 0
        for j, (k, first, n, _) in enumerate(part):
            if failed[j]:
                bad.add(k)
            images[k].coefficients[first : first + n] = coefficients[row : row + n]
            row += n
    for k in bad:
        images[k].coefficients = None


def _lockstep(part: list, images: list[Image], lookups: dict) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(x[3] + bytes(8) for x in part)
    sizes = np.array([len(x[3]) + 8 for x in part])
    byte = np.frombuffer(raw + bytes(8), np.uint8).astype(np.uint64)
    ahead = np.zeros(len(raw), dtype=np.uint64)  # the 64 bits from each byte on
    for k in range(8):
        ahead |= byte[k : k + len(raw)] << np.uint64(56 - 8 * k)
    start = np.cumsum(sizes) - sizes
    end = (start + sizes - 8) * 8
    blocks = np.array([x[2] for x in part])
    base = (np.cumsum(blocks) - blocks) * BLOCK
    # each distinct pair of tables has a number; a lane knows them for each block of its MCU
    per = np.array([len(images[x[0]].layout) for x in part])
    wide = int(per.max())
    component, dc, ac = (np.zeros((len(part), wide), dtype=np.int64) for _ in range(3))
    stack: list[np.ndarray] = []
    number: dict = {}
    plans: dict = {}
    for j, (k, *_) in enumerate(part):
        if k not in plans:
            im = images[k]
            rows = [[], [], []]
            for c in im.layout:
                rows[0].append(c)
                for r, name in ((1, im.components[c][4]), (2, im.components[c][5])):
                    spec = im.tables[name]
                    if spec not in number:
                        if spec not in lookups:
                            lookups[spec] = _lookup(list(spec[0]), list(spec[1]))
                        number[spec] = len(stack)
                        stack.append(lookups[spec])
                    rows[r].append(number[spec])
            plans[k] = rows
        for array, row in zip((component, dc, ac), plans[k], strict=True):
            array[j, : len(row)] = row
    table = np.concatenate(stack)
    out = np.zeros(int(blocks.sum()) * BLOCK, dtype=np.int16)
    failed = np.zeros(len(part), dtype=bool)
    lane = np.flatnonzero(blocks > 0)
    pos, block, k = start * 8, np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    predicted = np.zeros((len(part), int(component.max()) + 1), dtype=np.int64)
    pos, block, k = pos[lane], block[lane], k[lane]
    while len(lane):
        bits = ahead[pos >> 3] << (pos & 7).astype(np.uint64)
        slot = block % per[lane]
        is_dc = k == 0
        which = np.where(is_dc, dc[lane, slot], ac[lane, slot])
        found = table[(which << 16) + (bits >> np.uint64(48)).astype(np.int64)]
        length, symbol = found >> 8, found & 255
        size = np.where(is_dc, symbol, symbol & 15)
        run = np.where(is_dc, 0, symbol >> 4)
        extra = (bits << length.astype(np.uint64)) >> np.uint64(1)
        value = (extra >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
        pos = pos + length + size
        d = np.flatnonzero(is_dc)
        own = lane[d]
        c = component[own, slot[d]]
        value[d] += predicted[own, c]
        predicted[own, c] = value[d]
        spot = k + run
        wrong = (length == 0) | (pos > end[lane]) | (~is_dc & (size > 0) & (spot > 63)) | (is_dc & (size > 11))
        write = (is_dc | (size > 0)) & ~wrong
        out[(base[lane] + block * BLOCK + spot)[write]] = value[write]
        k = np.where(is_dc | (size > 0), spot + 1, np.where(run == 15, k + 16, BLOCK))
        full = k >= BLOCK
        block = block + full
        k = np.where(full, 0, k)
        gone = wrong | (block >= blocks[lane])
        if gone.any():
            failed[lane[wrong]] = True
            stay = ~gone
            lane, pos, block, k = lane[stay], pos[stay], block[stay], k[stay]
    return out.reshape(-1, BLOCK), failed


def luminance(im: Image) -> np.ndarray:
    """The thumbnail: one pixel of 0 to 255 for each luminance block."""
    first = np.flatnonzero(np.array(im.layout) == 0)
    h, v = (im.components[0][1], im.components[0][2]) if len(im.components) > 1 else (1, 1)
    wide, high = im.mcus
    dc = im.coefficients[:, 0].reshape(high, wide, len(im.layout))[:, :, first]
    grid = dc.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h).astype(np.int64)
    grid = grid[: -(-im.height * v // (8 * max(c[2] for c in im.components))) if len(im.components) > 1 else None]
    step = int(im.quantisation[im.components[0][3]][0])
    return np.clip((grid * step + 4) // 8 + 128, 0, 255).astype(np.uint8)


def _resize(t: np.ndarray, n: int) -> np.ndarray:
    rows = np.arange(n) * t.shape[0] // n
    cols = np.arange(n) * t.shape[1] // n
    return t[np.ix_(rows, cols)]


def thumbnail_hashes(t: np.ndarray) -> tuple[str, str]:
    """An average hash of 8 x 8 nearest pixels, and a digest of the whole thumbnail."""
    small = _resize(t, 8).astype(np.int64)
    bits = np.packbits((small * 64 > small.sum()).ravel())
    return bits.tobytes().hex(), hashlib.sha256(struct.pack(">II", *t.shape) + t.tobytes()).hexdigest()[:16]


def feature(im: Image) -> str:
    average, digest = thumbnail_hashes(luminance(im))
    return f"{im.width}x{im.height}:{average}:{digest}"


def payload_in(im: Image) -> bytes:
    """The bytes that ``encode_payloads`` stored."""
    n = int(im.comment.partition(b"payload-bytes=")[2])
    v = im.coefficients.reshape(-1)[:n].astype(np.int64)
    return np.where(v < 0, v + 128, v + 127).astype(np.uint8).tobytes()


def store_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n_bytes, media): each whole text as an image; a null text is empty.

    Every row gives a row, also repeated ones and those with a null id; very long
    texts are one image each, an empty table gives none. Extra columns are dropped.
    """

    def run(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            media = encode_payloads([payload_of(t) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"), F.col(common.quoted(text)).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FEATURES = "width int, height int, thumb_width int, thumb_height int, thumb_hash string, thumb_digest string, feature string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"


def media_features(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` without its bytes, with dimensions, thumbnail hashes and digests.

    Null, empty or damaged images have an error and null features; images that
    store no payload have null payload columns. Equal images have equal features,
    repeated rows come back each; an empty table gives an empty result. Same-named
    columns are replaced, others pass through, whatever their names.
    """
    new = [f.split()[0] for f in _FEATURES.split(", ")]
    source, back = common.plainly(media, [column, *new], F.col(common.quoted(column)))
    schema = T.StructType([*source.schema.fields[:-1], *T._parse_datatype_string(_FEATURES).fields])
    types = [pa.int32()] * 4 + [pa.string()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            data = b.column(b.num_columns - 1).to_pylist()
            parsed: list[Image | str] = []
            for d in data:
                try:
                    parsed.append(parse(d or b""))
                except BadImage as e:
                    parsed.append(str(e))
            decode([im for im in parsed if isinstance(im, Image)])
            rows = [_describe(d, im) for d, im in zip(data, parsed, strict=True)]
            cols = zip(*rows, strict=True) if rows else [[] for _ in new]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*b.schema.names[:-1], *new])

    common.small_batches(media.sparkSession)
    return source.mapInArrow(run, schema).select(*back, *new)


def _describe(data: bytes | None, im: Image | str) -> tuple:
    size, sha = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
    if isinstance(im, str) or im.coefficients is None:
        return (None,) * 10 + (size, sha, im if isinstance(im, str) else "damaged scan")
    t = luminance(im)
    average, digest = thumbnail_hashes(t)
    payload = payload_in(im) if im.comment.startswith(b"payload-bytes=") else None
    own = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]))
    return (im.width, im.height, t.shape[1], t.shape[0], average, digest, f"{im.width}x{im.height}:{average}:{digest}", *own, size, sha, None)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` stored as images, read back and described."""
    stored = store_texts(common.table(spark, sf_dir, "documents"))
    return media_features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
