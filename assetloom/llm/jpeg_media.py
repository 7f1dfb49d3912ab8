"""Media columns as baseline JPEG: store payloads, parse, Huffman-decode, thumbnail, hash.

``store`` writes a payload losslessly: each byte is the DC coefficient of one 8x8 block (quantised by
8, so it is also the block's sample), 192 blocks to a row, one restart interval to a row. Payloads of
more than ``FRAME_ROWS`` rows become several images one after the other. ``read`` parses any baseline
JPEG (several components, subsampling, AC coefficients), decodes the scan of the luminance component
and rebuilds its DC-only thumbnail. Restart intervals of many images are decoded in step by numpy.

Defined results: null text counts as empty and, as any payload, is padded to a whole row; equal texts
give equal values whatever their batch; rows are independent, so ties, repeats and empty tables need
no care; bytes that aren't baseline JPEG raise ValueError in ``decode`` and give null features in
``read``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ROW = 192
FRAME_ROWS = 65535 // 8
#: Rows encoded or intervals decoded at once.
BATCH_ROWS = 8192

#: The usual luminance DC table (codes per length 1 to 16, then symbols), and a table of the end-of-block only.
DC_LENGTHS, DC_SYMBOLS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
AC_LENGTHS, AC_SYMBOLS = [1] + [0] * 15, [0]


def canonical(lengths: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table."""
    found, code, at = [], 0, 0
    for length, count in enumerate(lengths, 1):
        for _ in range(count):
            found.append((symbols[at], code, length))
            code += 1
            at += 1
        code <<= 1
    return found


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255, with the end of block."""
    table = {s: (c, n) for s, c, n in canonical(DC_LENGTHS, DC_SYMBOLS)}
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, length = table[size]
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        bits[diff + 255] = (((code << size) | extra) << 1)  # the end of block is a zero bit
        sizes[diff + 255] = length + size + 1
    return bits, sizes


_BITS, _SIZES = _diff_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"\xff\xd8" + b"".join(
        [
            _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            _segment(0xDB, bytes([0]) + bytes([8] * 64)),
            _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, bytes([0x00, *DC_LENGTHS, *DC_SYMBOLS])),
            _segment(0xC4, bytes([0x10, *AC_LENGTHS, *AC_SYMBOLS])),
            _segment(0xDD, struct.pack(">H", ROW)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def _encode_rows(samples: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows, each followed by a marker, and the rows' ends in them.

    ``starts``: row numbers at which an image starts.
    """
    values = samples.astype(np.int64) - 128
    diffs = np.diff(values, axis=1, prepend=0) + 255
    bits, sizes = _BITS[diffs], _SIZES[diffs]
    ends = np.cumsum(sizes, axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    row_at = np.concatenate([[0], np.cumsum(row_bytes)])
    begin = ends - sizes + (row_at[:-1] * 8)[:, None]
    index = (begin >> 3).ravel()
    placed = (bits << (24 - sizes - (begin & 7))).ravel()
    total = int(row_at[-1])
    data = np.zeros(total + 2, np.int64)
    for k in range(3):
        part = np.bincount(index, (placed >> (16 - 8 * k)) & 255, total + 2 - k)
        data[k:] += part.astype(np.int64)[: total + 2 - k]
    data = data[:total]
    data[row_at[1:] - 1] += (1 << (row_bytes * 8 - ends[:, -1])) - 1  # the rest of the last byte is ones
    stuffed = np.cumsum(data == 255)
    at = np.arange(total) + stuffed - (data == 255) + 2 * np.repeat(np.arange(len(samples)), row_bytes)
    out_ends = row_at[1:] + stuffed[row_at[1:] - 1] + 2 * np.arange(1, len(samples) + 1)
    out = np.zeros(out_ends[-1], np.uint8)
    out[at] = data
    first = np.zeros(len(samples), np.int64)
    first[starts] = starts
    number = np.arange(len(samples)) - np.maximum.accumulate(first)
    out[out_ends - 2] = 255
    out[out_ends - 1] = 0xD0 + number % 8
    last = np.append(starts[1:], len(samples)) - 1
    out[out_ends[last] - 1] = 0xD9
    return out, out_ends


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """JPEG bytes of payloads whose lengths are positive multiples of ROW."""
    frames = [(i, p[at : at + FRAME_ROWS * ROW]) for i, p in enumerate(payloads) for at in range(0, len(p), FRAME_ROWS * ROW)]
    out: list[list[bytes]] = [[] for _ in payloads]
    at = 0
    while at < len(frames):
        to, rows = at, 0
        while to < len(frames) and (to == at or rows + len(frames[to][1]) // ROW <= BATCH_ROWS):
            rows += len(frames[to][1]) // ROW
            to += 1
        group = frames[at:to]
        sizes = np.array([len(p) // ROW for _, p in group])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        data, ends = _encode_rows(np.frombuffer(b"".join(p for _, p in group), np.uint8).reshape(-1, ROW), starts)
        raw, cut = data.tobytes(), np.concatenate([[0], ends])
        for (i, _), start, size in zip(group, starts, sizes, strict=True):
            out[i] += [_header(int(size)), raw[cut[start] : cut[start + size]]]
        at = to
    return [b"".join(x) for x in out]


def parse(data: bytes) -> list[dict]:
    """The images in ``data``, one after the other: size, quantisation, components, tables and scans."""
    images: list[dict] = []
    at = 0
    try:
        while at < len(data):
            if data[at : at + 2] != b"\xff\xd8":
                raise ValueError("no JPEG start of image")
            at += 2
            image: dict = {"quant": {}, "huffman": {}, "restart": 0, "scans": []}
            while data[at + 1] != 0xD9:
                marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
                if data[at] != 255:
                    raise ValueError("no marker where one must be")
                if marker == 255:  # fill byte
                    at += 1
                    continue
                body = data[at + 4 : at + 2 + size]
                at += 2 + size
                if marker == 0xDB:
                    while body:
                        wide = body[0] >> 4
                        image["quant"][body[0] & 15] = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                        body = body[129 if wide else 65 :]
                elif marker in (0xC0, 0xC1):
                    image["height"], image["width"] = struct.unpack(">HH", body[1:5])
                    image["parts"] = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
                    if body[0] != 8 or not image["height"]:
                        raise ValueError("not 8-bit baseline")
                elif marker == 0xC4:
                    while body:
                        count = sum(body[1:17])
                        image["huffman"][body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + count]))
                        body = body[17 + count :]
                elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                    raise ValueError("not baseline")
                elif marker == 0xDD:
                    image["restart"] = int.from_bytes(body[:2], "big")
                elif marker == 0xDA:
                    end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
                    stop = end.start() if end else len(data)
                    image["scans"].append(([(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])], dict(image["huffman"]), image["restart"], (at, stop)))
                    at = stop
            at += 2
            images.append(image)
    except (IndexError, struct.error) as error:
        raise ValueError("cut-off JPEG") from error
    if not images:
        raise ValueError("no JPEG start of image")
    return images


def _lookup(table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits ahead: the symbol and the length of its code (0: none)."""
    symbols, sizes = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for symbol, code, length in canonical(list(table[0]), list(table[1])):
        low = code << (16 - length)
        symbols[low : low + (1 << (16 - length))] = symbol
        sizes[low : low + (1 << (16 - length))] = length
    return symbols, sizes


class _Bits:
    """Bit readers over many intervals, moved in step."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        padded = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint32)
        self.words = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        self.limit = len(self.words) - 1
        self.at = starts.astype(np.int64) * 8

    def ahead(self, rows=slice(None)) -> np.ndarray:
        at = self.at[rows]
        return (self.words[np.minimum(at >> 3, self.limit)] << (at & 7).astype(np.uint32)) >> np.uint32(16)

    def value(self, sizes: np.ndarray, rows=slice(None)) -> np.ndarray:
        """The signed values of so many bits, which are then passed."""
        raw = self.ahead(rows).astype(np.int64) >> (16 - sizes)
        self.at[rows] += sizes
        return np.where(raw < (1 << sizes >> 1), raw - (1 << sizes) + 1, raw)


def _plan(image: dict) -> tuple:
    """(blocks of one MCU as (is luminance, DC table, AC table), MCUs in all, intervals' length, grid) of the luminance scan."""
    if "parts" not in image:
        raise ValueError("no frame header")
    luminance = next(iter(image["parts"]))
    scan = next((s for s in image["scans"] if luminance in [c for c, _ in s[0]]), None)
    if scan is None:
        raise ValueError("no luminance scan")
    wide, high = max(h for h, _, _ in image["parts"].values()), max(v for _, v, _ in image["parts"].values())
    h, v, quant = image["parts"][luminance]
    columns, rows = -(-(-(-image["width"] * h // wide)) // 8), -(-(-(-image["height"] * v // high)) // 8)
    parts = scan[0]
    if len(parts) == 1:
        across, down, shape = columns, rows, [(1, 1)]
    else:
        across, down = -(-image["width"] // (8 * wide)), -(-image["height"] // (8 * high))
        shape = [image["parts"][c][:2] for c, _ in parts]
    blocks = tuple((c == luminance, scan[1][t >> 4], scan[1][16 | (t & 15)]) for (c, t), (x, y) in zip(parts, shape, strict=True) for _ in range(x * y))
    return blocks, across * down, scan[2] or across * down, (across, *shape[[c for c, _ in parts].index(luminance)], rows, columns), image["quant"][quant][0], scan[3]


def _decode_intervals(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, blocks: tuple) -> np.ndarray:
    """DC values of the luminance blocks, a row for each interval (all with the same MCU layout)."""
    reader = _Bits(data, starts)
    tables = {t: _lookup(t) for _, dc, ac in blocks for t in (dc, ac)}
    luminance = [i for i, b in enumerate(blocks) if b[0]]
    out = np.zeros((int(lengths.max()), len(luminance), len(starts)), np.int64)
    everything = bool((lengths == lengths[0]).all())
    for mcu in range(int(lengths.max())):
        rows = slice(None) if everything else np.flatnonzero(lengths > mcu)
        for i, (_, dc, ac) in enumerate(blocks):
            symbols, sizes = tables[dc]
            ahead = reader.ahead(rows)
            length = sizes[ahead]
            if not length.all():
                raise ValueError("no such Huffman code")
            reader.at[rows] += length
            diff = reader.value(symbols[ahead], rows)
            if i in luminance:
                out[mcu, luminance.index(i), rows] = diff
            symbols, sizes = tables[ac]
            within = rows
            k = 1
            while True:
                ahead = reader.ahead(within)
                symbol, length = symbols[ahead], sizes[ahead]
                if not length.all():
                    raise ValueError("no such Huffman code")
                reader.at[within] += length + (symbol & 15)  # AC values aren't needed, only passed
                if not symbol.any():
                    break
                k = k + np.where(symbol == 0xF0, 16, (symbol >> 4) + 1)
                on = (symbol != 0) & (k < 64)
                if not on.any():
                    break
                index = np.arange(len(starts)) if isinstance(within, slice) else within
                within, k = index[on], k[on]
    return out.reshape(-1, len(starts)).cumsum(axis=0).T


def decode_many(media: list[bytes]) -> list[np.ndarray | None]:
    """DC-only luminance thumbnails (one sample a block, images below each other); None where it isn't baseline JPEG."""
    groups: dict[tuple, list] = {}
    grids: list[list | None] = []
    for i, data in enumerate(media):
        try:
            plans = [_plan(image) for image in parse(data)]
        except (ValueError, KeyError, ZeroDivisionError):
            grids.append(None)
            continue
        grids.append([None] * len(plans))
        for j, plan in enumerate(plans):
            groups.setdefault(plan[0], []).append((i, j, data, plan))
    for blocks, items in groups.items():
        at = 0
        while at < len(items):
            to, rows = at, 0
            while to < len(items) and (to == at or rows < BATCH_ROWS):
                rows += -(-items[to][3][1] // items[to][3][2])
                to += 1
            _decode_group(blocks, items[at:to], grids)
            at = to
    return [None if g is None or any(x is None for x in g) else np.concatenate(g) for g in grids]


def _decode_group(blocks: tuple, items: list, grids: list) -> None:
    pieces, starts, lengths, at = [], [], [], 0
    counts = []
    for _, _, data, (_, mcus, interval, _, _, (a, b)) in items:
        raw = np.frombuffer(data, np.uint8, b - a, a)
        escape = np.flatnonzero(raw[:-1] == 255)
        after = raw[escape + 1]
        restart = escape[(after >= 0xD0) & (after <= 0xD7)]
        drop = np.concatenate([escape[after == 0] + 1, restart, restart + 1])
        keep = np.ones(len(raw), bool)
        keep[drop] = False
        begin = np.concatenate([[0], restart - np.searchsorted(np.sort(drop), restart)]) + at
        need = -(-mcus // interval)
        begin = np.concatenate([begin[:need], np.full(max(0, need - len(begin)), at + int(keep.sum()))])
        pieces.append(raw[keep])
        at += len(pieces[-1])
        starts.append(begin)
        lengths.append(np.minimum(interval, mcus - interval * np.arange(need)))
        counts.append(need)
    try:
        values = _decode_intervals(np.concatenate(pieces), np.concatenate(starts), np.concatenate(lengths), blocks)
    except ValueError:
        if len(items) > 1:  # one bad image doesn't spoil the others
            for item in items:
                _decode_group(blocks, [item], grids)
        return
    row = 0
    for (i, j, _, (_, mcus, _, (across, h, v, down, columns), quant, _)), count in zip(items, counts, strict=True):
        flat = values[row : row + count].reshape(-1)[: mcus * h * v]
        row += count
        grid = flat.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)[:down, :columns]
        grids[i][j] = np.clip((grid * quant + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(grid: np.ndarray) -> str:
    """64 bits in hexadecimal: is a cell of the 8 x 9 mean-pooled thumbnail lighter than the one to its left?"""
    sums = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), np.int64)
    np.cumsum(grid, axis=0, dtype=np.int64, out=sums[1:, 1:])
    np.cumsum(sums[1:, 1:], axis=1, out=sums[1:, 1:])

    def edges(n: int, cells: int):
        low = np.arange(cells) * n // cells
        return low, np.maximum(low + 1, (np.arange(cells) + 1) * n // cells)

    (top, bottom), (left, right) = edges(grid.shape[0], 8), edges(grid.shape[1], 9)
    total = sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]
    mean = total / ((bottom - top)[:, None] * (right - left)[None, :])
    return np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the text's UTF-8, padded by spaces to whole rows, as JPEG."""

    def write(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                raw = [(x.as_py() or "").encode() for x in part.column(1)]
                media = encode_many([x.ljust(max(ROW, -(-len(x) // ROW) * ROW), b" ") for x in raw])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary"
    return docs.select(F.col(key), F.col(text).cast("string").alias("text_to_store")).mapInArrow(write, schema)


def read(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, width, height in pixels, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    The payload is what the thumbnail's samples say. All but the media's own columns are null where
    the bytes aren't baseline JPEG.
    """
    names = [key, "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def describe(data: bytes, grid: np.ndarray | None) -> tuple:
        own = len(data), hashlib.sha256(data).hexdigest()
        if grid is None:
            return None, None, None, None, None, *own, None
        payload = grid.tobytes()
        height, width = grid.shape[0] * 8, grid.shape[1] * 8
        return width, height, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, f"{width}x{height}:{thumbnail_hash(grid)}"

    def look(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                data = [x.as_py() or b"" for x in part.column(1)]
                rows = [describe(x, grid) for x, grid in zip(data, decode_many(data), strict=True)]
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    schema = f"{key} {stored.schema[key].dataType.simpleString()}, width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select(F.col(key), F.col(media).alias("media_to_read")).mapInArrow(look, schema)


def op8_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(documents(spark, sf_dir)).select(F.struct("doc_id", "n_bytes").alias("id"), "media")
    found = read(stored, key="id")
    return found.select("id.doc_id", "id.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
