import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from assetloom.llm.jpeg_media import ROW, decode_many, encode_many, op8_baseline_jpeg, parse, read, store, thumbnail_hash


def slow_jpeg(width, height, parts, restart, seed):
    """A baseline JPEG of random coefficients, written bit by bit, and its luminance DC thumbnail.

    parts: (h, v) of each component.
    """
    rng = random.Random(seed)
    dc, ac = list(range(12)), [r << 4 | s for r in range(16) for s in range(1, 11)] + [0, 0xF0]
    code = lambda table, n, s: format(table.index(s), f"0{n}b")
    signed = lambda x: "" if not x else format(x if x > 0 else x + (1 << abs(x).bit_length()) - 1, f"0{abs(x).bit_length()}b")
    wide, high = max(h for h, _ in parts), max(v for _, v in parts)
    if len(parts) == 1:
        shape, across, down = [(1, 1)], -(-width // 8), -(-height // 8)
    else:
        shape, across, down = parts, -(-width // (8 * wide)), -(-height // (8 * high))
    grid = np.zeros((down * shape[0][1], across * shape[0][0]), int)
    scan, bits, before = b"", "", [0] * len(parts)

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        done = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""
        return done

    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            scan += flush() + bytes([255, 0xD0 + (mcu // restart - 1) % 8])
            before = [0] * len(parts)
        for c, (h, v) in enumerate(shape):
            for y in range(v):
                for x in range(h):
                    level = rng.randint(-120, 120)
                    diff = level - before[c]
                    before[c] = level
                    bits += code(dc, 4, abs(diff).bit_length()) + signed(diff)
                    if c == 0:
                        grid[mcu // across * v + y, mcu % across * h + x] = level
                    k = 1
                    while k < 64 and rng.random() < 0.6:
                        if rng.random() < 0.1 and k < 40:
                            bits += code(ac, 8, 0xF0)
                            k += 16
                        run, value = rng.randint(0, min(5, 63 - k)), rng.choice([-300, -5, 1, 17])
                        bits += code(ac, 8, run << 4 | abs(value).bit_length()) + signed(value)
                        k += run + 1
                    if k < 64:
                        bits += code(ac, 8, 0)
    scan += flush()
    seg = lambda m, b: struct.pack(">BBH", 255, m, len(b) + 2) + b
    data = b"\xff\xd8" + seg(0xFE, b"note") + seg(0xDB, bytes([0] + [4] * 64))
    data += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts)))
    data += seg(0xC4, bytes([0, 0, 0, 0, 12] + [0] * 12 + dc)) + seg(0xC4, bytes([0x10] + [0] * 7 + [len(ac)] + [0] * 8 + ac))
    if restart:
        data += seg(0xDD, struct.pack(">H", restart))
    data += seg(0xDA, bytes([len(parts)] + [x for i in range(len(parts)) for x in (i + 1, 0)] + [0, 63, 0])) + scan + b"\xff\xd9"
    h, v = parts[0]
    rows, columns = -(-(-(-height * v // high)) // 8), -(-(-(-width * h // wide)) // 8)
    return data, np.clip((grid[:rows, :columns] * 4 + 4) // 8 + 128, 0, 255)


@pytest.mark.parametrize("parts", [[(1, 1)], [(2, 2)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 2, 3])
def test_general_baseline_images(parts, restart):
    cases = [slow_jpeg(w, h, parts, restart, w * h) for w, h in ((8, 8), (37, 21), (64, 50), (1, 1))]
    for got, (_, expected) in zip(decode_many([d for d, _ in cases]), cases, strict=True):
        assert np.array_equal(got, expected)


def test_payloads_come_back():
    rng = random.Random(1)
    payloads = [bytes(rng.choices(range(256), k=ROW * n)) for n in (1, 2, 3, 40, 8191 + 5)] + [b" " * ROW, b"\xff" * ROW * 3, b"\x00\xff" * ROW]
    media = encode_many(payloads)
    assert [g.tobytes() for g in decode_many(media)] == payloads
    assert encode_many(payloads[3:4]) == media[3:4]  # the same in any batch
    assert len(parse(media[4])) == 2 and parse(media[0])[0]["width"] == ROW * 8


def test_what_is_no_jpeg():
    good = encode_many([b"a" * ROW])[0]
    assert [g is None for g in decode_many([b"", b"text", good[:40], good.replace(b"\xff\xc0", b"\xff\xc2"), good])] == [True, True, True, True, False]


def test_hash_sees_structure():
    ramp = np.tile(np.arange(72, dtype=np.uint8), (64, 1))
    assert thumbnail_hash(ramp) == "f" * 16 and thumbnail_hash(ramp[:, ::-1]) == "0" * 16
    assert len(thumbnail_hash(np.zeros((1, 1), np.uint8))) == 16


def expected(text):
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % ROW if raw else ROW)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def test_documents_with_nulls_repeats_and_other_columns(spark):
    texts = [None, "", "a", "é" * 96, "x" * 191, "x" * 192, "x" * 193, "y" * 400_000, "a"]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(None, "a", "m"), (2, "a", None)], "doc_id long, text string, media string")
    rows = read(store(docs)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None:
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(texts[r.doc_id])[1:]
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (2, 8, None)}) == 1
    assert store(docs.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"no")), (2, None)], "doc_id long, media binary")
    assert [(r.payload_sha256, r.media_bytes) for r in read(bad).orderBy("doc_id").collect()] == [(None, 2), (None, 0)]


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op8_baseline_jpeg(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(docs[r.doc_id])
