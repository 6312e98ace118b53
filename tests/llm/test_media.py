"""JPEG columns and WARC archives."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from gleaner.llm import common, jpeg, warc
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(0, 2**32 - 1))
def test_payload_returns_by_both_paths(blocks, seed):
    payload = np.random.default_rng(seed).integers(0, 256, 64 * blocks, np.uint8).tobytes()
    data = jpeg.write(payload)
    fast, slow = jpeg.Reader(data), jpeg.Reader(data, regular=False)
    assert fast.payload() == slow.payload() == payload
    assert (fast.rgb() == slow.rgb()).all() and fast.rgb().shape == (fast.height, fast.width, 3)


def test_many_blocks_take_several_runs_and_columns():
    payload = np.random.default_rng(1).integers(0, 256, 64 * 6 * (jpeg.MOST_ROWS * 3 + 1), np.uint8).tobytes()
    reader = jpeg.Reader(jpeg.write(payload))
    assert reader.payload() == payload and reader.width == 64


def test_general_scans():
    """A grey image by hand: zero runs, an end-of-band run, new and refined coefficients."""
    bits = lambda text: jpeg.packed(np.array([int(b) for b in text.replace(" ", "")], np.uint8))
    ac = {2: [0x01, 0x10, 0x21], 3: [0xF0]}  # 00: one bit at once; 01: run of two blocks or three; 10: after two zeros; 110: sixteen zeros
    out = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + b"\2" * 64) + jpeg.segment(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    out += jpeg.table_segment(0, 0, {2: [0, 3]}) + jpeg.table_segment(1, 0, ac)
    out += jpeg.scan_head([1], 0, 0, 0, 0, 0) + bits("01 101 01 010")  # DC 5, then 5 - 5
    out += jpeg.scan_head([1], 0, 1, 63, 0, 1) + bits("00 1 10 0 110 01 0")  # k=1: +2; k=4: -2; sixteen zeros; both blocks end
    out += jpeg.scan_head([1], 0, 1, 63, 1, 0) + bits("00 1 1 10 0 0 01 0") + b"\xff\xd9"
    blocks = jpeg.Reader(out).parts[0].blocks
    assert blocks[0, 0, 0] == 5 and blocks[0, 1, 0] == 0
    # block 0: k=1 is passed with correction 1 and k=2 becomes +1; then two zeros (k=3, k=5) are passed, k=4 is refined by 0 on
    # the way, and k=6 becomes -1; a run of two blocks ends the rest
    assert list(blocks[0, 0, 1:]) == [3, 1, 0, -2, 0, -1] + [0] * 57
    assert not blocks[0, 1, 1:].any()


def test_inverse_is_the_cosine_transform():
    block = np.zeros(64)
    block[0], block[2] = 80, 40  # zigzag 2 is row 1, column 0
    samples = (block @ jpeg.inverse()).reshape(8, 8) / jpeg.UNIT
    x = np.arange(8)
    want = 80 / 8 + 40 * np.sqrt(1 / 8) * 0.5 * np.cos((2 * x + 1) * np.pi / 16)
    assert np.allclose(samples, want[:, None], atol=2e-3)


ZIGZAG = """
 0  1  5  6 14 15 27 28
 2  4  7 13 16 26 29 42
 3  8 12 17 25 30 41 43
 9 11 18 24 31 40 44 53
10 19 23 32 39 45 52 54
20 22 33 38 46 51 55 60
21 34 37 47 50 56 59 61
35 36 48 49 57 58 62 63
"""


def decoded(data):
    """A second reader, of 4:2:0 files only: bit strings, one coefficient at a time, samples by the double cosine sum."""
    at, tables, quant, coefficients = 2, {}, None, None
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            quant = body[1:65]
        elif marker == 0xC4:
            code, symbols, table = 0, iter(body[17:]), {}
            for n in range(1, 17):
                for _ in range(body[n]):
                    table[f"{code:0{n}b}"] = next(symbols)
                    code += 1
                code *= 2
            tables[body[0] >> 4, body[0] & 15] = table
        elif marker == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            down, across = -(-height // 16), -(-width // 16)
            shape = {1: (2 * down, 2 * across), 2: (down, across), 3: (down, across)}
            coefficients = {c: {(r, k): [0] * 64 for r in range(shape[c][0]) for k in range(shape[c][1])} for c in shape}
        elif marker == 0xDA:
            end = at
            while data[end] != 255 or data[end + 1] == 0:
                end += 1
            bits = "".join(f"{b:08b}" for b in data[at:end].replace(b"\xff\0", b"\xff"))
            at, p = end, 0
            parts, (first, last, both) = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}, body[-3:]
            high, low = both >> 4, both & 15
            if len(parts) == 3:
                order = [(c, (r * s + i, k * s + j)) for r in range(down) for k in range(across) for c, s in ((1, 2), (2, 1), (3, 1)) for i in range(s) for j in range(s)]
            else:
                (only,) = parts
                order = [(only, place) for place in sorted(coefficients[only])]

            def symbol(table):
                nonlocal p
                n = next(n for n in range(1, 17) if bits[p : p + n] in table)
                p += n
                return table[bits[p - n : p]]

            def number(n):
                nonlocal p
                p += n
                return int(bits[p - n : p], 2) if n else 0

            signed = lambda n: (lambda v: v if not n or v >> (n - 1) else v - (1 << n) + 1)(number(n))  # noqa: B023, E731
            before, skip = dict.fromkeys(shape, 0), 0
            for c, place in order:
                block = coefficients[c][place]
                if first == 0 and not high:
                    before[c] += signed(symbol(tables[0, parts[c] >> 4]))
                    block[0] = before[c] << low
                elif first == 0:
                    block[0] |= number(1) << low
                elif not high:
                    k = first
                    while k <= last and not skip:
                        zeros, size = divmod(symbol(tables[1, parts[c] & 15]), 16)
                        if size or zeros == 15:
                            k += zeros
                            block[k] = signed(size) * (1 << low)
                            k += 1
                        else:
                            skip = (1 << zeros) + number(zeros)
                    skip -= skip > 0
                else:
                    if not skip:
                        zeros, size = divmod(symbol(tables[1, parts[c] & 15]), 16)
                        assert not size and zeros < 15  # these files have no zero coefficients left to fill
                        skip = (1 << zeros) + number(zeros)
                    for k in range(first, last + 1):
                        if block[k] and number(1):
                            block[k] += (1 if block[k] > 0 else -1) << low
                    skip -= 1
    zigzag = [int(x) for x in ZIGZAG.split()]
    c = np.array([[(0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    planes = {}
    for part, blocks in coefficients.items():
        plane = planes[part] = np.zeros((8 * shape[part][0], 8 * shape[part][1]))
        for (r, k), block in blocks.items():
            f = np.array([block[z] * quant[z] for z in zigzag], float).reshape(8, 8)
            plane[8 * r : 8 * r + 8, 8 * k : 8 * k + 8] = np.clip(c.T @ f @ c + 128, 0, 255)
    rgb = np.zeros((height, width, 3))
    for r in range(height):
        for k in range(width):
            y, cb, cr = planes[1][r, k], planes[2][r // 2, k // 2] - 128, planes[3][r // 2, k // 2] - 128
            rgb[r, k] = y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb
    raw = b"".join(bytes(v + 255 if v < 0 else v for v in block) for part in (1, 2, 3) for _, block in sorted(coefficients[part].items()))
    return raw, np.clip(rgb, 0, 255)


@pytest.mark.parametrize("size", [64, 384, 448, 3200])
def test_files_against_a_second_reader(size):
    payload = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    data = jpeg.write(payload)
    raw, rgb = decoded(data)
    assert raw[:size] == payload and not any(raw[size:])
    own = jpeg.Reader(data).rgb()
    assert own.shape == rgb.shape and np.abs(own - rgb).max() <= 2.5


TEXTS = [None, "", "a", "é" * 100, "x" * 64, "long " * 4000]


def test_media_query(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, ""), (None, "a")]
    docs = spark.createDataFrame([(i, t, "m", 1) for i, t in rows], "doc_id long, text string, media string, n_bytes int")
    out = jpeg.round_trip(docs).collect()
    assert len(out) == len(rows) and jpeg.round_trip(docs.limit(0)).count() == 0
    by_bytes = {}
    for r in out:
        text = next(t or "" for i, t in rows if i == r.doc_id)
        raw = text.encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        media = jpeg.write(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert by_bytes.setdefault(raw, r.feature) == r.feature
        rgb = jpeg.Reader(media).rgb()
        assert (r.height, r.width, bytes(r.rgb)) == (*rgb.shape[:2], rgb.tobytes())
        mean = rgb.reshape(-1, 3).mean(axis=0)
        assert r.feature == f"{r.width}x{r.height};" + ",".join(f"{x:.3f}" for x in mean) + f";{zlib.crc32(rgb.tobytes()):08x}"


def test_records_of_a_stream_in_small_pieces():
    records = [warc.record(str(i), "http://x/\r\ny", b"\r\n\r\n" * i + b"WARC/1.1", "0a" * 20, None) for i in range(5)]
    whole = gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:]))
    for step in (1, 7, 1 << 16):
        assert list(warc.records_of(warc.inflated(whole, step))) == records
    with pytest.raises(ValueError):
        list(warc.records_of(iter([records[1][:-3]])))


def test_records_are_as_the_format_asks():
    digest = hashlib.sha1(b"body").hexdigest()
    whole, again = warc.record("7", "http://x/", b"body", digest, None, "2020-01-02T03:04:05Z"), warc.record("3", "", b"body", digest, "7")
    fields, block = warc.fields_of(whole)
    assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["warc-record-id"]) and fields["warc-date"] == "2020-01-02T03:04:05Z"
    assert fields["warc-payload-digest"] == "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode() and int(fields["content-length"]) == len(block)
    assert block.startswith(b"HTTP/1.1 200 OK\r\n") and block.endswith(b"\r\n\r\nbody")
    other, head = warc.fields_of(again)
    assert other["warc-refers-to"] == fields["warc-record-id"] != other["warc-record-id"] and other["warc-target-uri"] == "about:blank" and head.endswith(b"\r\n\r\n")
    assert warc.record_id(None) != warc.record_id(None)


def test_warc_round_trip(spark, monkeypatch):
    rng = random.Random(6)
    big, small = "<p>" + "é" * 600, "<p>small"
    rows = [(i, f"http://h/{i}", rng.choice([big, small, None, "", "<b>" + "y" * rng.randrange(900, 1100), big + "2"])) for i in range(200)]
    rows += [(500, None, big), (501, "http://x", None), (500, None, big)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, size int").repartition(3)
    out = warc.round_trip(pages).collect()
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        last = max(j for j, _, h in rows if (h or "") == (html or ""))
        again = len(raw) >= 1000 and i != last
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)  # the same by a join that deals the rows of a payload
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.url) for r in warc.round_trip(pages).collect()), key=str) == sorted(((r.page_id, r.record_type, r.refers_to, r.url) for r in out), key=str)
    packed = warc.pack(warc.planned(pages), 20_000)
    members = warc.normalise(packed).collect()
    assert len(members) > 1
    for archive in members:
        stream = io.BytesIO(archive.content)
        assert gzip.GzipFile(fileobj=stream).read().count(b"WARC/1.1") == len(archive.offsets)
        for at in archive.offsets:
            assert at.record_id.encode() in gzip.decompress(bytes(archive.content[at.start : at.start + at.length]))
