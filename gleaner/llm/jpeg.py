"""Progressive JPEG media columns.

Writing: a payload of bytes becomes the quantised coefficients of a 4:2:0 colour
image: a byte is the eight magnitude bits of one coefficient (values -255..-128
and 128..255), so nothing is lost. The coefficients are stored as a progressive
JPEG: DC and two spectral bands of AC without their lowest bit, then refinement
scans that add it (successive approximation). A comment segment has the
payload's length.

Reading: every scan is accumulated into coefficient arrays of the image's
components. Any Huffman tables, end-of-band runs, zero runs, restart intervals
and sampling factors of baseline-precision progressive files are read by a
general bit-by-bit path; scans whose codes make their layout regular, as those
written here, are read as whole arrays, with the same results. The arrays are
inverse-transformed in numpy, chroma is upsampled, and the full-resolution RGB
tensor results.

Defined results: a null text is an empty one; the payload is padded with zeros
to a positive multiple of 64 bytes. Equal texts give equal files. Rows repeat as
they do in the input.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import pieces

BLOCK = 64
#: Bands of AC coefficients that get scans of their own.
BANDS = ((1, 5), (6, 63))
MOST_ROWS = 4095  # of 16 lines
#: Whole numbers in the inverse transform and the colour conversion stand for that share of one.
UNIT = 1 << 16
#: Bytes of texts that are worked on together.
PIECE = 1_000_000


@cache
def zigzag() -> np.ndarray:
    """Raster place of each coefficient in zigzag order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@cache
def inverse() -> np.ndarray:
    """Zigzag coefficients (64) times this matrix are samples (64), by rows, times
    UNIT. Its numbers are whole and their sums below 2 to the 53rd, so a product
    of doubles is exact and the same on every machine."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    c = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.rint(np.einsum("ua,vb->uvab", c, c).reshape(64, 64)[zigzag()] * UNIT)


def segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(data) + 2) + data


def table_segment(kind: int, name: int, lengths: dict[int, list[int]]) -> bytes:
    """A Huffman table: symbols by code length."""
    return segment(0xC4, bytes([kind << 4 | name]) + bytes(len(lengths.get(n, [])) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in lengths.get(n, [])))


#: Codes of four bits for DC sizes, of one bit for "a coefficient of seven bits follows", of four for end-of-band runs.
DC_TABLE, ONE_TABLE, RUN_TABLE = {4: list(range(12))}, {1: [0x07]}, {4: [n << 4 for n in range(15)]}


@cache
def head(width: int, height: int) -> bytes:
    parts = b"".join(bytes([i, s, 0]) for i, s in ((1, 0x22), (2, 0x11), (3, 0x11)))
    return segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + parts) + table_segment(0, 0, DC_TABLE) + table_segment(1, 0, ONE_TABLE) + table_segment(1, 1, RUN_TABLE)


def scan_head(parts: list[int], table: int, first: int, last: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p, table]) for p in parts) + bytes([first, last, high << 4 | low]))


def packed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes: filled with ones, 255 stuffed."""
    fill = -len(bits) % 8
    data = np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)]) if fill else bits).tobytes()
    return data.replace(b"\xff", b"\xff\x00")


def by_unit(y: np.ndarray, cb: np.ndarray, cr: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Values of blocks in the order of an interleaved scan, (units, 6)."""
    four = y.reshape(rows, 2, columns, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    return np.concatenate([four, cb[:, None], cr[:, None]], axis=1)


def write(payload: bytes) -> bytes:
    """The payload (a multiple of 64 bytes) as a progressive JPEG."""
    units = max(1, -(-len(payload) // (6 * BLOCK)))
    columns = -(-units // MOST_ROWS)
    rows = -(-units // columns)
    units = rows * columns
    data = np.zeros((6 * units, BLOCK), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    parts = [data[: 4 * units], data[4 * units : 5 * units], data[5 * units :]]
    out = [b"\xff\xd8", segment(0xFE, b"payload %d" % len(payload)), head(16 * columns, 16 * rows)]

    value = data[:, 0].astype(np.int32)
    value = np.where(value < 128, value - 255, value)
    dc = by_unit(*(value[a:b] for a, b in ((0, 4 * units), (4 * units, 5 * units), (5 * units, 6 * units))), rows, columns)
    high = dc >> 1
    diff = high.copy()
    diff[:, 1:4] -= high[:, :3]
    diff[1:, 0] -= high[:-1, 3]
    diff[1:, 4:] -= high[:-1, 4:]
    diff = diff.ravel()
    size = np.where(diff == 0, 0, np.floor(np.log2(np.maximum(np.abs(diff), 1))).astype(np.int32) + 1)
    code = (size << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)
    length = size + 4
    most = int(length.max())
    shift = length[:, None] - 1 - np.arange(most)
    bits = ((code[:, None] >> np.maximum(shift, 0)) & 1).astype(np.uint8)
    out += [scan_head([1, 2, 3], 0, 0, 0, 0, 1), packed(bits[shift >= 0])]
    halves = [p >> 1 for p in parts]  # a 0 bit and seven magnitude bits for each coefficient
    for first, last in BANDS:
        for i, half in enumerate(halves, 1):
            out += [scan_head([i], 0, first, last, 0, 1), half[:, first : last + 1].tobytes()]
    out += [scan_head([1, 2, 3], 0, 0, 0, 1, 0), packed((dc & 1).astype(np.uint8).ravel())]
    for i, part in enumerate(parts, 1):
        lowest = (part[:, 1:] & 1) ^ (part[:, 1:] < 128)
        bits = []
        for at in range(0, len(part), 32767):
            run = min(32767, len(part) - at)
            n = run.bit_length() - 1
            bits += [np.array([int(b) for b in f"{n:04b}" + (f"{run - (1 << n):0{n}b}" if n else "")], np.uint8), lowest[at : at + run].ravel()]
        out += [scan_head([i], 1, 1, 63, 1, 0), packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


@dataclass
class Part:
    """A component: its sampling factors, table, blocks in all units and in its own size."""

    name: int
    across: int
    down: int
    quant: int
    rows: int = 0
    columns: int = 0
    own_rows: int = 0
    own_columns: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


class Bits:
    """Bits of an entropy-coded piece, one by one or as an array."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if n == 0 or value >> (n - 1) else value - (1 << n) + 1


class Reader:
    """A progressive JPEG's coefficients, accumulated scan by scan."""

    def __init__(self, data: bytes, regular: bool = True):
        self.data, self.regular = data, regular
        self.parts: list[Part] = []
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[int, dict[tuple[int, int], int]] = {}
        self.interval = 0
        self.comments: list[bytes] = []
        self._parse()

    def _parse(self) -> None:
        data, at = self.data, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            marker = data[at + 1]
            if data[at] != 255 or marker == 0xD9:
                return
            (length,) = struct.unpack_from(">H", data, at + 2)
            body, at = data[at + 4 : at + 2 + length], at + 2 + length
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    counts, used, code = body[1:17], 17, 0
                    table = self.codes[body[0]] = {}
                    for n in range(1, 17):
                        for _ in range(counts[n - 1]):
                            table[n, code] = body[used]
                            used, code = used + 1, code + 1
                        code <<= 1
                    body = body[used:]
            elif marker == 0xC2:
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("not a progressive file")
            elif marker == 0xDD:
                (self.interval,) = struct.unpack(">H", body)
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDA:
                at = self._scan(body, at)

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        self.parts = [Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.across, self.down = max(p.across for p in self.parts), max(p.down for p in self.parts)
        self.unit_columns, self.unit_rows = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
        for p in self.parts:
            p.columns, p.rows = self.unit_columns * p.across, self.unit_rows * p.down
            p.own_columns, p.own_rows = -(-(-(-self.width * p.across // self.across)) // 8), -(-(-(-self.height * p.down // self.down)) // 8)
            p.blocks = np.zeros((p.rows, p.columns, 64), np.int32)

    def _scan(self, body: bytes, at: int) -> int:
        names = {p.name: p for p in self.parts}
        parts = [(names[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
        first, last, both = body[-3:]
        high, low = both >> 4, both & 15
        pieces, start = [], at
        while True:  # to the next marker that isn't a restart
            end = self.data.find(b"\xff", at)
            if end < 0:
                raise ValueError("the file ends in a scan")
            after = self.data[end + 1]
            at = end + 2
            if 0xD0 <= after <= 0xD7:
                pieces.append(self.data[start:end])
                start = at
            elif after:
                pieces.append(self.data[start:end])
                break
        if len(parts) > 1:
            order = self._units([p for p, _ in parts])
        else:
            p = parts[0][0]
            order = [(p.blocks[: p.own_rows, : p.own_columns], None)]
        if self.regular and len(pieces) == 1 and self._regular(pieces[0], parts, first, last, high, low):
            return end
        if len(parts) > 1:
            tables = {id(p): t for p, t in parts}
            blocks = [(p, tables[id(p)], p.blocks[r, c]) for p, r, c in order]
            group = sum(p.across * p.down for p, _ in parts)
        else:
            blocks = [(p, parts[0][1], b) for row in order[0][0] for b in row]
            group = 1
        step = self.interval * group or len(blocks)
        for i, piece in enumerate(pieces):
            self._general(Bits(piece), blocks[i * step : (i + 1) * step], first, last, high, low)
        return end

    def _units(self, parts: list[Part]) -> list[tuple[Part, int, int]]:
        return [(p, r * p.down + i, c * p.across + j) for r in range(self.unit_rows) for c in range(self.unit_columns) for p in parts for i in range(p.down) for j in range(p.across)]

    def _general(self, bits: Bits, blocks: list, first: int, last: int, high: int, low: int) -> None:
        before: dict[int, int] = {}
        run = 0
        for part, tables, block in blocks:
            if first == 0:
                if high:
                    block[0] |= bits.take(1) << low
                else:
                    before[part.name] = before.get(part.name, 0) + bits.signed(bits.symbol(self.codes[tables >> 4]))
                    block[0] = before[part.name] * (1 << low)
                continue
            codes = self.codes[16 | tables & 15]
            k = first
            if not high:
                if run:
                    run -= 1
                    continue
                while k <= last:
                    zeros, size = divmod(bits.symbol(codes), 16)
                    if size:
                        k += zeros
                        block[k] = bits.signed(size) * (1 << low)
                        k += 1
                    elif zeros == 15:
                        k += 16
                    else:
                        run = (1 << zeros) + bits.take(zeros) - 1
                        break
                continue
            unit = 1 << low
            while k <= last and not run:
                zeros, size = divmod(bits.symbol(codes), 16)
                new = 0
                if size:
                    new = unit if bits.take(1) else -unit
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= last:
                    if block[k]:
                        self._refine(bits, block, k, unit)
                    elif zeros:
                        zeros -= 1
                    else:
                        block[k] = new
                        k += 1
                        break
                    k += 1
            if run:
                for j in range(k, last + 1):
                    if block[j]:
                        self._refine(bits, block, j, unit)
                run -= 1

    @staticmethod
    def _refine(bits: Bits, block: np.ndarray, k: int, unit: int) -> None:
        if bits.take(1) and not abs(int(block[k])) & unit:
            block[k] += unit if block[k] > 0 else -unit

    def _regular(self, piece: bytes, parts: list, first: int, last: int, high: int, low: int) -> bool:
        """Reads a scan whose layout follows from its tables; False if it isn't one."""
        if first == 0 and len(parts) == 3 and [(p.across, p.down) for p, _ in parts] == [(2, 2), (1, 1), (1, 1)]:
            return self._regular_dc(piece, parts, high, low)
        if first == 0 or len(parts) > 1:
            return False
        part, tables = parts[0]
        codes = self.codes[16 | tables & 15]
        blocks = part.blocks[: part.own_rows, : part.own_columns]
        count, width = blocks.shape[0] * blocks.shape[1], last - first + 1
        if not high:
            if list(codes) != [(1, 0)] or codes[1, 0] != 7 or b"\xff" in piece or len(piece) != count * width:
                return False
            value = np.frombuffer(piece, np.uint8).astype(np.int32).reshape(*blocks.shape[:2], width)
            blocks[:, :, first : last + 1] = np.where(value < 64, value - 127, value) * (1 << low)
            return True
        if not all(s < 0xF0 and s & 15 == 0 for s in codes.values()) or not blocks[:, :, first : last + 1].all():
            return False
        bits, done, found = Bits(piece), 0, []
        while done < count:
            n = bits.symbol(codes) >> 4
            run = (1 << n) + bits.take(n)
            found.append(bits.bits[bits.at : bits.at + run * width])
            bits.at += run * width
            done += run
        lowest = np.concatenate(found)[: count * width].reshape(*blocks.shape[:2], width).astype(np.int32)
        old = blocks[:, :, first : last + 1]
        blocks[:, :, first : last + 1] = old + np.sign(old) * (lowest << low) * ((np.abs(old) >> low & 1) == 0)
        return True

    def _regular_dc(self, piece: bytes, parts: list, high: int, low: int) -> bool:
        y, cb, cr = (p for p, _ in parts)
        rows, columns = cb.rows, cb.columns
        count = 6 * rows * columns
        if high:
            value = Bits(piece).bits[:count].astype(np.int32) << low
        else:
            codes = self.codes[parts[0][1] >> 4]
            if codes != {(4, s): s for s in range(12)} or any(t >> 4 != parts[0][1] >> 4 for _, t in parts):
                return False
            bits = np.concatenate([Bits(piece).bits, np.zeros(16, np.uint8)]).astype(np.int32)
            size = (bits[:-3] << 3 | bits[1:-2] << 2 | bits[2:-1] << 1 | bits[3:]).tolist()
            starts, at = [], 0
            for _ in range(count):
                starts.append(at)
                at += 4 + size[at]
            starts = np.array(starts)
            n = np.array([size[s] for s in starts])
            extra = np.zeros(count, np.int32)
            for k in range(int(n.max())):
                on = n > k
                extra[on] = extra[on] << 1 | bits[starts[on] + 4 + k]
            value = np.where((n > 0) & (extra >> np.maximum(n - 1, 0) == 0), extra - (1 << n) + 1, extra)
        value = value.reshape(-1, 6)
        four, rest = value[:, :4].ravel(), value[:, 4:]
        if not high:
            four, rest = np.cumsum(four) << low, np.cumsum(rest, axis=0) << low
        four = four.reshape(rows, columns, 2, 2).transpose(0, 2, 1, 3).reshape(2 * rows, 2 * columns)
        for part, new in ((y, four), (cb, rest[:, 0].reshape(rows, columns)), (cr, rest[:, 1].reshape(rows, columns))):
            part.blocks[:, :, 0] = part.blocks[:, :, 0] | new if high else new
        return True

    def payload(self) -> bytes:
        """The bytes that write() stored."""
        length = next(int(c.split()[1]) for c in self.comments if c.startswith(b"payload "))
        value = np.concatenate([p.blocks.reshape(-1) for p in self.parts])
        return np.where(value < 0, value + 255, value).astype(np.uint8).tobytes()[:length]

    def rgb(self) -> np.ndarray:
        """The image at full resolution, (height, width, 3) of uint8. Whole
        numbers throughout: the same on every machine."""
        planes = []
        for p in self.parts:
            samples = (p.blocks * self.quant[p.quant]).reshape(-1, 64).astype(np.float64) @ inverse()
            samples = np.clip(np.floor(samples / UNIT + 128.5), 0, 255).astype(np.int32)
            plane = samples.reshape(p.rows, p.columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * p.rows, 8 * p.columns)
            planes.append(plane.repeat(self.down // p.down, axis=0).repeat(self.across // p.across, axis=1)[: self.height, : self.width])
        if len(planes) == 1:
            planes = [planes[0], np.full_like(planes[0], 128), np.full_like(planes[0], 128)]
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        share = lambda x: round(x * UNIT)
        out = np.empty((*y.shape, 3), np.int32)
        out[:, :, 0] = y + (share(1.402) * cr + UNIT // 2 >> 16)
        out[:, :, 1] = y - (share(0.344136) * cb + share(0.714136) * cr + UNIT // 2 >> 16)
        out[:, :, 2] = y + (share(1.772) * cb + UNIT // 2 >> 16)
        return np.clip(out, 0, 255).astype(np.uint8)


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's padded payload as a progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column("bytes").to_pylist()]
            for at, end in pieces(texts, PIECE):
                raw = texts[at:end]
                media = [write(x + b"\0" * (-len(x) % BLOCK if x else BLOCK)) for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, end - at), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("bytes"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_column)


def load(stored: DataFrame, media_column: str = "media") -> DataFrame:
    """Replaces each file by its payload and its full-resolution tensor: rgb
    (height x width x 3 bytes, by rows), height, width, and the tensor's sums by
    colour; other columns stay."""
    names = [c for c in stored.columns if c != media_column]
    kinds = {"payload": pa.binary(), "rgb": pa.binary(), "height": pa.int32(), "width": pa.int32(), "sums": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(media_column).to_pylist()
            for at, end in pieces(files, PIECE):
                rows = []
                for data in files[at:end]:
                    reader = Reader(data)
                    rgb = reader.rgb()
                    rows.append((reader.payload(), rgb.tobytes(), *rgb.shape[:2], rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True))], [*names, *kinds])

    schema = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in names)
    return stored.mapInArrow(run, f"{schema}, payload binary, rgb binary, height int, width int, sums array<long>")


def feature_of(tensor: str = "rgb") -> Column:
    """Size, mean colour and checksum of a tensor column."""
    mean = [F.format_number(F.get("sums", F.lit(i)) / (F.col("height") * F.col("width")), 3) for i in range(3)]
    return F.concat_ws(";", F.concat_ws("x", "width", "height"), F.concat_ws(",", *mean), F.lpad(F.lower(F.hex(F.crc32(tensor))), 8, "0"))


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Stores every text, reads it back, and digests both forms; the tensors stay
    as columns rgb, height and width."""
    stored = store(docs, id_column, text_column).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return load(stored).select(
        id_column, "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"), "media_bytes", "media_sha256", feature_of().alias("feature"), "height", "width", "rgb",
    )
