"""Baseline JPEG in numpy: many streams are coded, or decoded, side by side.

The decoder reads all stretches between restart markers of all streams in step, one symbol of each at a time,
so its Python steps grow with the longest stretch and not with the data.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

SOI, EOI, SOS, DQT, DHT, SOF0, DRI, RST0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC0, 0xDD, 0xD0
MOST_SIDE = 65_535


@dataclass(frozen=True)
class Huffman:
    """A table as a DHT segment has it: the number of codes of each length from 1 to 16, and their symbols."""

    counts: bytes
    symbols: bytes

    def codes(self) -> list[tuple[int, int, int]]:
        """(symbol, code, length) in canonical order."""
        out, code, at = [], 0, 0
        for length, n in enumerate(self.counts, 1):
            for s in self.symbols[at : at + n]:
                out.append((s, code, length))
                code += 1
            at += n
            code <<= 1
        return out

    def lookup(self) -> np.ndarray:
        """For the next 16 bits: symbol * 32 + length; 0 where no code begins."""
        table = np.zeros(1 << 16, np.int64)
        for s, code, length in self.codes():
            table[code << 16 - length : code + 1 << 16 - length] = s << 5 | length
        return table


#: Sizes of differences up to 9 bits, all with four-bit codes.
OWN_DC = Huffman(bytes([0, 0, 0, 10, *[0] * 12]), bytes(range(10)))
#: Sizes of coefficients without a run of zeros, those of letters and spaces first; one code of each length.
OWN_AC = Huffman(bytes([1] * 9 + [0] * 7), bytes([5, 4, 7, 6, 3, 8, 2, 1, 0]))


def _coded(table: Huffman, low: int, high: int) -> np.ndarray:
    """Bits * 32 + their number for each value from low to high that has a code."""
    code = {s: (c, n) for s, c, n in table.codes()}
    out = np.zeros(high - low + 1, np.uint32)
    for v in range(low, high + 1):
        n = abs(v).bit_length()
        if n in code:
            c, k = code[n]
            out[v - low] = (c << n | (v if v >= 0 else v + (1 << n) - 1)) << 5 | k + n
    return out


def byte_values() -> np.ndarray:
    """A coefficient for each byte, none of them 0."""
    b = np.arange(256)
    return np.where(b < 128, b - 128, b - 127)


_DC_BITS, _AC_BITS = _coded(OWN_DC, -256, 256), _coded(OWN_AC, -128, 128)[byte_values() + 128]
PER_ROW = 3
UNIT = PER_ROW * PER_ROW * 64


def _header(height: int) -> bytes:
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    return b"".join((
        bytes([0xFF, SOI]),
        segment(DQT, bytes([0, *[1] * 64])),
        segment(SOF0, struct.pack(">BHHBBBB", 8, height, 8 * PER_ROW, 1, 1, 0x11, 0)),
        segment(DHT, b"\x00" + OWN_DC.counts + OWN_DC.symbols),
        segment(DHT, b"\x10" + OWN_AC.counts + OWN_AC.symbols),
        segment(DRI, struct.pack(">H", PER_ROW)),
        segment(SOS, bytes([1, 1, 0, 0, 63, 0])),
    ))


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a multiple of UNIT bytes, as grey baseline images three blocks wide whose quantised coefficients are its bytes.

    A payload of more rows than an image can have is several images, end to end.
    """
    most = MOST_SIDE // (8 * PER_ROW) * UNIT
    images = [(i, p[a : a + most]) for i, p in enumerate(payloads) for a in range(0, len(p), most)]
    data = np.frombuffer(b"".join(p for _, p in images), np.uint8)
    n_rows = len(data) // (PER_ROW * 64)
    code = np.zeros((n_rows, PER_ROW * 64 + 2), np.uint32)  # one to pad a row to bytes, one for an even number
    code[:, :-2] = _AC_BITS[data].reshape(n_rows, -1)
    dc = byte_values()[data[::64]].reshape(-1, PER_ROW)
    code[:, :-2:64] = _DC_BITS[np.diff(dc, axis=1, prepend=0) + 256]
    in_row = (code & 31).sum(1, dtype=np.int64)
    pad = -in_row % 8
    code[:, -2] = ((1 << pad) - 1) << 5 | pad
    ends = np.cumsum(in_row + pad) // 8
    code = code.reshape(-1, 2)
    low = code[:, 1] & 31
    both, n = (code[:, 0] >> 5) << low | code[:, 1] >> 5, ((code[:, 0] & 31) + low).astype(np.int64)
    at = np.cumsum(n) - n
    aligned = both.astype(np.uint64) << np.minimum(64 - (at & 31) - n, 63).astype(np.uint64)
    words = np.zeros((int(ends[-1]) if len(ends) else 0) // 4 + 3, np.uint64)
    word = at >> 5
    words[: word[-1] + 1] += np.bincount(word, aligned >> np.uint64(32)).astype(np.uint64)
    words[1 : word[-1] + 2] += np.bincount(word, aligned & np.uint64(0xFFFFFFFF)).astype(np.uint64)
    packed = np.frombuffer(words.astype(">u4").tobytes(), np.uint8)[: ends[-1]]
    rows_of = np.array([len(p) // (PER_ROW * 64) for _, p in images])
    first_row = np.cumsum(rows_of) - rows_of
    extra = (packed == 0xFF).astype(np.int64)
    marked = np.ones(n_rows, bool)
    marked[first_row + rows_of - 1] = False
    extra[ends[marked] - 1] += 2
    place = np.arange(len(packed)) + np.cumsum(extra) - extra
    out = np.zeros(len(packed) + int(extra.sum()), np.uint8)
    out[place] = packed
    after = place[ends[marked] - 1] + 1 + (packed[ends[marked] - 1] == 0xFF)
    out[after] = 0xFF
    out[after + 1] = RST0 + (np.arange(n_rows) - np.repeat(first_row, rows_of))[marked] % 8
    begins = place[np.append(0, ends[:-1])[first_row]]
    stops = np.append(begins[1:], len(out))
    whole = [b""] * len(payloads)
    for (i, p), a, b in zip(images, begins.tolist(), stops.tolist(), strict=True):
        whole[i] += _header(len(p) // (PER_ROW * 8)) + out[a:b].tobytes() + bytes([0xFF, EOI])
    return whole


@dataclass
class Component:
    across: int
    down: int
    quant: np.ndarray
    dc: Huffman = OWN_DC
    ac: Huffman = OWN_AC


@dataclass
class Image:
    """What the markers of one image say, and where the scan of its first component lies; components are those of that scan, frame all."""

    width: int = 0
    height: int = 0
    restart: int = 0
    frame: list[Component] = field(default_factory=list)
    components: list[Component] = field(default_factory=list)
    scan: bytes = b""

    def sampling(self) -> tuple[int, int]:
        return max(c.across for c in self.frame), max(c.down for c in self.frame)

    def size_of(self, c: Component) -> tuple[int, int]:
        """Samples of a component across and down."""
        a, d = self.sampling()
        return -(-self.width * c.across // a), -(-self.height * c.down // d)

    def grid(self) -> tuple[int, int]:
        """MCUs across and down. A scan of one component has a block for each."""
        if len(self.components) == 1:
            wide, high = self.size_of(self.components[0])
            return -(-wide // 8), -(-high // 8)
        a, d = self.sampling()
        return -(-self.width // (8 * a)), -(-self.height // (8 * d))

    def pattern(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.components) == 1:
            return [0]
        return [i for i, c in enumerate(self.components) for _ in range(c.across * c.down)]


def parse(stream: bytes) -> Iterator[Image]:
    """The images of a stream, one after the other; what follows an image and does not begin another ends it. Raises ValueError for what is no baseline JPEG."""
    at, image, quants, huffman, numbers = 0, Image(), {}, {}, {}
    while at < len(stream):
        if stream[at] != 0xFF or at + 1 >= len(stream):
            raise ValueError(f"no marker at byte {at}")
        marker = stream[at + 1]
        at += 2
        if marker == SOI:
            image, quants, huffman, numbers = Image(), {}, {}, {}
            continue
        if marker == EOI:
            if not image.scan:
                raise ValueError("an image without a scan")
            yield image
            if stream[at : at + 2] != bytes([0xFF, SOI]):
                return
            continue
        if marker == 0xFF:
            at -= 1
            continue
        (length,) = struct.unpack_from(">H", stream, at)
        body = stream[at + 2 : at + length]
        at += length
        if marker == DQT:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                quants[n] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + (wide > 0)) :]
        elif marker == DHT:
            while body:
                total = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = Huffman(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == SOF0:
            depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not image.height or not image.width:
                raise ValueError("only 8-bit images of known size")
            for k in range(n):
                number, sampling, q = body[6 + 3 * k : 9 + 3 * k]
                if not (1 <= sampling >> 4 <= 4 and 1 <= sampling & 15 <= 4):
                    raise ValueError("sampling factors are from 1 to 4")
                numbers[number] = Component(sampling >> 4, sampling & 15, quants[q])
            image.frame = list(numbers.values())
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a baseline frame")
        elif marker == DRI:
            (image.restart,) = struct.unpack(">H", body)
        elif marker == SOS:
            here = []
            for k in range(body[0]):
                number, tables = body[1 + 2 * k : 3 + 2 * k]
                here.append(numbers[number])
                here[-1].dc, here[-1].ac = huffman[0, tables >> 4], huffman[1, tables & 15]
            end = at
            while True:
                end = stream.find(b"\xff", end)
                if end < 0 or end + 1 >= len(stream):
                    raise ValueError("a scan without an end")
                if stream[end + 1] and not RST0 <= stream[end + 1] < RST0 + 8:
                    break
                end += 2
            if here and here[0] is image.frame[0]:
                image.components, image.scan = here, stream[at:end]
            at = end


def _scan_stretches(images: list[Image]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All scans without stuffed bytes and markers; the first byte of each stretch, and its image."""
    raw = np.frombuffer(b"".join(i.scan for i in images), np.uint8)
    sizes = np.array([len(i.scan) for i in images], np.int64)
    begin = np.cumsum(sizes) - sizes
    ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
    keep = np.ones(len(raw), bool)
    keep[ff + 1] = False  # a stuffed zero or the second byte of a marker
    marks = ff[raw[ff + 1] != 0]
    keep[marks] = False
    place = np.cumsum(keep)
    starts = np.sort(np.concatenate([begin, marks + 2]))
    return raw[keep], np.append(0, place)[starts], np.searchsorted(begin, starts, "right") - 1


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """For each image its blocks' 64 quantised coefficients, in the order of the scan, with DC prediction undone. Raises ValueError for damaged scans, before it takes memory for more blocks than a scan can hold."""
    if not images:
        return []
    for image in images:
        across, down = image.grid()
        if 2 * across * down * len(image.pattern()) > 8 * len(image.scan):  # a block has a bit for DC and one for its end at least
            raise ValueError("a scan too short for its frame")
    data, begin, owner = _scan_stretches(images)
    data = np.append(data, np.full(16, 0xFF, np.uint8))
    windows = data.astype(np.uint64)  # the eight bytes from each on
    for k in (1, 2, 4):
        windows[:-k] = windows[:-k] << np.uint64(8 * k) | windows[k:]
    tables: dict[Huffman, int] = {}
    number = lambda h: tables.setdefault(h, len(tables))
    n_blocks, dc_table, ac_table, component, per_stretch = [], [], [], [], []
    for image in images:
        pattern, (across, down) = image.pattern(), image.grid()
        mcus = across * down
        n_blocks.append(mcus * len(pattern))
        part = np.tile(np.array(pattern), mcus)
        component.append(part)
        dc_table.append(np.array([number(c.dc) for c in image.components])[part])
        ac_table.append(np.array([number(c.ac) for c in image.components])[part])
        every = image.restart or mcus
        stretch = np.full(-(-mcus // every), every, np.int64)
        stretch[-1] = mcus - every * (len(stretch) - 1)
        per_stretch.append(stretch * len(pattern))
    expected = np.concatenate([np.full(len(p), i) for i, p in enumerate(per_stretch)])
    if len(expected) != len(owner) or (expected != owner).any():
        raise ValueError("restart markers don't fit the image")
    lookup = np.concatenate([h.lookup() for h in tables])
    component = np.concatenate(component)
    table_of = np.stack([np.concatenate(dc_table), np.concatenate(ac_table)], 1).ravel() << 16
    blocks = np.concatenate(per_stretch)
    last = np.cumsum(blocks)
    block, bit, k = last - blocks, begin * 8, np.zeros(len(begin), np.int64)
    out = np.zeros(int(last[-1]) * 64, np.int16)
    one, edge = np.uint64(1), (len(data) - 8) * 8
    while len(block):
        if (bit > edge).any():
            raise ValueError("a scan ends too early")
        window = windows[bit >> 3] << (bit & 7).view(np.uint64)
        entry = lookup[table_of[2 * block + (k > 0)] + (window >> np.uint64(48)).view(np.int64)]
        length, symbol = entry & 31, entry >> 5
        if not length.all():
            raise ValueError("bits that are no code")
        size = symbol & 15
        raw = ((window << length.view(np.uint64)) >> one >> (63 - size).view(np.uint64)).view(np.int64)
        value = raw - (raw < (1 << size) >> 1) * ((1 << size) - 1)
        bit = bit + length + size
        at = k + (symbol >> 4)
        if (at > 63).any():
            raise ValueError("a run leaves its block")
        out[block * 64 + at] = value
        k = at + 1
        k[(symbol == 0) & (at > 0)] = 64
        done = k == 64
        if done.any():
            block, k = block + done, np.where(done, 0, k)
            on = block < last
            if not on.all():
                block, bit, k, last = block[on], bit[on], k[on], last[on]
    out = out.reshape(-1, 64)
    stretch = np.repeat(np.arange(len(blocks)), blocks)
    order = np.lexsort((stretch, component))
    key = (component * len(blocks) + stretch)[order]
    total = np.cumsum(out[order, 0], dtype=np.int64)
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    base = (total - out[order, 0])[new][np.cumsum(new) - 1]
    out[order, 0] = total - base
    return np.split(out, np.cumsum(n_blocks)[:-1])


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """Luminance from DC alone: a pixel for each block of the first component."""
    across, down = image.grid()
    first = image.components[0]
    a, d = (1, 1) if len(image.components) == 1 else (first.across, first.down)
    per = len(image.pattern())
    dc = blocks.reshape(down, across, per, 64)[:, :, : a * d, 0].reshape(down, across, d, a)
    grey = np.clip(np.rint(dc * int(first.quant[0]) / 8) + 128, 0, 255).astype(np.uint8)
    wide, high = image.size_of(first)
    return grey.transpose(0, 2, 1, 3).reshape(down * d, across * a)[: -(-high // 8), : -(-wide // 8)]


def average_hash(grey: np.ndarray) -> str:
    """64 bits of which samples of a thumbnail, eight by eight, are at least their mean."""
    high, wide = grey.shape
    small = grey[np.arange(8) * high // 8][:, np.arange(8) * wide // 8].astype(np.int64)
    return np.packbits(small * 64 >= small.sum()).tobytes().hex()


def restore(images: list[Image], blocks: list[np.ndarray]) -> bytes:
    """The payload of what ``store`` made."""
    value = np.concatenate(blocks).ravel()
    if ((value == 0) | (value < -128) | (value > 128)).any():
        raise ValueError("coefficients that are no bytes")
    return (value + np.where(value < 0, 128, 127)).astype(np.uint8).tobytes()
