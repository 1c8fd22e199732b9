"""FLAC columns: decode Rice residuals and linear predictors into PCM blocks with seekable sample offsets.

All frames of a batch are decoded in step: step i takes the i-th residual of every frame at once, so the
work is a fixed number of array operations for each sample position, however many frames there are. Frames
are found by their sync codes and header checksums; a frame counts only if its CRC-16 holds, and a stream
only if its frames follow each other, fill the length it states and give the MD5 it states.

Decoder: constant, verbatim, fixed and LPC subframes, both Rice kinds with escapes, wasted bits, 1 to 8
channels with stereo decorrelation, 4 to 32 bits, any block size, fixed or variable. Encoder (for storing
what isn't FLAC yet): mono, 8 to 16 bits, the best fixed predictor or an LPC of a given order, and a seek
point for each frame.

PCM bytes are those of a WAV file: offset binary up to 8 bits, else signed little-endian.

Defined results: a null stream or one that isn't FLAC, or is damaged, gives null outputs and a message in
`error`, never an exception; an empty table gives an empty one; repeated rows repeat their results; input
columns whose names clash with the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftline.llm.common import map_arrow, pieces

BLOCK = 576
#: Samples in a PCM block that the decoder writes; its offsets are multiples of this.
PCM_BLOCK = 16 * BLOCK
#: Bytes taken at a time; the arrays for a piece are about a hundred times as large.
PIECE_BYTES = 3 << 19
U = np.uint64


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        r = byte << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ poly if r & top else r << 1) & mask
        out.append(r)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Fixed values of the format: codes of block sizes, sample rates and sample sizes (0: given elsewhere or reserved).
BLOCK_SIZES = [0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768]
RATES = [0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000, 0, 0, 0, 0]
SAMPLE_BITS = [0, 8, 12, 0, 16, 20, 24, 32]


class FlacError(ValueError):
    pass


def _crc_rows(rows: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The checksum of the first lengths[i] bytes of each row."""
    cols = np.ascontiguousarray(rows.T)
    crc = np.zeros(len(rows), np.uint16)
    least = int(lengths.min()) if len(lengths) else 0
    for i in range(int(lengths.max()) if len(lengths) else 0):
        new = table[cols[i] ^ (crc >> (bits - 8)).astype(np.uint8)]
        if bits == 16:
            new = (crc << 8) ^ new
        crc = new if i < least else np.where(i < lengths, new, crc)
    return crc


def _utf8_number(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    tail = [0x80 | (n >> 6 * i) & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF00 >> size) & 0xFF | n >> 6 * (size - 1), *tail])


# ---------------------------------------------------------------- encoder


def _pack(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (value, bits) fields as rows of bytes, with the number of bytes in each.

    A field may be longer than its value: the bits above are zeros. Values are below 2**17.
    """
    ends = np.cumsum(lengths, axis=1)
    total = ends[:, -1]
    words = int(total.max() + 31) // 32 + 1
    at = ends + (np.arange(len(values)) * words * 32)[:, None] - 1
    word, wide = at >> 5, values.astype(U) << (31 - (at & 31)).astype(U)
    size = len(values) * words
    out = np.bincount(word.ravel(), (wide & U(0xFFFFFFFF)).astype(np.float64).ravel(), size)
    over = np.flatnonzero((wide >> U(32)).ravel())
    out += np.bincount(word.ravel()[over] - 1, (wide >> U(32)).ravel()[over].astype(np.float64), size)
    return out.astype(np.uint32).astype(">u4").view(np.uint8).reshape(len(values), words * 4), (total + 7) // 8


def _lpc(x: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor coefficients of each row, and their shifts, by Levinson and Durbin."""
    f = x * np.hanning(x.shape[1])
    auto = np.stack([(f[:, : x.shape[1] - k] * f[:, k:]).sum(1) for k in range(order + 1)], 1)
    err, a = auto[:, 0] + 1e-9, np.zeros((len(x), order))
    for i in range(order):
        r = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(1)) / err
        a[:, :i] -= r[:, None] * a[:, :i][:, ::-1]
        a[:, i] = r
        err = err * np.maximum(1 - r * r, 1e-9)
    most = np.maximum(np.abs(a).max(1), 2.0**-10)
    shift = np.clip(precision - 1 - np.ceil(np.log2(most)).astype(int), 0, 15)
    limit = (1 << (precision - 1)) - 1
    return np.clip(np.round(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def _partition(n: int) -> int:
    """Partitions a block is cut into, as a power of two: parts of at least 64 samples."""
    order = 0
    while order < 4 and n % (2 << order) == 0 and n >> (order + 1) >= 64:
        order += 1
    return order


def _subframes(x: np.ndarray, bits: int, lpc_order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of (rows of x, their fields' values, the fields' lengths)."""
    n, groups, left = x.shape[1], [], np.arange(len(x))
    mask = (1 << bits) - 1
    flat = (x == x[:, :1]).all(1)
    if flat.any():
        rows = left[flat]
        groups.append((rows, np.stack([np.zeros(len(rows), int), x[rows, 0] & mask], 1), np.tile([8, bits], (len(rows), 1))))
    left = left[~flat]
    if not len(left):
        return groups
    y = x[left].astype(np.int64)
    costs = np.stack([np.abs(np.diff(y, o, axis=1)).sum(1) * n / max(n - o, 1) for o in range(min(5, n))], 1)
    kinds = np.argmin(costs, 1)
    if lpc_order and n > lpc_order:
        kinds[:] = 100
    po = _partition(n)
    part = n >> po
    verbatim = np.zeros(len(left), bool)
    for kind in np.unique(kinds):
        own = np.flatnonzero(kinds == kind)
        z = y[own]
        order = lpc_order if kind == 100 else int(kind)
        if order >= part:
            verbatim[own] = True
            continue
        values, lengths = [], []

        def put(value, length, values=values, lengths=lengths, rows=len(own)):
            values.append(np.broadcast_to(np.asarray(value, np.int64).reshape(-1, 1), (rows, 1)))
            lengths.append(np.broadcast_to(np.asarray(length, np.int64).reshape(-1, 1), (rows, 1)))

        put((32 + order - 1 if kind == 100 else 8 + order) << 1, 8)
        for i in range(order):
            put(z[:, i] & mask, bits)
        if kind == 100:
            coefs, shift = _lpc(z, order)
            put(11, 4)
            put(shift, 5)
            for j in range(order):
                put(coefs[:, j] & 0xFFF, 12)
            pred = sum(coefs[:, j : j + 1] * z[:, order - 1 - j : n - 1 - j] for j in range(order)) >> shift[:, None]
            res = z[:, order:] - pred
        else:
            res = np.diff(z, order, axis=1)
        put(po, 6)
        u = (res << 1) ^ (res >> 63)
        at = 0
        for p in range(1 << po):
            piece = u[:, at : at + part - (order if p == 0 else 0)]
            at += piece.shape[1]
            k = np.clip(np.floor(np.log2(np.maximum(piece.mean(1), 1))), 0, 14).astype(np.int64)[:, None]
            put(k, 4)
            values.append((1 << k) | (piece & ((1 << k) - 1)))
            lengths.append((piece >> k) + 1 + k)
        v, length = np.concatenate(values, 1), np.concatenate(lengths, 1)
        dear = length.sum(1) >= 8 + n * bits
        verbatim[own[dear]] = True
        if not dear.all():
            groups.append((left[own[~dear]], v[~dear], length[~dear]))
    if verbatim.any():
        rows = left[verbatim]
        groups.append((rows, np.concatenate([np.full((len(rows), 1), 2), x[rows] & mask], 1), np.tile([8] + [bits] * n, (len(rows), 1))))
    return groups


def encode_streams(streams: list[np.ndarray], bits: int = 8, rate: int = 8000, block: int = BLOCK, lpc_order: int = 0) -> list[bytes]:
    """Each mono stream of integer samples as a FLAC file. Streams that aren't a multiple of `block` end in a shorter frame."""
    if not 8 <= bits <= 16 or rate not in RATES or bits not in SAMPLE_BITS:
        raise ValueError("8, 12 or 16 bits and a listed sample rate are supported")
    frames: dict[tuple[int, int], bytes] = {}
    by_size: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, s in enumerate(streams):
        for j in range(-(-len(s) // block)):
            part = np.asarray(s[j * block : (j + 1) * block], np.int32)
            by_size.setdefault(len(part), []).append((i, j, part))
    for n, parts in by_size.items():
        x = np.stack([p for *_, p in parts])
        if n in BLOCK_SIZES:
            code, extra = BLOCK_SIZES.index(n), b""
        else:
            code, extra = (6, bytes([n - 1])) if n <= 256 else (7, struct.pack(">H", n - 1))
        start = bytes([0xFF, 0xF8, code << 4 | RATES.index(rate), SAMPLE_BITS.index(bits) << 1])
        heads = [start + _utf8_number(j) + extra for _, j, _ in parts]
        size = np.array([len(h) for h in heads])
        top = np.zeros((len(parts), int(size.max())), np.uint8)
        for r, h in enumerate(heads):
            top[r, : len(h)] = np.frombuffer(h, np.uint8)
        crc8 = _crc_rows(top, size, _CRC8, 8)
        for rows, values, lengths in _subframes(x, bits, lpc_order):
            body, used = _pack(values, lengths)
            whole = np.zeros((len(rows), int(size[rows].max()) + 1 + body.shape[1]), np.uint8)
            for own in np.unique(size[rows]):
                r = np.flatnonzero(size[rows] == own)
                whole[r, :own] = top[rows[r], :own]
                whole[r, own] = crc8[rows[r]]
                whole[r, own + 1 : own + 1 + body.shape[1]] = body[r]
            length = size[rows] + 1 + used
            crc16 = _crc_rows(whole, length, _CRC16, 16)
            for r, row in enumerate(rows):
                frames[parts[row][:2]] = whole[r, : length[r]].tobytes() + int(crc16[r]).to_bytes(2, "big")
    out = []
    for i, s in enumerate(streams):
        own = [frames[i, j] for j in range(-(-len(s) // block))]
        sizes = [len(f) for f in own] or [0]
        md5 = hashlib.md5(np.asarray(s).astype("<i1" if bits <= 8 else "<i2").tobytes()).digest()
        packed = rate << 44 | (bits - 1) << 36 | len(s)
        info = struct.pack(">HH", max(block, 16), max(block, 16)) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
        points, at = [], 0
        for j, f in enumerate(own):
            points.append(struct.pack(">QQH", j * block, at, min(block, len(s) - j * block)))
            at += len(f)
        # a metadata block holds less than 2**24 bytes: of a very long stream, every so many frames have a point
        points = points[:: -(-len(points) * 18 // ((1 << 24) - 18)) or 1]
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + (18 * len(points)).to_bytes(3, "big") + b"".join(points) + b"".join(own))
    return out


# ---------------------------------------------------------------- decoder


@dataclass
class Stream:
    rate: int
    channels: int
    bits: int
    samples: np.ndarray  #: samples x channels
    frame_starts: list[int] = field(default_factory=list)  #: first sample of each frame
    frame_bytes: list[int] = field(default_factory=list)  #: its place in the file

    def pcm(self) -> bytes:
        flat = self.samples.ravel()
        if self.bits <= 8:
            return (flat + 128).astype(np.uint8).tobytes()
        if self.bits <= 16:
            return flat.astype("<i2").tobytes()
        if self.bits <= 24:
            return flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        return flat.astype("<i4").tobytes()


@dataclass
class _Frame:
    stream: int
    at: int  #: first byte, in the bytes of all streams
    end: int
    body: int  #: first byte after the header
    size: int
    bits: int
    assignment: int
    number: int
    variable: bool


def _metadata(data: bytes) -> tuple[dict, int]:
    if data[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata ends early")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if kind == 0:
            if len(block) < 34:
                raise FlacError("STREAMINFO ends early")
            packed = int.from_bytes(block[10:18], "big")
            info = {"min_block": int.from_bytes(block[:2], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "total": packed & (1 << 36) - 1, "md5": block[18:34]}
        at += 4 + size
    if info is None:
        raise FlacError("no STREAMINFO")
    return info, at


def _header(raw: np.ndarray, at: int, end: int, info: dict) -> _Frame | None:
    """The frame header at a sync code, if there is a valid one."""
    head = raw[at : min(at + 16, end)].tobytes()
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        return None
    size_code, rate_code, assignment, bits_code = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    if size_code == 0 or rate_code == 15 or assignment > 10 or bits_code == 3 or head[3] & 1:
        return None
    lead = head[4]
    more = 0 if lead < 0x80 else next((n for n in range(1, 7) if lead >> (6 - n) == (1 << (n + 2)) - 2), -1)
    if more < 0 or len(head) < 6 + more or any(b & 0xC0 != 0x80 for b in head[5 : 5 + more]):
        return None
    number = lead if not more else lead & (1 << (6 - more)) - 1
    for b in head[5 : 5 + more]:
        number = number << 6 | b & 63
    k = 5 + more
    size = BLOCK_SIZES[size_code]
    if size_code in (6, 7):
        size = int.from_bytes(head[k : k + size_code - 5], "big") + 1
        k += size_code - 5
    k += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if len(head) <= k:
        return None
    crc = 0
    for b in head[:k]:
        crc = int(_CRC8[crc ^ b])
    if crc != head[k]:
        return None
    return _Frame(-1, at, -1, at + k + 1, size, SAMPLE_BITS[bits_code] or info["bits"], assignment, number, bool(head[1] & 1))


def _find_frames(raw: np.ndarray, starts: list[int], ends: list[int], infos: list[dict | None], errors: list[str | None]) -> list[_Frame]:
    """Frames of all streams, each with its CRC-16 verified; a sync code inside a frame is no frame's start."""
    sync = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] & 0xFE == 0xF8)) if len(raw) > 1 else np.zeros(0, int)
    found: list[list[_Frame]] = []
    for i, info in enumerate(infos):
        own = []
        if info is not None and not errors[i]:
            for at in sync[np.searchsorted(sync, starts[i]) : np.searchsorted(sync, ends[i])]:
                if f := _header(raw, int(at), ends[i], info):
                    f.stream = i
                    own.append(f)
            if not own and info["total"]:
                errors[i] = "no frame found"
            elif own and own[0].at != starts[i]:
                errors[i] = "the first frame isn't where the metadata ends"
        for f, g in zip(own, [*own[1:], None]):
            f.end = g.at if g else ends[i]
        found.append(own if not errors[i] else [])
    todo = [f for own in found for f in own]
    bad = {id(f) for f, ok in zip(todo, _crc_ok(raw, todo)) if not ok}
    good: list[_Frame] = []
    for i, own in enumerate(found):
        k = 0
        while k < len(own):
            f = own[k]
            k += 1
            most = f.at + f.size * (infos[i]["channels"] + 1) * (f.bits + 1) // 4 + 64
            while id(f) in bad and k < len(own) and own[k].end <= most:  # it may go on beyond a chance sync code
                f.end = own[k].end
                k += 1
                if _crc_ok(raw, [f])[0]:
                    bad.discard(id(f))
            if id(f) in bad:
                errors[i] = f"frame checksum at byte {f.at - starts[i]} of the frames"
                break
            good.append(f)
    return [f for f in good if not errors[f.stream]]


def _crc_ok(raw: np.ndarray, frames: list[_Frame]) -> np.ndarray:
    ok = np.zeros(len(frames), bool)
    order = sorted(range(len(frames)), key=lambda i: frames[i].end - frames[i].at)
    for a in range(0, len(order), 4096):
        part = order[a : a + 4096]
        start = np.array([frames[i].at for i in part])
        size = np.array([frames[i].end for i in part]) - start
        fits = size >= 8
        cols = np.arange(int(size.max()))
        rows = raw[np.minimum(start[:, None] + cols, len(raw) - 1)]
        # the checksum over a frame with its own checksum is 0
        ok[part] = fits & (_crc_rows(rows, size, _CRC16, 16) == 0)
    return ok


class _Bits:
    """Bit fields at any place of a byte array, for many places at once."""

    def __init__(self, raw: np.ndarray):
        pad = np.concatenate([raw, np.zeros(16, np.uint8)])
        self.w = np.zeros(len(raw) + 8, U)
        for i in range(8):
            self.w |= pad[i : i + len(self.w)].astype(U) << U(56 - 8 * i)
        self.last = len(self.w) - 1

    def window(self, pos: np.ndarray) -> np.ndarray:
        return self.w[np.minimum(pos >> 3, self.last)] << (pos & 7).astype(U)

    def read(self, pos: np.ndarray, n) -> np.ndarray:
        """n bits, up to 57, at each place."""
        return ((self.window(pos) >> U(1)) >> (63 - np.asarray(n)).astype(U)).astype(np.int64)

    def signed(self, pos: np.ndarray, n) -> np.ndarray:
        v, n = self.read(pos, n), np.asarray(n)
        return np.where((n > 0) & (v >> np.maximum(n - 1, 0) & 1 == 1), v - (1 << n.astype(np.int64)), v)

    def zeros(self, pos: np.ndarray, most: int) -> np.ndarray:
        """How many zero bits stand at each place before the next one bit; `most` at least stops the count."""
        count, todo = np.zeros(len(pos), np.int64), np.arange(len(pos))
        while len(todo):
            top = (self.window(pos[todo] + count[todo]) >> U(32)).astype(np.float64)
            z = 32 - np.frexp(top)[1].astype(np.int64)
            count[todo] += np.where(top > 0, z, 32)
            todo = todo[(top == 0) & (count[todo] < most)]
        return count


def _residual(bits: _Bits, pos: np.ndarray, n: int, order: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals of rows with one predictor order: rows x (n - order), the places after them, and whether they are valid."""
    out = np.zeros((n - order, len(pos)), np.int64)
    method, po = bits.read(pos, 2), bits.read(pos + 2, 4)
    pos = pos + 6
    valid = (method < 2) & (n % (1 << po) == 0) & (n >> po >= order)
    for p in np.unique(po[valid]):
        rows = np.flatnonzero(valid & (po == p))
        at, wide, part, i = pos[rows], 4 + method[rows], n >> int(p), 0
        for q in range(1 << int(p)):
            k = bits.read(at, wide)
            at = at + wide
            escaped = k == (1 << wide) - 1
            raw_bits = np.where(escaped, bits.read(at, 5), 0)
            at = at + 5 * escaped
            any_escape, shift, rest = escaped.any(), (63 - k).astype(U), k + 1
            for _ in range(part - (order if q == 0 else 0)):
                win = bits.window(at)
                top = (win >> U(32)).astype(np.float64)
                z = 32 - np.frexp(top)[1].astype(np.int64)
                if not top.all():
                    long = np.flatnonzero((top == 0) & ~escaped)
                    z[long] = bits.zeros(at[long], 1 << 20)
                low = (((win << np.minimum(z + 1, 63).astype(U)) >> U(1)) >> shift).astype(np.int64)
                far = z + rest > 56
                if far.any():
                    low = np.where(far, bits.read(at + z + 1, k), low)
                u = z << k | low
                v, used = u >> 1 ^ -(u & 1), z + rest
                if any_escape:
                    v, used = np.where(escaped, bits.signed(at, raw_bits), v), np.where(escaped, raw_bits, used)
                out[i, rows] = v
                at = at + used
                i += 1
            late = at > limit[rows]
            if late.any():
                valid[rows[late]] = False
                at = np.minimum(at, limit[rows])
        pos[rows] = at
    return out.T, pos, valid


def _integrate(warm: np.ndarray, res: np.ndarray, order: int) -> np.ndarray:
    """Samples whose order-th differences are res."""
    x = res
    for level in range(order - 1, -1, -1):
        x = np.cumsum(np.concatenate([np.diff(warm, level, axis=1)[:, :1], x], 1), axis=1)
    return x


def _subframe(bits: _Bits, pos: np.ndarray, depth: np.ndarray, n: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One subframe of each row, all of n samples: samples, the places after them, whether they are valid."""
    out, valid = np.zeros((len(pos), n), np.int64), bits.read(pos, 1) == 0
    kind, wasted = bits.read(pos + 1, 6), bits.read(pos + 7, 1)
    pos = pos + 8
    if wasted.any():
        more = np.where(wasted == 1, bits.zeros(pos, 40) + 1, 0)
        valid &= more < depth
        pos, wasted = pos + more, np.minimum(more, depth - 1)
        depth = depth - wasted
    for t in np.unique(kind[valid]):
        rows = np.flatnonzero(valid & (kind == t))
        at, d = pos[rows], depth[rows]
        if t == 0:
            out[rows], at = bits.signed(at, d)[:, None], at + d
        elif t == 1:
            if (at + d * n > limit[rows]).any():
                valid[rows] = at + d * n <= limit[rows]
            out[rows] = bits.signed((at[:, None] + d[:, None] * np.arange(n)).ravel(), np.repeat(d, n)).reshape(len(rows), n)
            at = at + d * n
        elif 8 <= t <= 12 or t >= 32:
            order = int(t) - (8 if t < 32 else 31)
            if order > n:
                valid[rows] = False
                continue
            warm = np.stack([bits.signed(at + i * d, d) for i in range(order)], 1) if order else np.zeros((len(rows), 0), np.int64)
            at = at + order * d
            if t < 32:
                res, at, ok = _residual(bits, at, n, order, limit[rows])
                x = _integrate(warm, res, order) if order else res
            else:
                precision, shift = bits.read(at, 4) + 1, bits.signed(at + 4, np.full(len(at), 5))
                good = (precision < 16) & (shift >= 0)
                coefs = np.stack([bits.signed(at + 9 + j * precision, precision) for j in range(order)], 1)
                res, at, ok = _residual(bits, at + 9 + order * precision, n, order, limit[rows])
                ok &= good
                x, back, shift = np.concatenate([warm, res], 1), np.ascontiguousarray(coefs[:, ::-1]), np.maximum(shift, 0)
                for i in range(order, n):
                    x[:, i] += (x[:, i - order : i] * back).sum(1) >> shift
            out[rows] = x
            valid[rows] &= ok
        else:
            valid[rows] = False
        pos[rows] = at
    return out << wasted[:, None], pos, valid & (pos <= limit)


def decode_streams(streams: list[bytes | None]) -> list[Stream | str]:
    """Each FLAC file decoded, or what is wrong with it."""
    infos: list[dict | None] = []
    errors: list[str | None] = []
    starts, ends, at = [], [], 0
    for s in streams:
        try:
            info, begin = _metadata(s) if s is not None else (None, 0)
            errors.append(None if s is not None else "no stream")
        except FlacError as e:
            info, begin = None, 0
            errors.append(str(e))
        infos.append(info)
        starts.append(at + begin)
        at += len(s or b"")
        ends.append(at)
    raw = np.frombuffer(b"".join(s or b"" for s in streams), np.uint8)
    frames = _find_frames(raw, starts, ends, infos, errors)
    bits = _Bits(raw)
    decoded: dict[int, np.ndarray] = {}
    groups: dict[tuple[int, int], list[_Frame]] = {}
    for f in frames:
        groups.setdefault((f.size, f.assignment), []).append(f)
    for (n, assignment), own in groups.items():
        pos, limit = np.array([f.body for f in own]) * 8, np.array([f.end - 2 for f in own]) * 8
        depth, valid, parts = np.array([f.bits for f in own]), np.ones(len(own), bool), []
        for c in range(assignment + 1 if assignment < 8 else 2):
            side = (assignment in (8, 10) and c == 1) or (assignment == 9 and c == 0)
            x, pos, ok = _subframe(bits, pos, depth + side, n, limit)
            parts.append(x)
            valid &= ok
        if assignment == 8:
            parts[1] = parts[0] - parts[1]
        elif assignment == 9:
            parts[0] = parts[0] + parts[1]
        elif assignment == 10:
            mid = parts[0] << 1 | parts[1] & 1
            parts = [(mid + parts[1]) >> 1, (mid - parts[1]) >> 1]
        x = np.stack(parts, 2)
        for i, f in enumerate(own):
            if not valid[i] or not 0 <= limit[i] - pos[i] < 8:
                errors[f.stream] = errors[f.stream] or f"frame {f.number} can't be decoded"
            decoded[id(f)] = x[i]
    by_stream: dict[int, list[_Frame]] = {}
    for f in frames:
        by_stream.setdefault(f.stream, []).append(f)
    out: list[Stream | str] = []
    for i, info in enumerate(infos):
        if errors[i] or info is None:
            out.append(errors[i] or "no stream")
            continue
        own, first = by_stream.get(i, []), []
        at = 0
        for k, f in enumerate(own):
            if f.number != (at if f.variable else k):
                errors[i] = f"frame {k} has number {f.number}"
            first.append(at)
            at += f.size
        channels = info["channels"]
        if any(decoded[id(f)].shape[1] != channels for f in own):
            errors[i] = "a frame has other channels than the stream"
        if errors[i] or info["total"] not in (0, at):
            out.append(errors[i] or f"{at} samples of {info['total']}")
            continue
        x = np.concatenate([decoded[id(f)] for f in own]) if own else np.zeros((0, channels), np.int64)
        width = (info["bits"] + 7) // 8
        plain = x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() if x.size else b""
        if info["md5"] != bytes(16) and hashlib.md5(plain).digest() != info["md5"]:
            out.append("the samples' MD5 differs")
            continue
        out.append(Stream(info["rate"], channels, info["bits"], x, first, [f.at - starts[i] for f in own]))
    return out


def features(s: Stream) -> str:
    """Peak, root mean square, zero crossings and number of frames, as text; equal samples give equal text."""
    x = s.samples.astype(np.float64)
    if not x.size:
        return f"frames={len(s.frame_starts)};peak=0;rms=0.0000;crossings=0"
    crossings = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    return f"frames={len(s.frame_starts)};peak={int(np.abs(x).max())};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings}"


# ---------------------------------------------------------------- columns


def store_bytes(df: DataFrame, bytes_col: str, media_col: str = "media", block: int = BLOCK) -> DataFrame:
    """df with the bytes of `bytes_col` as 8-bit samples in a FLAC file; the file is null where the bytes are."""
    keep = [f for f in df.schema.fields if f.name != media_col]
    out = T.StructType([*keep, T.StructField(media_col, T.BinaryType())])

    def run(batches):
        for batch in pieces(batches, bytes_col, PIECE_BYTES):
            yield store(batch)

    def store(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column(bytes_col).to_pylist()
        samples = [np.frombuffer(d, np.uint8).astype(np.int32) - 128 for d in data if d is not None]
        made = iter(encode_streams(samples, block=block))
        media = pa.array([None if d is None else next(made) for d in data], pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), media], names=out.names)

    return map_arrow(df, run, out)


PCM = T.ArrayType(T.StructType([T.StructField("sample_offset", T.LongType(), False), T.StructField("n_samples", T.IntegerType(), False), T.StructField("pcm", T.BinaryType(), False)]), False)


def decode(df: DataFrame, media_col: str = "media", pcm_block: int = PCM_BLOCK) -> DataFrame:
    """df with what its FLAC files hold: rate, channels, bits, PCM blocks with their sample offsets, features, error."""
    made = [T.StructField("sample_rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("blocks", PCM), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())]
    keep = [f for f in df.schema.fields if f.name not in {m.name for m in made}]
    out = T.StructType([*keep, *made])
    kinds = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))

    def run(batches):
        for batch in pieces(batches, media_col, PIECE_BYTES):
            cols: list[list] = [[] for _ in made]
            for s in decode_streams(batch.column(media_col).to_pylist()):
                if isinstance(s, str):
                    row = [None] * 5 + [s]
                else:
                    pcm, wide = s.pcm(), s.channels * ((s.bits + 7) // 8)
                    blocks = [{"sample_offset": a, "n_samples": min(pcm_block, len(s.samples) - a), "pcm": pcm[a * wide : (a + pcm_block) * wide]} for a in range(0, len(s.samples), pcm_block)]
                    row = [s.rate, s.channels, s.bits, blocks, features(s), None]
                for c, v in zip(cols, row):
                    c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), pa.int32(), kinds, pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *arrays], names=out.names)

    return map_arrow(df, run, out)
