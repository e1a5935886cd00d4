"""FLAC for many short byte streams at once: mono, 8-bit samples, fixed and linear predictors, Rice residuals.

Both directions work on a batch of frames. The encoder computes all residuals as flat arrays. The decoder walks
all frames in step: the k-th residual of every frame is read together, so the serial bit reading and the serial
prediction become array operations over frames.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np

BLOCK, RATE, BITS = 4096, 8000, 8
#: Coefficients of the format's fixed predictors of order 0 to 4, newest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Bytes of payload (whole frames) that are encoded or decoded in one go.
RUN = 512 * BLOCK
#: Residuals decoded in one go: bounds the matrix of frames x samples.
CELLS = 4 << 20


class FlacError(ValueError):
    """A stream that is not valid, or whose checksums do not hold."""


def _crc_table(poly: int, width: int, index_bits: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    table = np.arange(1 << index_bits, dtype=np.int64) << (width - index_bits)
    for _ in range(index_bits):
        table = np.where(table & top, (table << 1) ^ poly, table << 1) & mask
    return table


#: The format's checksums: x^8 + x^2 + x + 1 for headers, x^16 + x^15 + x^2 + 1 for frames.
CRC8 = _crc_table(0x07, 8, 8).tolist()
CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The frame checksum of many slices. Leading zeros do not change it, so slices are aligned at their ends and
    stepped through together, two bytes at a time."""
    out = np.zeros(len(starts), np.uint16)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        most = max(1, (1 << 21) // max(64, int(sizes[order[min(at + 255, len(order) - 1)]])))
        own = order[at : at + min(most, 1024)]
        at += len(own)
        wide = int(sizes[own].max() + 1) & ~1
        cols = np.arange(wide) - (wide - sizes[own])[:, None]
        rows = np.where(cols >= 0, buf[np.clip(starts[own][:, None] + cols, 0, max(0, len(buf) - 1))], 0).astype(np.uint16)
        words = np.ascontiguousarray(((rows[:, 0::2] << 8) | rows[:, 1::2]).T)
        c = np.zeros(len(own), np.uint16)
        for w in words:
            c = CRC16[c ^ w]
        out[own] = c
    return out


def _utf8_number(n: int) -> bytes:
    """The format's UTF-8-like coding of a frame number."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 6
    while n >> room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room -= 1
    return bytes([(0xFF << (room + 1)) & 0xFF | n, *reversed(tail)])


@functools.lru_cache(4096)
def _frame_header(n: int, number: int) -> bytes:
    if n == 4096:
        code, extra = 12, b""
    elif n <= 256:
        code, extra = 6, bytes([n - 1])
    else:
        code, extra = 7, struct.pack(">H", n - 1)
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + _utf8_number(number) + extra
    return head + bytes([crc8(head)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


PRECISION = 12


def _predictors(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised linear predictors of all frames at once: (coefficients by frame, shifts, whether they are valid).

    Autocorrelation within each frame, then the Levinson-Durbin recursion with a row a frame.
    """
    r = [np.add.reduceat(x * x, starts, dtype=np.int64).astype(float)]
    for j in range(1, order + 1):
        lagged = np.zeros(len(x), np.int32)
        lagged[j:] = x[j:] * x[:-j]
        r.append(np.add.reduceat(np.where(place >= j, lagged, 0), starts, dtype=np.int64).astype(float))
    a, err = np.zeros((order, len(starts))), r[0].copy()
    valid = (sizes > order) & (err > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(order):
            k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / np.where(valid, err, 1.0)
            a[:i], a[i] = a[:i] - k * a[:i][::-1], k
            err = err * (1 - k * k)
            valid &= err > 0
        largest = np.maximum(np.abs(a).max(axis=0), 1e-9)
        shift = np.minimum(15, PRECISION - 2 - np.floor(np.log2(np.where(valid, largest, 1.0))).astype(np.int64))
    valid &= shift >= 0
    half = 1 << (PRECISION - 1)
    coefs = np.clip(np.round(np.where(valid, a, 0.0) * 2.0 ** np.maximum(shift, 0)), -half, half - 1).astype(np.int32)
    return coefs, np.maximum(shift, 0), valid


def encode(payloads: list[bytes], lpc_order: int = 0) -> list[bytes]:
    """One FLAC stream a payload (of 1 byte or more), each byte b as the sample b - 128, with a seek point a frame.

    Every frame takes the shortest of constant, verbatim, fixed predictor and, if asked for, linear predictor. A long
    payload is encoded in runs of frames, so the memory that it takes besides itself is bounded.
    """
    if any(len(p) > RUN for p in payloads):
        return [_encode_long(p, lpc_order) if len(p) > RUN else encode([p], lpc_order)[0] for p in payloads]
    if not payloads:
        return []
    data, frames, first = *_encode_frames(payloads, lpc_order), 0
    done = []
    for p in payloads:
        own = frames[first : first + -(-len(p) // BLOCK)]
        first += len(own)
        done.append(_stream(len(p), _signed_md5([p]), own, data[int(own["offset"][0]) : int(own["offset"][-1] + own["length"][-1])]))
    return done


def _signed_md5(pieces: Iterable[bytes]) -> bytes:
    """The stream's checksum: over the samples as signed bytes."""
    md5 = hashlib.md5()
    for p in pieces:
        md5.update((np.frombuffer(p, np.uint8) ^ 0x80).tobytes())
    return md5.digest()


def _encode_long(payload: bytes, lpc_order: int) -> bytes:
    pieces, tables, at = [], [], 0
    for lo in range(0, len(payload), RUN):
        data, frames = _encode_frames([payload[lo : lo + RUN]], lpc_order, lo // BLOCK)
        frames["offset"] += at
        at += len(data)
        pieces.append(data)
        tables.append(frames)
    md5 = _signed_md5(payload[lo : lo + RUN] for lo in range(0, len(payload), RUN))
    return _stream(len(payload), md5, np.concatenate(tables), b"".join(pieces))


#: What the encoder tells of each frame: bytes from the start of its data, their number, its number and samples.
FRAME = [("offset", np.int64), ("length", np.int64), ("number", np.int64), ("samples", np.int64)]


def _stream(samples: int, md5: bytes, frames: np.ndarray, data: bytes) -> bytes:
    packed = RATE << 44 | (BITS - 1) << 36 | samples
    info = struct.pack(">HH", BLOCK, BLOCK) + int(frames["length"].min()).to_bytes(3, "big") + int(frames["length"].max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
    points = np.zeros(len(frames), [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
    points["sample"], points["offset"], points["samples"] = frames["number"] * BLOCK, frames["offset"] - frames["offset"][0], frames["samples"]
    seek = points.tobytes()
    return b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data


def _encode_frames(payloads: list[bytes], lpc_order: int, first_number: int = 0) -> tuple[bytes, np.ndarray]:
    """(the frames of all payloads, one :data:`FRAME` each); frames of a payload are numbered from ``first_number``."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    x = raw.astype(np.int32) - 128
    lengths = np.array([len(p) for p in payloads], np.int64)
    if lengths.min() < 1:
        raise FlacError("an empty stream has no samples")
    per = -(-lengths // BLOCK)
    stream = np.repeat(np.arange(len(payloads)), per)
    index = np.arange(len(stream)) - np.repeat(np.cumsum(per) - per, per)
    number = index + first_number
    starts = np.repeat(np.cumsum(lengths) - lengths, per) + index * BLOCK
    sizes = np.minimum(BLOCK, np.repeat(lengths, per) - index * BLOCK)
    frames = len(starts)
    place = np.arange(len(x)) - np.repeat(starts, sizes)

    # Sum of zigzag residuals by order, and the order with the fewest estimated bits.
    zs, costs, r = [], [], x
    for order in range(5):
        z = np.where(place >= order, _zigzag(r), 0)
        zs.append(z)
        n = sizes - order
        total = np.add.reduceat(z, starts).astype(np.int64)
        k = np.clip(np.floor(np.log2(np.maximum(total, 1) / np.maximum(n, 1))), 0, 14).astype(np.int64)
        costs.append(np.where(n > 0, n * (k + 1) + (total >> k) + 8 * order, 1 << 60))
        r = np.diff(r, prepend=np.int32(0))
    order = np.argmin(costs, axis=0)
    z = np.choose(np.repeat(order, sizes), zs)
    del zs
    predictors: dict[int, tuple[list[int], int]] = {}
    if lpc_order:
        coefs, shifts, valid = _predictors(x, starts, sizes, place, lpc_order)
        guess = np.zeros(len(x), np.int32)
        for j in range(lpc_order):
            guess[j + 1 :] += np.repeat(coefs[j], sizes)[j + 1 :] * x[: -j - 1]
        zz = np.where(place >= lpc_order, _zigzag(x - (guess >> np.repeat(shifts, sizes).astype(np.int32))), 0)
        del guess
        n = sizes - lpc_order
        total = np.add.reduceat(zz, starts, dtype=np.int64)
        k = np.clip(np.floor(np.log2(np.maximum(total, 1) / np.maximum(n, 1))), 0, 14).astype(np.int64)
        better = valid & (n * (k + 1) + (total >> k) + 8 * lpc_order + 9 + PRECISION * lpc_order < np.min(costs, axis=0))
        z = np.where(np.repeat(better, sizes), zz, z)
        order = np.where(better, lpc_order, order)
        predictors = {f: (coefs[:, f].tolist(), int(shifts[f])) for f in np.flatnonzero(better).tolist()}
    n = sizes - order
    total = np.add.reduceat(z, starts).astype(np.int64)
    guess = np.clip(np.floor(np.log2(np.maximum(total, 1) / np.maximum(n, 1))), 0, 14).astype(np.int64)
    best_k, best = guess, np.full(frames, 1 << 60)
    for step in (-1, 0, 1):
        k = np.clip(guess + step, 0, 14)
        # warm-up samples have residual 0 here and no code
        cost = n * (k + 1) + np.add.reduceat(z >> np.repeat(k, sizes), starts)
        best_k, best = np.where(cost < best, k, best_k), np.minimum(cost, best)
    more = np.array([9 + PRECISION * lpc_order if f in predictors else 0 for f in range(frames)]) if predictors else 0
    coded = 8 * order + 10 + best + more
    flat = np.maximum.reduceat(x, starts) == np.minimum.reduceat(x, starts)
    kind = np.where(flat, 0, np.where(coded < 8 * sizes, 2, 1))
    body = np.where(kind == 0, 8, np.where(kind == 1, 8 * sizes, coded))
    heads = [_frame_header(int(a), int(b)) for a, b in zip(sizes, number, strict=True)]
    head = np.array([len(h) for h in heads]) + 1
    length = head + (body + 7) // 8 + 2
    offset = np.cumsum(length) - length
    bits = np.zeros(int(length.sum()) * 8, np.uint8)

    k_each = np.repeat(np.where(kind == 2, best_k, 0), sizes).astype(np.int32)
    live = (place >= np.repeat(order, sizes)) & np.repeat(kind == 2, sizes)
    q = z >> k_each
    width = np.where(live, q + 1 + k_each, 0).astype(np.int64)
    run = np.cumsum(width) - width
    first = (offset + head) * 8 + 8 * order + 10 + more
    at = (run + np.repeat(first - run[starts], sizes))[live]
    q, z, k_each = q[live], z[live], k_each[live]
    at += q
    bits[at] = 1
    at += k_each
    for j in range(int(k_each.max()) if len(k_each) else 0):
        own = k_each > j
        bits[at[own] - j] = (z[own] >> j) & 1
    out = np.packbits(bits)
    del bits
    for f in range(frames):
        o, s, m = int(offset[f]), int(starts[f]), int(order[f])
        code = (0, 1, 8 + m)[kind[f]]
        if f in predictors and kind[f] == 2:
            code = 32 + m - 1
        out[o : o + head[f]] = np.frombuffer(heads[f] + bytes([code << 1]), np.uint8)
        o += int(head[f])
        if kind[f] == 0:
            out[o] = raw[s] ^ 0x80
        elif kind[f] == 1:
            out[o : o + sizes[f]] = raw[s : s + sizes[f]] ^ 0x80
        else:
            out[o : o + m] = raw[s : s + m] ^ 0x80
            word, used = 0, 0
            if f in predictors:
                coefs, shift = predictors[f]
                word, used = 11 << 5 | shift, 9
                for c in coefs:
                    word, used = word << PRECISION | c & 0xFFF, used + PRECISION
            word, used = word << 10 | int(best_k[f]), used + 10
            spare = -used % 8
            out[o + m : o + m + (used + spare) // 8] |= np.frombuffer((word << spare).to_bytes((used + spare) // 8, "big"), np.uint8)
    crc = crc16(out, offset, length - 2)
    out[offset + length - 2], out[offset + length - 1] = crc >> 8, crc & 0xFF

    table = np.zeros(frames, FRAME)
    table["offset"], table["length"], table["number"], table["samples"] = offset, length, number, sizes
    return out.tobytes(), table


class _Bits:
    """Reads single fields of one frame."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        end = self.at + n
        word = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big")
        self.at = end
        return word >> (-end % 8) & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if v >> (n - 1) else v


def _read_header(data: bytes, at: int, bits: int) -> tuple[int, int, int]:
    """(samples, frame number, byte after the header); checks the header's checksum."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 1] & 1:
        raise FlacError("no frame of fixed block size here")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    if data[at + 3] >> 4 or data[at + 3] >> 1 & 7 not in (0, 1) or bits != BITS:
        raise FlacError("only one channel of 8-bit samples is handled")
    p = at + 4
    lead = data[p]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead & (0x7F >> (more + 1 if more else 0))
    for b in data[p + 1 : p + 1 + more]:
        number = number << 6 | b & 0x3F
    p += 1 + more
    if code == 6:
        n, p = data[p] + 1, p + 1
    elif code == 7:
        n, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    elif code >= 8:
        n = 256 << (code - 8)
    elif code >= 2:
        n = 576 << (code - 2)
    elif code == 1:
        n = 192
    else:
        raise FlacError("reserved block size")
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:p]) != data[p]:
        raise FlacError("the checksum of a frame header does not hold")
    return n, number, p + 1


def _rice(windows: np.ndarray, frames: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of many frames (samples x frames) and the bit after each; ``frames`` by falling residual count."""
    count = np.array([f["n"] - f["order"] for f in frames])
    order = np.array([f["order"] for f in frames])
    part = np.array([f["n"] >> f["parts"] for f in frames])
    params = np.array([f["params"] for f in frames])
    pos = np.array([f["at"] for f in frames], np.int64)
    k = np.zeros(len(frames), np.int64)
    raw = np.zeros(len(frames), np.int64)
    left = np.zeros(len(frames), np.int64)  # residuals left in the partition
    begun = np.zeros(len(frames), bool)
    out = np.zeros((int(count[0]), len(frames)), np.int32)
    plain = bool((part == count + order).all())
    alive = np.searchsorted(-count, -np.arange(len(out)), side="left")
    any_raw = False

    def peek(p: np.ndarray) -> np.ndarray:
        return windows[p >> 3] << (p & 7).astype(np.uint64)

    for s in range(len(out)):
        m = int(alive[s])
        if s == 0 or not plain:
            for i in np.flatnonzero(left[:m] == 0):  # a partition begins
                width = int(params[i])
                at = int(pos[i])
                k[i] = int(windows[at >> 3] << np.uint64(at & 7)) >> (64 - width) if width else 0
                pos[i] += width
                raw[i] = -1
                if k[i] == (1 << width) - 1:
                    at = int(pos[i])
                    raw[i] = int((int(windows[at >> 3]) << (at & 7) & (1 << 64) - 1) >> 59)
                    pos[i] += 5
                    any_raw = True
                left[i] = part[i] - (0 if begun[i] else order[i])
                begun[i] = True
            left[:m] -= 1
        p, kk = pos[:m], k[:m]
        w = peek(p)
        zeros = 53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        if (far := zeros >= 53).any():
            for i in np.flatnonzero(far):
                if raw[i] >= 0:
                    continue
                q, at = 0, int(p[i])
                while not (v := int(windows[at >> 3]) << (at & 7) & (1 << 64) - 1) >> 8:
                    q, at = q + 56, at + 56
                    if at >> 3 >= len(windows):
                        raise FlacError("a residual runs over the end")
                zeros[i] = q + 64 - v.bit_length()
        after = p + zeros + 1
        low = (peek(after) >> np.uint64(1)) >> (63 - kk).astype(np.uint64)
        value = (zeros << kk) | low.astype(np.int64)
        value = (value >> 1) ^ -(value & 1)
        after += kk
        if any_raw:
            for i in np.flatnonzero(raw[:m] >= 0):
                b, at = int(raw[i]), int(p[i])
                v = (int(windows[at >> 3]) << (at & 7) & (1 << 64) - 1) >> (64 - b) if b else 0
                value[i] = v - (1 << b) if b and v >> (b - 1) else v
                after[i] = at + b
        out[s, :m] = value
        pos[:m] = after
    return out, pos


def _predict(res: np.ndarray, frames: list[dict], which: np.ndarray) -> None:
    """Turn residuals into samples for frames that share an order; frames x samples go in step."""
    order = frames[which[0]]["order"]
    coefs = np.array([frames[i]["coefs"] for i in which]).T
    shift = np.array([frames[i]["shift"] for i in which])
    x = np.zeros((res.shape[0] + order, len(which)), np.int64)
    x[:order] = np.array([frames[i]["warm"] for i in which]).reshape(len(which), order).T
    x[order:] = res[:, which]
    if order:
        shifted = bool(shift.any())
        for s in range(order, len(x)):
            guess = coefs[0] * x[s - 1]
            for j in range(1, order):
                guess += coefs[j] * x[s - 1 - j]
            x[s] += guess >> shift if shifted else guess
    for col, i in enumerate(which):
        frames[i]["x"] = x[: frames[i]["n"], col]


def _decode_frames(data: bytes, starts: list[int], bits: int) -> list[dict]:
    """Decode the frames that begin at the given bytes of ``data``; verifies both checksums of each."""
    out, coded = [], []
    for at in starts:
        n, number, p = _read_header(data, at, bits)
        sub = data[p] >> 1
        if data[p] & 0x81:
            raise FlacError("a reserved bit, or wasted bits, in a subframe")
        f = {"start": at, "n": n, "number": number, "order": 0, "warm": [], "coefs": [], "shift": 0}
        p += 1
        if sub == 0:
            f |= {"x": np.full(n, data[p] ^ 0x80, np.int64) - 128, "end": p + 1}
        elif sub == 1:
            f |= {"x": (np.frombuffer(data, np.uint8, n, p) ^ 0x80).astype(np.int64) - 128, "end": p + n}
        elif 8 <= sub <= 12 or sub >= 32:
            f["order"] = m = sub - 8 if sub <= 12 else sub - 31
            b = _Bits(data, p * 8)
            f["warm"] = [b.signed(BITS) for _ in range(m)]
            f["coefs"] = FIXED[m] if sub <= 12 else ()
            if sub >= 32:
                precision = b.read(4) + 1
                f["shift"] = b.signed(5)
                if precision == 16 or f["shift"] < 0 or m > n:
                    raise FlacError("a linear predictor that is not valid")
                f["coefs"] = [b.signed(precision) for _ in range(m)]
            method = b.read(2)
            if method > 1:
                raise FlacError("reserved residual coding")
            f |= {"params": 4 + method, "parts": b.read(4)}
            if m >= n:  # warm-up samples alone
                b.read(f["params"])
                f |= {"x": np.array(f["warm"][:n], np.int64), "end": (b.at + 7) // 8}
            else:
                f["at"] = b.at
                coded.append(f)
        else:
            raise FlacError("reserved subframe type")
        out.append(f)
    if coded:
        padded = np.frombuffer(data + bytes(16), np.uint8)
        windows = np.zeros(len(data) + 9, np.uint64)
        for j in range(8):
            windows = windows << np.uint64(8) | padded[j : j + len(windows)]
        coded.sort(key=lambda f: f["order"] - f["n"])
        lo = 0
        while lo < len(coded):
            own = coded[lo : lo + max(1, CELLS // coded[lo]["n"])]
            lo += len(own)
            res, pos = _rice(windows, own)
            orders = np.array([f["order"] for f in own])
            for m in np.unique(orders):
                which = np.flatnonzero(orders == m)
                _predict(res[: own[which[0]]["n"] - m], own, which)
            for f, p in zip(own, pos, strict=True):
                f["end"] = (int(p) + 7) // 8
    buf = np.frombuffer(data, np.uint8)
    ends = np.array([f["end"] for f in out], np.int64)
    if len(out) and (ends + 2 > len(data)).any():
        raise FlacError("a frame runs over the end")
    begin = np.array([f["start"] for f in out], np.int64)
    sums = crc16(buf, begin, ends - begin)
    if ((buf[ends].astype(np.uint16) << 8 | buf[ends + 1]) != sums).any():
        raise FlacError("the checksum of a frame does not hold")
    return out


def _metadata(data: bytes) -> tuple[dict, np.ndarray, int]:
    """(stream information, seek points, byte of the first frame)."""
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    info, seek, at, last = None, np.zeros(0, [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]), 4, False
    while not last:
        if len(data) < at + 4:
            raise FlacError("the metadata end early")
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": block[18:34]}
        elif kind == 3:
            if n % 18 or len(block) < n:
                raise FlacError("seek points that are not valid")
            seek = np.frombuffer(block, seek.dtype)
            seek = seek[seek["sample"] != (1 << 64) - 1]  # without placeholders
        at += 4 + n
    if info is None or info["channels"] != 1:
        raise FlacError("no stream information, or more than one channel")
    return info, seek, at


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of FLAC streams. Verifies header, frame and whole-stream checksums.

    Streams whose seek points name every frame are decoded all at once (long ones in runs of frames, in bounded
    memory), others frame after frame, all in step.
    """
    if any(len(s) > RUN for s in streams) and len(streams) > 1:
        return [decode([s])[0] for s in streams]
    if streams and len(streams[0]) > RUN:
        info, seek, first = _metadata(streams[0])
        if int(seek["samples"].sum()) == info["samples"]:
            pieces = [piece for _, piece in _run_of_frames(streams[0], info, seek, first)]
            if sum(map(len, pieces)) != info["samples"] or any(info["md5"]) and _signed_md5(pieces) != info["md5"]:
                raise FlacError("the checksum of the stream does not hold")
            return [b"".join(pieces)]
    data = b"".join(streams)
    base, at, waiting = 0, [], []
    done: list[list[dict]] = [[] for _ in streams]
    infos = []
    owner: list[int] = []
    for i, s in enumerate(streams):
        info, seek, first = _metadata(s)
        infos.append(info)
        if int(seek["samples"].sum()) == info["samples"]:
            at += [base + first + int(o) for o in seek["offset"]]
            owner += [i] * len(seek)
        elif info["samples"]:
            waiting.append((i, base + first))
        base += len(s)
    for i, f in zip(owner, _decode_frames(data, at, BITS), strict=True):
        done[i].append(f)
    while waiting:
        got = _decode_frames(data, [p for _, p in waiting], BITS)
        for (i, _), f in zip(waiting, got, strict=True):
            done[i].append(f)
        waiting = [(i, f["end"] + 2) for (i, _), f in zip(waiting, got, strict=True) if sum(x["n"] for x in done[i]) < infos[i]["samples"]]
    out = []
    for info, own in zip(infos, done, strict=True):
        x = np.concatenate([f["x"] for f in own]) if own else np.zeros(0, np.int64)
        if len(x) != info["samples"] or len(x) and (x.min() < -128 or x.max() > 127):
            raise FlacError("the samples do not fit the stream information")
        payload = (x + 128).astype(np.uint8)
        if any(info["md5"]) and hashlib.md5((payload ^ 0x80).tobytes()).digest() != info["md5"]:
            raise FlacError("the checksum of the stream does not hold")
        out.append(payload.tobytes())
    return out


def _run_of_frames(stream: bytes, info: dict, seek: np.ndarray, first: int) -> Iterator[tuple[int, bytes]]:
    """(first sample, PCM bytes) of the frames of some neighbouring seek points, decoded in runs of bounded memory."""
    for lo in range(0, len(seek), RUN // BLOCK):
        own = seek[lo : lo + RUN // BLOCK]
        begin = first + int(own["offset"][0])
        end = first + int(seek["offset"][lo + len(own)]) if lo + len(own) < len(seek) else len(stream)
        for point, f in zip(own, _decode_frames(stream[begin:end], [first + int(o) - begin for o in own["offset"]], info["bits"]), strict=True):
            if len(f["x"]) and (f["x"].min() < -128 or f["x"].max() > 127):
                raise FlacError("the samples do not fit the stream information")
            yield int(point["sample"]), (f["x"] + 128).astype(np.uint8).tobytes()


def pcm_blocks(stream: bytes, from_sample: int = 0, to_sample: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(first sample, PCM bytes) of each frame that has samples in the range, found by the seek points alone."""
    info, seek, first = _metadata(stream)
    stop = info["samples"] if to_sample is None else to_sample
    own = seek[(seek["sample"] < stop) & (seek["sample"] + seek["samples"] > from_sample)]
    yield from _run_of_frames(stream, info, own, first)


def seek_points(stream: bytes) -> list[tuple[int, int, int]]:
    """(first sample, byte offset in the stream, samples) of every frame."""
    _, seek, first = _metadata(stream)
    return [(int(s), first + int(o), int(n)) for s, o, n in seek]
