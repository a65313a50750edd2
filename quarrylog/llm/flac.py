"""Media columns: a FLAC codec for 8-bit mono payloads, vectorised over the frames of many streams at once.

`encode` stores each text's UTF-8 bytes, padded with spaces to whole frames of 192 samples, as one FLAC stream per row:
STREAMINFO, a SEEKTABLE, and frames whose subframes are constant, verbatim, fixed-predictor or quantised linear-predictor
with Rice-coded residuals, whichever is smallest. `decode_blocks` reads streams back into PCM blocks with their sample
offsets; every frame's CRC-8 and CRC-16, each stream's MD5 and its seek points are verified, and a stream that fails raises.

Cases: null text is the empty text (one frame of spaces); equal texts give equal streams; texts of any length are whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylog.llm._ops import arrow_map, pick
from quarrylog.llm._text import chunks

FRAME = 192
#: A seek point every so many frames.
SEEK_EVERY = 64
LPC_ORDER = 4
LPC_PRECISION = 9
CHUNK = 1 << 20

# Fixed values of the FLAC format.
BLOCK_CODE_192 = 1
RATE_CODE_8K = 4
SIZE_CODE_8 = 1
SAMPLE_RATE = 8000
FIXED_PREDICTORS = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint16)
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out[i] = c
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc8(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(start), np.uint16)
    for j in range(int(length.max(initial=0))):
        crc = np.where(j < length, CRC8[crc ^ data[np.minimum(start + j, len(data) - 1)]], crc)
    return crc


def _crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges at once; ranges are worked longest first so finished ones drop out."""
    order = np.argsort(-length, kind="stable")
    at, size = start[order], length[order]
    crc, live = np.zeros(len(at), np.uint16), len(at)
    for j in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size[:live], -j, "left"))
        c = crc[:live]
        crc[:live] = (c << 8) ^ CRC16[(c >> 8) ^ data[at[:live] + j]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number_bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frame numbers' UTF-8-like coding: (count, bytes[frames, 6])."""
    size = 1 + sum((n >= limit).astype(np.int64) for limit in (0x80, 0x800, 0x10000, 0x200000, 0x4000000))
    out = np.zeros((len(n), 6), np.uint8)
    for s in range(1, 7):
        rows = size == s
        if not rows.any():
            continue
        v = n[rows]
        if s == 1:
            out[rows, 0] = v
        else:
            lead = (0xFF00 >> s) & 0xFF
            out[rows, 0] = lead | (v >> (6 * (s - 1)))
            for j in range(1, s):
                out[rows, j] = 0x80 | ((v >> (6 * (s - 1 - j))) & 0x3F)
    return size, out


def _lpc(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors of each frame by the autocorrelation method: coefficients [frames, order] and shifts."""
    x = samples.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", x[:, lag:], x[:, : FRAME - lag]) for lag in range(LPC_ORDER + 1)], 1)
    err = r[:, 0] + 1e-9
    a = np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        acc = r[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], r[:, i:0:-1]) if i else r[:, 1]
        k = np.clip(acc / err, -0.999, 0.999)
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        err = err * (1 - k * k) + 1e-9
    limit = (1 << (LPC_PRECISION - 1)) - 1
    top = np.abs(a).max(1)
    shift = np.clip(LPC_PRECISION - 2 - np.ceil(np.log2(np.maximum(top, 2.0**-14))).astype(np.int64), 0, 14)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def _residual(samples: np.ndarray, coefficients: np.ndarray, shift: np.ndarray | int, order: int) -> np.ndarray:
    """Samples less predictions; the first `order` columns are meaningless."""
    predicted = np.zeros_like(samples)
    for j in range(order):
        predicted[:, j + 1 :] += coefficients[:, j : j + 1] * samples[:, : FRAME - j - 1]
    return samples - (predicted >> (shift[:, None] if isinstance(shift, np.ndarray) else shift))


def _rice(residual: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag values, parameter and bits of each frame: the better of the two parameters around the mean's logarithm."""
    u = (residual << 1) ^ (residual >> 31)
    tail = u[:, order:]
    high = np.clip(np.log2(tail.mean(1) + 1).astype(np.int64), 1, 8)
    low = high - 1
    costs = [(tail >> k[:, None].astype(np.int32)).sum(1, dtype=np.int64) + (k + 1) * (FRAME - order) for k in (low, high)]
    return u, np.where(costs[0] <= costs[1], low, high), np.minimum(*costs)


def _or_bits(total_bytes: int, tokens: list[tuple[np.ndarray, np.ndarray, np.ndarray | int]]) -> np.ndarray:
    """Bytes with each (bit position, value, width of at most 9 bits) set; positions don't overlap."""
    acc = np.zeros(total_bytes + 1)
    for position, value, width in tokens:
        window = value << (16 - width - (position & 7))
        byte = position >> 3
        acc += np.bincount(byte, window >> 8, total_bytes + 1)
        acc[1:] += np.bincount(byte, window & 255, total_bytes + 1)[:-1]
    return acc[:-1].astype(np.uint8)


def encode_payloads(payload: np.ndarray, n_frames: np.ndarray) -> list[bytes]:
    """FLAC streams of payloads laid end to end, each of n_frames whole frames."""
    total = int(n_frames.sum())
    samples = payload.reshape(total, FRAME).astype(np.int32) - 128
    first_frame = np.concatenate(([0], np.cumsum(n_frames)))
    number = np.arange(total) - np.repeat(first_frame[:-1], n_frames)

    # Kind 0 constant, 1 verbatim, 2 and 3 fixed predictors of order 0 and 1, 5 linear predictor.
    best_bits, kind = np.full(total, 8 * FRAME, np.int64), np.ones(total, np.int64)
    rice_k, order, zigzag = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros((total, FRAME), np.int32)
    coefficients, shift = _lpc(samples)
    for number_of_kind, p, c, s, extra in (
        (2, 0, np.zeros((total, 0), np.int32), 0, 0),
        (3, 1, np.ones((total, 1), np.int32), 0, 0),
        (5, LPC_ORDER, coefficients.astype(np.int32), shift.astype(np.int32), 9 + LPC_PRECISION * LPC_ORDER),
    ):
        u, k, bits = _rice(_residual(samples, c, s, p), p)
        bits = bits + 8 * p + extra + 10
        better = bits < best_bits
        best_bits[better], kind[better], rice_k[better], order[better], zigzag[better] = bits[better], number_of_kind, k[better], p, u[better]
    constant = (samples == samples[:, :1]).all(1)
    kind[constant], best_bits[constant], order[constant] = 0, 8, 0

    n_size, n_bytes = _number_bytes(number)
    head = 4 + n_size + 1
    length = head + 1 + (best_bits + 7) // 8 + 2
    start = np.concatenate(([0], np.cumsum(length)))
    body = start[:-1] + head + 1  # first byte after the subframe header

    tokens = []
    coded = np.flatnonzero(kind >= 2)
    if len(coded):
        at = body[coded] * 8 + 8 * order[coded]
        is_lpc = kind[coded] == 5
        lpc = coded[is_lpc]
        if len(lpc):
            where = at[is_lpc]
            tokens += [(where, np.full(len(lpc), LPC_PRECISION - 1), 4), (where + 4, shift[lpc], 5)]
            tokens += [(where + 9 + LPC_PRECISION * j, coefficients[lpc, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION) for j in range(LPC_ORDER)]
        at = at + np.where(is_lpc, 9 + LPC_PRECISION * LPC_ORDER, 0)
        k = rice_k[coded][:, None]
        tokens.append((at + 6, k[:, 0], 4))
        u = zigzag[coded].astype(np.int64)
        quotient = u >> k
        size = quotient + 1 + k
        for j in range(LPC_ORDER):  # warm-up samples have no code
            size[order[coded] > j, j] = 0
        stop = (at + 10)[:, None] + np.cumsum(size, 1) - k - 1
        live = size > 0
        value = (u & ((1 << k) - 1)) | (1 << k)
        width = np.broadcast_to(k + 1, u.shape)
        tokens.append((stop.ravel(), value.ravel(), width.ravel()) if live.all() else (stop[live], value[live], width[live]))
    out = _or_bits(int(start[-1]), tokens)
    s = start[:-1]
    out[s], out[s + 1], out[s + 2], out[s + 3] = 0xFF, 0xF8, BLOCK_CODE_192 << 4 | RATE_CODE_8K, SIZE_CODE_8 << 1
    for j in range(int(n_size.max())):
        has = n_size > j
        out[s[has] + 4 + j] = n_bytes[has, j]
    out[s + head - 1] = _crc8(out, s, head - 1)
    out[s + head] = np.select([kind == 0, kind == 1, kind == 5], [0, 1, 0x20 | (LPC_ORDER - 1)], 8 | order) << 1
    raw = (samples + 128).astype(np.uint8) ^ 0x80  # two's complement
    rows = kind == 0
    out[body[rows]] = raw[rows, 0]
    rows = np.flatnonzero(kind == 1)
    out[(body[rows][:, None] + np.arange(FRAME)).ravel()] = raw[rows].ravel()
    for j in range(LPC_ORDER):
        rows = (kind >= 2) & (order > j)
        out[body[rows] + j] = raw[rows, j]
    crc = _crc16(out, s, length - 2)
    out[s + length - 2], out[s + length - 1] = crc >> 8, crc & 0xFF

    streams = []
    for d in range(len(n_frames)):
        a, b = first_frame[d], first_frame[d + 1]
        sizes, n = length[a:b], int(n_frames[d]) * FRAME
        digest = hashlib.md5(raw[a:b].tobytes()).digest()
        points = range(a, b, SEEK_EVERY)
        table = b"".join(struct.pack(">QQH", (p - a) * FRAME, int(start[p] - start[a]), FRAME) for p in points)
        info = struct.pack(">HH", FRAME, FRAME) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + digest
        streams.append(b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table + out[start[a] : start[b]].tobytes())
    return streams


_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])


class BadStream(ValueError):
    """A stream breaks the format or one of its checksums."""


def _stream_info(data: memoryview) -> tuple[int, int, int, bytes, np.ndarray]:
    """(offset of the first frame, bits a sample, samples, md5, seek points as rows of sample, offset, samples)."""
    if bytes(data[:4]) != b"fLaC":
        raise BadStream("no fLaC marker")
    at, info, last, points = 4, None, False, np.zeros(0, _POINT)
    while not last:
        if at + 4 + int.from_bytes(data[at + 1 : at + 4], "big") > len(data):
            raise BadStream("metadata reaches beyond the stream")
        last, kind, size = data[at] >= 128, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            packed = int.from_bytes(data[at + 14 : at + 22], "big")
            if (packed >> 41) & 7:
                raise BadStream("more than one channel")
            info = ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1), bytes(data[at + 22 : at + 38])
        elif kind == 3:
            points = np.frombuffer(data[at + 4 : at + 4 + size - size % _POINT.itemsize], _POINT)
        at += 4 + size
    if info is None:
        raise BadStream("no STREAMINFO")
    return at, *info, points[points["sample"] != 2**64 - 1]  # all ones: a place held free


def _headers(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, header lengths, streams and frame numbers of all that may be frames: sync codes with a valid header and CRC-8."""
    sync = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0xF8))
    stream = np.searchsorted(begin, sync, "right") - 1
    ok = (stream >= 0) & (sync >= begin[stream]) & (sync + 6 < end[stream])
    # One channel, reserved bit, block size and rate codes that exist.
    ok &= ((data[np.minimum(sync + 3, len(data) - 1)] & 0xF1) == 0) & (data[sync + 2] >> 4 > 0) & (data[sync + 2] & 15 < 15)
    sync, stream = sync[ok], stream[ok]
    lead = data[sync + 4]
    size = np.select([lead < 0x80, lead >> 5 == 6, lead >> 4 == 14, lead >> 3 == 30, lead >> 2 == 62, lead >> 1 == 126], [1, 2, 3, 4, 5, 6], 0)
    number = np.where(size == 1, lead, lead & (0x7F >> np.maximum(size, 1))).astype(np.int64)
    for j in range(1, 6):
        more = size > j
        number[more] = number[more] << 6 | (data[np.minimum(sync[more] + 4 + j, len(data) - 1)] & 0x3F)
    code = data[sync + 2] >> 4
    head = 4 + size + np.where(code == 6, 1, np.where(code == 7, 2, 0)) + 1
    ok = (size > 0) & (sync + head < end[stream])
    sync, stream, number, head = sync[ok], stream[ok], number[ok], head[ok]
    ok = _crc8(data, sync, head - 1) == data[sync + head - 1]
    return sync[ok], head[ok], stream[ok], number[ok]


def _holds(data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether the CRC-16 of each frame from `at` to `stop` holds."""
    return _crc16(data, at, stop - at - 2) == (data[stop - 2].astype(np.uint16) << 8 | data[stop - 1])


def _chain(data: np.ndarray, begin: int, end: int, at: np.ndarray, head: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which of a stream's headers are frames: those from `begin` to `end` with numbers 0, 1, 2, ... whose CRC-16 all hold."""
    pairs = [(i, j) for i, n in enumerate(number.tolist()) for j in np.flatnonzero(number == n + 1).tolist() if at[j] > at[i] + head[i] + 2]
    one, two = np.array(pairs, np.int64).reshape(-1, 2).T
    held = _holds(data, at[one], at[two])
    after: dict[int, list[int]] = {}
    for i, j in zip(one[held].tolist(), two[held].tolist(), strict=True):
        after.setdefault(i, []).append(j)
    open_ends = np.array([i for i in range(len(at)) if i not in after and at[i] + head[i] + 2 < end], np.int64)
    lasts = set(open_ends[_holds(data, at[open_ends], np.full(len(open_ends), end))].tolist())
    follow: dict[int, int] = {}  # -1: the stream's last frame
    for i in range(len(at) - 1, -1, -1):
        if i in lasts:
            follow[i] = -1
        elif (nexts := [j for j in after.get(i, []) if j in follow]):
            follow[i] = nexts[0]
    if not len(at) or at[0] != begin or number[0] != 0 or 0 not in follow:
        raise BadStream("a frame's CRC-16 differs")
    found, i = [], 0
    while i >= 0:
        found.append(i)
        i = follow[i]
    return np.array(found)


def _frame_starts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, header lengths and streams of all frames; each frame's CRC-16 holds.

    Frames' bits may look like a header by chance, so where headers' numbers don't run 0, 1, 2, ... or a CRC-16 between
    neighbours differs, the stream's headers are told apart by CRC-16.
    """
    at, head, stream, number = _headers(data, begin, end)
    first = np.searchsorted(stream, np.arange(len(begin) + 1))
    # A frame ends where the next of its stream begins.
    last = np.ones(len(at), bool)
    last[:-1] = stream[1:] != stream[:-1]
    stop = np.where(last, end[stream], np.concatenate((at[1:], [0])))
    ok = number == np.arange(len(at)) - first[stream]
    long_enough = stop >= at + head + 2
    ok &= long_enough
    ok[long_enough] &= _holds(data, at[long_enough], stop[long_enough])
    keep = np.ones(len(at), bool)
    for s in np.unique(stream[~ok]).tolist():
        own = slice(first[s], first[s + 1])
        keep[own] = False
        keep[first[s] + _chain(data, int(begin[s]), int(end[s]), at[own], head[own], number[own])] = True
    return at[keep], head[keep], stream[keep]


def _rice_tail(samples, word, coded, pos, k, coefficients, shift, begin, peek) -> None:
    """Samples from `begin` on of Rice-coded frames that all have as many: a step for each sample, over all frames."""
    n = len(coded)
    at, k, shift, weights = pos[coded].astype(np.uint64), k[coded].astype(np.uint64), shift[coded], np.ascontiguousarray(coefficients[:, coded])
    used = [j for j in range(len(weights)) if weights[j].any()]
    history = [np.ascontiguousarray(samples[begin - 1 - j, coded]) for j in range(len(weights))]
    one, three, seven, eleven, keep = np.uint64(1), np.uint64(3), np.uint64(7), np.uint64(11), np.uint64(63) - k
    exponent, out = np.uint64(1075), np.empty((len(samples) - begin, n), np.int64)
    k_top = int(k.max())
    for i in range(len(out)):
        w = word[at >> three] << (at & seven)
        zeros = exponent - ((w >> eleven).astype(np.float64).view(np.uint64) >> np.uint64(52))
        if int(zeros.max()) + 1 + k_top > 57:  # few: long runs of zeros
            quotient, at = zeros.copy(), at.copy()
            for f in np.flatnonzero(zeros + k > np.uint64(55)).tolist():
                q, p = 0, at[f : f + 1].astype(np.int64)
                while not int(peek(p)[0]) >> 11:
                    q, p = q + 46, p + 46
                q_more = 53 - (int(peek(p)[0]) >> 11).bit_length()
                quotient[f] = q + q_more
            at = at + quotient + one
            low = (word[at >> three] << (at & seven)) >> one >> keep
            at = at + k
        else:
            quotient = zeros
            low = (w << (zeros + one)) >> one >> keep
            at = at + zeros + one + k
        u = (quotient << k | low).view(np.int64)
        value = (u >> 1) ^ -(u & 1)
        if used:
            predicted = weights[used[0]] * history[used[0]]
            for j in used[1:]:
                predicted += weights[j] * history[j]
            value = value + (predicted >> shift)
        out[i] = value
        history = [value, *history[:-1]] if history else history
    samples[begin:, coded] = out


def decode_streams(streams: list[memoryview]) -> list[np.ndarray]:
    """Samples (int32) of fixed-blocksize mono streams of 4 to 16 bits."""
    infos = [_stream_info(s) for s in streams]
    lengths = np.array([len(s) for s in streams], np.int64)
    offset = np.concatenate(([0], np.cumsum(lengths)))
    data = np.concatenate([*(np.frombuffer(s, np.uint8) for s in streams), np.zeros(16, np.uint8)])
    begin, end = offset[:-1] + np.array([i[0] for i in infos]), offset[1:]
    at, head, stream = _frame_starts(data, begin, end)
    n = len(at)
    code = data[at + 2] >> 4
    block = np.select([code == c for c in BLOCK_SIZES], list(BLOCK_SIZES.values()), 0)
    tail = data[at + head - 2].astype(np.int64)
    block = np.where(code == 6, tail + 1, np.where(code == 7, (data[at + head - 3].astype(np.int64) << 8 | tail) + 1, block))
    depth = np.array([i[1] for i in infos])[stream]
    width = int(block.max(initial=0))

    word = np.zeros(len(data) - 8, np.uint64)  # the 64 bits from each byte on
    for j in range(8):
        word = word << np.uint64(8) | data[j : len(data) - 8 + j]

    def peek(pos: np.ndarray) -> np.ndarray:
        return word[pos >> 3] << (pos & 7).astype(np.uint64)

    def take(pos: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return np.where(bits > 0, peek(pos) >> (64 - np.maximum(bits, 1)).astype(np.uint64), 0).astype(np.int64)

    def signed_take(pos: np.ndarray, bits: np.ndarray) -> np.ndarray:
        v = take(pos, bits)
        return np.where(v >> (bits - 1) & 1, v - (1 << bits), v)

    kind = data[at + head] >> 1
    if (data[at + head] & 1).any():
        raise BadStream("wasted bits are not read")
    constant, verbatim, is_lpc = kind == 0, kind == 1, kind >= 32
    order = np.where(is_lpc, (kind & 31) + 1, np.where(constant | verbatim, 0, kind & 7)).astype(np.int64)
    pos = (at + head + 1) * 8
    samples = np.zeros((width, n), np.int64)  # a row for each sample, so that one step over all frames is contiguous
    for j in range(int(order.max(initial=0))):
        has = order > j
        samples[j, has] = signed_take(pos, depth)[has]
        pos = pos + np.where(has, depth, 0)
    top = int(order.max(initial=0))
    coefficients, shift = np.zeros((top, n), np.int64), np.zeros(n, np.int64)
    for p, values in FIXED_PREDICTORS.items():
        rows = (kind >= 8) & (kind < 13) & (order == p)
        for j, c in enumerate(values[:top]):
            coefficients[j, rows] = c
    precision = take(pos, np.full(n, 4)) + 1
    shift = np.where(is_lpc, take(pos + 4, np.full(n, 5)), 0)
    pos = pos + np.where(is_lpc, 9, 0)
    for j in range(int(order[is_lpc].max(initial=0))):
        has = is_lpc & (order > j)
        coefficients[j, has] = signed_take(pos, precision)[has]
        pos = pos + np.where(has, precision, 0)
    raw = constant | verbatim
    method = np.where(raw, 0, take(pos, np.full(n, 2)))
    parts = np.where(raw, 0, take(pos + 2, np.full(n, 4)))
    pos = pos + np.where(raw, 0, 6)
    k, escape = np.zeros(n, np.int64), np.zeros(n, bool)
    per_part = block >> parts
    k_bits = 4 + method
    coded = np.flatnonzero(~raw)
    # Frames of one shape (one partition, no escape, all samples) leave the general loop after their warm-up.
    simple = len(coded) and not parts.any() and (block == width).all()
    for i in range(width):
        if simple and i > top and not escape.any():
            _rice_tail(samples, word, coded, pos, k, coefficients, shift, i, peek)
            samples[:, constant] = samples[0, constant]
            for j in range(i, width if verbatim.any() else i):
                samples[j, verbatim] = signed_take(pos[verbatim], depth[verbatim])
                pos = pos + np.where(verbatim, depth, 0)
            break
        live = ~raw & (i >= order) & (i < block)
        fresh = live & ((i == order) | (i % per_part == 0))
        if fresh.any():
            k = np.where(fresh, take(pos, k_bits), k)
            pos = pos + np.where(fresh, k_bits, 0)
            escape = np.where(fresh, k == (1 << k_bits) - 1, escape)
            if (fresh & escape).any():
                k = np.where(fresh & escape, take(pos, np.full(n, 5)), k)
                pos = pos + np.where(fresh & escape, 5, 0)
        quotient = np.zeros(n, np.int64)
        w = peek(pos) >> np.uint64(11)
        unary = live & ~escape
        while (far := unary & (w == 0)).any():  # 53 zeros and more: read on
            quotient, pos = quotient + np.where(far, 46, 0), pos + np.where(far, 46, 0)
            w = np.where(far, peek(pos) >> np.uint64(11), w)
        zeros = 1075 - (w.astype(np.float64).view(np.int64) >> 52)
        quotient = quotient + zeros
        pos = pos + np.where(unary, zeros + 1, 0)
        low = take(pos, k)
        pos = pos + np.where(live, k, 0)
        u = quotient << k | low
        value = (u >> 1) ^ -(u & 1)
        if escape.any():
            value = np.where(escape, np.where(k > 0, signed_take(pos - k, np.maximum(k, 1)), 0), value)
        predicted = np.zeros(n, np.int64)
        for j in range(min(top, i)):
            predicted += coefficients[j] * samples[i - 1 - j]
        value = value + (predicted >> shift)
        given = signed_take(pos, depth) if raw.any() else value
        samples[i] = np.where(live, value, np.where(raw, np.where(constant & (i > 0), samples[0], given), samples[i]))
        pos = pos + np.where(verbatim & (i < block), depth, 0)
    by_frame = np.ascontiguousarray(samples.T).astype(np.int32)
    first = np.searchsorted(stream, np.arange(len(streams) + 1))
    out = []
    for d, (_, bits, total, digest, points) in enumerate(infos):
        rows = slice(first[d], first[d + 1])
        one = by_frame[rows]
        keep = block[rows]
        one = one.ravel() if (keep == width).all() else np.concatenate([f[:b] for f, b in zip(one, keep, strict=True)])
        if len(one) != total:
            raise BadStream(f"{len(one)} samples of {total}")
        if len(points):
            upto = np.cumsum(keep)
            frame = np.minimum(np.searchsorted(upto, points["sample"].astype(np.int64), "right"), len(keep) - 1)
            is_frame = (upto[frame] - keep[frame] == points["sample"]) & (at[rows][frame] - begin[d] == points["offset"]) & (keep[frame] == points["samples"])
            if not is_frame.all():
                raise BadStream("a seek point leads to no frame")
        if digest != bytes(16) and hashlib.md5((one.astype(np.int8) if bits <= 8 else one.astype("<i2")).tobytes()).digest() != digest:
            raise BadStream("the MD5 of the samples differs")
        out.append(one)
    return out


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads of whole frames laid end to end, and their frame counts."""
    size = np.diff(offsets)
    n_frames = np.maximum(1, -(-size // FRAME))
    start = np.concatenate(([0], np.cumsum(n_frames * FRAME)))
    payload = np.full(int(start[-1]), 32, np.uint8)
    payload[np.arange(len(data)) + np.repeat(start[:-1] - offsets[:-1], size)] = data
    return payload, n_frames


def encode(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One FLAC stream a row: (key, n_bytes: length before padding, media)."""
    work = pick(df, key=key, text=text)

    def run(batch):
        keys = batch.column("key")
        for a, b, data, offsets in chunks(batch.column("text"), CHUNK):
            yield {"key": keys.slice(a, b - a), "n_bytes": np.diff(offsets), "media": pa.array(encode_payloads(*_padded(data, offsets)), pa.binary())}

    return arrow_map(work, run, f"key {work.schema['key'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("key", key)


def _decoded(batch):
    """(first row, samples of each stream) of bounded runs of a batch's media column."""
    media = batch.column("media")
    for a, b, data, offsets in chunks(media, CHUNK):
        view = memoryview(data)
        yield a, b, view, offsets, decode_streams([view[offsets[i] : offsets[i + 1]] for i in range(b - a)])


def decode_blocks(df: DataFrame, key: str = "doc_id", media: str = "media", block_samples: int = FRAME * SEEK_EVERY) -> DataFrame:
    """PCM blocks of each stream: (key, block, sample_offset, n_samples, pcm), pcm as signed little-endian samples.

    Blocks hold block_samples samples but for the last; the block of sample s is s div block_samples. A null stream has
    no blocks; a damaged one raises.
    """
    work = pick(df, key=key, media=media).filter("media is not null")

    def run(batch):
        keys = batch.column("key")
        for a, b, _, _, decoded in _decoded(batch):
            for i in range(b - a):
                x = decoded[i]
                at = np.arange(0, len(x), block_samples)
                kind = np.int8 if x.min() >= -128 and x.max() < 128 else np.dtype("<i2")
                yield {"key": pa.concat_arrays([keys.slice(a + i, 1)] * len(at)), "block": np.arange(len(at)), "sample_offset": at, "n_samples": np.minimum(block_samples, len(x) - at), "pcm": pa.array([x[p : p + block_samples].astype(kind).tobytes() for p in at], pa.binary())}

    return arrow_map(work, run, f"key {work.schema['key'].dataType.simpleString()}, block long, sample_offset long, n_samples long, pcm binary").withColumnRenamed("key", key)


def features(x: np.ndarray) -> str:
    """Integer features of 8-bit samples: energy, zero crossings, peak and distinct levels."""
    wide = x.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"energy={int((wide * wide).sum())};crossings={crossings};peak={int(np.abs(wide).max())};levels={len(np.unique(x))}"


def read_back(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest of streams made by `encode`: what the stored bytes decode to.

    (key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)
    """
    work = pick(df, key=key, n_bytes="n_bytes", media="media")

    def run(batch):
        for a, b, view, offsets, decoded in _decoded(batch):
            payloads = [(x + 128).astype(np.uint8).tobytes() for x in decoded]
            yield {
                "key": batch.column("key").slice(a, b - a), "n_bytes": batch.column("n_bytes").slice(a, b - a),
                "payload_bytes": [len(p) for p in payloads], "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
                "tail_crc32": [zlib.crc32(p[-16:]) for p in payloads], "media_bytes": np.diff(offsets),
                "media_sha256": [hashlib.sha256(view[offsets[i] : offsets[i + 1]]).hexdigest() for i in range(b - a)],
                "feature": [features(x) for x in decoded],
            }

    return arrow_map(work, run, f"key {work.schema['key'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("key", key)
