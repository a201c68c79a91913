"""A FLAC codec for 8-bit mono PCM that works on many frames at once with numpy.

Streams are written with the fixed predictors of order 0-2 (those of text bytes gain nothing by more) and one Rice parameter a frame, and carry a seek point for
each frame. The reader takes any mono stream of up to 16 bits: constant, verbatim, fixed and LPC subframes, both Rice
codings with partitions and escapes, wasted bits, and checks CRC-8, CRC-16 and MD5. Frames whose place is known from the
seek table are decoded side by side: step s of the loop reads code s of every frame.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np

BLOCK = 1024
RATE = 8000
#: Payload bytes that are worked on at once (a longer payload is one piece).
PIECE = 1 << 20
# Coefficients of the fixed predictors, nearest sample first.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


class FlacError(ValueError):
    pass


def _crc_table(bits: int, poly: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, t << 1 ^ poly, t << 1) & ((1 << bits) - 1)
    return t


CRC8, CRC16 = _crc_table(8, 0x07).tolist(), _crc_table(16, 0x8005)
_SHIFTED = [CRC16.astype(np.uint16)]


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def _shifted(n: int) -> np.ndarray:
    """Row d: what each byte value adds to the CRC-16 if d more bytes follow it."""
    while len(_SHIFTED) < n:
        last = _SHIFTED[-1].astype(np.uint32)
        _SHIFTED.append(((last << 8 & 0xFFFF) ^ CRC16[last >> 8]).astype(np.uint16))
    return np.stack(_SHIFTED[:n]) if n else np.zeros((0, 256), np.uint16)


_STACK: list[np.ndarray] = [np.zeros((0, 256), np.uint16)]


def forget() -> None:
    """Drops what the checksums keep; for the end of a task."""
    _STACK[0] = np.zeros((0, 256), np.uint16)




def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:end] for each frame; the checksum is linear, so bytes add up by exclusive or."""
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint16)
    longest = int(lengths.max())
    if longest > 1 << 14:  # rare long frames: byte after byte
        return np.array([_crc16_slow(data[s:e]) for s, e in zip(starts, ends)], np.uint16)
    if len(_STACK[0]) < longest:
        _STACK[0] = _shifted(longest + 512)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(rows)) - first[rows]
    parts = _STACK[0][lengths[rows] - 1 - at, data[starts[rows] + at]]
    return np.bitwise_xor.reduceat(parts, first)


def _crc16_slow(data: np.ndarray) -> int:
    c, t = 0, CRC16.tolist()
    for b in data.tobytes():
        c = (c << 8 & 0xFFFF) ^ t[c >> 8 ^ b]
    return c


def _utf8(n: int) -> bytes:
    """The frame number in the extended UTF-8 form, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    return bytes([(0xFF00 >> k & 0xFF) | n >> (6 * (k - 1))] + [0x80 | n >> (6 * i) & 0x3F for i in reversed(range(k - 1))])


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """Payloads (bytes are signed 8-bit samples; none empty) -> FLAC streams."""
    out: list[bytes] = []
    group: list[bytes] = []
    held = 0
    for p in payloads:
        if held + len(p) > PIECE and group:
            out += _encode(group, block)
            group, held = [], 0
        group.append(p)
        held += len(p)
    return out + (_encode(group, block) if group else [])


def _encode(payloads: list[bytes], block: int) -> list[bytes]:
    sizes = np.array([len(p) for p in payloads])
    per = -(-sizes // block)
    doc = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    n = np.minimum(block, sizes[doc] - number * block)
    flat = np.frombuffer(b"".join(payloads), np.int8).astype(np.int32)
    first = np.cumsum(n) - n  # frames lie one after the other

    # Residuals of orders 0-2 over the flat samples (warm-up samples count as 0). The sum of the folded residuals bounds
    # the bits that a parameter k takes: n * (k + 1) + sum >> k; order and k come from that bound.
    best = np.full(len(n), np.iinfo(np.int64).max)
    order, k = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    residual, folded = flat, []
    for o in range(3):
        if o:
            residual = np.diff(residual, prepend=np.int32(0))
        z = (residual << 1) ^ (residual >> 31)
        for w in range(o):
            z[(first + w)[n > w]] = 0
        folded.append(z)
        total, coded = np.add.reduceat(z, first, dtype=np.int64), np.maximum(n - o, 0)
        guess = np.log2(np.maximum(total / np.maximum(coded, 1), 1)).astype(np.int64)
        for kk in (np.maximum(guess - 1, 0), guess):
            bits = (total >> kk) + coded * (kk + 1) + 8 * o + 10
            better = (bits < best) & (n > o)
            best[better], order[better], k[better] = bits[better], o, kk[better]
    plain = best >= 8 * n  # verbatim is no longer
    constant = np.minimum.reduceat(flat, first) == np.maximum.reduceat(flat, first)
    kind = np.where(constant, 0, np.where(plain, 1, 8 + order))

    order_s = np.repeat(np.where(kind >= 8, order, 0).astype(np.int8), n)
    z = np.where(order_s == 1, folded[1], np.where(order_s == 2, folded[2], folded[0]))
    col = np.arange(len(flat), dtype=np.int32) - np.repeat(first.astype(np.int32), n)
    coded = np.repeat(kind >= 8, n) & (col >= order_s)
    raw = ~coded & (np.repeat(kind != 0, n) | (col == 0))
    k_s = np.repeat(k.astype(np.int32), n)
    q = z >> k_s
    width = np.where(coded, q + 1 + k_s, np.where(raw, np.int32(8), np.int32(0)))

    heads = []
    for d, i, m, t in zip(doc.tolist(), number.tolist(), n.tolist(), kind.tolist()):
        head = b"\xff\xf8\x74\x02" + _utf8(i) + (m - 1).to_bytes(2, "big")
        heads.append(head + bytes([crc8(head), t << 1]))
    head_bits = np.array([8 * len(h) for h in heads])
    rice_bits = np.where(kind >= 8, 10, 0)  # coding method, partition order 0, parameter: after the warm-up samples
    body = np.add.reduceat(width, first)
    frame_bytes = -(-(head_bits + rice_bits + body) // 8) + 2
    frame_at = np.cumsum(frame_bytes) - frame_bytes
    bits = np.zeros(8 * int(frame_bytes.sum()), np.uint8)

    within = np.cumsum(width, dtype=np.int32) - width
    place = within + np.repeat((8 * frame_at + head_bits - within[first]).astype(np.int32), n)
    at, sample = place[raw], flat[raw] & 0xFF
    for b in range(8):
        bits[at + b] = sample >> (7 - b) & 1
    kc = k_s[coded]
    at, zc = place[coded] + q[coded] + 10, z[coded]
    bits[at] = 1
    for b in range(int(kc.max()) if len(kc) else 0):
        if (kc > b).all():
            bits[at + kc - b] = zc >> b & 1
        else:
            m = kc > b
            bits[at[m] + kc[m] - b] = zc[m] >> b & 1
    rice_at = (8 * frame_at + head_bits + 8 * order)[kind >= 8]
    for b in range(4):
        bits[rice_at + 6 + b] = k[kind >= 8] >> (3 - b) & 1
    data = np.packbits(bits)
    head_flat = np.frombuffer(b"".join(heads), np.uint8)
    size = head_bits // 8
    data[np.repeat(frame_at - (np.cumsum(size) - size), size) + np.arange(len(head_flat))] = head_flat
    ends = frame_at + frame_bytes
    check = crc16(data, frame_at, ends - 2)
    data[ends - 2], data[ends - 1] = check >> 8, check & 0xFF

    streams, frame = [], 0
    for p, f in zip(payloads, per.tolist()):
        mine = slice(frame, frame + f)
        lengths, at = frame_bytes[mine], frame_at[mine]
        info = (
            min(block, 65535).to_bytes(2, "big") * 2
            + int(lengths.min()).to_bytes(3, "big")
            + int(lengths.max()).to_bytes(3, "big")
            + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big")
            + hashlib.md5(p).digest()
        )
        points = np.zeros(f, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = number[mine] * block, at - at[0], n[mine]
        seek = points.tobytes()
        marked = len(seek) < 1 << 24  # a longer seek table has no room in its block
        streams.append(
            b"fLaC" + bytes([0 if marked else 0x80]) + len(info).to_bytes(3, "big") + info + (b"\x83" + len(seek).to_bytes(3, "big") + seek if marked else b"") + data[at[0] : at[-1] + lengths[-1]].tobytes()
        )
        frame += f
    return streams


def stream_info(stream: bytes) -> dict:
    """STREAMINFO, seek points (sample, byte, n) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, last, info, points = 4, False, None, []
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            found = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
            points = [(int(p["sample"]), int(p["offset"]), int(p["n"])) for p in found if p["sample"] != 0xFFFFFFFFFFFFFFFF]
        at += 4 + size
    if info is None or info["channels"] != 1 or info["bits"] > 16:
        raise FlacError("not a mono stream of up to 16 bits")
    return info | {"points": points, "frames_at": at}


class _Bits:
    """The bits of joined streams: 64 bits from each byte, of which 57 can be used from any bit of it."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        padded = data + bytes(16)
        self.word = np.ndarray((len(data) + 8,), ">u8", padded, strides=(1,)).astype(np.uint64)

    def window(self, at: np.ndarray) -> np.ndarray:
        """The bits from each place on, first bit uppermost."""
        return self.word.take(at >> 3, mode="clip") << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """k (up to 32) bits from each place, unsigned."""
        return (self.window(at) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)

    def zeros(self, at: int) -> int:
        """The number of zero bits before the next one bit."""
        n = 0
        while at + n < 8 * len(self.data):
            w = int(self.window(np.array([at + n]))[0]) >> 7
            if w:
                return n + 57 - w.bit_length()
            n += 57
        raise FlacError("the stream ends within a code")


def _signed(v: np.ndarray, bits) -> np.ndarray:
    half = np.int64(1) << np.maximum(bits - 1, 0)
    return np.where(v >= half, v - 2 * half, v) * (np.asarray(bits) > 0)


def _header(data, at: int, bits: int) -> tuple[int, int, int, int]:
    """-> block size, sample size, first byte after the header, frame or sample number."""
    b = bytes(data[at : at + 16])
    if len(b) < 6 or b[0] != 0xFF or b[1] & 0xFE != 0xF8:
        raise FlacError("no frame where one must begin")
    size_code, rate_code, p = b[2] >> 4, b[2] & 15, 5
    number, lead = b[4], b[4]
    if lead >= 0xC0:
        more = 1
        while lead & 0x40 >> more:
            more += 1
        number = lead & (0x3F >> more)
        for x in b[5 : 5 + more]:
            number = number << 6 | x & 0x3F
        p += more
    if size_code in (6, 7):
        n = int.from_bytes(b[p : p + size_code - 5], "big") + 1
        p += size_code - 5
    else:
        n = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if b[3] >> 4 or crc8(b[:p]) != b[p]:
        raise FlacError("damaged frame header")
    return n, {0: bits, 1: 8, 2: 12, 4: 16}[b[3] >> 1 & 7], at + p + 1, number


def _frames(bits: _Bits, starts: list[int], sample_bits: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Decodes one frame from each byte place side by side -> samples, byte place after each frame (CRC-16 checked)."""
    lanes = len(starts)
    n, kind, order, wasted, width, cursor = (np.zeros(lanes, np.int64) for _ in range(6))
    for i, (at, b) in enumerate(zip(starts, sample_bits)):
        n[i], width[i], p, _ = _header(bits.data, at, b)
        kind[i], cursor[i] = bits.data[p] >> 1, 8 * (p + 1)
        if bits.data[p] & 1:
            wasted[i] = bits.zeros(int(cursor[i])) + 1
            cursor[i] += wasted[i]
    width = width - wasted
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise FlacError("reserved subframe")
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    longest = int(n.max())
    x = np.zeros((longest + 1, lanes), np.int64)  # one row a step; the last row takes what lies beyond a frame
    for s in range(longest):  # verbatim samples, warm-up samples, the constant
        m = np.flatnonzero((s < n) & ((kind == 1) | (s < order) | (kind == 0) & (s == 0)))
        if not len(m):
            if not (kind == 1).any():
                break
            continue
        x[s, m] = _signed(bits.take(cursor[m], width[m]), width[m])
        cursor[m] += width[m]
    for i in np.flatnonzero(kind == 0):
        x[: n[i], i] = x[0, i]
    shift = np.zeros(lanes, np.int64)
    coefficients = np.zeros((32, lanes), np.int64)
    for i in np.flatnonzero(kind >= 8):
        if kind[i] < 32:
            coefficients[: order[i], i] = FIXED[int(order[i])]
            continue
        one = np.array([cursor[i]])
        precision = bits.take(one, np.array([4])) + 1
        shift[i] = _signed(bits.take(one + 4, np.array([5])), np.array([5]))[0]
        for j in range(int(order[i])):
            coefficients[j, i] = _signed(bits.take(one + 9 + j * precision, precision), precision)[0]
        cursor[i] += 9 + int(order[i]) * int(precision[0])
    coded = np.flatnonzero(kind >= 8)
    if len(coded):
        _rice(bits, coded, n, order, cursor, x)
        _restore(coded, n, order, kind, coefficients, shift, x)
    ends = -(-cursor // 8)
    begins = np.array(starts)
    if (ends + 2 > len(bits.data)).any():
        raise FlacError("the stream ends within a frame")
    want = bits.data[ends].astype(int) << 8 | bits.data[ends + 1]
    if (crc16(bits.data, begins, ends) != want).any():
        raise FlacError("frame checksum differs")
    return [x[: n[i], i] << wasted[i] for i in range(lanes)], ends + 2


def _rice(bits: _Bits, coded, n, order, cursor, x) -> None:
    """Residuals of the coded lanes into x, below the warm-up samples."""
    at = cursor[coded]
    head = bits.take(at, np.full(len(coded), 6))
    if (head >> 4 > 1).any():
        raise FlacError("reserved residual coding")
    pbits, parts = np.where(head >> 4 == 1, 5, 4), head & 15
    at = at + 6
    # Lanes by length, longest first: those that still have codes are the first ones.
    sort = np.argsort(-n[coded], kind="stable")
    lane, at, pbits, parts = coded[sort], at[sort], pbits[sort], parts[sort]
    size, begin = n[lane], order[lane]
    per, next_part = size >> parts, begin.copy()
    k, raw = np.zeros(len(lane), np.int64), np.full(len(lane), -1, np.int64)
    folded = np.zeros((int(size[0]), len(lane)), np.int64)  # step by lane; folded code values
    alive_at = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    low_shift = (63 - k).astype(np.uint64)
    one, eleven, usual = np.uint64(1), np.uint64(11), True
    for s in range(int(size[0])):
        alive = int(alive_at[s])
        new = np.flatnonzero((next_part[:alive] == s))
        if len(new):
            k[new] = bits.take(at[new], pbits[new])
            at[new] += pbits[new]
            e = new[k[new] == (1 << pbits[new]) - 1]
            raw[new] = -1
            if len(e):
                raw[e] = bits.take(at[e], np.full(len(e), 5))
                at[e] += 5
            next_part[new] = (s // per[new] + 1) * per[new]
            low_shift = (63 - k).astype(np.uint64)
            usual = not (raw >= 0).any()
        todo = slice(0, alive) if s >= 32 or (begin[:alive] <= s).all() else np.flatnonzero(begin[:alive] <= s)
        p, kk = at[todo], k[todo]
        w = bits.window(p)
        q = 53 - np.frexp((w >> eleven).astype(np.float64))[1].astype(np.int64)
        z = q << kk | (w << q.astype(np.uint64) << one >> one >> low_shift[todo]).astype(np.int64)
        after = p + q + 1 + kk
        odd = (q > 52) | (q + kk > 56)
        if not usual:
            odd |= raw[todo] >= 0
        if odd.any():  # long codes and escaped partitions, one after the other
            for i in np.flatnonzero(odd).tolist():
                r = int(raw[todo][i])
                if r >= 0:
                    v = int(_signed(bits.take(p[i : i + 1], np.array([r])), np.array([r]))[0]) if r else 0
                    z[i], after[i] = v << 1 if v >= 0 else -2 * v - 1, p[i] + r
                else:
                    q_ = bits.zeros(int(p[i]))
                    z[i] = q_ << int(kk[i]) | int(bits.take(p[i : i + 1] + q_ + 1, kk[i : i + 1])[0])
                    after[i] = p[i] + q_ + 1 + kk[i]
        folded[s, todo] = z
        at[todo] = after
    cursor[lane] = at
    value = folded >> 1 ^ -(folded & 1)
    rows = np.arange(len(folded))[:, None] >= begin[None, :]
    x[: len(folded), lane] = np.where(rows, value, x[: len(folded), lane])


def _restore(coded, n, order, kind, coefficients, shift, x) -> None:
    """Adds the predictions, lanes of one order together: fixed predictors by sums, LPC step by step."""
    for o in np.unique(order[coded]).tolist():
        fixed = coded[(order[coded] == o) & (kind[coded] < 32)]
        if len(fixed) and o:
            warm = x[:o, fixed].copy()
            starts = [warm]
            for _ in range(o - 1):
                starts.append(np.diff(starts[-1], axis=0))
            part = x[o:-1, fixed]
            for d in reversed(range(o)):  # sums of the differences of order d + 1 give those of order d
                part = np.cumsum(part, axis=0) + starts[d][-1]
            x[o:-1, fixed] = part
        lpc = coded[(order[coded] == o) & (kind[coded] >= 32)]
        if len(lpc):
            c, sh = coefficients[:o, lpc], shift[lpc]
            for s in range(o, int(n[lpc].max())):
                x[s, lpc] += (c * x[s - 1 :: -1, lpc][:o]).sum(axis=0) >> sh


def seekable(info: dict) -> bool:
    """Whether the seek table names every frame."""
    points = info["points"]
    return bool(points) and points[0][:2] == (0, 0) and sum(p[2] for p in points) == info["samples"]


def seek(streams: list[bytes], first: int, count: int) -> list[np.ndarray]:
    """`count` samples from offset `first` (below zero: from the end) of each stream, by its seek table: only frames that hold them are decoded.

    A stream whose table doesn't name every frame is decoded whole. What lies outside a stream is left out.
    """
    out, lanes, data, at = [np.zeros(0, np.int64)] * len(streams), [], [], 0
    for i, s in enumerate(streams):
        info = stream_info(s)
        a = max(0, info["samples"] + first) if first < 0 else first
        if not seekable(info):
            x = decode([s])[0][0]
            a = max(0, len(x) + first) if first < 0 else first
            out[i] = x[a : a + count]
            continue
        points = info["points"]
        begin, end = bisect_right(points, a, key=lambda p: p[0]) - 1, bisect_left(points, a + count, key=lambda p: p[0])
        for k in range(begin, end):
            piece = s[info["frames_at"] + points[k][1] : info["frames_at"] + points[k + 1][1] if k + 1 < len(points) else len(s)]
            lanes.append((i, at, points[k][0], a, info["bits"]))
            data.append(piece)
            at += len(piece)
    if lanes:
        found, _ = _frames(_Bits(b"".join(data)), [x[1] for x in lanes], [x[4] for x in lanes])
        for (i, _, offset, a, _), x in zip(lanes, found):
            out[i] = np.concatenate([out[i], x[max(0, a - offset) : max(0, a + count - offset)]])
    return [x.astype("<i2" if stream_info(s)["bits"] > 8 else np.int8) for s, x in zip(streams, out)]


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """FLAC streams -> (samples, [(first sample, number of samples) of each block]); raises FlacError if a check fails."""
    out, group, held = [], [], 0
    for s in streams:
        if held + len(s) > PIECE and group:
            out += _decode(group)
            group, held = [], 0
        group.append(s)
        held += len(s)
    return out + (_decode(group) if group else [])


def _decode(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    infos = [stream_info(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)]).tolist()
    bits = _Bits(b"".join(streams))
    blocks: list[list[np.ndarray]] = [[] for _ in streams]
    seeking = [i for i, x in enumerate(infos) if seekable(x)]
    starts = [(i, base[i] + infos[i]["frames_at"] + p[1]) for i in seeking for p in infos[i]["points"]]
    if starts:
        found, ends = _frames(bits, [at for _, at in starts], [infos[i]["bits"] for i, _ in starts])
        for (i, _), x in zip(starts, found):
            blocks[i].append(x)
        for (i, _), nxt, end in zip(starts, [*starts[1:], (-1, -1)], ends.tolist()):
            if end != (nxt[1] if nxt[0] == i else base[i + 1]):
                raise FlacError("a seek point doesn't meet the end of the frame before it")
    rest = {i: base[i] + infos[i]["frames_at"] for i in range(len(streams)) if i not in set(seeking)}
    while rest := {i: at for i, at in rest.items() if at < base[i + 1]}:  # no seek table: each stream is one lane
        found, ends = _frames(bits, list(rest.values()), [infos[i]["bits"] for i in rest])
        for i, x, end in zip(list(rest), found, ends.tolist()):
            blocks[i].append(x)
            rest[i] = end
    out = []
    for info, mine in zip(infos, blocks):
        x = np.concatenate(mine) if mine else np.zeros(0, np.int64)
        if info["samples"] and len(x) != info["samples"]:
            raise FlacError("number of samples differs")
        pcm = x.astype("<i2" if info["bits"] > 8 else np.int8)
        if any(info["md5"]) and hashlib.md5(pcm.tobytes()).digest() != info["md5"]:
            raise FlacError("MD5 differs")
        sizes = [len(b) for b in mine]
        out.append((pcm, list(zip((np.cumsum(sizes) - sizes).tolist() if sizes else [], sizes))))
    return out
