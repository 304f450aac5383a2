"""Media columns: FLAC streams of one 8-bit channel, written and read back.

The writer cuts samples into frames of 1024 and takes for each the cheapest of
a constant, fixed linear predictors (order 0 to 2), a quantised linear
predictor of order 2, or verbatim samples; residuals are Rice codes in one
partition. The reader finds frames by sync code and header CRC-8, takes their place
from the number read, checks the frame's CRC-16, decodes residuals of all frames of
a batch in step, undoes the predictors, and gives PCM blocks with their sample
offsets.

Defined cases: a null or empty payload is a stream without frames; a frame that
fails a check gives a block with ok false and null samples, and so does each gap
between the frames found, or up to the stream's samples; the frames around it are
read. Columns blocks, feature, whole and that of the media are replaced, others pass
through. Frames of other layouts than the above (more channels, other block or sample
sizes, more partitions, other predictors) are found but not decoded: blocks with ok
false.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import add_columns

FRAME = 1024
LONGEST = FRAME + 32  # bytes of the longest frame
SHIFT = 6
BATCH = 1 << 20  # samples that are decoded in step
ENCODED = 1 << 17  # samples that are encoded at a time


def _crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, t << 1 ^ poly, t << 1) & ((1 << bits) - 1)
    return t


_CRC8 = _crc_table(0x07, 8).tolist()
_CRC16: list[np.ndarray] = []


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of slices of a byte array. A CRC without initial value is the XOR of what each byte adds at its distance from the end."""
    if not _CRC16:
        one = _crc_table(0x8005, 16)
        rows = [one]
        for _ in range(LONGEST):
            rows.append((rows[-1] << 8 & 0xFFFF) ^ one[rows[-1] >> 8])
        _CRC16.append(np.array(rows, np.uint16).ravel())
    at = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    got = _CRC16[0][(np.repeat(sizes, sizes) - 1 - place) * 256 + data[np.repeat(starts, sizes) + place]]
    return np.bitwise_xor.reduceat(got, at)


def _number(n: int) -> bytes:
    """The frame number in the UTF-8 like code of frame headers."""
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    return bytes([(0xFF00 >> k & 0xFF) | n >> 6 * (k - 1)]) + bytes(0x80 | n >> 6 * i & 0x3F for i in range(k - 2, -1, -1))


def _header(n: int, size: int) -> bytes:
    h = b"\xff\xf8\x70\x02" + _number(n) + (size - 1).to_bytes(2, "big")
    return h + bytes([crc8(h)])


def _stream_info(payload: bytes) -> bytes:
    # Block sizes of 16 bits, two unknown frame sizes of 24, rate of 20, channels - 1 of 3, bits - 1 of 5, samples of 36.
    fields = (FRAME << 128) | (FRAME << 112) | (8000 << 44 | 7 << 36 | len(payload))
    signed = bytes(np.frombuffer(payload, np.uint8) ^ 0x80)
    return b"fLaC\x80\x00\x00\x22" + fields.to_bytes(18, "big") + hashlib.md5(signed).digest()


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = value >> (width - 1 - b) & 1


def _encode_frames(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: list[int]) -> list[bytes]:
    """x: samples (-128 to 127) of all frames, one after another."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(x)) - np.repeat(starts, sizes)
    back1, back2 = np.roll(x, 1), np.roll(x, 2)
    back1[place < 1] = 0
    back2[place < 2] = 0
    add = lambda v: np.add.reduceat(v, starts, dtype=np.int64)
    # The order-2 predictor from the frame's autocorrelation.
    r0, r1, r2 = (add(x * v).astype(float) for v in (x, back1, back2))
    det = np.maximum(r0 * r0 - r1 * r1, 1)
    q1, q2 = (np.clip(np.rint(c * (1 << SHIFT)), -128, 127).astype(np.int32) for c in ((r0 * r1 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det))
    ways = [(0, x), (1, x - back1), (2, x - 2 * back1 + back2), (2, x - (q1[owner] * back1 + q2[owner] * back2 >> SHIFT))]
    best = [(sizes * 8).astype(float)] + []
    codes = []
    for w, (order, residual) in enumerate(ways):
        u = np.where(residual < 0, -2 * residual - 1, 2 * residual)
        u[place < order] = 0
        total, n = add(u), sizes - order
        k = np.argmin([n * (j + 1) + total / (1 << j) for j in range(10)], axis=0)
        exact = n * (k + 1) + add(u >> k[owner]) + order * 8 + 10 + (25 * (w == 3))
        best.append(exact.astype(float))
        codes.append((u, k))
    constant = np.maximum.reduceat(x, starts) == np.minimum.reduceat(x, starts)
    choice = np.argmin(best, axis=0)  # 0 verbatim, 1 to 3 fixed, 4 linear
    choice[constant] = -1
    bits_of = np.where(choice < 0, 16, 8 + np.array(best)[np.maximum(choice, 0), np.arange(len(sizes))].astype(np.int64))
    heads = [_header(n, int(s)) for n, s in zip(numbers, sizes)]
    head = np.array([len(h) for h in heads])
    whole = head + -(-bits_of // 8)
    first = np.cumsum(whole) - whole
    bits = np.zeros(int(whole.sum()) * 8, np.uint8)
    body = (first + head) * 8
    kind = np.select([choice < 0, choice == 0, choice < 4], [0, 1, 8 + choice - 1], 32 + 1)
    _put(bits, body, kind << 1, 8)
    order = np.select([choice <= 0, choice == 4], [0, 2], choice - 1)
    raw = x & 0xFF
    straight = np.where(choice[owner] < 0, place < 1, (choice[owner] == 0) | (place < order[owner]))
    _put(bits, body[owner[straight]] + 8 + 8 * place[straight], raw[straight], 8)
    linear = np.flatnonzero(choice == 4)
    at = body[linear] + 24
    _put(bits, at, np.full(len(linear), 7), 4)  # precision 8
    _put(bits, at + 4, np.full(len(linear), SHIFT), 5)
    _put(bits, at + 9, q1[linear] & 0xFF, 8)
    _put(bits, at + 17, q2[linear] & 0xFF, 8)
    rest = body + 8 + 8 * order + 25 * (choice == 4)
    for w in range(4):
        frames = choice == w + 1
        if not frames.any():
            continue
        u, k = codes[w]
        _put(bits, rest[frames] + 6, k[frames], 4)
        mine = frames[owner] & (place >= order[owner])
        u, k, who = u[mine], k[owner[mine]], owner[mine]
        size = (u >> k) + 1 + k
        end = np.cumsum(size)
        new = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        base = np.repeat((end - size)[new], np.diff(np.append(new, len(who))))
        at = rest[who] + 10 + end - size - base + (u >> k)
        bits[at] = 1
        for j in range(int(k.max(initial=0))):
            some = k > j
            bits[at[some] + k[some] - j] = u[some] >> j & 1
    data = np.packbits(bits)
    for h, a in zip(heads, first):
        data[a : a + len(h)] = np.frombuffer(h, np.uint8)
    check = crc16(data, first, whole)
    return [data[a : a + n].tobytes() + int(c).to_bytes(2, "big") for a, n, c in zip(first, whole, check)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of bytes, each byte one sample."""
    out = [[_stream_info(p)] for p in payloads]
    cuts = [(i, n, p[a : a + FRAME]) for i, p in enumerate(payloads) for n, a in enumerate(range(0, len(p), FRAME))]
    start = 0
    while start < len(cuts):
        stop, size = start, 0
        while stop < len(cuts) and size < ENCODED:
            size += len(cuts[stop][2])
            stop += 1
        part = cuts[start:stop]
        x = np.frombuffer(b"".join(c[2] for c in part), np.uint8).astype(np.int32) - 128
        sizes = np.array([len(c[2]) for c in part])
        for (i, _, _), frame in zip(part, _encode_frames(x, np.cumsum(sizes) - sizes, sizes, [c[1] for c in part])):
            out[i].append(frame)
        start = stop
    return [b"".join(p) for p in out]


def _coded(data: bytes) -> tuple[int, int] | None:
    """The number at the start of the data in the UTF-8 like code, and its bytes."""
    if not data or data[0] in (0xFF, *range(0x80, 0xC0)):
        return None
    if data[0] < 0x80:
        return data[0], 1
    k = next(k for k in range(2, 8) if not data[0] << k & 0x80)
    if len(data) < k or any(b >> 6 != 2 for b in data[1:k]):
        return None
    n = data[0] & 0x7F >> k
    for b in data[1:k]:
        n = n << 6 | b & 0x3F
    return n, k


def _headers(stream: bytes, at: int, sync: bytes) -> list[tuple[int, int, int, int]]:
    """(number, start, header length, samples) of each header that has its checksum."""
    found, at = [], stream.find(sync, at)
    while at >= 0:
        code = _coded(stream[at + 4 : at + 11])
        size, rate = (stream[at + 2] >> 4, stream[at + 2] & 15) if code else (0, 15)
        if size and rate < 15 and stream[at + 3] >> 4 < 11 and not stream[at + 3] & 1:
            wide, fast = {6: 1, 7: 2}.get(size, 0), {12: 1, 13: 2, 14: 2}.get(rate, 0)
            end = at + 4 + code[1] + wide + fast
            body = stream[at:end]
            if stream[end : end + 1] == bytes([crc8(body)]):
                tail = int.from_bytes(body[4 + code[1] : 4 + code[1] + wide], "big") + 1
                found.append((code[0], at, end + 1 - at, tail if wide else 192 if size == 1 else 144 << size if size < 6 else 1 << size))
        at = stream.find(sync, at + 1)
    return found


def _rising(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The longest part whose numbers rise: a look-alike of a header inside a frame seldom fits in."""
    if all(f[0] == n for n, f in enumerate(found)):
        return found
    least, ends, back = [], [], []
    for i, f in enumerate(found):
        k = bisect_left(least, f[0])
        least[k:], ends[k:] = [f[0], *least[k + 1 :]], [i, *ends[k + 1 :]]
        back.append(ends[k - 1] if k else -1)
    out, i = [], ends[-1]
    while i >= 0:
        out.append(found[i])
        i = back[i]
    return out[::-1]


def _own_end(frame: bytes, head: int, n: int) -> int:
    """Where a frame of the writer's layout ends, by its codes; the end of the bytes if it goes on beyond them."""
    kind = frame[head] >> 1 if len(frame) > head else -1
    if kind in (0, 1):
        return min(len(frame), head + (2 if kind == 0 else 1 + n) + 2)
    if kind not in (8, 9, 10, 33):
        return len(frame)
    order = 2 if kind == 33 else kind - 8
    bits = "".join(f"{b:08b}" for b in frame[head + 1 + order : LONGEST + 16])
    at = 25 * (kind == 33) + 10
    k = int(bits[at - 4 : at] or "0", 2)
    for _ in range(n - order):
        one = bits.find("1", at)
        if one < 0:
            return len(frame)
        at = one + 1 + k
    return min(len(frame), head + 1 + order + -(-at // 8) + 2)


def find_frames(stream: bytes) -> list[tuple[int, int, int, int, int]]:
    """(sample offset, samples, start, end, header length) of each frame, by sync code and header checksum.

    What lies between the frames' numbers, or is missing at the stream's end, is one
    entry a gap, with start, end and length 0; so is a frame of another layout.
    """
    if len(stream) < 42 or stream[:4] != b"fLaC":
        return []
    at, last = 4, 0
    while not last and at + 4 <= len(stream):
        last = stream[at] & 0x80
        at += 4 + int.from_bytes(stream[at + 1 : at + 4], "big")
    total = int.from_bytes(stream[21:26], "big") & (1 << 36) - 1
    least, most = (int.from_bytes(stream[a : a + 2], "big") for a in (8, 10))
    step = most if least == most and most >= 16 else FRAME
    seen, own = _headers(stream, at, b"\xff\xf8\x70\x02"), []
    for f in seen:
        if f[0] == len(own):
            own.append(f)
    if sum(f[3] for f in own) != total:  # damaged, or another layout
        own = _rising([f for f in seen if f[0] * FRAME < total] or seen)
    found = own or _rising(_headers(stream, at, b"\xff\xf8"))
    if len(found) > 1:
        step = found[0][3]
    places = [f[0] * step for f in found]
    if not found:
        found = _rising(_headers(stream, at, b"\xff\xf9"))  # blocks of varying size: the number is the first sample's
        places = [f[0] for f in found]
    out, reached = [], 0
    for n, ((_, a, head, size), place) in enumerate(zip(found, places)):
        if place > reached:
            out.append((reached, place - reached, 0, 0, 0))
        reached = place + size
        end = found[n + 1][1] if n + 1 < len(found) else len(stream)
        if own and size <= FRAME:
            missing = places[n + 1] > reached if n + 1 < len(found) else total > reached
            out.append((place, size, a, a + _own_end(stream[a:end], head, size) if missing else end, head))
        else:
            out.append((place, size, 0, 0, 0))
    if total > reached:
        out.append((reached, total - reached, 0, 0, 0))
    return out


def _plain(frame: bytes, head: int) -> bool:
    """Whether a predicted frame has coefficients of 8 bits, no negative shift, and one partition of plain Rice codes."""
    linear = frame[head] >> 1 == 33
    a = head + 1 + (2 if linear else (frame[head] >> 1) - 8)
    bits = int.from_bytes(frame[a : a + 5].ljust(5, b"\0"), "big")  # precision 4, shift 5, coefficients 16; method 2, partitions 4, parameter 4
    if linear and (bits >> 36 != 7 or bits >> 35 & 1):
        return False
    rest = bits >> (5 if linear else 30) & 0x3FF
    return rest >> 4 == 0 and rest < 15


def _decode_frames(frames: list[tuple[bytes, int, int]]) -> list[bytes | None]:
    """frames: (bytes, header length, samples). The samples of each as bytes, None where a check fails."""
    out: list[bytes | None] = [None] * len(frames)
    sizes = np.array([len(f[0]) for f in frames])
    fit = (sizes > 8) & (sizes <= LONGEST)
    data = np.frombuffer(b"".join(f[0] for f in frames) + b"\x80" * 8, np.uint8)
    starts = np.cumsum(sizes) - sizes
    good = np.zeros(len(frames), bool)
    if fit.any():
        check = crc16(data, starts[fit], sizes[fit] - 2)
        stored = data[(starts + sizes - 2)[fit]].astype(np.int64) << 8 | data[(starts + sizes - 1)[fit]]
        good[fit] = check == stored
    body = starts + np.array([f[1] for f in frames])
    n = np.array([f[2] for f in frames])
    kind = data[np.minimum(body, len(data) - 1)] >> 1
    good &= data[np.minimum(body, len(data) - 1)] & 1 == 0  # no wasted bits
    signed = lambda a: (data[a] ^ 0x80).astype(np.int64) - 128  # noqa: E731  two's complement
    for i in np.flatnonzero(good & (kind <= 1)):
        a = int(body[i]) + 1
        raw = data[a : a + 1].repeat(n[i]) if kind[i] == 0 else data[a : a + n[i]]
        out[i] = (raw ^ 0x80).tobytes()
    todo = np.flatnonzero(good & ((kind >= 8) & (kind <= 10) | (kind == 33)))
    todo = todo[[_plain(frames[i][0], frames[i][1]) for i in todo]] if len(todo) else todo
    if not len(todo):
        return out
    order = np.where(kind[todo] == 33, 2, kind[todo].astype(np.int64) - 8)
    todo, order = (v[by] for by in (np.argsort(-(n[todo] - order), kind="stable"),) for v in (todo, order))
    linear = kind[todo] == 33
    bits = np.unpackbits(data)
    ones = np.flatnonzero(bits).astype(np.int32)
    following = ones[np.minimum(np.cumsum(bits, dtype=np.int32) - bits, len(ones) - 1)]
    wide = data[:-2].astype(np.int32) << 16 | data[1:-1].astype(np.int32) << 8 | data[2:]

    def take(at: np.ndarray, width) -> np.ndarray:
        return wide[at >> 3] >> 24 - width - (at & 7) & (1 << width) - 1

    at = (body[todo] + 1 + order) * 8
    c1, c2 = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
    shift = np.zeros(len(todo), np.int64)
    shift[linear] = take(at[linear] + 4, 5)
    for c, a in ((c1, 9), (c2, 17)):
        c[linear] = (take(at[linear] + a, 8) ^ 0x80) - 128
    at = at + 25 * linear
    k = take(at + 6, 4).astype(np.int64)
    at = at + 10
    count = n[todo] - order
    longest = int(count.max())
    codes = np.zeros((longest, len(todo)), np.int32)
    active = np.searchsorted(-count, -np.arange(1, longest + 1), side="right")
    ones_at, mask = at.astype(np.int64), (1 << k) - 1
    limit = len(following) - 1
    for row, m in zip(codes, active):
        p = ones_at[:m]
        stop = following[np.minimum(p, limit)].astype(np.int64)
        quotient = stop - p
        stop += 1
        row[:m] = quotient << k[:m] | (wide[stop >> 3] >> 24 - k[:m] - (stop & 7) & mask[:m])
        ones_at[:m] = stop + k[:m]
    residual = (codes >> 1) ^ -(codes & 1)
    samples = np.zeros((longest + 2, len(todo)), np.int64)
    for o in range(3):
        some = np.flatnonzero((order == o) & ~linear)
        if len(some):
            got = residual[:, some].astype(np.int64)
            warm = [signed(body[todo[some]] + 1 + j) for j in range(o)]
            if o == 1:
                got = np.cumsum(np.vstack([warm[0][None], got]), axis=0)
            elif o == 2:
                slope = np.cumsum(np.vstack([(warm[1] - warm[0])[None], got]), axis=0)
                got = np.cumsum(np.vstack([warm[0][None], slope]), axis=0)
            samples[: len(got), some] = got
    some = np.flatnonzero(linear)
    if len(some):
        a, b = signed(body[todo[some]] + 1), signed(body[todo[some]] + 2)
        s, u, v = shift[some], c1[some], c2[some]
        own = np.empty((longest + 2, len(some)), np.int64)
        own[0], own[1] = a, b
        for j, r in enumerate(residual[:, some]):
            a, b = b, r + (u * b + v * a >> s)
            own[j + 2] = b
        samples[:, some] = own
    plain = (samples + 128).astype(np.uint8).T
    for row, i in zip(plain, todo):
        out[i] = row[: n[i]].tobytes()
    return out


def decode(streams: list[bytes | None]) -> list[list[tuple[int, int, bytes | None]]]:
    """(sample offset, samples, bytes) of each frame of each stream."""
    out: list[list] = [[] for _ in streams]
    cuts = []
    for i, s in enumerate(streams):
        for place, size, a, e, head in find_frames(s or b""):
            if e:
                cuts.append((i, place, s[a:e], head, size))
            else:
                out[i].append((place, size, None))
    start = 0
    while start < len(cuts):
        stop, size = start, 0
        while stop < len(cuts) and size < BATCH:
            size += cuts[stop][4]
            stop += 1
        part = cuts[start:stop]
        for (i, place, _, _, size), pcm in zip(part, _decode_frames([c[2:] for c in part])):
            out[i].append((place, size, pcm))
        start = stop
    for blocks in out:
        blocks.sort(key=lambda b: b[0])
    return out


def intact(stream: bytes | None, blocks: list[tuple[int, int, bytes | None]]) -> bool:
    """Whether the blocks are all there and have the stream's sample count and MD5."""
    if not stream or len(stream) < 42 or stream[:4] != b"fLaC" or any(pcm is None for _, _, pcm in blocks):
        return False
    pcm = b"".join(b[2] for b in blocks)
    total = int.from_bytes(stream[21:26], "big") & (1 << 36) - 1
    return len(pcm) == total and hashlib.md5(bytes(np.frombuffer(pcm, np.uint8) ^ 0x80)).digest() == stream[26:42]


def encode_media(docs: DataFrame, *, payload_col: str = "payload", media_col: str = "media") -> DataFrame:
    """Add the FLAC stream of a binary column."""
    adds = T.StructType([T.StructField(media_col, T.BinaryType())])
    return add_columns(docs, [payload_col], adds, lambda got: [encode([p or b"" for p in got[0]])])


_BLOCK = T.StructType([T.StructField("sample_offset", T.LongType()), T.StructField("n_samples", T.LongType()), T.StructField("ok", T.BooleanType()), T.StructField("pcm", T.BinaryType())])


def decode_media(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Add blocks (sample_offset, n_samples, ok, pcm), each readable alone, the stream's features, and whole.

    whole says that all blocks are ok and make up the samples whose number and MD5 the
    stream's head has. Features: peak, sum of absolute samples and sign changes, as "peak:sum:changes".
    """

    def function(got):
        blocks, features, whole = [], [], []
        for stream, found in zip(got[0], decode(got[0])):
            whole.append(intact(stream, found))
            blocks.append([{"sample_offset": a, "n_samples": n, "ok": pcm is not None, "pcm": pcm} for a, n, pcm in found])
            x = np.frombuffer(b"".join(pcm or b"" for _, _, pcm in found), np.uint8).astype(np.int16) - 128
            features.append(f"{int(np.abs(x).max(initial=0))}:{int(np.abs(x).sum(dtype=np.int64))}:{int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}")
        return [blocks, features, whole]

    adds = T.StructType([T.StructField("blocks", T.ArrayType(_BLOCK)), T.StructField("feature", T.StringType()), T.StructField("whole", T.BooleanType())])
    return add_columns(media, [media_col], adds, function)
