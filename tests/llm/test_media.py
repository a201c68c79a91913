import hashlib
import zlib

import numpy as np
import pytest

from quire.llm import flac, media


class Writer:
    """A plain bit writer: frames as the format describes them, one code after the other."""

    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> i & 1 for i in reversed(range(n))]

    def bytes(self):
        b = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(x << (7 - i) for i, x in enumerate(b[k : k + 8])) for k in range(0, len(b), 8))


def lpc_stream(x, order=2, partition_order=1, method=0, escape=False, bits=16):
    """One LPC frame without a seek table; coefficients 2, -1 (or 1) with precision 5 and shift 0 ."""
    c = [2, -1][:order]
    w = Writer()
    head = b"\xff\xf8\x74\x08" + b"\x00" + (len(x) - 1).to_bytes(2, "big")
    for b in head + bytes([flac.crc8(head)]):
        w.put(b, 8)
    w.put((31 + order) << 1, 8)
    for v in x[:order]:
        w.put(v & 0xFFFF, 16)
    w.put(4, 4), w.put(0, 5)
    for v in c:
        w.put(v & 31, 5)
    w.put(method, 2), w.put(partition_order, 4)
    res = [x[i] - sum(c[j] * x[i - 1 - j] for j in range(order)) for i in range(order, len(x))]
    per = len(x) >> partition_order
    at = 0
    for p in range(1 << partition_order):
        part = res[at : at + per - (order if p == 0 else 0)]
        at += len(part)
        if escape and p == 1:
            w.put(31 if method else 15, 5 if method else 4), w.put(20, 5)
            for v in part:
                w.put(v & (1 << 20) - 1, 20)
            continue
        k = 3
        w.put(k, 5 if method else 4)
        for v in part:
            z = v << 1 if v >= 0 else -2 * v - 1
            w.bits += [0] * (z >> k) + [1]
            w.put(z & 7, k)
    frame = w.bytes()
    frame += flac._crc16_slow(np.frombuffer(frame, np.uint8)).to_bytes(2, "big")
    pcm = np.array(x, "<i2")
    info = (len(x)).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | (bits - 1) << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(pcm.tobytes()).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame, pcm


@pytest.mark.parametrize("method,escape", [(0, False), (1, False), (0, True), (1, True)])
def test_reads_lpc_partitions_and_escapes(method, escape):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.integers(-40, 41, 256)).tolist()
    stream, pcm = lpc_stream(x, 2, 2, method, escape)
    (got, blocks), (again, _) = flac.decode([stream, stream])
    assert got.tobytes() == pcm.tobytes() == again.tobytes() and blocks == [(0, 256)]


def test_round_trip_of_many_shapes():
    rng = np.random.default_rng(5)
    cases = [bytes(64), b"a" * 5000 + bytes(56), bytes(range(256)) * 9, rng.integers(0, 256, 64 * 77, dtype=np.uint8).tobytes()]
    cases += [rng.integers(90, 110, 64 * int(n), dtype=np.uint8).tobytes() for n in rng.integers(1, 60, 30)]
    cases.append((b"The quick brown fox. " * 100000)[: 64 * 30000])
    streams = flac.encode(cases)
    for p, (x, blocks) in zip(cases, flac.decode(streams)):
        assert x.tobytes() == p and sum(n for _, n in blocks) == len(p)
    assert flac.encode([cases[2]]) == [streams[2]]


def test_damage_is_found():
    good = flac.encode([b"some words that are stored here " * 64])[0]
    for at in (len(good) // 2, len(good) - 1, len(good) - 500):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises((flac.FlacError, IndexError, ValueError)):
            flac.decode([bytes(bad)])


def test_rows(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 100), (5, "x" * 64), (6, "w " * 400000), (1, "abc"), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    read = media.read_flac(media.write_flac(df))
    got = read.collect()
    assert len(got) == len(rows)
    for r, (key, text) in zip(got, rows):
        raw = (text or "").encode()
        assert (r.doc_id, r.n_bytes, r.error) == (key, len(raw), None)
        assert bytes(r.pcm) == raw + bytes(-len(raw) % 64 if raw else 64)
    blocks = media.pcm_blocks(read.filter("doc_id = 6")).orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks).rstrip(b"\0") == b"w " * 400000
    broken = spark.createDataFrame([(1, b"fLaC"), (2, None), (3, bytes(got[0].media))], "doc_id long, media binary")
    assert [(r.doc_id, r.error is None) for r in media.read_flac(broken).collect()] == [(1, False), (2, False), (3, True)]


def test_query(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = media.op3_flac_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id]
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_seeking_decodes_what_a_slice_holds(spark):
    rng = np.random.default_rng(8)
    raw = [rng.integers(90, 110, 64 * n, dtype=np.uint8).tobytes() for n in (1, 3, 400, 900)]
    streams = flac.encode(raw)
    plain, pcm = lpc_stream(np.cumsum(rng.integers(-40, 41, 256)).tolist(), 2, 2)
    for first, count in ((0, 10), (-64, 64), (5000, 9000), (40, 1), (4095, 2), (-1, 5), (10**7, 3)):
        got = flac.seek([*streams, plain], first, count)
        for x, want in zip(got, [*(np.frombuffer(p, np.int8) for p in raw), pcm]):
            a = max(0, len(want) + first) if first < 0 else first
            assert x.tobytes() == want[a : a + count].tobytes(), (first, count)
    broken = bytearray(streams[2])
    broken[-3] ^= 1
    df = spark.createDataFrame([(0, streams[3]), (1, bytes(broken)), (2, None), (3, b"no")], "doc_id long, media binary").coalesce(1)
    assert [None if r.range is None else bytes(r.range) for r in media.pcm_range(df, -8, 8).collect()] == [raw[3][-8:], None, None, None]
