"""Progressive JPEG: exact round trips, general scans, and the transform against its definition."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import jpeg, media


def padded(b: bytes) -> bytes:
    return b + b" " * (-len(b) % 192 if b else 192)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5))
def test_round_trip(raw):
    payloads = [padded(b) for b in raw]
    files = jpeg.encode(payloads)
    heads, c = jpeg.coefficients(files)
    assert jpeg.payloads(heads, c) == payloads
    assert files == [jpeg.encode([p])[0] for p in payloads]  # a file doesn't depend on its neighbours


@pytest.mark.parametrize("raw", [b"", b"\xff" * 1000, b"\x00" * 1000, bytes(range(256)) * 40, b"x" * 500_000])
def test_extremes(raw, monkeypatch):
    monkeypatch.setattr(jpeg, "LANES", 100)
    p = padded(raw)
    heads, c = jpeg.coefficients(jpeg.encode([p, b"a" * 192]))
    assert jpeg.payloads(heads, c) == [p, b"a" * 192]


def test_zero_runs():
    """A band with long runs of zeros, as files of others have."""
    block = np.zeros((3, 63), np.int64)
    block[0, [20, 62]], block[1, 40], block[2, 0] = [5, -3], -1, 7
    stream, ends = jpeg.pack(*jpeg._symbols_ac(block), np.zeros(3, np.int64))
    raw = np.concatenate([stream, np.zeros(8, np.uint8)])
    full = np.flatnonzero((raw[:-1] == 255) & (raw[1:] == 0))
    assert not len(full)
    c = np.zeros((3, 64), np.int32)
    starts = np.concatenate([[0], ends[:-1]]) * 8
    jpeg._ac_first(c, raw, starts, np.arange(3), np.ones(3, np.int64), np.arange(3), jpeg.decoder_table(*jpeg.own_tables()[1, 0]), 1, 63, 0)
    assert (c[:, 1:] == block).all()


def test_refinement_with_new_coefficients():
    """Known coefficients get their next bit, and a new one comes after a run of zeros."""
    code, length = jpeg.encoder_table((1, 0))
    known = [0, 4, 0, -6, 0]
    bits = ""
    # run of 1 zero, then a new negative coefficient: passes coefficient 1 (known, bit 1), lands on the third
    bits += format(int(code[0x11]), f"0{int(length[0x11])}b") + "0" + "1"
    # end of block: the bit of the other known one
    bits += format(int(code[0]), f"0{int(length[0])}b") + "1"
    bits += "1" * (-len(bits) % 8)
    raw = np.concatenate([np.frombuffer(int(bits, 2).to_bytes(len(bits) // 8, "big"), np.uint8), np.zeros(16, np.uint8)])
    c = np.zeros((1, 64), np.int32)
    c[0, 1:6] = known
    jpeg._ac_refine(c, raw, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64), jpeg.decoder_table(*jpeg.own_tables()[1, 0]), 1, 5, 0)
    assert c[0, 1:6].tolist() == [0, 5, -1, -7, 0]


def test_inverse_transform():
    rng = np.random.default_rng(0)
    natural = rng.integers(-200, 200, 64).reshape(8, 8)
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5)
    want = np.clip(np.round(basis.T @ natural @ basis) + 128, 0, 255)
    got = jpeg.samples(natural.ravel()[jpeg.zigzag()][None], np.ones(64, np.int64))[0]
    assert np.abs(got.astype(int) - want).max() <= 1
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_grey_and_colour():
    heads, c = jpeg.coefficients(jpeg.encode([b" " * 192]))
    c[:] = 0
    assert (jpeg.tensors(heads, c)[0] == 128).all() and jpeg.tensors(heads, c)[0].shape == (16, 16, 3)
    c[heads[0].parts[2].base, 0] = 8 * 50  # red chroma
    assert jpeg.tensors(heads, c)[0][0, 0].tolist() == [198, 92, 128]


def luma(heads, c):
    """The luma planes, as grey images."""
    c = c.copy()
    for f in heads:
        for p in f.parts[1:]:
            c[p.base : p.base + p.rows * p.columns] = 0
    return [t[:, :, 0].astype(int) for t in jpeg.tensors(heads, c)]


def java_luma(spark, data):
    """The luma plane as Java's own reader has it."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stream = jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
    reader.setInput(stream)
    raster = reader.readRaster(0, None)
    w, h = raster.getWidth(), raster.getHeight()
    got = raster.getSamples(0, 0, w, h, 0, gateway.new_array(jvm.int, w * h))
    return np.array(list(got)).reshape(h, w)


def test_another_reader_sees_the_same(spark):
    rng = np.random.default_rng(5)
    for raw in (b"hello", bytes(rng.integers(0, 256, 700, dtype=np.uint8)), ("Ein Satz, noch ein Satz. " * 60).encode()):
        data = jpeg.encode([padded(raw)])[0]
        own = luma(*jpeg.coefficients([data]))[0]
        other = java_luma(spark, data)
        assert own.shape == other.shape and np.abs(own - other).max() <= 2 and (own == other).mean() > 0.8


def test_progressive_files_of_another_writer(spark):
    """Java's writer makes the file: other tables, scans and sampling."""
    jvm, rng = spark._jvm, np.random.default_rng(6)
    image = jvm.java.awt.image.BufferedImage(40, 24, 1)
    for x in range(40):
        for y in range(24):
            image.setRGB(x, y, int(((6 * x) << 16) | ((8 * y) << 8) | int(rng.integers(0, 200))))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    writer.getOutput().flush()
    data = bytes(out.toByteArray())
    assert b"\xff\xc2" in data
    own, other = luma(*jpeg.coefficients([data]))[0], java_luma(spark, data)
    assert own.shape == other.shape == (24, 40) and np.abs(own - other).max() <= 2


def test_tensors_are_stored(spark):
    df = spark.createDataFrame([(1, "a text " * 200), (None, "b"), (None, "b")], "doc_id long, text string")
    rows = media.read_media(media.to_media(df)).collect()
    assert len(rows) == 3
    for r in rows:
        rgb = np.frombuffer(bytes(r.rgb), np.uint8).reshape(r.height, r.width, 3)
        assert media.describe(rgb) == r.feature and (rgb == jpeg.tensors(*jpeg.coefficients([bytes(r.media)]))[0]).all()


def test_frame(spark):
    df = spark.createDataFrame([(1, "héllo", 5), (1, "héllo", 6), (2, None, 7), (3, "", 8)], "doc_id long, text string, media int")
    rows = media.read_media(media.to_media(df)).orderBy("doc_id").collect()
    assert [bytes(r.payload) for r in rows] == [padded("héllo".encode())] * 2 + [b" " * 192] * 2
    assert rows[0].media == rows[1].media and rows[0].feature == rows[1].feature and len(rows[0].rgb) == 3 * rows[0].height * rows[0].width
    assert media.read_media(media.to_media(df.limit(0))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in media.op7_media(spark, sf).collect():
        p = padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        m = jpeg.encode([p])[0]
        rgb = jpeg.tensors(*jpeg.coefficients([m]))[0]
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
        assert (r.feature, r.rgb_bytes, r.rgb_sha256) == (media.describe(rgb), rgb.size, hashlib.sha256(rgb.tobytes()).hexdigest())
