import hashlib
import zlib

import numpy as np
import pytest

from assaylake.llm import progressive_jpeg as J

TEXTS = [None, "", "a", "x" * 64, "y" * 65, "é€𝄞" * 300, "\x00" * 130, "long " * 60_000, "a"]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 384, 385, 40_000])
def test_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    assert J.unpack(J.decode(J.pack(data))) == data.ljust(J.padded_size(n), b"\0")


def test_symbol_by_symbol_reading_agrees(monkeypatch):
    data = np.random.default_rng(5).integers(0, 256, 2000, np.uint8).tobytes()
    fast = J.decode(J.pack(data))
    monkeypatch.setattr(J, "_uniform", lambda *a: False)
    slow = J.decode(J.pack(data))
    for a, b in zip(fast.parts, slow.parts):
        assert (a.coef == b.coef).all()


def test_wide_layout_and_flat_image(monkeypatch):
    monkeypatch.setattr(J, "TALL", 3)
    data = bytes(range(256)) * 40
    img = J.decode(J.pack(data))
    assert img.width > 16 and J.unpack(img) == data
    img.parts[0].coef[:] = 0
    img.parts[0].coef[:, 0] = 8 * 40
    for p in img.parts[1:]:
        p.coef[:] = 0
    assert (J.rgb(img) == 168).all()


def test_inverse_transform_is_the_textbook_sum():
    c = np.random.default_rng(1).integers(-50, 50, 64)
    grid = np.zeros(64)
    grid[J.ZIGZAG] = c
    grid = grid.reshape(8, 8)
    f = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    want = [[sum(f(u) * f(v) / 4 * grid[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for y in range(8)] for x in range(8)]
    assert np.allclose((c.astype(np.float32) @ J.INVERSE).reshape(8, 8), want, atol=1e-2)


def test_not_a_jpeg():
    with pytest.raises(ValueError):
        J.decode(b"plain")


def test_columns(spark):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string")
    media = J.to_media(df)
    rows = {r.doc_id: r for r in J.describe(media).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw.ljust(J.padded_size(len(raw)), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert rows[2][1:] == rows[8][1:]
    t = {r.doc_id: r for r in J.to_tensors(media).collect()}
    assert all(len(r.tensor) == r.height * r.width * 3 for r in t.values())
    assert J.describe(media.limit(0)).count() == 0
    assert J.describe(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().payload_sha256 is None
