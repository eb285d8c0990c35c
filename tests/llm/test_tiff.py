"""TIFF: exact round trips over compressions, predictors, layouts, byte orders and pages."""

import itertools

import numpy as np
import pytest

from loomgraph.llm import op7_tiff, tiff

IMAGES = {
    "grey": np.random.default_rng(1).integers(0, 256, (70, 130), dtype=np.uint8),
    "flat": np.zeros((5, 64), np.uint8),
    "text": np.frombuffer(op7_tiff.payload(("the quick brown fox aaaaaaa " * 700).encode()), np.uint8).reshape(-1, 64),
    "rgb16": np.random.default_rng(2).integers(0, 65536, (33, 17, 3), dtype=np.uint16),
    "pixel": np.array([[7]], np.uint8),
}


@pytest.mark.parametrize("compression,predictor,tile,order", itertools.product([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS], [1, 2], [0, 16], "<>"))
def test_round_trip(compression, predictor, tile, order):
    found = list(tiff.pages(tiff.write(list(IMAGES.values()), compression, predictor, tile, 512, order)))
    assert [p.index for p in found] == list(range(len(IMAGES)))
    for p, image in zip(found, IMAGES.values(), strict=True):
        assert np.array_equal(p.pixels, image.reshape(p.pixels.shape))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 127, 128, 129, 255, 256, 257, 300, 5000, 70000])
def test_codecs(n):
    for data in (b"a" * n, bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)), (b"ab" * n)[:n], bytes(np.random.default_rng(n).integers(0, 3, n, dtype=np.uint8))):
        assert tiff.unpackbits(tiff.packbits(data), n) == data
        assert tiff.unlzw(tiff.lzw(data), n) == data


def test_payload():
    assert op7_tiff.payload(b"") == b"\0" * 64
    assert op7_tiff.payload(b"x" * 64) == b"x" * 64
    assert len(op7_tiff.payload(b"x" * 65)) == 128
