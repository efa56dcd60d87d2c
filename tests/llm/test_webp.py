"""The WebP operator: expected values made here, streams of every feature, all predictors by their definitions."""

import hashlib
import struct
import zlib
from random import Random

import numpy as np
import pytest

from siltstone.llm import webp


def payload(text):
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def feature(data: bytes) -> str:
    edges = [len(data) * k // 64 for k in range(65)]
    means = [sum(data[a:b]) / (b - a) for a, b in zip(edges, edges[1:])]
    bits = [int(means[(k + 1) % 64] - means[k] > 0) for k in range(64)]
    packed = bytes(sum(bits[8 * k + j] << (7 - j) for j in range(8)) for k in range(8))
    return bytes(int(sum(means[4 * k : 4 * k + 4]) / 4) for k in range(16)).hex() + ":" + packed.hex()


def texts():
    r = Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz\u00e9\u4e2d") for _ in range(r.randint(1, 9)))
    line = " ".join(word() for _ in range(30))
    plain = " ".join(word() for _ in range(900))
    return [None, "", "a", "ab" * 900, "abcd" * 50, "0123456789abcde" * 40, plain, f"{plain}\n{line}\n{line}\n{plain}", line * 9000, "\x00\x01", "x" * 64, plain * 60, "".join(chr(33 + k // 4 % 90) for k in range(5000))]


def test_digests_of_the_query(spark):
    rows = list(enumerate(texts())) + [(6, texts()[6]), (None, "null id")]
    got = webp.media_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    by = {(r.n_bytes, r.payload_sha256): r for r in got}
    for _, t in rows:
        want = payload(t)
        r = by[len((t or "").encode()), hashlib.sha256(want).hexdigest()]
        media = webp.encode_payload(want)
        assert (r.payload_bytes, r.tail_crc32, r.feature) == (len(want), zlib.crc32(want[-64:]), feature(want))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def used(monkeypatch, data: bytes) -> set[str]:
    """The features that reading the stored form of data meets."""
    seen = set()
    for name in ("undo_predictor", "undo_palette"):
        monkeypatch.setattr(webp, name, lambda *a, f=getattr(webp, name), n=name: (seen.add(n), f(*a))[1])
    read = webp._read_green

    def looked(bits, codes, n, width):
        seen.update({"references"} if any(k >= 256 for k in codes[0].used) else ())
        seen.update({"prefix code"} if len(set(codes[0].sizes.tolist())) > 1 else ())
        return read(bits, codes, n, width)

    monkeypatch.setattr(webp, "_read_green", looked)
    assert webp.decode_payload(webp.encode_payload(data)) == data
    monkeypatch.undo()
    return seen


def test_streams_of_the_query_hold_the_features(monkeypatch):
    _, _, a, ab, abcd, fifteen, plain, repeated, long, *_ = texts()
    assert used(monkeypatch, payload(plain)) >= {"prefix code"}
    assert used(monkeypatch, payload(repeated)) >= {"prefix code", "references"}
    assert used(monkeypatch, payload(abcd)) >= {"undo_palette", "references"}
    assert "undo_palette" in used(monkeypatch, payload(fifteen))
    ramp = bytes((k // 3 + k % 2) % 256 for k in range(64 * 40))
    assert "undo_predictor" in used(monkeypatch, ramp)
    assert len(webp.encode_payload(payload(long))) < len(payload(long)) / 50  # several images, nearly all references
    assert len(webp.images(webp.encode_payload(payload(long)))) > 1
    assert len(webp.encode_payload(payload(plain))) < 0.8 * len(payload(plain))


def test_any_payload_comes_back():
    r = np.random.default_rng(8)
    for n in (1, 2, 3, 5, 40):
        for top in (1, 2, 3, 5, 16, 17, 100, 256):
            data = r.integers(0, top, 64 * n, dtype=np.uint8).tobytes()
            assert webp.decode_payload(webp.encode_payload(data)) == data
    skewed = np.minimum(255, r.geometric(0.02, 64 * 20000)).astype(np.uint8).tobytes()  # long codes, two images
    assert webp.decode_payload(webp.encode_payload(skewed)) == skewed


def test_code_lengths_are_best_and_limited():
    counts = np.array([2**k for k in range(20)])
    lengths = webp.code_lengths(counts, 12)
    assert lengths.max() <= 12 and (2.0 ** -lengths).sum() == 1
    assert webp.code_lengths(np.array([5, 0, 2, 1, 1]), 12).tolist() == [1, 0, 2, 3, 3]


def average(a, b):
    return (a + b) // 2


def predicted(mode, l, t, tl, tr):
    """One channel by the format's text; mode 11 is decided over all channels by the caller."""
    clamp = lambda v: min(255, max(0, v))
    a = average(l, t)
    return {
        0: None, 1: l, 2: t, 3: tr, 4: tl, 5: average(average(l, tr), t), 6: average(l, tl), 7: average(l, t), 8: average(tl, t), 9: average(t, tr),
        10: average(average(l, tl), average(t, tr)), 12: clamp(l + t - tl), 13: clamp(a + int((a - tl) / 2)),
    }[mode]


@pytest.mark.parametrize("mode", range(14))
def test_every_predictor_inverts(mode):
    w, h, r = 7, 6, np.random.default_rng(mode)
    g = r.integers(0, 256, (h, w, 4))
    p = np.zeros_like(g)
    for y in range(h):
        for x in range(w):
            if y == 0:
                q = g[0, x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                q = g[y - 1, 0]
            else:
                l, t, tl, tr = g[y, x - 1], g[y - 1, x], g[y - 1, x - 1], g[y - 1, x + 1] if x + 1 < w else g[y, 0]
                if mode == 0:
                    q = [255, 0, 0, 0]
                elif mode == 11:
                    q = l if abs(l + t - tl - l).sum() < abs(l + t - tl - t).sum() else t
                else:
                    q = [predicted(mode, *(int(v[c]) for v in (l, t, tl, tr))) for c in range(4)]
            p[y, x] = (g[y, x] - np.array(q)) & 255
    for tile in (2, 9):  # tiles of four and one for all
        tiles = (-(-w // 2**tile)) * (-(-h // 2**tile))
        back = webp.undo_predictor(webp._join(p).reshape(-1), np.full(tiles, mode << 8, np.uint32), w, h, tile)
        assert (back == webp._join(g).reshape(-1)).all()


def test_groups_of_codes_by_an_entropy_image():
    """Two groups, left and right tile: each pixel by its own group's code."""
    bits = []
    put = lambda v, n: bits.extend(v >> k & 1 for k in range(n))

    def code(*symbols):
        put(1, 1), put(len(symbols) - 1, 1), put(1, 1)
        for s in symbols:
            put(s, 8)

    put(0x2F, 8), put(7, 14), put(0, 14), put(1, 1), put(0, 3), put(0, 1)
    put(0, 1), put(1, 1), put(0, 3)  # no cache; an entropy image of tiles of four
    put(0, 1)
    for s in ((0, 1), (0,), (0,), (0,), (0,)):
        code(*s)
    put(0, 1), put(1, 1)  # groups 0 and 1
    for green in ((5, 6), (100, 200)):
        code(*green), code(1), code(2), code(255), code(0)
    for b in (0, 1, 1, 0, 1, 0, 0, 1):
        put(b, 1)
    _, _, pixels = webp.decode_stream(np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes())
    assert (pixels >> 8 & 255).tolist() == [5, 6, 6, 5, 200, 100, 100, 200] and set((pixels & 0xFFFF00FF).tolist()) == {0xFF010002}


def test_damaged_streams():
    media = webp.encode_payload(payload("some words " * 40))
    with pytest.raises(ValueError):
        webp.images(b"x" + media)
    cut = media[20:-12]
    with pytest.raises(ValueError):
        webp.decode_stream(cut)


def test_columns_there_and_back(spark):
    df = spark.createDataFrame([(1, "some text", "old"), (2, None, None)], "doc_id long, text string, media string")
    back = webp.from_webp(webp.to_webp(df), "media_").orderBy("doc_id").collect()
    for r, t in zip(back, ("some text", None)):
        assert b"".join(bytes(p & 255 for (p,) in struct.iter_unpack(">I", x.pixels)) for x in r.images) == payload(t)
        assert (r.doc_id, r.text, r.media) == (1 if t else 2, t, "old" if t else None)


def test_input_columns_of_the_same_name_stay(spark):
    df = spark.createDataFrame([("some text", "old", 1), (None, None, None)], "text string, Media string, images int")
    stored = webp.to_webp(df)
    assert stored.columns == ["text", "Media", "images", "media_"]
    back = webp.from_webp(stored, "media_")
    assert back.columns == ["text", "Media", "images", "media_", "images_"]
    rows = {r.text: r for r in back.collect()}
    assert (rows["some text"].Media, rows["some text"].images) == ("old", 1) and rows["some text"].images_[0].width > 0


def test_prefixes_that_are_looked_up_are_those_that_are_computed():
    for v in (np.zeros(0, np.int64), np.arange(1, 5000), np.array([1, 4096, (1 << 16) - 1]), np.array([3, 1 << 16, 64 * 16384 + 120])):
        assert [x.tolist() for x in webp._prefixes(v)] == [x.tolist() for x in webp._prefix_of(v)]
    for v in (1, 2, 4, 5, 120, 121, 4096, 70_000, 1_000_000):
        symbol, extra, n = (int(x[0]) for x in webp._prefix_of(np.array([v])))
        assert webp.BASE[symbol] + extra == v and webp.EXTRA[symbol] == n and extra <= webp.MASK[symbol]
