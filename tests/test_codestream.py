"""Codestreams: round trips, windows, resolutions, refusals; rate search."""

import random

import numpy as np
import pytest

from rasterloom.operators import codestream, entropy, rate


def image(h, w, c, bits=8, seed=0):
    rng = np.random.default_rng(seed + h * 100 + w)
    return [rng.integers(0, 1 << bits, (h, w)) for _ in range(c)]


@pytest.mark.parametrize(("h", "w"), [(1, 1), (2, 3), (8, 8), (5, 9), (70, 130)])
def test_round_trips(h, w):
    for c in (1, 2, 3):
        for levels in (0, 1, 3):
            planes = image(h, w, c)
            back = codestream.decode(codestream.encode(planes, 8, levels))
            assert all((a == b).all() for a, b in zip(planes, back, strict=True))


def test_flat_and_extreme_images():
    for planes, bits in (([np.full((9, 9), 128)], 8), ([np.zeros((6, 6), int)], 16), ([np.full((6, 6), 65535)] * 3, 16), ([np.eye(7, dtype=int)], 1)):
        back = codestream.decode(codestream.encode(planes, bits))
        assert all((a == b).all() for a, b in zip(planes, back, strict=True))


def test_windows_are_crops_of_the_whole():
    planes = image(50, 70, 3, 12)
    data = codestream.encode(planes, 12, 2, tile=32)
    rng = random.Random(1)
    for _ in range(5):
        x, y = rng.randrange(70), rng.randrange(50)
        w, h = rng.randint(1, 70 - x), rng.randint(1, 50 - y)
        got = codestream.decode(data, region=(x, y, w, h), components=[2, 0])
        assert (got[0] == planes[2][y : y + h, x : x + w]).all() and (got[1] == planes[0][y : y + h, x : x + w]).all()


def test_discarded_levels_give_the_low_band():
    planes = image(21, 34, 1)
    data = codestream.encode(planes, 8, 2)
    low = codestream.analyse(planes[0].astype(np.int64) - 128, 1)[0, "LL"] + 128
    assert (codestream.decode(data, discard=1)[0] == np.clip(low, 0, 255)).all()


def test_index_and_headers():
    data = codestream.encode(image(10, 10, 1), 8, 1, tile=4)
    index = codestream.tile_index(data)
    assert [t for t, _, _ in index] == list(range(9)) and index[-1][2] == len(data) - 2
    assert [m[0] for m in codestream.markers(data)][:6] == ["SOC", "SIZ", "COD", "QCD", "SOT", "SOD"]
    info = codestream.inspect(data)
    assert (info["width"], info["height"], info["levels"], info["supported"]) == (10, 10, 1, True)


def test_refusals():
    data = codestream.encode(image(8, 8, 1), 8)
    other = bytearray(data)
    other[data.index(b"\xff\x52") + 5] = 2  # another progression
    assert not codestream.inspect(bytes(other))["supported"]
    for bad, options in (
        (bytes(other), {}), (data[:-20], {}), (b"\0\0", {}), (data, {"region": (0, 0, 0, 4)}), (data, {"region": (4, 4, 5, 4)}), (data, {"discard": 3}),
        (data, {"components": [0, 0]}), (data, {"components": [1]}),
    ):
        with pytest.raises(codestream.Refused):
            codestream.decode(bad, **options)
    for planes, bits in ((image(4, 4, 5), 8), (image(4, 4, 1, 9), 8), (image(4, 4, 1), 17)):
        with pytest.raises(codestream.Refused):
            codestream.encode(planes, bits)


def test_rate_search_on_a_known_curve():
    size = lambda rows, c: (70_000 - c) // 100
    (pick,), (most,), (looks,) = rate.search(size, 1, 300)
    assert most == size(None, pick) == 300 and looks <= rate.VISITS
    assert [x.tolist() for x in rate.search(size, 1, 10)] == [[rate.COARSEST], [44], [1]]
    assert rate.undershoot_allowed(100) == 32 and rate.undershoot_allowed(50_000) == 100


def test_rate_search_of_planes(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, (rng.standard_normal((8, 8)) * 60).tolist()) for k in range(4)], "k long, plane array<array<double>>")
    for r in rate.search_planes(df, "k", "plane", 40).collect():
        assert r["size"] <= 40 and r["looks"] <= rate.VISITS and r["success"]


def test_rate_searches_in_step_equal_a_loop(spark):
    """Every look at every plane by itself, with the coder of single blocks."""
    rng = np.random.default_rng(4)
    scales = [0, 1, 60, 60, 900, 1e9]
    planes = [(rng.standard_normal((h, 8)) * s).tolist() for s in scales for h in (8, 3)]

    def size_of(plane, c):
        q = [[int(abs(v) / rate.step_of(c, 8)) * (1 if v > 0 else -1) for v in row] for row in plane]
        return None if max(abs(v) for row in q for v in row) >= rate.LARGEST else len(entropy.encode_block(q)[1])

    for budget in (0, 12, 40):
        want = {}
        for k, plane in enumerate(planes):
            seen = {rate.COARSEST: size_of(plane, rate.COARSEST)}
            low, high = rate.FINEST, rate.COARSEST
            fits = lambda s: s is not None and s <= budget
            looks = 1
            while fits(seen[rate.COARSEST]) and low <= high and looks < rate.VISITS:
                c = (low + high) // 2
                seen.setdefault(c, size_of(plane, c))
                low, high = (low, c - 1) if fits(seen[c]) else (c + 1, high)
                looks += 1
            allowed = {c: s for c, s in seen.items() if fits(s)} or {rate.COARSEST: seen[rate.COARSEST] or 0}
            best = max(allowed.values())
            want[k] = (next(c for c, s in allowed.items() if s == best), best, looks)
        df = spark.createDataFrame(list(enumerate(planes)), "k long, plane array<array<double>>").coalesce(1)
        got = {r.k: (r.coarseness, r["size"], r.looks) for r in rate.search_planes(df, "k", "plane", budget).collect()}
        assert got == want
