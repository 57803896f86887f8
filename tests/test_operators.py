"""Operators against loops, round trips, limits and refusals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import contexts, protocol, samples
from rasterloom.operators import blocks, entropy, grid, lookup, metrics, packets, ranges, wavelet
from rasterloom.plans import catalog
from rasterloom.sources import boxes, raster_files
from rasterloom.streaming import delivery


def loop_53(x):
    x, n = list(x), len(x)
    if n == 1:
        return x
    at = lambda i: x[-i if i < 0 else 2 * (n - 1) - i if i >= n else i]
    for i in range(1, n, 2):
        x[i] -= (at(i - 1) + at(i + 1)) // 2
    for i in range(0, n, 2):
        x[i] += (at(i - 1) + at(i + 1) + 2) // 4
    return x


def lines(spark, rng):
    data = {k: [rng.randint(-500, 500) for _ in range(n)] for k, n in enumerate([1, 2, 3, 4, 5, 8, 17, 64])}
    rows = [(k, i, v) for k, x in data.items() for i, v in enumerate(x)]
    rng.shuffle(rows)
    return data, spark.createDataFrame(rows, "line long, i long, v long")


def test_line_lifting_equals_a_loop(spark):
    data, df = lines(spark, random.Random(1))
    out = wavelet.lift_lines(df, ["line"], "i", wavelet.FORWARD_53)
    got = {(r["line"], r["i"]): r["v"] for r in out.collect()}
    assert got == {(k, i): v for k, x in data.items() for i, v in enumerate(loop_53(x))}
    back = wavelet.lift_lines(out, ["line"], "i", wavelet.INVERSE_53)
    assert {(r["line"], r["i"]): r["v"] for r in back.collect()} == {(k, i): v for k, x in data.items() for i, v in enumerate(x)}


def test_array_lifting_equals_line_lifting(spark):
    data, df = lines(spark, random.Random(2))
    arrays = spark.createDataFrame(list(data.items()), "line long, x array<long>")
    got = {r["line"]: r["y"] for r in arrays.select("line", wavelet.lift_row(F.col("x"), wavelet.FORWARD_53).alias("y")).collect()}
    assert got == {k: loop_53(x) for k, x in data.items()}


@pytest.mark.parametrize(("height", "width"), [(1, 1), (1, 5), (4, 1), (3, 7), (8, 8)])
def test_planes_of_odd_sizes_round_trip(spark, height, width):
    rng = np.random.default_rng(height * 10 + width)
    plane = rng.integers(-128, 128, (height, width)).tolist()
    df = spark.createDataFrame([(0, plane)], "vec_id long, plane array<array<long>>")
    coded = wavelet.analyse_planes(df)
    want = np.array([loop_53(r) for r in np.array([loop_53(c) for c in np.array(plane).T.tolist()]).T.tolist()])
    assert coded.first()["plane"] == want.tolist()
    assert wavelet.synthesise_planes(coded).first()["plane"] == plane


def test_missing_palette_entry_is_an_error(spark):
    table = spark.createDataFrame([(0, 5), (1, 6)], "entry long, c long")
    good = spark.createDataFrame([(0,), (1,), (1,)], "index long")
    assert sorted(r["c"] for r in lookup.strict_lookup(good, "index", table, "entry").collect()) == [5, 6, 6]
    with pytest.raises(Exception, match="no entry 2"):
        lookup.strict_lookup(spark.createDataFrame([(2,)], "index long"), "index", table, "entry").collect()


def test_broadcast_only_when_counted_small(spark):
    rows = spark.range(10)
    assert "ResolvedHint" in lookup.maybe_broadcast(rows)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in lookup.maybe_broadcast(rows, 5)._jdf.queryExecution().analyzed().toString()


def test_touching_ranges_merge(spark):
    rows = [(1, 0, 5), (1, 5, 7), (1, 8, 9), (1, 1, 2), (2, 3, 4), (2, 3, 4)]
    out = ranges.merge_ranges(spark.createDataFrame(rows, "k long, s long, e long"), ["k"])
    assert sorted(map(tuple, out.select("k", "s", "e").collect())) == [(1, 0, 7), (1, 8, 9), (2, 3, 4)]


def test_cache_reads_of_every_row(spark, tmp_path):
    rng = random.Random(14)
    rows = [(rng.randint(1, 12), rng.randint(1, 7), rng.randint(1, 3), float(rng.randint(0, 50))) for _ in range(150)] + [(1, 2, None, 30.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["q_cache_read"](spark, str(tmp_path)).select("k", "l_orderkey", "a", "b", "s", "e").collect()
    merged = []
    for k, s, e in sorted((k, o * 10, o * 10 + int(q)) for o, _, k, q in rows if k is not None):
        if merged and merged[-1][0] == k and s <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    want = [(k, o, o * 10 + 2, o * 10 + 6, s, e) for o, _, k, _ in rows for m, s, e in merged if m == k and s <= o * 10 + 2 and e >= o * 10 + 6]
    assert len(want) > sum(n == 1 for _, n, _, _ in rows)
    assert sorted(map(tuple, got)) == sorted(want)


def test_tiles_cover_regions_without_overlap(spark):
    rng = random.Random(3)
    rects = [(i, rng.randint(0, 300), rng.randint(0, 300), rng.randint(1, 200), rng.randint(1, 200)) for i in range(50)] + [(99, 0, 0, 0, 5)]
    out = grid.clip_to_tile(grid.overlapping_tiles(spark.createDataFrame(rects, "id long, x long, y long, w long, h long"), 64), 64).collect()
    area = {}
    for r in out:
        assert r["x0"] < r["x1"] and r["y0"] < r["y1"]
        area[r["id"]] = area.get(r["id"], 0) + (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    assert area == {i: w * h for i, _, _, w, h in rects if w * h}


def test_code_blocks_of_every_region(spark, tmp_path):
    rng = random.Random(5)
    orders = [(k, rng.randint(1, 15_000)) for k in range(1, 41)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["q_codeblock_select"](spark, str(tmp_path)).collect()
    want = []
    for k, c in orders:
        x, y, w, h = k * 37 % 3840, (k * 11 + c * 17) % 3840, 1 + k % 255, 1 + c % 254
        over = lambda at, n: [b for b in range(64) if b * 64 < at + n + 4 and at - 4 < b * 64 + 64]
        want += [(k, bx, by) for bx in over(x, w) for by in over(y, h)]
    assert {k for k, _, _ in want} == {k for k, _ in orders}
    assert sorted(map(tuple, got)) == sorted(want)


def test_percentile_bounds(spark):
    rows = [(1, v) for v in [0, 1, 2, 3, 4, 5, 100]]
    out = metrics.percentile_bounds(spark.createDataFrame(rows, "k long, v long"), ["k"], "v", [50, 95]).first()
    assert (out["reads"], out["p50"], out["p95"]) == (7, 4, 128)


def test_arithmetic_coder_round_trip():
    rng = random.Random(4)
    for n in (0, 1, 7, 500, 5000):
        bits = [(rng.randrange(19), int(rng.random() < 0.2)) for _ in range(n)]
        coder = entropy.Encoder()
        for cx, bit in bits:
            coder.encode(cx, bit)
        data = coder.finish()
        back = entropy.Decoder(data)
        assert [back.decode(cx) for cx, _ in bits] == [bit for _, bit in bits]
        assert all(not (a == 0xFF and b > 0x8F) for a, b in zip(data, data[1:]))


@pytest.mark.parametrize("band", ["LL", "HL", "LH", "HH"])
def test_block_coding_round_trip(band):
    rng = random.Random(5)
    for w, h in [(1, 1), (4, 4), (5, 9), (16, 3)]:
        for scale in (0, 1, 7, 4000):
            v = [[rng.randint(-scale, scale) if rng.random() < 0.5 else 0 for _ in range(w)] for _ in range(h)]
            planes, data = entropy.encode_block(v, band)
            assert entropy.decode_block(w, h, planes, data, band) == v


def test_blocks_in_step_equal_single_blocks():
    rng = np.random.default_rng(7)
    for h, w, n in [(8, 8, 20), (5, 7, 15), (1, 1, 14), (9, 2, 13), (20, 33, 3)]:
        for band in ("LL", "LH", "HL", "HH"):
            v = np.round(rng.standard_normal((n, h, w)) * rng.choice([0, 0.3, 2, 60, 9000], (n, 1, 1))).astype(np.int64)
            planes, data = blocks.encode_many(v, band)
            assert list(zip(planes.tolist(), data, strict=True)) == [entropy.encode_block(x.tolist(), band) for x in v]
            assert (blocks.decode_many(w, h, planes, data, band) == v).all()


def test_blocks_of_mixed_shapes(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-50, 50, (h, w)).tolist()) for i in range(40) for h, w in [[(2, 3), (5, 1), (4, 4)][i % 3 if i < 38 else 2]]]
    rows.append((40, [[0, 0], [0, 0]]))
    df = spark.createDataFrame(rows, "id long, plane array<array<long>>").coalesce(1)
    coded = blocks.encode_blocks(df, "id", "plane")
    assert {r.id: r.plane for r in blocks.decode_blocks(coded, "id").collect()} == dict(rows)
    assert blocks.encode_blocks(df.limit(0), "id", "plane").count() == 0


@pytest.mark.parametrize("style", [("bypass",), ("terminate",), ("bypass", "terminate"), ("reset",), ("causal",), ("segmentation",), ("bypass", "reset", "causal", "segmentation")])
def test_block_styles_round_trip(style):
    rng = random.Random(9)
    for w, h in [(4, 4), (7, 13)]:
        for scale in (1, 40, 30_000):
            v = [[rng.randint(-scale, scale) if rng.random() < 0.6 else 0 for _ in range(w)] for _ in range(h)]
            planes, segments = entropy.encode_segments(v, "HL", style)
            assert entropy.decode_segments(w, h, planes, segments, "HL", style) == v
            assert sum(entropy.segment_lengths(3 * planes - 2, frozenset(style))) == 3 * planes - 2


def test_block_style_refusals():
    with pytest.raises(ValueError, match="unsupported styles"):
        entropy.encode_segments([[5]], style=("predictable",))
    planes, segments = entropy.encode_segments([[500] * 4] * 4, style=("terminate",))
    with pytest.raises(ValueError, match="segments"):
        entropy.decode_segments(4, 4, planes, segments[:-1], style=("terminate",))


def test_contexts_of_expressions_and_of_the_coder_agree(spark):
    rows = [(b, h, v, d) for b in ("LL", "HL", "LH", "HH") for h in range(3) for v in range(3) for d in range(5)]
    df = spark.createDataFrame(rows, "b string, h int, v int, d int")
    got = df.select("b", "h", "v", "d", contexts.zero_context(F.col("b"), F.col("h"), F.col("v"), F.col("d")).alias("c")).collect()
    for r in got:
        coder = entropy.BlockCoder(3, 3, r["b"], None)
        coder._near = lambda y, x, r=r: (r["h"], r["v"], r["d"])
        assert coder._zero_context(1, 1) == r["c"]


def test_lzw_and_predictor_round_trip():
    rng = random.Random(6)
    for n in (0, 1, 300, 20_000):
        for k in (2, 256):
            data = bytes(rng.randrange(k) for _ in range(n))
            assert raster_files.lzw_decode(raster_files.lzw_encode(data)) == data
    rows = bytes([10, 20, 30, 1, 2, 3, 250, 250, 250])
    assert raster_files.undo_predictor(rows, 3, 3) == bytes([10, 20, 30, 11, 22, 33, 5, 16, 27])


def tiff(width, height, body, packing, predictor):
    entries = [(256, 3, [width]), (257, 3, [height]), (258, 3, [8, 8, 8]), (259, 3, [packing]), (262, 3, [2]), (273, 4, [0]), (277, 3, [3]), (279, 4, [len(body)]), (317, 3, [predictor])]
    at = 8 + 2 + 12 * len(entries) + 4
    out, extra = len(entries).to_bytes(2, "little"), (8).to_bytes(2, "little") * 3
    for tag, kind, values in entries:
        if tag == 273:
            values = [at + len(extra)]
        size = 2 if kind == 3 else 4
        data = at.to_bytes(4, "little") if tag == 258 else b"".join(v.to_bytes(size, "little") for v in values).ljust(4, b"\0")
        out += tag.to_bytes(2, "little") + kind.to_bytes(2, "little") + len(values).to_bytes(4, "little") + data
    return b"II*\0" + (8).to_bytes(4, "little") + out + bytes(4) + extra + body


def test_tiff_profiles():
    px = np.random.default_rng(7).integers(0, 256, (4, 5, 3)).astype(np.uint8)
    assert (raster_files.parse_tiff_rgb(tiff(5, 4, px.tobytes(), 1, 1))[2] == px).all()
    diff = px.copy()
    diff[:, 1:] -= px[:, :-1]
    assert (raster_files.parse_tiff_rgb(tiff(5, 4, raster_files.lzw_encode(diff.tobytes()), 5, 2))[2] == px).all()
    for packing, predictor in [(1, 2), (5, 1), (7, 1)]:
        with pytest.raises(ValueError, match="profile"):
            raster_files.parse_tiff_rgb(tiff(5, 4, px.tobytes(), packing, predictor))


def test_pgx_refusals():
    w, h, bits, signed, v = raster_files.parse_pgx(b"PG LM -16 2 1\n" + (1).to_bytes(2, "little") + (-2).to_bytes(2, "little", signed=True))
    assert (w, h, bits, signed, v.tolist()) == (2, 1, 16, True, [[1, -2]])
    for bad in (b"PG ML 8 2 2\nabc", b"P5 2 2", b"PG ML 17 1 1\nab"):
        with pytest.raises(ValueError, match="PGX"):
            raster_files.parse_pgx(bad)


def test_box_errors():
    assert list(boxes.split_boxes(bytes.fromhex("00000000") + b"xml abc", 0, 11)) == [(b"xml ", 0, 8, 11)]
    long = (1).to_bytes(4, "big") + b"uuid" + (17).to_bytes(8, "big") + b"z"
    assert list(boxes.split_boxes(long, 0, 17)) == [(b"uuid", 0, 16, 17)]
    inner = (0).to_bytes(4, "big") + b"xml "
    for bad in (b"\0\0\0", b"\0\0\0\x04abcd", b"\0\0\0\x20abcd", (16).to_bytes(4, "big") + b"jp2h" + inner):
        with pytest.raises(ValueError, match="box"):
            list(boxes.split_boxes(bad, 0, len(bad)))


def test_ranged_reads(spark, tmp_path):
    data = bytes(range(256)) * 10
    (tmp_path / "raw").write_bytes(data)
    spark.dataSource.register(raster_files.ByteRanges)
    opts = {"path": str(tmp_path / "raw"), "length": str(len(data)), "size": "700"}
    rows = spark.read.format("byteranges").options(**opts).load().orderBy("start").collect()
    assert [r["start"] for r in rows] == [0, 700, 1400, 2100] and b"".join(bytes(r["data"]) for r in rows) == data
    with pytest.raises(Exception, match="ends before"):
        spark.read.format("byteranges").options(**(opts | {"length": "9999"})).load().collect()


def response(spark):
    rows = [(0, 3, 0, True, b"hello"), (2, 700, 5, False, b"x" * 300), (8, 1, 0, True, b""), (0, 4, 128, False, b"\xff\x00")]
    df = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], "c long, i long, o long, f boolean, d binary")
    m = [bytes(r[0]) for r in df.select(delivery.message_bytes(F.col("c"), F.col("i"), F.col("o"), F.col("f"), F.col("d"))).collect()]
    return rows, b"".join(m) + bytes([0, delivery.COMPLETE, 0])


def test_every_fragmentation_gives_the_same_bytes(spark):
    rows, data = response(spark)
    for step in (1, 2, 3, 7, len(data)):
        f, got = delivery.Framing(), {}
        for k in range(0, len(data), step):
            for cls, i, o, final, part in f.push(data[k : k + step]):
                key = (cls, i)
                got.setdefault(key, []).append((o, final, part))
        f.finish()
        for cls, i, o, final, body in rows:
            parts = sorted(got[cls, i])
            assert parts[0][0] == o and b"".join(p[2] for p in parts) == body and any(p[1] for p in parts) == final


def test_framing_refusals(spark):
    _, data = response(spark)
    with pytest.raises(ValueError, match="not complete"):
        f = delivery.Framing()
        f.push(data[:-1])
        f.finish()
    for bad, limit in ((data + b"x", 1 << 20), (b"\x10\x01", 1 << 20), (data, 100)):
        f = delivery.Framing(limit)
        with pytest.raises(ValueError):
            f.push(bad)
        with pytest.raises(ValueError, match="failed"):
            f.push(b"\0")


def test_cache_rules():
    c = delivery.RangeCache(max_bytes=20)
    c.bind("t")
    c.insert((0, 1), 5, b"56789", False)
    assert c.prefix((0, 1)) == 0
    c.insert((0, 1), 0, b"012345", False)
    assert c.prefix((0, 1)) == 10 and not c.complete((0, 1)) and c.read((0, 1), 3, 4) == b"3456"
    with pytest.raises(ValueError, match="disagree"):
        c.insert((0, 1), 4, b"xx", False)
    c.insert((0, 1), 10, b"", True)
    assert c.complete((0, 1)) and c.model() == {(0, 1): None}
    with pytest.raises(ValueError, match="length"):
        c.insert((0, 1), 10, b"z", False)
    c.insert((2, 0), 0, b"y" * 15, False)
    assert c.evicted == 1 and (0, 1) not in c.bins
    c.bind("u")
    assert not c.bins
    c.bind("0")
    assert c.model() == {}


DEMAND = "s string, n long, class int, id long, length long, wanted long, known long, complete boolean"


def deliver(spark, rows, *limits):
    """By session the messages (class, id, start, stop, final) and the reason of the end."""
    found = {}
    for r in delivery.deliver(spark.createDataFrame(rows, DEMAND), "s", "n", *limits).orderBy("s", "ordinal", F.col("reason").asc_nulls_first()).collect():
        sent = found.setdefault(r["s"], ([], []))
        sent[1].append(r["reason"]) if r["reason"] else sent[0].append((r["class"], r["id"], r["start"], r["stop"], r["final"]))
    return {s: (sent, *why) for s, (sent, why) in found.items()}


def test_delivery_limits(spark):
    two = [("a", 1, 0, 1, 300, None, None, None), ("a", 2, 2, 0, 10, None, 0, False)]
    sent, why = deliver(spark, two, 10_000, 128, 10)["a"]
    assert why == delivery.COMPLETE and [m[2:4] for m in sent] == [(0, 128), (128, 256), (256, 300), (0, 10)]
    assert [m[4] for m in sent] == [False, False, True, True]
    done = [("a", 1, 0, 1, 300, None, None, True), ("b", 1, 0, 1, 300, 100, 100, False), ("c", 1, 0, 1, 300, None, 300, False)]
    assert deliver(spark, done, 100, 64, 10) == {
        "a": ([], delivery.COMPLETE), "b": ([], delivery.COMPLETE), "c": ([(0, 1, 300, 300, True)], delivery.COMPLETE)
    }
    assert deliver(spark, two[:1], 1000, 10, 2)["a"] == ([(0, 1, 0, 10, False), (0, 1, 10, 20, False)], delivery.MESSAGE_LIMIT)
    with pytest.raises(Exception, match="twice"):
        deliver(spark, [two[0], two[0]], 100, 10, 5)


def test_byte_limits_take_all_that_fits(spark):
    """Every budget, against the most bytes that framed messages hold."""
    for length in (100, 200):
        for budget in (3, 5, 6, 7, 50, 131, 132, 133, 134, 135, 136, 300):
            sent, why = deliver(spark, [("a", 1, 0, 20, length, None, None, None)], budget, 1 << 20, 9)["a"]
            fits = [n for n in range(1, length + 1) if 5 + (1 if n < 128 else 2) + n <= budget]
            assert sent == ([(0, 20, 0, max(fits), max(fits) == length)] if fits else [])
            assert why == (delivery.COMPLETE if fits and max(fits) == length else delivery.BYTE_LIMIT)


def test_ids_of_any_size_are_framed(spark):
    ids = [0, 15, 16, 2047, 2048, (1 << 18) - 1, 1 << 18, (1 << 60) - 1]
    df = spark.createDataFrame([(i, bytearray(b"x")) for i in ids], "id long, d binary")
    rows = df.select("id", delivery.message_bytes(F.lit(8), F.col("id"), F.lit(0), F.lit(True), F.col("d")), delivery.id_size(F.col("id"))).collect()
    for bin_id, message, size in rows:
        got = delivery.Framing().push(bytes(message))
        assert got == [(8, bin_id, 0, True, b"x")] and len(message) == size + 5
    with pytest.raises(Exception, match="auxiliary"):
        df.select(delivery.message_bytes(F.lit(1), F.col("id"), F.lit(0), F.lit(True), F.col("d"))).collect()


def test_a_refused_insert_changes_nothing():
    c = delivery.RangeCache(max_bytes=10, max_bins=2)
    with pytest.raises(ValueError, match="identity"):
        c.insert((0, 1), 0, b"x", False)
    c.bind("t")
    c.insert((0, 1), 0, b"0123", False)
    c.insert((0, 2), 0, b"0123", False)
    for key, at, data, final in [((0, 3), 0, b"y" * 11, False), ((0, 1), 2, b"xx", False), ((0, 1), 0, b"01", True)]:
        with pytest.raises(ValueError):
            c.insert(key, at, data, final)
        assert set(c.bins) == {(0, 1), (0, 2)} and c.held == 8 and c.evicted == 0
    assert c.read((0, 1), 0, 4) == b"0123"
    c.insert((0, 3), 0, b"z", True)
    assert set(c.bins) == {(0, 1), (0, 3)} and c.held == 5 and c.evicted == 1 and c.evict((0, 3)) and not c.evict((0, 3))


def test_a_new_identity_empties_a_streamed_cache(spark, tmp_path):
    message = delivery.message_bytes(F.lit(0), F.col("i"), F.lit(0), F.lit(True), F.col("d"))
    df = spark.createDataFrame([(k, bytearray(b"ab")) for k in (1, 2)], "i long, d binary")
    data = [bytearray(bytes(r[0]) + bytes([0, delivery.COMPLETE, 0])) for r in df.select(message).collect()]
    rows = [("s", 0, data[0], "t"), ("s", 1, data[1], "u")]
    spark.createDataFrame(rows, "session string, seq long, data binary, tid string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, seq long, data binary, tid string").parquet(str(tmp_path / "in"))
    q = delivery.stream_cache(stream, "tid").writeStream.format("memory").queryName("renamed").outputMode("update")
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("renamed").collect()] == [("s", 0, 2, 2, True)]


def test_precincts_beyond_the_image_are_refused(spark):
    rows = spark.createDataFrame([(1, 3, 0), (1, 0, 4)], "s long, c long, t long")
    for k in range(2):
        with pytest.raises(Exception, match="no such tile"):
            rows.where(f"t = {4 * k}").select(protocol.precinct_id(F.col("s"), F.col("c"), F.col("t"), F.lit(3), F.lit(4))).collect()


def test_stream_equals_batch(spark, tmp_path):
    _, data = response(spark)
    pieces = [("s", k, bytearray(data[at : at + 50])) for k, at in enumerate(range(0, len(data), 50))]
    src, schema = tmp_path / "in", "session string, seq long, data binary"
    for k, p in enumerate(pieces):
        spark.createDataFrame([p], schema).coalesce(1).write.parquet(str(src / f"{k:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = delivery.stream_cache(stream).writeStream.format("memory").queryName("bins").outputMode("update")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("bins").collect():
        key = (r["class"], r["id"])
        last[key] = max(last.get(key, (0, False)), (r["prefix"], r["complete"]))
    assert last == {(0, 3): (5, True), (2, 700): (0, False), (8, 1): (0, True), (0, 4): (0, False)}


def test_samples_of_expressions(spark):
    row = spark.range(1)
    value = lambda c: row.select(c).first()[0]
    assert [value(samples.toward_zero_shift(F.lit(v), 2)) for v in (-7, 7)] == [-1, 1]
    assert [value(samples.ceil_div(F.lit(v).cast("long"), 3)) for v in (-4, 0, 1, 3)] == [-1, 0, 1, 1]
    assert value(samples.quantise(F.lit(-7.9), F.lit(2.0))) == -3
    with pytest.raises(ValueError, match="reduced"):
        samples.reduce_precision(F.lit(1), 8, 12)
    assert value(protocol.percent_decode(F.lit("a+b"))) is None and value(protocol.percent_decode(F.lit("%zz"))) is None
    assert value(grid.common_divisor(F.array(F.lit(12), F.lit(18)))) == 6
    assert [value(protocol.vbas_size(F.lit(v).cast("long"))) for v in (0, 127, 128, 16384)] == [1, 1, 2, 3]


def test_volumes_and_orders(spark):
    rows = [(0, la, r, c, 0, 0) for la in range(2) for r in range(2) for c in range(2)]
    df = spark.createDataFrame(rows, "img long, layer int, resolution int, component int, y int, x int")
    seq = {r["seq"]: (r["layer"], r["resolution"], r["component"]) for r in packets.sequence_packets(df, ["img"], "RLCP").collect()}
    assert [seq[k] for k in range(8)] == sorted(seq.values(), key=lambda t: (t[1], t[0], t[2]))
    vols = [(0, 1, 2, 0, 1), (1, 2, 2, 0, 2)]
    out = packets.first_volume(df, vols, ["img", "layer", "resolution", "component"]).collect()
    assert len(out) == 8 and {r["volume"] for r in out if r["resolution"] == 0 and r["component"] == 0} == {0}


LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"


def test_segments_of_one_place_go_by_passes_and_size(spark, tmp_path):
    rows, want = [], {}
    for k in range(40):
        # 9 passes, then two segments of one pass at one place: the first begins at 9 (arithmetic), the other at 10 (raw)
        rows += [(k, 1, 7, 4), (k, 1, 8, 3)]
        a, b = [(k, 2, 1000 + k, 100), (k, 2, 1001 + k, 0)] if k % 2 else [(k, 3, k, 0), (k, 2, 10000 + k, 0)]
        rows += [a, b]
        want[k] = (7 + 8 + a[2], b[2])
    for n, data in enumerate((rows, rows[::-1])):
        spark.createDataFrame(data, LINES).coalesce(1).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        got = catalog.QUERIES["q_segment_classes"](spark, f"{tmp_path}/{n}").collect()
        assert {r["l_orderkey"]: (r["mq_bytes"], r["raw_bytes"]) for r in got} == want
    tied = "block long, at long, passes long, size long"
    for data in ([(0, 0, 2, 9), (0, 0, 9, 5), (0, 0, 9, 4)], [(0, 0, 9, 4), (0, 0, 9, 5), (0, 0, 2, 9)]):
        one = packets.mq_or_raw(spark.createDataFrame(data, tied).coalesce(1), ["block"], "at").first()
        assert (one["mq_bytes"], one["raw_bytes"]) == (9 + 4, 5)
