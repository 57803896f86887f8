import random

import pytest

from rasterloom.llm.difference_cover import suffix_ranks


@pytest.mark.parametrize(("seed", "texts", "letters"), [(1, ["abracadabra" * 3], ""), (2, ["a" * 9, "ba" * 5, "a" * 4], ""), (3, [40, 21, 1], "ab")])
def test_ranks_equal_sorting(spark, seed, texts, letters):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(letters) for _ in range(t)) if isinstance(t, int) else t for t in texts]
    rows, suffixes = [], {}
    for n, t in enumerate(texts):
        for i, c in enumerate(t):
            rows.append((n * 10_000 + i, ord(c) - 96))
            suffixes[n * 10_000 + i] = t[i:]
    got = {r["pos"]: r["rank"] for r in suffix_ranks(spark.createDataFrame(rows, "pos long, c long"), need=81).collect()}
    order = sorted(suffixes.values())
    assert got == {p: order.index(s) for p, s in suffixes.items()}
