import hashlib
import math
import re
from collections import defaultdict

import corpus_pipeline
from rasterloom.llm import decontaminate
from tests.llm.helpers import frame, odd_rows
from tests.llm.test_operators import brute_components


def brute_pipeline(docs, bench):
    """doc_id -> (source, size, source_size, copies) from plain Python."""
    docs = {i: (t, s) for i, t, s in docs if t is not None and any(c.isalpha() for c in t)}
    last = {}
    for i, (t, _) in docs.items():
        last[t] = max(i, last.get(t, i))
    docs = {i: docs[i] for i in sorted(last.values())}
    groups = brute_components({i: t for i, (t, _) in docs.items()})
    docs = {i: v for i, v in docs.items() if groups[i][1] == i}
    hits = decontaminate.brute_force({i: t for i, (t, _) in docs.items()}, bench)
    docs = {i: v for i, v in docs.items() if hits[i][2] < 2}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, (t, _) in docs.items()}
    by_source = defaultdict(list)
    for i, (_, s) in docs.items():
        by_source[s].append(i)
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in by_source[s]) for s in names}
    target, free, left = {}, set(names), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * total[s] + 1e-9}
        for s in over or free:
            target[s] = 3.0 * total[s] if over else weight[s] * level
        if not over:
            break
        free -= over
        left -= sum(target[s] for s in over)
    out = {}
    for s in names:
        key = "systematic:" + ("null" if s is None else "s" + s)
        offset = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32
        ratio = target[s] / total[s] if total[s] else 0.0
        for place, i in enumerate(sorted(by_source[s], key=lambda i: (size[i], i)), 1):
            copies = math.floor(offset + ratio * place) - math.floor(offset + ratio * (place - 1))
            if copies:
                out[i] = (s, size[i], total[s], copies)
    return out


def test_pipeline_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = {r["doc_id"]: (r["source"], r["size"], r["source_size"], r["copies"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    want = brute_pipeline([tuple(r) for r in rows], {r["item_id"]: r["text"] for r in bench})
    assert set(got) == set(want)
    assert got == want


def test_stages_keep_the_columns_of_their_input(spark, sf_dir):
    docs = frame(spark, odd_rows())
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert step(spark, docs.where("false"), sf_dir).count() == 0
    kept = {r["doc_id"] for r in corpus_pipeline.identify_languages(spark, docs, sf_dir).collect()}
    assert kept == {4, 5, 6, 7, 8, None}
    kept = [r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, sf_dir).collect()]
    assert len(kept) == 7 and set(kept) == {3, 2, 5, 6, 7, 8, None}


def test_near_copies_and_contaminated_rows_with_odd_ids(spark, sf_dir):
    """Repeated rows of one id share its fate, equal texts of other ids go, and a row without an id always stays."""
    words = [f"w{i}" for i in range(60)]
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(2).collect()]
    leak = " ".join(bench)
    rows = [(5, " ".join(words)), (5, " ".join(words)), (9, " ".join(words[:-1])), (4, "quite another text"), (None, " ".join(words)), (6, None), (7, "")]
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), sf_dir).collect()]
    assert sorted(kept, key=repr) == [4, 5, 5, 6, 7, None]
    rows = [(1, leak), (1, leak), (2, "clean text"), (None, leak), (3, None), (8, bench[0])]
    kept = [r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, frame(spark, rows), sf_dir).collect()]
    assert sorted(kept, key=repr) == [2, 3, 8, None]


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights",
    ]
