import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import (
    chat_format, decontaminate, exact_dedup, graph, language_id, mixing, ngram_join, quality, queries, suffix_dedup, token_counts,
)
from tests.llm.helpers import frame, odd_rows


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def as_sets(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert as_sets(got.select(columns).collect()) == as_sets(want.fetchall())


# 5: exact dedup


def test_perfect_hash_places_every_digest_once():
    for n in (1, 2, 3, 7, 100, 5000):
        digests = np.frombuffer(b"".join(hashlib.sha256(str((n, i)).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
        table = exact_dedup.PerfectHash(digests)
        assert sorted(table.slots.tolist()) == list(range(n))
        assert table.locate(digests).tolist() == list(range(n))
    assert exact_dedup.PerfectHash(digests[:0]).locate(digests).tolist() == [-1] * len(digests)


def test_exact_dedup_edge_cases(spark):
    rows = odd_rows()
    out = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(out) == len(rows)
    want, kept = Counter(), Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept[t, keep] = 1
        for i in ids:
            want[i, keep, len(ids)] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == want
    digest = {hashlib.sha256(t.encode()).digest(): t for t in groups}
    assert Counter((digest[bytes(r["digest"])], r["doc_id"]) for r in out if r["kept"]) == kept  # one row of each text
    assert exact_dedup.exact_dedup(frame(spark, rows).where("false")).count() == 0


def test_exact_dedup_against_history(spark):
    history, new = frame(spark, [(1, "a"), (9, "b"), (3, "a")]), frame(spark, [(2, "a"), (4, "c"), (5, "c"), (6, "b")])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(new, history).collect()}
    assert got == {2: (3, 3, False), 4: (5, 2, False), 5: (5, 2, True), 6: (9, 2, False)}


def test_repeated_rows_and_rows_without_ids_are_dropped(spark):
    rows = odd_rows() + [(7, "other"), (7, "other"), (6, "other"), (None, "word"), (None, None), (None, "alone"), (None, "alone"), (9, "x"), (9, "y")]
    docs = frame(spark, rows)
    got = exact_dedup.remove_repeats(docs.repartition(3))
    assert got.columns == docs.columns
    best = {}
    for i, t, *_ in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert Counter((t or "", -1 if i is None else i) for i, t, *_ in got.collect()) == Counter(best.items())
    unique = [(i, t) for i, t, *_ in rows[:4]]
    assert sorted(r["doc_id"] for r in exact_dedup.remove_repeats(frame(spark, unique)).collect()) == [2, 3, 4]


# 6: language ID


def test_parse_finds_the_fewest_phrases():
    model = language_id.Model({"a": "abracadabra banana", "b": "zzz yyy xxx"}).build()
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("abrcdnz ") for _ in range(rng.randint(0, 40)))
        seqs, bounds = model.symbols(*model.codes([text]))
        for k, lang in enumerate(model.langs):
            train = model.symbols(*model.codes([model.samples[lang]]))[0].tobytes()
            s, n, i = seqs.tobytes(), 0, 0
            while i < len(s):
                j = i + 1
                while j < len(s) and s[i : j + 1] in train:
                    j += 1
                n, i = n + 1, j
            assert model.phrases([seqs])[0, k] == n
    assert len(bounds) == 2


def test_wide_and_narrow_parsing_agree():
    rng = random.Random(6)
    model = language_id.Model({"a": "the cat sat on the mat " * 3, "b": "der hund und die katze " * 3}).build()
    seqs = [model.symbols(*model.codes(["".join(rng.choice("thecatdrun ") for _ in range(rng.randint(0, 200)))]))[0] for _ in range(100)]
    one = np.concatenate([model.phrases([s]) for s in seqs])
    assert (model.phrases(seqs) == one).all()


def test_language_accuracy_and_edge_cases(spark, sf_dir, corpus):
    out = queries.op6_language_id(spark, sf_dir).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    model = language_id.fit(corpus.select("lang", "text"))
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(frame(spark, odd_rows()), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got
    assert all(lang != "und" for i, lang in got if i not in (1, 2, 3))
    assert language_id.identify(frame(spark, odd_rows()).where("false"), model).count() == 0
    nothing = language_id.fit(corpus.select("lang", "text").where("false"))
    assert {r["lang_pred"] for r in language_id.identify(corpus.limit(5), nothing).collect()} == {"und"}
    both = language_id.identify_with(frame(spark, odd_rows()), model)
    assert both.columns[-2:] == ["lang_pred", "score"] and both.count() == len(odd_rows())


def test_languages_with_long_rows_only_are_learned(spark):
    rng = random.Random(16)
    words = {"de": "der hund und die katze schlafen heute nicht".split(), "fr": "le chat et les chiens dorment bien ici".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    books = [("de", text("de", 2_000)), ("fr", "1 2 " * 5_000 + text("fr", 900) + " 3 4" * 5_000), (None, text("fr", 2_000)), ("xx", "1 2 " * 2_000)]
    pages = [("de", text("de", 20)) for _ in range(20)]
    docs = frame(spark, [(i, text(lang, 30)) for i, lang in enumerate(["de", "fr"] * 5)])
    for labelled in (books, books[1:] + pages):
        model = language_id.fit(spark.createDataFrame(labelled, "lang string, text string"))
        assert set(model.samples) == {"de", "fr"}
        assert all(len(s) <= language_id.SAMPLE_CHARS + language_id.SAMPLE_ROW_CHARS + 1 for s in model.samples.values())
        got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
        assert got == {i: ["de", "fr"][i % 2] for i in range(10)}


def test_copies_do_not_thin_the_language_sample(spark):
    langs = ["de", "fr", "it"]
    texts = {lang: [f"{lang} wort " + " ".join(lang[k % 2] * (1 + (i * k) % 7) for k in range(1, 60)) + f" {i}" for i in range(n)] for lang, n in zip(langs, (400, 1, 3), strict=True)}
    rows = [(lang, t) for lang in langs for t in texts[lang]]
    once = spark.createDataFrame(rows, "lang string, text string")
    often = once.crossJoin(spark.range(3_000).select(F.lit(0).alias("_"))).where("lang <> 'de'").select("lang", "text").unionByName(
        once.crossJoin(spark.range(50).select(F.lit(0).alias("_"))).where("lang = 'de'").select("lang", "text")
    )
    model, same = language_id.fit(once), language_id.fit(often)
    assert model.samples == same.samples and set(model.samples) == set(langs)
    assert len(model.samples["de"]) >= language_id.SAMPLE_CHARS
    assert len(model.samples["it"]) == sum(len(t) + 1 for t in texts["it"])


# 9: decontamination


def test_decontamination_equals_brute_force(spark, sf_dir, corpus):
    rng = random.Random(9)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:10]
    bench += [(100, "tiny item"), (101, None), (102, " ... "), (103, "Tiny ITEM"), (104, "a b c d e f g h i j")]
    docs = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").limit(40).collect()]
    docs += [(1000, None), (1001, ""), (1002, "so tiny, item! tiny item"), (1003, "x a b c d e f g h i j a b c d e f g h"), (1004, "a b c d e f g")]
    for i in range(20):
        t = bench[rng.randrange(10)][1].split()
        docs.append((2000 + i, "intro " + " ".join(t[rng.randrange(4) : rng.randrange(5, 30)]) + " outro"))
    want = decontaminate.brute_force(dict(docs), dict(bench))
    items = spark.createDataFrame(bench, "item_id long, text string")
    for block in (decontaminate.BLOCK_WINDOWS, 150):
        old, decontaminate.BLOCK_WINDOWS = decontaminate.BLOCK_WINDOWS, block
        try:
            out = decontaminate.find_hits(frame(spark, docs), items).withColumn("digest", decontaminate.digest_items(F.col("items"))).collect()
        finally:
            decontaminate.BLOCK_WINDOWS = old
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["digest"]) for r in out} == want
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in out)
    again = [(None, docs[-1][1]), (None, docs[-2][1]), (1003, docs[-1][1]), (1003, docs[-1][1])]
    seen = []
    for block in (decontaminate.BLOCK_WINDOWS, 150):  # rows that share an id, or have none, stay apart
        old, decontaminate.BLOCK_WINDOWS = decontaminate.BLOCK_WINDOWS, block
        try:
            seen.append(as_sets(decontaminate.find_hits(frame(spark, odd_rows() + docs + again), items).collect()))
        finally:
            decontaminate.BLOCK_WINDOWS = old
    assert seen[0] == seen[1] and len(seen[0]) == len(odd_rows() + docs + again)
    none = decontaminate.find_hits(frame(spark, odd_rows()), items.where("false"))
    assert none.count() == len(odd_rows()) and none.where("n_hit > 0").count() == 0
    kept = decontaminate.remove_documents(frame(spark, docs), items)
    assert kept.columns == frame(spark, docs).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if v[2] < 2}


# 7: mixing


def test_mixing_edge_cases(spark):
    rows = [(i, "w " * (i % 9), "en", s) for i, s in enumerate(["a", "b", "c", None, "d"] * 40)] + [(900, None, "en", "a"), (901, "x", "en", "é"), (901, "x", "en", "é")]
    out = mixing.plan(frame(spark, rows)).collect()
    again = mixing.plan(frame(spark, rows).repartition(7)).collect()
    assert as_sets(out) == as_sets(again) and len(out) == len(rows)
    total, taken = sum(r["size"] for r in out), Counter()
    for r in out:
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    goal = {r["source"]: (r["target"], r["source_size"]) for r in out}
    assert abs(sum(t for t, _ in goal.values()) - total) < 1e-6
    assert all(t <= 3 * s + 1e-9 for t, s in goal.values())
    assert all(abs(taken[s] - t) <= 0.1 * t + 9 for s, (t, _) in goal.items())
    assert mixing.plan(frame(spark, rows).where("false")).count() == 0
    unique = frame(spark, rows).dropDuplicates(["doc_id"])
    sample = mixing.sample(unique)
    assert sample.columns == unique.columns
    assert sample.count() == sum(r["copies"] for r in mixing.plan(unique).collect())


# 2: chat formatting


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\n", "<", "|", "\\", "<\\|", "é", "a", ">", "assistant"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "od\\d\n<|"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(100, 0, "user", None), (101, None, None, "x"), (101, 1, "assistant", "first"), (101, 1, "assistant", "first"), (102, 0, "assistant", "y" * 200_000), (None, 0, "user", "n")]
    rng.shuffle(rows)
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(turns)
    out = out.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")))
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    got = out.collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in got} == want
    assert {r["conv_id"]: r["loss"] for r in got} == {c: [t for role, t in v if role == "assistant"] for c, v in want.items()}
    for r in got:
        merged = 1 + sum(a[0] != b[0] for a, b in zip(want[r["conv_id"]], want[r["conv_id"]][1:]))
        assert r["n_blocks"] == merged == r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>\n")
    assert chat_format.format_chats(turns.where("false")).count() == 0


def test_roles_of_control_characters_and_backslashes_come_back(spark):
    roles = ["a\0\0b", "\\", "\\n", "\n\\", "\\\n\\\\n", "<\\|", "<|im_end|>", "\0"]
    rows = [(i, 0, r, "t") for i, r in enumerate(roles)]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r[0]: r[1] for r in out.select("conv_id", chat_format.read_turns(F.col("formatted"))[0]["role"]).collect()}
    assert got == dict(enumerate(roles))


def test_a_conversation_of_very_many_turns(spark):
    """Work that grew with the square of the turns would take hours here."""
    n = 60_000
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    out = chat_format.format_chats(turns)
    loss = F.array_join(chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")), "")
    row = out.select(F.size(chat_format.read_turns(F.col("formatted"))).alias("n"), F.md5(loss).alias("loss"), "n_blocks").first()
    want = "".join(f"t{i}" for i in range(n) if i % 3)
    assert row["n"] == n and row["n_blocks"] == 2 * n // 3 and row["loss"] == hashlib.md5(want.encode()).hexdigest()


def test_chat_query_has_the_extra_conversation(spark, sf_dir):
    row = queries.op2_chat_format(spark, sf_dir).where("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text)
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# 3: n-gram Jaccard join


def brute_components(docs):
    sets = {}
    for i, t in docs.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(docs, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


def near_corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    docs, n = {}, 0
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 7, 9, 14, 20, 40, 90, 300]))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 2)] = [rng.choice(words) for _ in range(rng.randint(0, 2))]
            docs[n] = " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)
            n += 1
    docs |= {n: None, n + 1: "", n + 2: " \t", n + 3: "w1 w2 w3 w4", n + 4: "W1 w2\tw3 w4", n + 5: "w1 w2 w3 w4 w5"}
    return docs


@pytest.mark.parametrize("block", [ngram_join.BLOCK_NGRAMS, 60, 0])
def test_near_duplicates_equal_brute_force(spark, block, monkeypatch):
    if not block:  # many small blocks, asked by two sets at a time
        block = ngram_join.BLOCK_NGRAMS
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
        monkeypatch.setattr(ngram_join, "ASKING", 2)
    docs = near_corpus()
    old, ngram_join.BLOCK_NGRAMS = ngram_join.BLOCK_NGRAMS, block
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, docs.items())).collect()}
    finally:
        ngram_join.BLOCK_NGRAMS = old
    assert got == brute_components(docs)


def test_routing_keys_never_miss_a_link():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, len(a) // 5 + 1))
        add = int(rng.integers(0, max(1, (len(a) - drop) // 5)))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if ngram_join.linked(common, len(a), len(b)):
            assert len(np.intersect1d(ngram_join.routing_keys(a), ngram_join.routing_keys(b)))


def test_signature_tree_keeps_every_link():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(5, 80)), dtype=np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([s[rng.random(len(s)) > 0.06], rng.integers(0, 1 << 63, 1, dtype=np.uint64)])) for s in base for _ in range(6)]
    sets.sort(key=lambda s: (len(s), int(s[0])))
    tree = ngram_join.SignatureTree(sets)
    pairs = set(tree.pairs(lambda level, a, others: others))
    links = {(i, j) for i, j in combinations(range(len(sets)), 2) if ngram_join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert links <= {(min(p), max(p)) for p in pairs} and len(pairs) < len(sets) ** 2 / 4


def test_near_duplicates_edge_cases(spark):
    out = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, odd_rows())).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 5, 4), (5, 5, 4), (6, 1, 6)} <= out
    assert ngram_join.near_duplicates(frame(spark, odd_rows()).where("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7), (900, 3)]
    rng.shuffle(edges)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{500 + i: 500 for i in range(50)}, 900: 3, 3: 3}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1: quality


def test_isotonic_pools_violators():
    out = quality.isotonic(np.arange(5.0), np.array([1, 1, 2, 1, 1.0]), np.array([0.0, 0.5, 0.2, 0.9, 0.7]))
    assert np.allclose(out, [0, 0.3, 0.3, 0.8, 0.8])


def test_quality_equals_plain_arithmetic(spark):
    """Statistics, ridge and calibration of the whole operator, worked out again without its tables and partitions."""
    rng = random.Random(21)
    texts = {i: " ".join(rng.choice(["the", "a", "x", "buy!", "NOW", "9", "longerwordhere"][i % 2 * 3 :]) for _ in range(rng.randint(1, 80))) for i in range(400)}
    texts |= {1000: None, 1001: "", 1002: "one\none\n|"}
    labels = {i: i % 2 if rng.random() < 0.9 else 1 - i % 2 for i in range(400)}
    docs = frame(spark, list(texts.items()))
    stats = quality.document_statistics(docs)
    y = quality.clean_labels(spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(stats, quality.fit(stats, y)).collect()}

    def plain(text):
        b = (text or "").encode()
        words, lines = b.split(), [x for x in b.split(b"\n") if x]
        kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:?'\"", b"|", b"!", b"*#$%&@=+~^_\\/<>", b"()[]{}"]
        shares = [sum(c in k for c in b) for k in kinds]
        wide = sum(c > 127 for c in b)
        shares += [len(b) - sum(shares) - wide, wide]
        n, pairs = max(1, len(words)), list(zip(words, words[1:]))
        return [
            np.log1p(len(b)), np.log1p(len(words)), np.log1p(len(lines)), *[x / max(1, len(b)) for x in shares], sum(map(len, words)) / n, np.log1p(len(b) / max(1, len(lines))),
            sum(len(w) <= 3 for w in words) / n, sum(len(w) >= 12 for w in words) / n, len(set(words)) / n, max(Counter(words).values(), default=0) / n,
            len(set(lines)) / max(1, len(lines)), len(set(pairs)) / len(pairs) if pairs else 1.0,
        ]

    x = {i: np.array(plain(t)) for i, t in texts.items()}
    assert all(np.allclose(x[r["doc_id"]], r["x"]) for r in stats.collect())
    rows = sorted(labels)
    rest = [zlib.crc32(str(i).encode()) % 25 >= 20 for i in rows]
    table, target = np.array([x[i] for i in rows]), np.array([labels[i] for i in rows], float)
    fourier = quality.Fourier(table.mean(axis=0), np.maximum(table.std(axis=0), 1e-6))
    fitted, held = ~np.array(rest), np.array(rest)
    z = fourier(table[fitted])
    gram = z.T @ z
    beta = np.linalg.solve(gram + quality.RIDGE * max(1.0, gram[-1, -1]) / quality.FEATURES * np.eye(len(gram)), z.T @ target[fitted])
    ridge = lambda t: np.clip(fourier(t) @ beta, 0, 1)
    at = np.rint(ridge(table[held]) * quality.BINS)
    knots = np.array(sorted(set(at)))
    share = np.array([target[held][at == k].mean() for k in knots])
    weight = np.array([(at == k).sum() for k in knots], float)
    # Isotonic regression as the largest of least means.
    mean = lambda a, b: (share[a : b + 1] * weight[a : b + 1]).sum() / weight[a : b + 1].sum()
    steps = [max(min(mean(a, b) for b in range(k, len(knots))) for a in range(k + 1)) for k in range(len(knots))]
    every = np.array([x[i] for i in texts])
    want = 0.999 * np.interp(ridge(every), knots / quality.BINS, steps) + 0.001 * ridge(every)
    assert np.allclose([got[i] for i in texts], want, atol=2e-3)


def test_quality_held_out_and_edge_cases(spark, corpus):
    big = "/root/testdata/sf0.01"
    out = queries.op1_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)
    stats = quality.document_statistics(frame(spark, odd_rows()))
    labels = quality.clean_labels(spark.createDataFrame([(1, None), (None, 1), (4, 7)], "doc_id long, quality int"))
    flat = quality.score(stats, quality.fit(stats, labels)).collect()
    assert len(flat) == len(odd_rows()) and {r["score"] for r in flat} == {0.5}
    assert quality.score(stats.where("false"), quality.fit(stats, labels)).count() == 0


# 4: token counts


def test_trie_counts_equal_brute_force():
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "ba": -3.0, "▁a": -2.9, "aba": -4.0, "é": -5.0}
    trie = token_counts.Trie(pieces)
    rng = random.Random(4)
    for _ in range(500):
        word = token_counts.MARK + "".join(rng.choice("abéx") for _ in range(rng.randint(0, 9)))
        n, s = trie.insert(word)
        assert abs(s - token_counts.brute_force(word, pieces)) < 1e-9
        assert 1 <= n <= len(word.encode())
    assert trie.insert(token_counts.MARK + "x")[0] == 2


def test_long_words_are_counted_without_nodes(monkeypatch):
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "ba": -3.0, "▁a": -2.9, "aba": -4.0, "é": -5.0, "bbbbbbb": -6.0}
    rng = random.Random(14)
    words = [token_counts.MARK + "".join(rng.choice("abéx") for _ in range(n)) for n in (0, 5, 15, 16, 17, 40, 300, 1000)] + [token_counts.MARK + "b" * 200]
    want = [token_counts.Trie(pieces).insert(w) for w in words]
    monkeypatch.setattr(token_counts, "LONG", 16)
    trie = token_counts.Trie(pieces)
    got = [trie.insert(w) for w in words]
    assert [n for n, _ in got] == [n for n, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    assert len(trie.score) <= 1 + 17 * len(words)


def test_token_counts_equal_brute_force_over_documents(spark):
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "ba": -3.0, "▁a": -2.9, "aba": -4.0}

    def fewest(word):
        """Tokens of the best segmentation; of equal ones that whose last piece is longest."""
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(end):
                p, n = pieces.get(word[start:end]), 1
                if p is None and end - start == 1:
                    n = len(word[start:end].encode())
                    p = n * (min(pieces.values()) - 10.0)
                if p is not None:
                    options.append((best[start][0] + p, -start, best[start][1] + n))
            top = max(options)
            best.append((top[0], top[2]))
        return best[-1][1]

    rng = random.Random(41)
    rows = odd_rows() + [(100 + i, " ".join("".join(rng.choice("abx") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    got = sorted((tuple(r)[:3] for r in token_counts.count_tokens(frame(spark, rows), pieces).collect()), key=repr)
    split = lambda t: [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t or "").split(" ") if w]
    counts = {w: fewest(token_counts.MARK + w) for _, t, *_ in rows for w in set(split(t))}
    assert got == sorted(((i, len(split(t)), sum(counts[w] for w in split(t))) for i, t, *_ in rows), key=repr)


def test_token_counts_over_texts(spark, sf_dir):
    pieces = {"▁": -3.0, "o": -2.0, "ne": -2.5, "one": -1.0, "▁one": -0.5}
    out = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.count_tokens(frame(spark, [(1, None), (2, ""), (3, "one  one\tone"), (4, "ox")]), pieces).collect()}
    assert out == {1: (0, 0), 2: (0, 0), 3: (3, 3), 4: (1, 3)}
    old, token_counts.TRIE_NODES = token_counts.TRIE_NODES, 200
    try:
        small = as_sets(queries.op4_token_counts(spark, sf_dir).collect())
    finally:
        token_counts.TRIE_NODES = old
    assert small == as_sets(queries.op4_token_counts(spark, sf_dir).collect())
    assert token_counts.count_tokens(frame(spark, []), pieces).count() == 0


# 10: suffix-array dedup


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 60)))
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def repeat_corpus(seed=10):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(4)]
    docs = {}
    for i in range(40):
        parts = [text(rng.randint(0, 60))] + [rng.choice(passages)[rng.randint(0, 80) :] for _ in range(rng.randint(0, 2))] + [text(rng.randint(0, 40))]
        docs[i] = " ".join(parts)
    docs |= {40: None, 41: "", 42: "a" * 199, 43: "b" * 200, 44: "c" * 201, 45: "xy" * 300, 46: docs[0], 47: docs[1][5:], 48: "é" * 150, 49: "short", 50: "short"}
    return docs


@pytest.mark.parametrize(("group", "runs"), [(512, 4096), (2, 4096), (2, 1)])
def test_repeats_equal_brute_force(spark, monkeypatch, group, runs):
    docs = repeat_corpus()
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "RUNS", runs)
    out = suffix_dedup.remove_repeats(frame(spark, docs.items())).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out}
    assert got == suffix_dedup.brute_force(docs)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in out)


def test_ranges_of_a_long_text_in_pieces(monkeypatch):
    import pyarrow as pa

    text = repeat_corpus()[3] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text.encode()], pa.binary())], ["doc_id", "data"])
    monkeypatch.setattr(suffix_dedup, "STRETCH", 300)
    rows = next(suffix_dedup._names(iter([batch]))).column(3).to_pylist()[0]
    starts = sorted(p for r in rows for p in range(r["lo"], r["hi"] + 1))
    assert starts == list(range(len(text.encode()) - suffix_dedup.LENGTH + 1))


def test_repeats_edge_cases(spark):
    out = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(frame(spark, odd_rows())).collect()}
    assert out[8] == len("abc def ") * 30_000 and sum(out.values()) == out[8]
    assert suffix_dedup.remove_repeats(frame(spark, []).where("false")).count() == 0
