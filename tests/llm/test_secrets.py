import hashlib
import random
import re

from pyspark.sql import functions as F

from rasterloom.llm import queries, secrets

BASE = {
    "assign": (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}


def base_spans(text):
    out = []
    for i, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), i, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)


def shown(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


TEXTS = [
    None,
    "",
    "password=secret:abcdefghij token: 'abcdefgh' \x01 api_KEY = x",
    "é😀 SECRET=\"aaaaaaaaaa\" AKIAABCDEFGHIJKLMN AKIAAB " + "0f" * 20 + "z" + "ab" * 15,
    "token=token=abcdefgh passwd::abcdefgh apikey:  Zz/+_.=-9 AKIAAKIAAKIAAKIA",
    "x" * 5000 + " secret : abcdefg secret : abcdefgh " + "a1" * 40,
    "\x01\x02 key Zk3vQ9xT7LmB2wYp8RfD1sHc plain_identifier_with_long_name",
]


def test_base_spans_equal_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng, more = random.Random(7), []
    alphabet = ["token", "API_KEY", "=", ":", " ", '"', "abcdefgh", "AKIA", "0123456789abcdef", "Z", "é", "\n", ".", "\x01"]
    for _ in range(150):
        more.append("".join(rng.choice(alphabet) for _ in range(40)))
    rows = [(10**6 + i, t) for i, t in enumerate(TEXTS + more)]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    got = {r["doc_id"]: r["s"] for r in secrets.scan(docs).select("doc_id", secrets.spans_text(secrets.base_spans(F.col("spans"))).alias("s")).collect()}
    want = {r["doc_id"]: shown(base_spans(r["text"])) for r in docs.collect()}
    assert got == want


def test_random_strings_are_added_and_words_are_not(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ratios = secrets.train(spark, docs)
    rng = random.Random(3)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, "see " + "".join(rng.choice(b64) for _ in range(32)) + " end") for i in range(50)]
    rows += [(100 + i, t) for i, t in enumerate(["some_long_identifier_name_here", "thetioningeranthentioner" * 2, "/usr/local/share/documents/another"])]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), ratios)
    n = {r[0]: r[1] for r in found.select("doc_id", secrets.count_of(F.col("spans"), "markov")).collect()}
    assert sum(n[i] == 1 for i in range(50)) >= 48
    assert all(v == 0 for k, v in n.items() if k >= 100)
    plain = secrets.scan(docs, ratios).where(secrets.count_of(F.col("spans"), "markov") > 0).count()
    assert plain <= 0.02 * docs.count()


def test_query_and_empty_table(spark, sf_dir):
    out = queries.op8_secrets(spark, sf_dir)
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    row = out.where("n_assign = 0 AND n_access = 0 AND n_hex = 0").first()
    assert row["base_sha256"] == hashlib.sha256(b"").hexdigest()
    empty = spark.createDataFrame([], "doc_id long, text string, kind string, spans int")
    assert secrets.scan(empty).count() == 0


def test_models_on_held_out_strings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    seen = secrets.held_out(docs)
    assert seen["generated"][1] >= 0.98 * seen["generated"][0] and seen["identifier"][1] <= 0.02 * seen["identifier"][0]
    strings = secrets.labelled(docs).cache()
    texts = [r["text"] or "" for r in docs.collect()]
    named = {m[g] for t in texts for p, g, least in BASE.values() for m in re.finditer(p, t) if len(m[g]) >= least}
    assert {r["s"] for r in strings.where("label = 'found'").collect()} == named and named  # all texts fit into the sample
    copies = docs.where("text IS NOT NULL").limit(1).crossJoin(spark.range(3000)).select("doc_id", "text")
    assert secrets.labelled(copies).where("label = 'identifier'").count() > 0


def test_long_texts_are_sampled_too(spark):
    rows = [(i, "some_name other_name " * 3000 + f"n{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert secrets.labelled(docs).where("label = 'identifier'").count() > 1000


def test_added_spans_equal_plain_python(spark, sf_dir):
    """Runs of key characters beyond MARGIN nats a character that touch no base span, by a loop over the texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng = random.Random(11)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    words = ["identifier_with_words", "/usr/local/lib/something", "thequickbrownfoxjumpsover"]
    more = [" ".join(rng.choice(words) if rng.random() < 0.5 else "".join(rng.choice(chars) for _ in range(rng.randint(5, 60))) for _ in range(20)) for _ in range(40)]
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS + more)], "doc_id long, text string")).cache()
    ratios = secrets.train(spark, docs)

    def added(text):
        text = (text or "").replace("\x01", "\x02")
        base, out = base_spans(text), []
        for m in re.finditer(secrets.RUN, text):
            gain = sum(ratios[(ord(a) - 32) * 95 + ord(b) - 32] for a, b in zip(m[0], m[0][1:]))
            if gain > int(100 * secrets.MARGIN) * (len(m[0]) - 1) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                out.append((m.start(), 3, m.end(), "markov"))
        return shown(sorted(base + out))

    got = {r["doc_id"]: r["s"] for r in secrets.scan(docs, ratios).select("doc_id", secrets.spans_text(F.col("spans")).alias("s")).collect()}
    want = {r["doc_id"]: added(r["text"]) for r in docs.collect()}
    assert got == want and sum("markov" in v for v in want.values()) > 20
