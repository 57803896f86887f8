"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text. A document is parsed greedily against it
into longest matches (a phrase ends where no longer match exists); the number of phrases, times the logarithm of the
sample's length and divided by the document's length, estimates the cross entropy, and the language with the fewest
normalised phrases wins. Whole texts are parsed.

The automata of all languages share one transition table of numpy integers. A lookup gives the next state and, in its
lowest bit, whether a phrase ended, so that many documents and all languages advance one character at a time together.

The sample: labelled rows in order of a hash of their text, until SAMPLE_CHARS characters a language are taken. Of a row
of more than SAMPLE_ROW_CHARS characters an excerpt of its words is taken, at a place that the hash chooses. The bound is
a parameter. The characters of all distinct texts are counted, copies once, and a threshold on the hash from these counts
keeps what the driver gathers bounded; it is raised for a language that it gives too few characters.

A text that is null or has no letter is `und` with score 0. Ties go to the language first in code point order. With no
labelled rows at all every text is `und`. Null labels and rows without a letter are not learned. Repeated rows get equal rows. Empty tables give an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.storage import text_batches
from rasterloom.llm.words import buffers, chunks

SAMPLE_CHARS = 20_000
#: Characters of a row that the sample takes at most.
SAMPLE_ROW_CHARS = 4_000
#: How many times the sample's characters are drawn, so that one draw nearly always has enough.
DRAW = 3
#: Characters besides the gap that the automata tell apart; rarer ones share the last class.
ALPHABET = 126
#: Lanes below which plain Python is faster than numpy.
NARROW = 24

SCHEMA = "doc_id long, lang_pred string, score double"


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state of the suffix automaton; state 0 is the root."""
    link, length, go = [-1], [0], [{}]
    last = 0
    for c in symbols:
        now = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return go


class Model:
    """Built from (language, sample text) pairs; small enough to be sent to every task as these texts."""

    def __init__(self, samples: dict[str, str]):
        self.samples = samples
        self.table = None

    def __getstate__(self):
        return {"samples": self.samples, "table": None}

    def build(self) -> Model:
        if self.table is not None:
            return self
        self.langs = sorted(self.samples)
        seen: dict[str, int] = {}
        for text in self.samples.values():
            for c in text.lower():
                if c.isalpha():
                    seen[c] = seen.get(c, 0) + 1
        letters = sorted(sorted(seen), key=lambda c: -seen[c])[:ALPHABET]
        self.symbol = {c: i + 1 for i, c in enumerate(letters)}
        self.width = len(letters) + 2
        self.classes = np.zeros(0x10000, np.uint8)
        for code in range(0x10000):
            low = chr(code).lower()[:1]
            if low.isalpha():
                self.classes[code] = self.symbol.get(low, self.width - 1)
        self.classes[0xFFFF] = self.width - 1  # stands for any letter beyond
        tables, self.roots, self.scale, base = [], [], [], 0
        for lang in self.langs:
            symbols = self.symbols(*self.codes([self.samples[lang]]))[0].tolist()
            go = suffix_automaton(symbols)
            # Two more rows: after a character that the sample lacks, and before the first one.
            lost, start = (base + r * self.width for r in (len(go), len(go) + 1))
            t = np.full((len(go) + 2, self.width), -1, np.int32)
            for s, out in enumerate(go):
                for c, to in out.items():
                    t[s, c] = (base + to * self.width) << 1
            # A phrase ends where there is no transition; the next begins with this character, from the root.
            first = np.where(t[0] < 0, lost << 1, t[0])
            t = np.where(t < 0, first | 1, t)
            t[-1] = first
            tables.append(t.ravel())
            self.roots.append(start)
            self.scale.append(math.log2(max(2, len(symbols))))
            base += t.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(self.roots, np.int64)
        return self

    @staticmethod
    def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts, other letters beyond U+FFFF as U+FFFF and all else there as a space; row bounds."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        far = np.flatnonzero(codes >= 0xFFFF)
        codes[far] = [0xFFFF if chr(c).isalpha() else 0x20 for c in codes[far].tolist()]
        return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def symbols(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes with one gap for each run of other characters after a letter, and their row bounds."""
        cls = self.classes[codes]
        keep = cls > 0
        keep[1:] |= keep[:-1].copy()
        first = bounds[:-1][np.diff(bounds) > 0]
        keep[first] = cls[first] > 0
        return cls[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]

    def phrases(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Phrases of each sequence against each language."""
        k = len(self.langs)
        count = np.zeros((len(seqs), k), np.int64)
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        sizes = np.array([len(seqs[i]) for i in order])
        live = int(np.count_nonzero(sizes))
        if not live:
            return count
        steps = int(sizes[min(live, max(1, NARROW // k)) - 1])  # so long, there are lanes enough
        flat = np.concatenate([seqs[i] for i in order[:live]]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes[:live])[:-1]])
        state = np.repeat(self.roots[None, :], live, axis=0)
        got = np.zeros((live, k), np.int64)
        table, lanes = self.table, live
        for t in range(steps):
            while sizes[lanes - 1] <= t:
                lanes -= 1
            v = table.take(state[:lanes] + flat.take(starts[:lanes] + t)[:, None])
            got[:lanes] += v & 1
            np.right_shift(v, 1, out=v)
            state[:lanes] = v
        for lane in range(lanes):
            if sizes[lane] > steps:
                rest = flat[starts[lane] + steps : starts[lane] + sizes[lane]].tolist()
                for j in range(k):
                    s, n = int(state[lane, j]), 0
                    item = table.item
                    for c in rest:
                        v = item(s + c)
                        n += v & 1
                        s = v >> 1
                    got[lane, j] += n
        got += 1  # the last phrase
        count[np.array(order[:live])] = got
        return count

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        cls, bounds = self.symbols(*self.codes(texts))
        seqs = [cls[bounds[i] : bounds[i + 1]] for i in range(len(texts))]  # each begins with a letter
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        counts = self.phrases(seqs) * np.array(self.scale)
        norm = counts / np.maximum(1, np.array([len(s) for s in seqs]))[:, None]
        best = norm.argmin(axis=1)
        inverse = 1.0 / np.maximum(norm, 1e-9) ** 4
        share = inverse[np.arange(len(texts)), best] / inverse.sum(axis=1)
        known = np.diff(bounds) > 0
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, share, 0.0)


def _excerpt(text: str) -> Column:
    """Texts as they are; of long ones SAMPLE_ROW_CHARS characters, with one space for what is between words."""
    words = F.trim(F.regexp_replace(text, r"\P{L}+", " "))
    start = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.length(words) - SAMPLE_ROW_CHARS + 1)) + 1
    return F.when(F.length(text) <= SAMPLE_ROW_CHARS, F.col(text)).otherwise(F.substring(words, start.cast("int"), F.lit(SAMPLE_ROW_CHARS)))


def fit(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model:
    """labelled (lang, text) to a model. The driver gathers about DRAW * sample_chars characters a language."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"), F.least(F.length("text"), F.lit(SAMPLE_ROW_CHARS)).alias("n"))
    texts = rows.groupBy("lang", "h").agg(F.max("n").alias("n"))
    chars = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    spread = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    samples: dict[str, str] = {}
    shares = {lang: DRAW * sample_chars / n for lang, n in chars.items()}
    while shares:  # again, with a larger share, for languages whose draw fell short
        wanted = F.lit(False)
        for lang, share in sorted(shares.items()):
            wanted = wanted | ((F.col("lang") == lang) & (spread < min(1.0, share)))
        drawn = rows.where(wanted).select("lang", _excerpt("text").alias("text"), spread.alias("u")).distinct().collect()
        found = dict.fromkeys(shares, "")
        for lang, text, _ in sorted(drawn, key=lambda r: (r["lang"], r["u"], r["text"])):
            if len(found[lang]) < sample_chars:
                found[lang] += text + "\n"
        short = {lang for lang, share in shares.items() if share < 1 and len(found[lang]) < sample_chars}
        samples |= {lang: text for lang, text in found.items() if lang not in short}
        shares = {lang: 4 * shares[lang] for lang in short}
    return Model(samples)


def _predictor(sent, text_at: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = sent.value.build()
        for batch in batches:
            _, offs = buffers(batch.column(text_at))
            for i, j in chunks(offs, 1 << 21):
                rows = batch.slice(i, j - i)
                texts = ["" if t is None else t for t in rows.column(text_at).to_pylist()]
                langs, score = ready.predict(texts)
                kept = rows.columns if keep_text else rows.columns[1:]
                names = rows.schema.names if keep_text else rows.schema.names[1:]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"]
                )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the winner's share of inverse entropies, 0 to 1)."""
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(_predictor(sent, 0, False), SCHEMA)


def identify_with(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, without a join; the columns of docs keep their order."""
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predictor(sent, docs.columns.index("text"), True), schema)
