"""Token counts under a unigram model by trie-shared dynamic programming.

Texts are cut into pre-tokens (words with the mark of the space before them). A task puts the distinct pre-tokens of its
rows in a trie. Each trie node holds the best forward score of the prefix that it stands for and the number of tokens of
that best segmentation, computed once from the nodes above it however many pre-tokens share the prefix; the nodes where
pre-tokens end give their counts, which are summed over each whole text.

The score of a piece is that of its vocabulary file; a character without a piece costs its UTF-8 bytes, each as one token
of the byte fallback. Of equal scores the segmentation whose last piece is longest wins. The vocabulary is read once by
the driver and sent to the tasks: its size is fixed by the file. A trie that outgrows TRIE_NODES is begun anew after at
most STRETCH words, and a pre-token of more than LONG characters gets nodes for its first LONG only: what a task holds does
not grow with the length of a text or of a word, and the counts do not depend on either.

Null and empty texts, and texts of spaces only, have 0 tokens. Null ids and repeated rows get their rows. Empty tables
give an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.storage import text_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
TRIE_NODES = 1_000_000
#: Characters of a pre-token that get nodes of the trie; a longer one is counted on from there without any.
LONG = 2_048
#: Words of a text that are looked up between two looks at the size of the trie.
STRETCH = 20_000
#: Rows handled at once, so that a batch's distinct pre-tokens stay few.
ROWS = 500

_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = "doc_id long, n_pretokens long, n_tokens long, log_score double"


def load_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces and log probabilities. The file ranks pieces; rank r gets the probability 1 / (r + 1), normalised."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ids.sort(key=lambda i: (-sp.get_score(i), i))
    total = math.log(sum(1 / (r + 1) for r in range(len(ids))))
    return {sp.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ids)}


class Trie:
    """Nodes of pre-token prefixes: their best forward score and its token count."""

    def __init__(self, pieces: dict[str, float]):
        self.byte = min(pieces.values(), default=0.0) - 10.0
        #: Ends of pieces, to the score of the piece that they are, or None: what is no end of a piece stops a search.
        self.ends: dict[str, float | None] = {}
        for p in pieces:
            for k in range(len(p)):
                self.ends.setdefault(p[k:], None)
        self.ends.update(pieces)
        #: Characters of the longest piece.
        self.reach = min(LONG, max(map(len, pieces), default=1))
        self.clear()

    def clear(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.score: list[float] = [0.0]
        self.count: list[int] = [0]

    def insert(self, word: str) -> tuple[int, float]:
        """Tokens and score of a pre-token; only nodes that are new are computed."""
        if len(word) > LONG:
            return self._beyond(word)
        nexts, score, count, ends = self.next, self.score, self.count, self.ends
        node, path = 0, [0]
        for c in word:
            to = nexts[node].get(c)
            if to is None:
                break
            node = to
            path.append(node)
        for end in range(len(path), len(word) + 1):
            c = word[end - 1]
            p = ends.get(c)
            if p is None:
                size = len(c.encode("utf-8", "surrogatepass"))
                best, tokens = score[node] + size * self.byte, count[node] + size
            else:
                best, tokens = score[node] + p, count[node] + 1
            if c in ends:
                for start in range(end - 2, -1, -1):
                    p = ends.get(word[start:end], 1.0)
                    if p is None:
                        continue
                    if p > 0:  # no piece ends like this
                        break
                    at = path[start]
                    s = score[at] + p
                    if s >= best:
                        best, tokens = s, count[at] + 1
            to = len(score)
            nexts.append({})
            score.append(best)
            count.append(tokens)
            nexts[node][c] = to
            node = to
            path.append(node)
        return count[node], score[node]


    def _beyond(self, word: str) -> tuple[int, float]:
        """A long word: a prefix of LONG characters is shared, and after it only what pieces can reach back to is held."""
        reach, ends = self.reach, self.ends
        done = [self.insert(word[: LONG - k]) for k in range(reach, -1, -1)]  # what ends before each of the last places
        counts, scores = [c for c, _ in done], [s for _, s in done]
        for end in range(LONG + 1, len(word) + 1):
            c = word[end - 1]
            p = ends.get(c)
            if p is None:
                size = len(c.encode("utf-8", "surrogatepass"))
                best, tokens = scores[-1] + size * self.byte, counts[-1] + size
            else:
                best, tokens = scores[-1] + p, counts[-1] + 1
            if c in ends:
                for back in range(2, reach + 1):
                    p = ends.get(word[end - back : end], 1.0)
                    if p is None:
                        continue
                    if p > 0:
                        break
                    s = scores[-back] + p
                    if s >= best:
                        best, tokens = s, counts[-back] + 1
            scores.append(best)
            counts.append(tokens)
            if len(scores) > 4 * reach + 64:
                del scores[: -reach - 1], counts[: -reach - 1]
        return counts[-1], scores[-1]


class _Memo(dict):
    """Token counts by word, found on first use; scores beside them. Begins anew when the trie outgrows TRIE_NODES."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie, self.scores = trie, {}

    def __missing__(self, word: str) -> int:
        n, self.scores[word] = self.trie.insert(MARK + word)
        self[word] = n
        return n

    def trim(self) -> None:
        """Between stretches of words only, so that the words of one are all known when they are summed."""
        if len(self.trie.score) > TRIE_NODES:
            self.trie.clear()
            self.scores.clear()
            self.clear()


def pretokens(text: str) -> list[str]:
    return [MARK + w for w in _SPLIT.findall(text)]


def _stretches(text: str) -> Iterator[list[str]]:
    """The words of a text, at most STRETCH at a time."""
    if len(text) < 4 * STRETCH:
        yield _SPLIT.findall(text)
        return
    words = (m[0] for m in _SPLIT.finditer(text))
    while found := list(islice(words, STRETCH)):
        yield found


def _counter(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Memo(Trie(sent.value))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                words, tokens, scores = [], [], []
                for text in part.column(1).to_pylist():
                    n, total, sums = 0, 0, []
                    for found in _stretches(text or ""):
                        n += len(found)
                        total += sum(map(known.__getitem__, found))
                        sums.append(math.fsum(map(known.scores.__getitem__, found)))
                        known.trim()
                    words.append(n)
                    tokens.append(total)
                    scores.append(round(math.fsum(sums), 6))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())],
                    ["doc_id", "n_pretokens", "n_tokens", "log_score"],
                )

    return run


def count_tokens(docs: DataFrame, pieces: dict[str, float] | None = None, path: str = VOCABULARY) -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens, log_score."""
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path) if pieces is None else pieces)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counter(sent), SCHEMA)


def brute_force(word: str, pieces: dict[str, float]) -> float:
    """For tests: the best score of all segmentations of a pre-token."""
    byte = min(pieces.values()) - 10.0
    if not word:
        return 0.0
    options = [brute_force(word[1:], pieces) + (pieces[word[0]] if word[0] in pieces else len(word[0].encode()) * byte)]
    options += [pieces[word[:k]] + brute_force(word[k:], pieces) for k in range(2, len(word) + 1) if word[:k] in pieces]
    return max(options)
