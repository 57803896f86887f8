"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, merged into blocks of adjacent turns of one role by array
functions, and concatenated:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT...<|im_end|>\\n

Every control string begins with `<|`. Inside roles and texts, one backslash is put between a `<` and a `|` that follows
directly or after backslashes, so no text holds a control string, and taking one backslash out gives the text back. Line
breaks and backslashes of roles are escaped too. The loss mask is the list of code point ranges of the assistant's
escaped texts, without the separators between merged turns.

A null text counts as empty, a null role as the empty string, and null turns come first. Rows that repeat a turn number
are sorted by role and text, and all stay; so do rows that are wholly equal. Conversations with null ids form one
conversation. Very long texts are kept whole. An empty table gives an empty result. Other columns are not looked at. A
formatted conversation is one value, so all turns of one conversation meet in one task; the work on them grows with their
number times its root (sums of sizes are made by part), whatever their texts hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # Between pairs of backslashes, a single one can only be that of a line break.
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often a lambda function in it looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(items: Column) -> Column:
    """An array in parts of about the root of its length, so that work by part and item does not square."""
    step = F.ceil(F.sqrt(F.size(items))).cast("int")
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), step))
    return F.coalesce(F.transform(starts, lambda k: F.slice(items, k, step)), F.slice(F.array(items), 1, 0))


def _before(sizes: Column) -> Column:
    """For each number of an array the sum of those before it."""
    kind = "struct<sum:int,out:array<int>>"
    begin = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")).cast(kind)
    more = lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out")).cast(kind)
    each = F.transform(_parts(sizes), lambda part: F.aggregate(part, begin, more))

    def joined(parts: Column) -> Column:
        ahead = F.aggregate(parts, begin, lambda a, p: more(a, p["sum"]), lambda a: a["out"])
        return _let(ahead, lambda known: F.flatten(F.transform(parts, lambda p, k: F.transform(p["out"], lambda n: n + F.get(known, k)))))

    return _let(each, joined)


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns of one role."""
    last = F.size(turns) - 1
    opens = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def blocks(starts: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(starts, k + 1), F.size(turns))
        texts = lambda s, k: F.transform(F.slice(turns, s + 1, stop(k) - s), lambda t: t["text"])
        return F.transform(starts, lambda s, k: F.struct(F.get(turns, s)["role"].alias("role"), texts(s, k).alias("texts")))

    return _let(opens, blocks)


def _loss(blocks: Column, loss_role: str) -> Column:
    """Code point ranges (start, stop) of the loss role's texts in the formatted conversation."""
    parts = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    F.when(i == 0, F.length(b["role"]) + len(START) + 1).otherwise(F.lit(len(SEPARATOR))).alias("lead"),
                    F.length(t).alias("size"),
                    F.when(i == F.size(b["texts"]) - 1, F.lit(len(END))).otherwise(F.lit(0)).alias("trail"),
                    (b["role"] == escape_role(F.lit(loss_role))).alias("counts"),
                ),
            ),
        )
    )

    def placed(pieces: Column) -> Column:
        at = _before(F.transform(pieces, lambda p: p["lead"] + p["size"] + p["trail"]))
        span = lambda p, n: F.struct((n + p["lead"]).alias("start"), (n + p["lead"] + p["size"]).alias("stop"))
        both = F.zip_with(pieces, at, lambda p, n: F.when(p["counts"], span(p, n)))
        return F.filter(both, lambda s: s.isNotNull())

    return _let(parts, placed)


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted, loss_spans, n_blocks from (conv_id, turn, role, text)."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    ready = F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))

    def chat(blocks: Column) -> Column:
        body = F.transform(blocks, lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEPARATOR), F.lit(END)))
        return F.struct(F.array_join(body, "").alias("formatted"), _loss(blocks, loss_role).alias("loss_spans"), F.size(blocks).cast("long").alias("n_blocks"))

    return chats.select("conv_id", F.inline(F.array(_let(ready, lambda r: _let(_merged(r), chat)))))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before merging."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # nothing stands after the last end

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        texts = F.split(F.substring(block, F.length(head) + 2, F.length(block)), r"<\|im_sep\|>")
        role = unescape_role(F.substring(head, F.lit(len(START) + 1), F.length(head)))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask. Spans are in order; each part of them is cut out of the whole only once."""

    def cut(part: Column) -> Column:
        first, last = F.get(part, F.lit(0))["start"], F.get(part, F.size(part) - 1)["stop"]
        inside = lambda piece: F.transform(part, lambda s: unescape(F.substring(piece, s["start"] - first + 1, s["stop"] - s["start"])))
        return _let(F.substring(formatted, first + 1, last - first), inside)

    return F.flatten(F.transform(_parts(spans), cut))
