r"""Chat formatting with Spark expressions only.

A conversation's turns are gathered into one array, sorted, merged where a role
speaks again, and concatenated.  Each merged turn becomes::

    <s>[role]text<|>next text of the same role</s>

The control strings are ``<s>[``, ``]``, ``<|>`` and ``</s>``.  Inside roles and
texts the characters they are made of are written with a backslash and a
letter: ``\l`` for ``<``, ``\b`` for ``[``, ``\r`` for ``]`` in roles, and
``\e`` for the backslash.  So no text can contain a control string, and every
text is recovered exactly.

``formatted`` is the string; ``loss`` lists the (start, length), in code points,
of the assistants' escaped texts in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NAMED, JOIN, CLOSE = "<s>[", "]", "<|>", "</s>"
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
_PIECE = "struct<learn:boolean,s:string>"


def escape(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _piece(s: Column | str, learn: Column | bool = False) -> Column:
    return F.struct((learn if isinstance(learn, Column) else F.lit(learn)).alias("learn"), (s if isinstance(s, Column) else F.lit(s)).alias("s")).cast(_PIECE)


def let(value: Column, body) -> Column:
    """body of a value that is worked out once for a row.

    Spark copies a column's expression to wherever it is used, and within a
    lambda that is once for each element; a lambda's own argument is not copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(x: Column) -> Column:
    """The sums of what stands before each element, in two levels: appending to an array copies it, so no long one is built by steps."""

    def running(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, y: F.concat(acc, F.array(F.element_at(acc, -1) + y)))

    def sums(x: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
        blocks = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / w).cast("int")), lambda k: running(F.slice(x, k * w + 1, w))))
        return let(blocks, lambda bs: let(running(F.transform(bs, lambda b: F.element_at(b, -1))), lambda before: F.flatten(F.transform(bs, lambda b, k: F.transform(F.slice(b, 1, F.size(b) - 1), lambda y: y + F.get(before, k))))))

    return let(x, sums)


def merged(turns: Column) -> Column:
    """Sorted turns (turn, role, text) as an array of (role, texts), neighbours of one role together."""
    begins = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def runs(begins: Column) -> Column:
        ends = F.concat(F.slice(begins, 2, F.greatest(F.size(begins) - 1, F.lit(0))), F.array(F.size(turns)))
        return F.zip_with(begins, ends, lambda lo, hi: F.struct(F.get(turns, lo)["role"].alias("role"), F.transform(F.slice(turns, lo + 1, hi - lo), lambda t: t["text"]).alias("texts")))

    return let(begins, runs)


def _pieces(run: Column) -> Column:
    """The strings of a merged turn, with the flag of those to learn from."""
    role = F.replace(escape(run["role"]), F.lit("]"), F.lit("\\r"))
    texts = F.transform(run["texts"], lambda x: F.array(_piece(JOIN), _piece(escape(x), run["role"] == "assistant")))
    flat = F.flatten(texts)
    return F.concat(F.array(_piece(F.concat(F.lit(OPEN), role, F.lit(NAMED)))), F.slice(flat, 2, F.size(flat) - 1), F.array(_piece(CLOSE)))


def format_chats(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, formatted, loss) for each conversation of rows.

    Turns are in the order of ``turn``, nulls first, ties by role and then
    text; repeated rows are turns of their own.  A null text counts as empty, a
    null role as the empty role; all rows with a null key are one conversation.
    Other columns are ignored.  An empty table gives no rows.  One conversation
    is one row of the result, and no more than that is gathered.
    """
    t = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = rows.select(F.col(key).alias("key"), t.alias("t")).groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def written(flat: Column) -> Column:
        """The string and the spans to learn from, of a conversation's pieces."""
        lengths = F.transform(flat, lambda x: F.length(x["s"]).cast("long"))
        spans = let(prefix_sums(lengths), lambda at: F.filter(F.transform(flat, lambda x, i: F.struct(x["learn"].alias("learn"), F.get(at, i).alias("start"), F.length(x["s"]).cast("long").alias("length"))), lambda x: x["learn"]))
        loss = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
        return F.struct(F.concat_ws("", F.transform(flat, lambda x: x["s"])).alias("formatted"), loss.alias("loss"))

    whole = let(F.col("turns"), lambda turns: let(F.flatten(F.transform(merged(turns), _pieces)), written))
    out = chats.select("key", whole.alias("w"))
    return out.select(F.col("key").alias(key), F.col("w.formatted").alias("formatted"), F.col("w.loss").alias("loss"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, merged ones apart again."""
    whole = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turns(block: Column) -> Column:
        named = F.instr(block, NAMED)
        role = unescape(F.replace(F.substr(block, F.lit(len(OPEN) + 1), named - len(OPEN) - 1), F.lit("\\r"), F.lit("]")))
        body = F.substr(block, named + 1)
        return F.transform(F.split(body, r"<\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(whole, turns))


def learned(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped and without gaps."""
    return F.concat_ws("", F.transform(loss, lambda x: unescape(F.substr(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int")))))


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted strings."""

    def read(c: Column) -> Column:
        def told(turns: Column, text: Column) -> Column:
            said = F.concat_ws("", F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
            return F.struct(
                F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(text).cast("long").alias("loss_chars"),
                F.sha2(text, 256).alias("loss_sha256"), F.length(c["formatted"]).cast("long").alias("formatted_chars"),
            )

        return let(turns_of(c["formatted"]), lambda turns: let(learned(c["formatted"], c["loss"]), lambda text: told(turns, text)))

    chats = format_chats(rows).select("conv_id", let(F.struct("formatted", "loss"), read).alias("d"))
    return chats.select(F.col("conv_id").cast("long").alias("conv_id"), "d.*")
