"""Chat formatting in Spark expressions: sorted turns, merged by role, with a loss mask.

``<|im_start|>role<|im_text|>text<|im_next|>text<|im_end|>\\n``: one block for each run of
turns of one role, the texts of its turns apart.  Control strings inside roles and texts
are escaped by a backslash behind their first character, one more if there are some, which
``unescaped`` takes away again, so every text reads back as it was.  ``loss`` holds the spans
of the assistant's texts as places (from 0) and lengths in bytes of UTF-8, so that a text is cut
out without counting its way through the conversation.

Places are running sums over the turns of a conversation, which is sorted and merged once; the
work grows with its length and not with turns times length.

Defined results: null text or role is empty; turns sort by turn (null last), role, text, so
ties and repeated rows have one order and all stay; rows without a conversation id are
conversations of their own, those alike in turn, role and text one together; an empty table
gives an empty result.  Only the four columns are read.  A conversation is one text, so its
turns meet in one row; nothing larger is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, TEXT, NEXT, END = "<|im_start|>", "<|im_text|>", "<|im_next|>", "<|im_end|>\n"
#: What follows the first character of a control string: <|...|>, <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
_REST = r"(\||/?s>|</?SYS>>|/?INST\])"
ESCAPE = rf"([<\[])(\\*){_REST}"
UNESCAPE = rf"([<\[])\\(\\*){_REST}"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def formatted(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, formatted, loss`` of every conversation."""
    said = F.coalesce(rows[role], F.lit("")), F.coalesce(rows[text], F.lit(""))
    own = F.when(rows[conv_id].isNull(), F.xxhash64(rows[turn], rows[role], rows[text]))
    turns = rows.select(rows[conv_id].alias("conv_id"), own.alias("own"), F.struct(rows[turn].isNull().alias("late"), rows[turn].alias("turn"), said[0].alias("role"), said[1].alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # Each turn as what stands before its text, the text, and what stands behind.
    last = F.size("turns") - 1

    def piece(t: Column, k: Column) -> Column:
        opens = (k == 0) | (F.get("turns", k - 1)["role"] != t["role"])
        closes = (k == last) | (F.get("turns", k + 1)["role"] != t["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(START), escaped(t["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT)).alias("before"),
            escaped(t["text"]).alias("text"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("behind"),
            (t["role"] == "assistant").alias("loss"),
        )

    pieces = grouped.select("conv_id", "own", F.posexplode(F.transform("turns", piece)).alias("k", "p")).select("conv_id", "own", "k", "p.*")
    # Turns of a conversation are together already, so this is a sort and no shuffle.
    earlier = Window.partitionBy("conv_id", "own").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    said = F.concat("before", "text", "behind")
    begin = F.coalesce(F.sum(F.octet_length(said).cast("long")).over(earlier), F.lit(0)) + F.octet_length("before")
    placed = pieces.select("conv_id", "own", F.struct("k", said.alias("said"), begin.alias("begin"), F.octet_length("text").cast("long").alias("size"), "loss").alias("p"))
    whole = placed.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list("p")).alias("p"))
    spans = F.transform(F.filter("p", lambda p: p["loss"]), lambda p: F.struct(p["begin"].alias("begin"), p["size"].alias("size")))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda p: p["said"]), "").alias("formatted"), spans.alias("loss"))


def _literal(mark: str) -> str:
    return "".join(f"\\{c}" if c in "|<>" else c for c in mark)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted``: the turns (role, text) and the text under the mask."""
    blocks = F.filter(F.split("formatted", _literal(END.strip()) + "\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(START) + 1, 2_147_483_647), _literal(TEXT), 2)
        role = unescaped(F.get(parts, F.lit(0)))
        texts = F.split(F.get(parts, F.lit(1)), _literal(NEXT), -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    def cut(data: Column) -> Column:
        return F.transform("loss", lambda s: unescaped(F.substring(data, s["begin"].cast("int") + 1, s["size"].cast("int")).cast("string")))

    # The bytes are formed once, and every span is read at its place.
    under = F.element_at(F.transform(F.array(F.col("formatted").cast("binary")), cut), 1)
    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(under, "").alias("loss_text"), "formatted")
