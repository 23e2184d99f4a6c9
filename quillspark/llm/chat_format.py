"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is written turn by turn in a template; a deterministic parser reads the text back; turns that do not
come back as they went in hold text the grammar would take for its own, so they are written again with their control
strings escaped. The whole conversation is then parsed and compared too, and its row says whether it is identical.

The grammar, with one turn after another and nothing between them:

    user       <s>[INST] text [/INST]
    assistant  text </s>                      (with one space before the text)
    any other  <s>[ROLE=name] text [/ROLE]    (the name percent-encoded)

A control string in a text is escaped by a backslash after its first character; one that already has backslashes
there gets one more, so that unescaping is exact. No other text is changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Anything that is a control string, or would be one without backslashes after its first character.
CONTROL = r"([<\[])(\\*)(/?)(s>|INST\]|ROLE[=\]])"
ESCAPED = r"([<\[])\\(\\*)(/?)(s>|INST\]|ROLE[=\]])"
#: A turn ends after any of these; inside texts they are escaped.
TURN_END = r"(?<=\[/INST\]|</s>|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3$4")


def render_turn(role: Column, text: Column) -> Column:
    """One turn in the template; ``text`` is written as it is."""
    return (
        F.when(role == "user", F.concat(F.lit("<s>[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit(" "), text, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("<s>[ROLE="), F.url_encode(role), F.lit("] "), text, F.lit(" [/ROLE]")))
    )


def text_start(role: Column) -> Column:
    """Code points of a rendered turn before its text."""
    return F.when(role == "user", 10).when(role == "assistant", 1).otherwise(F.char_length(F.url_encode(role)) + 11)


def parse_turn(turn: Column) -> Column:
    """Role and unescaped text of one rendered turn."""
    size = F.char_length(turn)
    name = F.regexp_extract(turn, r"^<s>\[ROLE=([^\]]*)\] ", 1)
    is_user = turn.startswith("<s>[INST] ") & turn.endswith(" [/INST]")
    is_other = turn.startswith("<s>[ROLE=") & turn.endswith(" [/ROLE]")
    role = F.when(is_user, "user").when(is_other, F.url_decode(name)).otherwise("assistant")
    inner = (
        F.when(is_user, F.substring(turn, F.lit(11), size - 18))
        .when(is_other, F.substring(turn, F.char_length(name) + 12, size - F.char_length(name) - 19))
        .otherwise(F.substring(turn, F.lit(2), size - 6))
    )
    return F.struct(role.alias("role"), unescape(inner).alias("text"))


def split_turns(formatted: Column) -> Column:
    """The rendered turns of a conversation."""
    return F.filter(F.split(formatted, TURN_END), lambda t: t != "")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    return F.transform(split_turns(formatted), parse_turn)


def with_extra(conversations: DataFrame, conv_id: int, turns: list[tuple[str, str]]) -> DataFrame:
    """``conversations`` and one more of the given turns."""
    rows = [(conv_id, k, role, text) for k, (role, text) in enumerate(turns)]
    extra = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted text, the loss mask as code-point spans [start, end) of the assistant texts in it, the turns
    read back from it, and identical: whether they are the turns that went in.

    Turns stand in the order of their number; equal numbers by role, then text; null numbers first. A null role is an
    empty name, a null text an empty text. Rows with a null conv_id make one conversation; repeated rows are turns of
    their own. An empty table gives no rows; further columns are ignored. Turns are rendered and checked as rows, before
    anything is gathered, so only a conversation's finished text is ever held at once. No conversation stops the others.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    raw = render_turn(F.col("role"), F.col("text"))
    read = F.col("read")
    first = rows.withColumn("raw", raw).withColumn("read", parse(F.col("raw")))
    same = (F.size("read") == 1) & (read[0]["role"] == F.col("role")) & (read[0]["text"] == F.col("text")) & ~F.col("raw").rlike(r"(?s)^.+" + TURN_END + ".")
    second = first.withColumn("body", F.when(F.coalesce(same, F.lit(False)), F.col("text")).otherwise(escape(F.col("text"))))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.coalesce(F.sum(F.char_length("turn_text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        second.withColumn("turn_text", render_turn(F.col("role"), F.col("body")))
        .withColumn("nth", F.row_number().over(order))
        .withColumn("at", before + text_start(F.col("role")))
        .select("conv_id", "nth", "role", "text", "turn_text", "at", F.char_length("body").alias("size"))
    )
    turn = F.struct("nth", "role", "text", "turn_text", "at", "size")
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = gathered.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["at"].alias("start"), (t["at"] + t["size"]).alias("end"))).alias("loss_spans"),
    ).withColumn("turns", parse(F.col("formatted")))
    return whole.select("conv_id", "formatted", "loss_spans", "turns", (F.col("turns") == F.col("source")).alias("identical"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when read back: turns, and the text under the loss mask, cut out at its spans."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    cut = lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(cut(s))), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
