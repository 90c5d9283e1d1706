"""Chat logs folded into conversations and rendered for training, in DataFrame functions only.

A log holds events of conversations: (conversation, seq, kind, message, role, text).

* `message` sets the text of a message, `delta` appends to it, `edit` replaces it, and
  `regenerate` throws it away, to be streamed anew. A regenerated message also
  supersedes the messages that were opened between it and the regeneration.
* Folding is associative, so a message is folded in blocks of `BLOCK` sequence numbers
  first and the blocks then: what stands before the last reset of a block is gone there.
  A conversation's messages are folded in many tasks and meet only as rendered turns.
  So texts are shuffled twice, by message and by conversation; what is superseded is found
  from numbers alone.
* A turn becomes its role's marks around the text. Control strings inside a text get
  one backslash after their first character, whatever backslashes are there already,
  which can be undone exactly. `loss` lists the stretches of the result that hold texts
  of the learned role, in code points.

Defined results: a NULL text or role is empty; a NULL kind, or one that is none of the
four, counts as `message`. Events are ordered by `seq`, NULL first, then resets before deltas,
then by text; messages by their first `seq`, then by message, role and rendered text. Events without a message id
are no part of a fold: each of them is a message by itself, repeated ones too. A NULL
conversation is a conversation. Extra columns are ignored, so their names cannot clash. An
empty log gives an empty table. A formatted conversation is one value, which Spark bounds at 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import fold_before, let, quoted

#: Sequence numbers of a block.
BLOCK = 1024
#: Code points of the parts that a text is cut in before stretches of it are read.
PART = 4096

#: The marks of a turn by role; any other role stands between marks of its own.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
#: The strings that no text may hold, without their first character, as a pattern.
_REST = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|role\|>|\|text\|>|\|end\|>"
ESCAPED = rf"([<\[])(\\*)({_REST})"
UNESCAPED = rf"([<\[])\\(\\*)({_REST})"
#: One turn of a formatted conversation.
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|<\|role\|>.*?<\|text\|>.*?<\|end\|>"

RESETS = {"message": 1, "edit": 2, "regenerate": 3}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPED, "$1$2$3")


def _folded(steps: Column) -> tuple[Column, Column]:
    """Whether a sorted array of (.., reset, text) holds a reset, and the text from the last one on."""
    behind = F.array_position(F.reverse(F.transform(steps, lambda s: s["reset"])), True)
    # Nothing before the last reset counts; without one, everything does.
    count = F.when(behind > 0, behind).otherwise(F.size(steps)).cast("int")
    text = F.array_join(F.transform(F.slice(steps, F.size(steps) - count + 1, count), lambda s: s["text"]), "")
    return behind > 0, text


def _first_role(steps: Column) -> Column:
    return F.get(F.filter(F.transform(steps, lambda s: s["role"]), lambda r: r.isNotNull()), F.lit(0))


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", message: str = "message", role: str = "role", text: str = "text") -> DataFrame:
    """The final messages of a log: (conv, place, message, role, text), superseded ones left out."""
    rank = F.coalesce(*[F.when(F.col(quoted(kind)) == k, n) for k, n in RESETS.items()], F.when(F.col(quoted(kind)) == "delta", 0), F.lit(1))
    log = events.select(
        F.col(quoted(conv)).alias("conv"),
        F.col(quoted(seq)).alias("seq"),
        rank.alias("rank"),
        F.col(quoted(message)).alias("message"),
        F.col(quoted(role)).alias("role"),
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"),
    )
    kept = ["conv", "place", "message", "role", "text"]
    single = log.where("message IS NULL").select("conv", F.col("seq").alias("place"), "message", "role", F.when(F.col("rank") == 3, "").otherwise(F.col("text")).alias("text"))
    step = F.struct("seq", (-F.col("rank")).alias("order"), F.when(F.col("rank") == 3, "").otherwise(F.col("text")).alias("text"), "role", (F.col("rank") > 0).alias("reset"))
    # Both levels of the fold need a message's events together, so they share one shuffle of the texts.
    parts = (
        log.where("message IS NOT NULL")
        .repartition("conv", "message")
        .groupBy("conv", "message", F.floor(F.col("seq") / BLOCK).alias("block"))
        .agg(F.array_sort(F.collect_list(step)).alias("steps"), F.min("seq").alias("place"))
    )
    reset, rest = _folded(F.col("steps"))
    parts = parts.select("conv", "message", "place", F.struct("block", rest.alias("text"), _first_role(F.col("steps")).alias("role"), reset.alias("reset")).alias("part"))
    whole = parts.groupBy("conv", "message").agg(F.array_sort(F.collect_list("part")).alias("steps"), F.min("place").alias("place"))
    _, rest = _folded(F.col("steps"))
    folded = whole.select("conv", "place", "message", _first_role(F.col("steps")).alias("role"), rest.alias("text"))
    gone, places = _superseded(log)
    folded = folded.join(gone, F.expr("conv <=> gone_conv AND message = gone_message"), "left_anti")
    single = single.join(places, F.expr("conv <=> gone_conv AND place = gone_place"), "left_anti")
    return folded.select(*kept).unionByName(single.select(*kept))


def _superseded(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that a regeneration of an earlier one supersedes, and places of events without a message that it does; no text is moved.

    The furthest regeneration of all earlier messages is taken over blocks of places (shelves)
    first and within a shelf then, so no task sees all messages of a conversation.
    """
    kind = log.schema["seq"].dataType
    opened = log.where("message IS NOT NULL").groupBy("conv", "message").agg(F.min("seq").alias("place"), F.max(F.when(F.col("rank") == 3, F.col("seq"))).alias("again"))
    single = log.where("message IS NULL").select("conv", "message", F.col("seq").alias("place"), F.lit(None).cast(kind).alias("again")).distinct()
    shelved = opened.unionByName(single).withColumn("shelf", F.floor(F.col("place") / BLOCK))
    shelves = shelved.groupBy("conv", "shelf").agg(F.max("again").alias("reach"))
    earlier = Window.partitionBy("conv").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)
    before = shelves.select(F.col("conv").alias("c"), F.col("shelf").alias("s"), F.max("reach").over(earlier).alias("before")).where("before IS NOT NULL")
    inside = Window.partitionBy("conv", "shelf").orderBy("place", "message").rowsBetween(Window.unboundedPreceding, -1)
    told = shelved.join(before, F.expr("conv <=> c AND shelf <=> s"), "left").withColumn("reach", F.greatest("before", F.max("again").over(inside)))
    gone = told.where("reach > place")
    named = gone.where("message IS NOT NULL").select(F.col("conv").alias("gone_conv"), F.col("message").alias("gone_message"))
    return named, gone.where("message IS NULL").select(F.col("conv").alias("gone_conv"), F.col("place").alias("gone_place"))


def _turn(role: Column, text: Column) -> Column:
    """A struct of a turn's opening marks, its escaped text and its closing marks."""
    role = F.coalesce(role, F.lit(""))
    opened = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    closed = F.lit(OTHER[2])
    for name, (before, after) in MARKS.items():
        opened, closed = F.when(role == name, before).otherwise(opened), F.when(role == name, after).otherwise(closed)
    return F.struct(opened.alias("open"), escape(text).alias("body"), closed.alias("close"))


def render(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv, formatted, loss): each conversation of `fold`'s messages as one text, and where texts of the learned role stand in it."""
    turns = messages.select("conv", "place", "message", "role", _turn(F.col("role"), F.col("text")).alias("turn"))
    learn = F.coalesce(F.col("role") == learned, F.lit(False))
    one = F.struct(
        "place",
        "message",
        "role",
        F.concat("turn.open", "turn.body", "turn.close").alias("turn"),
        F.length("turn.open").alias("skip"),
        F.length("turn.body").alias("size"),
        learn.alias("learn"),
    )
    whole = turns.groupBy("conv").agg(F.array_sort(F.collect_list(one)).alias("turns"))

    def spans(turns: Column) -> Column:
        at = fold_before(turns, lambda t: F.length(t["turn"]), lambda a, b: a + b)
        each = F.zip_with(turns, at, lambda t, a: F.when(t["learn"], F.struct((a + t["skip"]).cast("long").alias("start"), (a + t["skip"] + t["size"]).cast("long").alias("end"))))
        return F.filter(each, lambda s: s.isNotNull())

    return whole.select("conv", F.array_join(F.col("turns.turn"), "").alias("formatted"), spans(F.col("turns")).alias("loss"))


def format_chats(events: DataFrame, conv: str = "conv_id", learned: str = "assistant", **names: str) -> DataFrame:
    """(conv, formatted, loss) of every conversation of a log; `names` as in `fold`."""
    return render(fold(events, conv, **names), learned).withColumnRenamed("conv", conv)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""

    def between(raw: Column, start: int, end: int) -> Column:
        return F.substring(raw, F.lit(start + 1), F.length(raw) - (start + end))

    def read(raw: Column) -> Column:
        head, middle, tail = OTHER
        named = F.substring_index(F.substring(raw, F.lit(len(head) + 1), F.length(raw)), middle, 1)
        skip = len(head) + len(middle)
        text = F.substring(raw, F.length(named) + (skip + 1), F.length(raw) - F.length(named) - (skip + len(tail)))
        role = unescape(named)
        for name, (before, after) in MARKS.items():
            own = F.startswith(raw, F.lit(before))
            role, text = F.when(own, name).otherwise(role), F.when(own, between(raw, len(before), len(after))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), read)


def masked_texts(formatted: Column, loss: Column) -> Column:
    """The texts that the mask covers, unescaped, as an array.

    The conversation is cut in parts once, so a stretch costs its own length and that of a part, not the way to it.
    """

    def cut(parts: Column, span: Column) -> Column:
        first = F.floor(span["start"] / PART).cast("int")
        held = F.array_join(F.slice(parts, first + 1, F.floor(span["end"] / PART).cast("int") - first + 1), "")
        return unescape(F.substring(held, (span["start"] % PART + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    parts = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    return let(parts, lambda p: F.transform(loss, lambda s: cut(p, s)))


def streamed(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = 512) -> DataFrame:
    """The log that a table of finished turns would have left: each row opened by a message, its text in deltas of `chunk` code points.

    Rows are told apart by their place in the input, so repeated rows are messages of their own. A NULL turn comes first.
    """
    first = F.coalesce(F.col(quoted(turn)).cast("decimal(38,0)"), F.lit(-(2**63)).cast("decimal(38,0)"))
    rows = df.select(
        F.col(quoted(conv)).alias("conv_id"),
        F.monotonically_increasing_id().alias("message"),
        F.col(quoted(role)).alias("role"),
        (first * F.lit(1 << 22).cast("decimal(10,0)")).cast("decimal(38,0)").alias("first"),
        F.regexp_extract_all(F.coalesce(F.col(quoted(text)), F.lit("")), F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("chunks"),
    )
    opened = F.array(F.lit(None).cast("string"))
    pieces = rows.select("conv_id", "message", "role", "first", F.posexplode(F.concat(opened, F.col("chunks"))).alias("step", "text"))
    is_first = F.col("step") == 0
    return pieces.select(
        "conv_id",
        (F.col("first") + F.col("step")).cast("decimal(38,0)").alias("seq"),
        F.when(is_first, "message").otherwise("delta").alias("kind"),
        "message",
        F.when(is_first, F.col("role")).alias("role"),
        "text",
    )
