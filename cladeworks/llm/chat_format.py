"""Operator 6: chat formatting in budgeted windows, native.

The turns of a conversation, in order, get token counts and prefix sums. A window takes as
many new turns as the budget holds, behind the repeated system turn and a limited number of
repeated turns of history, so every turn is new in exactly one window. Windows are texts with control
strings around each turn; control strings inside texts are escaped so that they can't occur there,
and the loss mask covers assistant texts of new turns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<turn:bigint,role:string,text:string>"
OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"  # around the role, before the text, after the text
# A control string in a text is broken behind its first character; the mark itself is doubled.
MARK = "\\"
CONTROL = r"(<)(/?s>)|(\[)(/?INST\])"


def escaped(text: Column) -> Column:
    """The text without any control string; unescaped() gives it back."""
    doubled = F.replace(text, F.lit(MARK), F.lit(MARK * 2))
    return F.regexp_replace(doubled, CONTROL, r"$1$3\\$2$4")


def unescaped(text: Column) -> Column:
    """Inverse of escaped(): a single mark goes, a double one becomes single."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def n_tokens(text: Column) -> Column:
    """Estimated tokens of a turn: one for every four bytes begun, and four for its marks."""
    return F.ceil(F.octet_length(text) / 4) + 4


def with_turns(df: DataFrame) -> DataFrame:
    """One row per conversation: its turns by number (then role and text), null texts and roles empty."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


CHUNK = 256  # turns whose sums are folded at once


def running_sums(values: Column) -> Column:
    """Prefix sums of an array of whole numbers: in chunks, and over the chunks' totals, so the work grows with its length."""
    empty = F.expr("cast(array() as array<bigint>)")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def sums(part: Column, base: Column) -> Column:
        zero = F.struct(base.alias("at"), empty.alias("out"))
        return F.aggregate(part, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")), lambda s: s["out"])

    def bases(parts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))
        return F.aggregate(parts, zero, lambda s, c: F.struct((s["at"] + total(c)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    n = F.ceil(F.size(values) / CHUNK).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))
    return F.when(n > 0, F.transform(F.array(parts), lambda c: F.flatten(F.zip_with(c, bases(c), sums)))[0]).otherwise(empty)


def _starts(budget: int, history: int) -> Column:
    """1-based positions at which windows begin (start), and where their repeated turns do (back).

    A window opens when a turn doesn't fit any more. It repeats as many turns of history as fit with its first new one, and the
    system turn where that is not among them.
    """
    zero = F.struct(
        F.expr("cast(array() as array<struct<start:int,back:int>>)").alias("starts"), F.lit(0).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("room")
    )
    sums = F.col("sums")
    before = lambda i: F.when(i > 1, F.element_at(sums, F.greatest(i - 1, F.lit(1)))).otherwise(F.lit(0))
    system = lambda back: F.when(back > 1, F.col("n_system")).otherwise(F.lit(0))

    def step(state: Column, i: Column) -> Column:
        opens = (i == 1) | (F.element_at(sums, i) - state["base"] > state["room"])
        back = i
        for h in range(1, history + 1):
            far = F.greatest(F.lit(1), i - h)
            back = F.when(F.element_at(sums, i) - before(far) + system(far) <= budget, far).otherwise(back)
        here = F.struct(i.cast("int").alias("start"), back.cast("int").alias("back"))
        return F.struct(
            F.when(opens, F.concat(state["starts"], F.array(here))).otherwise(state["starts"]).alias("starts"),
            F.when(opens, before(back)).otherwise(state["base"]).cast("bigint").alias("base"),
            F.when(opens, budget - system(back)).otherwise(state["room"]).cast("bigint").alias("room"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.size("turns")), zero, step, lambda s: s["starts"])


def format_conversations(df: DataFrame, budget: int = 512, history: int = 2) -> DataFrame:
    """One row per conv_id with its windows: array of struct(formatted, n_repeated, loss).

    Input rows are turns (conv_id, turn, role, text); other columns are ignored. loss holds
    (start, length) in code points of formatted, for every new assistant turn. A window's
    tokens stay within the budget unless its first new turn alone, with the system turn, exceeds it: history that doesn't fit is
    left out, and a turn is never cut. A leading system turn is repeated in every later window. Turns with equal
    numbers go by role, then text; repeated rows are turns of their own; null conv_ids form one
    conversation. An empty table gives none.
    """
    marked = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MID)).alias("head"),
            escaped(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("target"),
            n_tokens(t["text"]).alias("n"),
        ),
    )
    sums = running_sums(F.transform("marked", lambda t: t["n"].cast("bigint")))
    system = F.element_at("turns", 1)["role"] == "system"
    laid = (
        with_turns(df)
        .withColumn("marked", marked)
        .withColumns({"sums": sums, "n_system": F.when(system, F.col("marked")[0]["n"]).otherwise(0), "has_system": system})
        .withColumn("starts", _starts(budget, history))
    )

    def window(at: Column, w: Column) -> Column:
        start, back = at["start"], at["back"]
        stop = F.coalesce(F.try_element_at("starts", w + 2)["start"], F.size("turns") + 1)
        kept = F.when(F.col("has_system") & (back > 1), F.slice("marked", 1, 1)).otherwise(F.slice("marked", 1, 0))
        repeated = F.concat(kept, F.slice("marked", back, start - back))
        new = F.slice("marked", start, stop - start)
        plain = lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))
        lead = F.array_join(F.transform(repeated, plain), "")
        zero = F.struct(
            F.length(lead).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("loss")
        )

        def mask(state: Column, t: Column) -> Column:
            at = state["at"] + F.length(t["head"])
            span = F.struct(at.cast("bigint").alias("start"), F.length(t["body"]).cast("bigint").alias("length"))
            return F.struct(
                (at + F.length(t["body"]) + len(CLOSE)).cast("bigint").alias("at"),
                F.when(t["target"], F.concat(state["loss"], F.array(span))).otherwise(state["loss"]).alias("loss"),
            )

        return F.struct(
            F.concat(lead, F.array_join(F.transform(new, plain), "")).alias("formatted"),
            F.size(repeated).alias("n_repeated"),
            F.aggregate(new, zero, mask, lambda s: s["loss"]).alias("loss"),
        )

    return laid.select("conv_id", F.transform("starts", window).alias("windows"))


def read_turns(windows: Column) -> Column:
    """Role and text of every turn, once and in order, read back from formatted windows."""
    parts = lambda w: F.slice(
        F.split(w["formatted"], CLOSE, -1), w["n_repeated"] + 1, F.size(F.split(w["formatted"], CLOSE, -1)) - 1 - w["n_repeated"]
    )
    fields = lambda p: F.split(p, r"\[/INST\]", -1)
    return F.transform(
        F.flatten(F.transform(windows, parts)),
        lambda p: F.struct(
            unescaped(F.substring(fields(p)[0], len(OPEN) + 1, 1 << 30)).alias("role"), unescaped(fields(p)[1]).alias("text")
        ),
    )


def read_targets(windows: Column) -> Column:
    """All text under the loss masks, unescaped, in order, nothing between."""
    under = lambda w: F.transform(
        w["loss"], lambda s: unescaped(F.substring(w["formatted"], (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    return F.array_join(F.flatten(F.transform(windows, under)), "")
