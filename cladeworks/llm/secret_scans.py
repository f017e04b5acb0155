"""Operator 8: secret scans, native.

Known formats are found by regular expressions; the offsets of all matches follow from the
lengths of the matches and of what lies between them, so no text is walked again for a match. Further
candidates are long strings of one character class, split into characters once, in which a window
slides by one character at a time: the character that enters and the one that leaves change two
counts, and with them the sum of n*log2(n) over the counts, which gives the window's Shannon entropy. Counts
are packed into a few longs, so a step costs the same wherever the window stands. Candidates that look like
harmless identifiers are on an allow-list.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.common import text_or_empty

SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"

# The formats of the contract. The second form of each finds the same strings
# but leaves out those that would be dropped for their length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)passw|secret|token|api_?key"
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

# Candidates of the entropy scan by character class: pattern, window, least entropy in bits.
CLASSES = (
    ("mixed", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.7),
    ("hex", r"[0-9A-Fa-f]{16,}", 16, 2.9),
)
# Candidates of these forms are no secrets: UUIDs, dates and times, words of letters only (between single separators), numbers, rulers.
# No form repeats a group: Java's matcher goes a call deeper for each repetition, so a long candidate would end the executor.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9TZ/_+-]*$",
    r"^(?!.*[_/=+-]{2})[A-Za-z][A-Za-z_/=+-]*(?<![_/=+-])$",
    r"^[0-9]+$",
    r"^[_=/+-]+$",
)


CHUNK = 256  # matches whose offsets are summed in one fold
LANES, BITS, FIRST = 12, 5, 32  # counts packed into a long, bits of each, code of the first character that has one
REGISTERS = 8  # longs: 96 characters, all of printable ASCII
UNIT = 1 << 40  # n*log2(n) is kept in whole parts of this, so sums don't drift


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as (start in code points, hit), by start.

    Offsets are summed in chunks and the chunks' ends once more, so the work grows with the number of matches, not its square.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,hit:string>>)").alias("out"))
    moved = lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("bigint")

    def chunk(pairs: Column, base: Column) -> Column:
        def step(state: Column, p: Column) -> Column:
            here = F.struct((base + state["at"] + F.length(p["gap"])).alias("start"), p["hit"].alias("hit"))
            return F.struct((state["at"] + moved(p)).alias("at"), F.concat(state["out"], F.array(here)).alias("out"))

        return F.aggregate(pairs, zero, step, lambda s: s["out"])

    def ends(chunks: Column) -> Column:
        none = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(
            chunks, none,
            lambda s, c: F.struct(F.aggregate(c, s["at"], lambda at, p: at + moved(p)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )

    def placed(pairs: Column) -> Column:
        n = F.ceil(F.size(pairs) / CHUNK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(pairs, k * CHUNK + 1, CHUNK))
        return F.when(n > 0, bound(parts, lambda c: F.flatten(F.zip_with(c, ends(c), chunk))))

    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: p["hit"].isNotNull())
    return F.coalesce(bound(pairs, placed), F.expr("cast(array() as array<struct<start:bigint,hit:string>>)"))


def span(start: Column, stop: Column, rank: int, kind: str) -> Column:
    return F.struct(start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.cast("bigint").alias("stop"))


def whole(hits: Column, rank: int, kind: str) -> Column:
    """Found hits as spans."""
    return F.transform(hits, lambda h: span(h["start"], h["start"] + F.length(h["hit"]), rank, kind))


def none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def base_spans(text: Column) -> Column:
    """The contract's three kinds, by start and then kind."""
    long_enough = lambda h: F.length(F.regexp_extract(h["hit"], ASSIGN, 1)) >= ASSIGN_LEAST
    assign = F.when(text.rlike(ASSIGN_HINT), whole(F.filter(found(text, ASSIGN), long_enough), 0, "assign")).otherwise(none())
    access = F.when(text.contains("AKIA"), whole(found(text, ACCESS), 1, "access")).otherwise(none())
    hexes = F.when(text.rlike(HEX), whole(found(text, HEX), 2, "hex")).otherwise(none())
    return F.array_sort(F.concat(assign, access, hexes))


def hot_part(token: Column, window: int, least: float) -> Column:
    """First and last character (0-based, end exclusive) of the windows whose entropy is high enough, or null.

    The token's characters are printable ASCII, as those of all classes are, and the window holds fewer than 32.
    """
    weights = [round(n * math.log2(n) * UNIT) if n else 0 for n in range(window + 2)]
    table = F.array(*[F.lit(x).cast("bigint") for x in weights])
    most = F.lit(round((math.log2(window) - least) * window * UNIT) + UNIT // 10**9).cast("bigint")
    zero = F.struct(
        F.array(*[F.lit(0).cast("bigint")] * REGISTERS).alias("n"), F.lit(0).cast("bigint").alias("sum"), F.lit(-1).alias("start"), F.lit(-1).alias("stop")
    )
    lane = lambda code: F.floor(code / LANES).cast("int")
    place = lambda code: code % LANES * BITS
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("bigint"), place(code))
    count = lambda n, code: (
        F.call_function("shiftright", F.element_at(n, lane(code) + 1), place(code)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    )
    weight = lambda n: F.element_at(table, n + 1)

    def slid(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            full = i > window
            enters, leaves = F.element_at(codes, i), F.element_at(codes, F.greatest(i - window, F.lit(1)))
            had = count(state["n"], enters)
            # the character that leaves has one more where it also entered
            has = count(state["n"], leaves) + F.when(enters == leaves, 1).otherwise(0)
            counts = F.transform(
                state["n"],
                lambda x, k: x + F.when(k == lane(enters), one(enters)).otherwise(0) - F.when(full & (k == lane(leaves)), one(leaves)).otherwise(0),
            )
            total = state["sum"] - weight(had) + weight(had + 1) + F.when(full, weight(has - 1) - weight(has)).otherwise(0)
            hot = (i >= window) & (total <= most)
            return F.struct(
                counts.alias("n"), total.alias("sum"),
                F.when(hot & (state["start"] < 0), i - window).otherwise(state["start"]).alias("start"),
                F.when(hot, i).otherwise(state["stop"]).alias("stop"),
            )

        return F.aggregate(
            F.sequence(F.lit(1), F.size(codes)), zero, step,
            lambda s: F.when(s["start"] >= 0, F.struct(s["start"].alias("start"), s["stop"].alias("stop"))),
        )

    return F.when(F.length(token) >= window, bound(F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST), slid))


def entropy_spans(text: Column, allow: Sequence[str] = ALLOW) -> Column:
    """Spans of kind entropy: the parts of candidate strings that windows of high entropy cover."""
    allowed = "|".join(f"(?:{x})" for x in allow) or "(?!)"
    out = []
    for i, (name, pattern, window, least) in enumerate(CLASSES):
        candidates = F.filter(found(text, pattern), lambda h: ~h["hit"].rlike(allowed))
        scored = F.transform(candidates, lambda h: F.struct(h["start"].alias("start"), hot_part(h["hit"], window, least).alias("part")))
        hot = F.transform(
            F.filter(scored, lambda x: x["part"].isNotNull()),
            lambda x: span(x["start"] + x["part"]["start"], x["start"] + x["part"]["stop"], 3 + i, f"entropy_{name}"),
        )
        out.append(F.when(text.rlike(pattern), hot).otherwise(none()))
    return F.concat(*out)


def find_secrets(df: DataFrame, text: str = "text", allow: Sequence[str] = ALLOW) -> DataFrame:
    """Add base and secrets, arrays of spans (start, rank, kind, stop), to every row.

    base holds the known formats; secrets holds those and the spans that the entropy scan adds,
    by start and kind. Offsets are code points, ends exclusive. Null and empty texts have none.
    Repeated rows stay repeated; input columns named like an output are replaced. The allow-list
    suppresses only what the entropy scan adds; its expressions run in Java's matcher on candidates of any length, so one's own must not
    repeat a group of several characters either.
    """
    with_base = df.withColumn("base", base_spans(text_or_empty(text)))
    return with_base.withColumn(
        "secrets", F.array_sort(F.concat("base", entropy_spans(text_or_empty(text), allow)))
    )


def joined(spans: Column) -> Column:
    """`kind:start:stop` of all spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
