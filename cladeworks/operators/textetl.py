"""Text ETL: descriptions to blocks, exclusions, examples, cleaned descriptions, one table.

Inputs are tables with code and a text column; a description is split into blocks, whose ids
count the non-empty blocks of a code from 1 before headers are left out, so ids may have gaps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers, markers, keywords and rewrites of the source texts.
HEADER = "The Sector as a Whole"
CROSS_REFERENCE = "Cross-References."  # a pattern: the dot is any character
EXAMPLES_MARK = "Illustrative Examples:"
EXCLUDE_WORDS = ("Excluded", "excluded", "Exclude", "exclude")
CODE_MENTION = r" \d{2,6}"
NO_EXAMPLES = 999
COMBINED = {"31-33": "31", "44-45": "44", "48-49": "48"}
SUFFIXES = ("1", "2", "3", "4", "9")  # of the children that may stand in for a four-digit code, best first
EMPTY_TOKEN = "[EMPTY]"


def combined_code(code: Column) -> Column:
    """Combined sector codes under their first prefix."""
    out = code
    for wide, first in COMBINED.items():
        out = F.when(code == wide, first).otherwise(out)
    return out


def titles(df: DataFrame) -> DataFrame:
    """index from 0, level, code, title of rows with a 1-based index."""
    return df.select((F.col("index") - 1).alias("index"), F.length("code").alias("level"), "code", "title")


def blocks(df: DataFrame, separator: str = "\r\n") -> DataFrame:
    """(code, description_id, description): the blocks of every description without headers and cross-references."""
    parts = F.filter(F.split("description", separator.replace("\r", r"\r").replace("\n", r"\n"), -1), lambda x: F.length(x) > 0)
    out = df.select("code", F.posexplode(parts).alias("_at", "description"))
    return out.select("code", (F.col("_at") + 1).alias("description_id"), "description").where(
        (F.col("description") != HEADER) & ~F.col("description").rlike(CROSS_REFERENCE)
    )


def _unpadded(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^ ", ""), " $", "")


def cleaned(c: Column) -> Column:
    """The cleaning steps of a block, in order: a later step sees what an earlier one left."""
    c = F.replace(_unpadded(c), F.lit("NULL"), F.lit(""))
    c = F.regexp_replace(c, r"See industry description for \d{6}\.", "")
    c = F.regexp_replace(F.regexp_replace(c, "<.*?>", ""), " ", " ")
    for old, new in ((".", ". "), ("U. S. ", "U.S."), ("e. g. ,", "e.g.,"), ("i. e. ,", "i.e.,"), (";", "; "), *COMBINED.items()):
        c = F.replace(c, F.lit(old), F.lit(new))
    return _unpadded(F.regexp_replace(c, r"(?U)\s{2,}", " "))


def clean_blocks(raw: DataFrame) -> DataFrame:
    return raw.select(F.trim("code").alias("code"), "description_id", cleaned(F.col("description")).alias("description"))


def last_blocks(df: DataFrame) -> DataFrame:
    """Blocks that are the last one of their code."""
    last = F.max("description_id").over(Window.partitionBy("code"))
    return df.withColumn("_last", last).where("description_id = _last").drop("_last")


def mentioned_codes(text: Column) -> Column:
    """Codes of two to six digits behind a blank, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(CODE_MENTION), F.lit(0)), lambda x: F.regexp_replace(x, "^ ", ""))


def _joined(ordered: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(ordered), lambda x: x["text"]), separator)


def exclusions(cross: DataFrame, clean: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(level, code, excluded, excluded_codes) and the blocks (code, description_id) they were taken from.

    cross has (code, ord, excluded). Texts are joined once per code that they mention. Codes that are not in codes don't count.
    """
    given = (
        cross.where(F.col("excluded").rlike(CODE_MENTION)).groupBy("code")
        .agg(_joined(F.collect_list(F.struct("ord", F.col("excluded").alias("text"))), " ").alias("description"))
        .select("code", F.lit(1).alias("description_id"), "description", F.lit(0).alias("origin"))
    )
    keyword = F.lit(False)
    for word in EXCLUDE_WORDS:
        keyword = keyword | F.col("description").contains(word)
    found = last_blocks(clean).where(keyword & F.col("description").rlike(CODE_MENTION)).select("code", "description_id", "description", F.lit(1).alias("origin"))
    mentions = given.unionByName(found).select(
        "code", "origin", "description_id", "description", F.explode(F.array_distinct(mentioned_codes(F.col("description")))).alias("digit")
    )
    known = mentions.join(codes.select(F.col("code").alias("digit")), "digit", "left_semi")
    entry = F.struct("origin", "description_id", "digit", F.col("description").alias("text"))
    out = known.groupBy("code").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return out.select(
        F.length("code").alias("level"), "code", F.array_join(F.transform("e", lambda x: x["text"]), " ").alias("excluded"), F.transform("e", lambda x: x["digit"]).alias("excluded_codes")
    ), found.select("code", "description_id")


def examples(sheet: DataFrame, raw: DataFrame, clean: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code, examples) with the sheet's preferred over those behind the mark, and (code, first example block).

    sheet has (code, ord, examples).
    """
    listed = sheet.join(codes.select("code"), "code", "left_semi").groupBy("code").agg(_joined(F.collect_list(F.struct("ord", F.col("examples").alias("text"))), "; ").alias("e1"))
    mark = raw.where(F.col("description").rlike(EXAMPLES_MARK)).select("code", F.col("description_id").alias("mark"))
    behind = clean.join(mark, "code").where("mark < description_id").groupBy("code").agg(
        _joined(F.collect_list(F.struct("description_id", F.col("description").alias("text"))), "; ").alias("e2"), F.min("description_id").alias("description_id_min")
    )
    merged = listed.join(behind, "code", "full_outer").select("code", F.coalesce("e1", "e2").alias("examples"))
    return merged, behind.select("code", "description_id_min")


def first_replaced(c: Column, old: str, new: str) -> Column:
    """The first occurrence of a literal replaced."""
    return F.regexp_replace(c, rf"(?s)^(.*?)\Q{old}\E", f"$1{new}")


def filled(clean: DataFrame, excluded: DataFrame, example_starts: DataFrame, record: str | None = None) -> DataFrame:
    """(code, description): blocks joined, without exclusion and example blocks; empty ones filled from children.

    An empty five-digit code takes the text of its child with 0, an empty four-digit code that of its best child by
    SUFFIXES; codes that stay empty are left out. With record, a column of all three tables, records that share a code are
    texts of their own: each has its row, a child with 0 fills as often as there are such, and of equally good children the one of the least record counts.
    """
    own = [] if record is None else [record]
    kept = (
        clean.join(excluded, ["code", *own, "description_id"], "left_anti").join(example_starts, ["code", *own], "left")
        .where(F.col("description_id") < F.coalesce("description_id_min", F.lit(NO_EXAMPLES)))
        .groupBy("code", *own).agg(_joined(F.collect_list(F.struct("description_id", F.col("description").alias("text"))), " ").alias("description"))
        .select("code", "description", (F.lit(None) if record is None else F.col(record)).alias("record"))
    )
    whole, empty = kept.where("description <> ''"), kept.where("description = ''").select("code", "record")
    fives = (
        empty.where("length(code) = 5").select(F.concat("code", F.lit("0")).alias("child"), "record")
        .join(whole.select(F.col("code").alias("child"), "description"), "child")
        .select(F.substring("child", 1, 5).alias("code"), first_replaced(F.col("description"), "This industry", "This NAICS industry").alias("description"), "record")
    )
    known = whole.unionByName(fives)
    order = F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.concat("code", F.lit(s)).alias("child")) for i, s in enumerate(SUFFIXES)]))
    fours = (
        empty.where("length(code) = 4").select("code", F.col("record").alias("own"), order.alias("c")).select("code", "own", "c.nth", "c.child")
        .join(known.withColumnRenamed("code", "child"), "child")
        .groupBy("code", "own").agg(F.min_by("description", F.struct("nth", "record", "description")).alias("description"))
    )
    reworded = first_replaced(first_replaced(F.col("description"), "This industry", "This industry group"), "This NAICS industry", "This industry group")
    return known.select("code", "description").unionByName(fours.select("code", reworded.alias("description")))


def description_table(title_rows: DataFrame, descriptions: DataFrame, cross: DataFrame, sheet: DataFrame, separator: str = "\r\n") -> DataFrame:
    """The whole ETL: one row per titled and described code, with examples and exclusions, by index."""
    named = titles(title_rows)
    codes = named.select("code").distinct()
    raw = blocks(descriptions, separator)
    clean = clean_blocks(raw)
    excl, excl_blocks = exclusions(cross, clean, codes)
    exam, starts = examples(sheet, raw, clean, codes)
    texts = filled(clean, excl_blocks, starts)
    return named.join(texts, "code").join(excl.drop("level"), "code", "left").join(exam, "code", "left").select(
        "index", "level", "code", "title", "description", "examples", "excluded", "excluded_codes"
    ).orderBy("index")


def _windows_of(length: int) -> Callable[[Column], Column]:
    """Of an array that is not empty: its parts of that length, the last one shorter."""
    return lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / F.lit(length)).cast("int")), lambda w: F.slice(t, w * length + 1, length))


def channel_tokens(df: DataFrame, channels: dict[str, int]) -> DataFrame:
    """A row per window of a row's texts, from 0: each channel's tokens of that window, padded with '', and a mask.

    A channel's windows have its length and follow each other to the end of the text, so no token is lost; a channel
    that ends before the others is all padding. Empty texts become EMPTY_TOKEN.
    """
    split = {}
    for name, length in channels.items():
        text = F.when(F.coalesce(F.length(name), F.lit(0)) == 0, EMPTY_TOKEN).otherwise(F.col(name))
        split[name] = F.transform(F.array(F.split(text, r"\s+")), _windows_of(length))[0]  # bound in a lambda, so each text is split once
    zipped = F.arrays_zip(*[split[name].alias(name) for name in channels])
    rows = df.select(*[F.col(c) for c in df.columns], F.posexplode(zipped).alias("window", "_w"))
    out = {}
    for at, (name, length) in enumerate(channels.items()):
        tokens = F.coalesce(F.col("_w").getField(rows.schema["_w"].dataType.names[at]), F.array().cast("array<string>"))
        pad = F.lit(length) - F.size(tokens)
        out[f"{name}_tokens"] = F.concat(tokens, F.array_repeat(F.lit(""), pad))
        out[f"{name}_mask"] = F.concat(F.transform(tokens, lambda x: F.lit(1)), F.array_repeat(F.lit(0), pad))
    return rows.withColumns(out).drop("_w")


def channel_counts(df: DataFrame, channels: list[str]) -> DataFrame:
    """How many texts of each channel are not empty."""
    return df.agg(*[F.count_if(F.length(c) > 0).alias(c) for c in channels])


def html_stripped(c: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, white space folded."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))
