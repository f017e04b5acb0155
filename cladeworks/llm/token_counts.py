"""Operator 9: token counts.

Texts go to Python in Arrow batches and only lengths come back. Inside a batch every text is
split at boundaries that the byte-level pre-tokenizer always has (before a single blank or line
feed between two non-blank characters, and between an ASCII letter and a digit of a long piece), so pieces
can be encoded apart: equal pieces are encoded once, in groups of about equal bytes. A text without
any such boundary, such as pages of one script without blanks, is one piece and is encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cladeworks.llm.common import text_or_empty

GROUP_BYTES = 1 << 18  # bytes that go to the encoder at once
LONG_PIECE = 1 << 14  # characters from which a piece is also split between letters and digits
MEMO_PIECES = 400_000  # pieces whose lengths a task remembers before it starts anew
SAFE_BLANK = re.compile(r"(?<=\S)(?= \S)")
LETTER_DIGIT = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@lru_cache(maxsize=4)
def _encoder(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if os.path.isabs(name):
        path = name
    else:
        import public_tokenizers

        path = public_tokenizers.path(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda texts: [
        len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    ]


def _splits_bytes(name: str) -> bool:
    """Whether the safe boundaries above hold: only for the byte-level vocabulary files."""
    return os.path.basename(name).startswith("byte_bpe") and name.endswith(".json")


def pieces(text: str) -> list[str]:
    """Split a text at safe boundaries; the pieces concatenate to the text."""
    out: list[str] = []
    lines = text.split("\n")
    # a line feed is a token of its own only between two non-blank characters
    if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
        for i, line in enumerate(lines):
            if i:
                out.append("\n")
            words = line.split(" ")
            if all(w and not w[0].isspace() and not w[-1].isspace() for w in words):
                out.append(words[0])
                out.extend([" " + w for w in words[1:]])
            else:
                out.extend(SAFE_BLANK.split(line))
    else:
        out = SAFE_BLANK.split(text)
    if any(len(x) > LONG_PIECE for x in out):
        out = [y for x in out for y in (LETTER_DIGIT.split(x) if len(x) > LONG_PIECE else [x])]
    return out


def _learn(missing: set[str], memo: dict[str, int], encode) -> None:
    group: list[str] = []
    held = 0
    for piece in sorted(missing, key=len):
        group.append(piece)
        held += len(piece)
        if held >= GROUP_BYTES:
            memo.update(zip(group, encode(group)))
            group, held = [], 0
    if group:
        memo.update(zip(group, encode(group)))


def count_texts(texts: list[str], name: str, memo: dict[str, int]) -> list[int]:
    """Numbers of tokens of the texts; memo keeps the lengths of pieces seen before."""
    encode = _encoder(name)
    if not _splits_bytes(name):
        out: list[int] = []
        group: list[str] = []
        held = 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= GROUP_BYTES:
                out.extend(encode(group))
                group, held = [], 0
        return out + (encode(group) if group else [])
    out = []
    block: list[list[str]] = []
    held = 0
    for i, text in enumerate(texts):
        block.append(pieces(text) if text else [])
        held += len(text)
        if held >= 8 * GROUP_BYTES or i == len(texts) - 1:
            if len(memo) > MEMO_PIECES:
                memo.clear()
            missing = {x for got in block for x in got if x not in memo}
            _learn(missing, memo, encode)
            out.extend(sum(map(memo.__getitem__, got)) for got in block)
            block, held = [], 0
    return out


def token_length(tokenizer: str):
    """An Arrow column function: string -> number of tokens, null read as empty."""

    @arrow_udf("bigint")
    def length(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, int] = {}
        for batch in batches:
            yield pa.array(
                count_texts([x or "" for x in batch.to_pylist()], tokenizer, memo), pa.int64()
            )

    return length


def count_tokens(
    df: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512
) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit to every row.

    Null and empty texts count 0 bytes and 0 tokens. Repeated rows stay repeated. Input columns
    named like an output are replaced. An empty table gives an empty result.
    """
    body = text_or_empty(text)
    return df.withColumns(
        {"n_bytes": F.octet_length(body).cast("long"), "n_tokens": token_length(tokenizer)(body)}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
