"""Text columns: templates, whitespace, token counts, file-safe names."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from string import Formatter

import pandas as pd
from pyspark.sql import Column, functions as F

# Fixed value: one token is a run of letters and digits or any single other
# character, with the white space before it.
TOKEN_PATTERN = r"\s*(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}])"

# Fixed value: the characters that count as white space when a text is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

#: from an array of texts to the array of their token counts
TokenCounter = Callable[[Column], Column]
#: from a text and a number to the text's first tokens
TokenCutter = Callable[[Column, int], Column]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def render(template: str, **columns: Column | str | int) -> Column:
    """Fill ``{name}`` holes from columns, in one pass; a null value makes the text null.

    A filled-in value is never searched for holes again, so a text containing
    ``{lang_name}`` stays as it is.
    """
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            value = columns[name]
            parts.append(value.cast("string") if isinstance(value, Column) else F.lit(str(value)))
    return F.concat(*parts) if parts else F.lit("")


def filesafe(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "")


def token_count(text: Column, counter: TokenCounter | None = None) -> Column:
    """Number of tokens; ``counter`` puts another tokenizer in (see ``python_counter``)."""
    if counter is not None:
        return F.try_element_at(counter(F.array(text)), F.lit(1))
    return F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("long")


def token_counts(texts: Column, counter: TokenCounter | None = None) -> Column:
    """Token counts of an array of texts."""
    return counter(texts) if counter is not None else F.transform(texts, lambda text: token_count(text))


def python_counter(make_counter: Callable[[], Callable[[str], int]]) -> TokenCounter:
    """A counter around a Python tokenizer; ``make_counter`` runs once per task."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count_one = make_counter()

        def count_all(texts):
            return None if texts is None else [None if t is None else count_one(t) for t in texts]

        for batch in batches:
            yield batch.map(count_all)

    return F.pandas_udf(count, "array<bigint>")


def python_cutter(
    make_codec: Callable[[], tuple[Callable[[str], Sequence[int]], Callable[[Sequence[int]], str]]],
) -> TokenCutter:
    """A cutter around a Python tokenizer; ``make_codec`` runs once per task and gives (encode, decode).

    The ids of a text are cut and decoded again, so what comes out is the tokenizer's own spelling; a text that is short enough
    passes through it as well.  ``encode`` should add no special tokens.
    """

    def cutter(text: Column, n: int) -> Column:
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode, decode = make_codec()
            for batch in batches:
                yield batch.map(lambda own: None if own is None else decode(encode(own)[:n]))

        return F.pandas_udf(cut, "string")(text)

    return cutter


def truncate_tokens(text: Column, n: int, cutter: TokenCutter | None = None) -> Column:
    """The first ``n`` tokens of a text, as they are written in it; ``cutter`` puts another tokenizer in (see ``python_cutter``)."""
    if cutter is not None:
        return cutter(text, n)
    tokens = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.array_join(F.slice(tokens, 1, n), "")


def is_sound_text(text: Column) -> Column:
    """True for a non-null text that is valid UTF-8."""
    return text.isNotNull() & F.coalesce(F.is_valid_utf8(text), F.lit(False))


def within_tokens(text: Column, n: int, counter: TokenCounter | None = None) -> Column:
    return token_count(text, counter) <= n
