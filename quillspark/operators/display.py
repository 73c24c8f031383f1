"""What a hit shows: a window of its text around the first match, and marked-up matches."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import fold_ascii

HIGHLIGHT = T.StructType([
    T.StructField("html", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("byte_offset", T.LongType()), T.StructField("byte_length", T.LongType())]))),
])


def summary(content: Column, terms: Column, window: int = 160, leading: int = 40) -> Column:
    """struct(text, source_byte_offset, matched, truncated_before, truncated_after).

    At most ``window`` code points of ``content``, beginning ``leading`` before the earliest place where any of ``terms`` (an array) stands as a
    substring, ASCII case aside; from the start if none does.
    """
    folded = fold_ascii(content)
    places = F.filter(F.transform(terms, lambda t: F.instr(folded, fold_ascii(t))), lambda p: p > 0)
    first = F.coalesce(F.array_min(places), F.lit(0))
    n = F.char_length(content)
    size = F.least(n, F.lit(window))
    start = F.when(first > 0, F.least(F.greatest(first - 1 - leading, F.lit(0)), n - size)).otherwise(F.lit(0))
    return F.struct(
        F.substring(content, start + 1, size).alias("text"), F.octet_length(F.substring(content, F.lit(1), start)).cast("long").alias("source_byte_offset"),
        (first > 0).alias("matched"), (start > 0).alias("truncated_before"), (start + size < n).alias("truncated_after"),
    )


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ENTITY = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"})


def mark(text: str, terms: Iterable[str]) -> tuple[str, list[tuple[int, int]]]:
    """Escaped markup of a text with its matches marked, and their spans in UTF-8 bytes.

    At every place the longest term that stands there counts; spans that overlap or touch are one.
    """
    folded = text.translate(_FOLD)
    wanted = {t.translate(_FOLD) for t in terms if t}
    ends: dict[int, int] = {}
    for t in wanted:
        at = folded.find(t)
        while at >= 0:
            ends[at] = max(ends.get(at, 0), at + len(t))
            at = folded.find(t, at + 1)
    spans: list[list[int]] = []
    for a in sorted(ends):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], ends[a])
        else:
            spans.append([a, ends[a]])
    out, last = [], 0
    for a, b in spans:
        out += [text[last:a].translate(_ENTITY), "<mark>", text[a:b].translate(_ENTITY), "</mark>"]
        last = b
    out.append(text[last:].translate(_ENTITY))
    size = lambda s: len(s.encode())
    return "".join(out), [(size(text[:a]), size(text[a:b])) for a, b in spans]


@F.pandas_udf(HIGHLIGHT)
def highlight(text: pd.Series, terms: pd.Series) -> pd.DataFrame:
    """struct(html, spans) for a text and an array of terms; see ``mark``."""
    rows = [mark(t or "", ts if ts is not None else ()) for t, ts in zip(text, terms, strict=True)]
    return pd.DataFrame({"html": [r[0] for r in rows], "spans": [[{"byte_offset": a, "byte_length": b} for a, b in r[1]] for r in rows]})
