"""Quality rules on compression: texts that zstandard shrinks too well repeat themselves, texts that it hardly shrinks are noise.

A text is compressed whole and in fixed chunks; each ratio (compressed bytes over bytes) must lie in the band for its
length, as short texts shrink less. Before that a text must have enough words, and not too many of them in repeated runs.
Everything is worked out row by row next to the text, so nothing is shuffled and no text meets another.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
_INNER = bytes(range(0x80, 0xC0))  # bytes that begin no code point
RUN = 8


class Band(NamedTuple):
    """Ratios from ``least`` to ``most`` are those of prose, for texts of fewer than ``below`` bytes (None: any)."""

    below: int | None
    least: float
    most: float


# At level 3, invented prose and English manuals lie inside with room on both sides (from 0.83 to 0.57 and 0.42 to 0.31 with
# length); repeated sentences and forms lie below, base64 and random data above.
BANDS = (
    Band(256, 0.45, 1.00),
    Band(512, 0.40, 0.90),
    Band(1024, 0.36, 0.80),
    Band(2048, 0.34, 0.74),
    Band(4096, 0.32, 0.70),
    Band(8192, 0.30, 0.66),
    Band(16384, 0.29, 0.64),
    Band(None, 0.25, 0.64),
)


class Rules(NamedTuple):
    """Limits of the rules. ``chunk`` is in bytes; a share of chunks outside their bands above ``bad_chunks`` rejects."""

    min_words: int = 20
    max_repeated_percent: int = 30
    chunk: int = 4096
    bad_chunks: float = 0.25
    level: int = 3
    bands: tuple[Band, ...] = BANDS


FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double, "
    "least_chunk double, most_chunk double, n_chunks bigint, n_bad_chunks bigint, reason string"
)


def repeated_words(words: list[bytes], run: int = RUN) -> int:
    """Words that lie in a run of ``run`` words (a power of two) found twice or more, the first one included. Runs are named
    by doubling, numbers of pairs for numbers of words, so equal names are equal runs."""
    n = len(words)
    if n <= run:
        return 0
    seen: dict[bytes, int] = {}
    names = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    step = 1
    while step < run:
        names = np.unique(names[:-step] * np.int64(names.max() + 1) + names[step:], return_inverse=True)[1]
        step *= 2
    starts = np.flatnonzero(np.bincount(names)[names] >= 2)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + run] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


def band(bands: tuple[Band, ...], size: int) -> Band:
    return next(b for b in bands if b.below is None or size < b.below)


def cut(text: bytes, size: int) -> Iterator[bytes]:
    """Chunks of ``size`` bytes; what is left over goes to the last chunk if it is under half of one."""
    n = max(1, len(text) // size + (len(text) % size * 2 >= size))
    for k in range(n):
        yield text[k * size : (k + 1) * size if k < n - 1 else len(text)]


def measure(text: bytes | None, rules: Rules, shrink) -> tuple:
    """The values of FIELDS for one text, as bytes of UTF-8."""
    text = text or b""
    words = text.split()  # of bytes: cuts at exactly the six ASCII white spaces
    n, repeats = len(words), repeated_words(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    ratio, bad, chunks, reason = 0.0, 0, [], None
    if text:
        ratio = len(shrink(text)) / len(text)
        for part in cut(text, rules.chunk):
            r = ratio if len(part) == len(text) else len(shrink(part)) / len(part)
            b = band(rules.bands, len(part))
            bad += not b.least <= r <= b.most
            chunks.append(r)
    b = band(rules.bands, len(text))
    if n < rules.min_words:
        reason = "few_words"
    elif 100 * repeats > rules.max_repeated_percent * n:
        reason = "repeated_words"
    elif ratio < b.least:
        reason = "repetitive"
    elif ratio > b.most:
        reason = "incompressible"
    elif bad > rules.bad_chunks * len(chunks):
        reason = "uneven"
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (
        n, len(text.translate(None, SPACE + _INNER)), symbols, len(lines) - len(set(lines)), repeats, ratio,
        min(chunks, default=0.0), max(chunks, default=0.0), len(chunks), bad, reason,
    )


def measured(text: Column, rules: Rules = Rules()) -> Column:
    """A struct of FIELDS for a text. ``reason`` names the first rule that rejects it and is null for a text to keep.

    Null and empty texts have no words and the reason few_words. Whole texts are read, of any length: the work arrays of
    one text take about 60 bytes a word."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shrink = zstandard.ZstdCompressor(level=rules.level).compress
        for part in texts:
            yield pd.DataFrame.from_records([measure(t, rules, shrink) for t in part], columns=names)

    return measures(text.cast("binary"))


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs``: doc_id, FIELDS, base_failed (too few words, or too many repeated), kept.

    Only doc_id and text are read, so other columns can't clash. Rows with equal or no ids are judged one by one, equal
    texts alike. An empty table gives no rows."""
    out = docs.select("doc_id", measured(F.col("text"), rules).alias("m")).select("doc_id", "m.*")
    failed = F.col("reason").isin("few_words", "repeated_words")
    return out.withColumn("base_failed", F.coalesce(failed, F.lit(False))).withColumn("kept", F.col("reason").isNull())


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns as they are."""
    return docs.where(measured(docs["text"], rules)["reason"].isNull())
