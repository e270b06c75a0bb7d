"""Words of scanned pages to rows of label and amount."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "company_id long, doc string, page int, row int, label string, amount long"
_NUMBER = re.compile(r"[(\-−]?[0-9][0-9  .]*\)?-?")


def _rows(key: tuple, words: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    words = words.assign(mid=words["top"] + words["height"] / 2).sort_values(["mid", "left", "text"], kind="stable")
    rows: list[list] = []
    for w in words.itertuples():
        # a word joins a row by its distance from the row's first word
        if rows and abs(w.mid - rows[-1][0].mid) <= max(w.height, rows[-1][0].height) * tolerance:
            rows[-1].append(w)
        else:
            rows.append([w])
    out = []
    for n, row in enumerate(rows):
        parts = [w.text for w in sorted(row, key=lambda w: (w.left, w.text))]
        at = len(parts)
        while at and (_NUMBER.fullmatch(parts[at - 1]) or parts[at - 1] in "-−()"):
            at -= 1
        tail = "".join(parts[at:])
        digits = re.sub("[^0-9]", "", tail)
        amount = int(digits) if digits and len(digits) <= 18 else None
        if amount is not None and re.search(r"[-−(]", tail):
            amount = -amount
        out.append((*key, n, " ".join(parts[:at] if amount is not None else parts), amount))
    return pd.DataFrame(out, columns=["company_id", "doc", "page", "row", "label", "amount"]).astype({"amount": "Int64"})


def rows_from_words(words: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """``words`` (company_id, doc, page, text, left, top, height) to rows from top to bottom, each from left to right.

    Rows are anchored on their first word, so a page is worked on as one group (a page's words are bounded by its paper).
    Trailing numbers make the amount; a minus or parenthesis, alone or not, makes it negative.
    """
    return words.groupBy("company_id", "doc", "page").applyInPandas(lambda key, part: _rows(key, part, tolerance), ROW)


def fill_pages(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """OCR text (path, page, ocr_text) for images none of whose pages has text; says where it came from."""
    bare = pages.groupBy("path").agg(F.max(F.length(F.trim("text")) > 0).alias("has")).where(~F.col("has")).select("path")
    joined = pages.join(bare.withColumn("bare", F.lit(True)), "path", "left").join(ocr, ["path", "page"], "left")
    use = F.col("bare") & F.col("mime").startswith("image/") & F.col("ocr_text").isNotNull()
    return joined.select("path", "mime", "page", F.when(use, F.col("ocr_text")).otherwise(F.col("text")).alias("text"), F.coalesce(use, F.lit(False)).alias("from_ocr"))
