"""Documents: type by content, and text by pages. Bytes are read inside tasks; everything after is columns."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import first_amount, in_thousands, looks_delimited, match_label, once, strip_markup
from ..operators.notices import MOST_BYTES, why_unreadable

# Leading bytes in hex and the type they tell.
MAGIC = [
    ("25504446", "application/pdf"), ("7B5C727466", "application/rtf"), ("504B0304", "application/zip"), ("D0CF11E0A1B11AE1", "application/x-ole"),
    ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"),
    ("424D", "image/bmp"), ("1F8B", "application/gzip"), ("377ABCAF271C", "application/x-7z"), ("52617221", "application/x-rar"), ("7F454C46", "application/x-elf"), ("4D5A", "application/x-exe"),
]
MOST_MEMBER = 96 << 20
# Bytes at either end of a file in which the names of an archive's members are looked for.
PROBE = 64 << 10
# What a broken file can raise; anything else is a fault of this module.
_BROKEN = (zipfile.BadZipFile, zlib.error, ET.ParseError, KeyError, ValueError, RuntimeError, NotImplementedError, EOFError, OSError, IndexError)


def sniff(content: Column, name: Column) -> Column:
    """Type of a file by its first bytes, then of a text by what it looks like; the name only parts zip and text types."""
    head = F.hex(F.substring(content, 1, 16))
    low = F.lower(F.coalesce(name, F.lit("")))
    text = F.decode(F.substring(content, 1, 4096), "UTF-8")
    out = F.when(F.length(content) == 0, "application/x-empty")
    for magic, kind in MAGIC:
        if kind == "application/zip":
            ends = F.hex(F.concat(F.substring(content, 1, PROBE), F.substring(content, -PROBE, PROBE)))
            word = F.contains(ends, F.lit("word/document.xml".encode().hex().upper()))
            sheet = F.contains(ends, F.lit("xl/workbook.xml".encode().hex().upper()))
            inner = F.when(word, "application/docx").when(sheet, "application/xlsx").when(low.endswith(".docx"), "application/docx").when(low.endswith(".xlsx"), "application/xlsx").otherwise(kind)
            out = out.when(head.startswith(magic), inner)
        else:
            out = out.when(head.startswith(magic), kind)
    out = out.when(~F.is_valid_utf8(F.substring(content, 1, 4096).cast("string")), "application/octet-stream")
    trimmed = F.ltrim(text)
    return (
        out.when(trimmed.startswith("<?xml"), "text/xml").when(F.lower(trimmed).rlike("^<(!doctype html|html)"), "text/html").when(trimmed.rlike(r"^[{\[]"), "application/json")
        .when(trimmed.startswith("#FLAGGA") | trimmed.startswith("#SIETYP"), "text/sie").when(low.endswith(".csv"), "text/csv").when(looks_delimited(text), "text/csv").otherwise("text/plain")
    )


def _member(archive: zipfile.ZipFile, name: str) -> bytes:
    """A member's bytes; one that inflates to more than MOST_MEMBER is an error, as half a member has no meaning."""
    with archive.open(name) as f:
        content = f.read(MOST_MEMBER + 1)
    if len(content) > MOST_MEMBER:
        raise ValueError("member is too large")
    return content


def within(content: bytes, most: int) -> bytes:
    """At most the first ``most`` bytes, cut before a character that would be split."""
    if len(content) <= most:
        return content
    while most > 0 and content[most] & 0xC0 == 0x80:
        most -= 1
    return content[:most]


def _tags(xml: str) -> str:
    return re.sub(r"[ \t]*\n\s*", "\n", re.sub(r"<[^>]*>", " ", re.sub(r"</(w:p|w:tr)>", "\n", xml))).strip()


def docx_pages(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [_tags(_member(z, "word/document.xml").decode("utf-8", "replace"))]


def xlsx_pages(content: bytes) -> list[str]:
    """A page per sheet that has cells, in order of member names; cells of a row joined by three spaces."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.fromstring(_member(z, "xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if local(t) == "t"))
        pages = []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            lines = []
            for row in (e for e in ET.fromstring(_member(z, name)).iter() if local(e) == "row"):
                cells = []
                for c in row:
                    value = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                    if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                        value = shared[int(value)]
                    if value:
                        cells.append(value)
                if cells:
                    lines.append("   ".join(cells))
            if lines:
                pages.append("\n".join(lines))
        return pages


def rtf_text(rtf: str) -> str:
    """Text of RTF: control words go, paragraphs and tabs stay, hex escapes are cp1252."""
    rtf = re.sub(r"\{\\(fonttbl|colortbl|stylesheet|info|\*)[^{}]*(\{[^{}]*\}[^{}]*)*\}", "", rtf)
    rtf = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), rtf)
    rtf = re.sub(r"\\(par|line|row)\b ?", "\n", rtf)
    rtf = re.sub(r"\\(tab|cell)\b ?", "   ", rtf)
    rtf = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), rtf)
    # two halves of a pair become one character, a half alone the replacement character
    rtf = rtf.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    rtf = re.sub(r"\\[a-zA-Z]+-?\d* ?", "", rtf)
    return re.sub(r"\\([{}\\])", r"\1", re.sub(r"(?<!\\)[{}]", "", rtf)).strip()


def json_lines(text: str) -> str:
    """A line 'path words   value' per number or string leaf, depth first; text that isn't JSON, or too deep, comes back as it is."""
    try:
        tree = json.loads(text)
    except (ValueError, RecursionError):
        return text
    out: list[str] = []

    def go(x, path: list[str]) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                go(v, [*path, k.replace("_", " ")])
        elif isinstance(x, list):
            for v in x:
                go(v, path)
        elif isinstance(x, (int, float, str)) and not isinstance(x, bool):
            out.append(f"{' '.join(path)}   {x}")

    try:
        go(tree, [])
    except RecursionError:
        return text
    return "\n".join(out)


def _paged(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for path, kind, size, raw in zip(part["path"], part["mime"], part["size"], part["content"]):
                content = within(bytes(raw), most)
                try:
                    match kind:
                        case "application/docx":
                            pages = docx_pages(content)
                        case "application/xlsx":
                            pages = xlsx_pages(content)
                        case "application/zip":
                            with zipfile.ZipFile(io.BytesIO(content)) as z:
                                pages = ["\n".join(z.namelist()[:25])]
                        case "application/rtf":
                            pages = [rtf_text(content.decode("latin-1"))]
                        case "application/json":
                            pages = [json_lines(content.decode("utf-8", "replace"))]
                        case _ if kind.startswith("text/"):
                            pages = content.decode("utf-8", "replace").split("\f")
                        case _:
                            pages = []
                    status = "ok" if any(p.strip() for p in pages) else "no_text"
                except _BROKEN:
                    pages, status = [], "unreadable"
                cut = len(content) if size > len(content) else None
                rows += [(path, kind, status, n + 1, p, cut) for n, p in enumerate(pages)] or [(path, kind, status, 0, "", cut)]
            out = pd.DataFrame(rows, columns=["path", "mime", "status", "page", "text", "truncated_after"])
            yield out.astype({"truncated_after": "Int64"})

    return run


def read_documents(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """Files under ``path``: path, mime, status (ok, no_text, unreadable), page from 1, text, truncated_after (bytes read of a
    file with more than ``most``, else null), why (a type is not read, else null). A file without text has one row, page 0; a
    broken or encrypted one is unreadable and ends nothing. Spark passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # one byte more than is read tells that there is more, and whether a character is split
    typed = files.select("path", sniff(F.col("content"), F.col("path")).alias("mime"), F.col("length").alias("size"), F.substring("content", 1, most + 1).alias("content"))
    pages = typed.mapInPandas(_paged(most), "path string, mime string, status string, page int, text string, truncated_after bigint")
    html = F.col("mime").isin("text/html", "text/xml")
    return pages.withColumn("text", F.when(html, strip_markup(F.col("text"))).otherwise(F.col("text"))).withColumn("why", why_unreadable(F.col("mime")))


# How sure a line of text is, and one that was recognised in an image.
PARSED, RECOGNISED = 0.95, 0.45


def statement_facts(pages: DataFrame, confidence: float = PARSED, recognised: float = RECOGNISED) -> DataFrame:
    """``pages`` (company_id, doc, page, text) to facts: a labelled line's first amount, or that of the next line if it has no label.

    A fact is as sure as its page (``confidence``, or ``recognised`` where a column ``ocr`` of the pages is true) times the share of
    its document's pages that are not blank.

    Cost kinds are made positive; a document that says so anywhere counts in thousands; amounts that overflow are dropped.
    Lines of one page are one array, so nothing is shuffled but the scale of each document.
    """
    read = F.avg((F.coalesce(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))), F.lit(0)) > 0).cast("double"))
    scale = pages.groupBy("company_id", "doc").agg(F.max(in_thousands(F.col("text"))).alias("thousands"), read.alias("readable"))
    # readings of a company follow each other by document, page and line
    scale = scale.withColumn("doc_no", F.row_number().over(W.partitionBy("company_id").orderBy("doc")).cast("bigint") - 1)
    base = F.when(F.coalesce("ocr", F.lit(False)), recognised).otherwise(confidence) if "ocr" in pages.columns else F.lit(confidence)

    def labelled(lines: Column) -> Column:
        def fact(x: Column, i: Column) -> Column:
            after = F.coalesce(F.get(lines, i + 1), F.struct(F.lit("").alias("line"), F.lit(None).cast("string").alias("kind")))
            return once(first_amount(x["line"]), lambda own: F.struct(
                x["kind"].alias("kind"), i.alias("line_no"), F.coalesce(own, F.when(after["kind"].isNull(), first_amount(after["line"]))).alias("amount"),
                F.when(own.isNull(), F.concat_ws(" ", x["line"], after["line"])).otherwise(x["line"]).alias("source_text"),
            ))

        found = F.transform(lines, lambda x, i: F.when(x["kind"].isNotNull(), fact(x, i)))
        return F.filter(found, lambda f: f.isNotNull())

    # each line meets the labels once, and only those with a label are read for amounts
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), match_label(x).alias("kind")))
    rows = pages.select("company_id", "doc", "page", base.alias("base"), F.inline(once(lines, labelled)))
    rows = rows.join(scale, ["company_id", "doc"]).withColumn("value_ore", F.try_multiply("amount", F.when(F.col("thousands"), 100_000).otherwise(100).cast("bigint")))
    costs = F.col("kind").isin("personnel_costs", "external_costs", "depreciation", "interest_expense", "wages")
    return rows.where("value_ore is not null").select(
        "company_id", "kind", F.when(costs, F.abs("value_ore")).otherwise(F.col("value_ore")).alias("value_ore"), (F.col("base") * F.col("readable")).alias("confidence"),
        (F.col("doc_no") * 1_000_000_000_000 + F.col("page").cast("bigint") * 1_000_000 + F.col("line_no")).alias("seq"), "doc", "page", "source_text",
    )
