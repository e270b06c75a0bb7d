"""License scans: units of text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

# Short standard licence notices, by id.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "Released into the public domain under CC0 1.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
MOST_TEMPLATES = 10_000
# Bounds of what is held in expressions or broadcast; beyond them other ways give the same result.
MOST_KEYS = 200
MOST_LISTED = 20_000
MOST_PAIRS = 2_000_000


def normalised(text: Column) -> Column:
    """The text in lower case, with one space for every run of other characters than a-z and 0-9."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")


def words(text: Column) -> Column:
    """Words of the normalised text."""
    return F.filter(F.split(normalised(text), " "), lambda w: w != "")


def pairs(w: Column) -> Column:
    """Word bigrams in order, repeats included."""
    joined = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(w) > 1, joined).otherwise(F.array().cast("array<string>"))


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of the normalised text."""
    return F.transform(F.array(words(text)), lambda w: F.array_distinct(pairs(w)))[0]  # the lambda's variable holds the words, which are made once


def keys(templates: dict[str, str], least: float) -> list[str]:
    """Word pairs of which a text must hold one to match any template at all.

    A unit with a Dice coefficient of t holds at least b * t / (2 - t) of a template's b bigrams. So it holds one of any
    choice of the template's bigrams that leaves out fewer than so many; those with the longest words are chosen.
    """
    found = set()
    for text in templates.values():
        w = re.sub("[^a-z0-9]+", " ", text.lower()).strip(" ").split(" ")
        pairs = sorted({p for p in zip(w, w[1:])}, key=lambda p: (-max(map(len, p)), -len(p[0] + p[1]), p))
        found |= {" ".join(p) for p in pairs[: len(pairs) - math.ceil(len(pairs) * least / (2 - least) - 1e-9) + 1]}
    return sorted(found)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """Units that match a template with a Dice coefficient of ``least`` or more: doc_id, unit, license, dice.

    Units are a text's lines (numbered from 0) and, where it has several, the whole text (-1). A line also stands for the
    windows that begin in it, each as many words long as the template and over later lines too: at the line's first word
    and wherever a word and the next are a bigram of the template. So a notice is found where it begins, after other
    words of its line, wrapped over lines or with text after it; the best of a line's scores counts. A template of b
    bigrams can only match a unit of a bigrams if b * t / (2 - t) <= a <= b * (2 - t) / t; that prunes units and
    templates before any count. An inverted index of the templates' bigrams (at most MOST_TEMPLATES templates, broadcast
    up to MOST_PAIRS bigrams, both checked) counts what they share. Null and empty texts and units of one word match nothing.
    Rows with equal ids are scanned as one: a unit's number stands for each row that has it, once.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MOST_TEMPLATES} are broadcast")
    lo, hi = least / (2 - least), (2 - least) / least
    index = spark.createDataFrame(sorted(templates.items()), "license string, template string")
    index = index.select("license", bigrams(F.col("template")).alias("pairs"), F.size(words(F.col("template"))).alias("n_words"))
    index = index.withColumn("b", F.size("pairs")).where("b > 0")
    bounds = index.agg(F.min("b"), F.max("b"), F.sum("b"), F.max("n_words")).first()
    if bounds[0] is None:
        return spark.createDataFrame([], docs.select("doc_id").schema.add("unit", "integer").add("license", "string").add("dice", "double"))
    small = F.broadcast if bounds[2] <= MOST_PAIRS else lambda df: df
    docs = docs.select("doc_id", "text").where("text is not null")
    needed = keys(templates, least)
    if len(needed) <= MOST_KEYS:
        both = [sorted(k.split(" "), key=len) for k in needed]
        by_first = {a: [x for x, y in both if y == a] for _, a in both}
        holds = lambda low: reduce(or_, (F.contains(low, F.lit(a)) & reduce(or_, (F.contains(low, F.lit(b)) for b in bs)) for a, bs in by_first.items()))
        # first the words anywhere, then, in the few texts left, side by side
        docs = docs.where(F.exists(F.array(F.lower("text")), holds))
        docs = docs.where(F.exists(F.array(normalised(F.col("text"))), lambda x: reduce(or_, (F.contains(x, F.lit(k)) for k in needed))))
    lines = F.split(F.col("text"), "\n")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array("text"))).otherwise(lines)
    found = (
        docs.select("doc_id", F.size(lines).alias("n_lines"), F.posexplode(units))
        .select("doc_id", F.when(F.col("pos") == F.col("n_lines"), -1).otherwise(F.col("pos")).alias("unit"), bigrams(F.col("col")).alias("pairs"))
        .withColumn("a", F.size("pairs"))
        .where(F.col("a").between(bounds[0] * lo, bounds[1] * hi))
        .select("doc_id", "unit", "a", F.xxhash64("pairs").alias("content"), F.explode("pairs").alias("pair"))
    )
    terms = small(index.select("license", "b", F.explode("pairs").alias("pair")))
    shared = (
        found.join(terms, "pair").where((F.col("a") >= F.col("b") * lo) & (F.col("a") <= F.col("b") * hi))
        .groupBy("doc_id", "unit", "content", "license", "a", "b").agg(F.countDistinct("pair").alias("n"))
    )
    scored = shared.select("doc_id", "unit", "license", (2 * F.col("n") / (F.col("a") + F.col("b"))).alias("dice")).where(F.col("dice") >= least)
    cells = written(_cells(docs, needed if len(needed) <= MOST_LISTED else None, max(1, bounds[3] - 1)), "cells")
    inside = _from_words(cells, small(index), terms, lo, least)
    return scored.union(inside).groupBy("doc_id", "unit", "license").agg(F.max("dice").alias("dice"))


def _cells(docs: DataFrame, needed: list[str] | None, m: int) -> DataFrame:
    """cell, doc_id, at, p: the stretches of ``m`` words in which a window that holds a needed pair can begin.

    ``at`` has the line of each of those words and whether it is the line's first, ``p`` the word pairs of all windows
    of up to m pairs from there on. Stretches lie on a grid, so a text's words are in at most two of them.
    """
    by_line = docs.select("doc_id", F.transform(F.split(F.col("text"), "\n"), words).alias("by_line"))
    flat = by_line.select(
        "doc_id", F.transform(F.array(F.flatten("by_line")), pairs)[0].alias("p"),
        F.flatten(F.transform("by_line", lambda w, u: F.transform(w, lambda _, i: F.struct(u.alias("unit"), (i == 0).alias("first"))))).alias("at"),
    ).where("size(p) > 0")
    if needed is None:
        hit = F.sequence(F.lit(0), F.floor(F.size("p") / m).cast("int"))
    else:
        places = F.filter(F.transform("p", lambda x, i: F.when(x.isin(*needed), i)), lambda i: i.isNotNull())
        hit = F.array_distinct(F.flatten(F.transform(places, lambda k: F.array(F.greatest(F.lit(0), F.floor((k - m + 1) / m).cast("int")), F.floor(k / m).cast("int")))))
    cut = F.transform(hit, lambda c: F.struct(F.slice("at", c * m + 1, m).alias("at"), F.slice("p", c * m + 1, 2 * m - 1).alias("pairs")))
    return flat.select("doc_id", F.explode(cut).alias("c")).select(F.monotonically_increasing_id().alias("cell"), "doc_id", "c.at", F.col("c.pairs").alias("p"))


def _from_words(cells: DataFrame, index: DataFrame, terms: DataFrame, lo: float, least: float) -> DataFrame:
    """doc_id, unit, license, dice of the windows that begin in cells. Only templates are looked at of which a cell has
    enough bigrams; those counts prune before any window is made."""
    near = cells.select("cell", F.explode(F.array_distinct("p")).alias("pair")).join(terms, "pair")
    near = near.groupBy("cell", "license", "b").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("b") * lo).select("cell", "license")
    near = near.join(cells, "cell").join(index, "license")
    begins = F.filter(
        F.transform("at", lambda x, i: F.struct(x["unit"].alias("unit"), x["first"].alias("first"), i.alias("i"))),
        lambda x: F.get("p", x["i"]).isNotNull() & (x["first"] | F.array_contains("pairs", F.get("p", x["i"]))),
    )

    def dice(own: Column) -> Column:
        return 2 * F.size(F.array_intersect(own, F.col("pairs"))) / (F.size(own) + F.col("b"))

    window = lambda x: F.array_distinct(F.slice("p", x["i"] + 1, F.col("n_words") - 1))
    scores = F.transform(begins, lambda x: F.struct(x["unit"].alias("unit"), F.transform(F.array(window(x)), dice)[0].alias("dice")))
    return near.select("doc_id", "license", F.explode(scores).alias("s")).select("doc_id", "s.unit", "license", "s.dice").where(F.col("dice") >= least)


def best(scanned: DataFrame) -> DataFrame:
    """One row per document and licence: the units whose best template it is (ties: first licence id) and the best score."""
    first = W.partitionBy("doc_id", "unit").orderBy(F.desc("dice"), "license")
    return (
        scanned.withColumn("r", F.row_number().over(first)).where("r = 1")
        .groupBy("doc_id", "license").agg(F.count("*").alias("n_units"), F.round(F.max("dice"), 6).alias("dice"))
    )


def oracle(least: float = 0.8) -> str:
    rows = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    norm = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
with t as (select license, string_split({norm.format('template')}, ' ') as w from (values {rows}) as v(license, template)),
tb as (select license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from t),
u as (
  select doc_id, i - 1 as unit, l[i] as txt from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null) x, range(1, len(l) + 1) as r(i)
  union all
  select doc_id, -1, text from documents where contains(text, chr(10))
),
w as (select doc_id, unit, string_split({norm.format('txt')}, ' ') as w from u),
g as (select doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) > 1),
m1 as (
  select doc_id, unit, license, 2.0::double * len(list_intersect(g.g, tb.g)) / (len(g.g) + len(tb.g)) as dice
  from g join tb on len(g.g) >= len(tb.g) * {least}::double / (2 - {least}::double) and len(g.g) <= len(tb.g) * (2 - {least}::double) / {least}::double
),
lw as (select doc_id, unit, list_filter(string_split({norm.format('txt')}, ' '), lambda x: x <> '') as w from u where unit >= 0),
lo as (select doc_id, unit, len(w) as n, coalesce(sum(len(w)) over (partition by doc_id order by unit rows between unbounded preceding and 1 preceding), 0)::bigint as start from lw),
fw as (select doc_id, flatten(list(w order by unit)) as w from lw group by doc_id),
wp as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from fw),
pp as (select doc_id, i, x || ' ' || lead(x) over (partition by doc_id order by i) as pair from wp),
tp as (select license, unnest(g) as pair from tb),
st as (
  select doc_id, license, i, max(hit) as hit from (
    select doc_id, license, i, 1 as hit from pp join tp using (pair)
    union all
    select doc_id, license, start + 1, 0 from lo cross join t where n > 0
  ) group by all
),
en as (
  select doc_id, license, i, sum(hit) over (partition by doc_id, license order by i range between current row and greatest(len(w) - 2, 0) following) as n
  from st join t using (license)
),
win as (
  select en.doc_id, license, i, tb.g as tg, fw.w[i : i + len(t.w) - 1] as w
  from en join t using (license) join tb using (license) join fw on en.doc_id = fw.doc_id
  where en.n >= len(tb.g) * {least}::double / (2 - {least}::double) - 1e-9
),
wg as (select doc_id, license, i, tg, list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) as g from win where len(w) > 1),
m2 as (
  select wg.doc_id, unit, license, 2.0::double * len(list_intersect(g, tg)) / (len(g) + len(tg)) as dice
  from wg join lo on wg.doc_id = lo.doc_id and i > start and i <= start + n
),
m as (select doc_id, unit, license, max(dice) as dice from (select * from m1 union all select * from m2) group by all),
b as (select *, row_number() over (partition by doc_id, unit order by dice desc, license) as r from m where dice >= {least}::double)
select doc_id, license, count(*) as n_units, round(max(dice), 6) as dice from b where r = 1 group by doc_id, license
"""
