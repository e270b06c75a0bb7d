"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points, mapped through the cumulative targets, give each slot of the mix a source; a source's
slots are ranked, and rank r takes the r-th block of equally many tokens from the source's shuffled documents,
starting over after the last. Ranks, offsets and joins are computed in pieces (hash prefixes, slot chunks), so
a source with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
CHUNK = 65536


@dataclass
class Mix:
    """``documents``: a row per input row with size, source_size, target, taken and first_slot (null where nothing is taken).
    ``slots``: slot, source, rank, tokens: the order of the mix. ``blocks``: slot, at, doc_id, source, first_word, n_words: what
    stands in each slot, in order of ``at``."""

    documents: DataFrame
    slots: DataFrame
    blocks: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source: source_size, weight, target.

    Sources by code point, null last, get the weights in turn. They share ``share`` times all tokens; a target
    stops at ``most`` times its source's size and what is above goes to the others by weight. With caps in
    order of size per weight, the first source below its cap fixes the common level of all after it. The
    windows over all sources read one row per source.
    """
    by_name, by_cap = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, every = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return per.select("source", "source_size", "weight", F.least("cap", F.coalesce(final * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(
    docs: DataFrame,
    size: Column | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 4096,
    seed: str = "mix",
) -> Mix:
    """Mixes ``docs`` (doc_id, source, text). No row is dropped: rows with a null id, null source or no words come
    back too, the last with taken 0. Rows with the same id are mixed as separate rows. Other columns are ignored.
    An empty table gives empty results. Reruns give the same rows.
    """
    spark = docs.sparkSession
    size = word_count(F.col("text")) if size is None else size
    sized = written(docs.select("doc_id", "source", size.alias("size")), "sizes")
    per = written(source_targets(sized, weights, share, most), "targets")

    # where each document starts in its source's shuffled stream of tokens
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))
    keyed = sized.withColumn("key", key).withColumn("part", F.substring("key", 1, 3))
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("n"))
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_at"))
    inside = W.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    keyed = keyed.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    streams = same(keyed, parts, "source", "part").withColumn("at", F.col("at") + F.col("part_at")).select("doc_id", "source", "size", "at")
    streams = written(same(streams, per.select("source", "source_size", "target"), "source"), "streams")

    slots = written(schedule(spark, per, block), "slots")
    # a document's tokens in the first and the second pass over its source, cut at block ends, against the slots
    turns = F.transform(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1)), lambda k: F.col("at") + k * F.col("source_size"))
    cut = (
        streams.where("size > 0").select("doc_id", "source", "at", "size", F.explode(turns).alias("start"))
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    )
    begin = F.greatest("start", F.col("rank") * block)
    overlap = F.least(F.col("start") + F.col("size"), F.col("rank") * block + F.col("tokens")) - begin
    placed = same(cut, slots.select("slot", "source", "rank", "tokens"), "source", "rank").withColumn("n_words", overlap).where("n_words > 0")
    placed = written(placed.select("slot", (begin - F.col("rank") * block).alias("at_word"), "doc_id", "source", (begin - F.col("start")).alias("first_word"), "n_words", "at"), "blocks")
    taken = placed.groupBy("source", "at").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
    a, b = streams.alias("a"), taken.alias("b")
    found = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.size") > 0), "left")
    found = found.select("a.doc_id", "a.source", "a.size", "a.source_size", "a.target", F.coalesce("b.taken", F.lit(0)).cast("bigint").alias("taken"), "b.first_slot")
    return Mix(found, slots, placed.select("slot", F.col("at_word").alias("at"), "doc_id", "source", "first_word", "n_words"))


def texts(docs: DataFrame, mix: Mix) -> DataFrame:
    """The mix itself: slot, at, doc_id, text: the words of each piece, one space between. ``docs`` must have unique ids."""
    words = docs.select("doc_id", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    a, b = mix.blocks.alias("a"), words.alias("b")
    piece = F.array_join(F.slice("b.words", (F.col("a.first_word") + 1).cast("int"), F.col("a.n_words").cast("int")), " ")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))).select("a.slot", "a.at", "a.doc_id", piece.alias("text"))


def same(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on ``keys``, null equal to null; the keys once."""
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on).select("a.*", *[f"b.`{c}`" for c in right.columns if c not in keys])


def schedule(spark, per: DataFrame, block: int) -> DataFrame:
    """slot, source, rank (from 0), tokens: as many slots as each source's target has blocks, the last one cut to fit.

    Slot i stands at the fraction of (i + 1) times the golden ratio, on a line on which each source has its share, so every
    prefix of the schedule holds each source in about its share. The points give a source a few slots too many or too few
    (the discrepancy of the sequence, which grows with the logarithm of the slots); each slot beyond a source's need goes,
    in order, to the next block that is still without one. So all slots are used and every block has one.
    """
    need = per.select("source", "target", F.round("target").cast("bigint").alias("tokens")).where("tokens > 0")
    need = need.withColumn("slots", F.ceil(F.col("tokens") / block)).withColumn("n_sources", F.count("*").over(W.partitionBy()))
    line = W.orderBy(F.col("source").asc_nulls_last())
    share = F.col("slots") / F.sum("slots").over(W.partitionBy())
    need = need.withColumn("hi", F.sum(share).over(line.rowsBetween(W.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - share)
    # the line ends at 1, whatever the sum of the shares was rounded to
    need = need.withColumn("hi", F.when(F.row_number().over(line) == F.col("n_sources"), 1.0).otherwise(F.col("hi")))
    need = written(need, "needs")
    total = need.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    n, cells = int(total[0]), max(1024, int(total[1]))
    points = spark.range(n).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * cells))
    spans = need.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))))
    mapped = points.join(spans, "cell").where("x >= lo and x < hi").select("slot", "source").withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    sums = mapped.groupBy("source", "chunk").count()
    sums = sums.withColumn("base", F.coalesce(F.sum("count").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = mapped.withColumn("r", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = same(ranked, sums.select("source", "chunk", "base"), "source", "chunk").select("slot", "source", (F.col("base") + F.col("r")).alias("rank"))
    ranked = written(same(ranked, need.select("source", "slots"), "source"), "ranked")
    good = ranked.where("rank < slots").select("slot", "source", "rank")
    # few rows: the discrepancy of each source
    over = spark.range(n).select(F.col("id").alias("slot")).join(good.select("slot"), "slot", "left_anti").withColumn("k", F.row_number().over(W.orderBy("slot")))
    given = ranked.groupBy("source").agg(F.count("*").alias("given"))
    a, b = need.alias("a"), given.alias("b")
    short = (
        a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left")
        .select("a.source", "a.slots", F.coalesce("b.given", F.lit(0)).alias("given")).where("given < slots")
        .select("source", F.explode(F.sequence("given", F.col("slots") - 1)).alias("rank"))
        .withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last(), "rank")))
    )
    moved = over.join(short, "k").select("slot", "source", "rank")
    out = same(good.union(moved), need.select("source", F.col("tokens").alias("need")), "source")
    return out.select("slot", "source", "rank", F.least(F.lit(block), F.col("need") - F.col("rank") * block).cast("bigint").alias("tokens"))


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), p as (
  select source, sum(size)::bigint as source_size,
    case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from d group by source
), r as (
  select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio from p
), l as (
  select *, (sum(source_size) over () * 1.5::double
    - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as lv
  from r
), f as (
  select source, source_size, least(cap, coalesce((select arg_min(lv, ratio) from l where lv <= ratio) * weight, cap)) as target from l
), s as (
  select doc_id, source, size, coalesce(sum(size) over (partition by source
    order by md5(concat(coalesce(doc_id::varchar, ''), 'mix')), doc_id, size rows between unbounded preceding and 1 preceding), 0) as pos
  from d
), need as (
  select source, round(target)::bigint as tokens, ceil(round(target) / 4096)::bigint as slots, row_number() over (order by source nulls last) as place from f where round(target) >= 1
), line as (
  select *, sum(slots) over () as total, case when place = count(*) over () then 1.0::double else sum(slots) over (order by place) / (sum(slots) over ())::double end as hi,
    coalesce(sum(slots) over (order by place rows between unbounded preceding and 1 preceding), 0) / (sum(slots) over ())::double as lo
  from need
), points as (
  select i as slot, ((i + 1) * 0.6180339887498949::double) % 1.0::double as x from range((select coalesce(max(total), 0)::bigint from line)) t(i)
), mapped as (
  select slot, source, slots, row_number() over (partition by source order by slot) - 1 as rank from points join line on x >= lo and x < hi
), over_ as (
  select slot, row_number() over (order by slot) as k from mapped where rank >= slots
), short as (
  select source, rank, row_number() over (order by source nulls last, rank) as k
  from (select source, unnest(range(given, slots)) as rank from (select source, slots, (select count(*) from mapped m where m.source is not distinct from need.source) as given from need))
), slot as (
  select slot, source, rank from mapped where rank < slots union all select slot, source, rank from over_ join short using (k)
), turn as (
  select doc_id, source, size, pos + t * source_size as start, source_size, round(target)::bigint as tokens, pos
  from s join f using (source), range(2) r(t) where size > 0
  union all select doc_id, s.source, size, pos + t * source_size, source_size, round(target)::bigint, pos from s join f on s.source is null and f.source is null, range(2) r(t) where size > 0
), firsts as (
  select turn.source, pos, min(slot) as first_slot from turn join slot on turn.source is not distinct from slot.source
    and rank between start // 4096 and (start + size - 1) // 4096 and least(start + size, least((rank + 1) * 4096, tokens)) > greatest(start, rank * 4096)
  group by turn.source, pos
)
select s.doc_id, s.size, f.source_size, round(f.target, 3) as target,
  (greatest(0, least(s.pos + size, round(f.target)) - s.pos) + greatest(0, least(s.pos + f.source_size + size, round(f.target)) - s.pos - f.source_size))::bigint as taken, first_slot
from s join f on s.source is not distinct from f.source left join firsts x on x.source is not distinct from s.source and x.pos = s.pos and s.size > 0
"""
