"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose spans that end at turns. Each window holds the system turn, limited history
and the span's new turns; the loss covers the text of the span's assistant turns only, so that every target
is learnt once, however often it is repeated as history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .mixing import word_count

START, END = "<|im_start|>", "<|im_end|>"
OVERHEAD = 4  # tokens of the marks of a turn


def escape(text: Column) -> Column:
    """No control string is left in the result; ``unescape`` reverses it."""
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def windows(turns: DataFrame, budget: int = 512, history: int = 2, history_tokens: int = 128, size: Column | None = None) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) to one row per window: conv_id, window, text, n_tokens, repeated, loss.

    Turns go by (turn, role, text); null roles and texts are empty; repeated rows are turns of their own; rows with
    a null conv_id are one conversation. A leading system turn is in every window. Half of what the budget leaves
    beside it and the history is the step of the prefix sums: a span of turns no longer than a step fits; a longer
    turn is a span of its own and its window may pass the budget, since turns are never cut. ``history`` turns before
    the span are repeated as far as they have ``history_tokens``. repeated: leading turns of the window seen before;
    loss: code point spans (start from 0, end exclusive) in text. Other columns are ignored; no rows give no rows.
    """
    size = word_count(F.col("text")) if size is None else size
    base = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("tokens", size + OVERHEAD)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    n = base.withColumn("n", F.row_number().over(order)).withColumn("lead", (F.col("n") == 1) & (F.col("role") == "system"))
    n = n.withColumn("system", F.first(F.when(F.col("lead"), F.col("tokens")).otherwise(0)).over(order))
    n = n.withColumn("step", F.greatest(F.floor((F.lit(budget) - F.least("system", F.lit(budget)) - history_tokens) / 2), F.lit(1)))
    n = n.withColumn("cost", F.when(F.col("lead"), 0).otherwise(F.col("tokens")))
    n = n.withColumn("sum", F.coalesce(F.sum("cost").over(before), F.lit(0)))
    n = n.withColumn("long", F.col("cost") > F.col("step")).withColumn("cell", F.floor(F.col("sum") / F.col("step")))
    # the system turn belongs to the first span
    new = (F.col("n") == 1) | (F.lag("cell").over(order) != F.col("cell")) | F.col("long") | F.lag("long").over(order)
    n = n.withColumn("new", F.when(F.lag("lead").over(order), False).otherwise(new))
    n = n.withColumn("window", F.sum(F.col("new").cast("int")).over(order) - 1)
    item = F.struct("role", "text", "tokens", "lead")
    n = n.withColumn("past", F.when(F.col("new") & (F.col("n") > 1), F.collect_list(item).over(order.rowsBetween(-history, -1))))
    head = F.first(F.when(F.col("lead"), F.struct("role", "text", "tokens"))).over(order)
    n = n.withColumn("head", F.when(F.col("new") & (F.col("n") > 1), head))

    bare = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["tokens"].alias("tokens"))
    grouped = n.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("n", F.struct("role", "text", "tokens").alias("t")))).alias("own"),
        F.max_by("past", F.col("new").cast("int")).alias("past"), F.max_by("head", F.col("new").cast("int")).alias("head"),
    )
    past = F.filter(F.coalesce("past", F.array().cast(n.schema["past"].dataType)), lambda x: ~x["lead"])
    # the latest turns of the history that together fit, kept in order
    kept = F.aggregate(
        F.reverse(past), F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<struct<role:string,text:string,tokens:bigint>>").alias("keep"), F.lit(True).alias("open")),
        lambda s, x: F.struct(
            (s["sum"] + x["tokens"]).cast("bigint").alias("sum"),
            F.when(s["open"] & (s["sum"] + x["tokens"] <= history_tokens), F.array_prepend(s["keep"], bare(x))).otherwise(s["keep"]).alias("keep"),
            (s["open"] & (s["sum"] + x["tokens"] <= history_tokens)).alias("open"),
        ),
        lambda s: s["keep"],
    )
    first = F.when(F.col("head").isNotNull(), F.array("head")).otherwise(F.array().cast("array<struct<role:string,text:string,tokens:bigint>>"))
    lead_in = F.concat(first, kept)
    grouped = grouped.withColumn("again", lead_in).withColumn("all", F.concat("again", F.transform("own", lambda x: x["t"])))
    wrapped = F.transform("all", lambda x: F.struct(F.concat(F.lit(START), _role(x["role"]), F.lit("\n")).alias("open"), escape(x["text"]).alias("body"), x["role"].alias("role")))
    grouped = grouped.withColumn("parts", wrapped).withColumn("repeated", F.size("again"))
    tail = END + "\n"
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def mark(s, x):
        start = s["at"] + F.length(x["open"])
        end = start + F.length(x["body"])
        learn = (x["role"] == "assistant") & (s["i"] >= F.col("repeated"))
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + len(tail)).alias("at"), (s["i"] + 1).alias("i"), F.when(learn, F.array_append(s["loss"], span)).otherwise(s["loss"]).alias("loss"))

    return grouped.select(
        "conv_id", "window",
        F.array_join(F.transform("parts", lambda x: F.concat(x["open"], x["body"], F.lit(tail))), "").alias("text"),
        F.aggregate("all", F.lit(0).cast("bigint"), lambda s, x: s + x["tokens"]).alias("n_tokens"),
        "repeated",
        F.aggregate("parts", state, mark, lambda s: s["loss"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learnt text of each conversation, read from its windows: conv_id, turns array<role,text>, loss, formatted_chars."""
    parts = F.slice(F.split("text", r"<\|im_start\|>"), 2, 1 << 30)
    own = F.slice(parts, F.col("repeated") + 1, 1 << 30)

    def turn(x):
        at = F.locate("\n", x)
        role, body = x.substr(F.lit(1), at - 1), x.substr(at + 1, F.length(x) - at - len(END) - 1)
        return F.struct(unescape(F.replace(role, F.lit("%0A"), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    learnt = F.transform("loss", lambda s: unescape(F.col("text").substr(s["start"] + 1, s["end"] - s["start"])))
    rows = formatted.select("conv_id", "window", F.transform(own, turn).alias("turns"), F.array_join(learnt, "").alias("loss"), F.length("text").alias("chars"))
    ordered = F.sort_array(F.collect_list(F.struct("window", "turns", "loss")))
    return rows.groupBy("conv_id").agg(ordered.alias("w"), F.sum("chars").cast("bigint").alias("formatted_chars")).select(
        "conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss"), "formatted_chars"
    )


ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), b as (
  select *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 as tok,
    24 + length(replace(replace(replace(role, '%', '%25'), '<|', '%3C|'), chr(10), '%0A')) + length(replace(replace(text, '%', '%25'), '<|', '%3C|')) as chars
  from t
), n as (
  select *, row_number() over w as n, first_value(role) over w = 'system' as has_head, first_value(tok) over w as head_tok, first_value(chars) over w as head_chars
  from b window w as (partition by conv_id order by turn, role, text)
), c as (
  select *, n = 1 and has_head as head, greatest((512 - case when has_head then least(head_tok, 512) else 0 end - 128) // 2, 1) as step, case when n = 1 and has_head then 0 else tok end as cost from n
), s as (
  select *, coalesce(sum(cost) over (partition by conv_id order by n rows between unbounded preceding and 1 preceding), 0)::bigint // step as cell, cost > step as long from c
), l as (
  select *, lag(cell) over w as cell_1, lag(long) over w as long_1, lag(head) over w as head_1, lag(head, 2) over w as head_2, lag(tok) over w as tok_1, lag(tok, 2) over w as tok_2,
    lag(chars) over w as chars_1, lag(chars, 2) over w as chars_2
  from s window w as (partition by conv_id order by n)
), k as (
  select *, case when head_1 then false else n = 1 or cell_1 <> cell or long or long_1 end as fresh from l
), e as (
  select *, case when fresh and n > 1 then case when has_head then head_chars else 0 end
    + case when tok_1 <= 128 then chars_1 + case when not coalesce(head_2, true) and tok_1 + tok_2 <= 128 then chars_2 else 0 end else 0 end else 0 end as again
  from k
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars + again)::bigint as formatted_chars
from e group by conv_id
"""
