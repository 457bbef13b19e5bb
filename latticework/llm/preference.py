"""Operator 2, chat formatting: preference pairs with one shared prompt.

For each pair the longest common prefix of turns (same role and text) of the
chosen and the rejected conversation is rendered once as the prompt; the rest
of each side is rendered as its completion, with a loss mask given as character
spans [start, end) of what assistant turns say, their closing tag included.

Defined results: turns are ordered by `turn`, then role and text, and repeated
rows count once; a null turn comes before all others; a null role counts as "user" and a null text as empty. Where
both sides are equal, both completions are empty and `common_turns` is their
length. A pair that has only one side gets an empty other side. A null `conv_id`
gives no pair; texts of any length are rendered whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = "<|im_end|>\n"


def turns(conversations: DataFrame, name: str) -> DataFrame:
    """conv_id and its turns in order, as an array of (role, text)."""
    t = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        conversations.filter(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_set(t)).alias("all"))
        .select("conv_id", F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias(name))
    )


def _head(role: F.Column) -> F.Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))


def _render(a: F.Column) -> F.Column:
    return F.array_join(F.transform(a, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(_TAG))), "")


def _spans(a: F.Column, end: bool) -> F.Column:
    """Character positions where what the assistant says starts, or ends."""
    size = lambda t: F.length(_head(t["role"])) + F.length(t["text"]) + len(_TAG)

    def step(s: F.Column, t: F.Column) -> F.Column:
        at = s["n"] + (size(t) if end else F.length(_head(t["role"])))
        return F.struct(
            (s["n"] + size(t)).cast("bigint").alias("n"),
            F.when(t["role"] == "assistant", F.concat(s["at"], F.array(at.cast("bigint")))).otherwise(s["at"]).alias("at"),
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("at"))
    return F.aggregate(a, zero, step, lambda s: s["at"])


def pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen, rejected: (conv_id, turns). One row per conv_id that either side has."""
    d = chosen.join(rejected, "conv_id", "full_outer")
    none = F.array().cast("array<struct<role:string,text:string>>")
    d = d.select("conv_id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = F.transform(
        F.slice("chosen", F.lit(1), shorter), lambda x, i: (x == F.col("rejected")[i]) & x.isNotNull()
    )
    first = F.array_position(same, False)
    d = d.withColumn("common", F.when(first > 0, first - 1).otherwise(shorter).cast("int"))
    rest = lambda c: F.slice(c, F.col("common") + 1, F.size(c))
    d = d.select("conv_id", "common", F.slice("chosen", F.lit(1), F.col("common")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return d.select(
        "conv_id",
        F.col("common").cast("bigint").alias("common_turns"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _spans(F.col("c"), False).alias("chosen_mask_start"),
        _spans(F.col("c"), True).alias("chosen_mask_end"),
        _render(F.col("r")).alias("rejected"),
        _spans(F.col("r"), False).alias("rejected_mask_start"),
        _spans(F.col("r"), True).alias("rejected_mask_end"),
    )


def echo_rejections(chosen: DataFrame) -> DataFrame:
    """Rejected sides for data that has none: one assistant turn only repeats the turn before it.

    Of the assistant turns that follow another turn it is number conv_id modulo
    their count, so that sides part early, late and in between; the turns after
    it stay. Conversations without such a turn have no rejected side.
    """
    spots = F.filter(F.transform("chosen", lambda x, i: F.when((x["role"] == "assistant") & (i > 0), i + 1)), lambda i: i.isNotNull())
    d = chosen.withColumn("spots", spots).filter("size(spots) > 0").withColumn("at", F.expr("spots[cast(pmod(conv_id, size(spots)) as int)]"))
    echo = F.array(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("You said: "), F.col("chosen")[F.col("at") - 2]["text"]).alias("text")))
    return d.select(
        "conv_id",
        F.concat(F.slice("chosen", F.lit(1), F.col("at") - 1), echo, F.slice("chosen", F.col("at") + 1, F.size("chosen"))).alias("rejected"),
    )


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Pairs of every conversation that has an echo rejection."""
    chosen = turns(conversations, "chosen")
    d = echo_rejections(chosen)  # the same groups; the join below reuses their partitioning
    return pairs(chosen.join(d.select("conv_id"), "conv_id", "left_semi"), d)


ORACLE = """
with t as (select distinct conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, count(*) over (partition by conv_id) as total from t),
l as (select conv_id, list(k order by k) as ks from n where role = 'assistant' and k >= 2 group by conv_id),
e as (select n.conv_id, k, role, text, case when k = ks[1 + ((n.conv_id % len(ks)) + len(ks)) % len(ks)] then 'You said: ' || lag(text) over (partition by n.conv_id order by k) else text end as other
  from n join l using (conv_id)),
s as (select conv_id, k, role, text, other, min(case when text <> other then k end) over (partition by conv_id) as first_diff from e),
f as (select conv_id, k, role, coalesce(first_diff, 1000000000) as d, '<|im_start|>' || role || chr(10) as head, text || '<|im_end|>' || chr(10) as c, other || '<|im_end|>' || chr(10) as r from s),
g as (select *, sum(case when k >= d then length(head) + length(c) else 0 end) over w as c_end, sum(case when k >= d then length(head) + length(r) else 0 end) over w as r_end
  from f window w as (partition by conv_id order by k))
select conv_id, count(*) filter (where k < d) as common_turns,
  coalesce(string_agg(head || c, '' order by k) filter (where k < d), '') as prompt,
  coalesce(string_agg(head || c, '' order by k) filter (where k >= d), '') as chosen,
  coalesce(list((c_end - length(c))::bigint order by k) filter (where k >= d and role = 'assistant'), []) as chosen_mask_start,
  coalesce(list(c_end::bigint order by k) filter (where k >= d and role = 'assistant'), []) as chosen_mask_end,
  coalesce(string_agg(head || r, '' order by k) filter (where k >= d), '') as rejected,
  coalesce(list((r_end - length(r))::bigint order by k) filter (where k >= d and role = 'assistant'), []) as rejected_mask_start,
  coalesce(list(r_end::bigint order by k) filter (where k >= d and role = 'assistant'), []) as rejected_mask_end
from g group by conv_id
"""
