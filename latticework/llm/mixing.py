"""Operator 9, mixing sources to target weights.

Each source gets a budget of tokens: its share by weight of `total` (the tokens
of the whole table unless given), rounded down. A source's tokens fit in that a
number of times, its whole epochs, which are arithmetic: every document is taken
in each of them. What is left of the budget is the last epoch's. For it the
documents get hash-random keys (md5 of seed, epoch and doc_id), are range-sorted
by (source, key), and distributed prefix sums of their token counts tell where
the budget ends: every partition sums its own rows, a small table of partition
totals gives the offsets, and one row of each source holds the cut. Documents up
to it are taken, the one at the cut in part, so that each source's
`tokens_taken` add up to its budget exactly.

Only ids and token counts are sorted. Texts meet the cuts, one row a source, and
are not shuffled.

Defined results: a token is a run of characters other than white space, a null
text has none, and documents without tokens are never taken. Texts of any length
count whole. A null source counts as "(none)"; a null doc_id as "". Ties of keys,
which only repeated doc_ids have, go by token count, so repeated rows are all
taken, one after the other. Sources without a weight get weight 0 where weights
are given. However many times a budget holds its source, there are two rows at
most for each document. An empty table gives an empty result. `plan` reads
doc_id, source and text alone; `apply` keeps all columns, but for those of the
names of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import ship, stash

#: The columns that tell how a document is taken.
TAKEN = ("epoch", "epochs", "n_tokens", "tokens_taken")


def _budgets(base: DataFrame, weights: dict[str, int] | None, total: int | None) -> DataFrame:
    """(source, full, rest): whole epochs, and the tokens of the last one."""
    if weights is None:
        weight = F.lit(1).cast("bigint")
    else:
        weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("source")], F.lit(0)).cast("bigint") if weights else F.lit(0).cast("bigint")
    sources = base.groupBy("source").agg(F.sum("n_tokens").alias("has")).withColumn("weight", weight)
    everything = sources.agg(F.sum("weight").alias("all_weight"), (F.lit(total).cast("bigint") if total is not None else F.sum("has")).alias("all_tokens"))
    budget = F.expr("case when all_weight > 0 then cast(cast(all_tokens as decimal(38,0)) * weight div all_weight as bigint) else 0L end")
    d = sources.crossJoin(F.broadcast(everything)).withColumn("budget", budget)  # one row on the broadcast side
    return stash(d.selectExpr("source", "budget div has as full", "budget % has as rest").filter("full > 0 or rest > 0"), "mix-budgets")


def _taken(base: DataFrame, budgets: DataFrame, seed: int, broadcast_limit: int, salts: int) -> DataFrame:
    """The rows of base with TAKEN, one for the whole epochs and one for the last, as far as they are taken."""
    md5 = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    many = budgets.count() > broadcast_limit
    spread = F.pmod(F.col("rid"), F.lit(salts)).cast("int")

    def meet(d: DataFrame, small: DataFrame, how: str) -> DataFrame:
        """Few sources are sent to the rows; of many the rows are shuffled, those of one source to `salts` tasks."""
        if not many:
            return d.join(F.broadcast(small), "source", how)
        small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return d.withColumn("salt", spread).join(small, ["source", "salt"], how).drop("salt")

    order = ["source", "key", "doc_id", "n_tokens", "rid"]
    last = meet(base.select("source", "doc_id", "n_tokens", "rid"), budgets.filter("rest > 0"), "inner").withColumn("key", md5).select(*order)
    ranged = last.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.spark_partition_id().alias("part"))
    summed = stash(ranged.mapInArrow(_running, "source string, key string, doc_id long, n_tokens long, rid long, part int, upto long"), "mix-sums")
    parts = summed.groupBy("source", "part").agg(F.max("upto").alias("here"))
    w = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # the partition in which each source's budget ends, and its row there
    offsets = parts.withColumn("offset", F.coalesce(F.sum("here").over(w), F.lit(0))).join(budgets.select("source", "rest"), "source").filter("offset < rest and rest <= offset + here")
    at = F.struct("key", "doc_id", "n_tokens", "rid")
    cuts = summed.join(offsets, ["source", "part"]).filter("offset + upto - n_tokens < rest and rest <= offset + upto")
    cuts = cuts.select("source", at.alias("cut"), F.expr("rest - (offset + upto - n_tokens)").alias("cut_tokens"))
    small = stash(budgets.join(cuts, "source", "left").select("source", "full", "cut", "cut_tokens"), "mix-cuts")
    d = meet(base, small, "inner").withColumn("key", md5).withColumn("at", at)
    one = F.lit(1).cast("bigint")
    whole = F.when(F.col("full") > 0, F.struct(F.lit(0).cast("bigint").alias("epoch"), F.col("full").alias("epochs"), (F.col("full") * F.col("n_tokens")).alias("taken")))
    part = F.when(F.col("at") <= F.col("cut"), F.struct(F.col("full").alias("epoch"), one.alias("epochs"), F.when(F.col("at") == F.col("cut"), F.col("cut_tokens")).otherwise(F.col("n_tokens")).alias("taken")))
    d = d.withColumn("take", F.explode(F.filter(F.array(whole, part), lambda x: x.isNotNull())))
    return d.select(*base.columns, "take.epoch", "take.epochs", F.col("take.taken").alias("tokens_taken"))


def _base(docs: DataFrame, row: F.Column) -> DataFrame:
    """Rows with tokens, numbered; stashed, as the numbers hold for one run of a plan only."""
    ship(docs.sparkSession)
    d = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("source", F.lit("(none)")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("n_tokens"),
        row.alias("row"),
    )
    return stash(d.filter("n_tokens > 0").withColumn("rid", F.monotonically_increasing_id()), "mix-base")


def plan(docs: DataFrame, weights: dict[str, int] | None = None, total: int | None = None, seed: int = 7, broadcast_limit: int = 100_000, salts: int = 64) -> DataFrame:
    """(doc_id, source, epoch, epochs, n_tokens, tokens_taken), for each document the whole epochs, and the last one.

    weights: whole numbers by source; None gives every source the same. A row
    stands for `epochs` epochs from `epoch` on; tokens_taken counts all of them.
    """
    base = _base(docs, F.lit(True))
    return _taken(base, _budgets(base, weights, total), seed, broadcast_limit, salts).select("doc_id", "source", *TAKEN)


def apply(docs: DataFrame, weights: dict[str, int] | None = None, total: int | None = None, seed: int = 7, broadcast_limit: int = 100_000, salts: int = 64) -> DataFrame:
    """The documents as they are taken: all their columns, the text cut to what is taken of it in an epoch, and TAKEN."""
    names = [c for c in docs.columns if c not in TAKEN]
    base = _base(docs.select(*names), F.struct(*(F.col(c) for c in names)))
    d = _taken(base, _budgets(base, weights, total), seed, broadcast_limit, salts)
    part = F.col("tokens_taken") < F.col("epochs") * F.col("n_tokens")
    cut = F.rtrim(F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"\S+\s*"), F.lit(0)), F.lit(1), F.col("tokens_taken").cast("int")), ""))
    d = d.withColumn("text", F.when(part, cut).otherwise(F.col("row.text")))
    new = {"text": F.col("text"), "source": F.col("source"), "n_chars": F.length("text").cast("bigint")}
    return d.select(*(new.get(c, F.col("row")[c]).alias(c) for c in names), *TAKEN)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix sums within a partition, by source; rows come sorted by source."""
    last, carry = None, 0
    for b in batches:
        if not len(b):
            continue
        n, code = b.column("n_tokens").to_numpy(), b.column("source").dictionary_encode()
        of = code.indices.to_numpy()
        head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        total = np.cumsum(n)
        before = np.repeat(total[head] - n[head], np.diff(np.append(head, len(n))))
        upto = total - before
        names = code.dictionary.to_pylist()
        if names[of[0]] == last:
            upto[: head[1] if len(head) > 1 else len(n)] += carry
        last, carry = names[of[-1]], int(upto[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto)], [*b.schema.names, "upto"])


ORACLE = r"""
with base as (select doc_id, coalesce(source, '(none)') as source, len(regexp_extract_all(coalesce(text, ''), '\S+')) as n_tokens from documents),
b as (select * from base where n_tokens > 0),
s as (select source, sum(n_tokens)::bigint as has from b group by source),
g as (select source, has, ((select sum(has) from s)::hugeint // (select count(*) from s))::bigint as budget from s),
e as (select doc_id, b.source, n_tokens, budget // has as full_epochs, budget % has as rest from b join g using (source)),
c as (select *, sum(n_tokens) over (partition by source order by md5(concat('7:', full_epochs, ':', coalesce(doc_id::varchar, ''))), doc_id nulls first, n_tokens rows unbounded preceding) - n_tokens as start from e)
select doc_id, source, 0::bigint as epoch, full_epochs::bigint as epochs, n_tokens::bigint as n_tokens, (full_epochs * n_tokens)::bigint as tokens_taken from e where full_epochs > 0
union all select doc_id, source, full_epochs, 1, n_tokens, least(n_tokens, rest - start)::bigint from c where start < rest
"""
