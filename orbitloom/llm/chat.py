"""Operator 6: chat formatting with collapse of cumulative snapshots.

Logged conversations often repeat an earlier log and add turns. Each turn carries a rolling hash of the conversation up to
it: running sums of hashes of (position, role, text). A conversation whose last rolling hash is that of an earlier turn of a
longer conversation is a snapshot of it and is dropped by an anti-join; of equal conversations the smallest conv_id stays.
What stays is rendered with a chat template. Cases: turns are ordered by turn (nulls first), then role and text; repeated
rows are turns of their own; null roles and texts count as empty; each row with a null conv_id is a conversation of its own
(equal ones collapse); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_ORDER = "partition by conv_id order by turn nulls first, role, text rows between unbounded preceding and current row"


_KEYS = ["position", "p1", "p2", "p3", "p4"]


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, position from 1, role, text, and the rolling hash (p1..p4) of the turns up to each.

    Two hashes of 64 bits are summed in halves of 32, which no length of conversation overflows."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashes = {"h": F.xxhash64("position", "role", "text"), "g": F.xxhash64("text", "position", F.lit(7), "role")}
    halves = {"p1": "shiftright(h, 32)", "p2": "h & 4294967295", "p3": "shiftright(g, 32)", "p4": "g & 4294967295"}
    known = rows.filter("conv_id is not null").withColumn("position", F.expr(f"row_number() over ({_ORDER})")).withColumns(hashes)
    known = known.withColumns({k: F.expr(f"sum({v}) over ({_ORDER})") for k, v in halves.items()})
    alone = rows.filter("conv_id is null").withColumn("position", F.lit(1)).withColumns(hashes).withColumns({k: F.expr(v) for k, v in halves.items()})
    columns = ["conv_id", "role", "text", *_KEYS]
    return known.select(columns).union(alone.select(columns))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the last rolling hash of the conversations, of rows with prefix hashes, that no other one continues."""
    known = rows.filter("conv_id is not null").select("conv_id", *_KEYS)
    last = known.groupBy("conv_id").agg(F.max_by(F.struct(*_KEYS), "position").alias("last")).select("conv_id", "last.*")
    every = last.union(rows.filter("conv_id is null").select("conv_id", *_KEYS))
    classes = every.groupBy(*_KEYS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = known.join(last.select("conv_id", F.col("position").alias("end")), "conv_id").filter("position < end").select(*_KEYS).distinct()
    kept = classes.join(inner, _KEYS, "left_anti")
    return kept.select("conv_id", F.col("position").cast("long").alias("n_turns"), "n_copies", *_KEYS)


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and chat: the maximal conversations under a template with turn marks."""
    rows = common.saved(with_prefix_hashes(turns))
    kept = common.saved(maximal(rows))
    shown = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    parts = rows.select("conv_id", F.struct("position", shown.alias("shown")).alias("part")).join(kept.select("conv_id", "n_turns", "n_copies"), "conv_id")
    turns_of = parts.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    known = turns_of.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("parts.shown"), "").alias("chat"))
    texts = rows.filter("conv_id is null").groupBy(*_KEYS).agg(F.first(shown).alias("chat"))
    alone = kept.filter("conv_id is null").join(texts, _KEYS).select("conv_id", "n_turns", "n_copies", "chat")
    return known.union(alone)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, collapsed and rendered."""
    return rendered(common.table(spark, sf_dir, "conversations"))


OP6_SQL = """
with n as (select *, case when conv_id is null then row_number() over () end as alone from conversations),
t as (
  select conv_id, alone, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id, alone order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as position
  from n),
p as (select conv_id, position, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') over (partition by conv_id, alone order by position rows between unbounded preceding and current row) as chat,
             count(*) over (partition by conv_id, alone) as n_turns from t),
ends as (select min(conv_id) as conv_id, n_turns, count(*) as n_copies, chat from p where position = n_turns group by chat, n_turns)
select conv_id, n_turns, n_copies, chat from ends e
where not exists (select 1 from p where p.position < p.n_turns and p.position = e.n_turns and p.chat = e.chat)
"""
