"""Chat formatting by rotation of perspectives (operator 8).

For every participant of a dialogue the whole dialogue is rendered with that speaker as assistant and the others
as named users; `system` turns stay system turns and system is no participant. The mask covers what the assistant says, its
end mark included. Utterances are numbered within their dialogue, and a record holds a block of BLOCK of them: one for nearly all dialogues,
several in a row for longer ones; `offset` says where a block begins in the whole. Numbers come from a sort by ranges, which cuts a
dialogue of any length, and offsets from summed lengths of blocks, so that no task gathers a dialogue, with turn numbers or without.

Null or empty roles speak as `unknown`, null text is empty. Turns go by turn number, role and text; null turns come first. A
row that repeats conv_id, turn, role and text is the same utterance and counts once. Rows without conv_id
form a dialogue of their own. Marks inside texts are broken by a zero-width space. A dialogue of system
turns alone gives no record, nor does an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

BLOCK = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def head(role: Column, perspective: Column) -> Column:
    """What opens an utterance of a role in a record of this perspective."""
    speaker = F.when(role == "system", "system").when(role == perspective, "assistant").otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(OPEN), speaker, F.lit("\n"))


def numbered(turns: DataFrame) -> DataFrame:
    """turns with `number`, from 0 within each dialogue, by turn, role and text.

    Rows are parted by ranges of the order (texts that begin alike stay together) and written once, with the part they lie in; they are numbered within
    their part, behind the rows of the dialogue in the parts before.
    """
    order = [F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64)]
    parted = stored(turns.repartitionByRange(F.col("conv_id").asc_nulls_first(), *order).withColumn("part", F.spark_partition_id()), "chat-turns")
    sizes = parted.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("conv_id").alias("own_conv"), F.col("part").alias("own_part"), F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    ranked = parted.withColumn("place", place)
    joined = ranked.join(sizes, ranked["conv_id"].eqNullSafe(sizes["own_conv"]) & (ranked["part"] == sizes["own_part"]))
    return joined.select("conv_id", "turn", "role", "text", (F.col("before") + F.col("place") - 1).alias("number"))


def block_offsets(by_block: DataFrame) -> DataFrame:
    """speaker_conv, speaker_block, perspective and offset of every record, from the utterances (n) and characters (chars) of each conv_id, block and role.

    A block is as long as if all were named users, but for the heads of the perspective's own utterances.
    """
    named, own = F.length(head(F.col("role"), F.lit(""))), F.length(head(F.col("role"), F.col("role")))
    speakers = by_block.where("role != 'system'").select(F.col("conv_id").alias("speaker_conv"), F.col("role").alias("perspective")).distinct()
    sizes = by_block.groupBy("conv_id", "block").agg(F.sum(F.col("n") * (named + len(CLOSE)) + F.col("chars")).alias("size"))
    pairs = sizes.join(speakers, sizes["conv_id"].eqNullSafe(speakers["speaker_conv"])).select("speaker_conv", F.col("block").alias("speaker_block"), "perspective", "size")
    changes = by_block.where("role != 'system'").select("conv_id", "block", "role", (F.col("n") * (own - named)).alias("change"))
    mine = pairs["speaker_conv"].eqNullSafe(changes["conv_id"]) & (pairs["speaker_block"] == changes["block"]) & (pairs["perspective"] == changes["role"])
    before = Window.partitionBy("speaker_conv", "perspective").orderBy("speaker_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.sum(F.col("size") + F.coalesce("change", F.lit(0))).over(before)
    return pairs.join(changes, mine, "left").select("speaker_conv", "speaker_block", "perspective", F.coalesce(offset, F.lit(0)).cast("bigint").alias("offset"))


def rotate(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, block, n_turns, n_masked, text, masks (start:end of each masked span, in characters, end exclusive) and offset."""
    turns = numbered(
        conversations.select(
            "conv_id",
            "turn",
            F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown")).alias("role"),
            F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<​|")).alias("text"),
        ).distinct()
    ).withColumn("block", F.floor(F.col("number") / block))
    by_block = turns.groupBy("conv_id", "block", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    speakers = block_offsets(by_block)
    blocks = turns.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("number", "role", "text"))).alias("turns"))
    joined = blocks.join(speakers, blocks["conv_id"].eqNullSafe(speakers["speaker_conv"]) & (blocks["block"] == speakers["speaker_block"]))
    opened = lambda t: head(t["role"], F.col("perspective"))
    pieces = F.transform("turns", lambda t: F.struct(F.length(opened(t)).alias("head"), (F.length(t["text"]) + len(CLOSE)).alias("body"), (t["role"] == F.col("perspective")).alias("mask"), F.concat(opened(t), t["text"], F.lit(CLOSE)).alias("piece")))
    none = F.lit([]).cast("array<string>")
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["head"] + p["body"]).alias("at"),
            F.when(p["mask"], F.concat(acc["spans"], F.array(F.concat_ws(":", acc["at"] + p["head"], acc["at"] + p["head"] + p["body"])))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: F.array_join(acc["spans"], ","),
    )
    return joined.withColumn("pieces", pieces).select(
        "conv_id",
        "perspective",
        "block",
        F.size("pieces").cast("bigint").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["mask"])).cast("bigint").alias("n_masked"),
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"),
        spans.alias("masks"),
        "offset",
    )


ORACLE_SQL = """
with t as (
  select distinct conv_id, turn, coalesce(nullif(role, ''), 'unknown') as role,
         replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') as text
  from conversations),
n as (select *, (row_number() over (partition by conv_id order by turn nulls first, role, text) - 1) // 1024 as block from t),
p as (select distinct conv_id, role as perspective from t where role <> 'system'),
j as (
  select p.perspective, t.*, t.role = p.perspective as mask,
         '<|im_start|>' || case when t.role = 'system' then 'system' when t.role = p.perspective then 'assistant'
           else 'user name=' || t.role end || chr(10) as head,
         t.text || '<|im_end|>' || chr(10) as body
  from n as t join p on t.conv_id is not distinct from p.conv_id),
o as (
  select *, coalesce(sum(length(head) + length(body)) over (partition by conv_id, perspective, block
    order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0) as pos
  from j),
g as (
  select conv_id, perspective, block, count(*) as n_turns, count(*) filter (where mask) as n_masked,
         string_agg(head || body, '' order by turn nulls first, role, text) as text,
         coalesce(string_agg(cast(cast(pos + length(head) as bigint) as varchar) || ':' || cast(cast(pos + length(head) + length(body) as bigint) as varchar), ','
           order by pos) filter (where mask), '') as masks
  from o group by all)
select *, cast(coalesce(sum(length(text)) over (partition by conv_id, perspective order by block
  rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
from g
"""
