"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

Every participant of a conversation (each distinct speaker but the system) gets the whole dialogue rendered with that
speaker as the assistant, all others as named users and system messages as they are. The result has one row per
message and perspective, so that no row holds an unbounded dialogue: the rendered segment, its place in the rendered
dialogue (code points), and the mask: which code points are the assistant's own words and end mark, to be learned.
Segments of one (conversation, perspective) in order of ``start`` follow each other without gaps.

Order: turn (null first), then speaker, then text; equal messages follow each other. Null or blank speaker: the
participant ``unknown``. Null text: empty. Null conversation: a message of its own, alone in its dialogue. A
conversation of system messages only has no participant and so no rows. Empty table: empty result. Extra columns don't
matter. Marks within texts stay as text; masks are given by place and so can't be forged.

A long conversation is cut into ranges of TURNS turns; segments are placed within a range and ranges within the
dialogue, so no task needs a whole conversation. Equal turns share a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURNS = 256
END = "<|end|>\n"
UNKNOWN = "unknown"


def render(messages: DataFrame) -> DataFrame:
    """messages with role ("system", "assistant" for the own speaker, "user"), name, segment, length, mask_length."""
    own, system = F.col("speaker") == F.col("perspective"), F.col("is_system")
    role = F.when(system, "system").when(own, "assistant").otherwise("user")
    name = F.when(~system & ~own, F.col("speaker"))
    head = F.when(name.isNull(), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    segment = F.concat(head, F.col("text"), F.lit(END))
    masked = F.when(own & ~system, F.length("text") + len(END)).otherwise(0).cast("long")
    return messages.withColumns({"role": role, "name": name, "segment": segment, "length": F.length(segment).cast("long"), "mask_length": masked})


def rotate(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system", turns: int = TURNS) -> DataFrame:
    """(conv_id, perspective, turn, speaker, role, name, segment, start, length, mask_start, mask_length) rows."""
    who = F.coalesce(F.nullif(F.trim(F.col(speaker).cast("string")), F.lit("")), F.lit(UNKNOWN))
    m = conversations.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), who.alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"), (who == system).alias("is_system"))
    m = m.withColumn("_range", F.coalesce(F.floor(F.col("turn") / turns), F.lit(-(1 << 62))))
    kept = m.filter(F.col("conv_id").isNotNull())
    people = kept.filter(~F.col("is_system")).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    rows = render(kept.join(people, "conv_id"))
    key = ["conv_id", "perspective"]
    sums = rows.groupBy(*key, "_range").agg(F.sum("length").alias("_n"))
    before = Window.unboundedPreceding, -1
    places = sums.select(*key, "_range", F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(*before)), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*key, "_range").orderBy("turn", "speaker", "text").rowsBetween(*before)
    placed = rows.join(places, [*key, "_range"]).withColumn("start", F.col("_base") + F.coalesce(F.sum("length").over(within), F.lit(0)))
    alone = render(m.filter(F.col("conv_id").isNull() & ~F.col("is_system")).withColumn("perspective", F.col("speaker"))).withColumn("start", F.lit(0).cast("long"))
    both = placed.unionByName(alone, allowMissingColumns=True)
    return both.select(*key, "turn", "speaker", "role", "name", "segment", "start", "length", (F.col("start") + F.col("length") - F.col("mask_length")).alias("mask_start"), "mask_length")


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from each participant's perspective."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = r"""
with m as (select conv_id, turn::bigint turn, coalesce(nullif(trim(role), ''), 'unknown') speaker, coalesce(text, '') text from conversations),
p as (select distinct conv_id, speaker perspective from m where speaker <> 'system'),
x as (select p.conv_id, perspective, turn, speaker, text, case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end role
  from p join m on m.conv_id = p.conv_id),
r as (select *, case when role = 'user' then speaker end as name, case when role = 'user' then '<|user name=' || speaker || '|>' else '<|' || role || '|>' end || chr(10) || text || '<|end|>' || chr(10) segment,
  case when role = 'assistant' then length(text) + 8 else 0 end::bigint mask_length from x),
s as (select *, length(segment)::bigint length, coalesce(sum(length(segment)) over (partition by conv_id, perspective order by turn nulls first, speaker, text rows between unbounded preceding and 1 preceding), 0)::bigint start from r)
select conv_id, perspective, turn, speaker, role, name, segment, start, length, start + length - mask_length mask_start, mask_length from s
"""
