"""Chat formatting: multi-party perspective rotation (DataFrame operations only).

Each dialogue is rendered once for every participant: that speaker's turns are
the assistant's and are trained on, all others are users with a name, system
turns stay as they are. A dialogue of ordinary length is one row for each
perspective. A longer one is cut into parts of `part_messages` in the order of
its messages, so that its parts, joined in the order of their numbers, are the
whole rendering. Messages are ordered by a range partitioning over all keys,
which splits a hot dialogue, and a hot turn, like any others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import _store


@dataclass(frozen=True)
class DialogueRules:
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    #: Role of turns that belong to no participant.
    system: str = "system"
    #: Messages of a part; a dialogue of more is cut.
    part_messages: int = 512


def ordered(messages: DataFrame) -> DataFrame:
    """Distinct messages (conv_id, turn, role, text) and their places from 0 in their dialogues, by turn (null first), role, text.

    Rows are range-partitioned and sorted; a place is that in its own partition
    plus the counts of the dialogue in the partitions before it. Only those
    counts, a row for each dialogue and partition, are summed by dialogue.
    """
    keys = ["conv_id", "turn", "role", "text"]
    at = F.monotonically_increasing_id()
    rows = messages.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at)
    rows = _store.stored(rows, "messages").withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = _store.stored(counts.select("conv_id", "_range", "_first", "_before"), "ranges")
    same = F.col("r._range").eqNullSafe(F.col("c._range")) & F.col("r.conv_id").eqNullSafe(F.col("c.conv_id"))
    return rows.alias("r").join(counts.alias("c"), same).select(*[f"r.{k}" for k in keys], (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"))


def rotate(dialogues: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rules: DialogueRules = DialogueRules()) -> DataFrame:
    """conv_id, perspective, part, first_turn, n_messages, text, masks (spans of code points to train on).

    Messages are ordered by turn, then role, then text; a null turn comes first.
    Fully repeated rows are one message. A null role speaks as "unknown"; a null
    text is empty; rows of a null conv_id are one dialogue. The participants of
    a dialogue are its roles but the system's; one without any has no rows.
    Markers inside texts are broken by a space, so they cannot open or close a
    turn. part counts from 0 the runs of `part_messages` messages of a dialogue:
    its texts, joined by part, are the rendering of the whole. A span lies in
    its own part and covers a message of the perspective with its end marker.
    The result has a row for each part and participant, as the method asks.
    """
    broken = F.coalesce(F.col(text), F.lit(""))
    for marker in (rules.begin, rules.end):
        broken = F.replace(broken, F.lit(marker), F.lit(f"{marker[:1]} {marker[1:]}"))
    messages = ordered(
        dialogues.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), broken.alias("text"))
    )
    speakers = messages.where(F.col("role") != rules.system).select("conv_id", F.col("role").alias("perspective")).distinct()
    parts = messages.groupBy("conv_id", F.floor(F.col("place") / rules.part_messages).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("place", "turn", "role", "text"))).alias("_m")
    )
    # parts are whole before the participants come in, so the join may deal out those of a hot dialogue to many tasks
    turns = parts.alias("p").join(speakers.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select("p.*", "s.perspective")
    heads = (
        f"transform(_m, m -> struct(concat('{rules.begin}', case when m.role = '{rules.system}' then m.role when m.role = perspective then 'assistant' "
        f"else concat('user name=', m.role) end, '\n') as head, concat(m.text, '{rules.end}') as body, m.role = perspective as trained))"
    )
    spans = F.expr(
        "aggregate(_said, struct(0L as at, cast(array() as array<struct<begin:bigint,stop:bigint>>) as spans), (s, m) -> struct("
        "s.at + length(m.head) + length(m.body) + 1 as at, "
        "if(m.trained, concat(s.spans, array(struct(s.at + length(m.head) as begin, s.at + length(m.head) + length(m.body) as stop))), s.spans) as spans)).spans"
    )
    return turns.withColumn("_said", F.expr(heads)).select(
        "conv_id", "perspective", "part", F.expr("_m[0].turn").alias("first_turn"), F.size("_m").cast("long").alias("n_messages"),
        F.expr("array_join(transform(_said, m -> concat(m.head, m.body, '\n')), '')").alias("text"), spans.alias("masks"),
    )


#: DuckDB SQL for the registered query.
ORACLE = r"""
with messages as (
  select distinct conv_id, cast(turn as bigint) as turn, coalesce(role, 'unknown') as role,
    replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') as body
  from conversations),
dealt as (
  select *, (row_number() over (partition by conv_id order by turn nulls first, role, body) - 1) // 512 as part from messages),
speakers as (select distinct conv_id, role as perspective from messages where role <> 'system'),
turns as (
  select d.*, perspective, role = perspective as trained,
    '<|im_start|>' || case when role = 'system' then role when role = perspective then 'assistant' else 'user name=' || role end || chr(10) as head,
    body || '<|im_end|>' as tail
  from dealt d join speakers s on d.conv_id is not distinct from s.conv_id),
placed as (
  select *, sum(length(head) + length(tail) + 1) over (partition by conv_id, perspective, part order by turn nulls first, role, body rows unbounded preceding)
    - length(tail) - 1 as begins from turns)
select conv_id, perspective, cast(part as bigint) as part, first(turn order by begins) as first_turn, count(*) as n_messages,
  sha256(string_agg(head || tail || chr(10), '' order by turn nulls first, role, body)) as text_sha256,
  cast(sum(length(head) + length(tail) + 1) as bigint) as n_chars,
  coalesce(string_agg(case when trained then cast(begins as bigint) || ':' || cast(begins + length(tail) as bigint) end, ',' order by begins), '') as masks
from placed group by conv_id, perspective, part
"""
