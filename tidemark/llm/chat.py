"""Chat formatting: a dialogue from every participant's point of view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

#: Messages of one rendered piece; a longer conversation becomes several rows.
PIECE_MESSAGES = 64


def escaped(text: Column | str) -> Column:
    """Text in which no control string stands: <|im_ becomes <|_im_, <|_im_ becomes <|__im_, and so on."""
    return F.regexp_replace(text, r"<\|(_*)im_", "<|_$1im_")


def placed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, speaker, content, times, first: distinct messages and the place of their first copy.

    Places count a conversation's messages from 0, by turn, then speaker, then
    text. Equal messages are counted before anything is sorted; the rest is
    dealt into ranges of the whole order, so that a conversation of any length
    lies in many tasks: a place is the sum of what earlier ranges and earlier
    rows of its own range hold.
    """
    base = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("speaker"), F.coalesce(text, F.lit("")).alias("content"))
    order = ["turn", "speaker", "content"]
    rows = base.groupBy("conv_id", *order).agg(F.count(F.lit(1)).alias("times")).repartitionByRange("conv_id", *order)
    rows = stored(rows.withColumn("range", F.spark_partition_id()), "chat-messages")
    held = rows.groupBy("conv_id", "range").agg(F.sum("times").alias("held"))
    before = held.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), (F.sum("held").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("held")).alias("before"))
    within = F.sum("times").over(Window.partitionBy("conv_id", "range").orderBy(*order)) - F.col("times")
    rows = rows.withColumn("within", within).join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return rows.select("conv_id", *order, "times", (F.col("before") + F.col("within")).alias("first"))


def pieces(turns: DataFrame, size: int = PIECE_MESSAGES, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, piece, m: each piece's messages in order, as speaker, name and shown (both escaped)."""
    rows = placed(turns, conv, turn, role, text)
    last = F.col("first") + F.col("times") - 1
    rows = rows.select("*", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(last / size))).alias("piece"))
    copies = F.least(last, F.col("piece") * size + size - 1) - F.greatest(F.col("first"), F.col("piece") * size) + 1
    name = escaped(F.regexp_replace("speaker", r"[\r\n]", " "))
    message = F.struct("first", "speaker", name.alias("name"), escaped("content").alias("shown"), copies.cast("int").alias("copies"))
    made = rows.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(message)).alias("m"))
    return made.select("conv_id", "piece", F.flatten(F.transform("m", lambda x: F.array_repeat(F.struct(x["speaker"], x["name"], x["shown"]), x["copies"]))).alias("m"))


def message(role: Column, shown: Column) -> tuple[Column, Column]:
    """A message in ChatML form: what comes before the content, and the content with its end mark."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n")), F.concat(shown, F.lit("<|im_end|>"))


def perspectives(turns: DataFrame, size: int = PIECE_MESSAGES, **names: str) -> DataFrame:
    """Dialogues: conv_id, perspective, piece, n_messages, n_targets, system, dialogue, mask.

    One row for each participant of a conversation and each `size` messages of
    it. perspective is the participant who speaks as assistant; others become
    named users, and `system` turns stay system turns for everyone and are no
    participant's. mask lists the [start, end) character ranges of dialogue
    that the perspective speaks, end marks included: `s-e` joined by commas.

    Messages are ordered by turn, then speaker, then text; piece i holds those
    from place i * size on, whatever their turns' numbers. Joined in order, a
    perspective's pieces are the whole dialogue, and ranges move by the lengths
    of the pieces before. system is empty in piece 0; in later ones it has the
    system messages that the conversation begins with (those of piece 0), to be
    put before the dialogue where pieces are used apart.

    A null role is a participant without a name, apart from one called
    anything; its perspective is null. A null text is empty, a null
    conversation is one conversation, a null turn comes first, repeated rows
    stay. Control strings in texts and names are escaped (escaped()), line ends
    in names become spaces. A conversation with system turns only has no
    perspective and no row. Messages are shuffled before they are rendered, not
    once for each participant; the output has turns times participants.
    """
    made = stored(pieces(turns, size, **names), "chat-pieces")
    is_system = lambda x: x["speaker"].eqNullSafe(F.lit("system"))
    end = F.array_position(F.transform("m", is_system), False)
    begin = F.slice("m", 1, F.when(end == 0, F.size("m")).otherwise(end - 1).cast("int"))
    lead = F.array_join(F.transform(begin, lambda x: F.concat(*message(F.lit("system"), x["shown"]), F.lit("\n"))), "")
    longer = made.filter("piece = 1").select(F.col("conv_id").alias("lc"))
    leads = made.filter("piece = 0").join(longer, F.col("conv_id").eqNullSafe(F.col("lc")), "left_semi").select(F.col("conv_id").alias("lc"), lead.alias("lead"))
    people = made.select("conv_id", F.explode(F.array_distinct(F.transform("m", lambda x: x["speaker"]))).alias("who")).filter("who IS NULL OR who <> 'system'").distinct()
    people = people.join(leads, people["conv_id"].eqNullSafe(leads["lc"]), "left").select(F.col("conv_id").alias("c"), "who", "lead")
    people = stored(people, "chat-people")  # so that the pieces of a very long conversation can be dealt to several tasks

    def rendered(x: Column, who: Column) -> Column:
        own = x["speaker"].eqNullSafe(who)
        role = F.when(is_system(x), "system").when(own, "assistant").when(x["speaker"].isNull(), "user").otherwise(F.concat(F.lit("user name="), x["name"]))
        head, body = message(role, x["shown"])
        return F.struct(own.alias("own"), F.char_length(head).alias("head"), F.char_length(body).alias("body"), F.concat(head, body, F.lit("\n")).alias("text"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["head"]
        span = F.concat(begin.cast("string"), F.lit("-"), (begin + x["body"]).cast("string"))
        return F.struct((acc["at"] + x["head"] + x["body"] + 1).alias("at"), F.when(x["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    both = made.join(people, made["conv_id"].eqNullSafe(people["c"]))
    both = both.select("conv_id", "who", "piece", "lead", F.transform("m", lambda x: rendered(x, F.col("who"))).alias("r"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return both.select(
        "conv_id",
        F.col("who").alias("perspective"),
        "piece",
        F.size("r").cast("long").alias("n_messages"),
        F.size(F.filter("r", lambda x: x["own"])).cast("long").alias("n_targets"),
        F.when(F.col("piece") == 0, "").otherwise(F.coalesce("lead", F.lit(""))).alias("system"),
        F.array_join(F.transform("r", lambda x: x["text"]), "").alias("dialogue"),
        F.array_join(F.aggregate("r", start, step)["spans"], ",").alias("mask"),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH b AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS content FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker NULLS FIRST, content NULLS FIRST) - 1 AS pos,
      regexp_replace(regexp_replace(speaker, '[\r\n]', ' ', 'g'), '<\|(_*)im_', '<|_\1im_', 'g') AS name, regexp_replace(content, '<\|(_*)im_', '<|_\1im_', 'g') AS shown FROM b),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM b WHERE speaker IS DISTINCT FROM 'system'),
h AS (SELECT conv_id, string_agg('<|im_start|>system' || chr(10) || shown || '<|im_end|>' || chr(10), '' ORDER BY pos) AS lead FROM
      (SELECT *, min(CASE WHEN speaker IS DISTINCT FROM 'system' THEN pos END) OVER (PARTITION BY conv_id) AS talk FROM n) WHERE pos < talk AND pos < 64 GROUP BY conv_id),
r AS (SELECT n.conv_id, perspective, pos, pos // 64 AS piece, speaker IS NOT DISTINCT FROM perspective AS target,
      '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker IS NOT DISTINCT FROM perspective THEN 'assistant' WHEN speaker IS NULL THEN 'user' ELSE 'user name=' || name END || chr(10) AS head,
      shown || '<|im_end|>' AS body FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, (sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, piece ORDER BY pos) - length(body) - 1)::BIGINT AS a FROM r)
SELECT s.conv_id, perspective, piece, count(*) AS n_messages, count(*) FILTER (target) AS n_targets, CASE WHEN piece = 0 THEN '' ELSE coalesce(any_value(lead), '') END AS system,
       string_agg(head || body || chr(10), '' ORDER BY pos) AS dialogue, coalesce(string_agg(a::VARCHAR || '-' || (a + length(body))::VARCHAR, ',' ORDER BY pos) FILTER (target), '') AS mask
FROM s LEFT JOIN h ON s.conv_id IS NOT DISTINCT FROM h.conv_id GROUP BY s.conv_id, perspective, piece
"""
