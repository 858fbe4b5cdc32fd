"""Multi-party perspective rotation of dialogues, with DataFrame functions alone.

For every participant the dialogue is rendered with that speaker as assistant and the others as named users; the mask
marks what the assistant says. Dialogues are rendered in chunks of turn numbers, so a dialogue of any length is never
gathered in one row or task; one whose turns are numbered from 0 to ``chunk_turns`` - 1 is a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rotate(turns: DataFrame, chunk_turns: int = 64, system: str = "system") -> DataFrame:
    """conv_id, speaker, chunk, part, n_turns, rendered, mask (array of start, end in characters of rendered).

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns go by turn (nulls last), then role, then
    text; repeated rows are repeated turns. A null role speaks as 'unknown', a null text is empty. System turns stay
    system turns and are no participant, so a dialogue of system turns alone has no row. Chunk is turn divided by
    ``chunk_turns``, rounded down; turns numbered across its multiples thus lie in several chunks, and null turns in the
    last of all. More rows than that in a chunk (repeated turns) go on in further parts. Markers within texts and
    names are broken up by a space, line breaks in names become spaces.
    """
    clean = lambda c: F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "< |$1| >")
    rows = turns.select(
        "conv_id",
        "turn",
        F.expr(f"(coalesce(turn, 9223372036854775807L) - pmod(coalesce(turn, 9223372036854775807L), {chunk_turns}L)) div {chunk_turns}L").alias("chunk"),
        F.regexp_replace(clean(F.coalesce("role", F.lit("unknown"))), r"[\r\n]", " ").alias("role"),
        clean(F.coalesce("text", F.lit(""))).alias("text"),
    )
    order = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    placed = rows.withColumn("at", F.row_number().over(order) - 1).withColumn("part", F.floor(F.col("at") / chunk_turns))
    chunks = placed.groupBy("conv_id", "chunk", "part").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    speakers = rows.filter(F.col("role") != system).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    met = chunks.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))
    own = lambda t: t["role"] == F.col("speaker")
    name = lambda t: F.when(own(t), "assistant").when(t["role"] == system, "system").otherwise(F.concat(F.lit("user name="), t["role"]))
    head = lambda t: F.concat(F.lit("<|im_start|>"), name(t), F.lit("\n"))
    said = F.transform("turns", lambda t: F.struct(own(t).alias("own"), head(t).alias("head"), F.concat(t["text"], F.lit("<|im_end|>")).alias("body")))
    met = met.select("conv_id", "speaker", "chunk", "part", said.alias("said"))
    length = lambda s: F.length(s["head"]) + F.length(s["body"]) + 1
    before = lambda i: F.aggregate(F.slice(F.col("said"), F.lit(1), i), F.lit(0), lambda n, s: n + length(s))
    spans = F.transform("said", lambda s, i: F.struct(s["own"].alias("own"), (before(i) + F.length(s["head"])).alias("start"), (before(i) + length(s) - 1).alias("end")))
    return met.select(
        "conv_id",
        "speaker",
        "chunk",
        "part",
        F.size("said").alias("n_turns"),
        F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "").alias("rendered"),
        F.transform(F.filter(spans, lambda s: s["own"]), lambda s: F.struct(s["start"], s["end"])).alias("mask"),
    )
