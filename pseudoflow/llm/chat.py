"""Chat formatting: collapse cumulative snapshots, then render the conversations that remain.

Logs often hold a conversation once per turn, each log a prefix of the next.  A rolling hash over the
turns gives each prefix a key.  A conversation whose whole key is that of a proper prefix of another one
is dropped (more rows have the key than whole conversations); of equal conversations the one with the
smallest id stays.

One conversation may hold a large part of all rows.  The turns are cut into slices by their whole order, so
a conversation may span many; each slice is numbered and hashed for itself, and the counts and hashes of
earlier slices are carried over.  A slice goes on with at most one conversation of the slices before it, so
what is carried over has fewer rows than there are slices.  Texts are not sorted again after that: numbers
and hashes are made from digests.  Hashes are joined by exclusive or, which can't overflow.  Only turns that
agree in conversation, turn, role and the first ``CUT`` characters of the text can't be cut apart.

Defined cases: turns are taken in the order (turn, role, text), nulls first; rows that agree in all four
columns count once; null role and text count as empty; rows with a null conversation id form one
conversation; a conversation of more than ``part_turns`` turns is rendered in several parts, so no row
grows with the log; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pseudoflow.llm.common import written

#: Three lanes of 64 bits; a turn's position is hashed in, so the order counts.
LANES = ("h1", "h2", "h3")
KEY = ["pos", *LANES]
#: Characters of a text that take part in the bounds of slices, which the driver samples.
CUT = 200


def in_slices(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Written: conv_id, role, text, the turn's digests, its slice and a number that counts up by one inside a slice."""
    rows = turns.select(
        turns[conv].alias("conv_id"), turns[turn].alias("turn"),
        F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"),
    ).distinct()
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, CUT)).sortWithinPartitions("conv_id", "turn", "role", "text")
    digests = [F.xxhash64(F.lit(k), "role", "text").alias(name) for k, name in enumerate(LANES)]
    numbers = [F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("number")]
    return written(rows.select("conv_id", "role", "text", *digests, *numbers), "turns")


def pieces_of(rows: DataFrame) -> DataFrame:
    """Written: one row per conversation and slice: its first number and how many turns earlier slices hold (``before``)."""
    pieces = rows.groupBy("conv_id", "slice").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return written(pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "pieces")


def _carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """``rows`` left-joined with a table of fewer rows than there are slices."""
    keys = carried.withColumnsRenamed({"conv_id": "of", "slice": "of_slice"})
    on = rows["conv_id"].eqNullSafe(keys["of"]) & (rows["slice"] == keys["of_slice"])
    return rows.join(F.broadcast(keys), on, "left").drop("of", "of_slice")


def prefixes(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """conv_id, pos (from 1) and the rolling hash of the turns up to this one; needs ``in_slices`` and ``pieces_of``."""
    later = pieces.where("before > 0").select("conv_id", "slice", "before")
    inside = Window.partitionBy("conv_id", "slice").orderBy("number")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = _carried(rows.select("conv_id", "slice", "number", *LANES), later)
    local = local.withColumn("pos", F.row_number().over(inside) + F.coalesce("before", F.lit(0)))
    local = local.select("conv_id", "slice", "pos", *[F.bit_xor(F.xxhash64("pos", name)).over(so_far).alias(name) for name in LANES])
    local = written(local, "prefixes")

    spread = later.select(F.col("conv_id").alias("of")).distinct()
    ends = local.join(F.broadcast(spread), local["conv_id"].eqNullSafe(spread["of"]), "left_semi")
    ends = ends.groupBy("conv_id", "slice").agg(F.max(F.struct(*KEY)).alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    hashes = ends.select("conv_id", "slice", *[F.bit_xor(f"last.{x}").over(earlier).alias(f"{x}_before") for x in LANES])
    hashes = written(hashes.where("h1_before is not null"), "carried")
    whole = [F.col(x).bitwiseXOR(F.coalesce(f"{x}_before", F.lit(0))).alias(x) for x in LANES]
    return _carried(local, hashes).select("conv_id", "pos", *whole)


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one begins with; needs ``prefixes``."""
    last = F.max(F.struct(*KEY)).alias("last")
    whole = rows.groupBy("conv_id").agg(last).select("conv_id", *[F.col(f"last.{x}").alias(x) for x in KEY])
    same = whole.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    # a conversation has one row of a length: more rows than whole conversations are proper prefixes
    held = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"))
    return same.join(held, KEY).where("n_rows = n_copies").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           part_turns: int = 512) -> DataFrame:
    """conv_id, part (from 0), n_turns and n_copies of the whole conversation, and the part's text.

    The parts of a conversation, put together in order, are its text.  Turn marks inside a turn's text are
    broken by a space, so that they can't be taken for real ones."""
    rows = in_slices(turns, conv, turn, role, text)
    pieces = pieces_of(rows)
    stay = written(maximal(prefixes(rows, pieces)), "maximal").withColumnRenamed("conv_id", "of")
    kept = pieces.join(stay, pieces["conv_id"].eqNullSafe(stay["of"]))
    kept = kept.select("of", F.col("slice").alias("of_slice"), "first", "before", "n_turns", "n_copies")
    plain = lambda c: F.replace(F.col(c), F.lit("<|im_"), F.lit("<| im_"))
    turn_text = F.concat(F.lit("<|im_start|>"), plain("role"), F.lit("\n"), plain("text"), F.lit("<|im_end|>\n"))
    # by slice too, so that no task has all turns of a conversation
    mine = rows.select("conv_id", "slice", "number", "role", "text").join(kept, rows["conv_id"].eqNullSafe(kept["of"]) & (rows["slice"] == kept["of_slice"]))
    mine = mine.withColumn("pos", (F.col("number") - F.col("first") + F.col("before") + 1))
    part = F.floor((F.col("pos") - 1) / part_turns).cast("int")
    parts = mine.groupBy("conv_id", part.alias("part"), F.col("n_turns").cast("int").alias("n_turns"), "n_copies").agg(
        F.sort_array(F.collect_list(F.struct("pos", turn_text.alias("t")))).alias("ts")
    )
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("ts.t"), "").alias("text"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT conv_id, row_number() OVER w AS pos, role, text FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS ts FROM r GROUP BY conv_id),
p AS (SELECT DISTINCT ts[1:k] AS head FROM c, unnest(generate_series(1, len(ts) - 1)) AS g(k)),
m AS (SELECT min(conv_id) AS conv_id, ts, count(*) AS n_copies FROM c GROUP BY ts),
k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.head = m.ts))
SELECT conv_id, CAST((r.pos - 1) // 512 AS INTEGER) AS part, CAST(any_value(len(k.ts)) AS INTEGER) AS n_turns, any_value(k.n_copies) AS n_copies,
       string_agg('<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_')
                  || '<|im_end|>' || chr(10), '' ORDER BY r.pos) AS text
FROM r JOIN k USING (conv_id) GROUP BY conv_id, (r.pos - 1) // 512
"""
