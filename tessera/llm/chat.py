"""Chat formatting with cumulative-snapshot collapse (operator 1, DataFrame functions only).

Chat logs often store a conversation again after every exchange, so one logged conversation is a
prefix of a longer one.  Each conversation gets rolling hashes of its turn prefixes: turn i adds
two independent 64-bit hashes of (i, role, text), so the prefix hash is a running sum and equal
prefixes have equal sums.  An anti-join of whole conversations (hash, length) against all proper
prefixes of others leaves the maximal ones; of equal conversations the least id stays.  The ones
that stay are rendered, one text for each conversation:

    <|im_start|>role\\ntext<|im_end|>\\n   for every turn, in order

``<|`` inside a role or text is written ``< |``, so that no turn can forge a marker.

Scale: prefixes are made distinct map-side before the join, so a common first turn or many copies
are one row.  A conversation of any length is ranked, summed and rendered in ``block`` consecutive
turn numbers at a time, then over its blocks, so no task holds all turns of a long one.

Nulls and edge cases: turns are ordered by (turn, role, text), nulls first; rows that repeat all
four columns are one turn; null roles and texts equal empty ones; rows with a null conversation
id are one conversation, rendered under the null id; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, prepare, release, table

NAME = "op1_snapshot_chat"


def _safe(c: str) -> Column:
    return F.replace(F.col(c), F.lit("<|"), F.lit("< |"))


def turn_blocks(turns: DataFrame, block: int) -> DataFrame:
    """Distinct turns with their block of turn numbers; null roles and texts become empty."""
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                     F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return t.distinct().withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))


def prefix_hashes(turns: DataFrame, block: int = 256) -> DataFrame:
    """``conv_id, n, h1, h2`` for every prefix (n turns) of every conversation."""
    order = ["turn", "role_key", "text_key"]
    t = turn_blocks(turns, block).select("conv_id", "block", "turn", F.col("role").alias("role_key"), F.col("text").alias("text_key"))
    within = Window.partitionBy("conv_id", "block").orderBy(*order)
    t = t.select("conv_id", "block", F.row_number().over(within).alias("i"),
                 F.xxhash64("role_key", "text_key", F.lit(1)).alias("a"), F.xxhash64("text_key", "role_key", F.lit(2)).alias("b"))
    sizes = t.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    same = lambda x, y: F.expr(f"{x}.conv_id <=> {y}.conv_id and {x}.block = {y}.block")
    # the place of a turn enters its hash, so sums tell orders apart; 62 bits keep sums of turns exact
    placed = (t.alias("t").join(starts.alias("s"), same("t", "s"))
              .select("t.conv_id", "t.block", (F.col("start") + F.col("i")).alias("n"), "a", "b")
              .withColumns({"a": F.xxhash64("n", "a").cast("decimal(38,0)"), "b": F.xxhash64("b", "n").cast("decimal(38,0)")}))
    totals = placed.groupBy("conv_id", "block").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    carried = totals.select("conv_id", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"c{c}") for c in ("ta", "tb")))
    running = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return (placed.select("conv_id", "block", "n", F.sum("a").over(running).alias("a"), F.sum("b").over(running).alias("b")).alias("p")
            .join(carried.alias("c"), same("p", "c"))
            .select("p.conv_id", F.col("n").cast("long").alias("n"), (F.col("a") + F.col("cta")).cast("decimal(38,0)").alias("h1"),
                    (F.col("b") + F.col("ctb")).cast("decimal(38,0)").alias("h2")))


def maximal(turns: DataFrame, block: int = 256) -> DataFrame:
    """``conv_id, n`` of the conversations that are no proper prefix of another; of equal ones the least id."""
    prefixes = materialise(prefix_hashes(turns, block), "prefixes")
    length = prefixes.groupBy("conv_id").agg(F.max("n").alias("size"))
    whole = (prefixes.alias("p").join(length.alias("l"), F.expr("p.conv_id <=> l.conv_id"))
             .select("p.conv_id", "n", "h1", "h2", (F.col("n") == F.col("size")).alias("full")))
    unique = whole.where("full").groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("conv_id"))).alias("k"))
    proper = whole.where(~F.col("full")).select("n", "h1", "h2").distinct()
    out = materialise(unique.join(proper, ["n", "h1", "h2"], "left_anti").select(F.col("k.conv_id").alias("conv_id"), "n"), "maximal")
    release(prefixes)
    return out


def render(turns: DataFrame, block: int = 256) -> DataFrame:
    """``conv_id, text``: the rendered turns of every conversation."""
    line = F.concat(F.lit("<|im_start|>"), _safe("role"), F.lit("\n"), _safe("text"), F.lit("<|im_end|>\n"))
    parts = (turn_blocks(turns, block).groupBy("conv_id", "block")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("x"))
             .select("conv_id", "block", F.array_join(F.col("x.line"), "").alias("part")))
    return (parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("x"))
            .select("conv_id", F.array_join(F.col("x.part"), "").alias("text")))


def chat_texts(turns: DataFrame, block: int = 256) -> DataFrame:
    """``conv_id, n_turns, text`` of every maximal conversation."""
    keep = maximal(turns, block)
    chosen = turns.alias("t").join(keep.alias("k"), F.expr("t.conv_id <=> k.conv_id"), "left_semi")
    return (render(chosen, block).alias("r").join(keep.alias("k"), F.expr("r.conv_id <=> k.conv_id"))
            .select("r.conv_id", F.col("k.n").alias("n_turns"), "r.text"))


def query(spark, sf_dir):
    prepare(spark)
    return chat_texts(table(spark, sf_dir, "conversations"))


# The same by comparing the turn lists themselves: every conversation against all proper prefixes.
ORACLE_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (
  SELECT conv_id, row_number() OVER w AS n, list({'role': role, 'text': text}) OVER w AS turns,
         count(*) OVER (PARTITION BY conv_id) AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
whole AS (SELECT min(conv_id) AS conv_id, n, turns FROM p WHERE n = size GROUP BY n, turns),
proper AS (SELECT DISTINCT turns FROM p WHERE n < size)
SELECT conv_id, n AS n_turns,
       array_to_string(list_transform(turns, lambda x: '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10)
                       || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS text
FROM whole WHERE turns NOT IN (SELECT turns FROM proper)
"""
