"""Maximal conversations, rendered as chat text, with DataFrame functions only.

Logs hold cumulative snapshots: a conversation is often logged again with more turns. Turns stand in the order of their
numbers and, under one number, of a hash of their contents; a turn's position is its place in that order, whatever the
numbers are. Every turn has two rolling prefix hashes: the exclusive-or of 64-bit hashes of (position, contents) up to
it. A conversation whose whole hash is a proper prefix of another one goes, by an anti-join of distinct hashes; of
equal ones the smallest id stays.

Equal rows are counted first. Positions come from prefix sums in two levels over ranges of (conversation, number, hash),
so neither a conversation nor a turn number of any size is gathered in one task; hashes run over blocks of `BLOCK`
positions. Texts are shuffled once; those of conversations of more than a block are rendered block by block.

The result has one row a conversation. What a single row can't hold (2 GB) needs part_turns, which cuts longer
conversations into rows of so many turns, numbered by the column part.

Defined cases: rows without conv_id are left out; null roles and texts are empty; null turn numbers come first, as do
numbers that aren't whole; repeated rows are turns of their own; control tokens inside roles and texts are spaced out;
a text of any length is one turn; an empty table gives no conversation; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checked_broadcast, lookup, materialize, ranged, running

#: Positions to a block. It changes the plan, not the result.
BLOCK = 1024
_FIRST = -(1 << 63)


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")


def _rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    tie = F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, 32)
    number = F.coalesce(F.col(turn).try_cast("long"), F.lit(_FIRST))
    return conversations.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("conv_id"), number.alias("turn"), tie.alias("tie"), _plain(r).alias("role"), _plain(t).alias("text"))


def positions(rows: DataFrame) -> DataFrame:
    """conv_id, turn, tie, copies, last and n_turns of every distinct turn of rows: its copies stand at the positions up to last."""
    order = [F.col("turn"), F.col("tie")]
    turns = ranged(rows.groupBy("conv_id", "turn", "tie").agg(F.count("*").alias("copies")), [F.col("conv_id"), *order], "chat-turns")
    placed = running(turns, {"last": F.col("copies")}, order, ["conv_id"])
    sizes = turns.groupBy("conv_id", "range").agg(F.sum("copies").alias("n")).groupBy("conv_id").agg(F.sum("n").alias("n_turns"))
    return lookup(placed.drop("range"), materialize(sizes, "chat-sizes"), "conv_id", "inner")


def prefixes(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n_turns, pos and the two rolling hashes of every turn."""
    each = placed.select("conv_id", "n_turns", "tie", F.explode(F.sequence(F.col("last") - F.col("copies") + 1, F.col("last"))).alias("pos"))
    salted = each.withColumns({"block": F.floor((F.col("pos") - 1) / F.lit(block)).cast("long"), "a": F.xxhash64("pos", "tie"), "b": F.xxhash64("tie", "pos", F.lit("~"))})
    within = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = salted.filter(F.col("n_turns") > block).groupBy("conv_id", "block").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"))
    blocks = blocks.select("conv_id", "block", F.bit_xor("ta").over(ahead).alias("pa"), F.bit_xor("tb").over(ahead).alias("pb"))
    inner = salted.withColumns({"ra": F.bit_xor("a").over(within), "rb": F.bit_xor("b").over(within)})
    out = inner.join(checked_broadcast(materialize(blocks, "chat-blocks")), ["conv_id", "block"], "left")
    united = lambda own, before: F.col(own).bitwiseXOR(F.coalesce(before, F.lit(0)))
    return out.select("conv_id", "n_turns", "pos", united("ra", "pa").alias("x"), united("rb", "pb").alias("y"))


def maximal(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id and n_turns of the conversations that are no prefix of another."""
    every = materialize(prefixes(placed, block), "chat-prefixes")
    last = every.filter("pos = n_turns").groupBy("pos", "x", "y").agg(F.min("conv_id").alias("conv_id"))
    inner = every.filter("pos < n_turns").select("pos", "x", "y").distinct()
    return last.join(inner, ["pos", "x", "y"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def _said(turns: str) -> Column:
    return F.array_join(F.transform(turns, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n"))), "")


def render(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK, part_turns: int | None = None) -> DataFrame:
    """conv_id, n_turns and chat of every maximal conversation; with part_turns a row for so many turns at most, and its number as part."""
    rows = _rows(conversations, conv_id, turn, role, text)
    placed = materialize(positions(rows), "chat-positions")
    stay = materialize(maximal(placed, block), "chat-maximal")
    cut = part_turns or block
    # one group a conversation where a block holds it
    short = lookup(rows, materialize(stay.filter(F.col("n_turns") <= cut), "chat-short"), "conv_id", "inner")
    short = short.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("turn", "tie", "role", "text"))).alias("turns"))
    short = short.select("conv_id", F.lit(0).cast("long").alias("part"), "n_turns", _said("turns").alias("chat"))
    # a group for each block of a longer one; equal rows are one until their positions are known
    ids = stay.filter(F.col("n_turns") > cut)
    long = materialize(ids, "chat-long")
    texts = lookup(rows, long, "conv_id", "inner").groupBy("conv_id", "turn", "tie", "n_turns").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    where = placed.join(checked_broadcast(long.select("conv_id")), "conv_id", "left_semi").drop("n_turns")
    each = texts.join(where, ["conv_id", "turn", "tie"]).withColumn("pos", F.explode(F.sequence(F.col("last") - F.col("copies") + 1, F.col("last"))))
    parts = each.groupBy("conv_id", "n_turns", F.floor((F.col("pos") - 1) / F.lit(cut)).cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    parts = parts.select("conv_id", "part", "n_turns", _said("turns").alias("chat"))
    if part_turns:
        return short.unionByName(parts)
    whole = parts.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("part", "chat"))).alias("p"))
    whole = whole.select("conv_id", "n_turns", F.array_join(F.transform("p", lambda x: x["chat"]), "").alias("chat"))
    return short.drop("part").unionByName(whole)


ORACLE = r"""
with t as (
  select conv_id, r, x, row_number() over (partition by conv_id order by turn nulls first, tie) as pos, count(*) over (partition by conv_id) as n_turns, tie
  from (select conv_id, turn, r, x, substr(sha256(length(r) || ':' || r || x), 1, 32) as tie from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null))
), p as (
  select *, sha256(string_agg(tie, '') over (partition by conv_id order by pos rows unbounded preceding)) as prefix from t
), last as (
  select pos, prefix, min(conv_id) as conv_id from p where pos = n_turns group by pos, prefix
), stay as (
  select conv_id from last where not exists (select 1 from p where p.pos < p.n_turns and p.pos = last.pos and p.prefix = last.prefix)
)
select t.conv_id, n_turns,
  string_agg('<|im_start|>' || regexp_replace(r, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || chr(10) || regexp_replace(x, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || '<|im_end|>' || chr(10), '' order by pos) as chat
from t join stay using (conv_id) group by t.conv_id, n_turns"""
