"""The prefix trie of conversations, rolled up by bands of depth.

Every node is a distinct sequence of first turns. Depths are cut into bands of a
fixed height; a node knows the path from its band's root to itself and adds its
values to the ancestors on that path alone. Band roots form a trie of their own,
``height`` times as shallow, which is rolled up the same way; their completed
totals then go to the nodes of the band above. So a node explodes to at most
``height`` ancestors, and the rounds grow with the logarithm of the depth.

A prefix is named by 128 bits: two xors over hashes of (depth, role, text) of its
turns, which lets every turn be hashed by itself and prefixes be combined in any
split of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.llm.tables import cut

WORD = r"[^\x20\x09-\x0D]+"
FAMILY = 20  # conversations whose first turns come from the same one
TURNS = 4096  # turn numbers that are ordered in one task
IDS = 1024  # conversation ids that are joined to one text in one task
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = "struct<a:bigint,b:bigint>"


def _root() -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))


def _xor(x: Column, y: Column) -> Column:
    return F.struct(x["a"].bitwiseXOR(y["a"]).alias("a"), x["b"].bitwiseXOR(y["b"]).alias("b"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, stretch, place, turn_key, words``: the order of turns inside stretches of turn numbers.

    Turns ascend by number, null first, ties by role and text. A conversation of
    any length is spread over its stretches.
    """
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("stretch", F.expr(f"turn div {TURNS}"))
    order = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select(
        "conv_id", "stretch", F.row_number().over(order).alias("place"),
        F.struct(F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("b"), "role", "text").alias("b")).alias("turn_key"),
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: their turns ``conv_id, depth, turn_key, words``, and ``conv_id, length`` of each."""
    same = [F.col("t.conv_id") == F.col("s.conv_id"), F.col("t.stretch").eqNullSafe(F.col("s.stretch"))]
    earlier = Window.partitionBy("conv_id").orderBy(F.col("stretch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    stretches = turns.groupBy("conv_id", "stretch").agg(F.count("*").alias("n")).select(
        "conv_id", "stretch", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    first = turns.filter((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("place") <= 3)).alias("t").join(
        stretches.alias("s"), same).select("t.conv_id", (F.col("before") + F.col("place")).alias("at"), "turn_key", "words")
    heads = first.filter("at <= 3").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "turn_key", "words"))).alias("head"))  # three turns at most
    whole = stretches.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns({
        "base": F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY)),
        "h": F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")})
    none = F.array().cast("array<struct<at:bigint,turn_key:" + KEY + ",words:bigint>>")
    whole = whole.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").select(
        "conv_id", "n", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h")), none).alias("head"))
    length = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    whole = whole.select("conv_id", "h", "head", length.cast("bigint").alias("length"))
    shifts = stretches.join(whole, "conv_id").select(
        "conv_id", "stretch", "before", "h", "length", F.size("head").alias("taken"))
    own = turns.alias("t").join(shifts.alias("s"), same).withColumn("at", F.col("before") + F.col("place")).filter("at > h").select(
        "t.conv_id", (F.col("taken") + F.col("at") - F.col("h")).cast("bigint").alias("depth"), "length", "turn_key", "words")
    given = whole.select("conv_id", "length", F.posexplode("head").alias("k", "turn")).select(
        "conv_id", (F.col("k") + 1).cast("bigint").alias("depth"), "length", "turn.turn_key", "turn.words")
    return given.unionByName(own), whole.select("conv_id", "length")


def prefixes(turns: DataFrame, lengths: DataFrame, height: int) -> DataFrame:
    """``conv_id, depth, length, words, path`` of every prefix of every conversation, the textless one included.

    ``path`` holds the keys from the band's root, the last depth divisible by
    ``height`` before this one, to the prefix itself.
    """
    tagged = turns.select("conv_id", "length", "words", "depth", F.expr(f"(depth - 1) div {height}").alias("band"), F.struct(
        F.xxhash64(F.lit(1), "depth", "turn_key").alias("a"), F.xxhash64(F.lit(2), "depth", "turn_key").alias("b")).alias("x"))
    parts = tagged.groupBy("conv_id", "band").agg(
        F.first("length").alias("length"), F.array_sort(F.collect_list(F.struct("depth", "words", "x"))).alias("turns"))  # height turns
    upto = lambda k: F.aggregate(F.slice("turns", F.lit(1), k), _root(), lambda s, t: _xor(s, t["x"]))
    parts = parts.select("conv_id", "band", "length", "turns", F.transform(F.sequence(F.lit(1), F.size("turns")), upto).alias("inner"))
    above = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    head = F.struct(*[F.coalesce(F.bit_xor(F.element_at("inner", -1)[c]).over(above), F.lit(0)).alias(c) for c in "ab"])
    parts = parts.withColumn("head", head).withColumn(
        "keys", F.concat(F.array("head"), F.transform("inner", lambda p: _xor(p, F.col("head")))))
    found = parts.select("conv_id", "length", "keys", F.posexplode("turns").alias("k", "turn")).select(
        "conv_id", "turn.depth", "length", "turn.words", F.slice("keys", F.lit(1), F.col("k") + 2).alias("path"))
    tops = lengths.select("conv_id", F.lit(0).cast("bigint").alias("depth"), "length", F.lit(0).cast("bigint").alias("words"),
                          F.array(_root()).alias("path"))
    return found.unionByName(tops)


def trie_nodes(found: DataFrame) -> DataFrame:
    """``key, depth, path, conv_id, n_convs, leaves, saved``: every node once, with its own values."""
    grouped = found.groupBy(F.element_at("path", -1).alias("key")).agg(
        F.first("depth").alias("depth"), F.first("path").alias("path"), F.first("words").alias("words"),
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.count_if(F.col("depth") == F.col("length")).alias("n_ends"))
    return grouped.select(
        "key", "depth", "path", "conv_id", "n_convs",
        (F.col("n_ends") == F.col("n_convs")).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))


def _band_paths(chains: DataFrame, height: int) -> DataFrame:
    """``key, depth, path`` of every node on the chains ``conv_id, depth, key``, which include the root."""
    band = F.expr(f"(depth - 1) div {height}")
    # a band's root stands in its own band as the last and in the next one as the first
    bands = F.when(F.col("depth") % height == 0, F.array_distinct(F.array(band, F.expr(f"depth div {height}")))).otherwise(F.array(band))
    parts = chains.withColumn("band", F.explode(bands)).groupBy("conv_id", "band").agg(
        F.array_sort(F.collect_list(F.struct("depth", "key"))).alias("steps"))  # height + 1 steps
    spread = parts.select("band", F.transform("steps", lambda s: s["key"]).alias("keys"), F.posexplode("steps").alias("k", "step"))
    spread = spread.filter((F.col("k") > 0) | (F.col("step.depth") == 0)).select(
        "step.key", "step.depth", F.slice("keys", F.lit(1), F.col("k") + 1).alias("path"))
    return spread.groupBy("key").agg(F.first("depth").alias("depth"), F.first("path").alias("path"))


def rolled_up(nodes: DataFrame, chains: DataFrame, deepest: int, height: int) -> DataFrame:
    """``key, leaves, saved`` summed over the subtree of every node, itself included.

    ``nodes`` are ``key, depth, path, leaves, saved``; ``chains`` are ``conv_id,
    depth, key`` of the band roots, needed where there is more than one band.
    """
    values = ["leaves", "saved"]
    steps = nodes.select(*values, F.posexplode("path").alias("k", "up"))
    sums = steps.groupBy(F.col("up").alias("key")).agg(
        *[F.sum(F.when(F.col("k") > 0, F.col(c)).otherwise(0)).alias(c) for c in values],
        *[F.sum(F.when(F.col("k") == 0, F.col(c)).otherwise(0)).alias(f"under_{c}") for c in values])
    if deepest <= height:
        return sums.select("key", *[(F.col(c) + F.col(f"under_{c}")).alias(c) for c in values])
    sums = cut(sums)
    roots = _band_paths(chains, height).join(sums, "key").select(
        "key", "depth", "path", *[F.col(f"under_{c}").alias(c) for c in values])
    higher = chains.filter(F.col("depth") % height == 0).withColumn("depth", F.expr(f"depth div {height}"))
    totals = cut(rolled_up(cut(roots), higher, deepest // height, height))
    below = nodes.filter(F.col("depth") % height == 0).select("key", "path", "depth").join(totals, "key")
    # a band root hands its completed total to its band and itself, the root of all only to itself
    handed = below.select(*values, "depth", F.posexplode("path").alias("k", "key")).filter("k > 0 or depth = 0")
    return sums.select("key", *values).unionByName(handed.select("key", *values)).groupBy("key").agg(
        *[F.sum(c).alias(c) for c in values])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sha256 of the texts of every key, which follow one another; one running hash is all that is held."""
    now, running = None, None
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if (a, b) != now:
                if now:
                    done.append((*now, running.hexdigest()))
                now, running = (a, b), hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["a", "b", "ends_sha256"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, running.hexdigest())], names=["a", "b", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the sha256 of the ascending ids of the conversations that end at each node.

    Ids are joined to texts of at most ``IDS`` first, so a node where very many
    conversations end costs its task a stream of such texts.
    """
    texts = ends.groupBy("key", F.expr(f"conv_id div {IDS}").alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ranged = texts.select("key.a", "key.b", "part", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "part")
    found = ranged.mapInArrow(_digest, "a bigint, b bigint, ends_sha256 string")
    return found.select(F.struct("a", "b").alias("key"), "ends_sha256")


def prefix_trie(conversations: DataFrame, height: int = 4) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, with counts over its subtree.

    A conversation ``c`` takes its first turns from the conversation whose id is
    the multiple of 20 at or below ``c``, as many as the crc32 of its id says (0
    to 3, or as many as there are), and goes on with its own turns after these.
    A null role or text is empty; rows without ``conv_id`` belong to no
    conversation and are left out; repeated rows are turns of their own. Without
    conversations there is no root and no row. Other columns are left behind.
    ``height`` bounds what a node explodes to and changes no result.
    """
    if height < 2:
        raise ValueError("a band has a height of two or more")
    turns, lengths = rebuilt(cut(ordered_turns(conversations)))
    lengths = cut(lengths)
    found = cut(prefixes(turns, lengths, height))
    nodes = cut(trie_nodes(found))
    deepest = lengths.agg(F.max("length")).first()[0] or 0
    key = F.element_at("path", -1)
    chains = found.filter(F.col("depth") % height == 0).select("conv_id", F.expr(f"depth div {height}").alias("depth"), key.alias("key"))
    totals = rolled_up(nodes.select("key", "depth", "path", "leaves", "saved"), chains, deepest, height)
    ends = end_digests(found.filter("depth = length").select(key.alias("key"), "conv_id"))
    parent = F.when(F.col("depth") > 0, F.element_at("path", -2))
    children = nodes.filter("depth > 0").groupBy(parent.alias("key")).agg(F.count("*").alias("n_children"))
    whole = nodes.select("key", parent.alias("up"), "conv_id", "depth", "n_convs").join(totals, "key").join(
        children, "key", "left").join(ends, "key", "left")
    # the children of one node share a key here; the other side has it once, so a frequent one can be split
    named = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(named, "up", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
