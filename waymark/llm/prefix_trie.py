"""Operator 12: the trie of conversations' common prefixes, by vertical bitmaps.

Conversations are dealt to shards of consecutive ids, and a shard's turns to blocks of DEPTH positions. In each block
an index maps (position, turn) to the bitset of the shard's conversations that have this turn there. A depth-first
descent intersects the bitset of a node with the postings of the next position: each intersection that is not empty is
a child, its popcount the number of its members in the shard, its lowest bit the smallest of them, and its bits among
the conversations that end there their end list. A block starts from the bitsets of the prefixes that enter it.

Nodes of several shards meet by a key of 128 bits, the exclusive or of a hash of each (position, turn) of their path;
a shard has one row a node, so a prefix that all share is no hot key. What a node's subtree holds is summed over its
members instead of over its descendants, so that a long path costs no more than its turns: a conversation is the
smallest member of all nodes from some depth on, and owes the tokens before that to the nodes on its way; a leaf is
counted by its smallest member.

Running values over a conversation (positions, keys, tokens) go in two levels, over ranges of its rows and then within
one, so that one conversation may hold any share of all turns. An end list's hash is a stream over the shards in order
of their ids: a node that very many conversations end at is one task's work, as SHA-256 has it, in constant memory.

Defined results: conversations are ordered by turn, null first, then by the MD5 of role and text; null role and text
are empty; repeated rows are turns one after the other; rows without a conv_id belong to no conversation; a turn's text
of any length is held only until it is hashed; other columns are not looked at; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import heavy, joined, released, stored

#: Consecutive ids a shard at least (up to SPARSE times as many where there are gaps), and positions a block.
SHARD, SPARSE, DEPTH = 2048, 8, 32
#: Of the contract: a conversation starts with some turns of that whose id is the last multiple of EVERY.
EVERY, MOST = 20, 4
_EMPTY = hashlib.sha256(b"").hexdigest()


def sections(df: DataFrame, key: str, order: list[Column], totals: dict[str, tuple], name: str) -> tuple[DataFrame, DataFrame]:
    """df, stored in ranges of (key, order), and (key, __part, __final, totals before this range): running values in two levels. totals: name to (aggregate, column)."""
    held = stored(df.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()), name)
    parts = held.groupBy(key, "__part").agg(*[f(c).alias(n) for n, (f, c) in totals.items()])
    own = Window.partitionBy(key).orderBy("__part")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    return held, parts.select(key, "__part", F.lead("__part").over(own).isNull().alias("__final"), *[F.coalesce(f(n).over(before), F.lit(0)).alias(f"__{n}") for n, (f, _) in totals.items()])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, code, tokens, times): the turns of all conversations, repeated rows once; code is an MD5 of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", code.alias("code"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"))
    return rows.groupBy("conv", "turn", "code").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("times"))


def positioned(rows: DataFrame) -> DataFrame:
    """(conv, pos, code, tokens): rows of turns() with their place in the conversation, from 1."""
    order = [F.col("turn").asc_nulls_first(), F.col("code").asc()]
    held, starts = sections(rows, "conv", order, {"times": (F.sum, F.col("times"))}, "trie-rows")
    own = Window.partitionBy("conv", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__times") + F.coalesce(F.col("__within"), F.lit(0)) + 1
    placed = held.withColumn("__within", F.sum("times").over(own)).join(starts, ["conv", "__part"])
    return placed.select("conv", F.explode(F.sequence(first, first + F.col("times") - 1)).alias("pos"), "code", "tokens")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, rows): every conversation (conv, h) and the turns (conv, pos, code, tokens) of the rebuilt ones, as the contract has them; both stored."""
    placed = stored(positioned(turns(conversations)), "trie-placed")
    first = F.col("conv") - F.col("conv") % EVERY
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % MOST).cast("long")
    heads = placed.where((F.col("conv") % EVERY == 0) & (F.col("pos") < MOST)).select(F.col("conv").alias("__first"), F.col("pos"), "code", "tokens")
    convs = stored(placed.groupBy("conv").agg(F.max("pos").alias("own")).withColumns({"h": h, "__first": first}), "trie-convs")
    lent = convs.join(heads, "__first").where("pos <= h").select("conv", "pos", "code", "tokens")
    # A conversation that starts another keeps its own first turns, so only those of the others move.
    missing = F.greatest(F.col("h") - F.coalesce(F.col("there"), F.lit(0)), F.lit(0))
    short = convs.join(heads.groupBy("__first").agg(F.max("pos").alias("there")), "__first", "left").where("own > h").select("conv", missing.alias("missing")).where("missing > 0")
    rest = placed.withColumn("h", h).where("pos > h")
    moved = joined(rest, short, ["conv"], heavy(convs.select("conv", F.col("own").alias("n")), "conv"), "left")
    own = moved.select("conv", (F.col("pos") - F.coalesce(F.col("missing"), F.lit(0))).alias("pos"), "code", "tokens")
    rows = stored(lent.unionByName(own), "trie-rebuilt")
    released(placed)
    return convs.select("conv"), rows


_NODES = "k1 long, k2 long, p1 long, p2 long, depth long, n long, conv long, tokens long, before long, shard long, ends binary"


def descend(t: pa.Table) -> pa.Table:
    """The nodes of one block of one shard; t has the shard's turns at its positions, one row for each conversation and position."""
    conv, pos, last = t["conv"].to_numpy(), t["pos"].to_numpy(), t["last"].to_numpy(zero_copy_only=False)
    k1, k2, e1, e2 = (t[c].to_numpy() for c in ("k1", "k2", "e1", "e2"))
    ids, member = np.unique(conv, return_inverse=True)
    first = int(pos.min())
    level = pos - first
    row = np.full((int(level.max()) + 2, ids.size), -1, np.int64)
    row[level, member] = np.arange(pos.size)

    def bits(members: np.ndarray) -> int:
        b = np.zeros(ids.size, np.uint8)
        b[members] = 1
        return int.from_bytes(np.packbits(b, bitorder="little").tobytes(), "little")

    def members(b: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(b.to_bytes((ids.size + 7) // 8, "little"), np.uint8), bitorder="little")[: ids.size])

    # (position, turn) to bitset: turns are equal where both hashes of (position, turn) are.
    order = np.lexsort((member, e2, e1, level))
    head = np.flatnonzero(np.r_[True, (np.diff(level[order]) != 0) | (np.diff(e1[order]) != 0) | (np.diff(e2[order]) != 0)])
    posting, of = [], np.zeros(pos.size, np.int64)
    for i, (a, b) in enumerate(zip(head.tolist(), [*head[1:].tolist(), order.size], strict=True)):
        posting.append(bits(member[order[a:b]]))
        of[order[a:b]] = i
    here = [bits(member[level == d]) for d in range(row.shape[0])]
    ending = [bits(member[(level == d) & last]) for d in range(row.shape[0])]

    entering: dict[tuple[int, int], list[int]] = {}
    at = np.flatnonzero(level == 0)
    for i, x, y in zip(member[at].tolist(), (k1[at] ^ e1[at]).tolist(), (k2[at] ^ e2[at]).tolist(), strict=True):
        entering.setdefault((x, y), []).append(i)
    stack = [(0, bits(np.array(found)), *key) for key, found in entering.items()]
    out, ends = [], []
    while stack:
        d, held, x, y = stack.pop()
        rest = held & here[d]
        while rest:
            r = int(row[d, (rest & -rest).bit_length() - 1])
            child = held & posting[of[r]]
            rest &= ~child
            out.append((r, x, y, child.bit_count()))
            done = child & ending[d]
            ends.append(ids[members(done)].astype("<i8").tobytes() if done else None)
            if child != done and here[d + 1]:
                stack.append((d + 1, child, int(k1[r]), int(k2[r])))
    r, x, y, n = (np.array(c, np.int64) for c in zip(*out, strict=True))
    shard = np.full(r.size, t["shard"][0].as_py(), np.int64)
    tokens = t["tokens"].to_numpy()[r]
    columns = [k1[r], k2[r], x, y, pos[r], n, conv[r], tokens, t["upto"].to_numpy()[r] - tokens, shard]
    return pa.table([*map(pa.array, columns), pa.array(ends, pa.binary())], names=[c.split()[0] for c in _NODES.split(", ")])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's end list; its rows come in order, one shard after the other."""
    key, digest, more = None, None, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["k1", "k2", "sha"])

    for b in batches:
        for x, y, ends in zip(b["k1"].to_pylist(), b["k2"].to_pylist(), b["ends"].to_pylist(), strict=True):
            if (x, y) != key:
                if key:
                    yield row()
                key, digest, more = (x, y), hashlib.sha256(), False
            digest.update((b"," if more else b"") + ",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode())
            more = True
    if key:
        yield row()


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key) of each node; convs names all conversations (conv), rows has their turns (conv, pos from 1 without gaps, code, tokens). Both are read several times."""
    r = convs.agg(F.count(F.lit(1)), F.min("conv"), F.max("conv")).first()
    width = SHARD * min(SPARSE, max(1, (r[2] - r[1] + 1) // r[0])) if r[0] else SHARD
    hashed = rows.withColumns({"e1": F.xxhash64("pos", "code"), "e2": F.xxhash64(F.lit("second"), "pos", "code")}).drop("code")
    held, starts = sections(hashed, "conv", [F.col("pos")], {"x1": (F.bit_xor, F.col("e1")), "x2": (F.bit_xor, F.col("e2")), "sum": (F.sum, F.col("tokens"))}, "trie-ranges")
    own = Window.partitionBy("conv", "__part").orderBy("pos")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    run = held.withColumns({"__y1": F.bit_xor("e1").over(upto), "__y2": F.bit_xor("e2").over(upto), "__upto": F.sum("tokens").over(upto), "__next": F.lead("pos").over(own)}).join(starts, ["conv", "__part"])
    keyed = stored(
        run.select("conv", "__part", "pos", "tokens", "e1", "e2", F.expr("__x1 ^ __y1").alias("k1"), F.expr("__x2 ^ __y2").alias("k2"), (F.col("__sum") + F.col("__upto")).alias("upto"), (F.col("__final") & F.col("__next").isNull()).alias("last")),
        "trie-keyed",
    )
    released(held)
    blocks = keyed.drop("__part").withColumns({"shard": F.expr(f"(conv - pmod(conv, {width}L)) div {width}L"), "block": F.expr(f"(pos - 1) div {DEPTH}")})
    parts = stored(blocks.groupBy("shard", "block").applyInArrow(descend, _NODES), "trie-parts")
    merged = parts.groupBy("k1", "k2").agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.min_by("before", "conv").alias("before"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("k1", "k2")]
    none = F.lit(None).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0").select(*zero, none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("before"))
    children = merged.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(merged.unionByName(root).join(children, ["k1", "k2"], "left").fillna(0, ["n_children"]), "trie-nodes")

    # The first node that a conversation is the smallest member of; what lies above belongs to others.
    owned = stored(nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "k1", "k2", "p1", "p2", "before")).alias("f"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")).select("conv_id", "f.*", "leaf"), "trie-owned")
    above = owned.where("depth > 0").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    hot = heavy(above.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")), "k1", "k2")
    other = joined(above, nodes.select("k1", "k2", F.col("conv_id").alias("other")), ["k1", "k2"], hot).select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "other")

    # What a conversation owes: tokens of its turns before its first own node (of all, if it has none), and its leaf.
    total = keyed.where("last").select("conv", F.col("upto").alias("total"))
    owing = stored(convs.join(total, "conv", "left").join(owned.select(F.col("conv_id").alias("conv"), "before", "leaf"), "conv", "left").select("conv", F.coalesce("before", "total", F.lit(0)).alias("owed"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "trie-owing")
    ranges = keyed.groupBy("conv", "__part").agg(F.count(F.lit(1)).alias("n")).join(owing, "conv").drop("n")
    share = F.greatest(F.col("owed") - F.col("upto") + F.col("tokens"), F.lit(0))
    below = keyed.join(ranges, ["conv", "__part"]).select("k1", "k2", share.alias("saved"), "leaf").unionByName(owing.select(*zero, F.col("owed").alias("saved"), "leaf"))
    sums = below.groupBy("k1", "k2").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    idle = convs.join(keyed.where("pos = 1").select("conv"), "conv", "left_anti")
    turnless = idle.select(*zero, F.expr(f"(conv - pmod(conv, {width}L)) div {width}L").alias("shard"), "conv").groupBy("k1", "k2", "shard").agg(F.array_sort(F.collect_list("conv")).alias("ends"))
    listed = parts.where("ends is not null").select("k1", "k2", "shard", "ends").unionByName(turnless.withColumn("ends", _bytes("ends")))
    digests = listed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "shard").mapInArrow(_hashed, "k1 long, k2 long, sha string")

    full = nodes.join(sums, ["k1", "k2"]).join(other, ["k1", "k2"], "left").join(digests, ["k1", "k2"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("other", "conv_id"))
    key = F.lower(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in ("k1", "k2")]))
    return full.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"), key.alias("key"))


def _bytes(c: str) -> Column:
    """An array of numbers as little-endian bytes, eight each."""
    return F.expr(f"unhex(array_join(transform({c}, x -> array_join(reverse(regexp_extract_all(lpad(hex(x), 16, '0'), '..', 0)), '')), ''))")
