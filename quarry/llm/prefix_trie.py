"""Prefix trie of conversations: which turns are shared, and what that saves.

A node of depth d is a distinct sequence of the first d turns (role, text); its
members are the conversations that start with it. It is known as (conv_id, depth)
by its owner, the smallest member. Owners are monotone: a conversation that owns
its prefix of d turns owns all of its longer ones. So its nodes are one chain,
from its first owned depth to its end, hung below the node of another owner.

1. ``numbered`` gives each turn its place and a 128-bit digest. Turns are sorted by
   range and counted by part, so that one very long conversation is no one task's
   work; texts are not shuffled.
2. A prefix digest is the exclusive or of its turns' digests hashed with their
   places (two 64-bit halves), a running value in segments of ``SEGMENT`` turns.
   The minima table holds owner and size of every prefix that is shared.
3. A binary search for the first owned depth runs for all conversations at once:
   each round asks for the digests at the middle depths and joins the minima.
   The last depth that was not owned names the parent of the chain.
4. Chains are summed from their ends up; a chain's total then goes to every node
   above it, by the digests of its conversation's shorter prefixes, in one sum by
   node instead of one round for each level of the tree.
5. The ids of the members that end in a node are packed in order into pieces of
   ``PIECE`` ids, and a node's pieces stream through its digest.

Defined results: turns go by turn (null first), then by the digest of role and
text; null role or text is empty; rows without a conv_id belong to no conversation
and are ignored; repeated rows are turns of their own; very long texts only enter
through digest and length; other columns are ignored; an empty table has no nodes,
not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

SEGMENT = 1024
PIECE = 4096
#: Conversations of a round that may be broadcast.
BROADCAST_ROWS = 200_000
HEAD_TURNS, FAMILY = 6, 100
_KEY = ["depth", "a", "b"]


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, x, y, chars), places from 1, and (conv_id, n) of the turns."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("t"), F.length(text).cast("long").alias("chars"))
    rows = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "t").withColumn("at", F.monotonically_increasing_id())
    rows = rows.select("conv_id", "at", F.shiftright("at", 33).alias("part"), _half(F.col("t"), 1).alias("x"), _half(F.col("t"), 17).alias("y"), "chars")
    rows = runtime.stored(rows, "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = runtime.stored(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "parts")
    place = (F.col("at") - F.col("first") + F.col("before") + 1).alias("place")
    turns = rows.join(parts.drop("n"), ["conv_id", "part"]).select("conv_id", place, "x", "y", "chars")
    return runtime.stored(turns, "numbered"), parts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def grafted(turns: DataFrame, lens: DataFrame, head_turns: int = HEAD_TURNS, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Numbered conversations rebuilt: the first h turns of the conversation that
    heads the family of ``family`` ids (all if it has fewer), then the own turns
    after the first h, with h = crc32(conv_id) % ``head_turns``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % head_turns
    heads = lens.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = lens.select("conv_id", F.col("n").alias("own"), h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(heads, "base", "left").select("conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    convs = runtime.stored(convs, "grafts")
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("place") < head_turns)).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", "base", "head").join(first, "base").where(F.col("place") <= F.col("head"))
    rest = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where(F.col("place") > F.col("h"))
    rest = rest.withColumn("place", F.col("place") - F.col("h") + F.col("head"))
    cols = ["conv_id", "place", "x", "y", "chars"]
    return first.select(*cols).unionByName(rest.select(*cols)), convs.select("conv_id", "n")


def _running(rows: DataFrame, names: list[str], fold, join, deepest: int) -> DataFrame:
    """``names`` replaced by their running values along each conversation's depths.
    Long conversations go in segments, whose totals are carried on."""
    seg = F.floor(F.col("depth") / SEGMENT)
    rows = rows.withColumn("seg", seg)
    w = Window.partitionBy("conv_id", "seg").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({c: fold(F.col(c)).over(w) for c in names})
    if deepest < SEGMENT:
        return out.drop("seg")
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "seg").agg(*[fold(F.col(c)).alias(c) for c in names])
    carry = totals.select("conv_id", "seg", *[fold(F.col(c)).over(before).alias(f"{c}_before") for c in names]).where("seg > 0")
    out = out.join(carry, ["conv_id", "seg"], "left")
    return out.withColumns({c: join(F.col(c), F.coalesce(f"{c}_before", F.lit(0))) for c in names}).drop("seg", *[f"{c}_before" for c in names])


def first_owned(prefixes: DataFrame, lens: DataFrame, shared: DataFrame, deepest: int) -> DataFrame:
    """(conv_id, n, first, parent): each conversation's smallest owned depth (n + 1 if
    it owns none) and the owner of the prefix above it, by binary search: depths
    below ``lo`` are not owned, those from ``hi`` on are."""
    asking = lens.select("conv_id", "n", F.lit(0).cast("long").alias("lo"), (F.col("n") + 1).alias("hi"), F.lit(None).cast("long").alias("parent"))
    settled = []
    for _ in range((deepest + 1).bit_length()):
        mid = asking.withColumn("depth", F.shiftright(F.col("lo") + F.col("hi"), 1))
        if asking.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            mid = F.broadcast(mid)
        asked = prefixes.select("conv_id", *_KEY).join(mid, ["conv_id", "depth"]).join(shared.select(*_KEY, "owner"), _KEY, "left")
        mine = F.col("owner").isNull() | (F.col("owner") == F.col("conv_id"))
        found = asked.select(
            "conv_id", "n", F.when(mine, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(mine, F.col("parent")).otherwise(F.col("owner")).alias("parent"),
        )
        found = runtime.stored(found, "search")
        settled.append(found.where("lo >= hi"))
        asking = found.where("lo < hi")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("conv_id", "n", F.col("lo").alias("first"), "parent")


def _packed(batches):
    """Sorted (depth, a, b, conv_id) as one row for up to PIECE ids of a node."""
    key, ids = None, []

    def row():
        return {"depth": key[0], "a": key[1], "b": key[2], "least": ids[0], "ids": ",".join(map(str, ids))}

    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("least", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        d, a, b, c = (batch.column(i).to_numpy() for i in range(4))
        cut = np.flatnonzero((d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        out = []
        for s, e in zip([0, *cut], [*cut, len(d)]):
            if s == e:
                continue
            now = (int(d[s]), int(a[s]), int(b[s]))
            if now != key and ids:
                out.append(row())
                ids = []
            key = now
            for at in range(s, e, PIECE):
                ids += c[at : min(at + PIECE, e)].tolist()
                while len(ids) >= PIECE:
                    ids, rest = ids[:PIECE], ids[PIECE:]
                    out.append(row())
                    ids = rest
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if ids:
        yield pa.RecordBatch.from_pylist([row()], schema)


def _digested(batches):
    """Sorted pieces of nodes as one SHA-256 for each node."""
    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    key, sha = None, None
    for batch in batches:
        out = []
        for d, a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("depth", "a", "b", "ids"))):
            if (d, a, b) != key:
                if sha:
                    out.append((*key, sha.hexdigest()))
                key, sha = (d, a, b), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((*key, sha.hexdigest()), schema)], schema=schema)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of (depth, a, b, conv_id): the SHA-256 of each
    node's ids, ascending, joined by commas."""
    order = [*_KEY, "conv_id"]
    pieces = ends.select(*order).orderBy(*order).mapInArrow(_packed, "depth long, a long, b long, least long, ids string")
    pieces = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "least")
    return pieces.mapInArrow(_digested, "depth long, a long, b long, ends_sha256 string")


def trie(turns: DataFrame, lens: DataFrame) -> DataFrame:
    """The nodes of numbered ``turns`` (conv_id, place, x, y, chars) of conversations
    ``lens`` (conv_id, n): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and x, y, the last turn's digest."""
    lens = runtime.stored(lens.select("conv_id", F.col("n").cast("long").alias("n")), "lens")
    deepest = lens.agg(F.max("n")).first()[0] or 0
    turn = [F.xxhash64("place", "x", "y").alias("a"), F.xxhash64(F.lit(1), "place", "x", "y").alias("b")]
    rows = turns.select("conv_id", F.col("place").cast("long").alias("depth"), *turn, "chars", "x", "y")
    rows = _running(rows, ["a", "b"], F.bit_xor, lambda p, q: p.bitwiseXOR(q), deepest)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = lens.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("chars"), none.alias("x"), none.alias("y"))
    prefixes = runtime.stored(roots.unionByName(rows), "prefixes")
    shared = prefixes.groupBy(*_KEY).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 1")
    shared = runtime.stored(shared, "minima")

    found = first_owned(prefixes, lens, shared, deepest)
    rows = runtime.stored(prefixes.join(found, "conv_id"), "chains")
    tops = found.where("first > 0 AND first <= n").groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("tops"))
    own = rows.where("depth >= first").join(shared.select(*_KEY, "n_convs"), _KEY, "left").withColumn("n_convs", F.coalesce("n_convs", F.lit(1)))
    own = own.join(tops, ["conv_id", "depth"], "left")
    children = F.coalesce("tops", F.lit(0)) + F.when(F.col("depth") < F.col("n"), 1).otherwise(0)
    own = own.withColumn("n_children", children).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    own = runtime.stored(own.drop("tops"), "nodes")

    # A chain's total, and whether its end is a leaf.
    leaf = F.max(F.when((F.col("depth") == F.col("n")) & (F.col("n_children") == 0), 1).otherwise(0))
    chains = own.groupBy("conv_id").agg(F.sum("saved").alias("total"), leaf.alias("leaf"))
    chains = runtime.stored(chains, "totals")
    above = rows.where("depth < first").join(chains.where("total > 0 OR leaf > 0"), "conv_id")
    above = above.groupBy(*_KEY).agg(F.sum("total").alias("more_saved"), F.sum("leaf").alias("more_leaves"))
    # The sum from a node down is the total without what stands above it.
    up = _running(own.withColumn("upto", F.col("saved")), ["upto"], F.sum, lambda p, q: p + q, deepest)
    nodes = up.join(chains, "conv_id").join(above, _KEY, "left")
    nodes = nodes.join(ends_digest(rows.where("depth = n")), _KEY, "left")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id"))
    return nodes.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), F.col("n_convs").cast("long").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"),
        (F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).cast("long").alias("n_leaves"),
        (F.col("total") - F.col("upto") + F.col("saved") + F.coalesce("more_saved", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "x", "y",
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of ``conversations`` (conv_id, turn, role, text) as they are."""
    return trie(*numbered(conversations))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with role and text of their last turn (the root: null)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.select(_half(digest, 1).alias("x"), _half(digest, 17).alias("y"), role.alias("role"), text.alias("text"))
    return nodes.join(turns.groupBy("x", "y").agg(F.first("role").alias("role"), F.first("text").alias("text")), ["x", "y"], "left")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    found = trie(*grafted(*numbered(runtime.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))
    return found.drop("x", "y")
