"""The trie of the turn prefixes of conversations, with the tokens that shared prefixes save.

Conversations are numbered turn by turn and, where asked for, rebuilt so that conversations of one
family share a beginning. The prefix of depth d is known by a digest of 128 bits: the exclusive or of
one hash for each of its (place, role, text). Texts are hashed where they are read and never travel.

A count-min sketch screens the prefixes. It has two rows of counters; a counter that more than one
prefix falls on is marked in a bitmap. A prefix with an unmarked counter in either row has an estimate
of one, which proves that it belongs to one conversation: its node is emitted where its row lies. Only
prefixes whose counters are both marked are possibly shared, and only they are shuffled and grouped by
digest. The sketch has eight counters a prefix and 2^26 a row at most, so its bitmaps, which are
broadcast, take 16 MB at most. Beyond some ten million prefixes it proves fewer of them; then more are
grouped, and the result is the same.

Sums over subtrees take no step per level. A node belongs to the smallest of its conversations. What a
conversation's own nodes save is summed from its end towards its beginning, and a node adds up these
sums over its conversations. Leaves are counted the same way.

Long conversations are numbered and summed in stretches of ``SPAN`` turns with one total for each, and
the digests of long lists of conversations are fed from sorted pieces of 4,096 ids at most, one piece at
a time, so no group is held as a whole.

Defined results: a null role or text is empty; turns are ordered by number, null first, equal ones by
role and then by digest, and all of them count, repeated rows too; rows without a conversation are left
out; an empty table gives no node, not even the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardgrid.llm.common import filled
from yardgrid.session import settle

SPAN = 1024
SPAN_BITS = 10
PER_PREFIX = 8
MOST_COUNTERS = 1 << 26
BLOCK = 1 << 15  # bits of one row of the bitmap
PIECE_BITS = 12
FAMILY = 5
MOST_SHARED = 9
NODE = ["depth", "a", "b"]
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(df: DataFrame) -> DataFrame:
    """(conv_id, pos, n, x, y, n_bytes): the turns in order, two hashes of each, and their number."""
    turn = F.col("turn").cast("bigint")
    rows = df.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        turn.alias("turn"),
        # Turns without a number come first.
        F.coalesce(F.shiftright(turn, SPAN_BITS), F.lit(-(1 << 62))).alias("chunk"),
        filled("role").alias("role"),
        F.octet_length(filled("text")).cast("bigint").alias("n_bytes"),
        *[F.xxhash64(F.lit(k), filled("role"), filled("text")).alias(name) for k, name in enumerate("xy")],
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"), "role", "x", "y")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("turns"))
        .select(
            "conv_id", "chunk", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("before"),
            F.sum("turns").over(Window.partitionBy("conv_id")).alias("n"),
        )
    )
    return (
        rows.withColumn("place", F.row_number().over(inside))
        .join(chunks, ["conv_id", "chunk"])
        .select("conv_id", (F.col("before") + F.col("place")).alias("pos"), "n", "x", "y", "n_bytes")
    )


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: their lengths, and their turns."""
    lengths = turns.filter("pos = 1").select("conv_id", F.col("n").alias("length"))
    return lengths, turns.withColumnRenamed("n", "length")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family of five.

    Conversation c takes the first h turns of c - c % 5, all if it has fewer and none if it is absent,
    and then its own after its first h, where h is the crc32 of its decimal id modulo 9.
    """
    convs = turns.filter("pos = 1").select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("h"),
    )
    firsts = convs.select(F.col("conv_id").alias("first"), F.col("n").alias("first_n"))
    family = convs.join(firsts, "first", "left").select(
        "conv_id", "first", "h", F.least("h", F.coalesce("first_n", F.lit(0))).alias("taken"),
        (F.least("h", F.coalesce("first_n", F.lit(0))) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
    )
    family = settle(family)
    own = turns.join(family, "conv_id").filter("pos > h").withColumn("pos", F.col("taken") + F.col("pos") - F.col("h"))
    heads = turns.filter(F.col("pos") < MOST_SHARED).withColumnRenamed("conv_id", "first")
    taken = heads.join(family, "first").filter("pos <= h")
    columns = ["conv_id", "pos", "length", "x", "y", "n_bytes"]
    return family.select("conv_id", "length"), own.select(*columns).unionByName(taken.select(*columns))


def running(
    df: DataFrame, key: Column, values: dict[str, str], total: Callable[[str], Column], plus: Callable[[Column, Column], Column]
) -> DataFrame:
    """Running totals of some columns over each conversation in the order of ``key``.

    Conversations of more than ``SPAN`` turns are cut into stretches; the totals of earlier stretches
    are joined to their rows.
    """
    rows = df.withColumn("_key", key).withColumn("_chunk", F.shiftright("_key", SPAN_BITS))
    upto = (Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy("conv_id", "_chunk").orderBy("_key").rowsBetween(*upto)
    earlier = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        rows.filter(F.col("length") >= SPAN).groupBy("conv_id", "_chunk").agg(*[total(c).alias(c) for c in values])
        .select("conv_id", "_chunk", *[total(c).over(earlier).alias(f"_{c}") for c in values])
    )
    out = rows.withColumns({new: total(c).over(inside) for c, new in values.items()}).join(sums, ["conv_id", "_chunk"], "left")
    for c, new in values.items():
        out = out.withColumn(new, plus(F.col(new), F.coalesce(f"_{c}", F.lit(0).cast("bigint"))))
    return out.drop("_key", "_chunk", *[f"_{c}" for c in values])


def prefixes(turns: DataFrame) -> DataFrame:
    """One row per conversation and depth: the digest (a, b) of the prefix and (up_a, up_b) of its parent."""
    steps = turns.withColumns({
        f"s{k}": F.xxhash64(F.lit(k), F.col("pos"), F.col("x"), F.col("y")) for k in (0, 1)
    })
    summed = running(steps, F.col("pos"), {"s0": "a", "s1": "b"}, F.bit_xor, lambda p, q: p.bitwiseXOR(q))
    return summed.select(
        "conv_id", F.col("pos").alias("depth"), "length", "n_bytes", "a", "b",
        F.col("a").bitwiseXOR(F.col("s0")).alias("up_a"), F.col("b").bitwiseXOR(F.col("s1")).alias("up_b"),
    )


def counters(n: int, most: int = MOST_COUNTERS) -> int:
    """Counters in a row of the sketch for so many prefixes, a power of two."""
    width = BLOCK
    while width < min(n * PER_PREFIX, most):
        width *= 2
    return width


def cell(row: int, a: str, b: str, width: int) -> Column:
    """The counter of a digest in a row of the sketch."""
    return F.pmod(F.xxhash64(F.lit(row + 2), F.col(a), F.col(b)), F.lit(width)) + F.lit(row * width)


def sketch(paths: DataFrame, width: int) -> DataFrame:
    """(block, marks): bitmaps of the counters that more than one prefix falls on.

    At most 2 * width / 2^15 rows of 4 KiB.
    """
    cells = paths.select(F.explode(F.array(*[cell(k, "a", "b", width) for k in (0, 1)])).alias("cell"))
    marked = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return marked.groupBy((F.expr(f"cell div {BLOCK}")).alias("block")).agg(
        F.bitmap_construct_agg(F.col("cell") % BLOCK).alias("marks")
    )


def screened(paths: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """The prefixes with ``shared`` and ``up_shared``: false where the estimate is one."""
    out = paths
    for name, a, b in (("shared", "a", "b"), ("up_shared", "up_a", "up_b")):
        crowded = []
        for row in (0, 1):
            at, bits = f"{name}_{row}", f"{name}_bits_{row}"
            table = F.broadcast(marks.select(F.col("block").alias(f"{at}_block"), F.col("marks").alias(bits)))
            out = out.withColumn(at, cell(row, a, b, width))
            out = out.join(table, F.expr(f"{at} div {BLOCK}") == F.col(f"{at}_block"), "left")
            byte = F.substring(bits, (F.col(at) % BLOCK / 8).cast("int") + 1, F.lit(1))
            value = F.conv(F.hex(byte), 16, 10).cast("int")
            crowded.append(F.coalesce(F.getbit(value, F.col(at) % 8) == 1, F.lit(False)))
            out = out.withColumn(f"{name}_mark_{row}", crowded[-1]).drop(at, bits, f"{at}_block")
        marked = F.col(f"{name}_mark_0") & F.col(f"{name}_mark_1")
        out = out.withColumn(name, marked).drop(f"{name}_mark_0", f"{name}_mark_1")
    # The root is above the first turns; it is counted by itself.
    return out.withColumn("up_shared", F.col("up_shared") & (F.col("depth") > 1))


def list_digests(members: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of the ids of every group, ascending and joined by commas.

    Pieces of a bounded range of ids are joined by Spark; a task reads the pieces of its groups in
    order and holds one at a time.
    """
    pieces = (
        members.groupBy(*keys, F.shiftright("conv_id", PIECE_BITS).alias("piece"))
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
        .repartition(*keys)
        .sortWithinPartitions(*keys, "piece")
        .select(*keys, "ids")
    )
    out = pa.schema([*[(k, pa.int64()) for k in keys], ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *key, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != group:
                    if group is not None:
                        done.append((*group, state.hexdigest()))
                    group, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), out, strict=True)], schema=out)
        if group is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, (*group, state.hexdigest()), strict=True))], schema=out)

    return pieces.mapInArrow(digest, ", ".join([*[f"{k} bigint" for k in keys], "ends_sha256 string"]))


def prefix_trie(df: DataFrame, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = plain) -> DataFrame:
    """One row per node of the trie.

    ``conv_id`` is the smallest conversation of the node, ``n_leaves`` counts the childless nodes of its
    subtree, ``saved_tokens`` sums (n_convs - 1) times the bytes of the last turn over its subtree, and
    ``ends_sha256`` stands for the conversations that end there. ``build`` makes the conversations.
    """
    lengths, turns = build(settle(numbered_turns(df)))
    lengths, paths = settle(lengths), settle(prefixes(turns))
    width = counters(paths.count())
    found = settle(screened(paths, settle(sketch(paths, width)), width))

    # Possibly shared prefixes, grouped exactly.
    shared = found.filter("shared")
    groups = shared.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner"),
        *[F.max(c).alias(c) for c in ("n_bytes", "up_a", "up_b")],
    )
    groups = settle(groups)
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    below = (
        found.filter("not shared and up_shared").select(*up).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"))
        .unionByName(groups.select(*up, F.lit(1).cast("bigint").alias("n")))
        .groupBy(*NODE).agg(F.sum("n").alias("n_children"))
    )
    nodes = settle(groups.join(below, NODE, "left").fillna(0, ["n_children"]))

    # What a conversation's own nodes save, summed from its end, and whether its end is a leaf.
    placed = shared.join(nodes.select(*NODE, "n_convs", "owner", "n_children"), NODE)
    own = F.col("owner") == F.col("conv_id")
    placed = settle(placed.select(
        "conv_id", *NODE, "length",
        F.when(own, (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(0).alias("saves"),
        ((F.col("depth") == F.col("length")) & ~(own & (F.col("n_children") == 0))).alias("no_leaf"),
    ))
    no_leaf = placed.filter("no_leaf").select("conv_id", F.lit(1).cast("bigint").alias("lost"))
    summed = running(placed.drop("no_leaf"), -F.col("depth"), {"saves": "saved"}, F.sum, lambda p, q: p + q)
    sums = (
        summed.join(no_leaf, "conv_id", "left")
        .groupBy(*NODE)
        .agg(F.sum("saved").alias("saved_tokens"), F.sum(1 - F.coalesce("lost", F.lit(0))).alias("n_leaves"))
    )
    ends = list_digests(shared.filter("depth = length").select("conv_id", *NODE), NODE)
    owners = nodes.select(*up[:0], F.col("depth").alias("up_depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("owner").alias("up_owner"))

    first = lengths.agg(F.min("conv_id").alias("root"))

    def under(rows: DataFrame, owner: str) -> DataFrame:
        """The conversation of the parent; a parent proved single belongs to the node's own."""
        joined = rows.withColumn("up_depth", F.col("depth") - 1).join(owners, ["up_depth", "up_a", "up_b"], "left")
        return joined.withColumn(
            "parent_conv_id", F.when(F.col("depth") == 1, first.scalar()).otherwise(F.coalesce("up_owner", F.col(owner)))
        )

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    grouped = (
        under(nodes.join(sums, NODE).join(ends, NODE, "left"), "owner")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
        .withColumnRenamed("owner", "conv_id")
        .select(*columns)
    )

    # Proved to belong to one conversation.
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    last = F.col("depth") == F.col("length")
    digest = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING))
    facts = {
        "n_convs": one, "n_children": F.when(last, none).otherwise(one), "n_leaves": one, "saved_tokens": none,
        "ends_sha256": digest,
    }
    single = found.filter("not shared").withColumns(facts)
    inner = single.filter("not up_shared").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, first.scalar()).otherwise(F.col("conv_id"))
    )
    heads = under(single.filter("up_shared"), "conv_id")

    # The root, from totals of one row each.
    children = found.filter("depth = 1 and not shared").agg(F.count(F.lit(1)).alias("n"))
    more = nodes.filter("depth = 1").agg(F.count(F.lit(1)).alias("n"))
    saved = placed.agg(F.coalesce(F.sum("saves"), F.lit(0)).alias("n"))
    lost = no_leaf.agg(F.count(F.lit(1)).alias("n"))
    silent = list_digests(lengths.filter("length = 0").select("conv_id", F.lit(0).cast("bigint").alias("depth")), ["depth"])
    root = (
        lengths.agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
            F.count(F.when(F.col("length") > 0, 1)).alias("spoken"),
        )
        .filter("n_convs > 0")
        .select(
            "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs",
            (children.scalar() + more.scalar()).alias("n_children"),
            F.greatest(F.col("spoken") - lost.scalar(), F.lit(1)).alias("n_leaves"),
            saved.scalar().alias("saved_tokens"),
        )
        .join(silent, "depth", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    )
    return (
        root.select(*columns)
        .unionByName(grouped)
        .unionByName(inner.select(*columns))
        .unionByName(heads.select(*columns))
    )
