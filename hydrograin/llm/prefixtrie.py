"""The trie of common conversation beginnings, built by partition refinement.

All conversations start in one class, the root. Round d splits each class that is still active by the d-th turn;
a class of one distinct conversation retires, and its remaining turns come out as one unary chain, so that rounds
go only as deep as different conversations agree. Totals of subtrees are then folded back, deepest round first.

Conversations of equal turns are one member with a weight. Turns take part as SHA-256 digests; texts are read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, release, stage

#: Conversations of one hundred start with turns of its first, HEADS - 1 at most.
GROUP, HEADS = 100, 6
#: Ids whose digits are joined in one task before they are hashed: 2 to this power of consecutive numbers.
ID_BITS = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, n_chars, chars up to here) of each turn, written out.

    Turns are ordered by turn (null first), then role and digest where numbers tie; rows of a null conv_id belong to no
    conversation. Numbers come from range-dealt rows and one offset for each range, so a conversation may span many tasks.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.length(text).cast("long").alias("n_chars"),
    )
    keys = ("conv_id", "turn", "role", "digest")
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stage(dealt.select("conv_id", F.monotonically_increasing_id().alias("at"), "digest", "n_chars"))
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    offsets = offsets.select("conv_id", "part", "first", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "chars")))
    here = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("running", F.sum("n_chars").over(here)).join(offsets, ["conv_id", "part"])
    out = stage(found.select("conv_id", (F.col("at") - F.col("first") + 1 + F.col("n_before")).alias("pos"), "digest", "n_chars", (F.col("running") + F.col("chars_before")).alias("up_to")))
    release(dealt)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) in which each conversation takes its first turns from the first of its hundred.

    conversations: (conv_id, length); turns: (conv_id, depth from 1, digest, n_chars, rest: characters from this turn on).
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n_own"), F.max("up_to").alias("chars"), F.sum(F.when(F.col("pos") <= h, F.col("n_chars")).otherwise(0)).alias("replaced"))
    own = own.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    head = turns.where((F.col("pos") < HEADS) & (F.col("conv_id") % GROUP == 0)).groupBy(F.col("conv_id").alias("base"))
    head = head.agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n_chars", "up_to"))).alias("head"))
    taken = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,n_chars:bigint,up_to:bigint>>")), F.lit(1), F.greatest(F.col("h"), F.lit(1)).cast("int"))).otherwise(F.array())
    convs = own.join(head, "base", "left").withColumn("head", taken)
    convs = convs.select("conv_id", "h", "head", F.size("head").cast("long").alias("m"), F.greatest(F.col("n_own") - F.col("h"), F.lit(0)).alias("tail"), "chars", (F.col("chars") - F.col("replaced")).alias("tail_chars"))
    convs = stage(convs)
    kept = turns.join(convs.select("conv_id", "h", "m", "chars"), "conv_id").where(F.col("pos") > F.col("h"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "digest", "n_chars", (F.col("chars") - F.col("up_to") + F.col("n_chars")).alias("rest"))
    given = convs.where("m > 0").select("conv_id", "tail_chars", F.element_at("head", -1)["up_to"].alias("head_chars"), F.explode("head").alias("t"))
    given = given.select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.n_chars", (F.col("head_chars") - F.col("t.up_to") + F.col("t.n_chars") + F.col("tail_chars")).alias("rest"))
    return convs.select("conv_id", (F.col("m") + F.col("tail")).alias("length")), stage(kept.unionByName(given))


def ends_digest(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256): the digest of each group's conv_ids, ascending, in decimal and joined by commas.

    Digits of up to 2 ** ID_BITS consecutive ids are joined in one task; a group's digest is then brought up to date
    block by block, so that a group may be of any size.
    """
    blocks = members.groupBy(*keys, F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select(*keys, "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("digits"))
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys, "block")
    schema = dealt.select(*keys).schema.add("ends_sha256", "string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done = []
            for *key, digits in zip(*(b.column(k).to_pylist() for k in (*range(len(keys)), len(keys) + 1))):
                if key != now:
                    if state is not None:
                        done.append([*now, state.hexdigest()])
                    now, state = key, hashlib.sha256(digits.encode())
                else:
                    state.update(b"," + digits.encode())
            if done:
                yield _rows(done)
        if state is not None:
            yield _rows([[*now, state.hexdigest()]])

    names = [*keys, "ends_sha256"]

    def _rows(done: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, zip(*done))), pa.schema([*((k, pa.int64()) for k in keys), ("ends_sha256", pa.string())]))

    return dealt.mapInArrow(digest, schema)


def _refine(turns: DataFrame, active: DataFrame, root: DataFrame) -> list[DataFrame]:
    """The classes of each depth, root first: (cls: its parent, node: its smallest conversation, n: distinct ones, n_convs, n_chars, rest, ending)."""
    levels, splitting = [root], active
    while True:
        depth = len(levels)
        split = stage(turns.where(F.col("depth") == depth).drop("depth").join(splitting, "conv_id"))
        classes = stage(
            split.groupBy("cls", "digest").agg(
                F.min("conv_id").alias("node"), F.count("*").alias("n"), F.sum("n_convs").alias("n_convs"), F.min("n_chars").alias("n_chars"),
                F.min("rest").alias("rest"), F.max(F.when(F.col("length") == depth, F.col("conv_id"))).alias("ending"),
            )
        )
        if depth > 1:
            release(last)
        if classes.isEmpty():
            release(split)
            return levels
        levels.append(classes)
        live = classes.where("n > 1").select("cls", "digest", "node")
        splitting = split.where(F.col("length") > depth).join(live, ["cls", "digest"]).select("conv_id", F.col("node").alias("cls"))
        last = split


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, length) with turns (conv_id, depth, digest, n_chars, rest), see rebuilt().

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No conversations, no
    rows; a conversation without turns ends at the root.
    """
    whole = (F.bit_xor(F.xxhash64("depth", "digest")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "digest", "depth")).alias("b"))
    marked = convs.join(turns.groupBy("conv_id").agg(*whole), "conv_id", "left").select("conv_id", "length", *(F.coalesce(c, F.lit(0)).alias(c) for c in "ab"))
    marked = stage(marked)
    texts = stage(marked.groupBy("a", "b", "length").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")))
    ends = ends_digest(marked.select("a", "b", "length", "conv_id"), ["a", "b", "length"]).join(texts, ["a", "b", "length"])
    ends = stage(ends.select(F.col("conv_id").alias("ending"), "ends_sha256"))
    release(marked)
    turns = stage(turns.join(texts.select("conv_id", "n_convs", "length"), "conv_id").sortWithinPartitions("depth"))
    root = texts.agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.sum("n_convs").alias("n_convs"), F.max(F.when(F.col("length") == 0, F.col("conv_id"))).alias("ending"))
    zero = F.lit(0).cast("long")
    root = stage(root.where("n > 0").select(F.lit(None).cast("long").alias("cls"), "node", F.lit(2).cast("long").alias("n"), "n_convs", zero.alias("n_chars"), zero.alias("rest"), "ending"))
    start = texts.where("length > 0").crossJoin(F.broadcast(root.select(F.col("node").alias("cls")))).select("conv_id", "cls")  # the root is one row
    levels = _refine(turns, start, root)
    inner, heads, below = None, None, None
    for depth in range(len(levels) - 1, -1, -1):
        classes = levels[depth]
        alone = classes.where("n = 1").select("cls", F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("start"), ((F.col("n_convs") - 1) * F.col("rest")).alias("saved"))
        own = classes.where("n > 1").select("cls", "node", "n_convs", "ending", ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
        if below is not None:
            total = below.groupBy(F.col("cls").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_below"))
            own = own.join(total, "node", "left")
        else:
            own = own.select("*", *(F.lit(None).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_below")))
        own = stage(
            own.select(
                F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("cls").alias("parent_conv_id"), "n_convs",
                F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
                (F.col("saved") + F.coalesce("saved_below", zero)).alias("saved_tokens"), "ending",
            )
        )
        below = own.select(F.col("parent_conv_id").alias("cls"), "n_leaves", F.col("saved_tokens").alias("saved")).unionByName(alone.select("cls", F.lit(1).cast("long").alias("n_leaves"), "saved"))
        inner, heads = (own, alone) if inner is None else (inner.unionByName(own), heads.unionByName(alone))
    on = turns.join(heads.select("conv_id", "start", "cls"), "conv_id").where("depth >= start")
    last: Column = F.col("depth") == F.col("length")
    chains = on.select(
        "conv_id", F.col("depth").cast("long"), F.when(F.col("depth") == F.col("start"), F.col("cls")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("rest")).alias("saved_tokens"), F.when(last, F.col("conv_id")).alias("ending"),
    )
    nodes = inner.unionByName(chains)
    ending = nodes.where("ending IS NOT NULL").join(ends, "ending").drop("ending")
    return ending.unionByName(nodes.where("ending IS NULL").drop("ending").withColumn("ends_sha256", F.lit(NO_ENDS)))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are, without exchanged beginnings; columns as in trie()."""
    turns = numbered(conversations)
    ends = turns.groupBy("conv_id").agg(F.max("pos").alias("length"), F.max("up_to").alias("chars"))
    rows = turns.join(ends.select("conv_id", "chars"), "conv_id").select("conv_id", F.col("pos").alias("depth"), "digest", "n_chars", (F.col("chars") - F.col("up_to") + F.col("n_chars")).alias("rest"))
    return trie(ends.select("conv_id", "length"), stage(rows))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = numbered(read_table(spark, sf_dir, "conversations"))
    convs, exchanged = rebuilt(turns)
    release(turns)
    return trie(convs, exchanged)


#: CRC-32 of a decimal number, byte by byte and bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x:
    list_reduce(range(8), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, x)), 4294967295))"""

_SQL = f"""
WITH RECURSIVE own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC.format("conv_id")} % {HEADS} AS h, conv_id - conv_id % {GROUP} AS base FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (
    SELECT c.conv_id, 0 AS side, t.pos, t.role, t.text FROM convs c JOIN own t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN own t ON t.conv_id = c.conv_id AND t.pos > c.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS depth, sha256(length(role) || ':' || role || text) AS name, length(text) AS n_chars FROM parts),
lengths AS (SELECT c.conv_id, count(t.depth) AS len FROM convs c LEFT JOIN turns t USING (conv_id) GROUP BY 1),
paths AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS path, CAST(0 AS BIGINT) AS n_chars FROM convs
    UNION ALL SELECT t.conv_id, t.depth, sha256(p.path || t.name), t.n_chars FROM paths p JOIN turns t ON t.conv_id = p.conv_id AND t.depth = p.depth + 1),
nodes AS (
    SELECT p.depth, p.path, min(p.conv_id) AS conv_id, count(*) AS n_convs, min(p.n_chars) AS n_chars,
           sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE l.len = p.depth), '')) AS ends_sha256
    FROM paths p JOIN lengths l USING (conv_id) GROUP BY 1, 2),
up AS (SELECT n.conv_id, n.depth, p.path AS parent FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
family AS (
    SELECT n.conv_id, n.depth, n.path, n.n_convs, n.n_chars, n.ends_sha256, a.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children
    FROM nodes n LEFT JOIN up u ON u.conv_id = n.conv_id AND u.depth = n.depth LEFT JOIN nodes a ON a.path = u.parent AND a.depth = n.depth - 1
    LEFT JOIN (SELECT parent, depth, count(*) AS n FROM up GROUP BY 1, 2) k ON k.parent = n.path AND k.depth = n.depth + 1)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, CAST(sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
       CAST(sum((x.n_convs - 1) * x.n_chars) AS BIGINT) AS saved_tokens, f.ends_sha256
FROM family f JOIN paths p ON p.path = f.path AND p.depth = f.depth JOIN family x ON x.conv_id = p.conv_id AND x.depth >= f.depth
GROUP BY ALL
"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": _SQL}
