"""Conversation prefix trie: every distinct beginning of a conversation once, with what shares it and what it saves.

Method: rows are hash-partitioned by the digest of the first turn, and each bucket builds pointer dictionary tries inside
``applyInPandas``: nodes are numbers, a node's children a dictionary from the digest of the next turn, and statistics go
from children to parents in an iterative postorder.  A first-turn subtrie of more than ``LIMIT`` turns isn't built by one
task: its rows are repartitioned by the next turn, and again as long as a part is oversized.  A split goes as far as all
rows of the part agree (the longest common beginning of the smallest and the largest sequence), so a long shared prompt
costs one round; the agreed turns are a chain of nodes made by expressions, whose statistics come from the parts below by
an aggregation.  The root is split in any case.

Only digests (16 bytes a turn), byte counts and ids are shuffled, never texts.  Conversations of equal sequences are one
row with a count before any trie is built, so a conversation of which there are millions of copies is one path.  Their
ids, in order, are hashed by streams: ids are range-partitioned by (sequence, id), each partition joins its ids to pieces,
and the pieces of a sequence go through one SHA-256 in order (which can't be computed in parallel), never all in memory.

Bounds: a bucket holds about ``BUCKET`` turns and at most ``LIMIT`` more; a conversation is a row of 24 bytes a turn.

Defined cases: turns are ordered by number, null first, equal numbers by role, then by digest; a null role or text is
empty; repeated rows are turns of their own; rows with a null ``conv_id`` belong to no conversation and are left out; an
empty table gives no rows, not even a root; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.scratch import bounded_batches, cut, keep_only, scope

#: Turns below a node that one task takes, and turns of a bucket of small subtries on the mean.
LIMIT, BUCKET = 1 << 10, 1 << 12
#: Characters of joined ids in a piece.
PIECE = 1 << 16
DIGEST = 16
_ROOT = b""
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, above binary"
_NONE = hashlib.sha256(b"").hexdigest()


def _digest(x: Column) -> Column:
    return F.substring(F.unhex(F.sha2(x, 256)), 1, DIGEST)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``digests`` (of its turns in order, 16 bytes each) and ``sizes`` (UTF-8 bytes of their texts)."""
    return _packed(_ordered(turns))


def _ordered(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    path = F.sort_array(F.collect_list(turn))
    return turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(path.alias("path"))


def _packed(df: DataFrame) -> DataFrame:
    digests = F.unhex(F.array_join(F.transform("path", lambda x: F.hex(x.digest)), ""))
    return df.select("conv_id", digests.alias("digests"), F.transform("path", lambda x: x["size"]).alias("sizes"))


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """:func:`sequences` of conversations that begin with turns of another.

    Conversation c takes the first h turns of conversation c - c % ``family`` and goes on with its own after its first h,
    where h is crc32 of its decimal id modulo ``heads`` (and % leaves the sign of c, as in SQL).
    """
    own = _ordered(turns)
    base = F.col("conv_id") - F.col("conv_id") % family
    first = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = own.select("conv_id", "path", base.alias("base"), h.alias("h")).join(first, "base", "left")
    path = F.expr("concat(slice(if(head is null, slice(path, 1, 0), head), 1, h), slice(path, h + 1, size(path)))")
    return _packed(both.select("conv_id", path.alias("path")))


def _ends(paths: DataFrame) -> DataFrame:
    """``key`` (digest of a sequence) and the SHA-256 of the ids that have it, in order and joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array([",".join(x) for x in texts], pa.string())], ["key", "first", "ids"])

        keys, firsts, texts, size = [], [], [], 0
        for batch in batches:
            for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not keys or keys[-1] != key or size > PIECE:
                    if len(keys) > 4000 or size > PIECE:
                        yield out()
                        keys, firsts, texts = [], [], []
                    keys.append(key)
                    firsts.append(conv_id)
                    texts.append([])
                    size = 0
                texts[-1].append(str(conv_id))
                size += len(texts[-1][-1]) + 1
        if keys:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            keys, found = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key == last:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    keys.append(last)
                    found.append(state.hexdigest())
                last, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends"])

    ids = paths.select(_digest(F.col("digests")).alias("key"), "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    by_piece = ids.mapInArrow(pieces, "key binary, first long, ids string")
    return by_piece.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends string")


class Tries:
    """Nodes as numbers, each with its children by digest; every child has a higher number than its parent."""

    def __init__(self) -> None:
        self.tops: dict[bytes, int] = {}
        self.above: list[tuple | None] = []
        self.parent: list[int] = []
        self.kids: list[dict[bytes, int]] = []
        self.depth: list[int] = []
        self.size: list[int] = []
        self.least: list[int] = []
        self.n: list[int] = []
        self.ends: list[str] = []

    def _made(self, parent: int, depth: int, size: int, conv_id: int, above: tuple | None) -> int:
        for column, value in ((self.above, above), (self.parent, parent), (self.kids, {}), (self.depth, depth), (self.size, size), (self.least, conv_id), (self.n, 0), (self.ends, _NONE)):
            column.append(value)
        return len(self.n) - 1

    def add(self, key: bytes, depth: int, digests: bytes, sizes: Iterable[int], conv_id: int, n: int, ends: str, above: tuple) -> None:
        """A sequence below the node ``key`` of this depth; ``above`` names that node's parent."""
        if key not in self.tops:
            self.tops[key] = self._made(-1, depth, sizes[depth - 1], conv_id, above)
        at = self.tops[key]
        for i in range(depth, len(sizes) + 1):
            self.least[at] = min(self.least[at], conv_id)
            self.n[at] += n
            if i < len(sizes):
                digest = digests[DIGEST * i : DIGEST * (i + 1)]
                if digest not in self.kids[at]:
                    self.kids[at][digest] = self._made(at, i + 1, sizes[i], conv_id, None)
                at = self.kids[at][digest]
        self.ends[at] = ends

    def rows(self) -> Iterator[tuple]:
        """All nodes; the reverse of the order in which they were made has children before parents."""
        leaves, saved = [0] * len(self.n), [0] * len(self.n)
        for i in reversed(range(len(self.n))):
            leaves[i] = leaves[i] or 1
            saved[i] += (self.n[i] - 1) * self.size[i]
            if (p := self.parent[i]) >= 0:
                leaves[p] += leaves[i]
                saved[p] += saved[i]
        for i, p in enumerate(self.parent):
            above, parent = self.above[i] or (None, self.least[p])
            yield self.least[i], self.depth[i], parent, self.n[i], len(self.kids[i]), leaves[i], saved[i], self.ends[i], above


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    tries = Tries()
    for r in pdf.itertuples(index=False):
        tries.add(r.key, r.depth, r.digests, r.sizes.tolist(), r.conv_id, r.n, r.ends, (r.above, r.parent))
    return pd.DataFrame(tries.rows(), columns=[x.split()[0] for x in _NODE.split(", ")])


def _split(level: DataFrame, oversized: DataFrame) -> DataFrame:
    """One row for each oversized part: up to which depth all its sequences agree, and what the chain of nodes down to
    there needs."""
    heavy = level.join(oversized, "key")
    ends = heavy.groupBy("key").agg(
        F.min(F.struct("digests", "sizes", "ends")).alias("a"), F.max("digests").alias("z"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"), F.first("above").alias("above"), F.first("parent").alias("parent"),
    )
    blocks = F.expr(f"least(size(a.sizes), octet_length(z) div {DIGEST})")
    differs = F.expr(f"array_position(transform(sequence(1, blocks), i -> substring(a.digests, {DIGEST} * i - {DIGEST - 1}, {DIGEST}) = substring(z, {DIGEST} * i - {DIGEST - 1}, {DIGEST})), false)")
    agreed = ends.withColumn("blocks", blocks.cast("int")).withColumn("to", F.when(differs == 0, F.col("blocks")).otherwise(differs - 1).cast("int"))
    sizes = F.slice("a.sizes", F.col("depth"), F.col("to") - F.col("depth") + 1)
    return agreed.select("key", "n", "conv_id", "depth", "to", "above", "parent", sizes.alias("sizes"), F.when(F.size("a.sizes") == F.col("to"), F.col("a.ends")).otherwise(_NONE).alias("ends"))


def _chain(split: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of oversized parts down to where they split, from the nodes right below."""
    sums = below.groupBy("above").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("above", "key")
    nodes = split.join(sums, "key", "left").select("*", F.posexplode("sizes").alias("i", "size"))
    upward = Window.partitionBy("key").orderBy(F.desc("i"))
    saved = F.coalesce("saved", F.lit(0)) + F.sum((F.col("n") - 1) * F.col("size")).over(upward)
    top, last = F.col("i") == 0, F.col("depth") + F.col("i") == F.col("to")
    return nodes.select(
        "conv_id", (F.col("depth") + F.col("i")).cast("long").alias("depth"), F.when(top, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(_NONE).alias("ends_sha256"), F.when(top, F.col("above")).alias("above"),
    )


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of all prefixes of ``paths`` (``conv_id``, ``digests``, ``sizes``; see :func:`sequences`): ``conv_id``
    (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``."""
    spark = paths.sparkSession
    bounded_batches(spark)
    columns = [x.split()[0] for x in _NODE.split(", ")][:-1]
    with scope() as made:
        paths = cut(paths)
        distinct = paths.groupBy("digests", "sizes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
        distinct = cut(distinct.withColumn("key", _digest(F.col("digests"))).join(_ends(paths), "key").drop("key"))
        empty = F.max(F.when(F.size("sizes") == 0, F.col("ends")))
        root = distinct.agg(F.min("conv_id"), F.sum("n"), F.coalesce(empty, F.lit(_NONE))).first()
        if root[0] is None:
            return spark.createDataFrame([], _NODE).select(columns)
        level = distinct.where(F.size("sizes") > 0).select("*", F.lit(1).alias("depth"), F.substring("digests", 1, DIGEST).alias("key"), F.lit(_ROOT).alias("above"), F.lit(root[0]).alias("parent"))
        built, splits = [], []
        while True:
            turns = level.groupBy("key").agg(F.sum(F.size("sizes") - F.col("depth") + 1).alias("turns"))
            oversized = cut(turns.where(F.col("turns") > LIMIT).select("key"))
            small = level.join(oversized, "key", "left_anti")
            buckets = 1 + (small.agg(F.sum(F.size("sizes") - F.col("depth") + 1)).first()[0] or 0) // BUCKET
            built.append(cut(small.groupBy(F.expr(f"pmod(xxhash64(key), {buckets})")).applyInPandas(_built, _NODE)))
            if oversized.isEmpty():
                break
            splits.append(cut(_split(level, oversized)))
            at = splits[-1].select("key", F.col("to"), F.col("conv_id").alias("parent"))
            rest = level.drop("above", "parent", "depth").join(at, "key").where(F.size("sizes") > F.col("to"))
            prefix = F.expr(f"substring(digests, 1, {DIGEST} * (to + 1))")
            level = cut(rest.select("digests", "sizes", "conv_id", "n", "ends", (F.col("to") + 1).alias("depth"), _digest(prefix).alias("key"), F.col("key").alias("above"), "parent"))
        nodes = [built[-1]]
        for split, own in zip(reversed(splits), reversed(built[:-1])):
            below = nodes[-1].where("above is not null")
            nodes.append(own.unionByName(cut(_chain(split, below))))
        keep_only(made, *built, *(x for x in made if x.columns == [*columns, "above"]))
    tops = nodes[-1].where("above is not null").agg(F.count("*"), F.coalesce(F.sum("n_leaves"), F.lit(1)), F.coalesce(F.sum("saved_tokens"), F.lit(0))).first()
    top = spark.range(1).select(*(F.lit(v).cast(t.split()[1]).alias(t.split()[0]) for v, t in zip((root[0], 0, None, root[1], *tops, root[2], None), _NODE.split(", "))))
    out = top
    for x in nodes:
        out = out.unionByName(x)
    return out.select(columns)


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    [4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda q, i: CASE WHEN q % 2 = 1 THEN xor(q // 2, 3988292384) ELSE q // 2 END))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = c.base AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND p > h
), l AS (
  SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY own, p) AS ds, list(strlen(text) ORDER BY own, p) AS sizes
  FROM r GROUP BY conv_id
), f AS (
  SELECT conv_id, coalesce(ds, []) AS ds, coalesce(sizes, []) AS sizes FROM c LEFT JOIN l USING (conv_id)
), s AS (
  SELECT conv_id, unnest(range(0, len(ds) + 1)) AS depth, ds, sizes FROM f
), m AS (
  SELECT conv_id, depth, md5(array_to_string(ds[1:depth], '')) AS k, CASE WHEN depth > 0 THEN md5(array_to_string(ds[1:depth - 1], '')) END AS up,
         CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS size, len(ds) = depth AS ends FROM s
), n AS (
  SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS members
  FROM m GROUP BY depth, k
), d AS (
  SELECT depth, up AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), w AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(n_children, 0) AS n_children
  FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.k = n.up LEFT JOIN d ON d.depth = n.depth + 1 AND d.k = n.k
), g AS (
  SELECT m.depth, m.k, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.size) AS saved
  FROM w JOIN m ON m.conv_id = w.conv_id AND m.depth <= w.depth GROUP BY ALL
)
SELECT w.conv_id, w.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(coalesce(members, '')) AS ends_sha256
FROM w JOIN g USING (depth, k)
"""
