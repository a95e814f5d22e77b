"""Conversation prefix trie: minimal-perfect-hash node tables, counts in flat arrays, sums through parent slots.

Every prefix of a rebuilt conversation has a digest: polynomial hashes of its turns in four bases modulo
2^31 - 1, so a prefix's digest is a sum over its turns and long conversations are cut into blocks of
turns. Paths (conversation, depth, digest, parent's digest) are dealt into shards of about SHARD_ROWS
rows. A shard enumerates its distinct digests, gives each a slot by a minimal perfect hash, verifies
every row against what its slot holds (digest, depth, parent and SHA-256 of the turn), and scatters
counts and smallest members into flat arrays. Shards are merged by digest, where the same is verified
again; two prefixes that share a digest are noticed and all is done again in other bases.

A node is owned by its smallest member, in whose path its weight stands once. A second turn over the
shards scatters these weights and adds them up through parent-slot arrays, deepest nodes first; what
lies in later blocks of a conversation is carried to the last turn of a block.

Defined cases: rows without conv_id belong to no conversation; null turns come first; null role or text
is empty; turns with the same number are ordered by role and text, equal rows are turns of their own;
``c - c % 100`` cuts towards zero; without conversations there is no row. Other columns are not
read. The SHA-256 of a node's ends is a single stream by its definition: ids reach it as joined
chunks, one chunk in memory at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opportunity.llm.common import arrow_batches, written
from opportunity.operators.ranges import running_total

PRIME = (1 << 31) - 1
#: Turns of a conversation that stay together.
BLOCK = 4096
#: Rows of a shard, about.
SHARD_ROWS = 200_000
#: Ids that are joined to one chunk.
CHUNK = 4096
#: Times that other bases are tried after two prefixes shared a digest.
TRIES = 8
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


# Node tables -------------------------------------------------------------------------------


class NodeTable:
    """A minimal perfect hash of distinct digests (n x 2, 64-bit): slots 0 to n - 1, verified on lookup.

    Levels of bits: a key stays in the first level where no other key falls on its place, and its slot
    is the number of bits before that place.
    """

    SPARE = 2

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, before = keys, 0
        while len(rest):
            if len(self.levels) == 64:
                raise ValueError("keys of a node table must be distinct")
            places = self._places(rest, len(self.levels), size := self.SPARE * len(rest))
            alone = np.bincount(places, minlength=size) == 1
            self.levels.append((alone, before + np.cumsum(alone) - alone))
            before += int(alone.sum())
            rest = rest[~alone[places]]
        self.keys = np.empty_like(keys)
        self.keys[self._slots(keys)] = keys

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        # Wrapping products and shifts of both halves; the level gives other places.
        mixed = keys[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + keys[:, 1].astype(np.uint64) + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(max(1, size))).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            places = self._places(keys[open_], level, len(bits))
            hit = bits[places]
            slots[open_[hit]] = rank[places[hit]]
            open_ = open_[~hit]
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that the table does not hold."""
        found = self._slots(keys)
        known = found >= 0
        known[known] = (self.keys[found[known]] == keys[known]).all(axis=1)
        return np.where(known, found, -1)


# Paths -------------------------------------------------------------------------------------


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, at from 0, sha, chars) of the rebuilt conversations, and the conversations (conv_id, size)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    placed = running_total(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    sha = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    turns = written(placed.select("conv_id", (F.col("_upto") - 1).alias("at"), F.col("_all").alias("own"), sha.alias("sha"), F.length("text").cast("long").alias("chars")), "trie-turns")
    convs = turns.filter("at = 0").select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    heads = turns.filter("conv_id % 100 = 0 and at < 5").groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "sha", "chars"))).alias("head"))
    plan = convs.join(heads, "base", "left")  # a head has 5 turns at most and serves 100 ids
    plan = plan.withColumn("head", F.slice(F.coalesce("head", F.array()), 1, F.greatest(F.col("h"), F.lit(1)).cast("int")))
    plan = plan.withColumn("head", F.when(F.col("h") == 0, F.array()).otherwise(F.col("head")))
    kept = F.greatest(F.col("own") - F.col("h"), F.lit(0))
    plan = written(plan.select("conv_id", "h", "head", F.size("head").cast("long").alias("first"), (F.size("head") + kept).alias("size")), "trie-convs")
    first = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.at", "t.sha", "t.chars")
    later = turns.join(plan.select("conv_id", "h", "first"), "conv_id").filter("at >= h").select("conv_id", (F.col("first") + F.col("at") - F.col("h")).alias("at"), "sha", "chars")
    return first.unionByName(later), plan.select("conv_id", "size")


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.int64), base, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return out


def prefix_paths(turns: DataFrame, seed: int = 0, modulus: int = PRIME) -> DataFrame:
    """conv_id, depth, block, d1 and d2 (digest), p1 and p2 (parent's), sha and chars for each prefix of a turn or more.

    A smaller ``modulus`` is for tests of shared digests.
    """
    bases = [int(b) for b in np.random.default_rng([13, seed]).integers(1 << 20, PRIME, 4)]

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column("sha").to_pylist()), ">u4").reshape(-1, 8)[:, :4].astype(np.int64) % (PRIME - 1) + 1
            at = batch.column("at").to_numpy().astype(np.int64)
            columns = [pa.array(words[:, i] * _powers(b, at) % PRIME % modulus) for i, b in enumerate(bases)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f"t{i}" for i in range(4))])

    rows = turns.select("conv_id", "at", "sha", "chars").mapInArrow(terms, "conv_id long, at long, sha binary, chars long, t0 long, t1 long, t2 long, t3 long")
    rows = rows.withColumn("block", F.floor(F.col("at") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"s{i}": F.sum(f"t{i}").over(inside) for i in range(4)})
    # Only conversations of several blocks need what stands before a block.
    ends = rows.filter((F.col("at") + 1) % BLOCK == 0).select("conv_id", (F.col("block") + 1).alias("block"), *[(F.col(f"s{i}") % modulus).alias(f"e{i}") for i in range(4)])
    upto = Window.partitionBy("conv_id").orderBy("block")
    before = ends.select("conv_id", "block", *[F.sum(f"e{i}").over(upto).alias(f"b{i}") for i in range(4)])
    rows = rows.join(before, ["conv_id", "block"], "left")
    whole = [(F.coalesce(f"b{i}", F.lit(0)) + F.col(f"s{i}")) % modulus for i in range(4)]
    rows = rows.withColumns({f"w{i}": w for i, w in enumerate(whole)})
    rows = rows.withColumns({f"v{i}": F.pmod(F.col(f"w{i}") - F.col(f"t{i}"), F.lit(modulus)) for i in range(4)})
    pair = lambda a, b: F.shiftleft(a, 31) + F.col(b)
    return rows.select("conv_id", (F.col("at") + 1).alias("depth"), "block", pair("w0", "w1").alias("d1"), pair("w2", "w3").alias("d2"), pair("v0", "v1").alias("p1"), pair("v2", "v3").alias("p2"), "sha", "chars")


# Shards ------------------------------------------------------------------------------------


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a shard, whose size is bounded."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _longs(table: pa.Table, *names: str) -> np.ndarray:
    return np.stack([table.column(n).to_numpy().astype(np.int64) for n in names], axis=1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct digests of a shard with members, smallest member, and whether its rows differ."""
    table = _whole(batches)
    if table is None:
        return
    digests, about = _longs(table, "d1", "d2"), _longs(table, "depth", "p1", "p2", "chars")
    sha = np.frombuffer(b"".join(table.column("sha").to_pylist()), np.uint64).reshape(-1, 4)
    nodes = NodeTable(np.unique(digests, axis=0))
    slot, n = nodes.slots(digests), len(nodes.keys)
    row = np.zeros(n, np.int64)
    row[slot] = np.arange(len(slot))  # one row of each node
    other = (about != about[row[slot]]).any(axis=1) | (sha != sha[row[slot]]).any(axis=1)
    clash = np.bincount(slot, weights=other, minlength=n) > 0
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, _longs(table, "conv_id")[:, 0])
    columns = [*nodes.keys.T, *about[row].T, np.bincount(slot, minlength=n).astype(np.int64), least]
    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), table.column("sha").combine_chunks().take(pa.array(row)), pa.array(clash)], ["d1", "d2", "depth", "p1", "p2", "chars", "members", "least", "sha", "clash"])


def _adder(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Leaves and saved tokens below each digest of a shard, by its own rows' weights."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        digests, parents, depths = _longs(table, "d1", "d2"), _longs(table, "p1", "p2"), table.column("depth").to_numpy()
        nodes = NodeTable(np.unique(np.concatenate([digests, np.zeros((1, 2), np.int64)]), axis=0))  # and the root
        slot, n = nodes.slots(digests), len(nodes.keys)
        sums = np.zeros((n, 2), np.int64)
        np.add.at(sums, slot, _longs(table, "leaf", "saved"))
        parent, depth = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        parent[slot], depth[slot] = nodes.slots(parents), depths
        parent[(depth > 1) & ((depth - 1) % block == 0)] = -1  # in the block before, which gets it by what is carried
        order = np.argsort(-depth, kind="stable")
        order = order[(depth[order] > 0) & (parent[order] >= 0)]
        for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
            np.add.at(sums, parent[level], sums[level])
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in (*nodes.keys.T, *sums.T))], ["d1", "d2", "leaves", "saved"])

    return added


def _nodes(paths: DataFrame, shards: int) -> DataFrame:
    """A row for each digest: depth, parent, chars, members, least, and whether different prefixes share it."""
    found = paths.repartition(shards, "conv_id", "block").mapInArrow(_counted, "d1 long, d2 long, depth long, p1 long, p2 long, chars long, members long, least long, sha binary, clash boolean")
    differ = F.lit(False)
    for c in ("depth", "p1", "p2", "sha"):
        differ |= F.min(c) != F.max(c)
    return found.groupBy("d1", "d2").agg(
        F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"), F.sum("members").alias("n_convs"), F.min("least").alias("conv_id"), (F.bool_or("clash") | differ).alias("clash")
    )


def _sums(paths: DataFrame, nodes: DataFrame, shards: int) -> DataFrame:
    """d1, d2, n_leaves and saved_tokens of every node but a lonely root."""
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    rows = paths.select("conv_id", "depth", "block", "d1", "d2", "p1", "p2").join(own, ["conv_id", "depth"], "left").fillna(0, ["leaf", "saved"])
    rows = written(rows, "trie-weights")
    # What a conversation owns in later blocks is added at the last turn of each earlier one.
    totals = rows.groupBy("conv_id", "block").agg(F.sum("leaf").alias("_leaf"), F.sum("saved").alias("_saved"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv_id", ((F.col("block") + 1) * BLOCK).alias("depth"), F.sum("_leaf").over(later).alias("_leaf"), F.sum("_saved").over(later).alias("_saved")).filter("_leaf is not null and (_leaf > 0 or _saved > 0)")
    rows = rows.join(carry, ["conv_id", "depth"], "left")
    rows = rows.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("leaf", "saved")}).drop("_leaf", "_saved")
    found = rows.repartition(shards, "conv_id", "block").mapInArrow(_adder(BLOCK), "d1 long, d2 long, leaves long, saved long")
    return found.groupBy("d1", "d2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


# Ends --------------------------------------------------------------------------------------


def _chunker(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (digest, id) rows as joined ids, ``chunk`` at most to a row."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            part = frame.groupby(["d1", "d2"], sort=False).cumcount() // chunk
            rows = [(*key[:2], int(ids.iloc[0]), ",".join(map(str, ids))) for key, ids in frame.groupby(["d1", "d2", part], sort=False)["conv_id"]]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["d1", "d2", "start", "ids"]), preserve_index=False)

    return chunks


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each digest's chunks, which come in order."""
    now, state = None, None
    done: list[tuple[int, int, str]] = []
    for batch in batches:
        for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids")), strict=True):
            if (d1, d2) == now:
                state.update(b",")
            else:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (d1, d2), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["d1", "d2", "ends_sha256"]), preserve_index=False)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_pandas(pd.DataFrame([(*now, state.hexdigest())], columns=["d1", "d2", "ends_sha256"]), preserve_index=False)


def _ends(ends: DataFrame, parts: int) -> DataFrame:
    """d1, d2 and ends_sha256 of every node where a conversation ends; ``ends`` has conv_id, d1 and d2."""
    dealt = ends.repartitionByRange(parts, "d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
    chunks = dealt.select("d1", "d2", "conv_id").mapInArrow(_chunker(CHUNK), "d1 long, d2 long, start long, ids string")
    return chunks.repartition(parts, "d1", "d2").sortWithinPartitions("d1", "d2", "start").select("d1", "d2", "ids").mapInArrow(_streamed, "d1 long, d2 long, ends_sha256 string")


def trie_nodes(conversations: DataFrame, seed: int = 0, modulus: int = PRIME) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node.

    Turns, paths and node tables are written to the work folder while the plan is built.
    """
    spark = conversations.sparkSession
    turns, convs = rebuilt_turns(conversations)
    turns = written(turns, "trie-rebuilt")
    shards = max(1, -(-turns.count() // SHARD_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    for attempt in range(TRIES):
        paths = written(prefix_paths(turns, seed + attempt, modulus), "trie-paths")
        nodes = written(_nodes(paths, shards), "trie-nodes")
        if not nodes.filter("clash").limit(1).count():
            break
    else:
        raise ValueError(f"prefixes share a digest in {TRIES} sets of bases")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = root.select(zero.alias("d1"), zero.alias("d2"), zero.alias("depth"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("chars"), "n_convs", "conv_id")
    nodes = root.unionByName(nodes.drop("clash"))
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, ["d1", "d2"], "left").fillna(0, ["n_children"]), "trie-children")
    with arrow_batches(spark, rows=50_000):
        sums = written(_sums(paths, nodes, shards), "trie-sums")
        last = paths.join(convs.filter("size > 0"), "conv_id").filter("depth = size").select("conv_id", "d1", "d2")
        ends = written(_ends(last.unionByName(convs.filter("size = 0").select("conv_id", zero.alias("d1"), zero.alias("d2"))), shards), "trie-ends")
    # A parent that the node's own smallest member owns is known; others are looked up, the root by its depth.
    owner = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    top = nodes.filter("depth = 0").select(F.col("conv_id").alias("_root"))
    below = nodes.filter("depth > 1").join(owner, ["p1", "p2"], "left")
    upper = nodes.filter("depth <= 1").crossJoin(F.broadcast(top)).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("_root"))).drop("_root")  # one row on the right
    out = upper.unionByName(below.select(*upper.columns)).join(sums, ["d1", "d2"], "left").join(ends, ["d1", "d2"], "left")
    lonely = F.col("n_children") == 0  # a root without turns below it is a leaf
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.when(lonely, 1).otherwise(0).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256"),
    )


# The SQL engine has no CRC-32: bits are shifted one after the other, over the digits of the id.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint)"
)
ORACLE_SQL = (
    "with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos from conversations where conv_id is not null), "
    "l as (select conv_id, list({'r': role, 't': text} order by pos) as turns from t group by 1), "
    f"h as (select conv_id, turns, ({_CRC}) % 6 as h from l), "
    "r as (select h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(h.turns, h + 1, len(h.turns))) as turns from h left join l b on b.conv_id = h.conv_id - h.conv_id % 100), "
    "p as (select conv_id, len(turns) as size, d as depth, list_slice(turns, 1, d) as prefix, case when d > 0 then list_slice(turns, 1, d - 1) end as above from (select *, unnest(range(0, len(turns) + 1)) as d from r)), "
    "n as (select depth, prefix, above, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = depth), '') as ends from p group by depth, prefix, above), "
    "k as (select above as prefix, count(*) as n_children from n where depth > 0 group by 1), "
    "w as (select n.*, coalesce(n_children, 0) as n_children, case when depth > 0 then (n_convs - 1) * length(prefix[depth].t) else 0 end as saved from n left join k using (prefix)), "
    "s as (select list_slice(prefix, 1, d) as prefix, sum(saved)::bigint as saved_tokens, (count(*) filter (where n_children = 0))::bigint as n_leaves from (select *, unnest(range(0, depth + 1)) as d from w) group by 1) "
    "select w.conv_id, w.depth::bigint as depth, q.conv_id as parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(w.ends) as ends_sha256 from w join s using (prefix) left join w q on q.prefix = w.above"
)
