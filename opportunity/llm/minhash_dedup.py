"""Near-duplicate classes by one-permutation MinHash, with links confirmed on full shingle sets.

Words are runs of bytes other than ASCII white space, after A-Z are lower-cased. The set of a
document holds its distinct word shingles; a document with fewer words has its whole sequence
as the only shingle; one without words has none and is linked with nothing.

1. Every row gets a number when its signature is written. Rows with equal sets form a class at
   once, named by its smallest row number.
2. One hash of each shingle gives the whole signature: the hash range is cut into bins, the
   smallest hash of each bin is kept, and empty bins copy a filled one found by a probe
   sequence that depends on the bin alone (optimal densification).
3. Bands of the signature are buckets. A bucket links its members to its smallest member only,
   so a bucket of n members gives n - 1 candidate edges.
4. Candidates are confirmed on the full sets and joined to components. Star edges alone can
   miss a link between two members that both differ from the centre. So the members of buckets
   that still hold several components get pivots: one for all that such buckets connect. Each is
   compared with its pivot, and described by what it lacks of the pivot and what it adds. Two
   sets are as like as asked only if they share enough of these differences, which the sizes
   tell exactly; a join on the rarest differences, under that bound, finds the few pairs left.
   Members far from their pivot go through the same once more, and what is then still far is
   joined on the rarest shingles of the whole sets. Only pairs across components are tried.

The sets, edges and components stay in tables of the work folder; the driver holds counts only.
Components are contracted turn by turn, until the edges left are few enough for one task
(``TASK_EDGES``, counted); later links only contract the components that they join.

Rows are told apart by their numbers, so rows that share a doc_id, or have none, are linked by
their own texts. The component_id is the smallest known doc_id of a component, null if none is
known; a row without a doc_id is kept if its component has none either. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opportunity.llm.common import arrow_batches, beside_texts, broadcast_if_small, giving_back, light, written

BANDS, ROWS = 32, 4
PIVOT_TURNS = 2
#: Turns in which rows are compared with one member of a group, and pairs a row from which that is done.
STAR_TURNS, PAIRS_A_ROW = 4, 8
#: Edges that one task joins to components at most (two 64-bit numbers each).
TASK_EDGES = 500_000
#: A bucket or pivot of more than one part in so many of all rows is joined on its own; there are at most so many of them.
HEAVY_PARTS = 1000
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    mixed = np.full(len(parts) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = mixed * MIX[0] + hashes[k : len(parts) - width + 1 + k]
    return np.unique(_mixed(mixed))


def _probes(bins: int, tries: int) -> np.ndarray:
    """Bins that an empty bin looks at, in turn."""
    x = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(1, tries + 1, dtype=np.uint64)[None, :]
    return (_mixed(x * MIX[0]) % np.uint64(bins)).astype(np.intp)


class OnePermutation:
    """Signatures and band keys of shingle sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.bins = bands * rows
        step = (1 << 64) // self.bins
        self.edges = np.array([k * step for k in range(self.bins)], np.uint64)
        self.probes = _probes(self.bins, 8 * self.bins)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """One value for each bin; ``hashes`` is sorted and not empty."""
        at = np.searchsorted(hashes, self.edges)
        ends = np.append(at[1:], len(hashes))
        filled = at < ends
        values = np.where(filled, hashes[np.minimum(at, len(hashes) - 1)], 0)
        empty = np.flatnonzero(~filled)
        for width in (16, self.probes.shape[1]):
            if not len(empty):
                return values
            found = filled[self.probes[empty, :width]]
            first = found.argmax(axis=1)
            done = found[np.arange(len(empty)), first]
            values[empty[done]] = values[self.probes[empty[done], first[done]]]
            empty = empty[~done]
        values[empty] = hashes[0]  # beyond all probes: the smallest hash, alike for equal sets
        return values

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        values = _mixed(self.signature(hashes)).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            key = key * MIX[0] + values[:, k]
        return _mixed(key).view(np.int64)


def _place() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _tie() -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, tie, n_shingles, set_key (128 bits of the whole set) and band keys of every row."""

    def begin():
        hasher = OnePermutation(bands, rows)

        def sign(texts: list[str | None]) -> dict[str, list]:
            sets = [shingle_set(t, words) for t in texts]
            return {
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "bands": [hasher.keys(s) if len(s) else [] for s in sets],
            }

        return sign

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tie().alias("tie"), "text")
    return beside_texts(read, begin, "n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """id and hashes of each class of ``asked`` (id, place, tie of one of its rows; at most one class for each text)."""

    def read(texts: list[str | None]) -> dict[str, list]:
        return {"hashes": [shingle_set(t, words).tobytes() for t in texts]}

    texts = docs.select(_place().alias("place"), _tie().alias("tie"), "text").join(broadcast_if_small(asked), ["place", "tie"])
    return beside_texts(texts.select("id", "text"), lambda: read, "hashes binary").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for left, right in zip(batch["left"], batch["right"]):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInPandas(giving_back(alike), "a long, b long")


def _joined(edges: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest id reachable from each end of all edges (a, b) of one task."""
    pairs = [frame.to_numpy(np.int64) for frame in edges]
    ids, ends = np.unique(np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    yield pd.DataFrame({"id": ids, "component": ids[root]})


def components(edges: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every end of the edges (a, b).

    Each turn maps a vertex to its smallest neighbour, or itself, and keeps the edges between
    different images; the smallest vertex of a component is never mapped away. Once the edges
    left are at most ``TASK_EDGES``, one task joins them.
    """
    current = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    steps = []
    while current.count() > TASK_EDGES:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "labels")
        steps.append(step)
        left = step.select(F.col("id").alias("a"), F.col("component").alias("pa"))
        right = step.select(F.col("id").alias("b"), F.col("component").alias("pb"))
        moved = current.join(left, "a").join(right, "b").filter("pa <> pb")
        current = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    labels = written(current.coalesce(1).mapInPandas(giving_back(_joined), "id long, component long"), "components")
    for step in reversed(steps):
        later = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        labels = written(step.join(later, "component", "left").select("id", F.coalesce("next", "component").alias("component")), "components")
    return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after more links (a, b)."""
    moved = written(_labelled(links, labels, "a", "b").filter("a_in <> b_in").select(F.col("a_in").alias("a"), F.col("b_in").alias("b")), "moved")
    if not moved.count():
        return labels
    roots = components(moved)
    later = roots.select(F.col("id").alias("component"), F.col("component").alias("next"))
    known = labels.join(later, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    return written(known.unionByName(roots.join(labels.select("id"), "id", "left_anti")), "components")


def _labelled(df: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """Adds the component of each column's id, or the id itself, as ``<column>_in``."""
    for column in columns:
        named = labels.select(F.col("id").alias(column), F.col("component").alias("_found"))
        df = df.join(named, column, "left").withColumn(f"{column}_in", F.coalesce("_found", column)).drop("_found")
    return df


def by_rare_shingles(own: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``labels`` after the links among the sets of ``own``, by prefix filtering.

    ``own`` has id, id_in and hashes. The rarest shingles come first in each set. Two sets of ``na``
    and ``nb`` shingles need ``need = ceil(percent * (na + nb) / (100 + percent))`` in common, so the
    first one that they share is among the first ``n - need + 1`` of both. No pair is made for a
    shingle that comes later in either; which sizes a shingle's sets have shortens each set at once.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for id_, comp, data in zip(batch["id"], batch["id_in"], batch["hashes"]):
                hashes = np.frombuffer(data, np.int64)
                yield pd.DataFrame({"id": id_, "comp": comp, "n": len(hashes), "shingle": hashes})

    shingles = own.select("id", "id_in", "hashes").mapInPandas(giving_back(rows), "id long, comp long, n long, shingle long")
    shingles = written(shingles, "shingles")
    common = shingles.groupBy("shingle").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("n_low")).filter("df > 1")
    shared = shingles.join(common, "shingle")
    # Shingles of one set alone come first: their number is n less the shared ones.
    by_doc = Window.partitionBy("id")
    ranked = shared.withColumn("shared", F.count("*").over(by_doc)).withColumn("place", F.row_number().over(by_doc.orderBy("df", "shingle")))
    ranked = ranked.withColumn("rank", F.col("n") - F.col("shared") + F.col("place"))
    least_need = _needed(F.col("n"), F.greatest("n_low", F.ceil(F.col("n") * percent / 100)), percent)
    prefix = ranked.filter(F.col("rank") <= F.col("n") - least_need + 1).filter("low < high").select("shingle", "id", "n", "rank")
    need = _needed(F.col("na"), F.col("nb"), percent)
    like_sizes = (F.least("na", "nb") * 100) >= (F.greatest("na", "nb") * percent)
    fits = like_sizes & (F.col("ra") <= F.col("na") - need + 1) & (F.col("rb") <= F.col("nb") - need + 1)
    return by_groups(written(prefix, "prefixes"), ["shingle"], {"n": "n", "rank": "r"}, fits, sets, labels, percent)


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Shingles that sets of n and m must have in common."""
    return F.ceil(percent * (n + m) / (100 + percent) - 1e-9)


def _with_bases(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The written ``rows`` (id, pivot and more) with the hashes of both, those of the pivot as base.

    Few bytes of pivots are broadcast. Beyond that, a pivot of many rows must not gather them in one
    task: its hashes are repeated for parts of its rows, twice ``HEAVY_PARTS`` times in all at most.
    """
    pivots = rows.groupBy(F.col("pivot").alias("id")).agg(F.count("*").alias("_rows"))
    bases = written(sets.join(pivots, "id").select(F.col("id").alias("pivot"), F.col("hashes").alias("base"), "_rows"), "bases")
    own = rows.join(sets.select("id", "hashes"), "id")
    if light(bases, "base"):
        return own.join(F.broadcast(bases.drop("_rows")), "pivot")
    step = rows.count() // HEAVY_PARTS + 1
    parts = F.ceil(F.col("_rows") / step)
    heavy = bases.filter(F.col("_rows") > step).select("pivot", parts.alias("_parts"))
    dealt = own.join(F.broadcast(heavy), "pivot", "left").withColumn("_part", F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1).cast("long"))))
    repeated = bases.select("pivot", "base", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    return dealt.join(repeated, ["pivot", "_part"]).drop("_part", "_parts")


def _with_centres(members: DataFrame, rows: int) -> DataFrame:
    """``members`` (bucket, id and more) of buckets with several, with centre (smallest id) and size of the bucket.

    ``rows`` counts the classes. Buckets that hold more than one part in ``HEAVY_PARTS`` of them, at
    most so many for each band, are broadcast, so that none gathers its members in one task.
    """
    centres = members.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("size"))
    centres = written(centres.filter("size > 1"), "centres")
    most = rows // HEAVY_PARTS + 1
    heavy = centres.filter(F.col("size") > most)
    light_ones = members.join(F.broadcast(heavy.select("bucket")), "bucket", "left_anti").join(centres.filter(F.col("size") <= most), "bucket")
    return light_ones.unionByName(members.join(F.broadcast(heavy), "bucket"))


def _pivoted(members: DataFrame, rows: int, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """id, pivot, sizes n and m of both, and both (their common shingles) of the members (bucket, id); links to pivots.

    A pivot is the smallest id of those that the buckets connect. ``rows`` counts the classes.
    """
    ties = _with_centres(members, rows).filter("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    roots = components(ties).filter("id <> component").select("id", F.col("component").alias("pivot"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch["hashes"], batch["base"])]
            out = batch[["id", "pivot"]].copy()
            out["n"], out["m"] = [len(x) for x, _ in pairs], [len(y) for _, y in pairs]
            out["both"] = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in pairs]
            yield out

    found = written(_with_bases(roots, sets).select("id", "pivot", "hashes", "base").mapInPandas(giving_back(compare), "id long, pivot long, n long, m long, both long"), "pivots")
    alike = 100 * F.col("both") >= percent * (F.col("n") + F.col("m") - F.col("both"))
    return found, found.filter(alike).select(F.col("id").alias("a"), F.col("pivot").alias("b"))


def by_differences(pivots: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``labels`` after the links among members near one pivot.

    With ``x`` lacking ``ax`` shingles of the pivot's ``m``, two sets have
    ``m - ax - ay + (common differences)`` shingles in common, and need
    ``percent * (nx + ny) / (100 + percent)``. All members are compared with the one of the least
    ``percent * n / (100 + percent) + a``; where a pair needs no common difference, both are linked
    with that one. Otherwise they share one of the first ``differences - needed + 1`` in order of
    frequency.
    """
    share = percent / (100 + percent)
    # Likeness to the pivot differs by 100 - percent points at most, so two like sets are both near or both far.
    near = pivots.filter(100 * F.col("both") >= (2 * percent - 120) * (F.col("n") + F.col("m") - F.col("both")))
    near = near.withColumn("lacks", F.col("m") - F.col("both")).withColumn("size", F.col("n") + F.col("m") - 2 * F.col("both"))
    near = _labelled(near.withColumn("g", share * F.col("n") + F.col("lacks")), labels, "id")
    groups = near.groupBy("pivot").agg(F.min_by("id", F.struct("g", "id")).alias("least"), F.min("id_in").alias("low"), F.max("id_in").alias("high"))
    near = written(near.join(groups.filter("low < high").drop("low", "high"), "pivot"), "near")
    # The least member is the most central one, such as the text that all others are edits of.
    hubs = near.filter(F.col("id") != F.col("least")).select(F.least("id", "least").alias("a"), F.greatest("id", "least").alias("b"))

    def differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                own, base = np.frombuffer(row.hashes, np.uint64), np.frombuffer(row.base, np.uint64)
                # A hash names one shingle, which a member either lacks or adds; no tag is needed.
                yield pd.DataFrame({"pivot": row.pivot, "id": row.id, "g": row.g, "mark": np.setxor1d(own, base, assume_unique=True).view(np.int64)})

    marks = written(_with_bases(near.select("id", "pivot", "g"), sets).select("id", "pivot", "g", "hashes", "base").mapInPandas(giving_back(differences), "pivot long, id long, g double, mark long"), "marks")
    common = marks.groupBy("pivot", "mark").agg(F.count("*").alias("df"), F.min("g").alias("g_low")).filter("df > 1")
    marks = marks.drop("g")
    by_doc = Window.partitionBy("pivot", "id")
    ranked = marks.join(common, ["pivot", "mark"]).withColumn("shared", F.count("*").over(by_doc)).withColumn("place", F.row_number().over(by_doc.orderBy("df", "mark")))
    ranked = ranked.join(near.select("pivot", "id", "id_in", "m", "g", "size"), ["pivot", "id"]).withColumn("rank", F.col("size") - F.col("shared") + F.col("place"))
    least_need = F.greatest(F.lit(1), F.ceil(F.col("g") + F.col("g_low") - F.col("m") - 1e-9))
    prefix = written(ranked.filter(F.col("rank") <= F.col("size") - least_need + 1).select("pivot", "mark", "id", "id_in", "m", "g", "size", "rank"), "prefixes")
    labels = merged(labels, confirmed(hubs.distinct(), sets, percent))
    need = F.ceil(F.col("ga") + F.col("gb") - F.col("m") - 1e-9)
    fits = (need >= 1) & (F.col("ra") <= F.col("sa") - need + 1) & (F.col("rb") <= F.col("sb") - need + 1)
    return by_groups(prefix.drop("id_in"), ["pivot", "mark", "m"], {"g": "g", "size": "s", "rank": "r"}, fits, sets, labels, percent)


def by_groups(prefix: DataFrame, keys: list[str], columns: dict[str, str], fits: Column, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``labels`` after all links between rows of ``prefix`` (keys, id, columns) that share the keys and satisfy ``fits``.

    ``fits`` names a pair's columns by their short name and a or b. Only pairs across components
    matter. Where they are many, every row is first compared with one member of one of its groups,
    as long as that joins components; then what is left is paired.
    """
    for turn in range(STAR_TURNS + 1):
        rows = written(_labelled(prefix, labels, "id"), "grouped")
        order = F.xxhash64(F.col("id"), F.lit(turn))
        parts = rows.groupBy(*keys, "id_in").agg(F.count("*").alias("_n"), F.min(F.struct(order.alias("o"), "id")).alias("_first"))
        groups = parts.groupBy(*keys).agg(F.count("*").alias("_parts"), F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_n")).alias("_same"), F.min(F.struct("_first", "id_in")).alias("_centre"))
        groups = written(groups.filter("_parts > 1"), "groups")
        load = groups.agg(F.sum("_n").alias("n"), F.sum((F.col("_n") * F.col("_n") - F.col("_same")) / 2).alias("pairs")).first()
        if not load.n:
            return labels
        if turn == STAR_TURNS or load.pairs <= PAIRS_A_ROW * load.n:
            break
        own = rows.join(groups.select(*keys, F.col("_centre._first.id").alias("centre"), F.col("_centre.id_in").alias("centre_in")), keys).filter("id_in <> centre_in")
        stars = own.groupBy("id").agg(F.min_by("centre", F.xxhash64("centre", F.lit(turn))).alias("centre"))
        more = merged(labels, confirmed(stars.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), sets, percent))
        if more is labels:
            break
        labels = more
    split = rows.join(groups.select(*keys), keys, "left_semi")
    left = split.select(*keys, F.col("id").alias("a"), F.col("id_in").alias("ca"), *[F.col(c).alias(f"{short}a") for c, short in columns.items()])
    right = split.select(*keys, F.col("id").alias("b"), F.col("id_in").alias("cb"), *[F.col(c).alias(f"{short}b") for c, short in columns.items()])
    pairs = left.join(right, keys).filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits).select("a", "b").distinct()
    return merged(labels, confirmed(pairs, sets, percent))


def row_components(docs: DataFrame, words: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, doc_id, tie, n_shingles and component (a row number; null where a row has no words) of every row."""
    with arrow_batches(docs.sparkSession):
        return _row_components(docs, words, percent, bands, rows)


def _row_components(docs: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    numbered = signatures(docs, words, bands, rows).withColumn("row", F.monotonically_increasing_id())
    signed = written(numbered, "signatures")  # the numbers stay as they are written
    linked = signed.filter("n_shingles > 0").withColumn("place", _place())
    classes = linked.groupBy("set_key").agg(
        F.min("row").alias("id"), F.min(F.struct("place", "tie")).alias("text"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = written(classes, "classes")
    members = classes.select("id", "n", F.explode("bands").alias("bucket"))
    count = classes.count()
    buckets = written(_with_centres(members, count), "buckets")
    sized = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"))
    stars = buckets.filter("id <> centre").groupBy("id", "centre").agg(F.first("n").alias("na"))
    stars = stars.select(F.col("id").alias("a"), F.col("centre").alias("b"), "na").join(sized, "b")
    stars = written(stars.filter((F.least("na", "nb") * 100) >= (F.greatest("na", "nb") * percent)).select("a", "b"), "stars")

    asked = buckets.select("id").distinct().join(classes.select("id", "text.place", "text.tie"), "id")
    sets = written(full_sets(docs, written(asked, "asked"), words), "sets")
    nearest = stars.groupBy("a").agg(F.min("b").alias("b"))
    labels = components(confirmed(nearest, sets, percent))
    more = _labelled(stars, labels, "a", "b").filter("a_in <> b_in").select("a", "b")
    labels = merged(labels, confirmed(more.join(nearest, ["a", "b"], "left_anti"), sets, percent))

    inside = _labelled(buckets.filter("size > 2").select("bucket", "id"), labels, "id")
    split = inside.groupBy("bucket").agg(F.min("id_in").alias("low"), F.max("id_in").alias("high")).filter("low < high")
    split = broadcast_if_small(written(split.select("bucket"), "split"))
    rest = written(buckets.filter("size > 2").join(split, "bucket").select("bucket", "id"), "open")
    for _ in range(PIVOT_TURNS):
        if not rest.count():
            break
        pivots, near = _pivoted(rest, count, sets, percent)
        labels = merged(labels, near)
        labels = by_differences(pivots, sets, labels, percent)
        far = pivots.filter(100 * F.col("both") < (percent - 20) * (F.col("n") + F.col("m") - F.col("both"))).select("id")
        rest = written(rest.join(far, "id", "left_semi").select("bucket", "id"), "open")
    if rest.count():
        last = _labelled(rest.select("id").distinct(), labels, "id")
        labels = by_rare_shingles(sets.join(last, "id"), sets, labels, percent)

    found = _labelled(classes.select("set_key", "id"), labels, "id").select("set_key", F.col("id_in").alias("component"))
    joined = signed.select("row", "doc_id", "tie", "n_shingles", "set_key").join(written(found, "named"), "set_key", "left")
    return joined.select("row", "doc_id", "tie", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    found = written(row_components(docs, words, percent, bands, rows), "rows")
    smallest = found.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    joined = found.join(written(smallest, "smallest"), "component", "left")
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one with the smallest doc_id stays.

    Rows go by doc_id and text, so rows that share an id are told apart; of rows alike in both one
    stays. Null ids come last. Rows without words all stay.
    """
    found = written(row_components(docs, words, percent).filter("component is not null").withColumn("place", _place()), "rows")
    order = F.struct(F.col("doc_id").isNull(), "place", "tie")
    best = found.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("size")).filter("size > 1")
    joined = found.join(written(best, "best"), "component")
    texts = written(joined.groupBy("place", "tie").agg(F.count("*").alias("copies"), F.max(order == F.col("best")).alias("stays")), "texts")
    gone = broadcast_if_small(written(texts.filter("not stays").select("place", "tie"), "gone"))
    several = broadcast_if_small(written(texts.filter("stays and copies > 1").select("place", "tie"), "several"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _place().alias("place"), _tie().alias("tie"))
    once = rows.join(several, ["place", "tie"], "left_semi").dropDuplicates(["place", "tie"])
    rest = rows.join(gone, ["place", "tie"], "left_anti").join(several, ["place", "tie"], "left_anti")
    return rest.unionByName(once).select("_row.*")


#: The same rows for three words and a likeness of 85 percent.
ORACLE_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
), s as (
  select doc_id, unnest(case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w
), n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select x, y from shared join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id as c from documents union select r.doc_id, e.y from r join e on r.c = e.x)
select r.doc_id, coalesce(any_value(n), 0) as n_shingles, min(c) as component_id, r.doc_id = min(c) as kept
from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""
