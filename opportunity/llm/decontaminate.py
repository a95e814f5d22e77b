r"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Words are runs of letters and digits of the lower-cased text. A seed is a hash of the words
that a fixed mask keeps, at some place of a test item or a document; the words under a 0 are
ignored. Seeds of documents are joined with those of the test items. Around each hit the two
texts are laid over each other, and a window of 13 words (the whole item where it is shorter)
that takes in the seed must have 11 equal words in place (or that share of a shorter item,
rounded up).

What is found is exactly what has such a window, for items of any length from one word on:

* in 13 words, two substitutions always leave one of the three masks whole;
* items of 7 to 12 words allow one substitution, which leaves their first or their second half
  whole; these halves are seeds without gaps;
* shorter items allow none, and are their own seed.

Documents are cut into short overlapping chunks before their seeds are laid out, so that bytes
grow with the words and not with their square. Up to a bound the seeds of the test items are
broadcast, after they are counted. Beyond it only a bit for each of ``BITS`` remainders is, 16 MB
for any number of seeds; the documents' seeds that find their bit set are then shuffled by seed.
A document's words are read again only where it has a hit.

Items are told apart by row: a repeated or null item_id is searched by each of its texts, and
reported once under that id. Null and empty texts have no words. Documents with the same doc_id
are searched by their own texts and reported together. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opportunity.llm.common import BROADCAST_BYTES, broadcast_if_small, small, written

#: Every pattern of two substitutions in 13 words leaves one of these whole (checked in the tests).
MASKS = ("111001001", "10001111", "110111")
WINDOW, EQUAL = 13, 11
SPLIT = r"[^\p{L}\p{N}]+"
#: Seeds of the test items up to which they are broadcast.
SEED_ROWS = 200_000
#: Bits that tell which seeds may be asked for, and the 64-bit words of a row of them.
BITS, ROW_WORDS = 1 << 27, 512
#: Words of a chunk of a document.
CHUNK = 64
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(words: Column, place: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(words, place + k) for k, bit in enumerate(mask) if bit == "1"])


def _laid(words: Column, place: Column, masks: list[str]) -> Column:
    """mask and seed of each mask that fits at a place."""
    return F.array(*[F.when(place + len(mask) <= F.size(words), F.struct(F.lit(mask).alias("mask"), _seed(words, place, mask).alias("seed"))) for mask in masks])


def item_seeds(items: DataFrame, masks: tuple[str, ...], window: int, equal: int) -> DataFrame:
    """item, mask, seed and item_place of the test items (item, item_words)."""
    sized = items.withColumn("n", F.size("item_words"))
    long = sized.filter(F.col("n") >= window).select("item", "item_words", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("item_place"))
    found = long.select("item", "item_place", F.explode(_laid(F.col("item_words"), F.col("item_place"), list(masks))).alias("laid"))
    for n in range(1, window):
        gaps = n - -(-n * equal // window)
        # One run of words more than there are substitutions: one of them stays whole.
        edges = [n * k // (gaps + 1) for k in range(gaps + 2)]
        runs = [(a, "1" * (b - a)) for a, b in zip(edges, edges[1:])]
        laid = F.array(*[F.struct(F.lit(a).alias("item_place"), F.lit(run).alias("mask"), _seed(F.col("item_words"), F.lit(a), run).alias("seed")) for a, run in runs])
        short = sized.filter(F.col("n") == n).select("item", F.explode(laid).alias("laid"))
        found = found.unionByName(short.select("item", "laid.item_place", F.struct("laid.mask", "laid.seed").alias("laid")))
    return found.filter("laid is not null").select("item", "item_place", "laid.mask", "laid.seed")


def document_seeds(docs: DataFrame, masks: list[str]) -> DataFrame:
    """doc_place, tie, place, mask and seed of the documents (doc_place, tie, words)."""
    longest = max(map(len, masks))
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(CHUNK))
    chunks = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, F.lit(CHUNK + longest - 1)).alias("chunk")))
    cut = docs.filter(F.size("words") > 0).select("doc_place", "tie", F.explode(chunks).alias("c")).select("doc_place", "tie", "c.start", "c.chunk")
    placed = cut.select("doc_place", "tie", "start", "chunk", F.posexplode("chunk").alias("at", "_word")).filter(F.col("at") < CHUNK)
    laid = placed.select("doc_place", "tie", (F.col("start") + F.col("at")).alias("place"), F.explode(_laid(F.col("chunk"), F.col("at"), masks)).alias("laid"))
    return laid.filter("laid is not null").select("doc_place", "tie", "place", "laid.mask", "laid.seed")


def _with_bit(own: DataFrame, seeds: DataFrame) -> DataFrame:
    """The rows of ``own`` whose seed leaves a remainder that one of ``seeds`` leaves: all that are asked for, and few others."""
    bit = F.pmod("seed", F.lit(BITS))
    word, at = F.floor(bit / 64), F.pmod("seed", F.lit(64)).cast("int")
    words = seeds.groupBy(word.alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(seed, 64) as int))")).alias("_bits"))
    rows = words.groupBy(F.floor(F.col("_word") / ROW_WORDS).alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("_word") % ROW_WORDS).alias("at"), "_bits"))).alias("_set"))
    rows = rows.select("_row", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(ROW_WORDS - 1).cast("long")), lambda k: F.coalesce(F.try_element_at("_set", k), F.lit(0).cast("long"))).alias("_words"))
    rows = written(rows, "seed-bits")  # at most BITS / 64 / ROW_WORDS rows
    joined = own.withColumn("_row", F.floor(word / ROW_WORDS)).join(F.broadcast(rows), "_row")
    return joined.filter(F.getbit(F.get("_words", (word % ROW_WORDS).cast("int")), at) == 1).drop("_row", "_words")


def row_overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, equal: int = EQUAL) -> DataFrame:
    """doc_place and tie (of the document's row), item_id, equal_words and place of each hit that holds."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("item_words")).withColumn("item", F.monotonically_increasing_id())
    items = written(items, "items")  # the numbers stay as they are written
    seeds = written(item_seeds(items, masks, window, equal), "item-seeds")
    runs = [r.mask for r in seeds.filter(~F.col("mask").isin(*masks)).select("mask").distinct().collect()]  # fewer than ``window``
    read = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_place"), F.xxhash64("text").alias("tie"), "text")
    own = document_seeds(read.select("doc_place", "tie", word_hashes(F.col("text")).alias("words")), [*masks, *sorted(runs)])
    if small(seeds, SEED_ROWS):
        hits = own.join(F.broadcast(seeds), ["mask", "seed"])
    else:
        hits = _with_bit(own, seeds).join(seeds.hint("merge"), ["mask", "seed"])
    hits = hits.select("doc_place", "tie", "place", F.length("mask").alias("span"), "item", "item_place")
    hits = written(hits, "seed-hits").distinct()  # rows alike in id and text give the same hits
    asked = broadcast_if_small(written(hits.select("doc_place", "tie").distinct(), "hit-documents"))
    texts = read.join(asked, ["doc_place", "tie"], "left_semi").dropDuplicates(["doc_place", "tie"])
    texts = written(texts.select("doc_place", "tie", word_hashes(F.col("text")).alias("words")), "hit-words")
    # Words of the items, 8 bytes each.
    few = items.agg(F.coalesce(F.sum(F.size("item_words")), F.lit(0)).alias("n")).first().n * 8 <= BROADCAST_BYTES
    laid = hits.join(F.broadcast(items) if few else items, "item").join(texts, ["doc_place", "tie"])

    length = F.size("item_words")
    width = F.least(F.lit(window), length)
    start = F.greatest(F.lit(0), F.col("item_place") + F.col("span") - width)
    end = F.least(F.col("item_place"), length - width)
    shift = F.col("place") - F.col("item_place")

    def same(k: Column) -> Column:
        at = shift + k
        return F.when((at >= 0) & (F.get("words", at) == F.get("item_words", k)), 1).otherwise(0)

    counts = F.transform(F.sequence(start, end), lambda s: F.aggregate(F.sequence(s, s + width - 1), F.lit(0), lambda total, k: total + same(k)))
    found = laid.select("doc_place", "tie", "item_id", "place", F.array_max(counts).alias("equal_words"), F.ceil(width * equal / window).alias("need"))
    return found.filter("equal_words >= need")


def overlaps(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """doc_id, item_id, equal_words (most in a window) and first_word (of that document) of each overlap."""
    found = row_overlaps(docs, benchmark, **parameters).withColumn("doc_id", F.when(F.col("doc_place") != NO_ID, F.col("doc_place")))
    return found.groupBy("doc_id", "item_id").agg(F.max("equal_words").cast("long").alias("equal_words"), F.min("place").cast("long").alias("first_word"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` whose text has no overlap with a test item, with their own columns."""
    flagged = row_overlaps(docs, benchmark, **parameters).select(F.col("doc_place").alias("_place"), F.col("tie").alias("_tie")).distinct()
    flagged = broadcast_if_small(written(flagged, "flagged"))
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("_place")) & (F.xxhash64(docs["text"]) == F.col("_tie"))
    return docs.join(flagged, same, "left_anti")


ORACLE_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as words from documents
), i as (
  select row_number() over () as item, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as words from benchmark
), masks as (
  select * from (values (0, [0, 1, 2, 5, 8], 9), (1, [0, 4, 5, 6, 7], 8), (2, [0, 1, 3, 4, 5], 6)) as m(mask, kept, span)
), bs as (
  select item, mask, span, place as item_place, list_transform(kept, lambda k: words[place + 1 + k]) as seed
  from (select item, words, unnest(range(len(words))) as place from i where len(words) >= 13), masks where place + span <= len(words)
  union all
  select item, 2 + len(words) as mask, len(words) as span, 0 as item_place, words as seed from i where len(words) between 1 and 6
  union all
  select item, 2 + e - b as mask, e - b as span, b as item_place, words[b + 1 : e] as seed
  from (select item, words, unnest([0, len(words) // 2]) as b, unnest([len(words) // 2, len(words)]) as e from i where len(words) between 7 and 12)
), ds as (
  select doc_id, words, mask, span, place, list_transform(kept, lambda k: words[place + 1 + k]) as seed
  from (select doc_id, words, unnest(range(len(words))) as place from w), masks where place + span <= len(words)
  union all
  select doc_id, words, mask, span, place, words[place + 1 : place + span] as seed
  from (select doc_id, words, unnest(range(len(words))) as place from w), (select distinct mask, span from bs where mask > 2) where place + span <= len(words)
), hits as (
  select ds.doc_id, i.item_id, ds.place, ds.span, bs.item_place, ds.words, i.words as item_words, least(13, len(i.words)) as width
  from ds join bs on ds.mask = bs.mask and ds.seed = bs.seed join i on i.item = bs.item
), wins as (
  select doc_id, item_id, place, width, words, item_words, item_place,
    unnest(range(greatest(0, item_place + span - width), least(item_place, len(item_words) - width) + 1)) as s from hits
), counted as (
  select doc_id, item_id, place, width,
    len(list_filter(range(s, s + width), lambda k: place - item_place + k >= 0 and words[(place - item_place + k + 1)::int] = item_words[k + 1])) as equal_words
  from wins
)
select doc_id, item_id, max(equal_words)::bigint as equal_words, min(place)::bigint as first_word
from counted where equal_words >= ceil(width * 11 / 13.0) group by doc_id, item_id
"""
