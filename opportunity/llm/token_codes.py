"""Token ids in directly addressable code blocks.

Each id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunk of the ids
that have one, a bitmap that marks which of them go on to level k+1, and a rank directory
with the number of set bits before each 512-bit word. Token ``i`` is read by following
``i -> rank(i)`` through the levels, so no block is decoded to reach one token.

A stored table has one row per block. A block holds whole documents in ascending order
(doc_id, then a hash of the text; null ids first), and its own directory of documents. The
documents are dealt out by range, so encoding, writing and reading work per block and no
task or driver sees the corpus.

Null and empty texts have only the end token. Repeated rows are separate documents. A very
long text makes a block of its own. An empty table gives an empty store.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opportunity.llm.common import arrow_batches, giving_back, kept, partitions, work_path

STORE_SCHEMA = (
    "part int, block int, first_token long, n_tokens long, doc_ids array<long>, doc_starts array<long>, "
    "chunks array<binary>, more array<binary>, ranks array<binary>"
)
DOCUMENTS_SCHEMA = "part int, block int, doc_id long, in_part long, n_tokens long, ids_crc32 long"
#: Tokens after which a block is closed at the next document's end.
BLOCK_TOKENS = 1 << 17
#: Marks that stay apart from a letter before them.
TAIL_MARKS = b".,;:!?|&%$*#"
_IS_BLANK, _IS_MARK, _IS_ASCII_LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_IS_BLANK[list(b" \t\n\r")] = True
_IS_MARK[list(TAIL_MARKS)] = True
_IS_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True

#: Longer words are encoded again each time, so that the memory of words stays small.
LONG_WORD = 256
#: Bytes of text that are looked up together, and ids that the memory of words holds at most.
RUN_BYTES, MAX_IDS = 1_500_000, 4_000_000


class WordEncoder:
    """Encodes texts with the tokenizers library, which sees each distinct piece once.

    Pieces are what stands between spaces, tabs and line ends. The normalizer composes and
    lower-cases nothing across these, and the splitter must drop white space; so the ids of a
    text are those of its pieces. A piece is cut further only where that is safe for every text:
    between an ASCII, Latin-1 or Cyrillic letter and an ASCII mark behind it, which no run of the
    splitter takes together, unless the piece has a ``<`` and might hold a special token. Pieces of
    ASCII alone without a ``<`` are lower-cased, where the tokenizer does so. All others go to the library as they
    are written. The memory of pieces starts anew beyond ``max_words``.
    """

    def __init__(self, path: str, max_words: int = 250_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        wide = self.library.get_vocab_size(with_added_tokens=True) > 65_536
        self.kind = np.uint32 if wide else np.uint16
        self.folds = self.library.encode("AZ", add_special_tokens=False).ids == self.library.encode("az", add_special_tokens=False).ids
        self.max_words = max_words
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix")
        self.ends_word = np.zeros(1 + max(self.library.get_vocab(with_added_tokens=True).values()), bool)
        if suffix:
            self.ends_word[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.pool = np.zeros(1 << 16, self.kind)
        self.words = self.held = 0

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and how many each has."""
        found = self.library.encode_batch_fast(pieces, add_special_tokens=False)
        ids = [e.ids for e in found]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.kind, int(sizes.sum())), sizes

    def _encoded_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of letters, each of which ends in the only token that ends a word."""
        flat, _ = self._encoded([" ".join(words[k : k + 64]) for k in range(0, len(words), 64)])
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) != len(words) or len(flat) != (ends[-1] if len(ends) else 0):
            return self._encoded(words)
        return flat, np.diff(ends, prepend=0)

    def _learn(self, new: list[str]) -> None:
        # Letters below U+0530, but for one, stay single letters under any normalizer.
        words = [piece for piece in new if piece.isalpha() and max(piece) < "\u0530" and "\u0130" not in piece]
        others = list(set(new).difference(words))
        parts = [self._encoded_words(words[k : k + 8192]) for k in range(0, len(words), 8192)]
        parts += [self._encoded(others[k : k + 4096]) for k in range(0, len(others), 4096)]
        flat, sizes = (np.concatenate(x) for x in zip(*parts))
        new = words + others
        self.starts = _room(self.starts, self.words, len(new))
        self.sizes = _room(self.sizes, self.words, len(new))
        self.pool = _room(self.pool, self.held, len(flat))
        self.starts[self.words : self.words + len(new)] = self.held + np.cumsum(sizes) - sizes
        self.sizes[self.words : self.words + len(new)] = sizes
        self.pool[self.held : self.held + len(flat)] = flat
        self.slots.update(zip(new, range(self.words, self.words + len(new))))
        self.words += len(new)
        self.held += len(flat)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of an array of strings without nulls."""
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        done = 0
        while done < len(texts):
            upto = max(done + 1, int(np.searchsorted(bounds, bounds[done] + RUN_BYTES, side="right")) - 1)
            some = bounds[done : upto + 1]
            raw = np.frombuffer(data, np.uint8)[some[0] : some[-1]] if data is not None else np.zeros(0, np.uint8)
            yield from self._run(raw, some - some[0])
            done = upto

    def _run(self, raw: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """``raw`` holds the UTF-8 of texts one after the other, cut at ``bounds``."""
        pieces, upto = _pieces(raw, bounds, self.folds)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [piece for piece in distinct if piece not in self.slots]
        if new and (self.words + len(new) > self.max_words or self.held > MAX_IDS):
            self.forget()
            new = distinct
        if new:
            self._learn(new)
        slots = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        sizes = self.sizes[slots]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.starts[slots] - before[:-1], sizes) + np.arange(before[-1])]
        yield from np.split(ids, before[upto[1:-1]])
        for piece in new:
            if len(piece) > LONG_WORD:
                del self.slots[piece]


def _pieces(raw: np.ndarray, bounds: np.ndarray, fold: bool) -> tuple[pa.Array, np.ndarray]:
    """All pieces in order, and how many of them stand before each of the ``bounds``."""
    n = len(raw)
    blank = _IS_BLANK[raw]
    last = np.zeros(n + 1, bool)  # the last byte of a piece
    last[:-2] = blank[1:]
    last[bounds - 1] = True
    at = np.flatnonzero(_IS_MARK[raw[1:]])  # a mark stands behind each of these bytes
    here, before = raw[at], raw[np.maximum(at - 1, 0)]
    latin = (before == 0xC3) & (here >= 0x80) & (here != 0x97) & (here != 0xB7)
    cyrillic = ((before == 0xD0) & (here >= 0x80)) | ((before == 0xD1) & (here >= 0x80) & (here < 0xA0))
    cut = at[_IS_ASCII_LETTER[here] | latin | cyrillic]
    angle = np.flatnonzero(raw == 0x3C)
    if len(angle):
        word = np.cumsum(blank | np.concatenate([[False], last[: n - 1]]), dtype=np.int32)
        cut = cut[~np.isin(word[cut], word[angle])]
    last[cut] = True
    kept = ~blank
    text, last = raw[kept], last[:n][kept]
    ends = np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], ends])
    if fold:
        upper = (text >= 65) & (text <= 90)
        if upper.any():
            plain = np.maximum.reduceat(np.where(text == 0x3C, 0xFF, text) if len(angle) else text, offsets[:-1]) < 0x80
            text = text + np.uint8(32) * (upper & np.repeat(plain, np.diff(offsets)))
    inside = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])[bounds]
    pieces = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text)))
    return pieces, np.searchsorted(ends, inside, side="right")


def _room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    """``values``, made longer where ``more`` do not fit behind the first ``used``."""
    if used + more <= len(values):
        return values
    grown = np.zeros(max(2 * len(values), used + more), values.dtype)
    grown[:used] = values[:used]
    return grown


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker and its memory of words, which its later tasks of this operator use again."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread keeps memory
    return kept(f"encoder {path}", lambda: WordEncoder(path))


def pack_block(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of one block, by level."""
    chunks, more, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        chunks.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest >>= 8
        goes_on = rest > 0
        bits = np.packbits(goes_on, bitorder="little")
        more.append(bits.tobytes())
        per_word = np.add.reduceat(goes_on, np.arange(0, len(goes_on), 512), dtype=np.uint32) if len(goes_on) else np.zeros(0, np.uint32)
        ranks.append((np.cumsum(per_word, dtype=np.uint32) - per_word).astype("<u4").tobytes())
        rest = rest[goes_on]
        if not len(rest):
            return chunks, more, ranks


def unpack_block(chunks: list[bytes], more: list[bytes]) -> np.ndarray:
    """All ids of a block as unsigned 32-bit integers."""
    ids = np.frombuffer(chunks[0], np.uint8).astype(np.uint32)
    at = np.arange(len(ids))
    for level in range(1, len(chunks)):
        goes_on = np.unpackbits(np.frombuffer(more[level - 1], np.uint8), count=len(at), bitorder="little").astype(bool)
        at = at[goes_on]
        ids[at] |= np.frombuffer(chunks[level], np.uint8).astype(np.uint32) << np.uint32(8 * level)
    return ids


def token_in_block(chunks: list[bytes], more: list[bytes], ranks: list[bytes], i: int) -> int:
    """One id by rank queries alone; reads a few bytes of each level."""
    value, i = 0, int(i)
    for level in range(len(chunks)):
        value |= chunks[level][i] << (8 * level)
        if not more[level][i >> 3] >> (i & 7) & 1:
            break
        word = i >> 9
        before = int.from_bytes(ranks[level][4 * word : 4 * word + 4], "little")
        whole = int.from_bytes(more[level][64 * word : (i >> 3) + 1], "little")
        i = before + (whole & ((1 << (i - 512 * word)) - 1)).bit_count()
    return value


def write_token_codes(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> str:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and store the blocks at ``path``.

    ``tokenizer`` is a file of the tokenizers library. ``end_id`` ends each document. Other
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession

    fields = to_arrow_schema(StructType.fromDDL(STORE_SCHEMA))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        block = first = held = 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        starts: list[int] = []
        end = np.array([end_id], np.uint32)

        def closed() -> pa.RecordBatch:
            row = (part, block, first, held, doc_ids, starts, *pack_block(np.concatenate(ids)))
            return pa.RecordBatch.from_pylist([dict(zip(fields.names, row))], fields)

        for batch in batches:
            # Ids stay integers: beside a null, pandas would make doubles of them.
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                doc_ids.append(doc_id)
                starts.append(held)
                ids += [got, end]
                held += len(got) + 1
                if held >= block_tokens:
                    yield closed()
                    block, first, held, ids, doc_ids, starts = block + 1, first + held, 0, [], [], []
        if doc_ids:
            yield closed()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    with arrow_batches(spark):
        # Pages are looked at after few rows, as a row is a block: Parquet would else hold a hundred of them in one.
        ordered.mapInArrow(giving_back(encode, keeps=True), STORE_SCHEMA).write.option("parquet.page.size.row.check.min", 8).parquet(path)
    return path


def read_token_codes(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32, block and place in it.

    start counts the ids of all documents before it in the whole store; the totals of the
    parts, one small row each, are summed and joined back.
    """
    store = spark.read.schema(STORE_SCHEMA).parquet(path)

    fields = to_arrow_schema(StructType.fromDDL(DOCUMENTS_SCHEMA))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (part, block, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "block", "first_token")))):
                ids = unpack_block(batch.column("chunks")[k].as_py(), batch.column("more")[k].as_py()).astype("<u4")
                bounds = np.array([*batch.column("doc_starts")[k].as_py(), len(ids)], np.int64)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
                n = len(sums)
                columns = [[part] * n, [block] * n, batch.column("doc_ids")[k].values, first + bounds[:-1], np.diff(bounds), sums]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    totals = store.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base"))
    found = store.select("part", "block", "first_token", "doc_ids", "doc_starts", "chunks", "more")
    found = found.mapInArrow(giving_back(documents, keeps=True), DOCUMENTS_SCHEMA)
    joined = found.join(F.broadcast(bases), "part")  # as many rows as the store has parts
    return joined.select("doc_id", (F.col("base") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", "part", "block")


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> dict[int, int]:
    """Ids at the given places of the whole store, by random access to the blocks that hold them.

    ``places`` is a list the caller chose; only the matching blocks are read.
    """
    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    totals = sorted((r.part, r.n) for r in store.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, base = {}, 0
    for part, n in totals:
        bases[part] = base
        base += n
    wanted: dict[int, list[int]] = {}
    for place in places:
        if not 0 <= place < base:
            raise IndexError(place)
        part = max((p for p in bases if bases[p] <= place), key=lambda p: (bases[p], p))
        wanted.setdefault(part, []).append(place - bases[part])
    inside = F.lit(False)
    for part, local in wanted.items():
        for i in local:
            inside |= (F.col("part") == part) & (F.col("first_token") <= i) & (F.col("first_token") + F.col("n_tokens") > i)

    def reads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                hits = [i for i in wanted[row.part] if row.first_token <= i < row.first_token + row.n_tokens]
                yield pd.DataFrame({"place": [bases[row.part] + i for i in hits], "id": [token_in_block(row.chunks, row.more, row.ranks, i - row.first_token) for i in hits]})

    held = store.filter(inside).select("part", "first_token", "n_tokens", "chunks", "more", "ranks")
    return {r.place: r.id for r in held.mapInPandas(reads, "place long, id long").collect()}


def token_codes(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as directly addressable codes in the work folder and read them back."""
    spark = docs.sparkSession
    return read_token_codes(spark, write_token_codes(docs, work_path(spark, "token-codes"), tokenizer, end_id))
