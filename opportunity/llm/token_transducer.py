"""Token counts of a byte-level BPE tokenizer by compiled finite-state transducers.

Two deterministic transducers do the work.

* The splitter reads code points by class and marks where pre-tokens start. A text is cut
  into chunks of equal length; every chunk is run from every state at once, which gives a
  map from states to states; the maps are composed by a parallel prefix scan, and a second
  run of each chunk from its now known state emits the marks.
* The merger reads the bytes of one pre-token. Its state is what the merges can still look
  at: the places from which a longer token may reach on, with the last token and the relative
  count at each. Each transition is annotated with the change of the token count.
  States are built when they are first met, so that only the part of the machine that a
  corpus uses is compiled.

Counts of pre-tokens are remembered by word; the memory and the machine start anew beyond
fixed sizes, which changes nothing in the counts. There is no shuffle: each document is
counted where it is read. Null and empty texts have no tokens. Nothing is truncated.
"""

from __future__ import annotations

import json
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opportunity.llm.common import beside_texts

#: Code points of one run of the splitter; longer texts go alone.
RUN_CHARS = 1_500_000
CHUNK = 256
MAX_WORDS, MAX_STATES, LONG_WORD = 900_000, 200_000, 128

END = 0x110000
# Classes of code points. S1 completes a contraction alone; R, V and L1 need one letter more.
LETTER, S1, R, V, L1, E1, NUMBER, SPACE, OTHER_WHITE, APOSTROPHE, OTHER, STOP = range(12)
# States of the splitter, named by what was read last.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, MORE_SPACE, ONE_WHITE, MORE_WHITE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CONTRACTED = range(13)
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and marks, at 16 * class + state. HERE and BEFORE mark a start at this or the last place."""
    letters = {LETTER, S1, R, V, L1, E1}
    run = {**dict.fromkeys(letters, IN_LETTERS), NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: QUOTE, SPACE: ONE_SPACE, OTHER_WHITE: ONE_WHITE, STOP: BEGIN}
    step, marks = np.zeros(256, np.uint8), np.zeros(256, np.uint8)

    def put(state: int, symbol: int, to: int, mark: int) -> None:
        step[16 * symbol + state], marks[16 * symbol + state] = to, mark

    for symbol, to in run.items():
        for state in (BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, CONTRACTED, QUOTE, ONE_WHITE):
            put(state, symbol, to, HERE)
        for state in (QUOTE_R, QUOTE_V, QUOTE_L):
            put(state, symbol, to, BEFORE if symbol in letters else BEFORE | HERE)
        put(MORE_WHITE, symbol, to, BEFORE | HERE)
    for symbol in letters:
        put(IN_LETTERS, symbol, IN_LETTERS, 0)
    put(IN_NUMBERS, NUMBER, IN_NUMBERS, 0)
    for symbol in (OTHER, APOSTROPHE):
        put(IN_OTHERS, symbol, IN_OTHERS, 0)
        put(QUOTE, symbol, IN_OTHERS, 0)
    put(QUOTE, S1, CONTRACTED, 0)
    for symbol, pending in ((R, QUOTE_R), (V, QUOTE_V), (L1, QUOTE_L)):
        put(QUOTE, symbol, pending, 0)
    put(QUOTE_R, E1, CONTRACTED, 0)
    put(QUOTE_V, E1, CONTRACTED, 0)
    put(QUOTE_L, L1, CONTRACTED, 0)
    for symbol in (*letters, NUMBER, OTHER, APOSTROPHE):  # the last space goes with what follows it
        to = IN_OTHERS if symbol == APOSTROPHE else run[symbol]
        put(ONE_SPACE, symbol, to, 0)
        put(MORE_SPACE, symbol, to, BEFORE)
    for state in (ONE_SPACE, MORE_SPACE, ONE_WHITE, MORE_WHITE):
        put(state, SPACE, MORE_SPACE, 0)
        put(state, OTHER_WHITE, MORE_WHITE, 0)
        put(state, STOP, BEGIN, HERE)
    return step, marks


def _classes(tokenizer: Tokenizer) -> np.ndarray:
    """16 * class of every code point, and of END, as the library's own splitter has them.

    Unicode tables differ in age, so the library is asked: where it splits the sequence of all code points
    past ASCII, their class changes, and the first of each run is tried beside a letter, a number and a
    mark. What joins none of them is white space.
    """
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    points = np.r_[0x80:0xD800, 0xE000:END]  # surrogates are no text
    runs = np.array(sorted({start for _, (start, _) in split("".join(map(chr, points.tolist())))} | {0}))
    kinds = np.full(len(runs), OTHER_WHITE, np.uint8)
    for beside, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
        begun = np.zeros(3 * len(runs) + 1, bool)
        begun[[start for _, (start, _) in split("".join(f"{beside}{chr(c)}\n" for c in points[runs].tolist()))]] = True
        kinds[~begun[3 * np.arange(len(runs)) + 1]] = kind
    table = np.full(END + 1, OTHER, np.uint8)
    table[points] = np.repeat(kinds, np.diff(np.append(runs, len(points))))
    table[END] = STOP
    for kind, chars in ((LETTER, string.ascii_letters), (NUMBER, string.digits), (OTHER_WHITE, "\t\n\v\f\r"), (S1, "stmd"), (R, "r"), (V, "v"), (L1, "l"), (E1, "e"), (SPACE, " "), (APOSTROPHE, "'")):
        table[[ord(c) for c in chars]] = kind
    return table * np.uint8(16)


def split_starts(symbols: np.ndarray, step: np.ndarray, marks: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places where pre-tokens start, in a run of 16 * class values that begins a text and ends in STOP."""
    n = len(symbols)
    m = -(-n // chunk)
    grid = np.full(m * chunk, 16 * STOP, np.uint8)
    grid[:n] = symbols
    columns = np.ascontiguousarray(grid.reshape(m, chunk).T)
    maps = np.repeat(np.arange(16, dtype=np.uint8)[:, None], m, axis=1)[: CONTRACTED + 1]
    for column in columns:
        maps = step.take(maps + column)
    shift = 1
    while shift < m:  # maps[:, k] becomes the composition of chunks 0..k
        maps = np.concatenate([maps[:, :shift], _composed(maps, shift)], axis=1)
        shift *= 2
    state = np.concatenate([np.array([BEGIN], np.uint8), maps[BEGIN, :-1]])
    out = np.empty_like(columns)
    for k, column in enumerate(columns):
        at = state + column
        out[k] = marks.take(at)
        state = step.take(at)
    flat = out.T.reshape(-1)[:n]
    found = (flat & HERE).astype(bool)
    found[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return np.flatnonzero(found)


def _composed(maps: np.ndarray, shift: int) -> np.ndarray:
    """For each chunk k >= shift: first the map of k - shift, then the map of k."""
    width = maps.shape[1] - shift
    return maps[:, shift:][maps[:, :-shift].astype(np.intp), np.arange(width)[None, :]]


class Merger:
    """Transducer from the bytes of a pre-token to its number of BPE tokens."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.vocab = vocab
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.whole: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        for place, (left, right) in enumerate(merges):
            pair = vocab[left], vocab[right]
            whole = vocab[left + right]
            self.rank.setdefault(pair, place)
            self.whole[pair] = whole
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = pair, place
        self.begins = {token[:k] for token in vocab for k in range(1, len(token))}
        self.sound: dict[bytes, bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [(b"", ((0, -1, 0),))]
        self.number = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, for single tokens only: whether a token's bytes give back the token."""
        ids = [self.vocab[bytes([b])] for b in data]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda k: self.rank.get((ids[k], ids[k + 1]), 1 << 60))
            pair = ids[best], ids[best + 1]
            if pair not in self.rank:
                break
            ids[best : best + 2] = [self.whole[pair]]
        return ids

    def is_sound(self, token: bytes) -> bool:
        if token not in self.sound:
            self.sound[token] = self.merged(token) == [self.vocab[token]]
        return self.sound[token]

    def fit(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` apart when they stand together.

        Merges are undone from the last to the first; the pair at the border must never have
        a merge that comes before the one undone last.
        """
        key = left, right
        if key not in self.fits:
            bound = 1 << 60
            while True:
                if self.rank.get((left, right), 1 << 60) < bound:
                    self.fits[key] = False
                    break
                a, b = self.made.get(left, -1), self.made.get(right, -1)
                if a < 0 and b < 0:
                    self.fits[key] = True
                    break
                # Of equal pairs the left one merges first: at the same rank, the right token's
                # own merge is later than the border's.
                if a > b:
                    bound, left = a, self.parts[left][1]
                else:
                    bound, right = b + 1, self.parts[right][0]
        return self.fits[key]

    def grow(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition."""
        seen, places = self.states[state]
        seen += bytes([byte])
        n = len(seen)
        for length, last, count in places:
            token = seen[n - 1 - length :]
            id_ = self.vocab.get(token)
            if id_ is not None and (last < 0 or self.fit(last, id_)) and self.is_sound(token):
                break
        else:
            raise ValueError(f"no token ends at byte {byte}: not a byte-level vocabulary")
        delta = count + 1
        kept = [(length + 1, last, c - delta) for length, last, c in places if seen[n - 1 - length :] in self.begins]
        to = (seen[n - kept[0][0] :] if kept else b"", (*kept, (0, id_, 0)))
        number = self.number.get(to)
        if number is None:
            number = self.number[to] = len(self.states)
            self.states.append(to)
            self.steps.append({})
        self.steps[state][byte] = number, delta
        return number, delta

    def count(self, data: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self.reset()
        state = total = 0
        steps = self.steps
        for byte in data:
            state, delta = steps[state].get(byte) or self.grow(state, byte)
            total += delta
        return total


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenCounter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splitter = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or splitter.get("type") != "ByteLevel" or not splitter.get("use_regex") or splitter.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} is no byte-level BPE with the usual splitter")
        known = byte_alphabet()
        raw = lambda token: bytes(known[c] for c in token)
        special = [t["content"] for t in spec["added_tokens"]]
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merger = Merger(vocab, [(raw(a), raw(b)) for a, b in pairs])
        self.special = special
        self.classes = _classes(Tokenizer.from_file(path))
        self.step, self.marks = _splitter()
        self.words: dict[str, int] = {}

    def _pieces(self, text: str) -> tuple[list[str], int]:
        """What stands between special tokens, and their number."""
        pieces, specials = [text], 0
        for token in self.special:
            if token in text:
                pieces = [part for piece in pieces for part in piece.split(token)]
                specials += text.count(token)
        return pieces, specials

    def count(self, texts: list[str]) -> list[int]:
        totals = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owners: list[int] = []
        chars = 0
        for k, text in enumerate(texts):
            parts, specials = self._pieces(text)
            totals[k] += specials
            pieces += parts
            owners += [k] * len(parts)
            chars += len(text)
            if chars >= RUN_CHARS or k == len(texts) - 1:
                totals += np.bincount(owners, self._run(pieces), len(texts)).astype(np.int64)
                pieces, owners, chars = [], [], 0
        return totals.tolist()

    def _run(self, pieces: list[str]) -> np.ndarray:
        """Token counts of the pieces, each with its own STOP behind it."""
        text = "\0".join(pieces) + "\0"
        stops = np.cumsum([len(p) + 1 for p in pieces]) - 1
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
        points[stops] = END
        starts = split_starts(self.classes.take(points), self.step, self.marks)
        ends = np.append(starts[1:], len(text))
        real = points[starts] != END
        starts, ends = starts[real], ends[real]
        if len(self.words) > MAX_WORDS:
            self.words = {}
        known, merger = self.words, self.merger
        words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        try:
            counts = np.array([known[word] for word in words], np.int64)
        except KeyError:
            for word in set(words):
                if word not in known:
                    known[word] = merger.count(word.encode())
            counts = np.array([known[word] for word in words], np.int64)
        for k in np.flatnonzero(ends - starts > LONG_WORD):
            known.pop(words[k], None)
        sums = np.concatenate([[0], np.cumsum(counts)])
        edges = np.searchsorted(starts, np.concatenate([[0], stops[:-1] + 1, [len(text)]]))
        return np.diff(sums[edges])


_COUNTERS: dict[str, TokenCounter] = {}


def token_counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row."""

    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = beside_texts(read, lambda: lambda texts: {"n_tokens": token_counter(tokenizer).count(texts)}, "n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
