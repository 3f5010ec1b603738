"""Token counts from a compiled finite-state tokenizer.

A word's merges are read off one symbol at a time: the last token of a prefix is the one token that ends the prefix, is
its own encoding and stands next to the last token of what it leaves. All that later symbols can ask for is, for each
place in the word from which a vocabulary entry is still being spelled, the node of that spelling, the last token at
that place and the count there relative to the present count. These configurations are the states of a deterministic
transducer; a transition carries the number of tokens by which the count changes. States are compiled when first met;
the tables are bounded and start anew when they are full, in the configuration that has been reached.

Text becomes one stream of symbols (bytes, marked where a word ends), cut into chunks of equal length that run side by
side. Every mark leads to the start state, so a chunk's state map is constant from its first mark on, and such maps
compose at once: a chunk's entry state is the exit of the one before it. The map of a chunk without a mark is not built
for all states: it is evaluated at the entry states that occur, round by round, as is the part before a first mark.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import arrow_map, slices, texts_of

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Code points of the Unicode property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: A symbol is a byte, plus FINAL where a word ends with it. PAD fills the last chunk.
FINAL, PAD, SYMBOLS = 256, 512, 513
SHIFT, BIAS = 7, 64
MOST_STATES, MOST_PAIRS = 1 << 17, 1 << 19
CHUNK = 512
#: Bytes of text that are held as symbols at a time, and symbols that are run before the tables' size is looked at again.
SLICE, BLOCK = 6 << 20, 1 << 20


@functools.lru_cache(1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


class _Full(Exception):
    """The tables are full."""


class Machine:
    """The transducer of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: a BPE with word ends is needed")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault((vocab[a], vocab[b]), (i, vocab[a + b]))
        byte_of = _byte_characters()
        self.single = [-1] * PAD
        self.spelling: dict[int, tuple[int, ...]] = {}
        self.children: dict[tuple[int, int], int] = {}
        self.token_at: list[int] = [-1]
        self.inner: set[int] = {0}
        for word, i in vocab.items():
            if word in self.special:
                continue
            body = word.removesuffix("</w>")
            symbols = [byte_of[c] for c in body]
            if body != word:
                symbols[-1] += FINAL
            self.spelling[i] = tuple(symbols)
            if len(symbols) == 1:
                self.single[symbols[0]] = i
        for i, symbols in self.spelling.items():
            node = 0
            for s in symbols:
                nxt = self.children.get((node, s))
                if nxt is None:
                    nxt = self.children[(node, s)] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.add(node)
                node = nxt
            self.token_at[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Empty tables with the start state 0."""
        self.most = 2 * MOST_STATES
        self.table = np.full((1024, 64), -1, np.int32)
        self.column = np.full(SYMBOLS, -1, np.int32)
        self.symbol: list[int] = []
        self.configs: list[tuple] = [((0, -1, 0),)]
        self.number: dict[tuple, int] = {self.configs[0]: 0}

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """The tables' columns of ``symbols``; a column is made when its symbol is first met."""
        met = np.flatnonzero(np.bincount(symbols, minlength=SYMBOLS))
        for s in met[self.column[met] < 0].tolist():
            self.column[s] = len(self.symbol)
            self.symbol.append(s)
        if len(self.symbol) > self.table.shape[1]:
            wide = np.full((len(self.table), len(self.symbol) + 32), -1, np.int32)
            wide[:, : self.table.shape[1]] = self.table
            self.table = wide
        return self.column[symbols]

    def merged(self, symbols: tuple[int, ...]) -> list[int]:
        """The encoding of a word's symbols by its merges: the lowest rank first, then the leftmost."""
        parts = [self.single[s] for s in symbols]
        while len(parts) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [self.rank[parts[i], parts[i + 1]][1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: the word's start): merging both anew gives both back."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= MOST_PAIRS:
                self.fits.clear()
            want = [right] if left < 0 else [left, right]
            found = self.fits[(left, right)] = self.merged(sum((self.spelling[t] for t in want), ())) == want
        return found

    def step(self, config: tuple, symbol: int) -> tuple[tuple, int]:
        """The configuration after ``symbol`` and the change of the count."""
        kept, token, change = [], -1, 0
        for node, last, rel in config:
            node = self.children.get((node, symbol))
            if node is None:
                continue
            t = self.token_at[node]
            if token < 0 and t >= 0 and self.compatible(last, t):
                token, change = t, rel + 1
            if node in self.inner:
                kept.append((node, last, rel))
        if token < 0:
            raise ValueError("the vocabulary's merges do not give one encoding")
        if symbol >= FINAL:
            return self.configs[0], change
        return (*((n, t, r - change) for n, t, r in kept), (0, token, 0)), change

    def compile(self, state: int, column: int) -> int:
        if self.symbol[column] == PAD:
            value = self.table[state, column] = (state << SHIFT) + BIAS
            return int(value)
        if len(self.configs) >= self.most:
            raise _Full
        config, change = self.step(self.configs[state], self.symbol[column])
        nxt = self.numbered(config)
        value = self.table[state, column] = (nxt << SHIFT) + BIAS + change
        return int(value)

    def follow(self, states: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Packed transitions of many lanes, compiling those that are missing."""
        wide = self.table.shape[1]
        at = states * wide + columns
        got = self.table.ravel()[at]
        if got.min(initial=0) < 0:
            missing = np.flatnonzero(got < 0)
            pairs, where = np.unique(at[missing], return_inverse=True)
            got[missing] = np.array([self.compile(*divmod(p, wide)) for p in pairs.tolist()], np.int32)[where]
        return got

    def changes(self, stream: np.ndarray) -> np.ndarray:
        """The count's change at each symbol of a stream that ends with a marked symbol.

        The tables never hold more than 2 * MOST_STATES states: a block that would need more is halved and starts anew,
        with the configuration that it begins in.
        """
        out, at, size = [], 0, BLOCK
        config = self.configs[0]
        while at < len(stream):
            if len(self.configs) > MOST_STATES:
                self.reset()
            try:
                found, config = self.block(stream[at : at + size], config)
            except _Full:
                self.reset()
                # a state for each symbol of each lane's run is the most that a block can need
                size = max(1, min(size, len(stream) - at) // 2)
                continue
            out.append(found)
            at, size = at + size, min(BLOCK, 2 * size)
        return np.concatenate(out) if out else np.zeros(0, np.int8)

    def numbered(self, config: tuple) -> int:
        at = self.number.get(config)
        if at is None:
            at = self.number[config] = len(self.configs)
            self.configs.append(config)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.full((len(self.table) // 2, self.table.shape[1]), -1, np.int32)])
        return at

    def block(self, stream: np.ndarray, config: tuple) -> tuple[np.ndarray, tuple]:
        """The changes of a block that begins in ``config``, and the configuration after it."""
        begin = self.numbered(config)
        n = len(stream)
        lanes = max(1, -(-n // CHUNK))
        flat = np.full(lanes * CHUNK, PAD, np.uint16)
        flat[:n] = stream
        marked = np.ascontiguousarray(((flat >= FINAL) & (flat < PAD)).reshape(lanes, CHUNK).T)
        grid = np.ascontiguousarray(self.columns(flat).reshape(lanes, CHUNK).T)
        out = np.empty((CHUNK, lanes), np.int8)
        state = np.zeros(lanes, np.int32)
        for t in range(CHUNK):
            got = self.follow(state, grid[t])
            state = got >> SHIFT
            out[t] = (got & (2 * BIAS - 1)) - BIAS
        head = np.where(marked.any(0), marked.argmax(0) + 1, CHUNK)
        # entry: the state for which a lane's head has been run; a lane without a mark has a new exit after each run
        entry, leave = np.zeros(lanes, np.int32), state
        while True:
            due = np.concatenate([[np.int32(begin)], leave[:-1]])
            todo = np.flatnonzero(due != entry)
            if not len(todo):
                return out.T.reshape(-1)[:n], self.configs[int(leave[-1])]
            entry[todo] = due[todo]
            todo = todo[np.argsort(-head[todo], kind="stable")]
            state, lengths = due[todo].copy(), head[todo]
            for t in range(int(lengths[0])):
                live = int(np.searchsorted(-lengths, -t, "left"))
                got = self.follow(state[:live], grid[t, todo[:live]])
                state[:live] = got >> SHIFT
                out[t, todo[:live]] = (got & (2 * BIAS - 1)) - BIAS
            whole = lengths == CHUNK
            unmarked = whole & ~marked[:, todo].any(0)
            leave[todo[unmarked]] = state[unmarked]

    def prepared(self, text: str) -> tuple[str, int]:
        """``text`` as the vocabulary's normalizer leaves it, parted where special tokens stood, and how many there were."""
        parts = [text] if self.special_re is None else self.special_re.split(text)
        return "\n".join(_lower(unicodedata.normalize("NFC", p)) for p in parts), len(parts) - 1

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        ready, special = zip(*map(self.prepared, texts), strict=True)
        out = np.array(special, np.int64)
        joined = "\n".join(ready)
        if not joined:
            return out
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        symbols, place = _symbols(joined, points, classes()[points])
        lengths = np.array([len(t) for t in ready])
        first = np.cumsum(lengths + 1) - lengths - 1
        total = np.zeros(len(symbols) + 1, np.int64)
        if len(symbols):
            np.cumsum(self.changes(symbols), out=total[1:])
        return out + total[place[first + lengths]] - total[place[first]]


def _byte_characters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def _lower(text: str) -> str:
    # each character by itself: a capital sigma has one small form, wherever it stands
    return text.replace("Σ", "σ").lower()


def _width(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


def _symbols(joined: str, points: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stream of symbols, and each character's place in it.

    Words: a contraction ('s 't 're 've 'm 'll 'd where no run of other characters precedes), a run of letters, one
    number, a run of other characters.
    """
    n = len(points)
    after = np.empty(n, np.uint8)
    after[:-1], after[-1] = kind[1:], SPACE
    ends = (kind != after) | (kind == NUMBER)
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        quotes = quotes[(quotes + 1 < n) & ((quotes == 0) | (kind[np.maximum(quotes - 1, 0)] != OTHER))]
        one = points[np.minimum(quotes + 1, n - 1)]
        two = points[np.minimum(quotes + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        long &= quotes + 2 < n
        ends[quotes[short | long]] = False
        ends[quotes[short] + 1] = True
        ends[quotes[long] + 2] = True
    kept = kind != SPACE
    raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
    width = _width(points)
    stop = np.cumsum(width) - 1
    symbols = raw.astype(np.uint16)
    symbols[stop[ends & kept]] += FINAL
    place = np.concatenate([[0], np.cumsum(np.where(kept, width, 0))])
    return symbols[np.repeat(kept, width)], place


@functools.lru_cache(2)
def machine(path: str) -> Machine:
    return Machine(path)


def count_tokens(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``documents(doc_id, text)``.

    Counts are those of the library for the vocabulary at ``path`` (the file's place on every machine), without added
    special tokens; strings of special tokens inside a text count as one token each, as the library has it by default.
    A null text counts as an empty one: 0 bytes, 0 tokens. Texts are read whole, in slices of SLICE bytes or one text.
    Repeated rows give repeated rows, an empty table an empty one; other columns are left aside.
    """

    def make():
        own = machine(path)

        def each(batch: pa.RecordBatch):
            texts = texts_of(batch.column(1))
            counts = [own.counts(texts[a:b]) for a, b in slices([len(t) for t in texts], SLICE)]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return each

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return arrow_map(documents.select(F.col("doc_id").cast("long"), "text", size), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
