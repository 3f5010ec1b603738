"""SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding by backtracking: at each place take the longest piece that an Aho-Corasick automaton found there, then shorter
prefixes of it, until one may stand next to the piece before it; where none may, mark the place in a bitfield of failed
places and give up the piece before. Two pieces may stand side by side if merging their characters anew gives the two
back. The result is the one sequence in which all neighbours may, which is the library's encoding.
"""

from __future__ import annotations

import functools
import hashlib
import operator
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.common import arrow_map, slices, texts_of

SPACE = "▁"  # stands for a space inside pieces
#: Types of pieces, and the model type of BPE.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
MOST_CACHED, MOST_PAIRS = 120_000, 1 << 19
SLICE = 1 << 20
#: Characters that often end a word.
MARKS = ".,;:!?*$%&#)\"'"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 0x80:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        elif key & 7 == 5:
            value, i = struct.unpack_from("<f", data, i)[0], i + 4
        else:
            value, i = data[i : i + 8], i + 8
        yield key >> 3, value


class PieceModel:
    """A BPE model file, with its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.text.append(piece[1].decode())
                self.score.append(piece.get(2, 0.0))
                self.kind.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != BPE or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0) or {USER_DEFINED, UNUSED} & {*self.kind}:
            raise ValueError(f"{path}: a BPE model without a character map, user-defined or unused pieces is needed")
        self.prefix = bool(normalizer.get(3, 1))
        self.unknown = trainer.get(40, 0)
        self.surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == NORMAL}
        self.byte = {int(t[3:-1], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            self.automaton.add_word(t, (i, len(t) - 1))
        self.automaton.make_automaton()
        order = sorted(set(self.score), reverse=True)
        place = {x: n for n, x in enumerate(order)}
        #: Places of pieces in order of their scores, and what stands for none.
        self.rank, self.none = [place[x] for x in self.score], len(order)
        #: Neighbours of which no piece holds both can be cut apart. In the text, spaces are cut from what precedes them
        #: and line breaks from all, if the pieces allow it; ``joined`` has the neighbours that some piece holds.
        self.joined = {t[i : i + 2] for t in self.id for i in range(len(t) - 1)}
        loose = not any(p[1] == SPACE != p[0] for p in self.joined)
        lines = not any("\n" in t for t in self.id)
        self.loose = loose
        self.lines = lines
        self.parts = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*" if lines else f"{SPACE}+[^{SPACE}]*")
        self.segment = re.compile((f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if loose else r"(?s).+")
        self.fits: dict[int, bool] = {}
        self.length = [len(t) for t in self.text]
        #: For each piece, the longest piece that is a proper prefix of it, or -1.
        self.shorter = [next((self.id[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id), -1) for t in self.text]
        self.shown = [t.replace(SPACE, " ").encode() if k == NORMAL else None for t, k in zip(self.text, self.kind, strict=True)]
        self.digits = [b"%d," % i for i in range(len(self.text))]
        self.caches: dict[Callable, _Cache] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding of ``text`` by merges: the highest score first, then the leftmost."""
        parts = list(text)
        ids, rank, none = self.id, self.rank, self.none
        found = [none if (i := ids.get(a + b)) is None else rank[i] for a, b in zip(parts, parts[1:], strict=False)]
        while found and (best := min(found)) < none:
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = none if (i := ids.get(parts[at - 1] + parts[at])) is None else rank[i]
            if at < len(found):
                found[at] = none if (i := ids.get(parts[at] + parts[at + 1])) is None else rank[i]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand next to ``left`` (-1: nothing precedes)."""
        key = left * len(self.text) + right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= MOST_PAIRS:
                self.fits.clear()
            want = [self.text[i] for i in (left, right) if i >= 0]
            found = self.fits[key] = self.merged("".join(want)) == want
        return found

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a text in which spaces are already marked."""
        try:
            return self._backtrack(text)
        except KeyError:  # a character that is no piece
            pass
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.joined]
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            part = text[a:b]
            if part in self.id or b - a > 1:
                out += self._backtrack(part)
            else:
                out += [self.byte[x] for x in part.encode()] if self.byte else [self.unknown]
        return out

    def _backtrack(self, text: str) -> list[int]:
        end = len(text)
        longest = [-1] * end
        # matches come by their ends, so the longest from a place comes last
        for stop, (i, n) in self.automaton.iter(text):
            longest[stop - n] = i
        if -1 in longest:
            raise KeyError(text[longest.index(-1)])
        length, fits, many, shorter = self.length, self.fits, len(self.text), self.shorter
        failed = 0
        taken: list[int] = []
        at, left, piece = 0, -1, longest[0]
        while at < end:
            while piece >= 0:
                stop = at + length[piece]
                if not failed >> stop & 1:
                    fit = fits.get(left * many + piece)
                    if fit or fit is None and self.may_follow(left, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                taken.append(piece)
                at, left = stop, piece
                piece = longest[at] if at < end else -1
            else:
                if not taken:
                    raise ValueError(f"no encoding of {text!r}")
                failed |= 1 << at
                piece = taken.pop()
                at -= length[piece]
                left = taken[-1] if taken else -1
        return taken

    def encode_marked(self, text: str) -> list[int]:
        """Ids of a text in which spaces are already marked."""
        return [i for segment in self.segment.findall(text) for i in self.encode_segment(segment)]

    def encode(self, text: str) -> list[int]:
        """The library's ids of ``text``, without begin and end."""
        return np.frombuffer(b"".join([i for (i,) in self.coded(text, int32)]), np.int32).tolist()

    def coded(self, text: str, form: Callable[[PieceModel, list[int]], tuple[bytes, ...]]) -> list[tuple[bytes, ...]]:
        """``form`` of the ids of the parts of ``text``, which add up to the text's: words, each with the spaces or the line break before it.

        Parts are named without their first space mark, so a name that starts with a line break has none.
        """
        if not text:
            return []
        cache = self.caches.get(form)
        if cache is None:
            cache = self.caches[form] = _Cache(self, form)
        if not self.prefix or not self.loose:
            return [form(self, self.encode_marked((SPACE if self.prefix else "") + text.replace(" ", SPACE)))]
        if "  " in text or text[0] == " " or SPACE in text:
            parts = self.parts.findall(SPACE + text.replace(" ", SPACE))
            return [cache[part[1:] if part[0] == SPACE else part] for part in parts]
        return list(map(cache.__getitem__, (text.replace("\n", " \n") if self.lines else text).split(" ")))

    def inner_text(self, ids: list[int]) -> bytes:
        """The text of ids inside a text, in UTF-8; most are pieces that stand for themselves."""
        try:
            return b"".join(map(self.shown.__getitem__, ids))
        except TypeError:
            return self.decode(ids, False).encode()

    def decode(self, ids: Iterable[int], first: bool = True) -> str:
        """The library's text of ``ids``: control pieces are empty, bytes that are no UTF-8 become U+FFFD one by one.

        Without ``first`` they stand inside a text, where no added space goes.
        """
        out: list[str] = []
        held = bytearray()
        fresh = self.prefix and first  # the mark of the added space is still due

        def flush() -> None:
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()

        for i in ids:
            kind = self.kind[i]
            if kind == BYTE:
                held.append(int(self.text[i][3:-1], 16))
                fresh = False
                continue
            flush()
            if kind == CONTROL:
                continue
            piece = self.surface if kind == UNKNOWN else self.text[i]
            if fresh and kind == NORMAL:
                piece = piece.removeprefix(SPACE)
            fresh = False
            out.append(piece.replace(SPACE, " ") if kind == NORMAL else piece)
        flush()
        return "".join(out)


class _Cache(dict):
    """``form`` of parts' ids by name, in two generations: when one is full, the one before it goes."""

    def __init__(self, model: PieceModel, form: Callable):
        self.model, self.form = model, form
        self.old: dict[str, tuple[bytes, ...]] = {}

    def __missing__(self, word: str) -> tuple[bytes, ...]:
        found = self.old.get(word)
        if found is None:
            found = self._made(word)
        if len(word) < 64:
            if len(self) >= MOST_CACHED:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def _made(self, word: str) -> tuple[bytes, ...]:
        own = self.model
        if word[:1] == "\n" and own.lines:
            return self.form(own, own.encode_marked(word))
        stem = word.rstrip(MARKS)
        if stem and len(stem) < len(word) and word[len(stem) - 1 : len(stem) + 1] not in own.joined:
            # marks that no piece joins to the word are parts of their own, and the word is met without them more often
            return tuple(map(operator.add, self[stem], self.form(own, own.encode_segment(word[len(stem) :]))))
        return self.form(own, own.encode_segment(SPACE + word))


def int32(own: PieceModel, ids: list[int]) -> tuple[bytes]:
    """Ids as 4 bytes each."""
    return (struct.pack(f"<{len(ids)}i", *ids),)


def decimal(own: PieceModel, ids: list[int]) -> tuple[bytes, bytes]:
    """Ids as decimals, a comma after each, and their text in UTF-8."""
    return b"".join(map(own.digits.__getitem__, ids)), own.inner_text(ids)


def int32_and_text(own: PieceModel, ids: list[int]) -> tuple[bytes, bytes]:
    return *int32(own, ids), own.inner_text(ids)


def whole_text(own: PieceModel, parts: list[tuple[bytes, bytes]]) -> bytes:
    """The parts' text, without the space that the model adds in front."""
    text = b"".join([t for _, t in parts])
    return text[1:] if own.prefix and text[:1] == b" " else text


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@functools.lru_cache(2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def id_lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(documents: DataFrame, path: str) -> DataFrame:
    """``documents`` with a column ``ids array<int>`` of the model at ``path``, in place of one of that name.

    Ids are the library's, without begin and end ids. Null and empty texts have no ids. Texts are read whole. A row
    comes for each row; other columns stay as they are.
    """
    rest = documents.drop("ids")
    schema = T.StructType([*rest.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    at = rest.columns.index("text")

    def make():
        own = model(path)

        def each(batch: pa.RecordBatch):
            texts = texts_of(batch.column(at))
            for a, b in slices([len(t) for t in texts], SLICE):
                ids = id_lists([b"".join([i for (i,) in own.coded(t, int32)]) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, ids], names=[*batch.schema.names, "ids"])

        return each

    return arrow_map(rest, schema, make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column ``decoded string`` of its ``ids``, in place of one of that name; null where ids is null.

    A row comes for each row; other columns stay as they are. An id that the model lacks is an error.
    """
    rest = encoded.drop("decoded")
    schema = T.StructType([*rest.schema.fields, T.StructField("decoded", T.StringType())])
    at = rest.columns.index("ids")

    def make():
        own = model(path)
        plain = np.array([k == NORMAL for k in own.kind])
        shown = np.array([t.replace(SPACE, " ") for t in own.text], object)

        def one(ids: np.ndarray) -> str:
            # stretches between byte and control pieces are joined at once
            if not len(ids):
                return ""
            odd = np.flatnonzero(~plain[ids])
            if len(odd) > 0.2 * len(ids):
                return own.decode(ids.tolist())
            out, last, fresh = [], 0, own.prefix
            groups = np.split(odd, np.flatnonzero(np.diff(odd) > 1) + 1) if len(odd) else []
            for group in [*groups, None]:
                stop = len(ids) if group is None else group[0]
                if stop > last:
                    text = "".join(shown[ids[last:stop]])
                    out.append(text[1:] if fresh and own.text[ids[last]].startswith(SPACE) else text)
                    fresh = False
                if group is not None:
                    chosen = ids[group].tolist()
                    out.append(own.decode(chosen))
                    fresh = fresh and all(own.kind[i] == CONTROL for i in chosen)
                    last = group[-1] + 1
            return "".join(out)

        def each(batch: pa.RecordBatch):
            column = batch.column(at)
            values, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            known = column.is_valid().to_pylist()
            texts = [one(values[starts[i] : starts[i + 1]]) if known[i] else None for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

        return each

    return arrow_map(rest, schema, make)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """``documents`` with ``ids`` and ``decoded`` as of encode and decode, from one pass over the texts."""
    rest = documents.drop("ids", "decoded")
    schema = T.StructType([*rest.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    at = rest.columns.index("text")

    def make():
        own = model(path)

        def each(batch: pa.RecordBatch):
            texts = texts_of(batch.column(at))
            for a, b in slices([len(t) for t in texts], SLICE):
                coded = [own.coded(t, int32_and_text) for t in texts[a:b]]
                ids = id_lists([b"".join([i for i, _ in parts]) for parts in coded])
                text = pa.array([whole_text(own, parts) for parts in coded], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, ids, text], names=[*batch.schema.names, "ids", "decoded"])

        return each

    return arrow_map(rest, schema, make)


def encode_digests(documents: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each row of ``documents(doc_id, text)``: digests of what round_trip returns.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8. Null and empty texts
    have no ids, so both are digests of the empty string. Repeated rows give repeated rows, an empty table an empty one;
    other columns are left aside. Texts, ids and decoded texts stay in one task; a word's share of both is kept under a bound.
    """

    def make():
        own = model(path)

        def each(batch: pa.RecordBatch):
            many, ids, decoded = [], [], []
            for text in texts_of(batch.column(1)):
                parts = own.coded(text, decimal)
                joined = b"".join([i for i, _ in parts])
                many.append(joined.count(b","))
                ids.append(hashlib.sha256(joined[:-1]).hexdigest())
                decoded.append(hashlib.sha256(whole_text(own, parts)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return arrow_map(documents.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
