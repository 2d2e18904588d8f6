"""Operator 12, encoding and decoding with merge-type sentencepiece vocabularies.

A text becomes its symbols, one a code point; an agenda holds the adjacent pairs that are pieces, the
best score first and of equal ones the leftmost, and merges them until no pair is a piece. What no
piece covers falls back to bytes. Texts fall apart into units at spaces; the agendas of all units that a
batch meets first are rows of one matrix, from which each round takes every row's best pair, and a long
unit has a heap. The sentencepiece library reads the model and normalises, and the ids of every distinct
unit are checked against its own, those of a whole text where a unit alone proves nothing, and so is every
decoded text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T

from .common import bounded_batches, keep, table, tidy
from .packing import Ragged

SPACE = "▁"
#: Bytes of text that are encoded at once; units of at most so many code points are kept, and so many of them.
CHUNK, SHORT, MOST = 1 << 20, 24, 450_000
#: Units whose agendas are one matrix, and those that the library encodes as one text.
AT_ONCE, IN_ONE, UNKNOWN = 1 << 13, 64, 1 << 28


class Pieces(dict):
    """unit of a normalised text -> its little-endian ids, kept from batch to batch; a full cache starts anew.

    Two symbols merge only into a piece, so a text falls apart, exactly, wherever no piece holds the two
    code points beside each other. A code point that is in no longer piece is a unit of its own, and
    units end before marks of space if no piece has one inside; long units are parted further by the pairs
    of code points that pieces hold.
    """

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        #: units kept of which the library has not given the same ids
        self.doubtful: set[str] = set()
        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(n)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in range(n)]
        if any(library.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        self.id_of = {p: i for i, p in enumerate(names) if not special[i]}
        self.raw = {p: i.to_bytes(4, "little") for p, i in self.id_of.items()}
        scores = sorted({library.get_score(i) for i in self.id_of.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        #: piece -> place of its score, the best first; equal scores share one
        self.place = {p: place[library.get_score(i)] for p, i in self.id_of.items()}
        self.none = len(scores)
        self._number_pairs(names)
        self.beside = {a + b for p in self.id_of for a, b in pairwise(p)}
        joined = "".join(map(re.escape, sorted({c for pair in self.beside for c in pair} - {SPACE}))) or SPACE
        parted = not any(b == SPACE != a for a, b in self.beside)
        #: whether words are on their own, with the mark before them: no piece holds a mark behind anything else
        self.by_words = parted
        self.unit = re.compile(f"{SPACE}+[{joined}]*|[{joined}]+|[^{joined}{SPACE}]" if parted else f"[{joined}{SPACE}]+|[^{joined}{SPACE}]", re.DOTALL)
        #: byte -> its id, if the model falls back to bytes
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if library.is_byte(i)}
        self.shown = [b"" if library.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        for b, i in self.byte.items():
            self.shown[i] = bytes([b])
        if not library.is_control(self.unknown):
            self.shown[self.unknown] = library.decode([self.unknown]).encode()
        self.control = frozenset(i for i in range(n) if library.is_control(i))
        self.spaced = frozenset(i for p, i in self.id_of.items() if p.startswith(SPACE))
        #: whether normalising puts a mark of space before a text, which decoding takes away
        self.prefix = library.normalize("a").startswith(SPACE)

    def _number_pairs(self, names: list[str]) -> None:
        """Symbols by number (a piece's id, or one beyond for a code point that is none) and, by the numbers of both
        sides, the pairs that are pieces."""
        number = dict(self.id_of)
        for c in sorted({c for p in self.id_of for c in p} - set(number)):
            number[c] = len(names) + len(number)
        self.number, self.no_piece = number, len(names)
        self.single = {k: c for c, k in number.items() if k >= len(names)}
        found = sorted((number[p[:i]] << 32 | number[p[i:]], self.place[p], k) for p, k in self.id_of.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        pairs, places, ids = zip(*found) if found else ((), (), ())
        # the last is no pair
        self.pairs, self.pair_place, self.pair_id = np.array([*pairs, -1], dtype=np.int64), np.array([*places, self.none], dtype=np.int32), np.array([*ids, -1], dtype=np.int32)
        self.bits = max(10, (8 * len(pairs)).bit_length())
        #: slot -> a pair whose hash it is, or of one before it without a gap between
        self.slots = np.full(1 << self.bits, len(pairs), dtype=np.int32)
        slot, left = self.slot_of(self.pairs[:-1]), np.arange(len(pairs))
        while len(left):
            free = left[self.slots[slot[left]] == len(pairs)]
            self.slots[slot[free]] = free
            left = left[self.slots[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)

    def slot_of(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def paired(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of pairs of symbols by number; a pair that is no piece, or has a side below 0, is at the place none."""
        # a side below 0 makes a key below 0
        key = left.astype(np.int64) << 32 | right
        slot, none = self.slot_of(key), len(self.pairs) - 1
        at = self.slots[slot]
        far = np.flatnonzero((self.pairs[at] != key) & (at != none))
        while len(far):
            slot[far] = (slot[far] + 1) & (len(self.slots) - 1)
            at[far] = self.slots[slot[far]]
            far = far[(self.pairs[at[far]] != key[far]) & (at[far] != none)]
        return self.pair_place[at], self.pair_id[at]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Little-endian ids of many units of at most SHORT code points, each of at least one."""
        n, size = len(units), np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4")
        distinct, of = np.unique(codes, return_inverse=True)
        row, width = np.repeat(np.arange(n), size), int(size.max()) + 2
        column = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size) + 1
        # a column of nothing on either side
        symbol = np.full((n, width), -1, dtype=np.int32)
        # a code point in no piece has the number UNKNOWN + its own and merges with nothing
        symbol[row, column] = np.array([self.number.get(chr(c), UNKNOWN + int(c)) for c in distinct])[of]
        place, piece = np.full((n, width), self.none, dtype=np.int32), np.full((n, width), -1, dtype=np.int32)
        place[row, column], piece[row, column] = self.paired(symbol[row, column], symbol[row, column + 1])
        after, before = (np.tile(np.arange(width, dtype=np.int32) + d, (n, 1)) for d in (1, -1))
        live = np.arange(n)
        while True:
            at = place[live].argmin(axis=1)
            more = place[live, at] < self.none
            live, at = live[more], at[more]
            if not len(live):
                break
            gone = after[live, at]
            then, ahead = after[live, gone], before[live, at]
            symbol[live, at], symbol[live, gone] = piece[live, at], -1
            place[live, gone], after[live, at], before[live, then] = self.none, then, at
            place[live, at], piece[live, at] = self.paired(symbol[live, at], symbol[live, then])
            place[live, ahead], piece[live, ahead] = self.paired(symbol[live, ahead], symbol[live, at])
        held = symbol >= 0
        ends = (4 * np.cumsum(held.sum(axis=1))).tolist()
        raw = symbol[held].astype("<u4").tobytes()
        out = [raw[i:j] for i, j in zip([0, *ends], ends)]
        for i in np.flatnonzero((symbol >= self.no_piece).any(axis=1)):
            out[i] = b"".join([k.to_bytes(4, "little") if k < self.no_piece else self.fall_back(chr(k - UNKNOWN) if k >= UNKNOWN else self.single[k]) for k in symbol[i][held[i]].tolist()])
        return out

    def learn(self, units: list[str]) -> None:
        """Encodes those of some distinct units that are short and new, all at once, and notes those that the library encodes otherwise."""
        new = [u for u in units if u not in self and 0 < len(u) <= SHORT]
        if len(self) + len(new) > MOST:
            self.clear()
            self.doubtful.clear()
            new = [u for u in units if 0 < len(u) <= SHORT]
        # units of about one length make a narrow matrix
        new.sort(key=len)
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            made = self.encode_units(some)
            self.update(zip(some, made, strict=True))
            self.doubtful.update(self.unproven(some, made))

    def unproven(self, units: list[str], made: list[bytes]) -> list[str]:
        """Those of some units, with the ids made of each, to which the library does not give the same ids as words of their own.

        Ids of pieces and bytes spell what they encode, so equal ones also prove that the library sees the unit as it
        stands; without bytes the unknown id spells nothing. A unit that is no word behind a mark stays unproven.
        """
        if not self.by_words or not self.byte:
            return units
        left, runs = [], [(i, min(i + IN_ONE, len(units))) for i in range(0, len(units), IN_ONE)]
        while runs:
            given = self.library.encode(["".join(units[i:j])[1:].replace(SPACE, " ") for i, j in runs], num_threads=1)
            differ = [(i, j) for (i, j), ids in zip(runs, given, strict=True) if array("I", ids).tobytes() != b"".join(made[i:j])]
            left += [units[i] for i, j in differ if j == i + 1]
            # units of a run that differs are given one by one
            runs = [(k, k + 1) for i, j in differ if j > i + 1 for k in range(i, j)]
        return left

    def merged(self, text: str) -> list[str]:
        """The symbols of a text once no adjacent pair is a piece; the agenda of a short one is a plain list of places."""
        place, none, symbols = self.place, self.none, list(text)
        if len(text) > SHORT:
            return self.merged_by_heap(symbols)
        agenda = [place.get(a + b, none) for a, b in pairwise(text)]
        while agenda and (k := min(agenda)) != none:
            i = agenda.index(k)
            p = symbols[i] + symbols[i + 1]
            symbols[i : i + 2] = [p]
            del agenda[i]
            if i:
                agenda[i - 1] = place.get(symbols[i - 1] + p, none)
            if i < len(agenda):
                agenda[i] = place.get(p + symbols[i + 1], none)
        return symbols

    def merged_by_heap(self, symbols: list[str]) -> list[str]:
        place, n = self.place, len(symbols)
        agenda = [(k, i, i + 1, p) for i, p in enumerate(map(str.__add__, symbols, symbols[1:])) if (k := place.get(p)) is not None]
        if not agenda:
            return symbols
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, j, p = heappop(agenda)
            # the pair is gone if either symbol has grown or been taken since
            a, b = symbols[i], symbols[j]
            if after[i] != j or not a or not b or len(a) + len(b) != len(p):
                continue
            symbols[i], symbols[j] = p, ""
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (k := place.get(q := p + symbols[j])) is not None:
                    heappush(agenda, (k, i, j, q))
            if (h := before[i]) >= 0 and (k := place.get(q := symbols[h] + p)) is not None:
                heappush(agenda, (k, h, i, q))
        return [s for s in symbols if s]

    def fall_back(self, symbol: str) -> bytes:
        return b"".join([self.byte[b].to_bytes(4, "little") for b in symbol.encode()] if self.byte else [self.unknown.to_bytes(4, "little")])

    def encode_unit(self, unit: str) -> bytes:
        """Little-endian ids of a unit, parted where no piece holds both neighbours."""
        cuts = [i + 1 for i, (a, b) in enumerate(pairwise(unit)) if a + b not in self.beside] if len(unit) > SHORT else []
        raw = self.raw
        return b"".join([raw.get(s) or self.fall_back(s) for i, j in zip([0, *cuts], [*cuts, len(unit)]) for s in self.merged(unit[i:j])])

    def __missing__(self, unit: str) -> bytes:
        # whoever is kept has been checked (learn)
        return self.encode_unit(unit)

    def units(self, text: str) -> list[str]:
        text = self.library.normalize(text)
        if not self.by_words or SPACE * 2 in text:
            return self.unit.findall(text)
        first, *words = text.split(SPACE)
        return [first, *[SPACE + w for w in words]] if first else [SPACE + w for w in words]

    def parted(self, texts: list[str]) -> pa.ListArray:
        """The units of each text, parted as columns where every mark of space begins one; an empty unit may come first."""
        normal = pa.array(self.library.normalize(texts), pa.string())
        if not self.by_words or pc.any(pc.match_substring_regex(normal, f"{SPACE}{SPACE}|\\x00")).as_py():
            return pa.array([self.units(t) for t in texts], pa.list_(pa.string()))
        return pc.split_pattern(pc.replace_substring(normal, SPACE, f"\0{SPACE}"), "\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The little-endian ids of texts without begin and end."""
        return self.encode_checked(texts)[0]

    def encode_checked(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The little-endian ids of texts without begin and end, and whether the library gives the same.

        A text is its units end to end, so a text of proven units is proven; the library encodes any other whole.
        """
        parted = self.parted(texts)
        flat = parted.flatten().dictionary_encode()
        names, at = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        self.learn(names)
        # long units are not kept from batch to batch
        long = [u for u in names if len(u) > SHORT]
        self.update(zip(long, ids := [self.encode_unit(u) for u in long], strict=True))
        doubtful = self.doubtful.union(self.unproven(long, ids))
        found = list(map(self.__getitem__, names))
        for u in long:
            del self[u]
        each = Ragged(np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4).take(at)
        ends = np.concatenate([[0], each.ends])[parted.offsets.to_numpy()]
        made = [each.flat[i:j].tobytes() for i, j in pairwise(ends.tolist())]
        agrees = [True] * len(texts)
        if doubtful:
            unit_ends = np.concatenate([[0], np.cumsum(np.array([u in doubtful for u in names])[at])])[parted.offsets.to_numpy()]
            unsure = np.flatnonzero(np.diff(unit_ends)).tolist()
            for i, own in zip(unsure, self.library.encode([texts[i] for i in unsure], num_threads=1), strict=True):
                agrees[i] = array("I", own).tobytes() == made[i]
        return made, agrees

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes in a row, controls left out, the space before the first piece taken away; a byte that is no UTF-8 becomes U+FFFD."""
        if not self.control.isdisjoint(ids[1:-1]):
            runs = [list(g) for c, g in groupby(ids, self.control.__contains__) if not c]
            return "".join([self.decode(r) if k == 0 else self.text_of(b"".join([self.shown[i] for i in r])) for k, r in enumerate(runs)])
        raw = b"".join(map(self.shown.__getitem__, ids))
        first = next((i for i in ids if i not in self.control), None)
        if self.prefix and first in self.spaced:
            raw = raw[1:]
        return self.text_of(raw)

    @staticmethod
    def text_of(raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join(mended(raw))


def mended(raw: bytes) -> Iterator[str]:
    """The characters of raw, each byte that begins none as U+FFFD."""
    at = 0
    while at < len(raw):
        for size in range(1, 5):
            try:
                yield raw[at : at + size].decode()
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            yield "�"
            at += 1


def pieces(path: str) -> Pieces:
    return keep(("pieces", path), lambda: Pieces(path))


def in_chunks(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in their order, some at a time: a longer text alone, else at most `most` code points together."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


MADE = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "agrees": T.BooleanType()}
WHOLE = {"ids": T.ArrayType(T.IntegerType(), False), "decoded": T.StringType()}


def encode_pieces(docs: DataFrame, path: str, whole: bool = True, text: str = "text") -> DataFrame:
    """docs with n_tokens, digests of ids and of the text decoded from them, agrees (the library gives the same ids and text), and ids and decoded themselves if `whole`.

    Every text is encoded whole, with begin and end ids; a null text counts as empty and has these two
    alone. Columns of docs with one of these names are replaced, all others stay, `text` only if
    `whole`. Rows are on their own: repeated ones get equal results, an empty table gives an empty one.
    """
    made = MADE | (WHOLE if whole else {})
    kept = [f for f in docs.schema.fields if f.name not in made and (whole or f.name != text)]
    schema = T.StructType([*kept, *[T.StructField(k, t) for k, t in made.items()]])
    sent = docs.select(docs[text].alias("_text"), *[docs[f.name] for f in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        ends = [np.array(i, dtype="<u4").tobytes() for i in ([p.begin], [p.end])]
        for b in batches:
            at = 0
            for texts in in_chunks([t or "" for t in b.column(0).to_pylist()], CHUNK):
                rows = []
                made_ids, same_ids = p.encode_checked(texts)
                raws = [ids.join(ends) for ids in made_ids]
                lists = [np.frombuffer(raw, dtype="<u4").tolist() for raw in raws]
                for raw, listed, same, library_text in zip(raws, lists, same_ids, p.library.decode(lists, num_threads=1), strict=True):
                    back = p.decode(listed)
                    row = (len(listed), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), same and back == library_text)
                    rows.append((*row, listed, back) if whole else row)
                columns = [pa.array(c, type=PA[name]) for name, c in zip(made, zip(*rows), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(texts)).columns[1:], *columns], names=[f.name for f in schema.fields])
                at += len(texts)

    return sent.mapInArrow(tidy(run), schema)


PA = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "agrees": pa.bool_(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and digests of every document by the installed 32k vocabulary; null texts are empty."""
    import public_tokenizers

    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), whole=False)
