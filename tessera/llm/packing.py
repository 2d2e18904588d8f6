"""Operator 8, best-fit packing with certified partitions."""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, cut, hand_back, keep, table, tidy

if TYPE_CHECKING:
    import pandas as pd

CAPACITY = 4096
EOD = 1
#: Pieces that one partition packs, about.
PER_PARTITION = 8000
#: A round of repacking that saves a smaller share of its bins is the last.
LEAST = 0.001
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: A word of plain letters and ASCII marks after it: two tokens' worth of text each of its own, whatever surrounds it.
PLAIN = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<marks>[!-/:-@\[-^`{-~]*)$"
#: Strings that one call of the tokenizer takes, parts in one of them; bytes of text that are looked up together.
AT_ONCE = 8
JOINED, CHUNK = 1000, 2 << 20


class Ragged:
    """Runs of ids of different lengths, end to end in one flat array."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.ends = np.cumsum(lengths)

    def take(self, at: np.ndarray) -> "Ragged":
        n = self.lengths[at]
        ends = np.cumsum(n)
        place = np.repeat((self.ends[at] - ends).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        return Ragged(self.flat[place], n)


class PartIds(dict):
    """Part of a text -> the bytes of its little-endian ids, kept from batch to batch if it was met twice; a full cache starts anew."""

    def __init__(self, path: str, most: int = 200_000):
        # a task has one core, and each thread of the tokenizer would keep memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        # a few at a time: what the tokenizer returns takes many times the room of its ids
        fast = lambda i: self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for i in range(0, len(texts), AT_ONCE) for e in fast(i)]

    def encode_joined(self, parts: list[str]) -> list[bytes]:
        """Parts that are one run of letters or marks each: many go in one string, and each ends at an id that ends a word."""
        raw = b"".join(self.encode([" ".join(parts[i : i + JOINED]) for i in range(0, len(parts), JOINED)]))
        ends = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, dtype="<u4")]) + 1)).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends)] if len(ends) == len(parts) else self.encode(parts)

    def ids(self, parts: pa.Array, counts: np.ndarray, plain: bool) -> Ragged:
        names = parts.to_pylist()
        found = list(map(self.get, names))
        if new := [i for i, ids in enumerate(found) if ids is None]:
            made = (self.encode_joined if plain else self.encode)([names[i] for i in new])
            if len(self) > self.most:
                self.clear()
            for i, ids in zip(new, made, strict=True):
                found[i] = ids
                if counts[i] > 1:
                    self[names[i]] = ids
        return Ragged(np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4)


def part_ids(path: str) -> PartIds:
    return keep(("ids", path), lambda: PartIds(path))


def token_ids(texts: pa.Array, parts: PartIds) -> Ragged:
    """The ids of each text, looked up by distinct words.

    The tokenizer drops white space, lower-cases, and splits letters from marks before it merges, so
    a text's ids are its words' ids in a row, and those of a plain word its letters' and its marks'.
    Words are numbered, taken apart and put together again as columns; the tokenizer sees each
    distinct run of letters once, many in one string, and words of any other kind one by one.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten().dictionary_encode()
    at, counts = words.indices.to_numpy(), np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
    split = pc.extract_regex(words.dictionary, PLAIN)
    plain = split.is_valid().to_numpy(zero_copy_only=False)
    other = parts.ids(words.dictionary.filter(pa.array(~plain)), counts[~plain], False)
    first, second = (c.dictionary_encode() for c in (pc.utf8_lower(split.field("letters").filter(pa.array(plain))), split.field("marks").filter(pa.array(plain))))
    known = []
    for c in (first, second):
        i = c.indices.to_numpy()
        known.append(parts.ids(c.dictionary, np.bincount(i, counts[plain], len(c.dictionary)), True) if len(i) else Ragged(other.flat[:0], np.zeros(0, np.int64)))
    # every word is two parts: letters and marks, or itself and nothing
    all_ = Ragged(np.concatenate([k.flat for k in (*known, other)]), np.concatenate([k.lengths for k in (*known, other)] + [np.zeros(1, np.int64)]))
    nothing = len(all_.lengths) - 1
    pair = np.full((len(plain), 2), nothing)
    pair[plain, 0], pair[plain, 1] = first.indices.to_numpy(), second.indices.to_numpy() + len(known[0].lengths)
    pair[~plain, 0] = np.arange(len(other.lengths)) + len(known[0].lengths) + len(known[1].lengths)
    own = all_.take(pair.reshape(-1))
    each = Ragged(own.flat, own.lengths.reshape(-1, 2).sum(axis=1)).take(at)
    ends = np.concatenate([[0], each.ends])[lists.offsets.to_numpy()]
    return Ragged(each.flat, np.diff(ends))


def chunks(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text), as many at a time as have `size` bytes of text, one at least."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of docs (doc_id, text): ids of the whole text and EOD, cut every `capacity` ids; an empty or null text is EOD alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = part_ids(tokenizer_path)
        eod = np.array([EOD], dtype="<u4").tobytes()
        for b in (c for whole in batches for c in chunks(whole, CHUNK)):
            ids = token_ids(b.column(1), parts)
            out = []
            for doc, end, n in zip(b.column(0).to_pylist(), ids.ends.tolist(), ids.lengths.tolist(), strict=True):
                for k, i in enumerate(range(0, n + 1, capacity)):
                    stop = min(i + capacity, n + 1)
                    crc = zlib.crc32(ids.flat[end - n + i : end - n + min(stop, n)].tobytes())
                    out.append((doc, k, i, stop - i, zlib.crc32(eod, crc) if stop > n else crc))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
            hand_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each length: longest first, each into the fullest bin with room."""
    bins = np.empty(len(lengths), dtype=np.int64)
    rooms: list[int] = []  # the distinct rooms, ascending, and their bins
    at: dict[int, list[int]] = {}
    n = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        k = bisect.bisect_left(rooms, size)
        if k == len(rooms):
            b, room = n, capacity
            n += 1
        else:
            room = rooms[k]
            b = at[room].pop()
            if not at[room]:
                del at[room], rooms[k]
        bins[i] = b
        if left := room - size:
            if left not in at:
                bisect.insort(rooms, left)
                at[left] = []
            at[left].append(b)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of dual feasible functions: the sum of lengths, f_k(x) with whole steps of 1/(k+1), and the
    threshold function that counts lengths above 1 - e whole and drops those under e."""
    if not len(lengths):
        return 0
    x = lengths.astype(np.int64)
    best = -(-int(x.sum()) // capacity)
    for k in range(1, 17):
        scaled = x * (k + 1)
        whole = scaled % capacity == 0
        best = max(best, -(-int(np.where(whole, x * k, (scaled // capacity) * capacity).sum()) // (k * capacity)))
    s = np.sort(x)
    total = np.concatenate([[0], np.cumsum(s)])
    for e in np.unique(s[s <= capacity // 2])[:: max(1, len(np.unique(s)) // 256)]:
        big, small = int((s > capacity - e).sum()), int(np.searchsorted(s, e))
        middle = int(total[len(s) - big] - total[small]) if len(s) - big > small else 0
        best = max(best, big + -(-middle // capacity))
    return best


PACKED = PIECES + ", place long, part long, bin long, offset long, gap long, room long"


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Packs one partition's pieces; gap is its bins above the bound, room the free ids of a piece's bin."""
    pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32", "place"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    lengths = pdf["length"].to_numpy()
    bins = best_fit_decreasing(lengths)
    used = np.bincount(bins, lengths) if len(bins) else np.zeros(0)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.searchsorted(bins[order], np.arange(len(used)))
    offset = np.empty(len(bins), dtype=np.int64)
    offset[order] = ends - lengths[order] - (ends - lengths[order])[first][bins[order]]
    gap = len(used) - lower_bound(lengths)
    return pdf.assign(bin=bins, offset=offset, gap=gap, room=(CAPACITY - used[bins]).astype(np.int64))


def pack(pieces: DataFrame, per_partition: int = PER_PARTITION, least: float = LEAST) -> DataFrame:
    """PIECES with sequence_id and offset.

    Full pieces are sequences of their own. The others are dealt over partitions of about
    `per_partition` and packed by best-fit decreasing; a bound from dual feasible functions certifies
    a partition whose bins equal it. Partitions with a gap give up their unfilled bins, and so does
    any bin filled to less than a fiftieth short: those pieces are dealt anew, so that they meet
    others, and packed again, until nothing is left open or a round saves under a share `least` of
    the bins it repacks. Every round keeps the better packing of bins: a round that needs as many as
    before is dropped. Only counts reach the driver; repeated rows are pieces of their own; nothing to
    pack gives no rows. pieces should be materialised: full ones are numbered by their place.
    """
    part = lambda n, salt: F.pmod(F.xxhash64("place", F.lit(salt)), F.lit(n))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # pieces are dealt by place: ids may be null or repeat
    pieces = pieces.withColumn("place", F.monotonically_increasing_id())
    out = pieces.where(F.col("length") >= CAPACITY).select(*cols, (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < CAPACITY)
    open_ = ((F.col("gap") > 0) & (F.col("room") > 0)) | (F.col("room") > CAPACITY // 50)
    name = lambda r: (F.lit(r << 56) + F.shiftleft(F.col("part"), 24) + F.col("bin")).alias("sequence_id")
    n_rest, had, before, r = rest.count(), None, None, 0
    while True:
        n = max(1, -(-n_rest // per_partition))
        packed = cut(rest.select(*cols, "place", part(n, r).alias("part")).groupBy("part").applyInPandas(_pack_group, PACKED))
        now = packed.groupBy("part", "bin").agg(F.count("*").alias("pieces"), F.max(open_).alias("open"))
        used, bins, n_rest = now.agg(F.count("*"), F.count_if("open"), F.coalesce(F.sum(F.when(F.col("open"), F.col("pieces"))), F.lit(0))).first()
        if before is not None:
            if used >= had:
                break
            out = out.unionByName(before.where(~open_).select(*cols, name(r - 1), "offset"))
        small = before is not None and had - used < least * had
        before, rest, had, r = packed, packed.where(open_), bins, r + 1
        if had < 2 or small:
            break
    return out.unionByName(before.select(*cols, name(r - 1), "offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Tokenizes docs (doc_id, text) once and packs the pieces."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(cut(tokenize(docs, tokenizer_path)))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 4096."""
    bounded_batches(spark)
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
