"""Operator 11, spelling variants grouped by blocked Gram matrices.

Words that one edit tells apart have letter counts whose squared distance is 1 (a letter more) or 2 (one
for another). The counts of a block of words times those of another give all squared distances of the two
at once; pairs at most two apart are verified letter by letter. Letters fall into a few classes, and a
block holds the words with the same number of letters of each, so of one length: an edit moves a word to
a block one letter longer, or from one class to another within its length, and only such blocks meet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, lookup, table, tidy

LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
RUN = re.compile("[a-zÀ-ÿ]+")
#: Classes of letters, and words of a part of a block, about.
CLASSES, PART = 6, 512
LEAST_CHARS, LEAST_N, TIMES = 6, 5, 5
#: One run in so many of a document loses a letter.
SPOIL = 199
#: Words a task counts before it passes them on.
HELD = 200_000
#: Lower-case letters and À to ÿ by code point; other code points aren't in words.
CODE = np.full(0x100, -1)
CODE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def runs(doc_id: int | None, text: str | None) -> Counter:
    """Runs of letters of a text, A-Z lower-cased, and how often each occurs, some with a letter deleted.

    Those with an unsigned crc32 of `<doc_id>:<run>` that SPOIL divides lose the code point at crc32 %
    length, at each occurrence; a null id is written as nothing.
    """
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    found: Counter = Counter()
    # bytes.lower() changes A-Z alone
    for w, n in Counter(RUN.findall((text or "").encode().lower().decode())).items():
        h = zlib.crc32(w.encode(), start)
        if h % SPOIL == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        found[w] += n
    return found


def count_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """(word, n): the words of whole texts with at least least_chars code points and least_n occurrences over all documents. A task adds up what it meets before it passes words on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for w, n in runs(i, t.as_py()).items():
                    if len(w) >= least_chars:
                        held[w] += n
                if len(held) >= HELD:
                    yield give()
                    held.clear()
        yield give()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def block_of(word: str = "word"):
    """How many letters of each class a word has: its block; their sum is its length."""
    size = F.char_length(word)
    return F.array(*[(size - F.char_length(F.translate(F.col(word), "".join(LETTERS[k::CLASSES]), ""))).cast("int") for k in range(CLASSES)])


def neighbours(block: str = "block"):
    """The block itself, those with a letter of one class instead of a later one, and those with one letter more: every two blocks an edit apart are met from one side."""
    b = lambda i: F.col(block)[i]
    moved = lambda up, down: F.array(*[b(k) + (int(k == up) - int(k == down)) for k in range(CLASSES)])
    return F.array(F.col(block), *[moved(i, j) for i in range(CLASSES) for j in range(i + 1, CLASSES)], *[moved(i, None) for i in range(CLASSES)])


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    codes = CODE[np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * len(LETTERS) + codes, minlength=len(words) * len(LETTERS)).reshape(len(words), len(LETTERS)).astype(np.float32)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells the words apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_in_blocks(left: list[str], right: list[str] | None) -> list[tuple[int, int]]:
    """Places of words one edit apart: of left and right, or twice of left if right is None, each pair once."""
    x = letter_counts(left)
    y = x if right is None else letter_counts(right)
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(squares <= 2)
    if right is None:
        i, j = i[i < j], j[i < j]
        right = left
    return [(p, q) for p, q in zip(i.tolist(), j.tolist()) if one_edit(left[p], right[q])]


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, n, other_n): both directions of every two words (word, n; distinct, of LETTERS) one edit apart.

    A block of more than PART words is dealt by hash into parts, and each two parts of neighbouring blocks
    meet in one row; what a task holds are two parts.
    """
    words = cut(words.select("word", "n", block_of().alias("block")))
    blocks = cut(words.groupBy("block").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    dealt = lookup(words, blocks, "block", blocks.count(), words.count())
    held = cut(dealt.groupBy("block", F.expr("pmod(xxhash64(word), parts)").cast("int").alias("part")).agg(F.collect_list(F.struct("word", "n")).alias("words")))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    met = blocks.select("block", "parts", F.explode(neighbours()).alias("other")).join(blocks.select(F.col("block").alias("other"), F.col("parts").alias("other_parts")), "other")
    met = met.withColumn("part", every("parts")).withColumn("other_part", every("other_parts")).where("block <> other or part <= other_part")
    one = held.select("block", "part", F.col("words").alias("left"))
    two = held.select(F.col("block").alias("other"), F.col("part").alias("other_part"), F.col("words").alias("right"))
    same = (F.col("block") == F.col("other")) & (F.col("part") == F.col("other_part"))
    pairs = met.join(one, ["block", "part"]).join(two, ["other", "other_part"]).select("left", F.when(~same, F.col("right")).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for left, right in zip(*b.columns, strict=True):
                names, ns = left.values.field("word").to_pylist(), left.values.field("n").to_numpy()
                others, other_ns = (names, ns) if right.values is None else (right.values.field("word").to_pylist(), right.values.field("n").to_numpy())
                found = near_in_blocks(names, None if right.values is None else others)
                if found:
                    i, j = np.array(found).T
                    a, c = [names[k] for k in i], [others[k] for k in j]
                    yield pa.RecordBatch.from_arrays([pa.array(a + c), pa.array(c + a), pa.array(np.concatenate([ns[i], other_ns[j]])), pa.array(np.concatenate([other_ns[j], ns[i]]))], ["word", "other", "n", "other_n"])

    return pairs.mapInArrow(tidy(run), "word string, other string, n long, other_n long")


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. Each round doubles the steps taken; forms that run in a circle are an error."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = cut(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")
    raise RuntimeError(f"forms do not end after {max_rounds} rounds")


def spelling_variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, times: int = TIMES) -> DataFrame:
    """Words of docs (doc_id, text) with n, n_near, form (the most frequent near word, if at least `times` as frequent; of equals the smallest), form_n and root.

    Null and empty texts have no words, repeated rows count as often as they occur, no documents give no
    words, other columns are not read.
    """
    words = cut(count_words(docs, least_chars, least_n))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = cut(near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), best.alias("best")))
    form = near.where(-F.col("best.minus") >= times * F.col("n")).select("word", "best.form", (-F.col("best.minus")).alias("form_n"))
    known = near.select("word", "n_near").join(form.join(roots(form), "word"), "word", "left")
    out = words.join(known, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, each with its more frequent form and its root."""
    return spelling_variants(table(spark, sf_dir, "documents"))
