"""Phrase collocation mining (13): count streams in prefix and suffix order, read in lockstep.

A phrase can only be frequent if its parts are. So orders are counted one after the other, each time over all texts,
and a filter of fixed size marks the frequent phrases of the order before; what it lets through by mistake is
counted like the rest and goes by its exact count. The frequent phrases then lie as two sorted streams. In prefix
order (by first word, second word, …) every phrase follows its own beginnings, in suffix order (by last word, the
last but one, …) its own endings: a walk that holds one chain of at most five counts merges all orders and reads
off left and right counts of every cut, and which shorter phrase an extension covers. No table of phrases is held
or looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import small_batches
from pathloom.session import cut

MIN_COUNT, LONGEST, TOP, CONTAINED = 100, 5, 2_000, 100
#: Words that a task holds before it counts them, and distinct words before it forgets their numbers.
HELD_WORDS, HELD_DISTINCT = 2_000_000, 1_000_000
#: Bits of a filter per frequent phrase, and the bounds of its size: 8 KB to 32 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 28
#: Phrases that begin with one word go to so many places, by the next word.
SALTS = 16

#: Ends of pieces and of words: upper case falls to lower case, breaks to a byte that UTF-8 never holds.
BREAK = b"\xff"
_FOLD = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: bytes) -> list[bytes]:
    """Words in order, with ``BREAK`` between pieces."""
    return text.translate(_FOLD).replace(BREAK, b" \xff ").split()


class Numbers(dict):
    """Numbers words as they come; 0 is the break."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def folded(lang: str, hashes: Sequence[np.ndarray]) -> np.ndarray:
    """One hash per phrase from the hashes of its words."""
    out = np.full(len(hashes[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for h in hashes:
        out = (out ^ h) * _MULTIPLY
        out ^= out >> np.uint64(29)
    return out


class Filter:
    """Bits of a hash filter over the frequent phrases of one order."""

    def __init__(self, order: int, size: int, bits: np.ndarray):
        self.order, self.size, self.bits = order, size, bits

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.size)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def distinct_phrases(words: np.ndarray, alive: np.ndarray, order: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, count) of each distinct phrase of ``order`` words among those that start where ``alive``; exact, by sorting."""
    at = np.flatnonzero(alive)
    code = words[at].astype(np.int64)
    for j in range(1, order):
        if j > 1:
            _, code = np.unique(code, return_inverse=True)
        code = code * total + words[at + j]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return at[first], counts


def _counter(orders: Sequence[int], passed, as_hashes: bool = False):
    """Counts phrases of the orders in a partition of (lang, text); emits (lang, k, phrase, n), k = 0 for all words.

    ``as_hashes`` emits (h, n) instead, without the phrases themselves.
    """

    def count(lang: str, held: list[np.ndarray], names: list[bytes], hashes: np.ndarray | None) -> Iterator[tuple]:
        words = np.concatenate(held)
        n_words = int((words != 0).sum())
        if passed is None:
            found = np.bincount(words, minlength=len(names))
            found[0] = 0
            some = np.flatnonzero(found)
            yield [lang], [0], [None], [n_words]
            yield [lang] * len(some), [1] * len(some), [names[i].decode("utf-8", "replace") for i in some], found[some].tolist()
            return
        m, width = passed.value.order, len(words)
        real = words != 0
        of_word = hashes[words]
        starts = width - m + 1
        if starts <= 0:
            return
        ok = np.logical_and.reduce([real[j : j + starts] for j in range(m)])
        ok &= passed.value.passes(folded(lang, [of_word[j : j + starts] for j in range(m)]))
        for k in orders:
            size = width - k + 1
            if size <= 0:
                continue
            alive = np.logical_and.reduce([ok[j : j + size] for j in range(k - m + 1)])
            if not alive.any():
                continue
            if as_hashes:
                places = np.flatnonzero(alive)
                yield np.unique(folded(lang, [of_word[places + j] for j in range(k)]), return_counts=True)
                continue
            at, counts = distinct_phrases(words, alive, k, len(names))
            rows = np.stack([words[at + j] for j in range(k)], 1).tolist()
            phrases = [b" ".join([names[i] for i in row]).decode("utf-8", "replace") for row in rows]
            yield [lang] * len(phrases), [k] * len(phrases), phrases, counts.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = Numbers(), {}, 0
        hashes = np.zeros(0, np.uint64)

        def flush():
            nonlocal hashes
            names = list(numbers)
            if passed is not None and len(hashes) < len(names):
                new = [xxhash.xxh64_intdigest(w) for w in names[len(hashes) :]]
                hashes = np.concatenate([hashes, np.array(new, np.uint64)])
            for lang in sorted(held):
                for found in count(lang, held[lang], names, hashes):
                    if as_hashes:
                        h, ns = found
                        for i in range(0, len(h), 500_000):
                            columns = [pa.array(h[i : i + 500_000].view(np.int64)), pa.array(ns[i : i + 500_000], pa.int64())]
                            yield pa.RecordBatch.from_arrays(columns, ["h", "n"])
                        continue
                    langs, ks, phrases, ns = found
                    for i in range(0, len(langs), 50_000):
                        j = i + 50_000
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(langs[i:j]), pa.array(ks[i:j], pa.int32()), pa.array(phrases[i:j], pa.string()), pa.array(ns[i:j], pa.int64())],
                            ["lang", "k", "phrase", "n"],
                        )

        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                ws = split_words(BREAK.join([*some, b""]))
                held.setdefault(lang, []).append(np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws)))
                size += len(ws)
            if size >= HELD_WORDS:
                yield from flush()
                held, size = {}, 0
                if len(numbers) > HELD_DISTINCT:
                    numbers, hashes = Numbers(), np.zeros(0, np.uint64)
        if held:
            yield from flush()

    return run


def counted(texts: DataFrame, orders: Sequence[int], min_count: int, passed=None) -> DataFrame:
    """(lang, k, phrase, n) of the phrases found ``min_count`` times, written out; of order 0 the number of all words."""
    rows = texts.mapInArrow(_counter(orders, passed), "lang string, k int, phrase string, n long")
    sums = rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return cut(sums.where((F.col("k") == 0) | (F.col("n") >= min_count)))


def frequent_hashes(texts: DataFrame, order: int, min_count: int, passed) -> DataFrame:
    """(h) of the hashes that phrases of one order have ``min_count`` times together, written out: all frequent phrases, and a few others."""
    rows = texts.mapInArrow(_counter([order], passed, as_hashes=True), "h long, n long")
    return cut(rows.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("h"))


def hashes_of(phrases: DataFrame) -> DataFrame:
    """(h) of phrases (lang, phrase)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, some in pdf.groupby("lang")["phrase"]:
                words = [[xxhash.xxh64_intdigest(w) for w in p.encode().split(b" ")] for p in some]
                yield pd.DataFrame({"h": folded(lang, list(np.array(words, np.uint64).T)).view(np.int64)})

    return phrases.select("lang", "phrase").mapInPandas(run, "h long")


def marked(hashes: DataFrame, order: int) -> Filter:
    """The filter over all hashes of one order. Its size follows their number up to ``MOST_BITS``; packed by Spark in blocks of 8 KB."""
    size = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, hashes.count()) * BITS_EACH))))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << 16, np.uint8)
        flags[pdf["at"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    place = F.shiftrightunsigned("h", 64 - size)
    at = hashes.select(F.shiftright(place, 16).alias("block"), place.bitwiseAND(F.lit(0xFFFF)).alias("at")).distinct()
    bits = np.zeros(1 << (size - 3), np.uint8)
    for row in at.groupBy("block").applyInPandas(pack, "block long, bits binary").toLocalIterator():
        bits[row["block"] << 13 : (row["block"] + 1) << 13] = np.frombuffer(row["bits"], np.uint8)
    return Filter(order, size, bits)


def frequent_phrases(texts: DataFrame, min_count: int, longest: int) -> DataFrame:
    """(lang, k, phrase, n) of all frequent phrases of 1 to ``longest`` words, and the number of words as order 0.

    Pairs are by far the most, so they are counted by their hashes first; only pairs whose hash is frequent are spelled out, in
    the pass that counts three words. The last pass counts all longer phrases at once.
    """
    send = texts.sparkSession.sparkContext.broadcast
    words = counted(texts, [1], min_count)
    one = send(marked(hashes_of(words.where("k = 1")), 1))
    two = send(marked(frequent_hashes(texts, 2, min_count, one), 2))
    short = counted(texts, range(2, min(longest, 3) + 1), min_count, two)
    out = words.unionByName(short)
    if longest > 3:
        three = send(marked(hashes_of(short.where("k = 3")), 3))
        out = out.unionByName(counted(texts, range(4, longest + 1), min_count, three))
    return out


def _chained(batches: Iterator[pa.RecordBatch], backwards: bool) -> Iterator[tuple[pa.RecordBatch, list[list[int] | None]]]:
    """Counts of the proper beginnings (or endings, shortest first) of every phrase of a sorted stream."""
    group, chain = None, []
    for batch in batches:
        out = []
        columns = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("lang", "__salt", "words", "a")]
        for lang, salt, words, a in zip(*columns):
            ws = words[::-1] if backwards else words
            if (lang, salt, ws[0]) != group:
                group, chain = (lang, salt, ws[0]), []
            del chain[len(ws) - 1 :]
            out.append([n for _, n in chain] if len(ws) > 1 else None)
            if [w for w, _ in chain] != ws[:-1]:
                raise AssertionError(f"the stream misses a part of {words}")
            chain.append((ws[-1], a))
        yield batch, out


def _stream(phrases: DataFrame, backwards: bool) -> DataFrame:
    """The phrases in prefix or suffix order. A single word goes before the phrases of each of its salts."""
    words = F.reverse("words") if backwards else F.col("words")
    salt = F.when(F.size("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.pmod(F.xxhash64(words[1]), F.lit(SALTS)).cast("int"))
    )
    dealt = phrases.withColumn("__salt", F.explode(salt)).withColumn("__ws", words).withColumn("__w", words[0])
    sorted_by = ["lang", "__w", "__salt"]
    return dealt.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by, "__ws").drop("__ws", "__w")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, n, score, first, last) of phrases of two and more words; from (lang, words, a, total).

    ``first`` and ``last`` are the counts of the phrase without its last and without its first word.
    """

    def lefts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts in _chained(batches, False):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.names.index(c)) for c in names), pa.array(counts, pa.list_(pa.int64()))], [*names, "lefts"]
            )

    def rights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ends in _chained(batches, True):
            rows = []
            for row, end in zip(batch.to_pylist(), ends):
                if end is None:
                    continue
                a, total, left, k = row["a"], row["total"], row["lefts"], len(row["words"])
                # end[j] counts the last j + 1 words; Python's integers are exact
                cuts = [(1000 * a * total // (left[i] * end[k - 2 - i]), i) for i in range(k - 1)]
                score, i = min(cuts)
                rows.append((row["lang"], row["words"], a, left[i], end[k - 2 - i], total, score, left[-1], end[-1]))
            types = [pa.string(), pa.list_(pa.string()), *[pa.int64()] * 7]
            values = list(zip(*rows)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], out)

    names = ["lang", "words", "a", "total"]
    out = ["lang", "words", "a", "l", "r", "n", "score", "first", "last"]
    fields = "lang string, words array<string>, a long, total long"
    # one word has nothing before it; it goes through every salt of the first stream, so it enters the second one anew
    # written, since the second order takes its borders from a sample of it
    with_left = cut(_stream(phrases, False).mapInArrow(lefts, f"{fields}, lefts array<long>").where(F.size("words") > 1))
    single = phrases.where(F.size("words") == 1).withColumn("lefts", F.lit(None).cast("array<long>"))
    return _stream(with_left.unionByName(single), True).mapInArrow(
        rights, "lang string, words array<string>, a long, l long, r long, n long, score long, first long, last long"
    )


def mine(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    contained: int = CONTAINED,
    top: int | None = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to ``longest`` words whose words hold together best.

    A phrase counts if found ``min_count`` times; its score is that of its weakest cut, ties to the first. It goes if a longer
    such phrase around it has at least ``contained`` percent of its count: then so has one that is longer by one word at
    either end, since counts only fall with length. Ranked per language by score, count and phrase; ``top`` rows of each,
    or all if None.

    A null language is ``und``, a null or empty text has no words, and an empty table gives no rows. Repeated rows count each
    time; all other columns play no part, whatever their names. Texts are read whole, a long one within one batch.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    found = frequent_phrases(texts, min_count, longest)
    totals = found.where(F.col("k") == 0).select("lang", F.col("n").alias("total"))
    phrases = found.where(F.col("k") > 0).join(totals, "lang").select("lang", F.split("phrase", " ").alias("words"), F.col("n").alias("a"), "total")
    rows = cut(scored(phrases))

    whole = F.size("words") > 2
    size = F.size("words") - 1
    covered = rows.where(whole & (100 * F.col("a") >= contained * F.col("first"))).select("lang", F.slice("words", 1, size).alias("words"))
    covered = covered.unionByName(
        rows.where(whole & (100 * F.col("a") >= contained * F.col("last"))).select("lang", F.slice("words", F.lit(2), size).alias("words"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = rows.hint("merge").join(covered.distinct(), ["lang", "words"], "left_anti").withColumn("phrase", F.array_join("words", " "))
    ranked = kept.withColumn("rank", F.row_number().over(best))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
