"""N-gram Jaccard join (4): MinHash candidates, pruned by posterior probability, the rest verified exactly.

1. Every text becomes a MinHash signature and band keys. Equal texts are one node from here on.
2. Nodes that share a band meet. Their signatures are compared sixteen values at a time; a pair goes as soon as the
   posterior probability that it reaches the threshold falls below the tolerance. Only a spanning forest of what is
   left leaves the task: as many rows as nodes, not as pairs.
3. The forests make groups of candidates. Inside a group the same pruning runs again over all pairs, and every pair
   that survives is verified on its whole shingle sets. Links are counted where they are found, and again only a
   spanning forest leaves the task.

Buckets and groups of any size are cut into blocks; each pair of blocks is a task's work of bounded size. No link is
left out to save work, and pairs are never rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import complete_groups, connected, linked, small_batches
from pathloom.session import cut

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: A pair at the threshold misses all bands with probability (1 - 0.8⁴)²⁴ = 3e-6.
BANDS, BAND_ROWS = 24, 4
HASHES = BANDS * BAND_ROWS
STEP = 16
#: Nodes of a bucket, nodes and shingles of a group that make one block.
BUCKET_BLOCK, GROUP_BLOCK, GROUP_SHINGLES = 1_024, 512, 1_000_000
REMEMBERED = 1_000_000
PAIRS = 1 << 20

_random = np.random.default_rng(20_240_601)
_XOR = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_PLACE = _random.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


class Shingles:
    """64-bit hashes of the word shingles of a text, words in lower case and separated by ASCII white space."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.lower().encode().split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        width = min(n, SHINGLE)  # a shorter text is one shingle
        h = ids[: n - width + 1] * _PLACE[0]
        for k in range(1, width):
            h = h + ids[k : n - width + 1 + k] * _PLACE[k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 4_096):
        low = np.minimum(low, ((short[i : i + 4_096] ^ _XOR[:, None]) * _ODD[:, None]).min(1))
    return low


def fewest_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair) after every step.

    With a uniform prior, Pr[similarity >= t | m of n match] is the chance of at most m successes in n + 1 trials at t.
    Values are compared by one byte, so unlike ones match with chance 1/256 and t moves up by that.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(signs: np.ndarray, a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no step drops."""
    same = np.zeros(len(a), np.int64)
    for n, m in needed:
        same = same + (signs[a, n - STEP : n] == signs[b, n - STEP : n]).sum(1)
        stay = same >= m
        a, b, same = a[stay], b[stay], same[stay]
    return a, b


def pairs_within(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside each group, in portions of bounded size."""
    sizes = np.diff(starts)
    for size in np.unique(sizes[sizes > 1]):
        first = starts[:-1][sizes == size]
        i, j = np.triu_indices(size, 1)
        for k in range(0, len(i), PAIRS):
            some = max(1, PAIRS // len(i))
            for g in range(0, len(first), some):
                yield (
                    (first[g : g + some, None] + i[None, k : k + PAIRS]).ravel(),
                    (first[g : g + some, None] + j[None, k : k + PAIRS]).ravel(),
                )


def shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs' sets."""
    if len(a) <= 4:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    used = np.unique(np.concatenate([a, b]))
    row = np.zeros(len(sets), np.int64)
    row[used] = np.arange(len(used))
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    often = counts > 1  # a shingle of one set only is in no intersection
    column = np.cumsum(often) - 1
    keep = often[at]
    owner, at = owner[keep], column[at[keep]]
    out = np.zeros(len(a), np.int64)
    width = 1 << 14
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        lo, hi = np.searchsorted(at, [start, start + width])
        bits = np.zeros((len(used), width), bool)
        bits[owner[lo:hi], at[lo:hi] - start] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        some = max(1, (1 << 23) // (width // 8))
        for p in range(0, len(a), some):
            out[p : p + some] += np.bitwise_count(packed[row[a[p : p + some]]] & packed[row[b[p : p + some]]]).sum(1).astype(np.int64)
    return out


def _signed(rows: DataFrame, keep_text: bool) -> DataFrame:
    """Rows (row, id, text) with the text's MD5, number of shingles, band keys and one byte per MinHash value; written.

    The text itself is written with them unless the caller holds it in a table already.
    """
    kind = rows.schema["id"].dataType.simpleString()
    held = 3 if keep_text else 2
    names = [*["row", "id", "text"][:held], "copy", "shingles", "bands", "signs"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            copy, count, bands, signs = [], [], [], []
            for t in batch.column(2).to_pylist():
                t = t or ""
                copy.append(hashlib.md5(t.encode()).digest())
                h = shingles.of(t)
                count.append(len(h))
                low = minhash(h) if len(h) else None
                # the low byte: a minimum over many shingles is small, so its high byte is 0 for every long text
                signs.append(None if low is None else (low & np.uint32(0xFF)).astype(np.uint8).tobytes())
                raw = b"" if low is None else low.tobytes()
                width = 4 * BAND_ROWS
                bands.append([xxhash.xxh64_intdigest(raw[i : i + width], i) - (1 << 63) for i in range(0, len(raw), width)])
            columns = [pa.array(copy, pa.binary()), pa.array(count, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], *columns], names)

    text = "text string, " if keep_text else ""
    return cut(rows.select("row", "id", "text").mapInArrow(sign, f"row long, id {kind}, {text}copy binary, shingles long, bands array<long>, signs binary"))


def _block_pairs(members: DataFrame, blocks: str) -> DataFrame:
    """Every member once per pair of blocks that it belongs to: columns ``one``, ``two`` and its own ``block``."""
    own = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    return own.withColumn("__other", other).withColumns({"one": F.least("block", "__other"), "two": F.greatest("block", "__other")}).drop("__other")


def _signs_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _candidates(nodes: DataFrame, needed: list[tuple[int, int]]) -> DataFrame:
    """(a, b): spanning forests of the pairs that share a band and survive."""
    entries = nodes.where(F.col("signs").isNotNull()).select("node", F.explode("bands").alias("key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    met = entries.join(sizes, "key").join(nodes.select("node", "signs"), "node")
    met = _block_pairs(met.withColumn("blocks", F.ceil(F.col("n") / BUCKET_BLOCK)), "blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in complete_groups(batches, 3):
            one, two = table.column(1).to_numpy(), table.column(2).to_numpy()
            node, block, signs = table.column(3).to_numpy(), table.column(4).to_numpy(), _signs_of(table.column(5))
            found = [(np.zeros(0, np.int64),) * 2]
            for a, b in pairs_within(starts):
                new = (one[a] == two[a]) | (block[a] != block[b])
                found.append(surviving(signs, a[new], b[new], needed))
            root = linked(len(node), *(np.concatenate(x) for x in zip(*found)))
            hung = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(node[root[hung]])], ["a", "b"])

    work = met.select("key", "one", "two", "node", "block", "signs").repartition("key", "one", "two")
    return work.sortWithinPartitions("key", "one", "two", "node").mapInArrow(compare, "a long, b long")


def _verified(members: DataFrame, threshold: float, needed: list[tuple[int, int]]) -> DataFrame:
    """(node, links, root, whole): per node and pair of blocks the links found and the node it hangs under.

    ``members``: group, node, blocks, signs, text.
    """
    t = Fraction(str(threshold))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for table, starts in complete_groups(batches, 3):
            one, two = table.column(1).to_numpy(), table.column(2).to_numpy()
            node, block, signs = table.column(3).to_numpy(), table.column(4).to_numpy(), _signs_of(table.column(5))
            texts = table.column(6)
            for lo, hi in zip(starts[:-1], starts[1:]):
                sets = [np.unique(shingles.of(texts[i].as_py())) for i in range(lo, hi)]
                size = np.array([len(s) for s in sets])
                left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for a, b in pairs_within(np.array([0, hi - lo])):
                    if one[lo] != two[lo]:
                        new = block[lo + a] != block[lo + b]
                        a, b = a[new], b[new]
                    a, b = surviving(signs[lo:hi], a, b, needed)
                    both = shared(sets, a, b)
                    real = both * t.denominator >= (size[a] + size[b] - both) * t.numerator
                    left.append(a[real])
                    right.append(b[real])
                a, b = np.concatenate(left), np.concatenate(right)
                root = linked(hi - lo, a, b)
                links = np.bincount(a, minlength=hi - lo) + np.bincount(b, minlength=hi - lo)
                hit = np.flatnonzero(links)
                own = node[lo:hi]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[hit]), pa.array(links[hit]), pa.array(own[root[hit]])], ["node", "links", "root"]
                )

    work = _block_pairs(members, "blocks").select("group", "one", "two", "node", "block", "signs", "text")
    work = work.repartition("group", "one", "two").sortWithinPartitions("group", "one", "two", "node")
    return work.mapInArrow(verify, "node long, links long, root long")


def _classes(rows: DataFrame, texts: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(copy, node, copies, links, class) of every distinct text. ``texts``: row, text."""
    needed = fewest_matches(threshold, tolerance)
    # the first row stands for all rows of its text; counted before the shuffle
    first = F.min(F.struct("row", "shingles", "bands", "signs")).alias("f")
    nodes = cut(
        rows.groupBy("copy").agg(first, F.count(F.lit(1)).alias("copies"))
        .select("copy", "copies", F.col("f.row").alias("node"), "f.shingles", "f.bands", "f.signs")
    )
    hung = connected(_candidates(nodes, needed))
    grouped = cut(hung.select("node", F.col("root").alias("group")).unionByName(hung.select(F.col("root").alias("node"), F.col("root").alias("group")).distinct()))
    weighed = grouped.join(nodes.select("node", "shingles", "signs"), "node")
    sizes = weighed.groupBy("group").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK), F.ceil(F.sum("shingles") / GROUP_SHINGLES)).alias("blocks")
    )
    members = weighed.join(sizes, "group").join(texts.select(F.col("row").alias("node"), "text"), "node")
    found = cut(_verified(members, threshold, needed))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found, "node", "root")
    return (
        nodes.select("copy", "node", "copies")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .select("copy", "node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("class"))
    )


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: (id, class_id, n_copies, n_links).

    Documents of one class are connected by links; a link joins two different texts whose sets of five-word shingles have a
    Jaccard similarity of ``threshold`` or more. ``class_id`` is the smallest id in the class, ``n_copies`` the number of documents with
    exactly this text, ``n_links`` the number of other texts this one is linked to.

    Texts of fewer than five words are one shingle. Texts without a word have none and are linked to nothing; equal ones are
    copies, and null counts as empty. Null ids stay; a class of null ids only has a null class id. Repeated rows are copies.
    Other columns play no part. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.monotonically_increasing_id().alias("row"), docs[doc_id].alias("id"), docs[text].alias("text"))
    rows = _signed(given, keep_text=True)
    classes = cut(_classes(rows, rows, threshold, tolerance))
    held = cut(rows.select("id", "copy").join(classes, "copy"))
    names = held.groupBy("class").agg(F.min("id").alias("class_id"))
    return held.join(names, "class").select(
        F.col("id").alias(doc_id), "class_id", F.col("copies").alias("n_copies"), F.col("links").alias("n_links")
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each class left, the one with the smallest id, with all columns as they were.

    Null ids come last; of rows with the same id the first in the order of reading stays.
    """
    small_batches(docs.sparkSession)
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("whole")
    held = cut(docs.select(F.monotonically_increasing_id().alias("row"), whole))
    texts = held.select("row", F.col(f"whole.`{text}`").alias("text"))
    named = F.struct(F.col(f"whole.`{doc_id}`").isNull().alias("none"), F.col(f"whole.`{doc_id}`").alias("id"), "row").alias("id")
    rows = _signed(held.select("row", named, F.col(f"whole.`{text}`").alias("text")), keep_text=False)
    classes = _classes(rows, texts, threshold, tolerance)
    stay = rows.select("id", "copy").join(classes, "copy").groupBy("class").agg(F.min("id")["row"].alias("row"))
    return held.join(stay, "row", "left_semi").select("whole.*")
