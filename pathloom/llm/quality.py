"""Quality rules (8): counts of every whole text, and compression bands.

Text that repeats itself compresses too well, noise hardly at all. Both are judged on the whole text and on
fixed chunks, against limits that depend on the length: a short text pays zstandard's header, a long one
gains from its own vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import SPACES, small_batches

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "ratio double, n_chunks long, n_bad_chunks long, reason string"
)


@dataclass(frozen=True)
class Band:
    """Texts of at least ``from_bytes`` may compress to between ``low`` and ``high`` of their size."""

    from_bytes: int
    low: float
    high: float


#: For text of any kind, where no labelled texts tell more. Below 128 bytes the header decides, so no band applies. Prose, licences and
#: manuals of 1 to 35 KB, among the most repetitive of ordinary texts, have ratios from 0.56 down to 0.33 and 4 KB chunks of 0.34 and more;
#: excerpts of 300 characters with ruled boxes 0.37.
BANDS = (
    Band(128, 0.35, 1.10), Band(256, 0.30, 1.00), Band(512, 0.30, 0.95), Band(1_024, 0.30, 0.90), Band(2_048, 0.30, 0.85),
    Band(4_096, 0.30, 0.80), Band(8_192, 0.27, 0.80), Band(16_384, 0.24, 0.80), Band(32_768, 0.18, 0.80), Band(65_536, 0.10, 0.80),
)
#: Labelled good texts that bands are fitted to, at most; chosen by the hash of their id.
SAMPLE = 5_000
CHUNK_BYTES = 4_096
#: Largest share of chunks outside their band.
BAD_CHUNKS = 0.3


def fitted(sizes: np.ndarray, ratios: np.ndarray, below: float = 0.02, above: float = 0.10, fewest: int = 20) -> list[Band]:
    """Bands of a quarter octave around the ratios of good texts, with a margin below and above.

    Ratios fall with the length, so their distance from a cubic in its logarithm is what is bounded, by texts of up to half an
    octave beside the band. Bands with fewer than ``fewest`` such texts are left out.
    """
    at = np.log2(sizes)
    course = np.poly1d(np.polyfit(at, ratios, 3))
    off = ratios - course(at)
    out = []
    for k in range(28, 60):
        near = off[(at >= k / 4 - 0.5) & (at < k / 4 + 0.75)]
        if len(near) >= fewest:
            low, high = course((k + 1) / 4) + near.min() - below, course(k / 4) + near.max() + above
            out.append(Band(round(2 ** (k / 4)), round(float(low), 3), round(float(high), 3)))
    return out


def fit_bands(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", good: int = 1, most: int = SAMPLE,
    below: float = 0.02, above: float = 0.10, fewest: int = 20,
) -> list[Band]:
    """Bands of a corpus from its own labelled texts: ``labels`` has ``doc_id`` and ``label``.

    At most ``most`` good ids are taken, by the hash of the id, so the bands do not depend on how rows are stored; the driver sees
    two numbers of each. Texts that fail the base rule tell nothing. Lengths with fewer than ``fewest`` texts near keep ``BANDS``.
    """
    small_batches(docs.sparkSession)
    ids = labels.where(F.col(label) == good).select(F.col(doc_id).alias("__id")).where(F.col("__id").isNotNull()).distinct()
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(most)
    # at most ``most`` ids travel to the texts
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(ids), "__id", "left_semi")
    # judged after the join: a condition on the verdict would be pushed below it, to every text
    seen = rows.select("__id", F.octet_length("__text").alias("size"), verdict(F.col("__text"), ()).alias("v"))
    found = seen.groupBy("__id").agg(F.min(F.struct("v.base_failed", "size", "v.ratio")).alias("x")).select("x.*").collect()
    found = [(r["size"], r["ratio"]) for r in found if not r["base_failed"] and r["size"] >= 128]
    if len(found) < fewest:
        return list(BANDS)
    sizes, ratios = (np.array(c, float) for c in zip(*sorted(found)))
    own = {b.from_bytes: b for b in fitted(sizes, ratios, below, above, fewest)}
    grid = sorted({*own, *(round(2 ** (k / 4)) for k in range(28, 68))})
    given = ((n, next(b for b in reversed(BANDS) if n >= b.from_bytes)) for n in grid)
    return [own.get(n, Band(n, b.low, b.high)) for n, b in given]


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in an eight-word window found twice or more; exact, by ranks of 2, 4 and 8 words.

    Only positions whose shorter windows repeat are ranked further, so ordinary text ends after one sort.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    at = np.arange(n)
    width = 1
    while width < WINDOW:
        size = n - 2 * width + 1
        both = at[(at < size)]
        there = np.zeros(n, bool)
        there[at] = True
        both = both[there[both + width]]
        if not len(both):
            return 0
        pair = rank[both] * (int(rank.max()) + 1) + rank[both + width]
        _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        at = both[again]
        if not len(at):
            return 0
        rank = np.zeros(n, np.int64)
        rank[at] = inverse[again]
        width *= 2
    edges = np.zeros(n + 1, np.int64)
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return int((np.cumsum(edges) > 0).sum())


def outside(size: int, ratio: float, bands: Sequence[Band]) -> str | None:
    """``repetitive``, ``incompressible`` or None."""
    band = next((b for b in reversed(bands) if size >= b.from_bytes), None)
    if band is None:
        return None
    return "repetitive" if ratio < band.low else "incompressible" if ratio > band.high else None


def judge_text(text: str | None, packer, bands: Sequence[Band], chunk_bytes: int, bad_chunks: float) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = repeated_words(words)
    failed = n < 20 or 100 * repeat > 30 * n
    ratio = len(packer.compress(raw)) / len(raw) if raw else None
    whole = outside(len(raw), ratio, bands) if raw else None
    # a last piece under half a chunk says little; it counts only where it is the whole text
    chunks = [raw[i : i + chunk_bytes] for i in range(0, len(raw), chunk_bytes)] if len(raw) > chunk_bytes else []
    if chunks and len(chunks[-1]) < chunk_bytes // 2:
        chunks.pop()
    bad = [r for r in (outside(len(c), len(packer.compress(c)) / len(c), bands) for c in chunks) if r]
    reason = "base" if failed else whole if whole else f"chunks {bad[0]}" if len(bad) > bad_chunks * len(chunks) else None
    return (
        n,
        len(text or "") - sum((text or "").count(c) for c in SPACES),
        sum(raw.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat,
        failed,
        reason is None,
        ratio,
        len(chunks),
        len(bad),
        reason,
    )


def verdict(text: Column, bands: Sequence[Band] = BANDS, chunk_bytes: int = CHUNK_BYTES, bad_chunks: float = BAD_CHUNKS) -> Column:
    """Counts, ratio and verdict of a text as one struct. No shuffle; a task holds one batch of texts.

    Null and empty texts have no words, no ratio and fail the base rule. Long texts are compressed whole.
    """
    names = [c.split()[0] for c in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def judge(texts: pd.Series) -> pd.DataFrame:
        packer = zstandard.ZstdCompressor(level=3)
        return pd.DataFrame([judge_text(t, packer, bands, chunk_bytes, bad_chunks) for t in texts], columns=names)

    return judge(text)


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per document: its id, the counts and the verdict. Repeated rows are judged each; other columns play no part."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id), verdict(F.col(text), **limits).alias("v")).select(doc_id, "v.*")


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents that pass, with all their columns unchanged."""
    small_batches(docs.sparkSession)
    return docs.where(verdict(docs[text], **limits)["kept"])
