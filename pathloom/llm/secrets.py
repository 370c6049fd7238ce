"""Secret scans (12): fixed patterns, and a battery of randomness tests that adds what they miss.

A key is a long run of letters, digits and their like that looks drawn at random from its alphabet. Every run is
given an encoding by its characters and tested three ways: chi-squared for uniform use of the alphabet, the runs
above and below its middle, and the correlation of neighbours. Fisher's sum of the three is the run's score.

How often ordinary text scores as high is not assumed but counted: all other text, written in each encoding and cut
into windows of each length, goes through the same tests. The share of windows that score as high is a run's
p-value, and Benjamini and Hochberg's rule per encoding and length keeps the expected share of false finds under
``FALSE_SHARE``. So a short run needs a far better score than a long one, and where ordinary text can look
random nothing is called a secret.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import small_batches
from pathloom.session import cut

#: Kinds in the order in which spans are listed; the first three are patterns.
KINDS = ("assign", "access", "hex", "random")
FALSE_SHARE = 0.01
#: A run belongs to the longest of these lengths that it reaches.
LENGTHS = (20, 24, 32, 40, 56, 80, 128)
#: Scores count by tenths of a power of ten below 1, down to 1e-40.
STEPS, LAST = 10, 400

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LENGTHS[0])

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Symbols of each encoding in order of their value; the first that holds all characters of a run is inferred.
ALPHABETS = {
    "hex": _DIGITS + "ABCDEF",
    "letters": _LOWER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
}
ENCODINGS = tuple(ALPHABETS)
#: Symbols that make up one byte of a plain text, where that number is whole: their places are tested apart.
PHASES = {"hex": 2}
#: Case says nothing in these, as long as it does not change within a run.
_FOLDED = ("hex", "letters", "base32", "base36")
_URL_SAFE = str.maketrans("-_", "+/")


def _values(encoding: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for value, symbol in enumerate(ALPHABETS[encoding]):
        out[ord(symbol)] = value
        if encoding in _FOLDED:
            out[ord(symbol.swapcase())] = value
    return out


_VALUES = {e: _values(e) for e in ENCODINGS}
_SYMBOLS = {e: frozenset(ALPHABETS[e]) for e in ENCODINGS}


def inferred(run: str) -> str:
    """The smallest encoding whose alphabet holds the run; mixed case leaves only those that tell cases apart."""
    seen = set(run.translate(_URL_SAFE))
    mixed = not run.isupper() and not run.islower()
    for encoding in ENCODINGS:
        symbols = _SYMBOLS[encoding]
        if encoding not in _FOLDED:
            if seen <= symbols:
                return encoding
        elif not mixed and ({c.lower() for c in seen} <= symbols or {c.upper() for c in seen} <= symbols):
            return encoding
    raise ValueError(f"not a run: {run!r}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' matches that are long enough, leftmost and non-overlapping per kind."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # a run of 16 and more is the same as a run whose length passes
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def by_start(spans: Sequence[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def runs(text: str, taken: Sequence[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs that could be keys and touch no span of a pattern."""
    found = [(m.start(), m.end()) for m in _RUN.finditer(text)]
    return [(s, e) for s, e in found if all(e <= t[1] or t[2] <= s for t in taken)] if found and taken else found


# --- the battery ----------------------------------------------------------------------------------

_Z = np.linspace(0, 40, 40_001)
_LOG_TAIL = np.array([math.log(max(math.erfc(z / math.sqrt(2)) / 2, 1e-300)) for z in _Z])


def _upper(z: np.ndarray) -> np.ndarray:
    """Logarithm of the normal probability above ``z``."""
    return np.where(z < 0, np.log1p(-np.exp(np.interp(-np.minimum(z, 0), _Z, _LOG_TAIL))), np.interp(z, _Z, _LOG_TAIL))


def _either(z: np.ndarray) -> np.ndarray:
    return np.minimum(0.0, math.log(2) + _upper(np.abs(z)))


def battery(symbols: np.ndarray, encoding: str) -> np.ndarray:
    """Scores of equally long runs, one per row of ``symbols`` (their values): 1 looks random, 0 does not.

    Chi-squared by Wilson and Hilferty's cube root, one-sided; runs above and below the middle are binomial and the sum of
    neighbours' products has a known variance, both two-sided and normal.
    """
    symbols = symbols.astype(np.int64)
    m, n = symbols.shape
    size, phases = len(ALPHABETS[encoding]), PHASES.get(encoding, 1)
    cell = symbols + size * (np.arange(n) % phases) + size * phases * np.arange(m)[:, None]
    cells = np.bincount(cell.ravel(), minlength=m * size * phases).reshape(m, phases, size).astype(float)
    places = np.array([len(range(p, n, phases)) for p in range(phases)])
    chi = (size / places * (cells**2).sum(2) - places).sum(1)
    free = phases * (size - 1)
    uniform = _upper((np.cbrt(chi / free) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    high = symbols >= size // 2
    changes = (high[:, 1:] != high[:, :-1]).sum(1)
    running = _either((changes - (n - 1) / 2) / (math.sqrt(n - 1) / 2))
    off = symbols - (size - 1) / 2
    serial = _either((off[:, 1:] * off[:, :-1]).sum(1) / (math.sqrt(n - 1) * (size * size - 1) / 12))
    half = -(uniform + running + serial)
    return np.exp(-half) * (1 + half + half**2 / 2)


def steps(scores: np.ndarray) -> np.ndarray:
    """How far below 1 a score lies, 0 to ``LAST``."""
    return np.clip(np.floor(-np.log10(np.maximum(scores, 1e-300)) * STEPS), 0, LAST).astype(int)


def run_step(run: str) -> tuple[int, int, int]:
    """(encoding, length class, step) of one run."""
    encoding = inferred(run)
    symbols = _VALUES[encoding][np.frombuffer(run.translate(_URL_SAFE).encode(), np.uint8)]
    length = sum(len(run) >= n for n in LENGTHS) - 1
    return ENCODINGS.index(encoding), length, int(steps(battery(symbols[None, :], encoding))[0])


# --- ordinary text --------------------------------------------------------------------------------

_KEPT = set((_DIGITS + _LOWER + _UPPER).encode())
_NO_WORD = bytes(b for b in range(256) if b not in _KEPT)
_NO_LETTER = bytes(b for b in range(256) if not chr(b).isalpha() or b > 127)
_NO_BASE32 = bytes(b for b in range(256) if b not in _KEPT or b in b"0189")
_SLUG = bytes(b if b in _KEPT else ord("-") for b in range(256))
_DASHES = re.compile(rb"-{2,}")


def written(raw: bytes, encoding: str) -> bytes:
    """Ordinary text as it would look in an encoding: words without spaces, words as a path, or its bytes in hex."""
    match encoding:
        case "hex":
            return raw.hex().encode()
        case "base32":
            return raw.translate(None, _NO_BASE32)
        case "letters":
            return raw.translate(None, _NO_LETTER).lower()
        case "base36":
            return raw.translate(None, _NO_WORD).lower()
        case "base62":
            return raw.translate(None, _NO_WORD)
    return _DASHES.sub(b"-", raw.translate(_SLUG)).replace(b"-", b"+")


_STRATA = [(e, n) for e in range(len(ENCODINGS)) for n in range(len(LENGTHS))]


class Windows:
    """Collects windows of ordinary text and counts their scores per encoding and length class.

    A text is cut into stretches that take all classes in turn, so every stretch is one window of one class. The class that
    begins follows from the text itself, hence the counts do not depend on how documents are dealt to tasks.
    """

    def __init__(self):
        self.held: dict[tuple[int, int], list[bytes]] = {s: [] for s in _STRATA}
        self.size = 0
        self.counts: dict[tuple[int, int], np.ndarray] = {}

    def add(self, text: str, skip: Sequence[tuple[int, int]]) -> None:
        at, parts = 0, []
        for start, end in sorted(skip):
            parts.append(text[at : max(at, start)])
            at = max(at, end)
        raw = " ".join([*parts, text[at:]]).encode() if parts else text.encode()
        k, at, held = zlib.crc32(raw), 0, self.held
        while at < len(raw):
            stratum = _STRATA[k % len(_STRATA)]
            encoding, length = ENCODINGS[stratum[0]], LENGTHS[stratum[1]]
            # letters and digits make up most of a text; a stretch too poor in them gives no window
            take = length if encoding == "hex" else 2 * length
            window = written(raw[at : at + take], encoding)[:length]
            if len(window) == length:
                held[stratum].append(window)
            at, k = at + take, k + 1
        self.size += len(raw)
        if self.size > 8 << 20:
            self.flush()

    def flush(self) -> None:
        for (e, n), windows in self.held.items():
            if windows:
                symbols = _VALUES[ENCODINGS[e]][np.frombuffer(b"".join(windows), np.uint8)].reshape(-1, LENGTHS[n])
                found = np.bincount(steps(battery(symbols, ENCODINGS[e])), minlength=LAST + 1)
                self.counts[e, n] = self.counts.get((e, n), 0) + found
                self.held[e, n] = []
        self.size = 0


def limits(counts: Sequence[tuple[int, int, int, int, int]], false_share: float) -> dict[tuple[int, int], int]:
    """Largest step at which a run is still a secret, per (encoding, length class), from (encoding, class, step, windows, runs).

    p of a step is the share of windows at or before it, with one window added; Benjamini and Hochberg's rule picks the
    largest step whose p is at most ``false_share`` times the share of runs at or before it. Without ordinary
    windows p is 1 and nothing is picked.
    """
    found: dict[tuple[int, int], list] = {}
    for e, n, step, windows, count in counts:
        found.setdefault((e, n), []).append((step, windows, count))
    out = {}
    for key, rows in found.items():
        all_windows, all_runs = sum(r[1] for r in rows), sum(r[2] for r in rows)
        windows = count = 0
        for step, w, c in sorted(rows):
            windows, count = windows + w, count + c
            if c and (1 + windows) * all_runs <= false_share * count * (1 + all_windows):
                out[key] = step
    return out


# --- the scan -------------------------------------------------------------------------------------

_SPAN = "struct<kind:string,start:int,end:int,encoding:int,length:int,step:int>"


def measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One pass over whole texts, written out: a row per document with base spans and runs, and a row per task with the counts of
    ordinary windows (``__counts`` is not null there)."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    schema = f"__id {kind.simpleString()}, spans array<{_SPAN}>, __counts array<struct<encoding:int,length:int,step:int,n:long>>"
    types = [
        to_arrow_type(kind),
        pa.list_(pa.struct([("kind", pa.string()), *((c, pa.int32()) for c in ("start", "end", "encoding", "length", "step"))])),
        pa.list_(pa.struct([*((c, pa.int32()) for c in ("encoding", "length", "step")), ("n", pa.int64())])),
    ]
    names = ["__id", "spans", "__counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = Windows()
        for batch in batches:
            out = []
            for body in batch.column(1).to_pylist():
                base = base_spans(body)
                found = runs(body, base)
                spans = [{"kind": k, "start": s, "end": e, "encoding": None, "length": None, "step": None} for k, s, e in by_start(base)]
                for s, e in found:
                    encoding, length, step = run_step(body[s:e])
                    spans.append({"kind": "random", "start": s, "end": e, "encoding": encoding, "length": length, "step": step})
                ordinary.add(body, [*found, *((s, e) for _, s, e in base)])
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, types[1]), pa.nulls(len(out), types[2])], names)
        ordinary.flush()
        counts = [
            {"encoding": e, "length": n, "step": int(step), "n": int(found[step])}
            for (e, n), found in sorted(ordinary.counts.items())
            for step in np.flatnonzero(found)
        ]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, types[0]), pa.nulls(1, types[1]), pa.array([counts], types[2])], names)

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return cut(docs.select(F.col(doc_id).alias("__id"), body.alias("__text")).mapInArrow(run, schema))


def score_counts(seen: DataFrame) -> DataFrame:
    """(encoding, length, step, windows, runs): how ordinary windows and runs score. At most 6 × 7 × 401 rows."""
    windows = seen.select(F.explode("__counts").alias("c")).select("c.*").withColumnRenamed("n", "windows").withColumn("runs", F.lit(0).cast("long"))
    found = seen.where(F.col("__counts").isNull()).select(F.explode("spans").alias("s")).where("s.step IS NOT NULL")
    found = found.select("s.encoding", "s.length", "s.step", F.lit(0).cast("long").alias("windows"), F.lit(1).cast("long").alias("runs"))
    both = windows.unionByName(found)
    return both.groupBy("encoding", "length", "step").agg(F.sum("windows").alias("windows"), F.sum("runs").alias("runs"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """(id, spans): per row of ``docs`` the spans (kind, start, end) in code points, by start and kind.

    Base spans are always kept; ``random`` ones are runs of 20 and more characters that touch none of them and pass the battery
    under false-discovery control over all documents. A null or empty text has no spans. Repeated rows give repeated rows and
    count each time, ties of scores are judged alike, an empty table gives no rows, other columns play no part. Texts are
    read whole, once; what reaches the driver are counts of scores, at most 16 842 rows.
    """
    seen = measured(docs, doc_id, text)
    most = limits([tuple(r) for r in score_counts(seen).collect()], false_share)

    def kept(s: Column) -> Column:
        passes = F.lit(False)
        for (e, n), step in sorted(most.items()):
            passes = passes | ((s["encoding"] == e) & (s["length"] == n) & (s["step"] <= step))
        return s["step"].isNull() | passes

    order = F.array(*(F.lit(k) for k in KINDS))
    spans = F.transform(
        F.filter("spans", kept),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")),
    )
    plain = F.transform(F.array_sort(spans), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return seen.where(F.col("__counts").isNull()).select(F.col("__id").alias(doc_id), plain.alias("spans"))


def digests(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select(doc_id, *counts[:3], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), counts[3])
