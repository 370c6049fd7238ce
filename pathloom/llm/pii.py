"""PII (2): fixed patterns, and a conditional random field over word shapes that adds what they miss.

The patterns run in linear time over every whole text. The field sees stretches of words that hold a digit or an at
sign, with one plain word on either side; it is trained on a small labelled table taken from the same documents and
decoded by Viterbi, a batch of stretches at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import crf
from pathloom.llm.common import small_batches

#: Kinds in the order in which spans are listed; the first four have patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Documents that training takes its stretches from, about, and the most stretches.
TRAIN_DOCS, TRAIN_STRETCHES = 1_500, 2_500
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What the labelled table calls a secret: a long word of letters and digits after a telling name.
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api_?key)\s*[=:]\s*[\"']?([0-9a-z_\-]{16,})")
_AROUND = "\"'`.,;:!?%$#*&|<>[]{}="


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # a match holds exactly one @; its local part is the run before it, as far as no earlier match reaches into it
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            yield start, tail.end()
            end = tail.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def _from_digits(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    # a match starts where a run of digits starts and ends where one ends
    end = 0
    for run in _DIGITS.finditer(text):
        if run.start() >= end and (m := pattern.match(text, run.start())):
            end = m.end()
            yield run.start(), end


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' matches that pass their checks, leftmost and non-overlapping per kind."""
    out = [("email", s, e) for s, e in _emails(text)]
    if not _DIGITS.search(text):
        return out
    out += [("ip", s, e) for s, e in _from_digits(text, _IP) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in text[s:e].split("."))]
    for s, e in _from_digits(text, _CARD):
        digits = re.sub(r"[\x20-]", "", text[s:e])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", s, e))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def shape(word: str) -> str:
    """Letters as x or X, digits as d with the length of their run, other characters as they are; runs of letters are one."""
    word = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() else "x", word.strip(_AROUND))
    return re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 20)}", word)[:40]


def stretches(text: str) -> list[list[tuple[int, int, bool]]]:
    """Runs of words (start, end, marked): those with a digit or @, one plain word around each, overlapping runs as one."""
    marked, end = [], 0
    for m in _MARK.finditer(text):
        start = m.start()
        while start > end and not _SPACE.match(text[start - 1]):
            start -= 1
        marked.append((start, m.end(), True))
        end = m.end()
    out: list[list[tuple[int, int, bool]]] = []
    for i, (start, stop, _) in enumerate(marked):
        floor = out[-1][-1][1] if out else 0
        before = _last_word(text, floor, start)
        if out and before is None:
            out[-1].append((start, stop, True))
        else:
            out.append([before, (start, stop, True)] if before else [(start, stop, True)])
        after = _WORD.search(text, stop)
        if after and (i + 1 == len(marked) or after.end() <= marked[i + 1][0]):
            out[-1].append((after.start(), after.end(), False))
    return out


def _last_word(text: str, floor: int, start: int) -> tuple[int, int, bool] | None:
    stop = start
    while stop > floor and _SPACE.match(text[stop - 1]):
        stop -= 1
    first = stop
    while first > floor and not _SPACE.match(text[first - 1]):
        first -= 1
    return (first, stop, False) if first < stop else None


def _checked(core: str) -> str:
    """Whether a number of a card's length passes Luhn, or four numbers are all a byte."""
    if core.isascii() and core.isdigit() and 13 <= len(core) <= 19:
        return f"card {luhn(core)}"
    if _IP.fullmatch(core):
        return f"ip {all(len(p.lstrip('0')) < 4 and int(p) <= 255 for p in core.split('.'))}"
    return ""


def features(text: str, words: list[tuple[int, int, bool]]) -> list[list[str]]:
    shapes = [shape(text[s:e]) for s, e, _ in words]
    out = []
    for i, (s, e, marked) in enumerate(words):
        core = text[s:e].strip(_AROUND)
        size = e - s
        out.append([
            f"s={shapes[i]}",
            f"p={shapes[i - 1] if i else ''}",
            f"n={shapes[i + 1] if i + 1 < len(words) else ''}",
            f"d={min(sum(c.isdigit() for c in core[:64]), 20)}",
            f"m={marked} @={'@' in core} +={core[:1] == '+'} .={min(core.count('.'), 4)}",
            f"check={_checked(core)}",
            f"hex={size >= 32 and re.fullmatch('[0-9a-fA-F]+', core) is not None} l={min(size // 4, 10)}",
        ])
    return out


def labelled(text: str) -> list[tuple[list[list[str]], list[str]]]:
    """Stretches with a label per word, from the patterns and the rule for secrets."""
    spans = base_spans(text) + [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    out = []
    for words in stretches(text):
        tags = []
        for s, e, _ in words:
            hit = next((k for k, a, b in spans if a < e and s < b), None)
            began = hit and any(a < s and k == hit and s < b for k, a, b in spans)
            tags.append(f"{'I' if began else 'B'}-{hit}" if hit else "O")
        out.append((features(text, words), tags))
    return out


def training_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = TRAIN_DOCS, most: int = TRAIN_STRETCHES) -> DataFrame:
    """(features, labels): a bounded number of labelled stretches, from documents chosen by the hash of their id."""
    share = min(1.0, documents / max(docs.count(), 1))
    chosen = docs.where(F.pmod(F.xxhash64(docs[doc_id], F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f[: crf.TRAIN_LENGTH], t[: crf.TRAIN_LENGTH]) for x in b["t"] for f, t in labelled(x or "")]
            yield pd.DataFrame(rows, columns=["features", "labels"])

    found = chosen.select(docs[text].alias("t")).mapInPandas(label, "features array<array<string>>, labels array<string>")
    return found.limit(most)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> crf.Model:
    """The field, trained on the driver on the bounded table."""
    small_batches(docs.sparkSession)
    table = training_table(docs, doc_id, text).toPandas()
    if not len(table):
        return crf.train([], [], LABELS)
    return crf.train([[list(w) for w in s] for s in table["features"]], [list(t) for t in table["labels"]], LABELS)


def find(texts: list[str], model: crf.Model) -> list[list[tuple[str, int, int, bool]]]:
    """All spans (kind, start, end, base) of each text, by kind and start."""
    base = [base_spans(t) for t in texts]
    runs = [(i, words) for i, t in enumerate(texts) for words in stretches(t)]
    paths = model.decode([features(texts[i], words) for i, words in runs])
    more: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, words), tags in zip(runs, paths):
        for (s, e, marked), tag in zip(words, tags):
            if tag == "O" or not marked:
                continue
            kind = tag[2:]
            s += len(texts[i][s:e]) - len(texts[i][s:e].lstrip(_AROUND))
            e -= len(texts[i][s:e]) - len(texts[i][s:e].rstrip(_AROUND))
            if s >= e:
                continue
            last = more[i][-1] if more[i] else None
            if tag[0] == "I" and last and last[0] == kind and not _WORD.search(texts[i], last[2], s):
                more[i][-1] = (kind, last[1], e)
            else:
                more[i].append((kind, s, e))
    out = []
    for own, added in zip(base, more):
        taken = sorted((s, e) for _, s, e in own)
        free, k = [], 0
        for kind, s, e in sorted(added, key=lambda x: x[1]):
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if k == len(taken) or taken[k][0] >= e:
                free.append((kind, s, e, False))
        out.append(sorted([(*x, True) for x in own] + free, key=lambda x: (KINDS.index(x[0]), x[1])))
    return out


def spans(text: Column, model: crf.Model) -> Column:
    """Spans of every text as an array, code points, end exclusive; a null text counts as empty. No shuffle."""

    @F.pandas_udf(SPAN)
    def run(texts: pd.Series) -> pd.Series:
        found = find([t or "" for t in texts], model)
        return pd.Series([[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in x] for x in found])

    return run(text)


def detect(docs: DataFrame, model: crf.Model | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, found): the spans of every row. Repeated rows are searched each, other columns play no part; an empty table gives no rows.

    Spans of the field never overlap those of the patterns. Without labelled stretches the field adds none.
    """
    model = model or train(docs, doc_id, text)
    return docs.select(F.col(doc_id), spans(docs[text], model).alias("found"))


def redact_text(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """Every span replaced by its kind in brackets; overlapping spans are one, named after the first."""
    out, end = [], 0
    for kind, s, e, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: crf.Model | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text; null stays null, other columns as they were (``n_chars`` follows the text)."""
    model = model or train(docs, doc_id, text)
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        found = find([t or "" for t in texts], model)
        return pd.Series([None if t is None else redact_text(t, f) for t, f in zip(texts, found)], dtype=object)

    done = docs.withColumn(text, run(docs[text]))
    return done.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else done
