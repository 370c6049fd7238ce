"""Collocations against counting everything, and the streams' own parts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pathloom.llm import collocations as c

DOCS = "doc_id long, text string, lang string, phrase string, k int, a long"


def counted(rows, min_count, longest, contained, top):
    """All phrases counted in memory."""
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, of in counts.items():
        n, kept = totals[lang], []
        candidates = {w: a for w, a in of.items() if len(w) > 1 and a >= min_count}
        for w, a in candidates.items():
            score, k = min((1000 * a * n // (of[w[:k]] * of[w[k:]]), k) for k in range(1, len(w)))
            around = (b for v, b in candidates.items() if len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))))
            if not any(100 * b >= contained * a for b in around):
                kept.append((-score, -a, " ".join(w).encode(), of[w[:k]], of[w[k:]]))
        for rank, (s, a, w, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, w.decode(), -a, l, r, n, -s))
    return sorted(out)


def documents(seed, n=150):
    r = random.Random(seed)
    words = ["the", "The", "of", "a", "of the", "new york", "new york city", "é", "日本", "x y", "Iİ"]
    seps = [" ", "  ", "\t", ". ", ",", "\n", " \r\n", "; "]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice(seps if r.random() < 0.3 else [" "]) for _ in range(r.randrange(40)))
        rows.append((i, text, r.choice(["en", "de", None, "und", ""]), "clash", 1, 2))
    rows += rows[:30] + [(None, None, "en", None, None, None), (1, "", "fr", None, None, None), (1, " . ", "fr", None, None, None)]
    return rows + [(2, "one passage that comes back again and again " * 40, "en", None, None, None)]


@pytest.mark.parametrize("min_count, longest, contained, top", [(3, 5, 100, 2_000), (2, 5, 60, 7), (8, 3, 100, None), (3, 2, 100, 5), (3, 7, 90, 50)])
def test_against_counting_everything(spark, min_count, longest, contained, top):
    rows = documents(min_count + longest)
    got = c.mine(spark.createDataFrame(rows, DOCS).repartition(5), min_count=min_count, longest=longest, contained=contained, top=top)
    assert sorted(map(tuple, got.collect())) == counted(rows, min_count, longest, contained, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_several_flushes(spark, monkeypatch):
    """Counts do not depend on how much a task holds; workers are forked, so this calls the counter itself."""
    rows = documents(9)
    import pyarrow as pa

    monkeypatch.setattr(c, "HELD_WORDS", 50)
    monkeypatch.setattr(c, "HELD_DISTINCT", 5)
    batches = [
        pa.RecordBatch.from_arrays([pa.array([x[2] or "und" for x in some]), pa.array([(x[1] or "").encode() for x in some], pa.binary())], ["lang", "text"])
        for some in (rows[i : i + 7] for i in range(0, len(rows), 7))
    ]
    found = Counter()
    for batch in c._counter([1], None)(iter(batches)):
        for lang, k, phrase, n in zip(*(col.to_pylist() for col in batch.columns)):
            found[lang, k, phrase] += n
    words = Counter()
    for _, text, lang, *_ in rows:
        for w in c.split_words((text or "").encode()):
            if w != c.BREAK:
                words[lang or "und", 1, w.decode()] += 1
                words[lang or "und", 0, None] += 1
    assert {k: n for k, n in found.items() if n} == dict(words)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None)], [(1, "once", "en", None, None, None)]])
def test_nothing_to_find(spark, rows):
    assert c.mine(spark.createDataFrame(rows, DOCS), min_count=2).collect() == []


def test_products_beyond_64_bits():
    """Ten million million words: numerators pass 64 bits, scores do not."""
    assert 1000 * 10**9 * 10**13 > 2**63
    import pyarrow as pa

    rows = pa.RecordBatch.from_pylist([{"lang": "x", "__salt": 0, "words": w, "a": a} for w, a in ((["p"], 10**12), (["p", "q"], 10**9))])
    ((_, chains),) = c._chained(iter([rows]), False)
    assert chains == [None, [10**12]]


def test_a_filter_passes_all_its_phrases(spark):
    rows = [("en", f"w{i} v{i % 7}") for i in range(500)]
    marked = c.marked(c.hashes_of(spark.createDataFrame(rows, "lang string, phrase string")), 2)
    import xxhash

    words = np.array([[xxhash.xxh64_intdigest(w) for w in p.split()] for _, p in rows], np.uint64)
    assert marked.passes(c.folded("en", list(words.T))).all()
    assert marked.passes(c.folded("de", list(words.T))).mean() < 0.2


def test_a_missing_part_is_noticed():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pylist([{"lang": "x", "__salt": 0, "words": ["p", "q"], "a": 3}])
    with pytest.raises(AssertionError):
        list(c._chained(iter([rows]), False))
