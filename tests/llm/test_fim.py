"""Fill-in-middle: rules against a plain rewrite, streams cut anywhere, round trips."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pathloom.llm import fim

DOCS = "doc_id long, text string, lang string, n long, form string, __row string"


def expected(doc_id, text):
    """The rule once more, without pieces."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", lo, hi - lo, f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents():
    r = random.Random(2)
    texts = [None, "", "a", "<", "<P", "x<M>y", "tail <", "<<<<", "S><P", "日本語 😀 é", "\x00\n"]
    texts += ["".join(r.choice("ab<PSM> é😀\n") for _ in range(r.randrange(60))) for _ in range(120)]
    texts += ["long 😀 " * 30_000, "x" * 100_000]
    rows = [(i, t, "l", -1, "f", "r") for i, t in enumerate(texts)]
    return rows + rows[:20] + [(None, "no id", None, None, None, None)] * 2 + [(5, "same id", None, None, None, None)]


@pytest.mark.parametrize("chunk", [3, fim.CHUNK])
def test_digests(spark, chunk):
    rows = [d for d in documents() if chunk > 3 or len(d[1] or "") < 1_000]
    got = fim.digests(spark.createDataFrame(rows, DOCS), chunk=chunk).collect()
    want = [(d[0], *(e := expected(d[0], d[1]))[:4], sha(e[4]), sha(d[1] or "")) for d in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def test_outputs_and_their_texts(spark):
    rows = documents()
    out = fim.transform(spark.createDataFrame(rows, DOCS))
    got = sorted(map(tuple, out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=repr)
    assert got == sorted(((d[0], *expected(d[0], d[1])) for d in rows), key=repr)
    back = fim.restore(out).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((d[0], d[1] or "") for d in rows), key=repr)


def test_other_rules(spark):
    rows = [(i, "some text of its own", None, None, None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r[0] for r in fim.digests(docs, fim_percent=0).select("form").collect()} == {"plain"}
    assert {r[0] for r in fim.digests(docs, fim_percent=100, spm_percent=100).select("form").collect()} == {"spm"}
    assert fim.digests(docs, seed=2).where(F.col("restored_sha256") != sha(rows[0][1])).isEmpty()
    one, two = (fim.digests(docs, seed=s).select("doc_id", "output_sha256").collect() for s in (1, 2))
    assert sorted(one) != sorted(two)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert fim.digests(docs).collect() == [] and fim.transform(docs).collect() == []


def test_reader_takes_pieces_cut_anywhere():
    r = random.Random(4)
    for _ in range(300):
        doc_id, text = r.randrange(1_000), "".join(r.choice("a<PSM>") for _ in range(r.randrange(30)))
        n, form, _, _, output = expected(doc_id, text)
        reader, parts, at = fim.Reader(form), [], 0
        while at < len(output):
            size = r.randrange(1, 5)
            parts += reader.feed(output[at : at + size])
            at += size
        parts += reader.rest()
        assert "".join(s for _, _, s in sorted(parts)) == text


def test_one_exchange(spark):
    docs = spark.createDataFrame(documents()[:5], DOCS)
    plan = fim.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2
