"""Operators over whole tables: revisits (1), URL rules (3), near duplicates (4), shards (5), neighbours (9), line dedup (10)."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import linededup, load_queries, nearest, neardup, sharding, urlrules, warc
from pathloom.plans.check import difference, duck

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = load_queries()
DOCS = "doc_id long, text string, row string, line string, words string, node string, set string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *"rlwns") for r in rows], DOCS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_checking_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), duck(SF), CHECKS[name]) is None


# --- revisits -------------------------------------------------------------------------------------

RECORDS = "record_id long, url string, ts long, type string, payload_digest string, headers array<struct<name:string,value:string>>, key string, stored string"


def records(spark, rows):
    return spark.createDataFrame([(*r, "k", "s") for r in rows], RECORDS)


def test_revisits(spark, hot):
    e = lambda v, *more: [("ETag", v), *more]
    rows = [
        (1, "http://A.com:80/x/?b=2&a=1&utm_source=q#f", 10, "response", "d1", e('"1"', ("Content-Length", "9"), ("Date", "old"))),
        (2, "https://a.com/x?a=1&b=2", 10, "revisit", None, e('"1"')),  # same time: not earlier
        (3, "https://a.com/x?a=1&b=2", 11, "revisit", None, e('W/"1"', ("content-length", "0"), ("date", "new"))),
        (4, "https://a.com/x?a=1&b=2", 12, "revisit", "d2", e('"1"')),  # digest of another content
        (5, "https://a.com/x?a=1&b=2", 13, "revisit", None, None),
        (6, "https://a.com/x?a=1&b=2", 14, "response", "d6", [("Last-Modified", "m")]),
        (7, "https://a.com/x?a=1&b=2", 15, "revisit", None, [("etag", '"1"'), ("last-modified", "m")]),
        (8, "https://b.com", 15, "revisit", None, e('"1"')),
        (9, None, 15, "revisit", None, e('"1"')),
        (10, "https://a.com/x?a=1&b=2", None, "revisit", None, e('"1"')),
        (11, "https://a.com/x?a=1&b=2", 16, None, None, None),
        (None, "https://a.com/x?b=2&a=1", 17, "revisit", "d6", None),
        (None, "https://a.com/x?b=2&a=1", 17, "revisit", "d6", None),
    ]
    want = {2: ("no response", None), 3: ("resolved", 1), 4: ("differs", 1), 5: ("no validator", 1), 7: ("resolved", 6), 8: ("no response", None),
            9: ("no key", None), 10: ("no key", None), None: ("resolved", 6)}
    for bound in (1_000_000, 3):
        hot(bound)
        got = warc.resolve_revisits(records(spark, rows)).collect()
        assert len(got) == 10 and {r["record_id"]: (r["state"], r["refers_to"]) for r in got} == want
        third = next(r for r in got if r["record_id"] == 3)
        assert [tuple(h) for h in third["headers"]] == [("Content-Length", "9"), ("ETag", 'W/"1"'), ("date", "new")]
        assert third["payload_digest"] == "d1" and third["key"] == "a.com/x?a=1&b=2"
    assert warc.resolve_revisits(records(spark, [])).count() == 0


# --- URL rules ------------------------------------------------------------------------------------


def test_url_rules(spark):
    wild = [*urlrules.WILDCARD_RULES, urlrules.WildcardRule("block", "zzz")]
    urls = [
        None, "", "nothing", "http://", "http://x.ORG/es/1", "http://example.org", "http://a.example.org/es/", "http://example.org/en/12", "http://notexample.org/en/12",
        "http://example.com/fr/", "http://com/de/x", "ftp://x.net/FR/?a://b", "http://x.net/a/ads/b", "http://free-bets.net/", "http://x.net/about/ads/",
        "http://blog.u.example.net/en/1?utm_source=feed", "http://x.net/aZZZb", "http://x.net/" + "a/" * 5_000, "http://x.net?ü#/ads/", "http://x.net/\u212a/ads/",
    ]
    df = spark.createDataFrame([(i, u, "h", "t", 1) for i, u in enumerate(urls)] + [(None, urls[4], "h", "t", 1)] * 2, "page_id long, url string, host string, token string, rule_id int")
    got = urlrules.judge(df, wildcard_rules=wild).collect()
    assert len(got) == len(urls) + 2

    def brute(url):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        tail = rest[len(host) :]
        low = "".join(c.lower() if c.isascii() else c for c in rest)
        host, path = low[: len(host)], re.match(r"[^?#]*", tail)[0]
        fit = [r for r in urlrules.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.name), default=None)
        other = [r for r in wild if re.search(r.regex, low)]
        pattern = max(other, key=lambda r: (r.action == "allow", len(r.name), r.name), default=None)
        return host, path, rule and rule.name, rule.action if rule else pattern.action if pattern else "allow", None if rule or not pattern else pattern.name

    for r in got:
        assert tuple(r)[1:] == brute(urls[4] if r["page_id"] is None else urls[r["page_id"]]), r
    assert urlrules.judge(df.where("false")).count() == 0


def test_whole_tokens():
    assert urlrules.whole_tokens(".example.org/en/1") == ["example", "org", "en"]
    assert urlrules.WildcardRule("block", "?*utm_source=feed").tokens == ["source"]


# --- shards ---------------------------------------------------------------------------------------


def test_shards(spark):
    rows = [(i % 50, f"t{i % 7}" if i % 9 else None) for i in range(300)] + [(None, "")] * 30 + [(7, "x" * 100_000)] * 40
    got = sharding.assign(docs(spark, rows).repartition(5), 40).collect()
    n = len(rows)
    assert len(got) == n and {(r["shard"], r["slot"]) for r in got} == {(p % 40, p // 40) for p in range(n)}
    assert sorted(r["row"] for r in got) == list(range(n))
    for r in got:
        p = sharding.place(r["row"], n)
        assert (r["shard"], r["slot"]) == (p % 40, p // 40) and sharding.row_at(p, n) == r["row"]
    again = sharding.assign(docs(spark, rows).repartition(3), 40).collect()
    key = lambda x: sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["row"], r["shard"]) for r in x)
    assert key(got) == key(again)
    assert sharding.assign(docs(spark, []), 40).count() == 0
    assert [r["shard"] for r in sharding.assign(docs(spark, [(1, None)]), 40).collect()] == [0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1_000, 1_009])
def test_permutation(n):
    assert sorted(sharding.place(i, n, 5) for i in range(n)) == list(range(n))


# --- near duplicates ------------------------------------------------------------------------------


def brute_classes(rows):
    def shingles(text):
        w = (text or "").lower().encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    at = {t: k for k, t in enumerate(texts)}
    ids = {}
    for i, t in rows:
        if i is not None:
            ids[group[at[t or ""]]] = min(i, ids.get(group[at[t or ""]], i))
    return sorted(((i, ids.get(group[at[t or ""]]), sum((u or "") == (t or "") for _, u in rows), links[at[t or ""]]) for i, t in rows), key=repr)


def near_texts():
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefgh"), r.integers(2, 7)))
    base = [[word() for _ in range(r.integers(30, 120))] for _ in range(12)]
    out = [None, "", " \n ", "a", "a b", "a b c d e", "A B C D E", "  a b c d e", "x " * 3_000]
    for b in base:
        for _ in range(r.integers(1, 9)):
            copy = list(b)
            for _ in range(r.integers(0, 6)):
                copy[r.integers(0, len(copy))] = word()
            out.append(" ".join(copy))
    big = base[0] * 2
    for k in range(70):  # a group of near copies that is cut into blocks
        copy = list(big)
        copy[r.integers(0, len(copy))] = f"n{k}"
        out.append(" ".join(copy))
    return [(int(i), t) for i, t in enumerate(out)] + [(500 + i, out[i]) for i in range(0, len(out), 3)] + [(None, out[20]), (None, "only null id here at all"), (3, out[3])]


def test_near_duplicates(spark, monkeypatch):
    rows = near_texts()
    want = brute_classes(rows)
    assert sorted(map(tuple, neardup.near_duplicates(docs(spark, rows)).collect()), key=repr) == want
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(neardup, "GROUP_BLOCK", 10)
    assert sorted(map(tuple, neardup.near_duplicates(docs(spark, rows)).collect()), key=repr) == want
    kept = neardup.keep_one(docs(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs(spark, []).columns
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c, _, _ in want if c is not None}) and ids.count(None) == 1
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_posterior():
    needed = neardup.fewest_matches(0.8, 1e-6)
    assert [n for n, _ in needed] == list(range(16, 97, 16)) and all(0 < m < 0.8 * n for n, m in needed)
    r = np.random.default_rng(5)
    signs = r.integers(0, 256, (2, neardup.HASHES)).astype(np.uint8)
    signs[1, : neardup.HASHES * 8 // 10] = signs[0, : neardup.HASHES * 8 // 10]
    assert len(neardup.surviving(signs, np.array([0]), np.array([1]), needed)[0]) == 1


@pytest.mark.parametrize("words", [500, 1_000, 3_000])
@pytest.mark.parametrize("shared, kept", [(0.0, 0.0), (0.4, 0.02), (0.85, 0.97)])
def test_pruning_of_long_texts(words, shared, kept):
    """Unlike long texts go before verification, alike ones stay; ``shared`` is the similarity of the shingle sets."""
    needed = neardup.fewest_matches(0.8, 1e-6)
    r = np.random.default_rng(words)
    shingles, stay = neardup.Shingles(), 0
    same = round(2 * words * shared / (1 + shared))
    for _ in range(60):
        common = [f"w{x}" for x in r.integers(0, 10**9, same)]
        texts = [" ".join(common + [f"v{x}" for x in r.integers(0, 10**9, words - same)]) for _ in range(2)]
        low = [neardup.minhash(shingles.of(t)) for t in texts]
        signs = np.stack([(m & np.uint32(0xFF)).astype(np.uint8) for m in low])
        stay += len(neardup.surviving(signs, np.array([0]), np.array([1]), needed)[0])
    assert stay <= 60 * kept if shared < 0.8 else stay >= 60 * kept


# --- neighbours -----------------------------------------------------------------------------------


def test_neighbours(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(900, 8)).astype("float32")
    v[100:160] = v[100]  # ties
    rows = [(i, [float(x) for x in v[i]], "q", 1) for i in range(900)]
    bad = [(1_000, None, "q", 1), (1_020, [0.0] * 8, "q", 1), (1_040, [float("nan")] + [1.0] * 7, "q", 1), (1_060, [None] + [1.0] * 7, "q", 1), (None, [1.0] * 8, "q", 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, leaf string, rank int")
    got = nearest.search(df, df.where("vec_id % 20 = 0"), k=20, recall=1.0)
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for x in sorted(got.collect(), key=lambda x: (x["query_id"], x["rank"])):
        found.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert found.keys() == set(range(0, 900, 20))
    hits = 0
    for q, have in found.items():
        score = (v.astype(float) * v[q].astype(float)).sum(1)
        score[q] = -np.inf
        order = np.lexsort((np.arange(900), -score))[:20]
        hits += len({i for i, _ in have} & set(order.tolist()))
        assert have == sorted(have, key=lambda x: (-x[1], x[0])) and len(have) == 20
        assert np.allclose([s for _, s in have], [score[i] for i, _ in have], rtol=0, atol=1e-12)
    assert hits >= 0.95 * 20 * len(found)
    few = df.where("vec_id < 3 or vec_id >= 1000")
    assert sorted((x["query_id"], x["rank"]) for x in nearest.search(few, few.where("vec_id = 0")).collect()) == [(0, 1), (0, 2)]
    assert nearest.search(df.where("false"), df).count() == 0
    assert nearest.search(df.where("vec_id < 0"), df.where("false")).columns == got.columns


def test_neighbours_in_blocks(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = sorted(map(tuple, nearest.search(df, df.where("vec_id % 20 = 0")).collect()))
    monkeypatch.setattr(nearest, "BLOCK", 8)
    assert sorted(map(tuple, nearest.search(df, df.where("vec_id % 20 = 0")).collect())) == whole


# --- lines ----------------------------------------------------------------------------------------


def brute_lines(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = [], {}
    for i in order:
        text = rows[i][1]
        if text is None:
            out[i] = (rows[i][0], None, 0, 0)
            continue
        kept, lines = [], text.split("\n")
        for line in lines:
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if not words or not any(5 * len(words & w) >= 4 * len(words | w) for w in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out[i] = (rows[i][0], "\n".join(kept), len(lines), len(lines) - len(kept))
    return sorted(out.values(), key=repr)


def line_texts():
    r = np.random.default_rng(7)
    word = lambda: "".join(r.choice(list("abcd"), r.integers(1, 6)))
    base = [[word() for _ in range(r.integers(1, 25))] for _ in range(40)]

    def line():
        b = list(base[r.integers(0, len(base))])
        for _ in range(r.integers(0, 3)):
            b[r.integers(0, len(b))] = word()
        return " ".join(b)

    rows = [(int(i), "\n".join(line() for _ in range(r.integers(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, " \n\t\n "), (104, "a b c d e\nE D C\ne d c b a\na b c d e f"), (105, "z " * 20_000 + "\n" + "y"), (None, line()), (None, "null id line")]
    return rows + [(3, rows[3][1]), (7, rows[7][1])]


def test_line_dedup(spark):
    rows = line_texts()
    got = linededup.dedup_lines(docs(spark, rows).coalesce(1)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)
    back = linededup.without_repeated_lines(docs(spark, rows).coalesce(1))
    assert back.columns == docs(spark, []).columns
    assert sorted((x["doc_id"], x["text"]) for x in back.where("doc_id is not null").collect() if x["text"]) == sorted(x[:2] for x in brute_lines(rows) if x[0] is not None and x[1])
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_of_files_split_otherwise(spark, monkeypatch, tmp_path):
    """Rows keep their numbers when the files are cut into other partitions between two jobs."""
    rows = [x for x in line_texts()[:-2] if x[0] is not None]  # repeated ids take the order of the files
    path = str(tmp_path / "docs")
    docs(spark, rows).repartition(12).write.parquet(path)
    name, given = "spark.sql.files.maxPartitionBytes", linededup.cut
    before = spark.conf.get(name)

    def resized(df):
        out = given(df)
        spark.conf.set(name, "8k")
        return out

    monkeypatch.setattr(linededup, "cut", resized)
    try:
        for dedup in (linededup.dedup_lines, linededup.without_repeated_lines):
            spark.conf.set(name, before)
            got = dedup(spark.read.parquet(path), from_files=True).select("doc_id", "text").collect()
            assert sorted(map(tuple, got), key=repr) == [x[:2] for x in brute_lines(rows)]
    finally:
        spark.conf.set(name, before)


def test_line_dedup_of_lines_about_the_short_sketch(spark):
    """Lines around the length where the sketch changes, in spaces or other white space, meet whatever sketch either has."""
    r = np.random.default_rng(11)
    space = lambda: r.choice([" ", "  ", "\t", "\r", "\x0b ", "\x0c"], p=[0.9, 0.02, 0.02, 0.02, 0.02, 0.02])
    base = [[f"w{x}" for x in r.integers(0, 3_000, n)] for n in range(66, 100, 3)]

    def line():
        b = list(base[r.integers(0, len(base))])
        b = [w for w in b if r.random() > 0.08] + [f"v{x}" for x in r.integers(0, 3_000, r.integers(0, 12))]
        r.shuffle(b)
        return space() + "".join(w + space() for w in b)

    rows = [(int(i), "\n".join([line() for _ in range(4)] + ["", " \t"])) for i in range(40)]
    lengths = {len(set(x.split())) for _, t in rows for x in t.split("\n")}
    assert min(lengths - {0}) < 80 < max(lengths)
    got = linededup.dedup_lines(docs(spark, rows).coalesce(1))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(rows)
    # the lines that stay go straight to their rows: one join with those that go, one with the rows, none line by line
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_pipeline(spark):
    """Stage by stage against what each stage promises."""
    import corpus_pipeline
    from pathloom.llm import pii, quality

    given = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names = given.columns
    tables = [given]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF).cache())
    assert all(t.columns == names for t in tables[1:-1])
    good, lines, single, clean, packed = tables[1:]
    bands = quality.fit_bands(given, spark.read.parquet(f"{SF}/labels.parquet"))
    verdicts = {r["doc_id"] for r in quality.judged(given, bands=bands).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == verdicts
    rows = [(r["doc_id"], r["text"]) for r in good.orderBy("doc_id").collect()]
    assert sorted((r["doc_id"], r["text"]) for r in lines.collect()) == sorted(x[:2] for x in brute_lines(rows))
    classes = brute_classes([(r["doc_id"], r["text"]) for r in lines.collect()])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, c, _, _ in classes})
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()}
    assert all(not pii.base_spans(r["text"] or "") for r in clean.collect())
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in clean.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in clean.where(F.col("text").isNotNull()).collect())


def test_neighbours_among_copies(spark):
    """Most vectors are copies of one: every query still gets 20 rows, most of them right, and the same ones for any split."""
    r = np.random.default_rng(8)
    v = r.normal(size=(2_000, 8))
    v[:1_400] = v[0]
    rows = [(int(i), [float(x) for x in v[i]], "q", 1) for i in r.permutation(2_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string, rank int")
    asked = [i for i in range(0, 2_000, 20)]
    found = {}
    for some in (df.coalesce(1), df.repartition(7)):
        got = sorted((x["query_id"], x["rank"], x["vec_id"]) for x in nearest.search(some, some.where("vec_id % 20 = 0"), k=20).collect())
        assert found in ({}, got)
        found = got
    by_query = {q: [i for a, _, i in found if a == q] for q in asked}
    assert all(len(x) == 20 and q not in x for q, x in by_query.items())
    hits = 0
    for q, have in by_query.items():
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(set(have) & set(np.lexsort((np.arange(2_000), -score))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(asked)
