"""Line dedup (10): an exact set-similarity join of lines, later matches removed.

A line is the set of its words. Words are ordered by rarity, so two lines of Jaccard similarity t share a word among the
first few of each: n - ⌈t·n⌉ + 1 of n. That word is the join key; length and position of it must allow the overlap,
and so must a parity sketch of both lines, of 128 bits where both are long, else of 64. What is left is verified on the whole sets.

No step emits the pairs of a group:

1. Equal lines become one before anything is joined.
2. A left semi join on the prefix words finds the lines that have any partner that passes the filters. It stops at a
   line's first partner.
3. Only those lines are compared: first with the earliest line of each of their prefix words, which settles nearly all
   lines of a group of copies; the few lines left then meet the earlier lines that share a prefix word.

Any one order of words gives the same result, the order only decides how much is compared. It comes from counts of all
words in a table of fixed size (by hash), so it is a literal of bounded size wherever the input goes. Words are compared by 54 bits
of their hash.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.session import cut

THRESHOLD = 0.8
#: Lines of at most so many words have a sketch of 64 bits.
SHORT = 80
#: Counters of words, and bits of the filter that fetches the words of candidate lines; both are fixed sizes.
COUNTERS, FILTER_BITS = 1 << 17, 1 << 21
HASH_BITS = 54
SPACES = r"[\x20\x09-\x0D]+"


def _table(values: np.ndarray) -> Column:
    """A table of fixed size as one constant; as text, since the gateway passes arrays value by value."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def _split(text: Column) -> Column:
    """The words of a line, perhaps with empty ones. Only lines with other white space than spaces need the regular expression."""
    return F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.split(text, SPACES)).otherwise(F.split(text, " "))


def _lines_of(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def _counter(word: Column | str) -> Column:
    return F.hash(word).bitwiseAND(F.lit(COUNTERS - 1))


def rarity(rows: DataFrame) -> np.ndarray:
    """Count class of every hash bucket of words: four classes per doubling. One count per word of the table, combined map-side."""
    words = _lines_of(rows).select(F.explode(_split(F.col("text"))).alias("w")).where("w != ''")
    counts = words.groupBy(_counter("w").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    seen = np.zeros(COUNTERS, "int64")
    found = counts.toPandas()
    seen[found["b"].to_numpy(dtype="int64")] = found["n"].to_numpy(dtype="int64")
    return np.floor(4 * np.log2(np.maximum(seen, 1))).astype("int32")


def _distinct_words(line: Column, classes: np.ndarray) -> Column:
    """The distinct words of a line as longs: class of the count, then hash."""
    table, low, none = _table(classes), F.lit((1 << HASH_BITS) - 1), F.lit(0).cast("long")

    def number(word: Column) -> Column:
        # never null, so that the numbers are kept and sorted as plain longs
        return F.shiftleft(F.coalesce(F.get(table, _counter(word)), none), HASH_BITS).bitwiseOR(F.xxhash64(word).bitwiseAND(low))

    # a separator at either end leaves an empty text, which is no word
    return F.array_remove(F.array_distinct(F.transform(_split(line), number)), number(F.lit("")))


def _lines(rows: DataFrame, classes: np.ndarray, t: Fraction) -> DataFrame:
    """One row per line: row, id, line, its words' number, identity, parity sketch and prefix. Blank lines have a null identity."""
    words = _lines_of(rows, "row", "id").select("row", "id", "line", F.sort_array(_distinct_words(F.col("text"), classes)).alias("words"))
    words = words.withColumn("n", F.size("words"))  # rarest words first
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(t.numerator) / F.lit(t.denominator) - 1e-9).cast("int") + 1

    def parity(one: Column, of: Column) -> Column:
        """Which of 64 bits an odd number of words hash to."""
        return F.aggregate(of, F.lit(0).cast("long"), lambda b, w: b.bitwiseXOR(F.call_function("shiftleft", one(w), w.bitwiseAND(F.lit(63)).cast("int"))))

    return words.select(
        "row", "id", "line", "n",
        F.when(F.col("n") > 0, F.xxhash64("n", "words")).alias("set"),
        parity(lambda w: F.lit(1).cast("long"), F.col("words")).alias("parity"),
        F.when(F.col("n") > SHORT, parity(lambda w: F.shiftright(w, 6).bitwiseAND(F.lit(1)), F.col("words"))).alias("odd"),
        # 32 bits of a word are enough for a key: a clash brings a candidate that verification drops
        F.transform(F.slice("words", 1, F.greatest(prefix, F.lit(1))), lambda w: F.hash(w)).alias("prefix"),
    )


def _may_match(l: str, r: str, t: Fraction) -> Column:
    """Length, position and sketch allow the pair: overlap o >= t/(1+t) · (n+m), difference <= (1-t)/(1+t) · (n+m)."""
    n, m = F.col(f"{l}.n").cast("long"), F.col(f"{r}.n").cast("long")
    most = F.least(n - F.col(f"{l}.at"), m - F.col(f"{r}.at"))
    odd, parity = (F.col(f"{l}.{c}").bitwiseXOR(F.col(f"{r}.{c}")) for c in ("odd", "parity"))
    # the even words of two long lines are what their odd ones leave of all
    differ = F.coalesce(F.bit_count(odd) + F.bit_count(parity.bitwiseXOR(odd)), F.bit_count(parity))
    p, q = t.numerator, t.denominator
    return (
        (n * q >= m * p) & (m * q >= n * p) & (most * (p + q) >= (n + m) * p) & (differ * (p + q) <= (n + m) * (q - p))
        & (F.col(f"{l}.set") != F.col(f"{r}.set"))
    )


def _entries(sets: DataFrame, *more: str) -> DataFrame:
    return sets.select("set", "n", "parity", "odd", *more, F.posexplode("prefix").alias("at", "key"))


def _matched(pairs: DataFrame, words: DataFrame, t: Fraction) -> DataFrame:
    """Later lines (``set``) of the pairs (set, other) whose whole sets reach the threshold."""
    both = (
        pairs.distinct()
        .join(words.select("set", F.col("words").alias("mine")), "set")
        .join(words.select(F.col("set").alias("other"), F.col("words").alias("theirs")), "other")
    )
    shared = F.size(F.array_intersect("mine", "theirs")).cast("long")
    union = F.size("mine") + F.size("theirs") - shared
    return both.where(shared * t.denominator >= union * t.numerator).select("set").distinct()


def _fetch(rows: DataFrame, wanted: DataFrame, classes: np.ndarray) -> DataFrame:
    """(set, words) of the wanted lines (set, row, line). A filter of fixed size keeps most other lines out of the shuffle."""
    bit = F.pmod(F.xxhash64("row", "line"), F.lit(FILTER_BITS))
    parts = wanted.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits")
    ).toPandas()
    table = np.zeros(FILTER_BITS // 64, "int64")
    table[parts["at"].to_numpy(dtype="int64")] = parts["bits"].to_numpy(dtype="int64")
    word = F.element_at(_table(table), F.shiftright(bit, 6).cast("int") + 1)
    there = F.call_function("shiftright", word, bit.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return _lines_of(rows, "row").where(there).join(wanted, ["row", "line"]).select("set", _distinct_words(F.col("text"), classes).alias("words"))


def _similar(rows: DataFrame, sets: DataFrame, classes: np.ndarray, t: Fraction) -> DataFrame:
    """(set): lines with an earlier line of enough similarity. ``sets``: set, first, n, parity, odd, prefix."""
    entries = _entries(sets)
    met = entries.alias("l").join(entries.alias("r"), (F.col("l.key") == F.col("r.key")) & _may_match("l", "r", t), "left_semi")
    some = cut(sets.join(met.select("set").distinct(), "set"))
    words = cut(_fetch(rows, some.select("set", "first.row", "first.line"), classes))
    own = _entries(some, "first")

    # lengths in classes of ratio 1/t, so that the earliest line of a word and class is likely alike
    length = F.floor(F.log(1 / float(t), F.col("n")) + 1e-9).alias("length")
    earliest = own.groupBy("key", length).agg(F.min(F.struct("first", "set", "n", "parity", "odd", "at")).alias("e"))
    earliest = earliest.select("key", "length", "e.*")
    pivoted = own.withColumn("length", length).alias("l").join(
        earliest.alias("r"),
        (F.col("l.key") == F.col("r.key")) & (F.col("l.length") == F.col("r.length")) & (F.col("r.first") < F.col("l.first")) & _may_match("l", "r", t),
    )
    done = cut(_matched(pivoted.select("l.set", F.col("r.set").alias("other")), words, t))
    left = own.join(done, "set", "left_anti")
    rest = left.alias("l").join(
        own.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("r.first") < F.col("l.first")) & _may_match("l", "r", t)
    )
    return done.unionByName(_matched(rest.select("l.set", F.col("r.set").alias("other")), words, t))


def _staying(rows: DataFrame, threshold: float) -> DataFrame:
    """(row, stay): the numbers of the lines that stay, per row of the table that keeps any."""
    t = Fraction(str(threshold))
    classes = rarity(rows)
    lines = cut(_lines(rows, classes, t))
    place = F.struct("id", "row", "line").alias("first")
    filled = lines.where(F.col("set").isNotNull())
    # the earliest of equal lines stands for them; counted before the shuffle
    alike = filled.groupBy("set").agg(F.min(F.struct(place, "n", "parity", "odd", "prefix")).alias("f")).select("set", "f.*")
    gone = cut(_similar(rows, alike, classes, t))
    first = filled.groupBy("set").agg(F.min(place).alias("first")).join(gone, "set", "left_anti").select("first.row", "first.line")
    stay = first.unionByName(lines.where(F.col("set").isNull()).select("row", "line"))
    return stay.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("stay"))


def _numbered(docs: DataFrame, columns: list[Column], from_files: bool) -> DataFrame:
    """``columns`` behind a number ``row`` that every later scan repeats, however the files are split by then.

    Rows of files are numbered by 31 bits of their file's name and their place in it; that is checked to be unique. Other rows,
    and files that the numbers do not tell apart, are numbered once and written.
    """
    if from_files:
        file, place = (docs.metadataColumn("_metadata")[f] for f in ("file_path", "row_index"))
        name = F.xxhash64(file).bitwiseAND(F.lit((1 << 31) - 1))
        names = docs.select(name.alias("name"), file.alias("file"), place.alias("place")).groupBy("name")
        seen = names.agg(F.min("file").alias("a"), F.max("file").alias("b"), F.max("place").alias("last"))
        if seen.where((F.col("a") != F.col("b")) | (F.col("last") >= 1 << 32)).isEmpty():
            return docs.select(F.shiftleft(name, 32).bitwiseOR(place).alias("row"), *columns)
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), *columns))


def dedup_lines(
    docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", from_files: bool = False
) -> DataFrame:
    """Every document without its repeated lines: (id, text, n_lines, n_removed), one row per row of ``docs``.

    A line goes if an earlier line, in the order of (id, place in the table, line), is the same set of words or reaches
    ``threshold``, whether that line stays or not. Blank lines have no words and always stay. Null texts stay null and have no lines;
    null ids come first. Repeated rows lose the lines that their first row has. Other columns play no part; an empty table gives no rows.

    ``from_files`` says that every row of ``docs`` is a row of a Parquet file, as ``spark.read.parquet`` gives it (columns may be
    left out): its place is then its file, by a hash of the name, and its number there. Other tables are written first.
    """
    rows = _numbered(docs, [docs[doc_id].alias("id"), docs[text].alias("text")], from_files)
    return _rebuilt(rows.join(_staying(rows, threshold), "row", "left")).select(F.col("id").alias(doc_id), F.col("text").alias(text), "n_lines", "n_removed")


def _rebuilt(rows: DataFrame) -> DataFrame:
    """Texts of the lines that stay. A text has one line at least; where none stays it is empty."""
    rows = rows.withColumns({"lines": F.split("text", "\n", -1), "stay": F.coalesce("stay", F.array().cast("array<int>"))})
    n, stays = F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long"), F.size("stay").cast("long")
    return rows.withColumns({
        "text": F.when(F.col("text").isNotNull(), F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n")),
        "n_lines": n,
        "n_removed": n - stays,
    })


def without_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", from_files: bool = False) -> DataFrame:
    """``docs`` with its texts deduplicated, all other columns as they were (``n_chars`` follows the text where there is one)."""
    # the text travels once, beside the other columns
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != text)).alias("whole")
    rows = _numbered(docs, [docs[doc_id].alias("id"), docs[text].alias("text"), whole], from_files)
    done = _rebuilt(rows.join(_staying(rows.select("row", "id", "text"), threshold), "row", "left"))
    new = {text: F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"whole.`{c}`") for c in docs.columns))
