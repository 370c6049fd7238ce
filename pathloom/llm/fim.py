"""Fill-in-middle transformation (11) by secondary-sort assembly.

A document leaves its text once, as pieces of at most ``CHUNK`` code points keyed by document and place in the
output. One shuffle with a sort inside each partition brings the pieces into output order; they stream into an
incremental digest, so no task holds an output. Reading that stream, the sentinels tell where a piece belongs in
the text; sorted again by that place, within the same partition, the pieces give the text back without a second
shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import small_batches

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Order of the parts in the output, by form: 0 prefix, 1 middle, 2 suffix, with the sentinel before each.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
SEED, FIM_PERCENT, SPM_PERCENT, CHUNK = 1, 90, 20, 8_192
#: Bytes of pieces in one batch on the way out of Python.
OUT_BYTES = 4 << 20

_PIECE = "__row long, __at long, __piece string"
_HEAD = "n long, form string, prefix_chars long, middle_chars long"


def planned(docs: DataFrame, doc_id: str, text: str, seed: int, fim_percent: int, spm_percent: int) -> DataFrame:
    """(id, text, n, form, prefix_chars, middle_chars): cut points and form follow from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)

    def group(i: int) -> Column:
        return F.conv(F.substring("__digest", 8 * i + 1, 8), 16, 10).cast("long")

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("__id"), body.alias("__text"), digest.alias("__digest"))
    rows = rows.withColumn("n", F.char_length("__text").cast("long"))
    first, second = group(0) % (F.col("n") + 1), group(1) % (F.col("n") + 1)
    marked = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("__text").contains(sentinel)
    plain = (F.col("n") == 0) | marked | (group(2) % 100 >= fim_percent)
    form = F.when(plain, "plain").when(group(3) % 100 < spm_percent, "spm").otherwise("psm")
    low, high = F.least(first, second), F.greatest(first, second)
    return rows.select(
        "__id", "__text", "n", form.alias("form"),
        F.when(~plain, low).alias("prefix_chars"), F.when(~plain, high - low).alias("middle_chars"),
    )


def cut_output(text: str, form: str, prefix: int | None, middle: int | None, chunk: int) -> Iterator[tuple[int, str]]:
    """(place in the output, piece) …; a sentinel leads the first piece of its part."""
    if form == "plain":
        for i in range(0, len(text), chunk):
            yield i, text[i : i + chunk]
        return
    borders = (0, prefix, prefix + middle, len(text))
    at = 0
    for sentinel, part in ORDERS[form]:
        start, end = borders[part], borders[part + 1]
        lead = sentinel
        while lead or start < end:
            piece = lead + text[start : min(end, start + chunk)]
            yield at, piece
            at += len(piece)
            start, lead = start + chunk, ""


class Reader:
    """Reads an output piece by piece and says where each stretch of it belongs: (part, place in the part, stretch).

    Pieces may be cut anywhere; what could be the beginning of the next sentinel waits for the next piece.
    """

    def __init__(self, form: str):
        self.ahead = list(ORDERS.get(form, ()))
        self.part = 0
        self.place, self.held = 0, ""

    def _placed(self, stretch: str) -> Iterator[tuple[int, int, str]]:
        if stretch:
            yield self.part, self.place, stretch
            self.place += len(stretch)

    def feed(self, piece: str) -> Iterator[tuple[int, int, str]]:
        piece = self.held + piece
        self.held = ""
        while self.ahead:
            sentinel, part = self.ahead[0]
            found = piece.find(sentinel)
            if found < 0:
                keep = next((k for k in range(len(sentinel) - 1, 0, -1) if piece.endswith(sentinel[:k])), 0)
                piece, self.held = piece[: len(piece) - keep], piece[len(piece) - keep :]
                break
            yield from self._placed(piece[:found])
            piece = piece[found + len(sentinel) :]
            self.part, self.place = part, 0
            self.ahead.pop(0)
        yield from self._placed(piece)

    def rest(self) -> Iterator[tuple[int, int, str]]:
        yield from self._placed(self.held)


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], piece: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; ``piece`` is the column whose length counts."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    for row in rows:
        held.append(row)
        size += 64 + len(row[piece] or "")
        if size >= OUT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _fields(docs: DataFrame, doc_id: str) -> tuple[str, list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    return f"__id {kind.simpleString()}, {_HEAD}", [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    chunk: int = CHUNK,
) -> DataFrame:
    """The outputs in pieces, sorted within partitions by (__row, __at): one row at place -1 with id, n, form and cuts, then the text.

    ``__row`` numbers the rows by partition and place there, so repeated rows and ids stay apart and no key is hot.
    """
    small_batches(docs.sparkSession)
    head, head_types = _fields(docs, doc_id)
    rows = planned(docs, doc_id, text, seed, fim_percent, spm_percent)
    rows = rows.select(F.monotonically_increasing_id().alias("__row"), "*")
    names = ["__row", "__at", "__piece", *(f.split()[0] for f in head.split(", "))]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for batch in batches:
                for row, who, body, n, form, prefix, middle in zip(*(c.to_pylist() for c in batch.columns)):
                    yield row, -1, None, who, n, form, prefix, middle
                    for at, piece in cut_output(body, form, prefix, middle, chunk):
                        yield row, at, piece, None, None, None, None, None

        return _batches(out(), [pa.int64(), pa.int64(), pa.string(), *head_types], names, 2)

    return rows.mapInArrow(emit, f"{_PIECE}, {head}").repartition("__row").sortWithinPartitions("__row", "__at")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of all batches."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", output: str = "output", **rule) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): every document's output, put together from its sorted pieces.

    A task holds one output. Rules and cases as in ``digests``.
    """
    head, head_types = _fields(docs, doc_id)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            about, held = None, []
            for _, at, piece, *row in _read(batches):
                if at < 0:
                    if about is not None:
                        yield *about, "".join(held)
                    about, held = row, []
                else:
                    held.append(piece)
            if about is not None:
                yield *about, "".join(held)

        return _batches(out(), [*head_types, pa.string()], [*(f.split()[0] for f in head.split(", ")), "__output"], 5)

    done = pieces(docs, doc_id, text, **rule).mapInArrow(put_together, f"{head}, __output string")
    return done.withColumnsRenamed({"__id": doc_id, "__output": output})


def restore(outputs: DataFrame, output: str = "output", form: str = "form", text: str = "text") -> DataFrame:
    """The same rows with the text that each output was made from; other columns stay, one called like ``text`` is replaced."""
    small_batches(outputs.sparkSession)

    @F.pandas_udf("string")
    def back(forms, bodies):
        def one(kind: str, body: str | None) -> str | None:
            if body is None:
                return None
            reader = Reader(kind)
            return "".join(s for _, _, s in sorted([*reader.feed(body), *reader.rest()]))

        return forms.combine(bodies, one)

    return outputs.withColumn(text, back(F.col(form), F.col(output)))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), one row per row of ``docs``.

    Pieces stream through both digests, so a task holds one piece at a time, however long the text. A null or empty text is
    plain and empty; so are texts that hold a sentinel plain, as they are. A null id counts as an empty one. Repeated rows
    give repeated rows, an empty table none; other columns play no part. The number of a row follows from its file
    and place, so ``docs`` should be a table (or cut), not the outcome of a shuffle that may deal rows anew.
    """
    head, head_types = _fields(docs, doc_id)
    head_names = [f.split()[0] for f in head.split(", ")]

    def to_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pieces go on with their place in the text; the head follows its document's pieces, with the digest of the output
        def out():
            about, row, digest, reader = None, None, None, None

            def end():
                yield from ((row, *s, *none) for s in reader.rest())
                yield row, -1, 0, None, digest.hexdigest(), *about

            none = (None,) * (1 + len(head_names))
            for number, at, piece, *rest in _read(batches):
                if at < 0:
                    if about is not None:
                        yield from end()
                    about, row, digest, reader = rest, number, hashlib.sha256(), Reader(rest[2])
                else:
                    digest.update(piece.encode())
                    for placed in reader.feed(piece):
                        yield row, *placed, *none
            if about is not None:
                yield from end()

        types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), *head_types]
        return _batches(out(), types, ["__row", "__part", "__at", "__piece", "output_sha256", *head_names], 3)

    def to_restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            about, digest = None, None
            for _, part, _, piece, *rest in _read(batches):
                if part < 0:
                    if about is not None:
                        yield *about[1:], about[0], digest.hexdigest()
                    about, digest = rest, hashlib.sha256()
                else:
                    digest.update(piece.encode())
            if about is not None:
                yield *about[1:], about[0], digest.hexdigest()

        return _batches(out(), [*head_types, pa.string(), pa.string()], [*head_names, "output_sha256", "restored_sha256"], 5)

    first = pieces(docs, doc_id, text, **rule).mapInArrow(
        to_digest, f"__row long, __part int, __at long, __piece string, output_sha256 string, {head}"
    )
    again = first.sortWithinPartitions("__row", "__part", "__at")
    return again.mapInArrow(to_restored, f"{head}, output_sha256 string, restored_sha256 string").withColumnRenamed("__id", doc_id)
