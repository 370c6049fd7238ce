"""Packing (7): documents into sequences of equal length and about equal cost.

A document of n tokens costs ``linear * n + quadratic * n²`` (attention looks inside a document only). In groups of about two
million tokens, documents go in descending order to the cheapest sequence that has room for them; a group has as
few sequences as its tokens need, and a document that fits nowhere is cut. Full groups are packed in the task that
reads their documents. What remains of every task meets in a shuffle and is packed the same way, so padding does
not depend on how finely the input is split.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathloom.llm.bpe import byte_alphabet
from pathloom.llm.common import Recent, small_batches
from pathloom.session import cut

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4_096
#: Tokens that are packed together; bounds a task's memory.
GROUP_TOKENS = 1 << 21
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1 / 1_024
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_PLAIN = re.compile("[ -~\t-\rÀ-ÖØ-öø-ÿ]*")
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")


class Words:
    """Ids of texts, each distinct word encoded once.

    Texts of ASCII and Latin-1 letters are cut by the vocabulary's pattern here and their words go to the library's
    model. In others, white-space separated pieces go through the library whole: the vocabulary drops white space and
    neither joins nor looks across it.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.stand_in = str.maketrans({b: c for c, b in byte_alphabet().items()})
        self.words, self.pieces = Recent(), Recent()

    def _cut(self, text: str) -> tuple[bool, list]:
        if _PLAIN.fullmatch(text) and not any(t in text for t in self.special):
            return True, _PLAIN_WORDS.findall(text.lower())
        return False, text.encode().split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        out = []
        tokenize = self.tokenizer.model.tokenize
        for start in range(0, len(texts), 200):
            cuts = [self._cut(t) for t in texts[start : start + 200]]
            for w in self.words.missing({w for plain, ws in cuts if plain for w in ws}):
                letters = w if w.isascii() else w.encode().decode("latin-1").translate(self.stand_in)
                self.words.now[w] = array("I", [t.id for t in tokenize(letters)]).tobytes()
            for p in self.pieces.missing({p for plain, ps in cuts if not plain for p in ps}):
                self.pieces.now[p] = array("I", self.tokenizer.encode(p.decode(), add_special_tokens=False).ids).tobytes()
            word, piece = self.words.now.__getitem__, self.pieces.now.__getitem__
            out += [b"".join(map(word if plain else piece, ws)) for plain, ws in cuts]
        return out


@functools.lru_cache(maxsize=1)
def words(path: str) -> Words:
    """One per Python worker, which serves many tasks."""
    return Words(path)


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((document, start, length, sequence, offset) …, number of sequences) for one group."""
    pieces, sequences, rests = [], 0, []
    for doc, n in enumerate(lengths):
        for k in range(n // capacity):
            pieces.append((doc, k * capacity, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rests.append((doc, n - n % capacity, n % capacity))
    rests.sort(key=lambda x: (-x[2], x[0]))
    open_ = -(-sum(r[2] for r in rests) // capacity)
    room, cost = np.full(open_, capacity), np.zeros(open_)
    for doc, start, left in rests:
        while left:
            fits = room >= left
            at = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            take = min(left, int(room[at]))
            pieces.append((doc, start, take, sequences + at, capacity - int(room[at])))
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            start, left = start + take, left - take
    return pieces, sequences + open_


def pack(
    docs: DataFrame,
    path: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: where its document's ids lie in which sequence.

    Every id of every row lies in exactly one piece; a null or empty text is its end id alone. Repeated rows are
    documents of their own, equal lengths keep the order of reading, other columns play no part. An empty table
    gives no rows. A sequence has at most ``capacity`` tokens; all sequences of a group together leave less than
    ``capacity`` free, but for the last groups of the shuffle when there are few documents.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def rows(group: list[tuple], first: int, task: int, side: int) -> tuple[list[tuple], int]:
        placed, n = assign([len(ids) // 4 for _, ids in group], capacity, linear, quadratic)
        out = []
        for doc, start, length, sequence, offset in placed:
            who, ids = group[doc]
            crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
            out.append((who, start, length, crc, len(ids) // 4, ((2 * task + side) << 32) + first + sequence, offset))
        return out, first + n

    def flow(documents: Iterator[tuple], side: int) -> Iterator[tuple[list[tuple], list[tuple]]]:
        """Pieces of each full group; at the end the documents that make no full group."""
        task, first, group, held = TaskContext.get().partitionId(), 0, [], 0
        for who, ids in documents:
            group.append((who, ids))
            held += len(ids) // 4
            if held >= group_tokens:
                out, first = rows(group, first, task, side)
                yield out, []
                group, held = [], 0
        if group and side:
            out, first = rows(group, first, task, side)
            yield out, []
        elif group:
            yield [], [(who, ids, task, i) for i, (who, ids) in enumerate(group)]

    columns = [doc_id, *(c.split()[0] for c in PIECE.split(", "))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents():
            for batch in batches:
                who, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for i in range(0, len(texts), 200):
                    yield from zip(who[i : i + 200], (x + end for x in words(path).encode(texts[i : i + 200])))

        for out, rest in flow(documents(), 0):
            full = [*out, *((r[0], None, None, None, None, None, None) for r in rest)]
            extra = [*((None, None, None) for _ in out), *(r[1:] for r in rest)]
            for i in range(0, len(full), 4096):
                some = [list(c) for c in zip(*full[i : i + 4096])] + [list(c) for c in zip(*extra[i : i + 4096])]
                yield batch_of(some, [*columns, "__ids", "__task", "__row"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a pool has about one group of tokens; sorted, since rows of a shuffle come in any order
        pool = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        pool.sort(key=lambda r: r[2:])
        for out, _ in flow((r[:2] for r in pool), 1):
            yield batch_of([list(c) for c in zip(*out)], columns)

    who_type = pa_type(docs, doc_id)

    def batch_of(values: list[list], names: list[str]) -> pa.RecordBatch:
        types = [who_type, *[pa.int64()] * 6, pa.binary(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

    pieces = f"`{doc_id}` {kind}, {PIECE}"
    first = cut(
        docs.select(F.col(doc_id), F.col(text).alias("__text")).mapInArrow(read, f"{pieces}, __ids binary, __task int, __row long")
    )
    rest = first.where(F.col("__ids").isNotNull()).select(doc_id, "__ids", "__task", "__row")
    tokens = rest.agg(F.sum(F.length("__ids")) / 4).first()[0] or 0
    pools = max(1, round(tokens / group_tokens))
    pooled = rest.repartition(pools, F.xxhash64("__task", "__row"))
    return first.where(F.col("__ids").isNull()).select(*columns).unionByName(pooled.mapInArrow(finish, pieces))


def pa_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
