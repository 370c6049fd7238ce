"""BPE encoding and decoding (6) by a trie of distinct words.

The merges of a word's prefix are settled by one fact: the last token of its encoding. So the distinct words of
a batch form a trie, and a depth-first walk carries the last token of every prefix from node to node; a
prefix that many words share is encoded once. A token may end a prefix if it is a suffix of it and if it
stands next to the last token of what remains without a merge across the border; exactly one does.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathloom.llm.common import Recent, small_batches

VOCABULARY = "byte_bpe_50k.json"
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 is itself, the rest follows from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and the rule for neighbours of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("a plain byte-level BPE file is needed")
        letters = byte_alphabet()
        as_bytes = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.ids = {as_bytes[t]: i for t, i in model["vocab"].items()}
        self.special = {}
        for t in spec.get("added_tokens", []):
            if any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) or re.search(r"\s", t["content"]):
                raise ValueError(f"unsupported added token {t['content']!r}")
            self.special[t["content"]] = t["id"]
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pre = Tokenizer.from_file(path).pre_tokenizer

        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right = self.ids[as_bytes[a]], self.ids[as_bytes[b]]
            whole = self.ids[as_bytes[a] + as_bytes[b]]
            if any(self.parts[x][2] > r for x in (left, right) if x in self.parts):
                raise ValueError("a merge precedes its parts")
            self.rank[left, right] = r
            self.parts.setdefault(whole, (left, right, r))
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        # pairs of neighbours, left id above 20 bits of the right one
        self._fits: set[int] = set()
        self._apart: set[int] = set()
        self.usable: dict[bytes, int] = {}
        for b, i in sorted(self.ids.items(), key=lambda x: self.parts.get(x[1], (0, 0, -1))[2]):
            if len(b) == 1 or i in self.parts and self._forms(*self.parts[i]):
                self.usable[b] = i
        # every part of a token, with the tokens that end it, longest first; a part's own parts are parts too
        self.tails: dict[bytes, tuple[tuple[int, int], ...]] = {b"": ()}
        for tail in sorted({b[i:j] for b in self.usable for i in range(len(b)) for j in range(i + 1, len(b) + 1)}, key=len):
            own = ((len(tail), self.usable[tail]),) if tail in self.usable else ()
            self.tails[tail] = own + self.tails[tail[1:]]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at the token's left (0) or right (1) edge while it forms: (part, rank at which it is merged away)."""
        known = (self._left, self._right)[side]
        if token not in known:
            out, t, gone = [], token, NEVER
            while True:
                out.append((t, gone))
                if t not in self.parts:
                    break
                gone, t = self.parts[t][2], self.parts[t][side]
            known[token] = out
        return known[token]

    def _forms(self, left: int, right: int, rank: int) -> bool:
        """Whether the token's own bytes merge to it: its parts do, and nothing crosses their border earlier."""
        whole = [self.bytes_of[x] in self.usable for x in (left, right)]
        return all(whole) and not self._crossed(left, right, rank)

    def _crossed(self, left: int, right: int, before: int) -> bool:
        # parts meet if neither has been merged away; equal pairs merge from the left
        for a, a_gone in self.edge(left, 1):
            for b, b_gone in self.edge(right, 0):
                r = self.rank.get((a, b))
                if r is not None and r < before and r < a_gone and r <= b_gone:
                    return True
        return False

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens may follow one another."""
        pair = left << 20 | right
        if pair in self._fits:
            return True
        if pair in self._apart:
            return False
        if len(self._fits) + len(self._apart) > 2_000_000:
            self._fits.clear()
            self._apart.clear()
        ok = not self._crossed(left, right, NEVER)
        (self._fits if ok else self._apart).add(pair)
        return ok

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words, each shared prefix worked out once.

        Sorted words are the leaves of their trie in depth-first order, so only the branch to the current word is
        held: per prefix its last token, and the length of its longest suffix that lies within some token.
        """
        out, tails, fits, apart, size_of = {}, self.tails, self._fits, self._apart, self.bytes_of
        before, last, reach = b"", [-1], [0]
        for word in sorted(words):
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1 :], reach[same + 1 :]
            size = reach[-1]
            for n in range(same + 1, len(word) + 1):
                size += 1
                found = tails.get(word[n - size : n])
                while found is None:
                    size -= 1
                    found = tails.get(word[n - size : n])
                reach.append(size)
                for k, token in found:
                    if k == n:
                        break
                    pair = last[n - k] << 20 | token
                    if pair in fits:
                        break
                    if pair not in apart and self.fits(last[n - k], token):
                        break
                else:
                    raise AssertionError("no token ends the prefix")
                last.append(token)
            before, ids, k = word, [], len(word)
            while k:
                ids.append(last[k])
                k -= len(size_of[last[k]])
            out[word] = ids[::-1]
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker, which serves many tasks."""
    return Encoder(path)


_DOUBLE = re.compile(r"\s ")
_BORDER = re.compile(r"(?<=\S) ")


def pieces(text: str) -> list[str]:
    """Cut before single spaces that follow a non-space: no word of the vocabulary's pattern crosses there.

    The spaces cut away belong to the piece that follows.
    """
    return _BORDER.split(text) if _DOUBLE.search(text) else text.split(" ")


# pieces of these characters are cut by the vocabulary's own pattern; others by the tokenizers library
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[ -~\n{_LETTERS}]*")
_PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


class Encoder:
    """Encodes batches of texts; remembers pieces and words across batches."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.known, self.of_word = Recent(50_000), Recent(250_000)
        most = max(self.v.bytes_of) + 1
        self.bytes_of = [self.v.bytes_of.get(i, b"") for i in range(most)]
        self.decimal = [str(i).encode() for i in range(most)]

    def words(self, piece: str) -> list[tuple[str, int | None]]:
        """Words of a piece as the vocabulary's pattern cuts them, and special tokens with their ids."""
        if _PLAIN.fullmatch(piece) and not any(t in piece for t in self.v.special):
            return [(w, None) for w in _PLAIN_WORDS.findall(piece)]
        out = []
        for part in self.v.split_special.split(piece) if self.v.split_special else [piece]:
            if part in self.v.special:
                out.append((part, self.v.special[part]))
            elif part:
                out += [(part[i:j], None) for _, (i, j) in self.v.pre.pre_tokenize_str(part)]
        return out

    def learn_words(self, words: set[str]) -> None:
        new = {w.encode(): w for w in self.of_word.missing(words)}
        self.of_word.now.update((new[w], array("i", ids).tobytes()) for w, ids in self.v.encode_words(new).items())

    def learn(self, new: set[str]) -> None:
        cut = {p: self.words(p) for p in new}
        self.learn_words({w for ws in cut.values() for w, special in ws if special is None})
        of_word = self.of_word.now
        for p, ws in cut.items():
            self.known.now[p] = b"".join([array("i", [s]).tobytes() if s is not None else of_word[w] for w, s in ws])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for start in range(0, len(texts), 200):
            cut, plain = [], []
            for text in texts[start : start + 200]:
                if _PLAIN.fullmatch(text) and not any(t in text for t in self.v.special):
                    cut.append([])
                    plain.append(_PLAIN_WORDS.findall(text))
                else:
                    first, *rest = pieces(text)
                    cut.append([first, *(f" {p}" for p in rest)])
                    plain.append([])
            new = self.known.missing({p for ps in cut for p in ps})
            if new:
                self.learn(new)
            self.learn_words({w for ws in plain for w in ws})
            piece, word = self.known.now.__getitem__, self.of_word.now.__getitem__
            out += [np.frombuffer(b"".join([*map(piece, ps), *map(word, ws)]), "<i4") for ps, ws in zip(cut, plain)]
        return out


def round_trip(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, and decoded again from its ids, in one pass.

    The same as ``digests(decode(encode(docs)))``, but ids and decoded texts stay in the worker that hashes them. Null texts
    count as empty; rows as in ``encode``.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = encoder(path)
            bytes_of, decimal = coder.bytes_of.__getitem__, coder.decimal.__getitem__
            counts, of_ids, of_text = [], [], []
            texts = batch.column(1).to_pylist()
            for start in range(0, len(texts), 200):
                for ids in coder.encode([t or "" for t in texts[start : start + 200]]):
                    ids = ids.tolist()
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(b",".join(map(decimal, ids))).hexdigest())
                    decoded = b"".join(map(bytes_of, ids)).decode("utf-8", "replace")
                    of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).alias("__text")).mapInArrow(
        run, f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text; a null text counts as empty and has none.

    One pass without a shuffle. Equal to the tokenizers library without added special tokens; the strings of special
    tokens in a text become their ids, as there. Repeated rows give repeated rows, other columns play no part.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encoder(path).encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]).astype("int32")
            values = np.concatenate(ids) if ids else np.zeros(0, "int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [doc_id, "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).alias("__text")).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of every id list, special tokens included; bytes that are no UTF-8 become U+FFFD. Null ids give a null text."""
    path = path or public_tokenizers.path(VOCABULARY)
    small_batches(encoded.sparkSession)
    at = encoded.columns.index(ids)
    names = [*encoded.columns, decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        of = [v.bytes_of.get(i, b"") for i in range(max(v.bytes_of) + 1)]
        for batch in batches:
            texts = [
                None if x is None else b"".join([of[i] for i in x]).decode("utf-8", "replace")
                for x in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{fields}, `{decoded}` string")


def digests(decoded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Count and hashes of ids and decoded text, as the query returns them."""
    return decoded.select(
        doc_id,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
