"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps a score-ordered agenda of adjacent symbol pairs: the pair
whose union has the best score (leftmost on ties) is merged first, and the new
neighbours enter the agenda. A merge can only cross two characters that stand
side by side in some piece, so a text falls apart at word marks (no piece that
is accepted here holds one after another character) and at every other pair of
characters that no piece has; its ids are those of its parts in order. Words
and parts are kept in two tables of bounded size per task; what does not fit is
encoded again when it returns. New parts are checked against the sentencepiece
library, a batch at a time, and a difference is an error.

Edge cases: a null text is the empty one, which has the begin and end ids only;
texts of any length are encoded whole; rows may repeat; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidemark.llm.common import lean, small_batches

MARK = "▁"
#: Words and parts kept by a task at most, and the longest that enters a table.
TABLE_WORDS = 500_000
LONG_WORD = 64
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LEFT = (1 << 40) - 1


class Pieces:
    """A vocabulary with its merge order; encode() and decode() of texts."""

    def __init__(self, model_file: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        self.ids = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        best = sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True)
        place = {score: k for k, score in enumerate(best)}
        self.order = {p: place[sp.get_score(i)] for p, i in self.ids.items()}  # equal scores share a place: the leftmost pair goes first
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.touching = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word mark inside: words can't be encoded apart")
        if any(sp.is_unused(i) for i in range(size)):
            raise ValueError("unused pieces aren't supported")
        inside = set("".join(self.ids))
        self.guard = next(c for c in "\n\x01\x02\x03" if c not in inside)
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def merge(self, part: str) -> list[int]:
        """The ids of one normalized part, by the agenda of (place in merge order, left symbol)."""
        order, symbols, n = self.order, list(part), len(part)
        agenda = [(order[pair] << 40) | i for i in range(n - 1) if (pair := part[i : i + 2]) in order]
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & _LEFT
            right = after[left]
            if right >= n or not symbols[left]:
                continue
            union = symbols[left] + symbols[right]
            if order.get(union, -1) != entry >> 40:
                continue  # a side has been merged since
            symbols[left], symbols[right] = union, ""
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                if (k := order.get(union + symbols[nxt])) is not None:
                    heapq.heappush(agenda, (k << 40) | left)
            prev = before[left]
            if prev >= 0 and (k := order.get(symbols[prev] + union)) is not None:
                heapq.heappush(agenda, (k << 40) | prev)
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                out.extend([i] if i is not None else (self.bytes[b] for b in s.encode("utf-8", "replace")))
        return out

    def cut(self, word: str) -> list[str]:
        """The parts of a word: no piece has the two characters at a cut side by side."""
        out, start, touching = [], 0, self.touching
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in touching:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Packed ids of new parts, each checked against the library."""
        merged = [self.merge(p) for p in parts]
        # the library puts a mark before every text: a part that starts with one goes without, others behind a character that joins nothing
        asked = self.library.encode([p[1:] if p[0] == MARK else self.guard + p for p in parts], num_threads=1)
        skip = len(self.library.encode(self.guard))
        for part, ids, expected in zip(parts, merged, asked, strict=True):
            if part != MARK and ids != (expected if part[0] == MARK else expected[skip:]):
                raise ValueError(f"the library encodes {part!r} in another way")
        return {p: struct.pack(f"<{len(m)}I", *m) for p, m in zip(parts, merged, strict=True)}

    def look_up(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of words that the table lacks."""
        cuts = {w: self.cut(w) for w in words}
        known = self.parts
        new = self.learn(list({p for c in cuts.values() for p in c if p not in known}))
        found = {w: b"".join([known[p] if p in known else new[p] for p in c]) for w, c in cuts.items()}
        for table, fresh in ((known, new), (self.words, found)):
            for key, value in fresh.items():
                if len(table) >= TABLE_WORDS:
                    break
                if len(key) <= LONG_WORD:
                    table[key] = value
        return found

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with begin and end ids."""
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        split = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        found = self.look_up(set().union(*split).difference(self.words))
        words = self.words
        out = []
        for s in split:
            if any(w in found for w in s) if found else False:
                out.append(begin + b"".join([words[w] if w in words else found[w] for w in s]) + end)
            else:
                out.append(begin + b"".join(map(words.__getitem__, s)) + end)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(struct.unpack(f"<{len(p) // 4}I", p)) for p in self.encode_packed(texts)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The library's texts of these ids."""
        return self.library.decode(ids, num_threads=1)


_OPEN: dict[str, Pieces] = {}


def opened(model_file: str) -> Pieces:
    """One vocabulary and word table for all batches of a worker."""
    if model_file not in _OPEN:
        _OPEN[model_file] = Pieces(model_file)
    return _OPEN[model_file]


def _batches(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def tokenize(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (array<int>), decoded text; or, with digests_only, SHA-256 digests of the packed ids and of the decoded text in place of both."""
    source = small_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    schema = source.select("doc_id").schema.add("n_tokens", "long")
    if digests_only:
        schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string")
    else:
        schema = schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = opened(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _batches(texts):
                packed = pieces.encode_packed(texts[a:b])
                counts = pa.array([len(p) // 4 for p in packed], pa.int64())
                ids = [array("I", p).tolist() for p in packed]
                decoded = pieces.decode(ids)
                if digests_only:
                    more = [pa.array([hashlib.sha256(p).hexdigest() for p in packed]), pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decoded])]
                else:
                    more = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), counts, *more], names=schema.names)

    return source.mapInArrow(lean(run), schema)
