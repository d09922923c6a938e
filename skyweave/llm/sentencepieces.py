"""Encoding and decoding with SentencePiece models as weighted finite-state transducers.

A model is compiled into three transducers: the normaliser (characters to characters), the pieces
(a trie whose paths end in an id), and the byte fallback (a character without a piece to the ids of
its bytes).  Their composition with an input is a lattice over its positions, and the encoding is
its shortest path in the tropical semiring, where weights add along a path.

* In a unigram model an arc weighs minus the piece's score.
* A BPE model ranks merges, not paths.  Its encodings are those whose neighbouring pieces are each the
  encoding of their own join, so a state is the last piece and an arc weighs 0, or infinity if
  merging would not leave this pair.  One path has a finite weight: the model's own encoding.

Pieces that hold no word end can't cross one, so a text is composed word by word, and workers
remember the paths of words.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import frugal
from .columns import packed, passing, unpacked

#: Fixed values of the model format: piece types, model types, the mark of white space, the text of an unknown piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
SPACE, UNKNOWN_TEXT = "▁", " ⁇ "
#: What a unigram model subtracts from its least score for a character without a piece.
UNKNOWN_PENALTY = 10.0
#: Entries of a worker's memory of words and of neighbours; characters of the words in it.
REMEMBERED, LONG_WORD = 250_000, 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message in the protocol buffers' wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= len(data):
                raise ValueError("no SentencePiece model")
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or (varint() if kind == 2 else -1)
        if n < 0 or at + n > len(data):
            raise ValueError("no SentencePiece model")
        yield tag >> 3, data[at : at + n]
        at += n


class Transducer:
    """A compiled model.  ``model``: the bytes of a model file; models with a character map aren't supported: ValueError."""

    def __init__(self, model: bytes):
        self.model = model
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unknown, self.prefix, self.squeeze, self.escape = UNIGRAM, False, 0, True, True, True
        for number, value in _fields(model):
            if number == 1:
                parts = dict(_fields(value))
                self.pieces.append((parts.get(1, b"").decode(), struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0, parts.get(3, NORMAL)))
            elif number == 2:
                parts = dict(_fields(value))
                self.kind, self.byte_fallback, self.unknown = parts.get(3, UNIGRAM), bool(parts.get(35, 0)), parts.get(40, 0)
            elif number == 3:
                parts = dict(_fields(value))
                self.prefix, self.squeeze, self.escape = bool(parts.get(3, 1)), bool(parts.get(4, 1)), bool(parts.get(5, 1))
                if parts.get(2):
                    raise ValueError("models with a character map are not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.scores = [s for _, s, _ in self.pieces]
        self.least = min((s for _, s, t in self.pieces if t == NORMAL), default=0.0)
        crosses = any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:], strict=False))
        self.word = re.compile("(?s).+" if crosses else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    @cached_property
    def trie(self) -> tuple:
        """Nodes: children by character, and the id of the piece that ends here, or -1."""
        root: list = [{}, -1]
        for p, i in self.ids.items():
            if self.kind == BPE and len(p) > 1 and self._merged(p) != [p]:
                continue  # merging never makes it
            node = root
            for c in p:
                node = node[0].setdefault(c, [{}, -1])
            node[1] = i
        return root

    def normalise(self, text: str) -> str:
        """White space: runs become one and ends go (if the model says so), a prefix comes, all of it is marked."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def _merged(self, text: str) -> list[str]:
        """What merging the best pair again and again, leftmost first among equals, makes of a text."""
        parts, after = list(text), list(range(1, len(text) + 1))
        before = list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(parts) and (i := self.ids.get(joined := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, joined))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, joined = heapq.heappop(heap)
            b = after[a] if parts[a] else len(parts)
            if b >= len(parts) or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b], after[a] = joined, "", after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [p for p in parts if p]

    def _stay(self, a: int, b: int) -> bool:
        """Whether merging leaves these neighbours apart: the arc's weight is 0, else infinite."""
        x, y = self.pieces[a][0], self.pieces[b][0]
        found = self.pairs[a << 32 | b] = self._merged(x + y) == [x, y]
        return found

    def _fallback(self, c: str) -> list[int]:
        if self.byte_fallback:
            return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def _path(self, word: str) -> list[int]:
        """Ids on the shortest path through the lattice of a word."""
        n = len(word)
        begin, last = [0] * (n + 1), [-2] * (n + 1)  # of the last piece on the best path to here: its begin and id; -1: a character without a piece, -2: no path
        last[0] = -1
        (self._unigram if self.kind == UNIGRAM else self._neighbours)(word, begin, last)
        out: list[int] = []
        while n:
            i, n = last[n], begin[n]
            out.extend(self._fallback(word[n])[::-1] if i < 0 else (i,))
        out.reverse()
        if not self.byte_fallback:
            out = [x for k, x in enumerate(out) if x != self.unknown or not k or out[k - 1] != x]
        return out

    def _unigram(self, word: str, begin: list[int], last: list[int]) -> None:
        n, scores, root = len(word), self.scores, self.trie
        best = [0.0, *[np.inf] * n]
        for at in range(n):
            node, end, alone = root, at, False
            while end < n and (node := node[0].get(word[end])) is not None:
                end += 1
                if (i := node[1]) >= 0:
                    alone |= end == at + 1
                    if (weight := best[at] - scores[i]) < best[end]:
                        best[end], begin[end], last[end] = weight, at, i
            if not alone and (weight := best[at] + UNKNOWN_PENALTY - self.least) < best[at + 1]:
                best[at + 1], begin[at + 1], last[at + 1] = weight, at, -1

    def _neighbours(self, word: str, begin: list[int], last: list[int]) -> None:
        """Weights are 0 or infinite, so the first path to the end is the shortest; arcs are tried longest first.

        A place is reached by one path of finite weight at most, so a place that leads nowhere is never tried again."""
        n, pairs, stay, root = len(word), self.pairs, self._stay, self.trie
        open_ = [True] * (n + 1)
        at, before, arcs, way = 0, -1, None, []
        while at < n:
            if arcs is None:
                node, end, arcs = root, at, []
                while end < n and (node := node[0].get(word[end])) is not None:
                    end += 1
                    if (i := node[1]) >= 0:
                        arcs.append((end, i))
                if not arcs or arcs[0][0] > at + 1:
                    arcs.insert(0, (at + 1, -1))
            while arcs:
                end, i = arcs.pop()
                if open_[end] and (before < 0 or i < 0 or (ok if (ok := pairs.get(before << 32 | i)) is not None else stay(before, i))):
                    begin[end], last[end] = at, i
                    way.append((at, before, arcs))
                    at, before, arcs = end, i, None
                    break
            else:
                open_[at] = False
                at, before, arcs = way.pop()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null or empty: none."""
        if not text:
            return np.zeros(0, np.int32)
        if len(self.words) > REMEMBERED:
            self.words = {}
        if len(self.pairs) > 4 * REMEMBERED:
            self.pairs = {}
        words, out = self.words, []
        for w in self.word.findall(self.normalise(text)):
            ids = words.get(w)
            if ids is None:
                ids = array("i", self._path(w)).tobytes()
                if len(w) <= LONG_WORD:
                    words[w] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    @cached_property
    def texts(self) -> list[bytes]:
        say = lambda p, t: bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else (UNKNOWN_TEXT if t == UNKNOWN else p.replace(SPACE, " ")).encode("utf-8", "surrogatepass")
        return [say(p, t) for p, _, t in self.pieces]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: runs of bytes as UTF-8 (a byte that fits nowhere: U+FFFD), control pieces as nothing."""
        table = self.texts
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def load(path: str) -> Transducer:
    """Reads a model file on the driver; operators send its bytes along."""
    with open(path, "rb") as f:
        return Transducer(f.read())


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    """Workers serve many tasks: they compile a model once, and keep what they remember of words."""
    return Transducer(model)


def encode(df: DataFrame, text: str, model: Transducer, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Replaces ``text`` by the array of its ids; null and empty texts have none.  No shuffle.

    Whole texts of any length; equal texts get equal ids.  Other columns pass; those of the added names are replaced.
    An empty table gives no rows.  ``decoded``: a further column, with the text that the ids decode to."""
    rest, data = passing(df, (text, ids, decoded)), model.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compiled(data)
        for b in batches:
            made = [own.encode(t.as_py()) for t in b.column(1)]
            offsets = np.cumsum([0, *[len(m) for m in made]])
            values = np.concatenate([*made, np.zeros(0, np.int32)])
            columns = [b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([own.decode(m) for m in made], pa.string())] if decoded else []), schema.names)

    rows = df.select(packed(rest), F.col(f"`{text}`").alias("text"))
    schema = rows.select("row").schema.add("ids", T.ArrayType(T.IntegerType()))
    schema = schema.add("decoded", "string") if decoded else schema
    return unpacked(rows.mapInArrow(frugal(run), schema), rest, F.col("ids").alias(ids), *([F.col("decoded").alias(decoded)] if decoded else []))


def decode(df: DataFrame, ids: str, model: Transducer, text: str = "text") -> DataFrame:
    """Adds ``text``, decoded from the array of ids; null ids: an empty text.  No shuffle.

    Other columns pass; one named ``text`` is replaced.  An empty table gives no rows."""
    rest, data = passing(df, (text,)), model.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compiled(data)
        for b in batches:
            made = [own.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], ["row", "text"])

    rows = df.select(packed(rest), F.col(f"`{ids}`").alias("ids"))
    return unpacked(rows.mapInArrow(frugal(run), rows.select("row").schema.add("text", "string")), rest, F.col("text").alias(text))
