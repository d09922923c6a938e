"""Language identification by rank-order profiles of character n-grams.

A language's profile is the ranks of its ``PROFILE`` most frequent n-grams.  A document's most
frequent n-grams are compared with it by the out-of-place distance: the sum of the differences of
ranks, ``PROFILE`` for an n-gram that the profile lacks.  The nearest language wins.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import frugal
from .columns import packed, passing, unpacked

#: n-grams of 1 to LENGTH letters, within words that a space pads on both sides.
LENGTH, PROFILE = 3, 300
#: Expected number of labelled documents a language that profiles are learned from, whole texts each.
SAMPLE = 2000
#: More learned labels than this are no languages: ValueError.
MOST_LANGUAGES = 5000
UNDETERMINED = "und"
#: n-grams that a worker remembers between documents, and letters of the words it remembers.
REMEMBERED, LONG_WORD = 100_000, 40
PIECE = 1 << 20

_WORD, _GAP = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")


def word_counts(text: str) -> Counter:
    """Counts of lower-cased words, in pieces of about a million characters that end between words."""
    found, at = Counter(), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = m.end() if (m := _GAP.search(text, end)) else len(text)
        found.update(_WORD.findall(text[at:end].lower()))
        at = end
    return found


def grams(word: str, length: int = LENGTH) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in range(1, length + 1) for i in range(len(padded) - n + 1) if n > 1 or padded[i] != " "]


class Profiles:
    """Profiles by language: lists of n-grams, the most frequent first."""

    def __init__(self, profiles: dict[str, list[str]], size: int = PROFILE, length: int = LENGTH):
        self.profiles, self.languages, self.size, self.length = profiles, sorted(profiles), size, length
        self.known = {g: i for i, g in enumerate(sorted({g for p in profiles.values() for g in p}))}
        self.ranks = np.full((len(self.languages), len(self.known)), float(size))
        for i, name in enumerate(self.languages):
            for rank, g in enumerate(profiles[name][:size]):
                self.ranks[i, self.known[g]] = rank
        self._forget()

    def _forget(self) -> None:
        self.ids, self.words = dict(self.known), {}

    def _ids(self, word: str) -> bytes:
        """Ids of the word's n-grams, 4 bytes each."""
        ids = self.ids
        made = array("i", [ids.setdefault(g, len(ids)) for g in grams(word, self.length)]).tobytes()
        if len(word) <= LONG_WORD:
            self.words[word] = made
        return made

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language, and 1 less the mean share of the greatest distance; ties go to the first by name."""
        return self.measure(text)[:2]

    def measure(self, text: str | None) -> tuple[str, float, int]:
        """As ``predict``, and the number of distinct n-grams in the text, which scores fall with."""
        counted = word_counts(text) if text else {}
        if not any(c.isalpha() for w in counted for c in w):
            return UNDETERMINED, 0.0, 0
        if not self.languages:
            return UNDETERMINED, 0.0, 0
        if len(self.ids) > REMEMBERED or len(self.words) > REMEMBERED:
            self._forget()
        parts = [self.words[w] if w in self.words else self._ids(w) for w in counted]
        weights = np.repeat(np.fromiter(counted.values(), np.float64, len(parts)), [len(p) >> 2 for p in parts])
        counts = np.bincount(np.frombuffer(b"".join(parts), np.int32), weights, len(self.ids))
        seen = np.flatnonzero(counts)
        distinct = len(seen)
        if len(seen) > self.size:
            seen = seen[counts[seen] >= np.partition(counts[seen], -self.size)[-self.size]]
        own = counts[seen]
        rank = np.minimum(np.searchsorted(np.sort(-own), -own), self.size)  # equal counts share a rank
        inside = seen < len(self.known)
        known = self.ranks[:, seen[inside]]
        # what a profile lacks is as far as can be
        far = np.where(known < self.size, np.abs(known - rank[inside]), self.size).sum(axis=1) + self.size * float((~inside).sum())
        best = int(far.argmin())
        return self.languages[best], float(1 - far[best] / (self.size * len(seen))), distinct


def held_out(key: Column, part: int = 2, of: int = 4) -> Column:
    """Whether a key's CRC puts its row in the part that is not learned from; null keys: false."""
    return F.coalesce(F.crc32(key.cast("string")) % of == part, F.lit(False))


def fit(df: DataFrame, key: str, text: str, lang: str, sample: int = SAMPLE, size: int = PROFILE, length: int = LENGTH) -> Profiles:
    """Learns profiles from rows of ``df`` with a text and a label, about ``sample`` a language, chosen by the hash of the key.

    Only languages' profiles come to the driver: their number times ``size`` n-grams.  More than ``MOST_LANGUAGES`` labels are a ValueError.
    Of n-grams that are equally frequent the first by code point come first; rows without a text or label teach nothing; no rows, no profiles."""
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    counts = rows.groupBy("l").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    if not counts:
        return Profiles({}, size, length)
    share = F.create_map(*[F.lit(x) for name, n in counts for x in (name, float(sample) / n)])
    chosen = rows.where(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit("")), F.lit("fit")), 11) / F.lit(float(2**53)) < F.element_at(share, F.col("l")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in batches:
            for t, name in zip(b.column(0), b.column(1), strict=True):
                mine = found.setdefault(name.as_py(), Counter())
                for w, n in word_counts(t.as_py()).items():
                    for g in grams(w, length):
                        mine[g] += n
                if len(mine) > REMEMBERED:
                    yield from rows_of(found)
                    found = {}
        yield from rows_of(found)

    def rows_of(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for name, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["l", "g", "n"])

    counted = chosen.select("t", "l").mapInArrow(frugal(run), "l string, g string, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("l").orderBy(F.desc("n"), "g"))
    top: dict[str, list[str]] = {name: [] for name, _ in counts}
    for r in sorted(counted.withColumn("r", place).where(F.col("r") <= size).collect(), key=lambda r: r["r"]):
        top[r["l"]].append(r["g"])
    return Profiles({k: v for k, v in top.items() if v}, size, length)


def identify(df: DataFrame, text: str, profiles: Profiles, lang: str = "lang_pred", score: str = "score", keep: bool = False, distinct: str | None = None) -> DataFrame:
    """Replaces ``text``, or follows it if it is to ``keep``, by its predicted language and score (0 to 1).  No shuffle.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned.  The whole text counts, however long.
    Languages that are equally far: the first by name.  Repeated rows get equal results.  An empty table gives no rows.
    Other columns pass; those of the added names are replaced.  ``distinct``: a column for the number of distinct n-grams."""
    rest = passing(df, (text, lang, score, distinct))
    names, size, length = profiles.profiles, profiles.size, profiles.length
    out = ["row", *(["text"] if keep else []), "lang", "score", "distinct"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(names, size, length)
        for b in batches:
            made = [model.measure(t.as_py()) for t in b.column(1)]
            found = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: 2 if keep else 1], *found], out)

    rows = df.select(packed(rest), F.col(f"`{text}`").alias("text"))
    schema = rows.select(*out[:-3]).schema.add("lang", "string").add("score", "double").add("distinct", "long")
    added = [*([F.col("text").alias(text)] if keep else []), F.col("lang").alias(lang), F.col("score").alias(score), *([F.col("distinct").alias(distinct)] if distinct else [])]
    return unpacked(rows.mapInArrow(frugal(run), schema), rest, *added)
