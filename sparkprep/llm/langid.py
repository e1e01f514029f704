"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (1 to ``SPECTRUM``, blended) that both have, whatever how
often, over the geometric mean of their numbers. Nyström landmarks (some labelled texts) give it a finite form: a text
is described by its kernels with the landmarks, and one-versus-rest kernel ridge regression is fitted on these. Scoring a
block of texts is two matrix products, of its n-gram presences with the landmarks' and of the kernels with the weights.

An n-gram is a number of ``BITS`` bits hashed from its lower-cased code points; everything that is no letter is a space.

The model is fitted on a bounded sample: ``SAMPLE`` labelled texts of each language with the smallest hashes, whole and
as two snippets each, the first ``LANDMARKS`` of them as landmarks. Only their n-grams reach the driver.

The best score says little on whether any learned language fits, as the scores of K languages add up to about 2 - K
whatever the text. A text fits its language when the landmarks of that language have enough of its n-grams: ``SLACK``
times what all but the lowest ``LOWEST`` of the labelled snippets have in landmarks other than their own text.

Defined cases: a null text and one without a letter are ``und`` with score 0, as is every text when there is nothing to
learn from; a row without doc_id is not held out and not learned from; a very long text is read in pieces that overlap,
so no n-gram is missed; equal texts get equal predictions; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import uniform

SPECTRUM = 3
BITS = 20
SAMPLE = 240
LANDMARKS = 40
SNIPPETS = (4, 12)
RIDGE = 1e-2
SLACK, LOWEST = 0.85, 0.01
SEED = 5
UNKNOWN = "und"
#: Code points and texts in a block.
PIECE = 1 << 19
ROWS = 128


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: the lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            table[c] = ord(low) if len(low := s.lower()) == 1 else c
    return table


def points(text: str) -> np.ndarray:
    return letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def grams(chars: np.ndarray) -> list[np.ndarray]:
    """For each length n the hashed n-gram that begins at each place."""
    out, now = [], np.zeros(len(chars), np.uint32)
    for n in range(SPECTRUM):
        now = now[: len(chars) - n] * np.uint32(0x01000193) + chars[n:] * np.uint32(0x9E3779B1) if len(chars) > n else now[:0]
        mixed = (now ^ (now >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        out.append(mixed >> np.uint32(32 - BITS))
    return out


def pieces(text: str) -> Iterator[str]:
    for at in range(0, max(1, len(text) - SPECTRUM + 1), PIECE):
        yield text[at : at + PIECE + SPECTRUM - 1]


def presence(text: str) -> np.ndarray:
    """The distinct n-grams of a text that has a letter; else none."""
    found, letter = [], False
    for piece in pieces(text):
        chars = points(piece)
        letter = letter or bool((chars != 32).any())
        found.append(np.unique(np.concatenate(grams(chars))))
    return np.unique(np.concatenate(found)).astype(np.uint32) if letter else np.zeros(0, np.uint32)


def sample(docs: DataFrame, key: str, text: str, lang: str, most: int) -> list[tuple[str, int, np.ndarray]]:
    """(language, place, n-grams) of up to ``most`` labelled texts of each language, and of their snippets."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("key").isNotNull() & ~held_out(F.col("key")) & F.col("lang").isNotNull())
    rows = rows.where(F.col("text").rlike(r"\p{L}")).select("lang", "text", uniform(SEED, F.col("key"), F.xxhash64("text")).alias("u"))
    # twice the share that gives the sample leaves few rows to rank, also of a language that has most of the corpus
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2 * most + 50) / n))])
    few = rows.where(F.col("u") < share[F.col("lang")])
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("u", F.xxhash64("text")))).where(F.col("place") <= most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lang, text, place in zip(*[c.to_pylist() for c in batch.columns]):
                words = text.split()
                at = place * 7919
                snippets = [" ".join(words[(a := at % max(1, len(words) - n + 1)) : a + n]) for n in SNIPPETS]
                out += [(lang, place + k * most, presence(t).tobytes()) for k, t in enumerate([text, *snippets])]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary()))], names=["lang", "place", "grams"])

    found = few.select("lang", "text", "place").mapInArrow(run, "lang string, place int, grams binary").collect()  # most * 3 rows for each language
    return sorted(((r["lang"], r["place"], np.frombuffer(r["grams"], np.uint32)) for r in found if len(r["grams"])), key=lambda r: r[:2])


class Model:
    """Languages, the landmarks' n-grams (``index`` by n-gram, ``marks`` by n-gram and landmark) and weights."""

    def __init__(self, rows: list[tuple[str, int, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE, most: int = SAMPLE):
        self.langs = sorted({lang for lang, _, _ in rows})
        if not rows:
            return
        chosen = [g for _, place, g in rows if place <= landmarks]
        known = np.unique(np.concatenate(chosen))
        self.index = np.full(1 << BITS, len(known), np.int32)
        self.index[known] = np.arange(len(known))
        self.marks = self._table(chosen).T.copy()
        self.marks /= np.sqrt(self.marks.sum(0))
        kernels = self._kernels(self._table([g for _, _, g in rows]))
        own = self._kernels(self._table(chosen))
        values, vectors = np.linalg.eigh(own.astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-6))
        features = np.column_stack([kernels @ root, np.ones(len(rows))])
        lang = np.array([self.langs.index(r[0]) for r in rows])
        goal = np.where(lang[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weight = (len(rows) / len(self.langs)) / np.bincount(lang, minlength=len(self.langs))[lang]
        left = features.T * weight
        solved = np.linalg.solve(left @ features + ridge * len(rows) / len(root) * np.eye(features.shape[1]), left @ goal)
        self.weights = (root @ solved[:-1]).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)
        self._set_floors(rows, landmarks, most)

    def _set_floors(self, rows: list[tuple[str, int, np.ndarray]], landmarks: int, most: int) -> None:
        """``own``: which n-grams a language's landmarks have (the last place is for unknown ones); ``floors``: see above."""
        self.own = np.zeros((len(self.langs), self.index.max() + 1), bool)
        self.floors = np.zeros(len(self.langs))
        for k, lang in enumerate(self.langs):
            mine = [((place - 1) % most, place, self.index[g]) for name, place, g in rows if name == lang]
            count = np.zeros(self.own.shape[1], np.int32)
            marks: dict[int, list[np.ndarray]] = {}
            for text, place, found in mine:
                if place <= landmarks:
                    count[found] += 1
                    marks.setdefault(text, []).append(found)
            count[-1] = 0
            self.own[k] = count > 0
            shares = []
            for text, place, found in [m for m in mine if m[1] > most] or mine:
                others = count.copy()
                for same in marks.get(text, []):
                    others[same] -= 1
                shares.append((others[found] > 0).mean())
            self.floors[k] = SLACK * np.quantile(shares, LOWEST)

    def _table(self, rows: list[np.ndarray]) -> np.ndarray:
        table = np.zeros((len(rows), self.index.max() + 1), np.float32)
        for row, found in zip(table, rows):
            row[self.index[found]] = 1
        return table[:, :-1]

    def _kernels(self, table: np.ndarray) -> np.ndarray:
        return (table @ self.marks) / np.sqrt(np.maximum(table.sum(1, keepdims=True), 1))

    def score(self, texts: list[str | None], fitting: bool = False) -> Iterator[tuple[str, float]]:
        """Language and score of each text, in order; if ``fitting``, a text that doesn't fit its language has none."""
        for at in range(0, len(texts), ROWS):
            yield from self._score_rows(texts[at : at + ROWS], fitting)

    def _score_rows(self, texts: list[str | None], fitting: bool = False) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        seen = np.zeros((len(texts), self.index.max() + 1), bool)
        letter = np.zeros(len(texts), bool)
        # places where an n-gram with a letter begins, and how many of them each language's landmarks know
        places, known = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)), np.int64)
        block: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            chars = points("".join(p for _, p in block))
            found = [self.index[g] for g in grams(chars)]
            some = [chars != 32]
            for n in range(1, SPECTRUM if fitting else 1):
                some.append(some[-1][: len(found[n])] | some[0][n:])
            at = 0
            for row, piece in block:
                end = at + len(piece)
                letter[row] |= bool((chars[at:end] != 32).any())
                for n, g in enumerate(found):
                    here = g[at : max(at, end - n)]
                    seen[row, here] = True
                    if fitting:
                        here = here[some[n][at : max(at, end - n)]]
                        places[row] += len(here)
                        known[row] += [np.count_nonzero(own[here]) for own in self.own]
                at = end
            block.clear()

        for row, text in enumerate(texts):
            for piece in pieces(text or ""):
                block.append((row, piece))
                size += len(piece)
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        scores = self._kernels(seen[:, :-1].astype(np.float32)) @ self.weights + self.bias
        best = scores.argmax(1)
        if fitting:
            letter &= known[np.arange(len(texts)), best] >= self.floors[best] * places
        top = np.clip((1 + scores[np.arange(len(texts)), best]) / 2, 0, 1)
        return [(self.langs[b], float(s)) if ok else (UNKNOWN, 0.0) for b, s, ok in zip(best, top, letter)]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    return Model(sample(docs, key, text, lang, most), landmarks, most=most)


def predict(docs: DataFrame, model: Model, text: str = "text", fitting: bool = False) -> DataFrame:
    """``docs`` with ``__lang_pred`` and ``__score``; if ``fitting``, ``und`` and 0 for texts that no learned language fits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    schema = T.StructType([*docs.schema.fields, T.StructField("__lang_pred", T.StringType()), T.StructField("__score", T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shared.value.score(batch.column(at).to_pylist(), fitting))
            pred, score = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "__lang_pred", "__score"])

    return docs.mapInArrow(run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """The query's digest: doc_id, held_out, lang_pred and score."""
    model = fit(docs)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))
