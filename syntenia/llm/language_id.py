"""Language ID by hyperdimensional profiles.

Every letter (and the gap between words) has a fixed random +-1 vector.  A
trigram's vector binds the first letter's, permuted twice, the second's, permuted
once, and the third's; a text's vector bundles (sums) those of its trigrams; a
language's prototype bundles its training texts.  A text gets the language whose
prototype has the greatest cosine to its vector.

Plan.  Training sends one partial prototype per task and language, summed by
position in the JVM; the prototypes (languages x DIMENSIONS) are all that is
broadcast.  Prediction is one scan.  Vectors of trigrams seen before are looked
up in a table of CACHE rows for each worker; beyond it they are bound anew.

Defined cases: a null text, an empty one and one without a letter give "und" with
score 0; so does every text if nothing could be learned; ties go to the
alphabetically first language; null langs do not train; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ragged import lone, tidy, trim

DIMENSIONS, CACHE, GAP = 1024, 20_000, 32
#: Trigrams of one text that are bound at once.
PART = 4096


class Profiler:
    """Text vectors of one worker."""

    def __init__(self, dimensions: int = DIMENSIONS, cache: int = CACHE):
        self.d, self.cache = dimensions, cache
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((cache, dimensions), np.int8)
        self.is_letter = np.zeros(0x110000, bool)
        self.is_letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            bits = np.random.Generator(np.random.PCG64([7919, code])).integers(0, 2, self.d, dtype=np.int8)
            v = self.letters[code] = bits * np.int8(2) - np.int8(1)
        return v

    def bind(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams and their counts; letters lower-cased, anything else is one gap."""
        code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = self.is_letter[code]
        if not letter.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        code = np.concatenate(([GAP], np.where(letter, code, GAP), [GAP]))
        code = code[np.concatenate(([True], (code[1:] != GAP) | (code[:-1] != GAP)))]
        return np.unique((code[:-2] << 42) | (code[1:-1] << 21) | code[2:], return_counts=True)

    def vector(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.d, np.float32)
        for at in range(0, len(keys), PART):
            known, weight = [], []
            for key, n in zip(keys[at : at + PART].tolist(), counts[at : at + PART].tolist(), strict=True):
                row = self.rows.get(key)
                if row is None:
                    if len(self.rows) == self.cache:
                        out += n * self.bind(key).astype(np.float32)
                        continue
                    row = self.rows[key] = len(self.rows)
                    self.vectors[row] = self.bind(key)
                known.append(row)
                weight.append(n)
            if known:
                out += np.asarray(weight, np.float32) @ self.vectors[known].astype(np.float32)
        return out


def profiler_of(dimensions: int) -> Profiler:
    """One profiler for each worker process, with the vectors it has bound (20 MB at most)."""
    return lone(("profiler", dimensions), lambda: Profiler(dimensions))


def _partial(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = profiler_of(dimensions)
        counts: dict[str, dict[int, int]] = {}
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, {})
                for key, n in zip(*(x.tolist() for x in profiler.trigrams(text)), strict=True):
                    own[key] = own.get(key, 0) + n
            for lang, own in counts.items():  # bundling is a sum: count first, bind each trigram once
                keys, n = np.fromiter(own, np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own))
                total = sums.setdefault(lang, np.zeros(dimensions))
                for at in range(0, len(keys), PART):
                    total += profiler.vector(keys[at : at + PART], n[at : at + PART]).astype(np.float64)
            counts.clear()
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([np.rint(total).astype(np.int64).tolist()], pa.list_(pa.int64()))], ["lang", "bundle"])

    return run


def prototypes(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from all rows with a lang."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    parts = rows.mapInArrow(tidy(_partial(dimensions)), "lang string, bundle array<long>")
    summed = parts.select("lang", F.posexplode("bundle").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in summed.filter("v <> 0").toLocalIterator():
        found.setdefault(r["lang"], np.zeros(dimensions))[r["at"]] = r["v"]
    langs = sorted(found)
    return langs, np.array([found[x] / np.linalg.norm(found[x]) for x in langs], np.float32).reshape(len(langs), dimensions)


def told(profiler: Profiler, langs: list[str], unit: np.ndarray, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Each text's language and score."""
    names, scores = [], []
    for text in texts:
        keys, n = profiler.trigrams(text)
        name, score = "und", 0.0
        if len(keys) and len(langs):
            v = profiler.vector(keys, n)
            cosine = unit @ v / max(float(np.linalg.norm(v)), 1e-30)
            best = int(np.argmax(cosine))
            name, score = langs[best], min(1.0, max(0.0, float(cosine[best])))
        names.append(name)
        scores.append(score)
    return names, scores


def _predict(langs: list[str], unit: np.ndarray, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = profiler_of(dimensions)
        for batch in batches:
            names, scores = told(profiler, langs, unit, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, *, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, lang_pred, score) for every row; ``train`` says which rows may be learned from (default: all)."""
    learn = docs if train is None else docs.filter(train)
    langs, unit = prototypes(learn, text_col=text_col, lang_col=lang_col, dimensions=dimensions)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_predict(langs, unit, dimensions)), f"id {dict(rows.dtypes)['id']}, lang_pred string, score double")


def keep_identified(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` less the rows whose text has no letter, or no similarity to any language that ``docs`` has.

    A row's own text decides, so ids may be null or repeat and other columns have any name; where nothing could be
    learned every row goes, and an empty table stays empty.
    """
    langs, unit = prototypes(docs, text_col=text_col, lang_col=lang_col, dimensions=dimensions)

    def known(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        profiler = profiler_of(dimensions)
        for column in columns:
            keep: list[bool] = []
            for at in range(0, len(column), 512):
                names, scores = told(profiler, langs, unit, column.slice(at, 512).to_pylist())
                keep += [name != "und" and score > 0 for name, score in zip(names, scores, strict=True)]
            yield pa.array(keep, pa.bool_())
        trim()

    return docs.filter(F.arrow_udf(known, "boolean")(docs[text_col]))
