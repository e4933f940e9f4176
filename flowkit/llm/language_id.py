"""Language identification with language-bitmask n-gram filters.

Training counts the n-grams of each language over all labelled documents. An n-gram belongs to a language when its share
of the language's n-grams reaches min_share. A bit-sliced Bloom filter keeps one bit per language in each of its slots:
the AND of an n-gram's slots gives all languages that contain it at once. Per document the bits are counted by language,
the counts are corrected for the filter's known false-positive rates, and the language with most of the document wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import checkpoint, text_of

#: Bytes of an n-gram, slots of the filter (a power of two), slots per n-gram, least share of a language's n-grams.
N, SLOT_BITS, HASHES, MIN_SHARE = 4, 20, 2, 1e-6
MAX_LANGUAGES = 64
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_RUN_BYTES = 1 << 20


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of lower-cased letter runs with one space around each, as numbers, and the number in each text."""
    flat = [f" {x} ".encode() if x else b"" for x in (_NOT_LETTERS.sub(" ", t.lower()).strip() for t in texts)]
    sizes = np.array([max(0, len(x) - N + 1) for x in flat], np.int64)
    raw = np.frombuffer(b"".join(flat), np.uint8)
    if not sizes.sum():
        return np.zeros(0, np.uint32), sizes
    codes = np.zeros(len(raw) - N + 1, np.uint32)
    for k in range(N):
        codes |= raw[k : len(raw) - N + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    lengths = np.array([len(x) for x in flat], np.int64)
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(len(codes) + N, bool)  # n-grams that would run into the next text
    for k in range(1, N):
        at = starts + lengths - k
        inside[at[at >= starts]] = False
    return codes[inside[: len(codes)]], sizes


def slots_of(codes: np.ndarray, slot_bits: int = SLOT_BITS, hashes: int = HASHES) -> list[np.ndarray]:
    wide = codes.astype(np.uint64) + np.uint64(1)
    return [((wide * np.uint64(m)) >> np.uint64(64 - slot_bits)).astype(np.int64) for m in _MULTIPLIERS[:hashes]]


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list]]:
    """Column lists of a few MB of text each; the last column is the text."""
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        at = size = 0
        for k, t in enumerate(columns[-1]):
            size += len(t)
            if size > _RUN_BYTES:
                yield [c[at : k + 1] for c in columns]
                at, size = k + 1, 0
        if at < b.num_rows:
            yield [c[at:] for c in columns]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for langs, texts in _runs(batches):
        for lang in sorted(set(langs)):
            codes, n = np.unique(grams([t for x, t in zip(langs, texts, strict=True) if x == lang])[0], return_counts=True)
            if len(codes):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


@dataclass(frozen=True)
class LanguageFilter:
    """languages in order of their bits; masks by slot; the false-positive rate of each language."""

    languages: tuple[str, ...]
    masks: np.ndarray
    rates: tuple[float, ...]


def fit(docs: DataFrame, min_share: float = MIN_SHARE, slot_bits: int = SLOT_BITS, hashes: int = HASHES) -> LanguageFilter:
    """Learn from all rows with text and lang. The driver receives the filter alone: at most 2**slot_bits slots.

    Rows without text or lang teach nothing. With no rows at all the filter knows no language. More than 64 languages are
    refused.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = checkpoint(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(sorted(totals, key=lambda x: (-totals[x], x)))  # ties go to the most common
    masks = np.zeros(1 << slot_bits, np.uint64)
    if not languages:
        return LanguageFilter((), masks, ())
    mask, least = F.lit(None).cast("long"), F.lit(None).cast("double")
    for k, x in enumerate(languages):
        mask = F.when(F.col("lang") == x, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(mask)
        least = F.when(F.col("lang") == x, F.lit(min_share * totals[x]).cast("double")).otherwise(least)

    def place(batches):
        for b in batches:
            codes = b.column("gram").to_numpy().astype(np.uint32)
            for s in slots_of(codes, slot_bits, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(s), b.column("mask")], names=["slot", "mask"])

    kept = counts.where(F.col("n") >= least).select("gram", mask.alias("mask"))
    filled = kept.mapInArrow(place, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks[filled["slot"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    rates = tuple(float((masks >> np.uint64(k) & np.uint64(1)).mean()) ** hashes for k in range(len(languages)))
    return LanguageFilter(languages, masks, rates)


def popcounts(model: LanguageFilter, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text and language the number of n-grams that the filter ascribes to it, and the number of n-grams."""
    codes, sizes = grams(texts)
    bits = len(model.masks).bit_length() - 1
    found = None
    for s in slots_of(codes, bits):
        found = model.masks[s] if found is None else found & model.masks[s]
    hits = np.zeros((len(texts), len(model.languages)), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(len(model.languages)):
            hits[full, k] = np.add.reduceat((found >> np.uint64(k) & np.uint64(1)).astype(np.int64), starts)
    return hits, sizes


def _decide(model: LanguageFilter, texts: list[str]) -> tuple[list, ...]:
    hits, sizes = popcounts(model, texts)
    rates = np.minimum(np.array(model.rates), 0.999)
    share = np.maximum(hits / np.maximum(sizes, 1)[:, None] - rates, 0) / (1 - rates)
    best = share.argmax(axis=1)
    whole = share.sum(axis=1)
    score = np.where(whole > 0, share.max(axis=1) / np.where(whole > 0, whole, 1), 1 / len(model.languages))
    letters = [any(map(str.isalpha, t)) for t in texts]
    named = [model.languages[b] if y else "und" for b, y in zip(best, letters, strict=True)]
    return named, np.where(letters, score, 0.0).tolist(), share.max(axis=1).tolist(), sizes.tolist()


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """All columns of docs and lang_pred, score, lang_share (part of the n-grams that the language explains) and n_grams.

    A text that is null or has no letter is "und" with score 0, and so is every text if no language was learned. Texts
    whose n-grams no language has take the first language with the score of a guess. The columns are replaced if docs
    has their names already.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**slot_bits masks at most

    @F.pandas_udf("lang_pred string, score double, lang_share double, n_grams long")
    def decide(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out: list[tuple] = []
        for (run,) in _runs([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]):
            out += zip(*_decide(m, run), strict=True) if m.languages else [("und", 0.0, 0.0, 0)] * len(run)
        return pd.DataFrame(out, columns=["lang_pred", "score", "lang_share", "n_grams"])

    named = "__language"
    rows = docs.withColumn(named, decide(text_of()))
    return rows.withColumns({x: F.col(f"{named}.{x}") for x in ("lang_pred", "score", "lang_share", "n_grams")}).drop(named)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: A document is rejected when no learned language explains LEAST_SHARE of its n-grams, of which it has LEAST_GRAMS.
LEAST_SHARE, LEAST_GRAMS = 0.2, 40


def accept(docs: DataFrame) -> DataFrame:
    """The rows whose text is in one of the languages learned from docs itself, with their columns.

    Texts that are null, have no letter, or are long enough to tell and in none of the languages are rejected.
    """
    rows = predict(docs, fit(docs))
    known = (F.col("lang_pred") != "und") & ((F.col("n_grams") < LEAST_GRAMS) | (F.col("lang_share") >= LEAST_SHARE))
    return rows.where(known).select(*docs.columns)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only rows that are not held out are learned from."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "lang_share", "n_grams")
