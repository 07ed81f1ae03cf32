"""Language identification as inference of a mixture.

A text is a bag of letter trigrams, drawn from a mixture of the learned languages and of a uniform
background. The set of languages grows greedily: the language with the steepest gain in likelihood
joins, expectation-maximisation fits the proportions, and it stays if the likelihood rises by more
than the penalty. The likelihood is concave in the proportions, so the steepest gain bounds what
any language can add; most texts stop there without a fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.llm import vocab
from assaylens.llm.common import fresh

UNDETERMINED = "und"
FEATURES = 1 << 14  # trigram buckets
MOST_LANGUAGES = 500  # a model of 500 languages is 32 MB; more is an error
CHARS = 200_000  # characters worked on at once; longer texts are one piece
ROUNDS = 20  # of expectation-maximisation
PENALTY = 4.0  # for each language, times the log of the trigrams

MIXTURE = "lang_pred string, score double, background double, languages map<string,double>"


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages and the probability of each bucket; the last column is the background."""

    languages: tuple[str, ...]
    prob: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each trigram of letters; a run of other characters is one space."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 2 for t in lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each run of other characters only the first
    keep[np.cumsum(sizes) - sizes] = True
    codes, owner, letter = np.where(letter, codes, 32)[keep].astype(np.uint32), owner[keep], letter[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    middle = letter[1:-1]
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    bucket = (mixed >> np.uint32(18)).astype(np.int64) & (FEATURES - 1)
    return owner[1:-1][middle], bucket[middle]


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about CHARS characters, with the place of the first."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHARS:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    vocab.forget()
    sums: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, group in pdf.groupby("lang", sort=False):
            for _, texts in _pieces(group["text"].tolist()):
                total = sums.setdefault(lang, np.zeros(FEATURES, np.int64))
                total += np.bincount(trigrams(texts)[1], minlength=FEATURES)
    for lang, total in sums.items():
        found = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": found, "n": total[found]})


def learn(labelled: DataFrame) -> LanguageModel:
    """Fit on every row of ``labelled(text, lang)``; rows with a null in either teach nothing.

    Tasks count buckets and Spark sums the counts, so what reaches the driver is at most
    ``MOST_LANGUAGES * FEATURES`` numbers. Without a row the model has no language.
    """
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    counts = rows.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.limit(MOST_LANGUAGES * FEATURES + 1).toPandas()
    languages = tuple(sorted(got["lang"].unique()))
    if len(languages) > MOST_LANGUAGES or len(got) > MOST_LANGUAGES * FEATURES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    prob = np.full((FEATURES, len(languages) + 1), 0.5)
    place = {lang: i for i, lang in enumerate(languages)}
    prob[got["bucket"].to_numpy(np.int64), got["lang"].map(place).to_numpy(np.int64)] += got["n"].to_numpy(np.float64)
    prob[:, -1] = 1
    return LanguageModel(languages, (prob / prob.sum(axis=0)).astype(np.float32))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0) if len(starts) else np.zeros((0, *values.shape[1:]))


def infer(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages and the background in each text, and its number of trigrams."""
    width = len(model.languages) + 1
    shares, totals = np.zeros((len(texts), width)), np.zeros(len(texts), np.int64)
    if width == 1:
        return shares, totals
    owner, bucket = trigrams(texts)
    keys, count = np.unique(owner * FEATURES + bucket, return_counts=True)
    owner, bucket = keys // FEATURES, keys % FEATURES
    texts_in, starts = np.unique(owner, return_index=True)
    totals[texts_in] = _sums(count, starts)
    size = np.diff(np.append(starts, len(owner)))
    p = model.prob[bucket]
    fit = _sums(count[:, None] * np.log(p), starts)
    best = fit[:, :-1].argmax(axis=1)
    chosen = np.zeros((len(texts_in), width), bool)
    chosen[np.arange(len(texts_in)), best] = True
    weight, reached = chosen.astype(np.float64), fit[np.arange(len(texts_in)), best]
    n, open_ = totals[texts_in], np.arange(len(texts_in))
    penalty = PENALTY * np.log1p(n)
    for _ in range(width - 1):
        rows = np.repeat(np.isin(np.arange(len(texts_in)), open_), size)
        pp, c = p[rows], count[rows][:, None]
        inner = np.append(0, np.cumsum(size[open_])[:-1]) if len(open_) else np.zeros(0, np.int64)
        local = np.repeat(np.arange(len(open_)), size[open_])
        w = weight[open_]
        gain = _sums(c * pp / (pp * w[local]).sum(axis=1, keepdims=True), inner) - n[open_][:, None]
        gain[chosen[open_]] = -np.inf
        go = gain.max(axis=1, initial=-np.inf) > penalty[open_]
        if not go.any():
            break
        rows = np.repeat(go, size[open_])
        open_, pp, c = open_[go], pp[rows], c[rows]
        inner = np.append(0, np.cumsum(size[open_])[:-1])
        local = np.repeat(np.arange(len(open_)), size[open_])
        with_ = chosen[open_].copy()
        with_[np.arange(len(open_)), gain[go].argmax(axis=1)] = True
        w = np.where(with_, 0.8 * weight[open_] + 0.2 / with_.sum(axis=1, keepdims=True), 0)
        w /= w.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            part = pp * w[local]
            mixed = part.sum(axis=1, keepdims=True)
            w = _sums(c * part / mixed, inner) / n[open_][:, None]
        now = _sums(c[:, 0] * np.log((pp * w[local]).sum(axis=1)), inner)
        better = now - reached[open_] > penalty[open_]
        open_ = open_[better]
        chosen[open_], weight[open_], reached[open_] = with_[better], w[better], now[better]
        if not len(open_):
            break
    shares[texts_in] = weight
    return shares, totals


def mixture(text: Column, model: LanguageModel) -> Column:
    """Struct of MIXTURE for each text; see :func:`identify`."""

    @F.pandas_udf(MIXTURE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab.forget()
        names = np.array([*model.languages, UNDETERMINED], object)
        for series in batches:
            texts = ["" if t is None else t for t in series]
            shares = [infer(part, model)[0] for _, part in _pieces(texts)]
            shares = np.concatenate(shares) if shares else np.zeros((0, len(names)))
            known = shares[:, :-1]
            found = shares.sum(axis=1) > 0
            pick = np.where(found, known.argmax(axis=1) if known.shape[1] else 0, len(names) - 1)
            yield pd.DataFrame(
                {
                    "lang_pred": names[pick],
                    "score": np.where(found, known.max(axis=1, initial=0), 0.0).clip(0, 1),
                    "background": shares[:, -1].clip(0, 1),
                    "languages": [{names[j]: float(row[j]) for j in np.flatnonzero(row)} for row in known],
                }
            )

    return run(text)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", name: str = "_mixture") -> DataFrame:
    """*docs* with ``lang_pred, score, background, languages`` in the struct *name*.

    ``languages`` maps the languages of the text to their proportions, ``background`` is the
    proportion that no learned language explains, ``score`` the proportion of ``lang_pred``. A text
    that is null, empty or has no letter is ``und`` with score 0 and background 0, and so is every
    text under a model of no language. Texts are read whole, whatever their length; equal texts get
    equal answers; other columns, null or not, pass through untouched.
    """
    return docs.withColumn(name, mixture(F.col(text), model))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: a language is given, and the checksum of doc_id isn't a multiple of 5."""
    return docs.where("lang is not null and crc32(cast(doc_id as string)) % 5 <> 0")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_identified(docs: DataFrame, model: LanguageModel, most_background: float = 0.5) -> DataFrame:
    """Documents in a learned language: neither undetermined nor mostly background; same columns."""
    found = fresh(docs, "_mixture")
    rows = identify(docs, model, name=found)
    kept = rows.where((F.col(found)["lang_pred"] != UNDETERMINED) & (F.col(found)["background"] <= most_background))
    return kept.select(*docs.columns)
