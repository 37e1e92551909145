"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import Shared

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.1
CHUNK = 1 << 20
#: Most languages of a model; with BUCKETS it bounds what is broadcast (8 bytes a cell).
MAX_LANGUAGES = 1024


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two spaces."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of every n-gram of one order: a polynomial hash, mixed and cut to BUCKETS."""
    n = len(codes) - order + 1
    h = np.full(max(n, 0), np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF), np.uint32)
    for i in range(order):
        h = (h ^ codes[i : i + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(17)).astype(np.int64)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _pieces(codes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """All n-grams of a text of any length, in bounded pieces."""
    for i in range(0, max(1, len(codes) - order + 1), CHUNK):
        yield _buckets(codes[i : i + CHUNK + order - 1], order)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    for batch in batches:
        for lang, own in batch.groupby("lang", sort=False):
            total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            waiting, size = [], 0
            for text in own["_text"]:
                if not _has_letter(text):
                    continue
                documents[lang] = documents.get(lang, 0) + 1
                codes = _codes(text)
                for order in ORDERS:
                    for piece in _pieces(codes, order):
                        waiting.append(piece)
                        size += len(piece)
                if size > CHUNK:
                    total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                    waiting, size = [], 0
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
    for lang, total in counts.items():
        some = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": some, "n": total[some]})
        yield pd.DataFrame({"lang": [lang], "bucket": [-1], "n": [documents.get(lang, 0)]})


class LanguageModel:
    """Log probabilities of every bucket in each language, and log priors: at most MAX_LANGUAGES x BUCKETS numbers."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.weights = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T)
        self.priors = np.log((documents + 1) / (documents.sum() + len(languages)))


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", train: Column | None = None) -> LanguageModel:
    """Count n-grams of all rows with a language where ``train`` holds; whole texts, no sample.

    Each task adds up its rows in one array a language, and Spark adds up the tasks.  What reaches the driver is the
    model itself, bounded by languages x BUCKETS whatever the input.  Rows whose text is null or has no letter teach
    nothing; without any other row the model knows no language.
    """
    rows = docs.where(train) if train is not None else docs
    rows = rows.select(F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL AND _text IS NOT NULL")
    counted = rows.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    documents = counted.where("bucket = -1 AND n > 0").orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    languages = [r["lang"] for r in documents]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        table = counted.where("bucket >= 0").where(F.col("lang").isin(languages)).toPandas()
        counts[table["lang"].map(place).to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
    return LanguageModel(languages, counts, np.array([r["n"] for r in documents], float))


def _sums(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Log probability of each text in each language: sparse rows times the weight matrix."""
    out = np.zeros((len(texts), len(model.languages)))
    waiting, rows, size = [], [], 0

    def flush() -> None:
        lengths = np.array([len(x) for x in waiting], np.int64)
        some = lengths > 0
        if some.any():
            starts = (np.cumsum(lengths) - lengths)[some]
            np.add.at(out, np.array(rows)[some], np.add.reduceat(model.weights[np.concatenate(waiting)], starts, axis=0))
        waiting.clear()
        rows.clear()

    for i, text in enumerate(texts):
        codes = _codes(text)
        for order in ORDERS:
            for piece in _pieces(codes, order):
                waiting.append(piece)
                rows.append(i)
                size += len(piece)
        if size > CHUNK:
            flush()
            size = 0
    if waiting:
        flush()
    return out


def _predict(model: LanguageModel, texts: pd.Series) -> pd.DataFrame:
    lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    known = [i for i, text in enumerate(texts) if model.languages and _has_letter(text)]
    if known:
        logs = _sums(model, [texts.iat[i] for i in known]) + model.priors
        best = logs.argmax(axis=1)
        lang[known] = np.array(model.languages, object)[best]
        score[known] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    return pd.DataFrame({"lang": lang, "score": score})


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs``, with the language and its score in place of columns of those names.

    The score is the posterior probability of the language given, between 0 and 1.  A text that is null, empty or
    without a letter gets ``und`` and score 0, and so does every text where the model knows no language.  Of languages
    with equal probability the first by name is given.
    """
    out = _told(docs, model, text)
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    return out.select(*kept, F.col("_told.lang").alias(lang), F.col("_told.score").alias(score))


def _told(docs: DataFrame, model: LanguageModel, text: str) -> DataFrame:
    """Whole rows as one column, and what the model tells."""
    shared = Shared(docs.sparkSession, model)

    @F.pandas_udf("lang string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        return _predict(shared.value, texts)

    return docs.select(F.struct("*").alias("_row"), told(F.col(text).cast("string")).alias("_told"))


def known_languages(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose language the model tells with at least the given score, all columns unchanged."""
    told = _told(docs, model, text)
    return told.where((F.col("_told.lang") != UNKNOWN) & (F.col("_told.score") >= least)).select("_row.*")
