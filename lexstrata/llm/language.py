"""Languages of documents and of their lines.

Method: error-correcting output codes. Each language has a codeword of 15 bits; for each bit one classifier over the
character n-grams of words predicts it. A line's margins are decoded by loss-weighted distance to the codewords; where two
codewords are nearly as close, the line is flagged as ambiguous. The classifiers are fitted by smoothed log odds on a
bounded sample of labelled documents (whole texts) in rounds: lines that one round gives another language than their label are left out
of the next, so wrong labels and foreign lines do no harm.

Scores belong to words, and a batch has far fewer distinct words than words: each distinct word is scored once and a line
adds up its words. Terms and short quotations in another language are outvoted by the sentences around them.

Defined results: lines end at a line feed, with or without a carriage return before it. Lines with few letters (figures,
record data) or no words have no language: they have no row or, if asked for, one with 'none' and confidence 0. Blank lines,
null and empty texts give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import tidy
from ..session import ship

LANGS = ("ru", "en", "de", "fr", "es", "pt", "uk", "bg")
#: Codes of ISO 639 and the English name of each language.
NAMES = {"ru": "ru rus russian", "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish", "pt": "pt por portuguese", "uk": "uk ukr ukrainian", "bg": "bg bul bulgarian"}
#: Frequent words, so that a language with few labelled rows is known too.
SEEDS = {
    "ru": "и в не на что с по как это из у от за для до или при если то так его все они была может также этого только были который которые между после",
    "en": "the of and to in a is that for it as was with be by on not this are or from at which but have an had they you were their been has would there when",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont aux avec ou son lui nous comme mais leur sans cette ses",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela",
    "uk": "і в не на що з до як це із у від за для або при якщо то так його всі вони була може також цього тільки були який які між після та є під час й",
    "bg": "и в не на че с по как това от за да или при ако то така го всички те беше може също този само бяха който които между след се са е като със във към ще",
}
BITS, DIMS = 15, 1 << 15
#: The sample that a model is fitted on: at most so many labelled documents for each language.
SAMPLE_DOCS = 250
MIN_CHARS = 60
#: A line with fewer letters than this share of its characters without white space, or fewer words, has no language.
LETTERS, WORDS = 0.5, 4
BATCH_CHARS = 2_000_000


def codewords() -> np.ndarray:
    """Rows of the 16 x 16 Hadamard matrix without its constant column: any two differ in 8 of 15 bits."""
    i = np.arange(16)
    parity = np.array([[bin(a & b).count("1") & 1 for b in i] for a in i])
    return np.where(parity[1 : len(LANGS) + 1, 1:] == 1, -1.0, 1.0).astype(np.float32)


def label_language(label: str | Column) -> Column:
    """The language that a label stands for, else null."""
    low = F.lower(tidy(label))
    low = F.regexp_replace(low, "^([a-z]{2,3})([-_][a-z0-9]{2,8})+$", "$1")
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(low.isin(names.split()), lang).otherwise(out)
    return out


def words_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets of each line's words, index of each word, distinct words): runs of letters in lower case."""
    low = pc.replace_substring_regex(pc.utf8_lower(pa.array(lines, pa.large_string())), r"[^\p{L}\p{M}]+", " ")
    split = pc.split_pattern(pc.utf8_trim(low, " "), " ")
    coded = split.values.dictionary_encode()
    return split.offsets.to_numpy(), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hashed n-gram) of the 1- to 4-grams of each word with its ends marked, and of the whole word."""
    cp = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32)
    lens = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    of = np.repeat(np.arange(len(words)), lens)
    owners, grams = [], []
    h = np.zeros(len(cp), np.uint32)
    for n in range(1, 5):
        # h holds the hash of the n - 1 characters from each place; the next one is mixed in.
        h = (h[: len(cp) - n + 1] ^ cp[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        same = of[: len(h)] == of[n - 1 :]
        owners.append(of[: len(h)][same])
        grams.append((h[same] + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(17))
        h = h.copy()
    start = np.cumsum(lens) - lens
    mixed = np.add.reduceat(cp * (np.arange(len(cp), dtype=np.uint32) - np.repeat(start, lens).astype(np.uint32) + np.uint32(7)) * np.uint32(0xC2B2AE35), start) if len(words) else np.zeros(0, np.uint32)
    owners.append(np.arange(len(words)))
    grams.append(((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x27D4EB2F) & np.uint32(0xFFFFFFFF)).astype(np.uint32) >> np.uint32(17))
    return np.concatenate(owners), np.concatenate(grams).astype(np.int64) & (DIMS - 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # DIMS x BITS
    scale: float  # margins are brought to about 1

    def word_margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, BITS), np.float32)
        owner, gram = ngrams(words)
        by = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[by], np.arange(len(words)))
        out = np.add.reduceat(self.weights[gram[by]], starts, axis=0)
        out[[i for i, w in enumerate(words) if not w]] = 0  # what a line without words is split into
        return out

    def margins(self, lines: list[str]) -> np.ndarray:
        """Mean margin of each bit over a line's words; zeros without words."""
        offsets, index, words = words_of(lines)
        table = self.word_margins(words)
        n = np.diff(offsets)
        out = np.zeros((len(lines), BITS), np.float32)
        some = np.flatnonzero(n > 0)
        if len(some):
            # Lines are many, distinct words few: sums are taken in runs to keep the gathered rows small.
            for a in range(0, len(some), 4096):
                part = some[a : a + 4096]
                lo, hi = offsets[part[0]], offsets[part[-1] + 1]
                out[part] = np.add.reduceat(table[index[lo:hi]], offsets[part] - lo, axis=0)
            out[some] /= n[some, None]
        return out * self.scale

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, confidence, ambiguous): logistic loss of the margins against each codeword, weighted by their size."""
        code = codewords()
        loss = np.logaddexp(0, -margins[:, None, :] * code[None]).sum(2)
        fit = np.exp(loss.min(1, keepdims=True) - loss)
        share = fit / fit.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = np.sort(share, 1)
        return best, top[:, -1], top[:, -2] > 0.5 * top[:, -1]


def _fit_once(lines: list[str], labels: np.ndarray, seed_weight: float) -> Model:
    code = codewords()
    offsets, index, words = words_of(lines + [s for s in SEEDS.values()])
    labels = np.append(labels, np.arange(len(LANGS)))
    weight = np.repeat(np.append(np.ones(len(lines)), np.full(len(LANGS), seed_weight)), np.diff(offsets))
    per_word = np.bincount(index * len(LANGS) + np.repeat(labels, np.diff(offsets)), weight, len(words) * len(LANGS)).reshape(len(words), -1)
    owner, gram = ngrams(words)
    # Every occurrence of a word counts by its square root: stock phrases don't drown the rest.
    per_word = np.sqrt(per_word)
    counts = np.stack([np.bincount(gram, per_word[owner, k], DIMS) for k in range(len(LANGS))])
    share = (counts + 0.02) / (counts + 0.02).sum(1, keepdims=True)  # each language weighs the same
    weights = np.zeros((DIMS, BITS), np.float32)
    for b in range(BITS):
        yes, no = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
        weights[:, b] = np.clip(np.log(yes / no), -4, 4)
    raw = Model(weights, 1.0)
    size = float(np.abs(raw.margins(lines or list(SEEDS.values()))).mean()) or 1.0
    return Model(weights, 2.0 / size)


def fit(lines: list[str], labels: list[int]) -> Model:
    """Frequent words alone judge first and take out lines that clearly aren't in the language of their label; the model
    of the rest judges all lines again, and those on which it agrees with the label make the final one."""
    y = np.array(labels, np.int64)
    model = _fit_once([], y[:0], 4.0)
    for strict in (False, True):
        if lines:
            best, _, unsure = model.decode(model.margins(lines))
            keep = (best == y) & ~unsure if strict else (best == y) | unsure
            model = _fit_once([x for x, k in zip(lines, keep) if k], y[keep], 4.0)
    return model


def _lines(text: str) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]


def _worded(lines: list[str]) -> np.ndarray:
    """Whether a line has enough letters and words for a language."""
    a = pa.array(lines, pa.large_string())
    dense = pc.replace_substring_regex(a, r"[\s\p{Z}]+", "")
    letters = pc.utf8_length(pc.replace_substring_regex(dense, r"[^\p{L}\p{M}]+", "")).to_numpy(zero_copy_only=False)
    words = pc.count_substring_regex(a, r"[\p{L}\p{M}]{2,}").to_numpy(zero_copy_only=False)
    return (letters >= LETTERS * pc.utf8_length(dense).to_numpy(zero_copy_only=False)) & (words >= WORDS)


def train(df: DataFrame, doc_id: str, text: str, label: str, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fitted on at most ``sample_docs`` documents for each language, taken by the least hash of their id: first the ids
    from the narrow columns, then the whole texts of these only. Rows of one id count as one document, with the least of
    its languages and texts, however many there are."""
    known = df.select(F.col(doc_id).alias("id"), label_language(label).alias("lang")).filter("lang is not null and id is not null").groupBy("id").agg(F.min("lang").alias("lang"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = known.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample_docs).select("id", "lang")
    ids = df.sparkSession.createDataFrame(picked.collect(), "id bigint, lang string")  # at most 8 * sample_docs rows
    texts = df.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).filter("t is not null")
    rows = texts.join(F.broadcast(ids), "id").groupBy("id", "lang").agg(F.min("t").alias("t")).select("t", "lang").collect()  # one row an id
    found = [(x, LANGS.index(lang)) for t, lang in sorted(map(tuple, rows)) for x in _lines(t) if len(x) >= 30]
    good = _worded([x for x, _ in found]) if found else []  # all lines at once: the patterns are costly to compile
    found = [pair for pair, ok in zip(found, good) if ok]
    return fit([x for x, _ in found], [y for _, y in found])


def line_languages(df: DataFrame, doc_id: str, text: str, model: Model, min_chars: int = MIN_CHARS, every: bool = False) -> DataFrame:
    """(doc_id, line_no, n_chars, lang, confidence, ambiguous) for each line of at least ``min_chars`` characters with a
    language, or with ``every`` for each such line that isn't blank. No shuffle."""
    ship(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("n_chars", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("ambiguous", pa.bool_())])
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.scale))  # of fixed size: DIMS x BITS
    names = np.array(LANGS, object)

    def judged(rows: list[tuple[int, int, str]], own: Model) -> pa.RecordBatch:
        lines = [x for _, _, x in rows]
        keep = np.flatnonzero(_worded(lines)) if lines else np.zeros(0, np.int64)
        best, share, unsure = own.decode(own.margins([lines[i] for i in keep])) if len(keep) else (keep, keep.astype(float), keep.astype(bool))
        tongues = names[best] if len(keep) else np.zeros(0, object)
        if every:
            told = dict(zip(keep.tolist(), range(len(keep))))
            keep = np.array([i for i, x in enumerate(lines) if i in told or x.strip()], np.int64)
            at = [told.get(i) for i in keep.tolist()]
            tongues = ["none" if k is None else tongues[k] for k in at]
            share, unsure = np.array([0.0 if k is None else share[k] for k in at]), np.array([k is not None and bool(unsure[k]) for k in at], bool)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in keep], pa.int64()), pa.array([rows[i][1] for i in keep], pa.int32()), pa.array([len(lines[i]) for i in keep], pa.int32()),
                pa.array(tongues, pa.string()), pa.array(np.round(share.astype(float), 6), pa.float64()), pa.array(unsure, pa.bool_()),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            rows: list[tuple[int, int, str]] = []
            size = 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, x in enumerate(_lines(t)):
                    if len(x) >= min_chars:
                        rows.append((i, k, x))
                        size += len(x)
                if size > BATCH_CHARS:
                    yield judged(rows, own)
                    rows, size = [], 0
            yield judged(rows, own)

    source = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t")).filter("t is not null and doc_id is not null").filter(F.length("t") >= min_chars)
    return source.mapInArrow(run, "doc_id bigint, line_no int, n_chars int, lang string, confidence double, ambiguous boolean")
