"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary classifier over
hashed character n-grams (one to three letters, word boundaries included)
learns to tell the languages with that bit from the others.  A text's margins
are decoded by loss weighting: each bit's loss counts by how often that
classifier is right on that language, the codeword with the least loss wins,
and a text whose two best codewords are close is flagged as ambiguous.

The classifiers are fitted on at most ``rows_per_language`` labelled rows of
each language (the ones with the smallest hashed ids); every whole text is
judged.  Predictions see the text only.

Edge cases: a null text or one without a letter is ``und`` with score 0; null
labels and null ids are not learned from; a single learned language is
predicted with score 1; without any learned language every text is ``und``;
equal texts get equal results; very long texts are read in slices whose counts
add up; other columns are kept, ``lang_pred``, ``score`` and ``ambiguous`` are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import bounded_batches, lean

UND = "und"
HASH_BITS = 13
_SLICE = 1 << 18


class Model(NamedTuple):
    """Codewords (languages x bits, -1 or 1), bit classifiers and the weight of each bit's loss per language."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    biases: np.ndarray
    loss_weights: np.ndarray


def code_words(n: int, seed: int = 11) -> np.ndarray:
    """Codewords of ``n`` languages: all splits for few, else random ones far apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:  # every way to split the languages in two, once
        splits = np.arange(1, 2 ** (n - 1))
        return np.where(np.arange(n)[:, None] == 0, 1, 1 - 2 * (splits >> np.maximum(np.arange(n)[:, None] - 1, 0) & 1))
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, best_gap = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], size=(n, bits))
        agree = code @ code.T
        gap = min(((bits - agree) // 2)[~np.eye(n, dtype=bool)].min(), bits - np.abs(code.sum(axis=0)).max())
        if gap > best_gap:
            best, best_gap = code, gap
    return best


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of the lower-cased letters; None without a letter."""
    counts, letters = np.zeros(1 << HASH_BITS), False
    for lo in range(0, len(text), _SLICE):
        codes = np.frombuffer(text[lo:lo + _SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        letter = ((codes >= 97) & (codes <= 122)) | (codes >= 0xC0) | (codes == 0xAA) | (codes == 0xB5) | (codes == 0xBA)
        if not letter.any():
            continue
        beyond = letter & (codes >= 0x250)
        if beyond.any():  # outside the Latin blocks ask Unicode, once for each character
            kinds, place = np.unique(codes[beyond], return_inverse=True)
            letter[beyond] = np.array([chr(k).isalpha() for k in kinds.tolist()])[place]
        letter &= (codes != 0xD7) & (codes != 0xF7)
        if not letter.any():
            continue
        letters = True
        codes = np.where(letter, codes, np.uint32(32))
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = letter[1:] | letter[:-1]  # one space between words
        codes = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]]).astype(np.uint32)
        one = codes * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(0x85EBCA6B) + one[1:]
        three = two[:-1] * np.uint32(0xC2B2AE35) + one[2:]
        for h in (one, two, three):
            counts += np.bincount((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - HASH_BITS),
                                  minlength=len(counts))
    return counts if letters else None


def features(text: str | None) -> np.ndarray | None:
    """Damped counts of unit length."""
    counts = gram_counts(text) if text else None
    if counts is None:
        return None
    damped = np.sqrt(counts)
    return damped / np.sqrt((damped ** 2).sum())


def fit(x: np.ndarray, languages_of: list[str], rounds: int = 200, ridge: float = 1e-4) -> Model:
    """Logistic bit classifiers by accelerated gradient steps; a fifth of the rows weighs the losses."""
    languages = sorted(set(languages_of))
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((x.shape[1], 1)), np.zeros(1), np.ones((0, 1)))
    codes = code_words(len(languages)).astype(np.float64)
    y = codes[np.searchsorted(languages, languages_of)]
    each = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), dtype=bool)
    mean = x.mean(axis=0)

    def train(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, want = (x[rows] - mean).astype(np.float32), y[rows]
        share = (want > 0).mean(axis=0)
        balance = np.where(want > 0, 0.5 / np.maximum(share, 1e-9), 0.5 / np.maximum(1 - share, 1e-9)) / max(1, len(want))
        w = old = np.zeros((x.shape[1], codes.shape[1]), dtype=np.float32)
        b = old_b = np.zeros(codes.shape[1])
        step = 4.0 / max(1e-6, float((balance.max() * len(want)) * (own ** 2).sum(axis=1).max(initial=1e-6)))
        for i in range(rounds):
            ahead, ahead_b = w + (i / (i + 3)) * (w - old), b + (i / (i + 3)) * (b - old_b)
            pull = -want * balance / (1 + np.exp(np.clip(want * (own @ ahead + ahead_b), -30, 30)))
            old, old_b = w, b
            w = (ahead - step * (own.T @ pull.astype(np.float32) + ridge * ahead)).astype(np.float32)
            b = ahead_b - step * pull.sum(axis=0)
        return w, b - mean @ w

    w, b = train(~each)
    check = each if each.any() else ~each
    right = (x[check] @ w + b) * y[check] > 0
    names = np.array(languages_of)[check]
    accuracy = np.array([(right[names == n].sum(axis=0) + 1) / ((names == n).sum() + 2) for n in languages]).reshape(codes.shape)
    if each.any():
        w, b = train(np.ones(len(x), dtype=bool))
    return Model(languages, codes, w, b, accuracy / accuracy.sum(axis=1, keepdims=True))


def decode(model: Model, margins: np.ndarray, sharpness: float = 8.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, lead over the next) by the least weighted logistic loss."""
    losses = (model.loss_weights * np.log1p(np.exp(-np.clip(margins[:, None, :] * model.codes, -30, 30)))).sum(axis=2)
    chance = np.exp(-sharpness * (losses - losses.min(axis=1, keepdims=True)))
    chance /= chance.sum(axis=1, keepdims=True)
    best = chance.argmax(axis=1)
    ordered = np.sort(chance, axis=1)
    lead = ordered[:, -1] - (ordered[:, -2] if ordered.shape[1] > 1 else 0)
    return best, ordered[:, -1], lead


def train_language_model(
    labelled: DataFrame,
    rows_per_language: int = 400,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
) -> Model:
    """Fit on at most ``rows_per_language`` rows of each language with the smallest hashed ids."""
    rows = labelled.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & F.col(text_column).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label_column).count().collect()}  # one row per language
    if not counts:
        return fit(np.zeros((0, 1 << HASH_BITS)), [])
    spread = F.xxhash64(id_column)
    share = F.pmod(spread, F.lit(1 << 30)) / F.lit(float(1 << 30))
    likely = F.lit(False)
    for name, n in counts.items():
        likely = likely | ((F.col(label_column) == name) & (share < min(1.0, 2.0 * rows_per_language / n)))
    smallest = Window.partitionBy(label_column).orderBy("h", text_column)  # about twice what is kept
    sample = (
        rows.where(likely).select(F.col(text_column).alias("text"), F.col(label_column).alias("lang"), share.alias("h"))
        .withColumnRenamed("text", text_column).withColumnRenamed("lang", label_column)
        .withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= rows_per_language)
        .select(text_column, label_column, "h"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, lang, h in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                f = features(text.as_py())
                if f is not None:
                    at = np.flatnonzero(f)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([h]), pa.array([at.astype(np.int16)], pa.list_(pa.int16())),
                         pa.array([f[at].astype(np.float32)], pa.list_(pa.float32()))], names=["lang", "h", "at", "value"])

    found = sample.mapInArrow(featurise, "lang string, h double, at array<short>, value array<float>").collect()
    found.sort(key=lambda r: (r.h, r.lang))
    x = np.zeros((len(found), 1 << HASH_BITS), dtype=np.float32)
    for i, r in enumerate(found):
        x[i, r["at"]] = r["value"]
    return fit(x, [r.lang for r in found])


def identify_languages(
    docs: DataFrame, model: Model, text_column: str = "text", ambiguous_below: float = 0.2, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` plus lang_pred, score (0 to 1) and ambiguous; ``keep`` names the columns to carry."""
    added = ("lang_pred", "score", "ambiguous")
    fields = [f for f in docs.schema.fields if f.name not in added and (keep is None or f.name in keep)]
    names = [f.name for f in fields]
    read = "_text"
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("ambiguous", T.BooleanType())])

    bounded_batches(docs.sparkSession)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                margins = np.zeros((b.num_rows, model.codes.shape[1]))
                found = np.zeros(b.num_rows, dtype=bool)
                for i, text in enumerate(b.column(b.schema.get_field_index(read))):
                    f = features(text.as_py()) if model.languages else None
                    if f is not None:
                        margins[i], found[i] = f @ model.weights + model.biases, True
                pred, score, lead = np.full(b.num_rows, UND, dtype=object), np.zeros(b.num_rows), np.zeros(b.num_rows)
                if found.any():
                    best, score[found], lead[found] = decode(model, margins[found])
                    pred[found] = np.array(model.languages, dtype=object)[best]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(pred, pa.string()),
                     pa.array(score), pa.array(lead < ambiguous_below)], names=[*names, *added])

    if text_column in names and isinstance(docs.schema[text_column].dataType, T.StringType):
        read = text_column  # carried anyway: sent once
        return docs.select(*names).mapInArrow(lean(identify), schema)
    return docs.withColumn(read, F.col(text_column).cast("string")).select(*names, read).mapInArrow(lean(identify), schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
