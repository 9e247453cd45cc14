"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams of the lower-cased text (one to three characters; ASCII other than letters counts as a
blank) are hashed into a fixed number of features. Document frequencies are counted over all training
documents. The weights are learned with follow-the-regularised-leader (per-coordinate rates, elastic
net) on a bounded, hash-chosen sample of ``SAMPLE`` labelled documents, spread evenly over the
languages; a fifth of the sample is kept apart and sets the temperature of the softmax.

Defined results: a null text or one without any letter is ``und`` with score 0, as is every text when
no labelled document exists; documents without a label or id text take no part in training when their
label is null (a null id counts as the empty text); repeated rows are counted and predicted each; a long text
is counted piece by piece; ties go to the alphabetically first language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, free_name, sum_vectors, vector_blocks

FEATURES = 1 << 16
#: Labelled documents that the weights are fitted on, over all languages.
SAMPLE = 3200
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.1
#: The broadcast model holds FEATURES numbers a language, so their number has a limit: a table with more is an error.
MAX_LANGUAGES = 512
UNKNOWN = "und"
FOLDS = 5
_WORDLIKE = re.compile(r"[^\W\d_]+")
_PIECE = 1 << 18
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def count_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of the hashed n-grams of a whole text, taken piece by piece."""
    low, total = text.lower(), None
    for at in range(0, len(low), _PIECE):
        c = np.frombuffer(low[max(0, at - 2) : at + _PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        c = np.where(c < 128, _FOLD[np.minimum(c, 127)], c)
        skip = min(at, 2)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
        one = c[skip:] * np.uint32(0x165667B1)
        grams = np.concatenate([one, two[max(0, skip - 1) :] ^ np.uint32(0x55555555), three ^ np.uint32(0x33333333)])
        n = np.bincount((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16), minlength=FEATURES)
        total = n if total is None else total + n
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    used = np.flatnonzero(total)
    return used, total[used]


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf
    return x / max(1e-12, float(np.sqrt(x @ x)))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # by feature
    weights: np.ndarray  # feature x language
    temperature: float = 1.0

    def logits(self, used: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weigh(counts, self.idf[used]) @ self.weights[used]

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*count_features(text)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def has_letter(text: str) -> bool:
    """Whether a letter is there; superscripts, fractions and letter-like numerals aren't letters."""
    return any(any(map(str.isalpha, m.group())) for m in _WORDLIKE.finditer(text))


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max())
    return e / e.sum()


def fit_weights(rows: list[tuple[int, np.ndarray, np.ndarray]], n_languages: int, epochs: int = EPOCHS) -> np.ndarray:
    """Follow-the-regularised-leader over (language, features, values) rows."""
    z, n = np.zeros((FEATURES, n_languages)), np.zeros((FEATURES, n_languages))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            y, used, x = rows[k]
            zs, ns = z[used], n[used]
            w = weights(zs, ns)
            error = softmax(x @ w)
            error[y] -= 1.0
            g = x[:, None] * error[None, :]
            more = ns + g * g
            z[used] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[used] = more
    return weights(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by a search over a fine geometric grid."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        v = logits / t
        v = v - v.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(labels)), labels]))

    return float(min(np.geomspace(0.02, 20.0, 200), key=loss))


def fold_of(id_col: str, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, sample: int = SAMPLE) -> Model:
    """Fit on the documents with a text and a label whose fold is not 0."""
    text = F.col(text_col).cast("string")
    labelled = docs.where(text.isNotNull() & F.col(lang_col).isNotNull() & (fold_of(id_col, folds) != 0)).select(text.alias("t"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("h"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model is broadcast and takes {FEATURES * 8 >> 10} KB for each")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)))
    # a document is in the sample if its hash is below its language's share of the range
    each = max(20, sample // len(languages))
    bound = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, each / sizes[k]))])[F.col("lang")]
    picked = labelled.withColumn("pick", (F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)) < bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, empty = np.zeros(FEATURES, np.int64), pa.array([None], pa.binary())
        for b in batches:
            for t, lang, h, pick in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                used, n = count_features(t.as_py())
                seen[used] += 1
                if pick.as_py():
                    data = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (used, n)]
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), data[0], data[1], pa.array([lang.as_py()]), pa.array([h.as_py()])], names=["block", "data", "n", "lang", "h"])
        for k, data in zip(*vector_blocks(seen)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary()), empty, pa.array([None], pa.string()), pa.array([None], pa.int64())], names=["block", "data", "n", "lang", "h"])

    gathered = cut(picked.mapInArrow(run, "block int, data binary, n binary, lang string, h bigint"))
    seen = sum_vectors(gathered.where("block >= 0").select("block", "data"), FEATURES)
    idf = np.log((1.0 + sum(sizes.values())) / (1.0 + seen)) + 1.0
    found = sorted(gathered.where("block < 0").select("h", "lang", "data", "n").collect(), key=lambda r: (r.h, r.lang, bytes(r.data)))
    rows = []
    for r in found:
        used, n = np.frombuffer(bytes(r.data), "<i4"), np.frombuffer(bytes(r.n), "<i4")
        if len(used):
            rows.append((languages.index(r.lang), used, weigh(n, idf[used])))
    apart = [row for k, row in enumerate(rows) if k % 5 == 4]
    model = Model(languages, idf, fit_weights([row for k, row in enumerate(rows) if k % 5 != 4], len(languages)))
    if apart:
        model.temperature = fit_temperature(np.array([x @ model.weights[used] for _, used, x in apart]), np.array([y for y, _, _ in apart]))
    return model


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with two more columns: the predicted language and its calibrated probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages numbers
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields]).add(lang_out, "string").add(score_out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [shared.value.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in told], pa.string()), pa.array([s for _, s in told], pa.float64())], names=[*b.schema.names, lang_out, score_out])

    return docs.mapInArrow(run, schema)


def predictions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, folds=folds)
    seen = docs.select(F.col(id_col), (fold_of(id_col, folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return identify(seen, model, text_col="t").select(id_col, "held_out", "lang_pred", "score")


def keep_known_languages(docs: DataFrame, *, min_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is recognised with at least ``min_score``, with all their columns."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    return identify(docs, model, text_col=text_col, lang_out=lang, score_out=score).where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
