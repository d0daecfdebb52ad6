"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

The model is trained by follow-the-regularised-leader with elastic-net penalties on a bounded,
documented sample of labelled rows, then its scores are calibrated by one temperature. Prediction is
one pass over all whole texts.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, small_batches, utf8

BITS = 16
LONGEST = 3
#: The bound of the training sample: rows of each language.
SAMPLE_PER_LANG = 600
#: The bound of a model: 2^BITS weights of 4 bytes each language, 64 MB in all; more languages are an error.
MAX_LANGS = 256
EPOCHS = 4
SCALE = 40.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
#: Calibrated probability under which the pipeline rejects a document.
MIN_SCORE = 0.4
UNDETERMINED = "und"
#: Bytes of rows predicted at once; their n-grams take some 150 times as much memory.
BATCH = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased letters and single spaces: (bucket, number of the text), by text."""
    padded = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.array([len(p) for p in padded])
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = np.cumsum(size) - size
    keep[first] = True
    has = np.add.reduceat(letter, first, dtype=np.int64) > 0 if len(first) else np.empty(0, bool)
    code = np.where(letter, code, 32)[keep].astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), size)[keep]
    buckets, owners = [], []
    h = np.zeros(len(code), dtype=np.uint32)
    for n in range(1, LONGEST + 1):
        h = h[: len(code) - n + 1] * np.uint32(0x9E3779B1) + code[n - 1 :] + np.uint32(n)
        inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
        mixed = h ^ (h >> np.uint32(15))
        mixed = mixed * np.uint32(0x85EBCA77)
        buckets.append((mixed >> np.uint32(32 - BITS))[inside].astype(np.int64))
        owners.append(owner[n - 1 :][inside])
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    ok = has[owner]
    return bucket[ok], owner[ok]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(languages, weights by bucket with the IDF and the scale in them, biases, temperature).

    Every fifth row of the sample is held back for the temperature.
    """
    names = sorted(set(langs))
    target = np.array([names.index(x) for x in langs])
    rows = []
    for t in texts:
        b, _ = grams([t])
        rows.append(np.unique(b, return_counts=True))
    df = np.zeros(1 << BITS)
    for b, _ in rows:
        df[b] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    rows = [(b, SCALE * c / max(c.sum(), 1) * idf[b]) for b, c in rows]
    held = np.arange(len(rows)) % 5 == 4
    z = np.zeros((1 << BITS, len(names)))
    n = np.zeros_like(z)
    zb, nb = np.zeros(len(names)), np.zeros(len(names))

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(np.flatnonzero(~held)):
            b, x = rows[i]
            w, wb = weights(z[b], n[b]), weights(zb, nb)
            miss = _softmax(x @ w + wb)
            miss[target[i]] -= 1
            g = x[:, None] * miss
            z[b] += g - (np.sqrt(n[b] + g * g) - np.sqrt(n[b])) / ALPHA * w
            n[b] += g * g
            zb += miss - (np.sqrt(nb + miss * miss) - np.sqrt(nb)) / ALPHA * wb
            nb += miss * miss
    w, wb = weights(z, n), weights(zb, nb)
    logits = np.array([x @ w[b] + wb for (b, x), h in zip(rows, held) if h]).reshape(-1, len(names))
    truth = target[held]

    def loss(t):
        return -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).sum()

    steps = np.geomspace(0.25, 20, 200)
    temperature = float(steps[int(np.argmin([loss(t) for t in steps]))]) if len(truth) else 1.0
    return names, w * idf[:, None] * SCALE, wb, temperature


def predict(model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text; ``und`` and 0 without letters or languages."""
    names, weights, bias, temperature = model
    if not names or not texts:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    bucket, owner = grams(texts)
    total = np.bincount(owner, minlength=len(texts))
    logits = np.stack([np.bincount(owner, weights=np.ascontiguousarray(weights[:, k])[bucket], minlength=len(texts)) for k in range(len(names))], axis=1)
    p = _softmax((logits / np.maximum(total, 1)[:, None] + bias) / temperature)
    best = p.argmax(axis=1)
    return [names[k] if n else UNDETERMINED for k, n in zip(best, total)], np.where(total > 0, p[np.arange(len(p)), best], 0.0)


def _fit_rows(batches):
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    table = table.sort_by([("order", "ascending"), ("lang", "ascending")])
    names, weights, bias, temperature = fit(table["text"].to_pylist(), table["lang"].to_pylist())
    row = [pa.array([names]), pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias.tolist()]), pa.array([temperature])]
    yield pa.record_batch(row, names=["langs", "weights", "bias", "temperature"])


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG):
    """Fit on ``per_lang`` rows at most of every language, drawn by a hash of doc_id and text among the rows
    with a language, a text and crc32(doc_id) mod 5 other than 0. The model has 2^BITS weights a language.

    Where a language has many more different rows, a threshold on the hash lets about twice ``per_lang`` through,
    so that no task sees more of them than that. Equal rows count once. More than MAX_LANGS languages are an error.
    """
    rows = docs.filter("lang is not null and text is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    # Negative hashes to positive ones: the order is that of an unsigned number.
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    # Equal rows are one draw, here too: else a text repeated often would set a threshold that leaves its language nothing.
    drawn = materialize(rows.select("lang", place.alias("order")).distinct(), "language-rows")
    counted = materialize(drawn.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    if counted.count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    share = F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.col("n")) * float(1 << 63)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    low = drawn.join(counted, "lang").filter(F.col("order") <= share).select("lang", "order")
    # Written first: its true size then tells Spark to broadcast it, and no text is shuffled.
    drawn = materialize(low.withColumn("place", first).filter(F.col("place") <= per_lang).select("lang", "order"), "language-sample")
    sample = rows.select("lang", "text", place.alias("order")).join(drawn, ["lang", "order"]).groupBy("lang", "order").agg(F.first("text").alias("text"))
    found = sample.select("text", "lang", "order").coalesce(1).mapInArrow(_fit_rows, "langs array<string>, weights binary, bias array<double>, temperature double").first()
    if found is None:
        return [], np.empty((1 << BITS, 0)), np.empty(0), 1.0
    return list(found.langs), np.frombuffer(found.weights, dtype="<f4").astype(np.float64).reshape(1 << BITS, -1), np.array(found.bias), found.temperature


def _predict_rows(model, batches):
    for batch in small_batches(batches, BATCH):
        offsets, data = utf8(batch.column(batch.schema.get_field_index("text")))
        lang, score = predict(model.value, [str(data[a:b], "utf-8") for a, b in zip(offsets[:-1], offsets[1:])])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, model=None) -> DataFrame:
    """All columns of ``docs``, lang_pred and score, for every row; columns of ``docs`` with these two
    names are replaced. Null and empty texts and texts without a letter are ``und`` with score 0, as is all
    if no row can be learnt from. Prediction sees the text alone, so equal texts have equal results, and texts of any
    length are read whole; no rows give no rows."""
    model = train(docs) if model is None else model
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(partial(_predict_rows, sent), f"{have}, lang_pred string, score double")


def language_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; a null doc_id is never learnt from and not held out."""
    out = identify(docs.select("doc_id", "text"), train(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
