"""Language identification by error-correcting output codes.

Each learned language has a codeword of bits. For every bit a binary classifier over hashed byte 2- and 3-grams of the whole
text is trained (ridge regression to -1 and 1). A text's language is the codeword of least loss, where each bit's loss weighs
as much as the bit's classifier was right in cross-checking on the training rows; the gap to the next codeword tells how sure
that is, and a small gap is flagged as ambiguous.

Training uses a bounded sample: for each language, however many there are, the ids of the ``per_language`` smallest hashes, which
are sought below a bound of the hash that about ``SPARE`` times as many ids of the language have, so the window that ranks them
does not grow with the table. The ridge's normal equations are solved in the smaller of their two forms: by the rows' products where there are
no more rows than features, else by the features' products, which the executors sum fold by fold. So the driver holds two or three square
matrices of FEATURES, whatever the languages' number.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; without training rows every text is ``und``; with
one language all others are that; ids may be null (never held out, never learned from) or repeat, each row is answered; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import ship, stored, table
from .textbytes import CHUNK, as_bytes

#: Hashed n-grams; rows to learn from for a language.
FEATURES, PER_LANGUAGE = 4096, 600
#: Parts of the training rows that are judged by what the others teach; rows of which one task sums the products.
FOLDS, SUMMED = 4, 16_384
#: The smallest hashes are sought among so many times the ids wanted of a language, whatever its size.
SPARE = 4
#: Of the square weights in the fit; a gap of losses below which the answer is ambiguous.
RIDGE, UNSURE = 0.02, 0.05
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _plain_bytes() -> np.ndarray:
    """Letters in lower case, digits as 0, white space and controls as space."""
    out = np.arange(256, dtype=np.uint32)
    out[65:91] = out[97:123]
    out[48:58] = 48
    out[:33] = 32
    return out


_PLAIN = _plain_bytes()


def gram_counts(raw: np.ndarray) -> np.ndarray:
    """How often each hashed byte 2- and 3-gram occurs, with one space before and after the text."""
    total = np.zeros(FEATURES, np.int64)
    for i in range(0, max(1, len(raw)), CHUNK):
        b = _PLAIN[raw[i : i + CHUNK]]
        head = _PLAIN[raw[max(0, i - 2) : i]] if i else np.array([32], np.uint32)
        tail = np.array([32] if i + CHUNK >= len(raw) else [], np.uint32)
        b = np.concatenate([head, b, tail])
        two = b[:-1] | (b[1:] << np.uint32(8))
        three = two[:-1] | (b[2:] << np.uint32(16))
        if i:
            two = two[1:]  # the pair that the chunk before has counted
        for x, salt in ((two, 0x85EBCA6B), (three, 0x9E3779B1)):
            total += np.bincount((x * np.uint32(salt)) >> np.uint32(20), minlength=FEATURES)
    return total


def features(texts: pa.Array) -> np.ndarray:
    """A unit vector of damped counts for each text."""
    raw, at = as_bytes(texts)
    x = np.stack([gram_counts(raw[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]) if len(texts) else np.zeros((0, FEATURES))
    x = np.log1p(x.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A codeword of -1 and 1 for each language: all splits in two for few, else random ones that lie far apart."""
    if languages <= 1:
        return np.ones((languages, 0), np.int8)
    if languages <= 6:
        splits = np.arange(1, 1 << (languages - 1))
        return (((splits[None, :] >> np.arange(languages)[:, None]) & 1) * 2 - 1).astype(np.int8)
    rng, bits = np.random.default_rng(seed), 4 * int(np.ceil(np.log2(languages))) + 11
    best, far = None, -1
    for _ in range(64 if languages <= 1024 else 2):
        c = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        c = c[:, np.abs(c.sum(0, dtype=np.int64)) < languages].astype(np.float32)
        apart = min((c.shape[1] - np.delete(c @ c[k], k).max()) / 2 for k in range(languages))
        if apart > far:
            best, far = c.astype(np.int8), apart
    return best


class Model:
    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray, unsure: float):
        self.languages, self.codes, self.weights, self.bias, self.trust, self.unsure = languages, codes, weights, bias, trust, unsure

    @classmethod
    def of(cls, languages: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray, right: np.ndarray, unsure: float) -> Model:
        """``right``: the share of training rows of which each bit's classifier, taught by the other folds, was right."""
        error = np.clip(1 - right, 0.005, 0.495)
        trust = np.log((1 - error) / error)
        return cls(languages, codes, weights.astype(np.float32), bias, trust / trust.sum(), unsure)

    @classmethod
    def blank(cls, languages: list[str], codes: np.ndarray, unsure: float) -> Model:
        """Of no or one language: nothing to tell apart."""
        return cls(languages, codes, np.zeros((FEATURES, 0), np.float32), np.zeros(0), np.zeros(0), unsure)

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str], ridge: float = RIDGE, folds: int = FOLDS, unsure: float = UNSURE) -> Model:
        """By the products of the rows with each other."""
        languages = sorted(set(labels))
        codes = codewords(len(languages))
        if not codes.size:
            return cls.blank(languages, codes, unsure)
        y = codes[[languages.index(k) for k in labels]].astype(np.float64)
        mean = y.mean(0)
        gram = (x @ x.T).astype(np.float64)
        fold, right = np.arange(len(y)) % folds, np.zeros(y.shape)
        for f in range(folds):
            i, j = fold != f, fold == f
            if i.any() and j.any():
                a = np.linalg.solve(gram[np.ix_(i, i)] + ridge * np.eye(i.sum()), (y - mean)[i])
                right[j] = np.sign(gram[np.ix_(j, i)] @ a + mean) == y[j]
        a = np.linalg.solve(gram + ridge * np.eye(len(y)), y - mean)
        return cls.of(languages, codes, x.T @ a, mean, right.mean(0), unsure)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score from 0 to 1, whether it is ambiguous."""
        if len(self.languages) < 2:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        margin = x @ self.weights + self.bias
        one = (self.codes.T > 0).astype(np.float64)
        loss = (np.log1p(np.exp(-3 * margin)) * self.trust) @ one + (np.log1p(np.exp(3 * margin)) * self.trust) @ (1 - one)
        best = loss.argmin(1)
        odds = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        two = np.partition(loss, 1, axis=1)
        return best, 1 / odds.sum(1), two[:, 1] - two[:, 0] < self.unsure


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [bool(t and _LETTER.search(t)) for t in batch.column(1).to_pylist()]
        batch = batch.filter(pa.array(keep, pa.bool_()))
        if batch.num_rows:
            yield pa.record_batch([batch.column(0), pa.array([v.astype(np.float16).tobytes() for v in features(batch.column(1))], pa.binary())], ["lang", "x"])


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float16) for v in column]).astype(np.float32) if len(column) else np.zeros((0, FEATURES), np.float32)


def _targets(column: pa.Array, at: dict[str, int], codes: np.ndarray) -> np.ndarray:
    return codes[[at[k] for k in column.to_pylist()]].astype(np.float32)


def _products(at: dict[str, int], codes: np.ndarray, strip: int = 256):
    """The sums, by fold, of the products of rows' features with each other, with their codewords, and of the codewords; in strips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            fold, x = b.column(2).to_numpy(), _vectors(b.column(1))
            y = _targets(b.column(0), at, codes)
            for f in np.unique(fold).tolist():
                own = np.concatenate([x[fold == f], np.ones(((fold == f).sum(), 1), np.float32)], axis=1)  # the last feature is 1
                part = own.T @ np.concatenate([own, y[fold == f]], axis=1)
                sums[f] = sums[f] + part if f in sums else part
        for f, part in sums.items():
            for k in range(0, FEATURES + 1, strip):
                yield pa.record_batch([pa.array([f], pa.int32()), pa.array([k], pa.int32()), pa.array([part[k : k + strip].tobytes()], pa.binary())], ["fold", "strip", "sums"])

    return run


def _added(block: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_buffer(), np.float32) for v in block.column("sums"))
    return pa.table({"fold": block.column("fold")[:1], "strip": block.column("strip")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _judged(at: dict[str, int], codes: np.ndarray, taught: dict[int, tuple[np.ndarray, np.ndarray]]):
    """How many rows of a task each bit's classifier of the other folds is right of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(codes.shape[1], np.int64)
        for b in batches:
            fold, x = b.column(2).to_numpy(), _vectors(b.column(1))
            y = _targets(b.column(0), at, codes)
            for f, (weights, bias) in taught.items():
                right += (np.sign(x[fold == f] @ weights + bias) == y[fold == f]).sum(0)
        yield pa.record_batch([pa.array(range(len(right)), pa.int32()), pa.array(right)], ["bit", "right"])

    return run


def fit_by_products(learn: DataFrame, n: int, languages: list[str], unsure: float = UNSURE) -> Model:
    """The same ridge by the products of the features, summed by the executors; ``learn`` has (lang, x, fold)."""
    codes = codewords(len(languages))
    if not codes.size:
        return Model.blank(languages, codes, unsure)
    at = {k: i for i, k in enumerate(languages)}
    tasks = max(1, -(-n // SUMMED))
    parts = learn.repartition(tasks, "fold", F.pmod(F.xxhash64("x"), F.lit(tasks))).mapInArrow(_products(at, codes), "fold int, strip int, sums binary")
    sums = stored(parts.groupBy("fold", "strip").applyInArrow(_added, "fold int, strip int, sums binary"), "products")  # FOLDS matrices, whatever the rows

    def matrix(fold: int) -> np.ndarray:
        own = sorted(sums.where(F.col("fold") == fold).select("strip", "sums").toLocalIterator())
        return np.concatenate([np.frombuffer(r.sums, np.float32) for r in own]).reshape(FEATURES + 1, -1) if own else np.zeros((FEATURES + 1, FEATURES + 1 + codes.shape[1]), np.float32)

    whole = sum(matrix(f) for f in range(FOLDS))
    mean = whole[-1, FEATURES + 1 :] / n

    def weights(m: np.ndarray) -> np.ndarray:
        left = m[:-1, :FEATURES].astype(np.float64)
        left[np.diag_indices(FEATURES)] += RIDGE
        return np.linalg.solve(left, m[:-1, FEATURES + 1 :] - m[:-1, FEATURES : FEATURES + 1] * mean).astype(np.float32)

    taught = {f: (weights(whole - matrix(f)), mean) for f in range(FOLDS)}
    right = np.zeros(codes.shape[1])
    for r in learn.mapInArrow(_judged(at, codes, taught), "bit int, right long").groupBy("bit").agg(F.sum("right").alias("right")).collect():
        right[r.bit] = r.right / n
    return Model.of(languages, codes, weights(whole), mean, right, unsure)


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, x, fold) of at most ``per_language`` labelled rows of each language."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null and text is not null")
    size = rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids"))
    share = stored(size.select("lang", (F.lit(SPARE * per_language) / F.col("ids")).alias("share")), "languages")  # a table, so that its size tells whether it is broadcast
    near = rows.select("id", "lang", F.xxhash64("id").alias("h")).join(share, "lang").where("h / 18446744073709551616D + 0.5D <= share")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = stored(near.select("id", "lang", "h").distinct().withColumn("nth", nth).where(F.col("nth") <= per_language).select("id", "lang"), "chosen")
    picked = rows.join(chosen, ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    learn = picked.select("lang", "text").mapInArrow(_featured, "lang string, x binary")
    return stored(learn.withColumn("fold", F.pmod(F.xxhash64("x", "lang"), F.lit(FOLDS)).cast("int")), "training")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the labelled rows of ``docs``, of all their languages."""
    learn = training_rows(docs, id_col, text_col, lang_col, per_language)
    n = learn.count()
    if n > FEATURES:
        return fit_by_products(learn, n, sorted(r.lang for r in learn.select("lang").distinct().collect()))
    rows = sorted(learn.select("lang", "x").collect())  # FEATURES rows at most
    return Model.fit(_vectors(pa.array([r.x for r in rows], pa.binary())), [r.lang for r in rows])


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                has = np.array([bool(t and _LETTER.search(t)) for t in batch.column(1).to_pylist()], bool)
                lang, score, unsure = [UNKNOWN] * len(has), np.zeros(len(has)), np.ones(len(has), bool)
                if model.languages and has.any():
                    best, score[has], unsure[has] = model.predict(features(batch.column(1).filter(pa.array(has))))
                    for k, b in zip(np.flatnonzero(has).tolist(), best.tolist(), strict=True):
                        lang[k] = model.languages[b]
                yield pa.record_batch([*batch.columns[:1], pa.array(lang, pa.string()), pa.array(score), pa.array(unsure), *batch.columns[2:]], ["id", "lang_pred", "score", "ambiguous", *batch.schema.names[2:]])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every whole text."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predicted(model), f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether crc32 of the id as text leaves no remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
