"""Language identification by nearest centroid.

A text is a TF-IDF vector over hashed character n-grams, of length one. Each language has
several centroids, found by spherical k-means over a bounded sample of its labelled
texts. A text gets the language of the centroid with the largest cosine; one that is
farther from it than almost all of the centroid's own texts is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalweave.llm.common import as_bytes, map_texts, stored, worker_value

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Letters in lower case; what is neither an ASCII letter nor beyond ASCII is a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled texts of a language that the model is fitted on, at most; ``centroids`` of each language;
    ``cells``: n-gram cells; ``farthest``: share of a centroid's texts that lie beyond its rejection distance."""

    sample: int = 1000
    centroids: int = 3
    cells: int = 4096
    rounds: int = 8
    farthest: float = 0.002


def counts_of(texts: Sequence[bytes | None], cells: int) -> np.ndarray:
    """Counts of the hashed 2-, 3- and 4-byte runs of each text, one row a text."""
    out = np.zeros((len(texts), cells), np.float32)
    for row, text in enumerate(texts):
        codes = np.frombuffer(b" ".join((b" " + (text or b"")).translate(LETTERS).split()), np.uint8).astype(np.uint32)
        run = codes
        for size in (2, 3, 4):
            if len(codes) < size:
                break
            run = run[:-1] * np.uint32(0x01000193) + codes[size - 1 :]
            mixed = (run ^ (run >> np.uint32(15))) * np.uint32(0x9E3779B1)
            out[row] += np.bincount(mixed >> np.uint32(20), minlength=4096)[:4096].reshape(cells, -1).sum(axis=1)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)


def cluster(points: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of points on the sphere, started far from each other, and the cosine beyond which each rejects."""
    centres = [points.mean(axis=0)]
    while len(centres) < min(settings.centroids, len(points)):
        nearest = np.max([points @ (c / max(np.linalg.norm(c), 1e-9)) for c in centres], axis=0)
        centres.append(points[int(np.argmin(nearest))])
    for _ in range(settings.rounds):
        at = np.array([c / max(np.linalg.norm(c), 1e-9) for c in centres])
        own = np.argmax(points @ at.T, axis=1)
        centres = [points[own == k].mean(axis=0) if (own == k).any() else at[k] for k in range(len(at))]
    at = np.array([c / max(np.linalg.norm(c), 1e-9) for c in centres], np.float32)
    cosines = points @ at.T
    own = np.argmax(cosines, axis=1)
    limits = [float(np.quantile(cosines[own == k, k], settings.farthest)) if (own == k).any() else 0.0 for k in range(len(at))]
    return at, np.array(limits, np.float32)


#: Languages whose shares of the sample are sent to all executors, at most; of more, texts are joined by shuffle.
FEW_LANGUAGES = 100_000


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None, settings: Settings = Settings()) -> Model:
    """A model of the labelled texts; rows with a null or empty text or a null language are left out.

    Of a language, about ``settings.sample`` texts are used, chosen by a hash of ``order``
    (default: of the text). Without any labelled text the model knows no language.
    """
    rows = labelled.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{text}`") if order is None else order).alias("_order"))
    rows = rows.filter("text <> '' AND lang IS NOT NULL")
    share = F.least(F.lit(settings.sample) / F.col("count"), F.lit(1.0)) * 1_000_000
    shares = stored(rows.groupBy("lang").count().withColumn("_share", share).drop("count"))
    if shares.count() <= FEW_LANGUAGES:
        shares = F.broadcast(shares)
    sample = rows.join(shares, "lang").filter(F.pmod("_order", F.lit(1_000_000)) < F.col("_share"))
    sample = stored(sample.select("lang", "text"))

    def frequencies(batches):
        total, n = np.zeros(settings.cells, np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                counts = counts_of(as_bytes(batch.column(0).slice(start, 256)), settings.cells)
                total += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(settings.cells + 1)), pa.array(np.append(total, n))], names=["cell", "n"])

    known = sample.select("text").mapInArrow(frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(settings.cells + 1)
    df[known["cell"].to_numpy()] = known["n"].to_numpy()
    if not df[-1]:
        return Model((), np.zeros(settings.cells, np.float32), np.zeros((0, settings.cells), np.float32), np.zeros(0, np.float32))
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1

    def centroids(rows: pa.Table) -> pa.Table:
        texts = as_bytes(rows["text"].combine_chunks())
        points = np.concatenate([vectors(counts_of(texts[i : i + 256], settings.cells), idf) for i in range(0, len(texts), 256)])
        at, limits = cluster(points, settings)
        return pa.table({"lang": [rows["lang"][0].as_py()] * len(at), "centroid": [c.tobytes() for c in at], "edge": limits.astype(float)})

    made = sample.groupBy("lang").applyInArrow(centroids, "lang string, centroid binary, edge double").orderBy("lang", F.desc("edge"), "centroid").toArrow()
    matrix = np.stack([np.frombuffer(c.as_py(), np.float32) for c in made["centroid"]])
    return Model(tuple(made["lang"].to_pylist()), idf, matrix, made["edge"].to_numpy().astype(np.float32))


def predict(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text", cells: int = Settings.cells) -> DataFrame:
    """Columns ``keep`` of each row with lang_pred, score (the cosine, 0 to 1) and rejected.

    The whole text counts. A null text and one without a letter are ``und`` with score 0,
    rejected; so is every text if the model knows no language. Equal cosines go to the language
    that comes first by name. Repeated rows stay, a kept column of an added name is replaced.
    Row-local.
    """
    plain = (model.languages, model.idf, model.centroids, model.limits)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        languages, idf, matrix, limits = worker_value(shared, lambda x: x)
        texts = as_bytes(columns[0])
        names, scores, far = [], [], []
        for start in range(0, len(texts), 256):
            part = texts[start : start + 256]
            if not languages:
                names += [UNKNOWN] * len(part)
                scores += [0.0] * len(part)
                far += [True] * len(part)
                continue
            cosines = vectors(counts_of(part, cells), idf) @ matrix.T
            best = np.argmax(cosines, axis=1)
            for text, k, row in zip(part, best, cosines):
                known = text is not None and LETTER.search(text.decode("utf-8", "replace")) is not None
                score = float(min(max(row[k], 0.0), 1.0)) if known else 0.0
                names.append(languages[k] if known else UNKNOWN)
                scores.append(score)
                far.append(not known or score < limits[k])
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())]

    return map_texts(docs, keep, [F.col(f"`{text}`").cast("string")], "lang_pred string, score double, rejected boolean", work)
