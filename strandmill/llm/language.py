"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, held_out, save, table

#: Hashed n-grams of one to three bytes share this many places.
PLACES = 4096
_SLICE = 128  # documents whose counts are held at a time
_PIECE = 1 << 22  # bytes looked at together

#: Letters stay, capitals of ASCII are folded, all else becomes a blank; bytes over 127 belong to letters, mostly.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def profile(column: pa.Array) -> np.ndarray:
    """Damped counts of hashed byte n-grams, one row a text: 1 + log of the count. Whole texts, in pieces."""
    data, offsets = as_bytes(column)
    counts = np.zeros((len(column), PLACES), np.float32)
    mask = PLACES - 1
    for k in range(len(column)):
        for a in range(int(offsets[k]), int(offsets[k + 1]), _PIECE):
            b = _FOLD[data[a : min(a + _PIECE, int(offsets[k + 1]))]].astype(np.int64)
            keep = np.ones(len(b), bool)
            keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
            b = b[keep]
            two = b[:-1] * 257 + b[1:]
            three = two[:-1] * 257 + b[2:]
            spots = np.concatenate((b * 40503 >> 4, two * 2654435761 >> 9, three * 2654435761 >> 11)) & mask
            counts[k] += np.bincount(spots, minlength=PLACES)
    return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    """What is learned: inverse document frequencies, unit centroids with their languages, and the least cosine accepted."""

    idf: np.ndarray
    centers: np.ndarray
    langs: list[str]
    least: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language, cosine and whether the nearest centroid is too far, of each text."""
        names, scores, far = [], [], []
        for a in range(0, len(column), _SLICE):
            cos = _unit(profile(column[a : a + _SLICE]) * self.idf) @ self.centers.T
            best = cos.argmax(1)
            names += [self.langs[k] for k in best]
            score = cos[np.arange(len(best)), best]
            scores.append(score)
            far.append(score < self.least[best])
        return names, np.clip(np.concatenate(scores), 0, 1).astype(float), np.concatenate(far)


def has_letter() -> F.Column:
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, *, per_language: int = 600, clusters: int = 4, rounds: int = 12, slack: float = 0.5) -> Centroids | None:
    """Fit on a sample of about ``per_language`` documents of each language; None if there is no labelled text.

    Only text and non-null lang of documents that aren't held out are used; texts without letters are left out. The
    sample takes documents whose hash of doc_id is below a share set by their language's count, so its size is bounded by
    that parameter for any size of input. Each language's vectors are clustered by spherical k-means, in one task a
    language; the driver gets the centroids and the frequencies. A text is rejected when its cosine to the nearest
    centroid is below ``slack`` times the 1 % quantile of that centroid's own members.
    """
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out(5) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_language / n))))
    chance = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where((chance < share[F.col("lang")]) & has_letter()).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, _SLICE):
                part = b.slice(a, _SLICE)
                rows = profile(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "vector"])

    rows = save(sample.mapInArrow(vectors, "lang string, vector binary"), "language-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(PLACES, np.int64), 0
        for b in batches:
            for x in b.column(0):
                seen += np.frombuffer(x.as_py(), np.float32) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([seen.tolist()], pa.list_(pa.int64()))], names=["n", "seen"])

    parts = rows.select("vector").mapInArrow(frequencies, "n long, seen array<long>").collect()
    n = sum(r["n"] for r in parts)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + np.sum([r["seen"] for r in parts], axis=0))).astype(np.float32) + 1

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack([np.frombuffer(v, np.float32) for v in sorted(rows["vector"])]) * idf)
        centers = [x[0]]
        while len(centers) < min(clusters, len(x)):  # the farthest from those taken comes next
            centers.append(x[(x @ np.stack(centers).T).max(1).argmin()])
        centers = np.stack(centers)
        for _ in range(rounds):
            mine = (x @ centers.T).argmax(1)
            centers = np.stack([_unit(x[mine == k].sum(0)) if (mine == k).any() else centers[k] for k in range(len(centers))])
        cos = x @ centers.T
        mine, best = cos.argmax(1), cos.max(1)
        low = [float(np.quantile(best[mine == k], 0.01)) if (mine == k).any() else 0.0 for k in range(len(centers))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "k": range(len(centers)), "center": [c.astype(np.float32).tobytes() for c in centers], "low": low})

    found = rows.groupBy("lang").applyInPandas(cluster, "lang string, k int, center binary, low double").collect()
    found.sort(key=lambda r: (r["lang"], r["k"]))
    centers = np.stack([np.frombuffer(r["center"], np.float32) for r in found])
    return Centroids(idf, centers, [r["lang"] for r in found], slack * np.array([r["low"] for r in found]))


def identify(docs: DataFrame, model: Centroids | None, keep: list[str] | None = None, accepted: bool = False) -> DataFrame:
    """Columns ``keep`` of docs (doc_id by default), then lid_lang, lid_score, lid_rejected.

    The prediction reads text alone. A text that is null, or has no letter, or any text if nothing was learned, is
    ``und`` with score 0, and rejected. Empty, very long and repeated texts need no care; an empty table gives no rows. With ``accepted``,
    only columns ``keep`` of the rows that aren't rejected, so that their names may be any.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            lettered, text, rest = b.column(b.num_columns - 1), b.column(b.num_columns - 2), b.columns[:-2]
            n = b.num_rows
            names, scores, far = model.predict(text) if model and n else ([None] * n, np.zeros(n), np.ones(n, bool))
            ok = np.array(lettered.to_pylist(), bool) & (model is not None)
            yield pa.RecordBatch.from_arrays([*rest, pa.array([x if o else "und" for x, o in zip(names, ok, strict=True)], pa.string()), pa.array(np.where(ok, scores, 0.0)), pa.array(far | ~ok)], names=[f"c{i}" for i in range(len(rest))] + ["lid_lang", "lid_score", "lid_rejected"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").cast("string").alias("lid_text"), has_letter().alias("lid_letter"))
    out = rows.mapInArrow(run, ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(keep)) + ", lid_lang string, lid_score double, lid_rejected boolean")
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    return out.where("NOT lid_rejected").select(*own) if accepted else out.select(*own, "lid_lang", "lid_score", "lid_rejected")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """docs without those whose language can't be told, all columns as they were, whatever their names."""
    return identify(docs, fit(docs), docs.columns, accepted=True)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(5).alias("held_out"), F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"), F.col("lid_rejected").alias("rejected"))
