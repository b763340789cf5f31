"""Language identification: nearest clustered centroid over normalised TF-IDF character n-grams, with rejection.

Text is lower-cased; letters and marks are kept, all else is one boundary.  Its trigrams (and boundary trigrams) are
hashed to `FEATURES` cells; weights are (1 + ln tf) * idf, normalised.  Each language has several centroids from
spherical k-means.  The best cosine wins; ties go to the first label in order.  Cells are shared by
chance, the more the longer a text is, so the cosine expected of a text with its weights in random cells is taken off first;
a text is rejected if its distance 1 - (cosine - chance) exceeds the radius of the winning centroid, which is set from the
same distances of training texts and widened by RADIUS.

The classifier is fitted on a bounded sample: for each label the PER_LABEL training rows with the smallest hash of
doc_id (one label holding most rows costs no more than another).  Each label is fitted in a task of its own; the driver gets
its centroids and one document count per cell.  More than `max_labels` labels are an error, as the model that every task holds
grows with them (64 kB a label): none is left out in silence.  Prediction covers every whole text.

Defined cases: null text or text without a letter is `und`, score 0, rejected; if there is no training row at all every
text is `und`; rows with equal texts get equal values; extra columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, lean, slices

FEATURES = 1 << 12
CENTROIDS = 4
PER_LABEL = 400
MAX_LABELS = 1000
ROUNDS = 8
QUANTILE = 0.005
RADIUS = 0.25
UNKNOWN = "und"


@lru_cache(1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Code points that are letters, and letters or marks."""
    kinds = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(sys.maxunicode + 1)], np.uint8)
    letters = kinds == ord("L")
    return letters, letters | (kinds == ord("M"))


def count_ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows, FEATURES) of hashed trigrams, and which rows have a letter."""
    letters, inside = letter_tables()
    low = [(t or "").lower() for t in texts]
    cps = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low])
    doc = np.repeat(np.arange(len(low), dtype=np.int32), np.diff(ends, prepend=0))
    has = np.zeros(len(low), bool)
    has[doc[letters[cps]]] = True
    x = np.where(inside[cps], cps, np.uint32(32))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (doc[1:] != doc[:-1])
    x, doc = x[keep], doc[keep]
    first = np.ones(len(x), bool)
    first[1:] = doc[1:] != doc[:-1]
    before = np.empty_like(x)
    before[0], before[1:] = 32, x[:-1]
    before[first] = 32
    after = np.empty_like(x)
    after[-1], after[:-1] = 32, x[1:]
    h = ((before * np.uint32(2654435761) + x) * np.uint32(2246822519) + after) * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2654435761)
    mid = x != 32
    cell = doc[mid].astype(np.int64) * FEATURES + (h[mid] >> np.uint32(32 - FEATURES.bit_length() + 1))
    return np.bincount(cell, minlength=len(low) * FEATURES).reshape(len(low), FEATURES), has


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = counts.astype(np.float32)
    np.log(w, out=w, where=w > 0)
    w += counts > 0
    w *= idf
    norm = np.sqrt((w * w).sum(1, keepdims=True))
    return w / np.where(norm > 0, norm, 1)


def by_chance(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cosine of each row to each centroid that is expected if the row's weights stood in random cells."""
    return x.sum(1, keepdims=True) * centroids.mean(1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Deterministic: starts at the row nearest the mean, then the farthest rows in turn."""
    unit = lambda v: v / max(float(np.linalg.norm(v)), 1e-12)
    centres = [x[int(np.argmax(x @ unit(x.mean(0))))]]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.array(centres).T, axis=1)
        if near.min() > 1 - 1e-6:
            break
        centres.append(x[int(np.argmin(near))])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([unit(x[own == i].mean(0)) if (own == i).any() else c[i] for i in range(len(c))])
    return c.astype(np.float32)


class Model:
    def __init__(self, labels, idf, centroids, owner, radius):
        self.labels, self.idf, self.centroids, self.owner, self.radius = labels, idf, centroids, owner, radius

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(label, score, rejected) of each text."""
        counts, has = count_ngrams(texts)
        if not self.labels:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        x = weigh(counts, self.idf)
        cos = np.round(x @ self.centroids.T, 5)
        best = np.argmax(cos, axis=1)
        top = np.clip(cos[np.arange(len(texts)), best], 0, 1)
        out = 1 - (top - by_chance(x, self.centroids)[np.arange(len(texts)), best]) > self.radius[best]
        return [(self.labels[self.owner[b]], round(float(s), 5), bool(r)) if ok else (UNKNOWN, 0.0, True) for b, s, r, ok in zip(best, top, out, has, strict=True)]


def runs(texts: list[str | None]):
    """Runs of texts that are small enough to count together; a long text is a run of its own."""
    ends = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    return slices(ends, 1 << 20, 128)


SAMPLE = "lang string, u long, doc_id long, at binary, n binary"


def vectors(batches):
    """SAMPLE rows of (lang, u, doc_id, text): the counts of each text that has a letter."""
    for b in batches:
        langs, us, ids, texts = (b.column(i).to_pylist() for i in range(4))
        rows = []
        for i, j in runs(texts):
            counts, has = count_ngrams(texts[i:j])
            for k in np.flatnonzero(has):
                at = np.flatnonzero(counts[k])
                rows.append((langs[i + k], us[i + k], ids[i + k], at.astype(np.uint16).tobytes(), counts[k][at].astype(np.float32).tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "u", "doc_id", "at", "n"])


def dense(pdf, per_label: int) -> np.ndarray:
    """Counts of the label's sample, in the order of its hashes."""
    rows = sorted(zip(pdf.u, pdf.doc_id.fillna(0), map(bytes, pdf["at"]), map(bytes, pdf.n), strict=True))[:per_label]
    out = np.zeros((len(rows), FEATURES), np.float32)
    for x, (_, _, at, n) in zip(out, rows, strict=True):
        x[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.float32)
    return out


def fit(docs: DataFrame, per_label: int = PER_LABEL, max_labels: int = MAX_LABELS, centroids: int = CENTROIDS) -> Model:
    """A model from docs(doc_id, text, lang); rows without text or lang teach nothing."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = train.groupBy("lang").count().limit(max_labels + 1).collect()
    if len(sizes) > max_labels:
        raise ValueError(f"there are more than {max_labels} labels; pass a larger max_labels if workers can hold 64 kB for each")
    if not sizes:
        return Model([], None, None, None, None)
    share = F.create_map(*[x for r in sorted(sizes) for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * per_label / r["count"] + 20.0 / r["count"])))])
    u = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 40))
    picked = train.where(u / float(1 << 40) < F.element_at(share, F.col("lang"))).select("lang", u.alias("u"), "doc_id", "text")
    sample = Scratch(docs.sparkSession, "langid").save(picked.mapInArrow(lean(vectors), SAMPLE), "sample")  # about 2 * per_label rows a label

    def count(pdf):
        import pandas as pd

        x = dense(pdf, per_label)
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "n": [len(x)], "df": [(x > 0).sum(0).astype(np.int64)]})

    counted = sample.groupBy("lang").applyInPandas(count, "lang string, n long, df array<long>")
    found = counted.select("n", F.posexplode("df").alias("cell", "df")).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).collect()  # FEATURES rows
    if not found:
        return Model([], None, None, None, None)
    df = np.zeros(FEATURES)
    for r in found:
        df[r["cell"]] = r["df"]
    idf = (np.log((1 + found[0]["n"]) / (1 + df)) + 1).astype(np.float32)

    def learn(pdf):
        import pandas as pd

        x = weigh(dense(pdf, per_label), idf)
        c = spherical_kmeans(x, centroids)
        floor = float(np.quantile(np.max(x @ c.T - by_chance(x, c), axis=1), QUANTILE)) * RADIUS
        return pd.DataFrame({"lang": pdf.lang.iloc[0], "i": range(len(c)), "centroid": [v.tobytes() for v in c], "radius": 1 - floor})

    got = sample.groupBy("lang").applyInPandas(learn, "lang string, i int, centroid binary, radius double").collect()
    got = sorted(got, key=lambda r: (r["lang"], r["i"]))
    labels = sorted({r["lang"] for r in got})
    at = {name: i for i, name in enumerate(labels)}
    stacked = np.stack([np.frombuffer(bytes(r["centroid"]), np.float32) for r in got])
    return Model(labels, idf, stacked, [at[r["lang"]] for r in got], np.array([r["radius"] for r in got], np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        m = shared.value
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for i, j in runs(texts):
                out += m.predict(texts[i:j])
            cols = list(zip(*out, strict=True)) or [()] * 3
            arrays = [b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(label), "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_recognised(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs(text, lang, ...) that are not rejected, with all their columns."""
    model = fit(docs, **kw)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        m = shared.value
        for b in batches:
            texts, out = b.column(at).to_pylist(), []
            for i, j in runs(texts):
                out += [not r for _, _, r in m.predict(texts[i:j])]
            yield b.filter(pa.array(out, pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
