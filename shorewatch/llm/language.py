"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed letter n-grams.  Each language has several centroids, found by
spherical k-means over a bounded sample of labelled rows; a text gets the language of the centroid of
largest cosine, and is rejected where even that one is farther than its training texts of like length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shorewatch.llm.common import free_names, materialize

#: Hash buckets, longest n-gram, labelled rows that the fit reads per language, centroids per language.
BUCKETS, LONGEST, SAMPLE, CENTROIDS = 8192, 3, 400, 4
#: Upper ends, in letters, of the length bands that have radii of their own; what the least cosine is divided
#: by, and the cosine distance up to which nothing is rejected, so that unusual texts of a language stay.
BANDS, SLACK, LEAST_RADIUS = (32, 128, 512), 1.25, 0.5
#: Share of the texts that a radius is drawn around before it is widened, and texts that it is drawn from at least.
REACHED, FEW_TEXTS = 0.99, 20
#: Sample rows that are made dense at once beside the whole texts of a label.
AT_ONCE = 256
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; every other run is one 0, and 0 stands at both ends."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letters = _letters[0][np.minimum(codes, 0xFFFF)]
    for place in np.flatnonzero(codes > 0xFFFF):
        letters[place] = chr(codes[place]).isalpha()
    codes = np.concatenate(([0], np.where(letters, codes, 0), [0]))
    return codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]


def gram_counts(codes: np.ndarray, buckets: int, longest: int) -> np.ndarray:
    """How often each bucket's n-grams of 1 to ``longest`` characters occur; the bare gap is none."""
    counts = np.bincount((codes[codes != 0] * 40503 >> 3) % buckets, minlength=buckets)
    hashed = codes.copy()
    for size in range(2, longest + 1):
        if len(codes) < size:
            break
        hashed = (hashed[: len(codes) - size + 1] * 1_000_003 + codes[size - 1 :] + size) & 0x3FFFFFFFFF
        counts += np.bincount((hashed * 2_654_435_761 >> 16) % buckets, minlength=buckets)
    return counts


@dataclass
class Model:
    """Fitted centroids; its size depends on buckets and languages only."""

    labels: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray
    longest: int

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts).astype(np.float32) * self.idf
        norm = np.sqrt((weighted**2).sum(axis=1, keepdims=True))
        return weighted / np.where(norm > 0, norm, 1)

    def predict(self, texts: pd.Series, rows: int = 64) -> pd.DataFrame:
        label = np.full(len(texts), UNDETERMINED, object)
        score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        for start in range(0, len(texts) if self.labels else 0, rows):
            places, counts, lengths = [], [], []
            for place, text in enumerate(texts.iloc[start : start + rows], start):
                codes = letter_codes(text) if isinstance(text, str) else np.zeros(0, np.int64)
                if n := int((codes != 0).sum()):
                    places.append(place)
                    lengths.append(n)
                    counts.append(gram_counts(codes, len(self.idf), self.longest))
            if places:
                cosine = self.vectors(np.array(counts)) @ self.centroids.T
                nearest = cosine.argmax(axis=1)
                most = np.clip(cosine.max(axis=1).astype(float), 0, 1)
                label[places] = np.array(self.labels, object)[self.owner[nearest]]
                score[places] = most
                rejected[places] = 1 - most > self.radius[nearest, np.searchsorted(BANDS, lengths, side="right")]
        return pd.DataFrame({"lang_pred": label, "score": score, "rejected": rejected})


def sparse_rows(model: Model, rows: pd.DataFrame) -> np.ndarray:
    """Vectors of rows that list their filled buckets."""
    dense = np.zeros((len(rows), len(model.idf)), np.float32)
    for i, (at, n) in enumerate(zip(rows["at"], rows["n"], strict=True)):
        dense[i, np.asarray(at, np.int64)] = n
    return model.vectors(dense)


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun with the mean and then the row farthest from all centroids so far."""
    unit = lambda m: m / np.maximum(np.sqrt((m**2).sum(axis=1, keepdims=True)), 1e-12)
    centroids = unit(rows.mean(axis=0, keepdims=True))
    while len(centroids) < min(k, len(rows)):
        farthest = (rows @ centroids.T).max(axis=1).argmin()
        centroids = np.vstack([centroids, rows[farthest : farthest + 1]])
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(axis=1)
        filled = [c for c in range(len(centroids)) if (own == c).any()]
        centroids = unit(np.array([rows[own == c].mean(axis=0) for c in filled]))
    return centroids


def reach(distance: np.ndarray) -> float:
    """Radius around a centroid of texts at these distances: never 1 while they share anything with it."""
    return max(LEAST_RADIUS, 1 - (1 - float(np.quantile(distance, REACHED))) / SLACK)


def radii(distance: np.ndarray, nearest: np.ndarray, band: np.ndarray, centroids: int) -> np.ndarray:
    """Radius by centroid and length band of one language, from its texts' distances to their nearest centroids.

    Where a centroid has few texts of a band, all the language's texts of the band count; a band in which the
    language has few takes the radius of the next band that has enough, the shorter one of two, or else of all bands together.
    """
    bands = range(len(BANDS) + 1)
    known = {b: reach(distance[band == b]) for b in bands if (band == b).sum() >= FEW_TEXTS}
    found = np.empty((centroids, len(BANDS) + 1))
    for b in bands:
        pooled = known[min(known, key=lambda x: (abs(x - b), x))] if known else reach(distance)
        for c in range(centroids):
            own = distance[(band == b) & (nearest == c)]
            found[c, b] = reach(own) if len(own) >= FEW_TEXTS else pooled
    # A shorter text is never held to a narrower radius than a longer one.
    return np.maximum.accumulate(found[:, ::-1], axis=1)[:, ::-1]


def labelled_sample(docs: DataFrame, text: Column, label: Column, key: Column, per_label: int) -> DataFrame:
    """At most ``per_label`` rows with letters of each label, chosen by the hash of their key."""
    rows = docs.select(text.alias("text"), label.cast("string").alias("label"), F.xxhash64(key, text).alias("h"))
    rows = rows.where(label.isNotNull() & text.isNotNull() & key.isNotNull())
    # The choice is made on hashes alone, and each task keeps no more of a label than the sample does; the
    # texts of the chosen, a number that is bounded by the labels, are looked up after.
    order = Window.partitionBy("label").orderBy("h")
    ranked = rows.select("label", "h").withColumn("rank", F.row_number().over(order))
    chosen = materialize(ranked.where(F.col("rank") <= per_label).select("label", "h").distinct(), "sample")
    return rows.join(chosen, ["label", "h"])


def fit(
    docs: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    id_col: str = "doc_id",
    sample_per_label: int = SAMPLE,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    centroids_per_label: int = CENTROIDS,
) -> Model:
    """Centroids from at most ``sample_per_label`` whole texts of each label; rows without text or label teach nothing."""
    sample = labelled_sample(docs, F.col(text_col), F.col(label_col), F.col(id_col), sample_per_label)

    def count(batches):
        for batch in batches:
            kept = []
            for text, label in zip(batch["text"], batch["label"], strict=True):
                whole = letter_codes(text)
                ends = np.flatnonzero(whole) + 1
                # Shorter bands learn their radii from beginnings too; only the whole text makes centroids.
                for letters in [len(ends)] * bool(len(ends)) + [end // 2 for end in BANDS if end <= len(ends)]:
                    codes = whole if letters == len(ends) else np.append(whole[: ends[letters - 1]], 0)
                    counts = gram_counts(codes, buckets, longest)
                    at = np.flatnonzero(counts)
                    kept.append((label, letters, letters == len(ends), at.astype(np.int32), counts[at].astype(np.int32)))
            yield pd.DataFrame(kept, columns=["label", "letters", "whole", "at", "n"])

    schema = "label string, letters int, whole boolean, at array<int>, n array<int>"
    rows = materialize(sample.mapInPandas(count, schema), "grams")
    # One number a bucket; the texts' counts stay in the tasks, and each label is fitted in one of its own.
    whole = rows.where("whole")
    idf, texts = np.zeros(buckets, np.float32), whole.count()
    for bucket, held in whole.select(F.explode("at").alias("at")).groupBy("at").count().collect():
        idf[bucket] = held
    idf = (np.log((1 + texts) / (1 + idf)) + 1).astype(np.float32)
    model = Model([], idf, np.zeros((0, buckets), np.float32), np.zeros(0, int), np.zeros((0, len(BANDS) + 1)), longest)

    def fit_label(own: pd.DataFrame) -> pd.DataFrame:
        # Rows in an order of their own, so that sums come out the same in every run.
        own = own.assign(order=[(np.asarray(a).tobytes(), np.asarray(n).tobytes()) for a, n in zip(own["at"], own["n"], strict=True)])
        own = own.sort_values(["letters", "order"])
        is_whole = own["whole"].to_numpy(dtype=bool)
        centroids = cluster(sparse_rows(model, own[is_whole]), centroids_per_label).astype(np.float32)
        # Beginnings are looked at a few at a time.
        cosine = np.vstack([sparse_rows(model, own.iloc[i : i + AT_ONCE]) @ centroids.T for i in range(0, len(own), AT_ONCE)])
        band = np.searchsorted(BANDS, own["letters"].to_numpy(), side="right")
        found = radii(1 - cosine.max(axis=1), cosine.argmax(axis=1), band, len(centroids))
        return pd.DataFrame({"label": own["label"].iloc[0], "centroid": [c.tobytes() for c in centroids], "radius": list(found)})

    fitted = rows.groupBy("label").applyInPandas(fit_label, "label string, centroid binary, radius array<double>")
    # A few centroids and radii for each label.
    centroids, radius, owner = [], [], []
    for row in materialize(fitted.select("*", F.monotonically_increasing_id().alias("place")), "centroids").orderBy("label", "place").toLocalIterator():
        if not model.labels or model.labels[-1] != row["label"]:
            model.labels.append(row["label"])
        owner.append(len(model.labels) - 1)
        centroids.append(np.frombuffer(row["centroid"], np.float32))
        radius.append(row["radius"])
    if centroids:
        model.centroids, model.owner, model.radius = np.vstack(centroids), np.array(owner), np.array(radius)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns, and lang_pred, score and rejected (which replace columns of these names).

    The whole text is read and nothing else.  Null texts and texts without letters get ``und``, score 0
    and are rejected; so does every text where the model has learned no language.  Equal cosines go to
    the language first in code-point order.  Equal texts get equal results; an empty table stays empty.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return model.predict(texts)

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    (found,) = free_names(docs.columns, "_predicted")
    return docs.select(*rest, predict(F.col(text_col)).alias(found)).select(
        *rest, *[F.col(f"`{found}`.{c}").alias(c) for c in ("lang_pred", "score", "rejected")]
    )


def held_out(key: Column) -> Column:
    """Rows that are kept from the fit: those whose crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
