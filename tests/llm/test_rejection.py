"""What no learned language is near goes, what is written in one stays."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shorewatch.llm.language import BANDS, fit, held_out, identify, radii

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_foreign_and_random_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"))
    model = fit(docs.where(~held))
    assert (model.radius < 1).all()
    rng = random.Random(1)
    letters = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", [chr(c) for c in range(0x430, 0x450)], [chr(c) for c in range(0x4E00, 0x5600)]]
    for alphabet in letters:
        for length in (15, 60, 300, 3000):
            texts = pd.Series(["".join(rng.choice(alphabet) for _ in range(length)) for _ in range(50)])
            assert model.predict(texts).rejected.mean() >= 0.85, (alphabet[10], length)
    greek = "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα."
    assert model.predict(pd.Series([greek, greek * 20])).rejected.all()
    clean = docs.where(held & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).toPandas()
    assert len(clean) > 200 and model.predict(clean.text).rejected.mean() <= 0.02


def test_radii_are_of_the_texts_that_a_centroid_has():
    distance = np.array([0.55] * 30 + [0.8] * 30)
    nearest = np.array([0] * 30 + [1] * 30)
    band = np.full(60, len(BANDS))
    found = radii(distance, nearest, band, 3)
    # A centroid without texts takes the language's radius, a band without texts its neighbour's.
    assert found[0, -1] < found[1, -1] == found[2, -1] < 1
    assert (found[1] == found[1, -1]).all()


def test_predictions_equal_nearest_centroid_in_plain_python(spark):
    """Every whole held-out text against every centroid, gram by gram."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"))
    model = fit(docs.where(~held))
    rows = docs.where(held).collect()
    found = {r.doc_id: r for r in identify(spark.createDataFrame(rows, docs.schema).repartition(4), model).collect()}

    def signed(x):
        return (x + (1 << 63)) % (1 << 64) - (1 << 63)

    def vector(text):
        run = [0]
        for c in text.lower():
            if c.isalpha():
                run.append(ord(c))
            elif run[-1]:
                run.append(0)
        run += [0] * (run[-1] != 0)
        counts = Counter()
        for place, code in enumerate(run):
            if code:
                counts[(code * 40503 >> 3) % len(model.idf)] += 1
            hashed = code
            for size in range(2, model.longest + 1):
                if place + size > len(run):
                    break
                hashed = (hashed * 1_000_003 + run[place + size - 1] + size) & 0x3FFFFFFFFF
                counts[(signed(hashed * 2_654_435_761) >> 16) % len(model.idf)] += 1
        weighted = {b: math.log1p(n) * float(model.idf[b]) for b, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weighted.values()))
        return {b: w / norm for b, w in weighted.items()}

    seen = set()
    for row in rows:
        own = vector(row.text or "") if any(c.isalpha() for c in row.text or "") else None
        if own is None:
            assert found[row.doc_id].lang_pred == "und" and found[row.doc_id].rejected
            continue
        cosines = [sum(w * float(c[b]) for b, w in own.items()) for c in model.centroids]
        best = max(cosines)
        near = {model.labels[o] for o, c in zip(model.owner, cosines, strict=True) if c > best - 1e-5}
        assert found[row.doc_id].lang_pred in near and abs(found[row.doc_id].score - best) < 1e-4
        seen |= near
    assert len(seen) > 2


def test_columns_of_the_result_names_stay_apart(spark):
    frame = spark.createDataFrame([(1, "a text", "own", 3)], "doc_id long, text string, _predicted string, score int")
    model = fit(spark.createDataFrame([(1, "a text of words", "en"), (2, "ein anderer", "de")], "doc_id long, text string, lang string"))
    row = identify(frame, model).first()
    assert row["_predicted"] == "own" and row["lang_pred"] == "en" and 0 < row["score"] <= 1
