"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, short_batches, trim

#: At most so many labelled rows fit the model, taken by a hash of their id.
MAX_FIT_ROWS = 20_000
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»„“”‘’…"
REPEATED = re.compile(r"(.)\1\1")
NEAR, WINDOW = 5, 50
FEATURES = (
    "log_words lexicon_density lexicon_log_count weight_density max_weight strong_density strong_log_count distinct_hits near_second_person second_person_density "
    "upper_share caps_words exclamation_rate question_rate punctuation_rate symbol_rate obfuscated_words obfuscated_hits repeated_letters densest_window"
).split()


def forms(word: str) -> list[str]:
    """What a word can match in the lexicon: itself and its beginnings of 4 to 6 letters."""
    low = word.strip(EDGE).lower()
    return [low, *(low[:n] + "~" for n in (4, 5, 6) if len(low) >= n)] if low else []


def plain(word: str) -> str:
    """A word without the signs that hide it: digits and signs that look like letters, others dropped."""
    return "".join(c for c in word.strip(".,;:?").translate(LEET) if c.isalpha())


class Codes(dict):
    """word -> its code: the lexicon weight in hundredths, then flags. Forgets when it has grown large."""

    HIT, OBFUSCATED_HIT, SECOND, CAPS, OBFUSCATED, REPEATS, STRONG = (1 << k for k in range(12, 19))

    def __init__(self, lexicon: dict[str, float], strong: float):
        self.lexicon, self.strong = lexicon, strong

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        core = word.strip(EDGE)
        hidden = any(not c.isalpha() for c in core) and any(c.isalpha() for c in core)
        weight = max((self.lexicon.get(f, 0.0) for f in forms(word)), default=0.0)
        code = 0
        if not weight and hidden:
            weight = max((self.lexicon.get(f, 0.0) for f in forms(plain(word))), default=0.0)
            code = self.OBFUSCATED_HIT if weight else 0
        code |= min(4095, int(100 * weight)) | (self.HIT if weight else 0) | (self.STRONG if weight >= self.strong else 0)
        code |= self.SECOND if core.lower() in SECOND_PERSON else 0
        code |= self.CAPS if len(core) > 1 and core.isupper() else 0
        code |= self.OBFUSCATED if hidden else 0
        code |= self.REPEATS if REPEATED.search(core) else 0
        self[word] = code
        return code


UPPER = np.arange(65, 91)
LETTERS = np.concatenate((UPPER, np.arange(97, 123)))
PUNCT = np.array([ord(c) for c in ".,;:'\"-()"])
SYMBOLS = np.array([ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"])


def features(text: str | None, codes: Codes) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES; an empty text has zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    code = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    hit, strong, second = (code & codes.HIT) > 0, (code & codes.STRONG) > 0, (code & codes.SECOND) > 0
    weight = (code & 4095) / 100.0
    near = 0
    if hit.any() and second.any():
        you = np.flatnonzero(second)
        at = np.flatnonzero(hit)
        right = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(right, len(you) - 1)]), np.abs(at - you[np.maximum(right - 1, 0)]))
        near = int((gap <= NEAR).sum())
    hits = int(hit.sum())
    summed = np.concatenate(([0], np.cumsum(hit)))
    densest = int((summed[WINDOW:] - summed[:-WINDOW]).max()) if n > WINDOW else hits
    seen = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, len(text))
    flag = lambda bit: float(((code & bit) > 0).sum())
    return [
        math.log1p(n),
        hits / n,
        math.log1p(hits),
        float(weight.sum()) / n,
        float(weight.max()),
        float(strong.sum()) / n,
        math.log1p(float(strong.sum())),
        float(len({w for w, h in zip(words, hit) if h}) if hits else 0),
        near / n,
        float(second.sum()) / n,
        float(seen[UPPER].sum()) / max(1, int(seen[LETTERS].sum())),
        flag(codes.CAPS) / n,
        float(seen[33]) / size,
        float(seen[63]) / size,
        float(seen[PUNCT].sum()) / size,
        float(seen[SYMBOLS].sum()) / size,
        flag(codes.OBFUSCATED) / n,
        flag(codes.OBFUSCATED_HIT) / n,
        flag(codes.REPEATS) / n,
        densest / min(n, WINDOW),
    ]


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4: 0 and 1 grow the lexicon and the trees, 3 calibrates, 2 is held out."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)).cast("int")


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """texts (text, toxic) -> form: log odds of standing in a toxic text, of all significant forms.

    A form counts if three toxic texts have it, its odds are e^2 or more and two standard errors
    above even. There is no other limit: what the driver holds is bounded by the texts, a sample.
    """

    def count(batches):
        toxic, clean = Counter(), Counter()
        for b in batches:
            for text, mark in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (toxic if mark else clean).update({f for w in set((text or "").split()) for f in forms(w)})
        forms_ = list(toxic.keys() | clean.keys())
        for k in range(0, len(forms_), 50_000):
            part = forms_[k : k + 50_000]
            yield pa.record_batch({"form": part, "t": [toxic[f] for f in part], "c": [clean[f] for f in part]}, schema=pa.schema([("form", pa.string()), ("t", pa.int64()), ("c", pa.int64())]))

    sizes = texts.groupBy("toxic").count().collect()
    n_toxic, n_clean = (sum(r["count"] for r in sizes if bool(r["toxic"]) is v) for v in (True, False))
    counts = texts.select("text", "toxic").mapInArrow(count, "form string, t bigint, c bigint").groupBy("form").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (n_toxic + 1)) - F.log(c / (n_clean + 1))
    rated = counts.where("t >= 3").withColumn("weight", odds).withColumn("z", odds / F.sqrt(1 / t + 1 / c))
    return {r["form"]: float(r["weight"]) for r in rated.where("weight >= 2 AND z >= 2").orderBy("form").collect()}


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit_rows: int = MAX_FIT_ROWS, carry: bool = False) -> DataFrame:
    """(id, held_out, score) for every row of docs, with carry also `row`, a struct of all its columns; score is between 0 and 1, higher for toxic texts.

    Learned from labelled rows of folds 0, 1 and 3 (see fold), at most max_fit_rows of them: a
    lexicon of word forms and beginnings by log odds and gradient-boosted trees over FEATURES from
    folds 0 and 1, and an isotonic calibration of the trees' probabilities from fold 3. A score
    depends on the text alone. Each text is read once, whole.

    A null or empty text has features 0 and gets the score that they have. A row without a label,
    or with a null one, teaches nothing; the largest of several labels counts. With labels of
    fewer than two kinds in folds 0 and 1 every score is the share of toxic labels (0 without
    any); with none in fold 3 the scores are not calibrated. Repeated rows and null ids keep
    their rows, a null id is not held out. Only the named columns are read; no rows give no rows.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    marks = marks.withColumn("fold", fold(F.col("id"))).where("fold <> 2")
    fit_rows = F.broadcast(marks.orderBy(F.xxhash64("id"), "id").limit(max_fit_rows))  # bounded by its limit
    short_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = checkpoint(own.select("id", "text").join(fit_rows, "id").repartition(16))
    lexicon = learn_lexicon(texts.where("fold < 2"))
    strong = float(np.quantile(list(lexicon.values()), 0.5)) if lexicon else math.inf
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def dense(frame: DataFrame, keep: str, schema: str) -> DataFrame:
        def run(batches):
            codes = Codes(shared.value, strong)
            for b in batches:
                texts = b.column("row").field(text_col) if "row" in keep.split() else b.column("text")
                rows = [features(t.as_py(), codes) for t in texts]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep.split()), pa.array(rows, pa.list_(pa.float64()))], names=[*keep.split(), "features"])
            del codes
            trim()

        return frame.mapInArrow(run, schema + ", features array<double>")

    vector = lambda frame: frame.withColumn("features", array_to_vector("features"))
    train = checkpoint(dense(texts.select("toxic", "fold", "text"), "toxic fold", "toxic int, fold int"))
    kind = docs.schema[id_col].dataType.simpleString()
    more = ["row"] if carry else []
    if carry:
        own = docs.select(F.col(id_col).alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    every = dense(own, " ".join(["id", *more]), f"id {kind}" + (f", row {own.schema['row'].dataType.simpleString()}" if carry else ""))
    kinds = {(r["fold"] < 2, r["toxic"]): r["count"] for r in train.groupBy("fold", "toxic").count().collect()}
    held = F.coalesce(fold(F.col("id")) == 2, F.lit(False))
    if len({t for f, t in kinds if f}) < 2:
        share = sum(n for (_, t), n in kinds.items() if t) / max(1, sum(kinds.values()))
        return every.select(F.col("id").alias(id_col), held.alias("held_out"), F.lit(float(share)).alias("score"), *more)
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, maxBins=64, seed=11, checkpointInterval=-1)
    model = trees.fit(vector(train.where("fold < 2")))
    raw = lambda frame: model.transform(vector(frame)).withColumn("raw", vector_to_array("probability")[1])
    score = F.col("raw")
    scored = raw(every).select("id", "raw", *more)
    calibrate = train.where("fold = 3")
    if calibrate.take(1):
        steps = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="calibrated").fit(raw(calibrate).select("raw", F.col("toxic").cast("double").alias("toxic")))
        scored, score = steps.transform(scored), F.col("calibrated")
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"), *more)
