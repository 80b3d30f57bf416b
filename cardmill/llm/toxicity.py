"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration (operator 8).

A lexicon of words and word stems is learned from labelled documents: those that occur
in toxic ones far more often than chance allows (likelihood ratio), so it follows the
data's languages. The trees see rates only: how dense lexicon hits are, how strong the
strongest is, how many stand near a word of the second person, capitals, punctuation,
and how many words are obfuscated (``1d10t``, ``i.d.i.o.t``, ``stuuupid``). Their
probability is calibrated on labelled documents that the trees have not seen.

Fitting takes at most about ``SAMPLE`` labelled rows, picked by a hash of their id and
joined by broadcast; scoring is one pass over all whole texts, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .arrow import raw_texts, text_slices, texts, type_of
from .shingles import shingle_sets

#: Labelled rows that the fit takes, about.
SAMPLE = 20_000
FOLDS = 5
TREES, DEPTH = 12, 3
STEMS = (4, 5, 6)
#: Documents with an entry of the lexicon, its likelihood ratio and its log odds, at least.
FEWEST, EVIDENCE, ODDS = 3, 24.0, 2.0
#: Words on either side in which a second person counts as near.
NEAR = 3
KNOWN = 200_000
#: Bytes of texts that are worked on at once.
SLICE = 1 << 19
#: Share of the uncalibrated probability in a score: it orders documents of equal calibrated score.
TIE = 0.001
VALUES = "__values"

FEATURES = (
    "hits", "density", "strongest", "strength", "different", "near_person", "persons", "capitals", "shouted",
    "exclamations", "punctuation", "hidden_hits", "obfuscated", "length",
)

SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ya ur tu te toi vous votre vos ton ta tes du dich dir dein deine euch euer "
    "tú ti usted ustedes vosotros vuestro".split()
)
EDGES = ".,;:!?\"'()[]{}<>«»„“”’‘…-–—*_~#/\\|"
LEET = str.maketrans("013457@$!|€", "oieastasiie")
LETTERS = re.compile(r"[^\W\d_]+")
NO_LETTER = re.compile(r"[\W\d_]+")
REPEATED = re.compile(r"(.)\1{2,}")
_SIGNS = [ord(c) for c in "!?.,;:\"'()[]{}-*#@$%&/\\|"]


def entries(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, and its stems with a trailing star."""
    return [word, *(word[:size] + "*" for size in STEMS if len(word) > size)]


def plain_words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Marks(dict):
    """Index of the marks of each token, worked out when it is first met.

    ``weight`` is the log odds of the strongest lexicon entry, 0 without one; ``flags``
    has 1 for an obfuscated form, 2 for a hit only through it, 4 for a second person, 8
    for a shouted word.
    """

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.weight: list[float] = []
        self.flags: list[int] = []

    def _strongest(self, words: list[str]) -> float:
        return max((self.lexicon.get(entry, 0.0) for word in words for entry in entries(word)), default=0.0)

    def __missing__(self, token: str) -> int:
        core = token.strip(EDGES)
        lower = core.lower()
        weight, flags = self._strongest(LETTERS.findall(lower)), 0
        if not core.isalpha() or REPEATED.search(lower):
            straight = NO_LETTER.sub("", token.lower().strip("\"'.,;:?()").translate(LEET))
            single = REPEATED.sub(r"\1", straight)
            if LETTERS.search(lower) and (single != straight or not core.isalpha()):
                flags = 1
                hidden = self._strongest([word for word in (straight, single) if word])
                if hidden > weight:
                    weight, flags = hidden, 3
        if lower in SECOND_PERSON:
            flags |= 4
        if len(core) > 2 and core.isupper():
            flags |= 8
        self[token] = len(self.weight)
        self.weight.append(weight)
        self.flags.append(flags)
        return self[token]

    def features(self, text: str) -> list[float]:
        if len(self) > KNOWN:
            self.clear()
            self.weight.clear()
            self.flags.clear()
        tokens = text.split()
        if not tokens:
            return [0.0] * len(FEATURES)
        at = list(map(self.__getitem__, tokens))
        kinds, places = np.unique(np.array(at), return_inverse=True)
        weight = np.array([self.weight[k] for k in kinds])[places]
        flags = np.array([self.flags[k] for k in kinds])[places]
        hit = weight > 0
        hits, words = int(hit.sum()), len(tokens)
        near = 0
        if hits and (flags & 4).any():
            persons = np.flatnonzero(flags & 4)
            spots = np.flatnonzero(hit)
            gap = np.abs(persons[np.clip(np.searchsorted(persons, spots), 0, len(persons) - 1)] - spots)
            before = np.abs(persons[np.clip(np.searchsorted(persons, spots) - 1, 0, len(persons) - 1)] - spots)
            near = int((np.minimum(gap, before) <= NEAR).sum())
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        capitals, letters = int(raw[65:91].sum()), int(raw[65:91].sum() + raw[97:123].sum())
        return [
            float(hits), hits / words, float(weight.max()), float(weight.sum()) / words, float(len(set(np.array(at)[hit]))),
            float(near), float((flags & 4 > 0).sum()) / words, capitals / max(letters, 1), float((flags & 8 > 0).sum()) / words,
            float(raw[33]) / words, float(raw[_SIGNS].sum()) / words, float((flags & 2 > 0).sum()),
            float((flags & 1).sum()) / words, float(np.log1p(words)),
        ]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of the whole set of shingles: equal for copies, and for nothing else that will ever be met."""
    for batch in text_slices(batches, 3, SLICE):
        sets = shingle_sets(raw_texts(batch.column(3)))
        digest = pa.array([hashlib.sha256(own.tobytes()).hexdigest() for own in sets], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, digest], ["marked", "toxic", "fold", "text", "sketch"])


def with_features(rows: DataFrame, lexicon: dict[str, float], text: str, keep: list[str], name: str) -> DataFrame:
    """The ``keep`` columns and ``name``, the features of a text in the order of ``FEATURES``.

    A null text is empty, an empty text has zeros. Texts go to Python once, a few megabytes at a time.
    """
    names = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, at = Marks(lexicon), names.index(text)
        for batch in text_slices(batches, at, SLICE):
            values = [marks.features(value) for value in texts(batch.column(at))]
            flat = pa.array([value for row in values for value in row], pa.float64())
            ends = pa.array(np.arange(len(values) + 1) * len(FEATURES), pa.int32())
            columns = [batch.column(names.index(column)) for column in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, flat)], [*keep, name])

    quoted = [F.col(f"`{column}`") for column in names]
    narrow = rows.select(*quoted)
    schema = T.StructType([*(narrow.schema[column] for column in keep), T.StructField(name, T.ArrayType(T.DoubleType()))])
    return narrow.mapInArrow(run, schema)


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log odds of words and stems that ``rows`` (``toxic, text``) show to mark toxic documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = (Counter(), Counter())
        for batch in text_slices(batches, 1, SLICE):
            for toxic, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                sides[toxic].update({entry for word in set(plain_words(text)) for entry in entries(word)})
        found = list(sides[0].keys() | sides[1].keys())
        columns = [pa.array(found, pa.string()), *(pa.array([side[entry] for entry in found], pa.int64()) for side in sides)]
        yield pa.RecordBatch.from_arrays(columns, ["entry", "clean", "toxic"])

    totals = {row["toxic"]: row["n"] for row in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return {}
    share = totals[1] / (totals[0] + totals[1])
    sums = rows.select("toxic", "text").mapInArrow(count, "entry string, clean long, toxic long")
    sums = sums.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = sums.filter(F.col("toxic") >= FEWEST)
    both = F.col("toxic") + F.col("clean")
    ratio = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / (both * share))
        + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))).otherwise(0.0)
    )
    odds = F.log((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1))
    strong = sums.select("entry", odds.alias("odds"), ratio.alias("ratio"))
    return {row["entry"]: row["odds"] for row in strong.filter((F.col("odds") >= ODDS) & (F.col("ratio") >= EVIDENCE)).collect()}


@dataclass
class Toxicity:
    """A fitted model; without trees every text gets the share of toxic labels."""

    lexicon: dict[str, float]
    share: float
    trees: GBTClassificationModel | None = None
    scale: IsotonicRegressionModel | None = None

    def score(self, docs: DataFrame, keep: list[str] | None = None, name: str = "toxicity") -> DataFrame:
        """The ``keep`` columns of ``docs``, all by default, and the score ``name``, 0 to 1; a column of that name is replaced."""
        keep = [column for column in (docs.columns if keep is None else keep) if column != name]
        if self.trees is None:
            return docs.select(*(f"`{column}`" for column in keep), F.lit(float(self.share)).alias(name))
        rows = with_features(docs, self.lexicon, "text", keep, VALUES)
        # The model's columns have fixed names, so those of the documents stand aside in a struct.
        rows = rows.select(F.struct(*(f"`{column}`" for column in keep)).alias("__row"), array_to_vector(VALUES).alias("features"))
        rows = _probability(self.trees, rows)
        scored = F.col("raw")
        if self.scale is not None:
            rows = self.scale.transform(rows)
            scored = (1 - TIE) * F.col("calibrated") + TIE * F.col("raw")
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scored))
        return rows.select(*(F.col("__row")[column].alias(column) for column in keep), score.alias(name))


def _probability(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    scored = trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])
    return scored.drop("probability", "rawPrediction", "prediction")


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """The remainder that holds a document out; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    """Learn from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``), never from fold 0.

    Of several labels of an id the highest counts; null labels and ids are no labels. Labelled
    documents of equal shingles count once. The fit is the same however rows are partitioned.
    Without documents of both kinds the model is constant.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
    marks = marks.agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    marks = marks.select(F.col("doc_id").alias("marked"), "toxic", fold(F.col("doc_id")).alias("fold")).filter("fold > 0")
    marks = materialise(marks, "marks")
    every, of_million = marks.count(), 1_000_000
    if every > sample:
        marks = marks.filter(F.pmod(F.xxhash64("marked"), F.lit(of_million)) < int(of_million * sample / every))
    own = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # At most about ``sample`` small rows are broadcast.
    rows = own.join(F.broadcast(marks), own["doc_id"] == marks["marked"]).select("marked", "toxic", "fold", "text")
    rows = materialise(rows, "toxic-train")
    # Copies of one document are one witness, the one of the least id; texts that differ in a single shingle are two.
    sketched = rows.mapInArrow(_sketched, f"marked {type_of(rows, 'marked')}, toxic int, fold int, text string, sketch string")
    sketched = materialise(sketched, "toxic-sketched")
    first = sketched.groupBy("toxic", "sketch").agg(F.min(F.struct("marked", F.xxhash64("text").alias("hash"))).alias("first"))
    rows = sketched.join(first, ["toxic", "sketch"]).filter((F.col("marked") == F.col("first.marked")) & (F.xxhash64("text") == F.col("first.hash")))
    rows = materialise(rows.dropDuplicates(["toxic", "sketch"]).select("marked", "toxic", "fold", "text"), "toxic-distinct")
    share = rows.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    lexicon = learn_lexicon(rows)
    # About ``sample`` rows of 14 numbers, in one order: sums of the fit, and so all scores, are the same on every run.
    ready = materialise(with_features(rows, lexicon, "text", ["marked", "toxic", "fold"], "values"), "toxic-features")
    ready = materialise(ready.repartition(1).sortWithinPartitions("marked", "toxic"), "toxic-ordered")
    counts = {(row["calibrates"], row["toxic"]): row["n"] for row in ready.groupBy((F.col("fold") == FOLDS - 1).alias("calibrates"), "toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get((False, 0)) or not counts.get((False, 1)):
        return Toxicity(lexicon, share)
    ready = ready.select(F.col("toxic").cast("double").alias("label"), "fold", array_to_vector("values").alias("features"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5).fit(ready.filter(F.col("fold") < FOLDS - 1))
    scale = None
    if counts.get((True, 0)) and counts.get((True, 1)):
        last = _probability(trees, ready.filter(F.col("fold") == FOLDS - 1)).select("label", "raw")
        scale = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(last)
    return Toxicity(lexicon, share, trees, scale)
