"""Quantities in one common unit per kind: units beside the figure are read, missing ones predicted by a calibrated forest."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.unitwords import figure, said
from ..session import discard, materialise, tidied

#: Bounds of the labelled rows the classifier is fitted on, whatever the corpus size: rows of each unit for the forest,
#: and rows of all units, as they are distributed, for its calibration.
PER_UNIT = 300
SAMPLE = 4_000
#: Calibrated probability from which a predicted unit is converted; rows below it are left for review.
CONFIDENT = 0.95
#: Kinds whose figures a page-wide magnitude multiplies. Rates and temperatures carry none.
_SCALED = frozenset({"money", "mass", "energy", "area", "duration", "count"})

#: Least probability with which the forest must offer a unit that a neighbouring field names.
OFFERED = 0.05

_READ = StructType(
    [StructField("kind", StringType()), StructField("unit", StringType()), StructField("sci", StringType()), StructField("figure", DoubleType()), StructField("scale", DoubleType()), StructField("label", StringType())]
    + [StructField("named", StringType()), StructField("words", ArrayType(StringType()))]
)
_TOKEN = re.compile(r"[^\W\d_]+|[%₹$€£¥₽฿₩°℃]")


def convert(value: float, scale: float | None, magnitude: float | None, unit: tuple) -> float:
    """A figure in the common unit of its kind. ``unit`` is ``(kind, name, factor)``.

    A scale in words counts once; a magnitude counts only where no words give a scale, because it repeats them, and
    1 or nothing may just be unfilled.
    """
    kind, name, factor = unit
    if scale is None and kind in _SCALED and magnitude is not None and not math.isnan(magnitude) and magnitude > 0:
        scale = magnitude
    scaled = value * (scale or 1.0)
    if name == "fahrenheit":
        return (scaled - 32) * 5 / 9
    if name == "kelvin":
        return scaled - 273.15
    return scaled * factor


def common_unit(unit: tuple) -> str:
    return "celsius" if unit[0] == "temperature" else unit[1]


def _unit_label(unit: tuple) -> str:
    return f"{unit[0]}|{unit[1]}|{unit[2]!r}"


def words_of(*texts: str | None) -> list[str]:
    """Words and signs of unit wordings, lower-cased; words of scripts without spaces also by character."""
    out: dict[str, None] = {}
    for t in texts:
        for w in _TOKEN.findall(unicodedata.normalize("NFKC", t).lower()) if isinstance(t, str) else ():
            out[w] = None
            if len(w) > 1 and ord(w[0]) > 0xDFF:
                out |= dict.fromkeys(w)
    return list(out)


def _told(places: list) -> tuple[float | None, tuple | None]:
    """``(scale, unit)`` of the first places that state one; a mere count gives way to a later unit."""
    scale = unit = None
    for place in places:
        s, c, u = said(place if isinstance(place, str) else None)
        scale = scale or s
        got = ("money", c, 1.0) if c else u
        if unit is None or unit[0] == "count" and got:
            unit = got or unit
    return scale, unit


def read_one(raw, unit, magnitude, header, measure, lang) -> tuple:
    """``(kind, common unit, printed value, figure, scale, label, named, words)`` of one quantity.

    A unit counts as stated where it stands beside the figure: in the text itself or in the unit field; kind is None
    where none does, and so it is for a mere count that a neighbouring field contradicts. ``named`` is the unit that
    the neighbouring fields (column heading, bracket after the measure name) name, and ``words`` is how the unit is
    worded: beside the figure where it is stated, else in those fields. A scale is taken from the first place that
    gives one, whichever it is.
    """
    got = figure(raw, lang)
    if got is None:
        return (None,) * 8
    value, around = got
    bracket = measure[measure.index("(") :] if isinstance(measure, str) and "(" in measure else None
    scale, stated = _told([around, unit])
    far_scale, near = _told([header, bracket])
    scale = scale or far_scale
    named = _unit_label(near) if near else None
    if stated is None or stated[0] == "count" and near and near[0] != "count":
        return None, None, None, value, scale, None, named, words_of(header, bracket)
    printed = f"{convert(value, scale, magnitude, stated):.4e}"
    return stated[0], common_unit(stated), printed, value, scale, _unit_label(stated), named, words_of(around, unit)


@pandas_udf(_READ)
def read_quantity(raw: pd.Series, unit: pd.Series, magnitude: pd.Series, header: pd.Series, measure: pd.Series, lang: pd.Series) -> pd.DataFrame:
    rows = [read_one(*x) for x in zip(raw, unit, magnitude, header, measure, lang, strict=True)]
    return pd.DataFrame(rows, columns=_READ.names).astype({"figure": "float64", "scale": "float64"})


@pandas_udf(StringType())
def _printed(value: pd.Series, scale: pd.Series, magnitude: pd.Series, label: pd.Series) -> pd.Series:
    out = []
    for v, s, m, x in zip(value, scale, magnitude, label, strict=True):
        kind, name, factor = x.split("|")
        out.append(f"{convert(v, None if s is None or math.isnan(s) else s, m, (kind, name, float(factor))):.4e}")
    return pd.Series(out, dtype=object)


def _exact(df: DataFrame) -> DataFrame:
    """Adds what ``convert`` gives before it is printed: ``unit``, ``multiplier`` and ``canonical_value`` by the label."""
    parts = F.split("label", r"\|")
    carried = F.when(parts[0].isin(*sorted(_SCALED)) & (F.col("magnitude") > 0) & ~F.isnan("magnitude"), F.col("magnitude"))
    scale = F.coalesce(F.when(~F.isnan("scale") & (F.col("scale") != 0), F.col("scale")), carried, F.lit(1.0))
    scaled, factor = F.col("figure") * scale, parts[2].cast("double")
    value = F.when(parts[1] == "fahrenheit", (scaled - 32) * 5 / 9).when(parts[1] == "kelvin", scaled - 273.15).otherwise(scaled * factor)
    step = F.when(parts[1] == "fahrenheit", scale * 5 / 9).otherwise(scale * factor)
    return df.withColumns({"unit": parts[1], "multiplier": step, "canonical_value": value})


def features(df: DataFrame) -> DataFrame:
    """Columns the classifier sees: size of the figure, its form, and the neighbouring fields with their words."""
    text = lambda c: F.coalesce(c, F.lit("none"))
    return df.withColumns(
        {
            "f_size": F.coalesce(F.log10(F.greatest(F.abs("figure"), F.lit(1e-9))), F.lit(0.0)),
            "f_sign": F.when(F.col("figure") < 0, 1.0).otherwise(0.0),
            "f_whole": F.when(F.col("figure") == F.floor("figure"), 1.0).otherwise(0.0),
            "f_scale": F.coalesce(F.log10(F.when(F.col("magnitude") > 0, F.col("magnitude"))), F.lit(0.0)),
            "f_kind": text(F.col("hint")),
            "f_measure": text(F.col("measure_key")),
            "f_source": text(F.col("source")),
        }
    )


_BARE, _WORDY = ["f_size", "f_sign", "f_whole", "f_scale"], ["f_kind", "f_measure", "f_source"]
_NUMERIC = [*_BARE, "f_worded", "f_gap"]


class Wordings:
    """Which unit a wording speaks for, learnt from labelled rows: counts of words by label, read as naive Bayes."""

    def __init__(self, rows: list[tuple[list[str], int]], labels: int):
        self.labels = labels
        self.counts: dict[str, Counter] = {}
        self.totals: Counter = Counter()
        for words, label in rows:
            self.totals[label] += 1
            for w in words:
                self.counts.setdefault(w, Counter())[label] += 1

    def best(self, words: list[str] | None) -> tuple[float, float]:
        """``(label, gap)``: the label the words speak for most, and by how much; ``(-1, 0)`` for words never met."""
        known = [self.counts[w] for w in words if w in self.counts] if words is not None else []
        if not known:
            return -1.0, 0.0
        votes: dict[int, float] = {}
        for label in set().union(*known):
            n = self.totals[label]
            votes[label] = sum(math.log((c[label] + 0.01) / (n + 0.02)) for c in known)
        top = sorted(votes.items(), key=lambda x: (-x[1], x[0]))[:2]
        return float(top[0][0]), min(top[0][1] - top[1][1], 20.0) if len(top) > 1 else 20.0


def _worded(df: DataFrame, wordings: Wordings, other: Wordings | None = None) -> DataFrame:
    """Adds ``f_worded, f_gap``; with ``other`` rows of an even ``h`` are read by ``wordings`` and odd ones by ``other``.
    Rows whose words are hidden, or that have none, are worded by nothing."""

    @pandas_udf(_WORDED)
    def read(words: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(other if other is not None and k % 2 else wordings).best(w) for w, k in zip(words, h, strict=True)], columns=["worded", "gap"])

    return df.withColumn("w", read("words", F.col("h") if "h" in df.columns else F.lit(0).cast("bigint"))).withColumns({"f_worded": F.col("w.worded"), "f_gap": F.col("w.gap")}).drop("w")


_WORDED = StructType([StructField("worded", DoubleType()), StructField("gap", DoubleType())])


class Fitted(NamedTuple):
    """The forest for figures with words about them and the one for figures without, their labels, and for each kind the
    curve that calibrates the top probability (after ``~``: without words)."""

    model: PipelineModel
    bare: PipelineModel
    wordings: Wordings
    labels: list[str]
    curves: dict[str, list[tuple[float, float]]]
    accuracy: dict[str, tuple[int, int]]


def isotonic(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The rising step curve nearest to ``(score, outcome)`` points, as ``(least score, value)`` steps (pooled neighbours)."""
    pools: list[list[float]] = []
    for x, y in sorted(points):
        pools.append([x, y, 1.0])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            x2, y2, n2 = pools.pop()
            x1, y1, n1 = pools[-1]
            pools[-1] = [x1, (y1 * n1 + y2 * n2) / (n1 + n2), n1 + n2]
    return [(x, y) for x, y, _ in pools]


#: Held-out rows a kind needs for a curve of its own; kinds with fewer share the curve of all.
OWN_CURVE = 30


def _forest(rows: DataFrame, numbers: list[str], seed: int, trees: int, depth: int) -> PipelineModel:
    """A forest over labelled rows, from the stated numbers and the hashed fields; labels count in order of code point."""
    steps = [
        FeatureHasher(inputCols=_WORDY, outputCol="v_fields", numFeatures=64),
        # The numbers have slots of their own, which no hashed field shares.
        VectorAssembler(inputCols=[*numbers, "v_fields"], outputCol="features"),
        StringIndexer(inputCol="label", outputCol="y", handleInvalid="skip", stringOrderType="alphabetAsc"),
        RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="0.5"),
    ]
    fitted = Pipeline(stages=steps).fit(rows)
    return PipelineModel([*fitted.stages[:2], fitted.stages[3]])


def train(labelled: DataFrame, per_unit: int = PER_UNIT, sample: int = SAMPLE, seed: int = 7) -> Fitted | None:
    """A random forest over quantities whose unit stands beside them, and curves that calibrate its top probability.

    Rows are chosen by a hash of the id. Three quarters of all are for the forest, ``per_unit`` rows of each unit at
    most; of the others ``sample`` at most calibrate it, each kind on its own where it has ``OWN_CURVE`` of them.
    ``accuracy`` holds their right and all by kind. The words of a row are read by counts of the half it is not in, so
    that no row has seen itself. A second forest sees the same rows without their words, for figures that have none; it
    has curves of its own. None where the sample has no two labels to tell apart or too few rows to calibrate.
    """
    spark = labelled.sparkSession
    hashed = features(labelled).withColumn("h", F.xxhash64("id", F.lit(seed))).select("label", "h", "words", *_BARE, *_WORDY)
    held = F.pmod("h", F.lit(4)) == 0
    ranked = hashed.where(~held).withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("rank") <= per_unit).drop("rank")
    rows, path = materialise(ranked.withColumn("for_fit", F.lit(True)).unionByName(hashed.where(held).orderBy("h").limit(sample).withColumn("for_fit", F.lit(False))), "units")
    fit_rows = rows.where("for_fit").select("label", "words", "h").collect()
    labels = sorted({r["label"] for r in fit_rows})
    if len(labels) < 2:
        discard(spark, path)
        return None
    index = {x: i for i, x in enumerate(labels)}
    halves = [Wordings([(r["words"], index[r["label"]]) for r in fit_rows if r["h"] % 2 == k], len(labels)) for k in (1, 0)]
    wordings = Wordings([(r["words"], index[r["label"]]) for r in fit_rows], len(labels))
    for_fit = _worded(rows.where("for_fit"), *halves)
    model, bare = _forest(for_fit, _NUMERIC, seed, 20, 12), _forest(for_fit, _BARE, seed, 20, 12)
    held_out = _worded(rows.where("not for_fit"), wordings)
    scored = model.transform(held_out.where("f_worded >= 0")).withColumn("worded", F.lit(True)).unionByName(bare.transform(held_out).withColumn("worded", F.lit(False)))
    judged = scored.select("label", F.array_max(_array("probability")).alias("p"), F.col("prediction").cast("int").alias("i"), "worded").collect()
    discard(spark, path)
    if len(judged) < 20:
        return None
    points: dict[str, list[tuple[float, float]]] = {"": [], "~": []}
    accuracy: dict[str, list[int]] = {}
    for label, p, i, worded in judged:
        right = float(labels[i] == label)
        mark = "" if worded else "~"
        points[mark].append((p, right))
        points.setdefault(mark + labels[i].split("|")[0], []).append((p, right))
        if worded:
            counts = accuracy.setdefault(label.split("|")[0], [0, 0])
            counts[0] += int(right)
            counts[1] += 1
    curves = {k: isotonic(v) for k, v in points.items() if k in ("", "~") or len(v) >= OWN_CURVE}
    return Fitted(model, bare, wordings, labels, curves, {k: (a, b) for k, (a, b) in accuracy.items()})


def _array(vector: str) -> Column:
    return vector_to_array(F.col(vector))


def _calibrated(kind: Column, p: Column, worded: Column, curves: dict[str, list[tuple[float, float]]]) -> Column:
    """The curve of a kind at ``p``, else that of all; figures without words have curves of their own."""

    def at(steps: list[tuple[float, float]]) -> Column:
        if not steps:
            return F.lit(0.0)
        return F.element_at(F.filter(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps]), lambda s: (s["x"] <= p) | (s["x"] == steps[0][0])), -1)["y"]

    def of(mark: str) -> Column:
        out = at(curves[mark])
        for k, steps in curves.items():
            if k.startswith(mark) and k.removeprefix(mark).isalpha():
                out = F.when(kind == k.removeprefix(mark), at(steps)).otherwise(out)
        return out

    return F.when(worded, of("")).otherwise(of("~"))


def predict(unlabelled: DataFrame, fitted: Fitted) -> DataFrame:
    """Adds to quantities without a unit beside them the forest's ``label`` with its calibrated ``probability``, and
    ``offered``, the probability it gives to the unit that a neighbouring field names."""
    worded = _worded(features(unlabelled), fitted.wordings)
    scored = fitted.model.transform(worded.where("f_worded >= 0")).unionByName(fitted.bare.transform(worded.where("f_worded < 0"))).withColumn("ps", _array("probability"))
    names = F.array(*map(F.lit, fitted.labels))
    place = F.array_position(names, F.col("named"))
    named = scored.withColumns({"label": F.element_at(names, F.col("prediction").cast("int") + 1), "p": F.array_max("ps"), "offered": F.when(place > 0, F.element_at("ps", place.cast("int")))})
    return named.withColumn("probability", _calibrated(F.split("label", r"\|")[0], F.col("p"), F.col("f_worded") >= 0, fitted.curves)).drop("ps", "p", "rawPrediction", "prediction", "features", "v_fields")


def read_facts(facts: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per fact with a quantity: what its texts state, with the fields the classifier needs.

    Of rows delivered twice the one extracted last counts. The language is that of the document's source; without a
    known source figures are read with decimal points.
    """
    habits = documents.select("doc_id", "source").join(sources.select("source", "lang"), "source").dropDuplicates(["doc_id"])
    said_ = facts.where("id is not null and quantity.raw is not null").select(
        "id", "doc_id", "extracted_at", F.col("quantity.raw").alias("raw"), F.col("quantity.unit").alias("unit_field"), F.col("quantity.magnitude").alias("magnitude"), F.col("quantity.kind").alias("hint"), "header", "measure_raw", "measure_key"
    )
    df = said_.join(habits, "doc_id", "left").withColumn("q", read_quantity("raw", "unit_field", "magnitude", "header", "measure_raw", "lang"))
    row = F.struct("q.*", "magnitude", "hint", "measure_key", "source")
    last = df.groupBy("id").agg(F.max_by(row, F.coalesce("extracted_at", F.lit("1900-01-01").cast("timestamp"))).alias("r"))
    return last.select("id", "r.*").where("figure is not null")


@tidied
def settled(facts: DataFrame, documents: DataFrame, sources: DataFrame, confident: float = CONFIDENT) -> tuple[DataFrame, DataFrame]:
    """Two tables: quantities in common units (``id, kind, canonical_unit, canonical_sci, way`` and, not rounded,
    ``canonical_value`` with the ``unit`` and ``multiplier`` of its figure), and those for review.

    A unit beside its figure is read (``way`` "stated"). Where none stands there, the forest decides from the figure's
    size, its source, its measure and the words of the neighbouring fields. An exact check follows: where those fields
    name a unit, the forest must offer that one (with ``OFFERED`` at least), and it is taken ("confirmed"); where they
    name none, the forest's own choice is taken at ``confident`` calibrated probability or more ("predicted"). All
    others go to review: ``id, label, probability, named``.

    Cases: a quantity without a readable figure has no row; a null or unfilled field states nothing; ties of
    probability go to the more frequent unit; empty tables give two empty results; extra columns are not read. With
    too few labelled rows to fit and calibrate, every quantity without a unit beside it goes to review.
    """
    read, _ = materialise(read_facts(facts, documents, sources), "quantities")
    stated = read.where("kind is not null")
    missing = read.where("kind is null").drop("label")
    exact = ("canonical_value", "unit", "multiplier")
    done = _exact(stated.withColumnRenamed("unit", "canonical_unit")).select("id", "kind", "canonical_unit", F.col("sci").alias("canonical_sci"), F.lit("stated").alias("way"), *exact)
    fitted = train(stated)
    if fitted is None:
        return done, missing.selectExpr("id", "cast(null as string) as label", "cast(null as double) as probability", "named")
    guessed, _ = materialise(predict(missing, fitted).select("id", "figure", "scale", "magnitude", "label", "probability", "named", "offered"), "guessed")
    way = F.when(F.col("named").isNotNull(), F.when(F.col("offered") >= OFFERED, "confirmed")).when(F.col("probability") >= confident, "predicted")
    judged = guessed.withColumn("way", way)
    sure = judged.where("way is not null").withColumn("label", F.coalesce("named", "label"))
    parts = F.split("label", r"\|")
    added = _exact(sure).select("id", parts[0].alias("kind"), F.when(parts[0] == "temperature", "celsius").otherwise(parts[1]).alias("canonical_unit"), _printed("figure", "scale", "magnitude", "label").alias("canonical_sci"), "way", *exact)
    return done.unionByName(added), judged.where("way is null").select("id", "label", "probability", "named")


def measured_facts(facts: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, canonical_unit, canonical_sci`` of every fact that is money, a percentage, a mass, a duration, energy, an
    area or a temperature, once per ``id``; counts are no case."""
    return settled(facts, documents, sources)[0].where("kind <> 'count'").select("id", "canonical_unit", "canonical_sci")
