"""Splits, folds and the feature recipe as ``pyspark.ml`` stages.

Every stage learns from the table it is fitted on and from nothing else. The
stages only use column expressions, so a fitted recipe adds no shuffle to scoring.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmill.functions.naming import level_suffix
from parcelmill.functions.numeric import log10_positive
from parcelmill.operators.aggregates import quantiles
from parcelmill.operators.relational import longer
from parcelmill.operators.windows import hash_order, hash_rank, slice_digits
from parcelmill.runtime import lookup_join, settle

# --- splits ------------------------------------------------------------------


def split(
    df: DataFrame, row_id: str, seed: int, prop: float = 0.75, strata: str | None = None, bins: int = 4
) -> DataFrame:
    """Add ``split``: ``train`` for the first ``prop`` of the rows in hash order, else ``test``.

    With ``strata``, the rule holds inside each quantile bin of that numeric column.
    Only the rows of the one hash slice that holds the border are ranked, to find
    the last training row; labelling then compares each row with it and moves no row.
    """
    text_id = F.col(row_id).cast("string")
    value = F.col(strata) if strata else F.lit(None).cast("double")
    # Many passes look for the borders; they go over these columns only.
    narrow = settle(df.select(hash_order(seed, row_id).alias("__h"), text_id.alias("__id"), value.alias("__v")))

    def bin_of(x: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(x > cuts[name], F.lit(False)).cast("int") for name in marks], F.lit(0))

    marks = {f"b{i}": i / bins for i in range(1, bins)} if strata else {}
    if strata:
        cuts = settle(quantiles(narrow, [], "__v", marks)).select(F.struct(*marks).alias("cuts")).scalar()
    hashed = df.withColumns({"__bin": bin_of(value), "__h": hash_order(seed, row_id)})
    border = _last_training_rows(narrow.select(bin_of(F.col("__v")).alias("__bin"), "__h", "__id"), prop)
    joined = lookup_join(hashed, border, ["__bin"], base_table=True)
    before = (F.col("__h") < F.col("last_h")) | ((F.col("__h") == F.col("last_h")) & (text_id <= F.col("last_id")))
    label = F.when(before, F.lit("train")).otherwise(F.lit("test"))
    return joined.withColumn("split", label).drop("__bin", "__h", "last_h", "last_id")


def _last_training_rows(hashed: DataFrame, prop: float) -> DataFrame:
    """(__bin, last_h, last_id): the last row of each bin that still is a training row."""
    digits = slice_digits(hashed)
    sliced = hashed.withColumn("__slice", F.substring("__h", 1, digits))
    sizes = settle(sliced.groupBy("__bin", "__slice").agg(F.count(F.lit(1)).alias("c")))
    totals = sizes.groupBy("__bin").agg(F.sum("c").alias("total"))
    # 16 ** digits rows per bin.
    upto = F.sum("c").over(Window.partitionBy("__bin").orderBy("__slice"))
    placed = lookup_join(sizes.withColumn("end", upto), totals, ["__bin"]).withColumn(
        "want", F.floor(F.col("total") * F.lit(float(prop)))
    )
    hit = (F.col("end") - F.col("c") < F.col("want")) & (F.col("want") <= F.col("end"))
    border = placed.where(hit).select("__bin", "__slice", (F.col("want") - F.col("end") + F.col("c")).alias("nth"))
    rows = lookup_join(sliced, border, ["__bin", "__slice"], "inner")
    place = F.row_number().over(Window.partitionBy("__bin").orderBy("__h", "__id"))
    last = rows.withColumn("r", place).where(F.col("r") == F.col("nth"))
    return settle(last.select("__bin", F.col("__h").alias("last_h"), F.col("__id").alias("last_id")))


def folds(df: DataFrame, row_id: str, seed: int, v: int = 10, name: str = "fold") -> DataFrame:
    """Add a fold number from 1 to ``v``; fold sizes differ by one row at most."""
    ranked = hash_rank(df, row_id, seed, (), "__rank")
    return ranked.withColumn(name, ((F.col("__rank") - 1) % v + 1).cast("long")).drop("__rank")


# --- roles -------------------------------------------------------------------


@dataclass
class Roles:
    """What each column is for; columns without a role stay on the table unused."""

    row_id: str = "par_id"
    outcome: str = "sale_price_adj"
    metadata: list[str] = field(default_factory=lambda: ["longitude", "latitude", "year_blt"])
    numeric: list[str] = field(
        default_factory=lambda: [
            "house_age_at_sale", "sale_year", "lot_area", "finished_living_area",
            "bedrooms", "fullbaths", "halfbaths",
        ]
    )
    nominal: list[str] = field(
        default_factory=lambda: [
            "geo_id", "style_desc", "grade_desc", "condition_desc", "ac_flag", "heat_type", "sale_month",
        ]
    )

    def table(self, df: DataFrame) -> list[tuple[str, str]]:
        roles = {self.row_id: "id", self.outcome: "outcome"}
        roles.update({c: "metadata" for c in self.metadata})
        roles.update({c: "predictor" for c in [*self.numeric, *self.nominal]})
        return [(c, roles.get(c, "unused")) for c in df.columns]


def with_label(df: DataFrame, outcome: str = "sale_price_adj", label: str = "label") -> DataFrame:
    """log10 of the outcome, for training only; truth stays in dollars."""
    return df.withColumn(label, log10_positive(F.col(outcome)))


# --- stages ------------------------------------------------------------------


def _param(name: str, convert=TypeConverters.identity) -> Param:
    return Param(Params._dummy(), name, name, convert)


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    def _settings(self, **values):
        for name, value in values.items():
            if value is not None:
                self._set(**{name: value})

    def _value(self, name: str):
        return self.getOrDefault(self.getParam(name))


class TextColumns(Transformer, _Stage):
    """Columns as text; logical values become TRUE and FALSE."""

    columns = _param("columns", TypeConverters.toListString)

    def __init__(self, columns: Sequence[str] | None = None):
        super().__init__()
        self._settings(columns=columns)

    def _transform(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        texts = {
            c: F.upper(F.col(c).cast("string")) if kinds[c] == "boolean" else F.col(c).cast("string")
            for c in self._value("columns")
        }
        return df.withColumns(texts)


class ValueRules(Transformer, _Stage):
    """Recode one column: listed values to a new one, missing to one, others kept or to one."""

    column = _param("column", TypeConverters.toString)
    groups = _param("groups")
    missing = _param("missing", TypeConverters.toString)
    otherwise = _param("otherwise", TypeConverters.toString)

    def __init__(self, column=None, groups=None, missing=None, otherwise=None):
        super().__init__()
        self._settings(column=column, groups=groups, missing=missing, otherwise=otherwise)

    def _transform(self, df: DataFrame) -> DataFrame:
        name = self._value("column")
        x = F.col(name)
        fallback = F.lit(self._value("otherwise")) if self.isSet("otherwise") else x
        case = F.when(x.isNull(), F.lit(self._value("missing")) if self.isSet("missing") else F.lit(None))
        for new, old in self._value("groups").items():
            case = case.when(x.isin(*old), F.lit(new))
        return df.withColumn(name, case.otherwise(fallback))


class FillMissing(Transformer, _Stage):
    """Put one learnt value per column in place of missing ones."""

    values = _param("values")

    def __init__(self, values: dict | None = None):
        super().__init__()
        self._settings(values=values)

    def _transform(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        filled = {}
        for name, value in self._value("values").items():
            # An integer column takes a fractional median as a double.
            kind = "double" if isinstance(value, float) else kinds[name]
            filled[name] = F.coalesce(F.col(name).cast(kind), F.lit(value).cast(kind))
        return df.withColumns(filled)


class ModeImputer(Estimator, _Stage):
    """Most frequent value per column; ties go to the smallest."""

    columns = _param("columns", TypeConverters.toListString)

    def __init__(self, columns: Sequence[str] | None = None):
        super().__init__()
        self._settings(columns=columns)

    def _fit(self, df: DataFrame) -> FillMissing:
        return FillMissing({row["name"]: row["mode"] for row in modes(df, self._value("columns")).collect()})


class MedianImputer(Estimator, _Stage):
    """Exact median per numeric column."""

    columns = _param("columns", TypeConverters.toListString)

    def __init__(self, columns: Sequence[str] | None = None):
        super().__init__()
        self._settings(columns=columns)

    def _fit(self, df: DataFrame) -> FillMissing:
        rows = medians(df, self._value("columns")).collect()
        return FillMissing({r["name"]: float(r["median"]) for r in rows if r["median"] is not None})


class PoolRare(Transformer, _Stage):
    """Keep learnt levels, turn all others (unseen ones too) into the pooled level."""

    kept = _param("kept")
    other = _param("other")

    def __init__(self, kept: dict | None = None, other: dict | None = None):
        super().__init__()
        self._settings(kept=kept, other=other)

    def _transform(self, df: DataFrame) -> DataFrame:
        pooled = {}
        for name, levels in self._value("kept").items():
            x = F.col(name)
            keep = x.isin(*levels) if levels else F.lit(False)
            pooled[name] = F.when(keep | x.isNull(), x).otherwise(F.lit(self._value("other")[name]))
        return df.withColumns(pooled)


class RareLevels(Estimator, _Stage):
    """Pool levels below a share (threshold under one) or a count (one and more)."""

    thresholds = _param("thresholds")
    other = _param("other")

    def __init__(self, thresholds: dict | None = None, other: dict | None = None):
        super().__init__()
        self._settings(thresholds=thresholds, other=other)

    def _fit(self, df: DataFrame) -> PoolRare:
        thresholds = self._value("thresholds")
        kept = {name: [] for name in thresholds}
        # At most 1 / share, or rows / count, levels of a column can be kept.
        for row in kept_levels(df, thresholds).collect():
            kept[row["name"]].append(row["level"])
        return PoolRare({n: sorted(v) for n, v in kept.items()}, self._value("other"))


class DummyColumns(Transformer, _Stage):
    """One 0/1 column ``column_Level.Name`` per level except the reference level.

    All of them are missing where the value is missing or was not seen in training.
    """

    levels = _param("levels")

    def __init__(self, levels: dict | None = None):
        super().__init__()
        self._settings(levels=levels)

    def names(self) -> list[str]:
        return [f"{c}_{level_suffix(v)}" for c, found in self._value("levels").items() for v in found[1:]]

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = [
            F.when(F.col(c).isin(*found), (F.col(c) == v).cast("double")).alias(
                f"{c}_{level_suffix(v)}", metadata={"dummy_of": c}
            )
            for c, found in self._value("levels").items()
            for v in found[1:]
        ]
        return df.select("*", *columns)


class DummyCoder(Estimator, _Stage):
    """Learn levels: the reference level first (if it occurs), the rest in alphabetical order."""

    columns = _param("columns", TypeConverters.toListString)
    references = _param("references")

    def __init__(self, columns=None, references=None):
        super().__init__()
        self._settings(columns=columns, references=references)

    def _fit(self, df: DataFrame) -> DummyColumns:
        columns = self._value("columns")
        found = longer(df, [], columns, "name", "level", "string").where(F.col("level").isNotNull())
        rows = found.distinct().collect()  # as many as the model will have coefficients
        references = self._value("references") or {}
        levels = {}
        for name in columns:
            own = sorted(r["level"] for r in rows if r["name"] == name)
            first = [v for v in own if v == references.get(name)]
            levels[name] = first + [v for v in own if v not in first]
        return DummyColumns(levels)


class DesignVector(Transformer, _Stage):
    """Numeric columns and all dummies of the coder before it as one ``features`` vector.

    Every row stays. ``features`` is missing where a number is missing or a
    category is missing or unknown; such rows can't be used in a fit and get no prediction.
    """

    numeric = _param("numeric", TypeConverters.toListString)

    def __init__(self, numeric=None):
        super().__init__()
        self._settings(numeric=numeric)

    def _transform(self, df: DataFrame) -> DataFrame:
        numeric = self._value("numeric")
        dummies = [f.name for f in df.schema.fields if "dummy_of" in f.metadata]
        parts = [F.col(f"`{c}`").cast("double") for c in [*numeric, *dummies]]
        whole = F.forall(F.array(*parts), lambda x: x.isNotNull())
        # The conversion must not meet a missing entry, whichever branch is worked out first.
        vector = array_to_vector(F.transform(F.array(*parts), lambda x: F.coalesce(x, F.lit(0.0))))
        return df.withColumn("features", F.when(whole, vector)).drop(*[F.col(f"`{c}`") for c in dummies])


# --- the statistics the stages learn -----------------------------------------


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, mode) of text columns."""
    counts = longer(df, [], columns, "name", "value", "string").where(F.col("value").isNotNull())
    counts = counts.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))


def group_modes(df: DataFrame, keys: Sequence[str], column: str, name: str = "mode") -> DataFrame:
    """Most frequent value of a column in each group; ties go to the smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("n"), column)).alias(name))


def impute_mode_within(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Fill missing values by the group's mode, else by the mode of the whole table."""
    local = group_modes(df, keys, column, "__local")
    overall = group_modes(df, [], column, "__overall").scalar()
    joined = lookup_join(df, local, keys)
    return joined.withColumn(column, F.coalesce(column, "__local", overall)).drop("__local")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, median) of numeric columns."""
    return quantiles(longer(df, [], columns, "name", "value", "double"), ["name"], "value", {"median": 0.5})


def kept_levels(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(name, level, n) of levels at or above the threshold of their column."""
    values = longer(df, [], list(thresholds), "name", "level", "string").where(F.col("level").isNotNull())
    counts = settle(values.groupBy("name", "level").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("name").agg(F.sum("n").alias("total"))
    joined = lookup_join(counts, totals, ["name"])
    least = F.lit(None).cast("double")
    for name, threshold in thresholds.items():
        needed = F.lit(float(threshold)) if threshold >= 1 else F.col("total") * F.lit(float(threshold))
        least = F.when(F.col("name") == name, needed).otherwise(least)
    # Where no level is frequent enough, the most frequent one is kept.
    top = counts.groupBy("name").agg(F.max_by("level", F.struct("n", F.col("level"))).alias("top"), F.max("n").alias("top_n"))
    rated = lookup_join(joined, top, ["name"])
    return rated.where((F.col("n") >= least) | ((F.col("top_n") < least) & (F.col("level") == F.col("top")))).select(
        "name", "level", "n"
    )


# --- the recipe --------------------------------------------------------------

# The recodes and reference levels results must reproduce.
CONDITION_GROUPS = {
    "Poor or worse": ["Poor", "Very Poor", "Unsound"],
    "Very Good or better": ["Very Good", "Excellent"],
}
GRADE_GROUPS = {
    "Below Average or worse": ["Below Average", "Poor"],
    "Very Good or better": ["Very Good", "Excellent", "Highest Cost"],
}
REFERENCE_LEVELS = {
    "condition_desc": "Average",
    "grade_desc": "Average",
    "sale_month": "Jun",
    "ac_flag": "TRUE",
    "heat_type": "Central Heat",
}


def recipe_stages(
    roles: Roles | None = None,
    style_share: float = 0.05,
    area_rows: int = 500,
    references: dict[str, str] | None = None,
) -> list:
    """The feature recipe in order: recodes, imputation, pooling, dummies, vector."""
    roles = roles or Roles()
    return [
        TextColumns(["condition_desc", "grade_desc", "ac_flag", "heat_type"]),
        ValueRules(
            "heat_type", {"Central Heat": ["Central Heat"], "None": ["None"]}, "Missing", "Other"
        ),
        ModeImputer(["condition_desc", "grade_desc", "ac_flag"]),
        MedianImputer(["bedrooms", "fullbaths", "halfbaths"]),
        ValueRules("condition_desc", CONDITION_GROUPS),
        ValueRules("grade_desc", GRADE_GROUPS),
        RareLevels(
            {"style_desc": style_share, "geo_id": area_rows},
            {"style_desc": "style_other", "geo_id": "school_other"},
        ),
        DummyCoder(roles.nominal, references or REFERENCE_LEVELS),
        DesignVector(roles.numeric),
    ]


def feature_names(fitted_stages: Sequence) -> list[str]:
    """Names of the entries of ``features``, in order."""
    names: list[str] = []
    for stage in fitted_stages:
        if isinstance(stage, DummyColumns):
            names = [*names, *stage.names()]
        elif isinstance(stage, DesignVector):
            names = [*stage._value("numeric"), *names]
    return names
