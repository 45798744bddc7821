"""The feature recipe as tables: levels with dense numbers, and sparse design rows.

A recipe is learnt for several models at once: model ``k`` of a cross-validation learns from all folds but
``k``. One pass counts the values of the recipe's columns by fold; what a model learns (most frequent values,
medians, kept and pooled levels, numbers of terms) follows from the counts of all rows less those of its fold.

A level is a row of a table with the number of its term, and is joined to the rows that have it. Neither the
plan nor the driver grows with the levels, and a design row holds its non-zero entries only.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmill.operators.recipe import CONDITION_GROUPS, GRADE_GROUPS, REFERENCE_LEVELS, Roles
from parcelmill.runtime import fits, quoted, settle

#: The model of all rows, and the fold of rows that were not dealt into folds.
ALL_ROWS, NO_FOLD = 0, -1


@dataclass
class Category:
    """What becomes of one nominal column, in this order.

    ``named`` values are renamed (a missing one to ``missing``, others to ``otherwise``, where these are given); missing
    ones become the most frequent value if ``impute``; ``groups`` are merged; levels below ``least`` (a share under one, else
    a count) are pooled as ``other``, but never the most frequent one. ``reference`` is the level without a term if it
    occurs, else the first in alphabetical order.
    """

    column: str
    named: dict[str, list[str]] = field(default_factory=dict)
    missing: str | None = None
    otherwise: str | None = None
    impute: bool = False
    groups: dict[str, list[str]] = field(default_factory=dict)
    least: float | None = None
    other: str | None = None
    reference: str | None = None

    def first(self, x: Column) -> Column:
        return _renamed(x, self.named, self.missing, self.otherwise)

    def merged(self, x: Column) -> Column:
        return _renamed(x, self.groups, None, None)


def _renamed(x: Column, groups: dict[str, list[str]], missing: str | None, otherwise: str | None) -> Column:
    case = F.when(x.isNull(), F.lit(missing))
    for new, old in groups.items():
        case = case.when(x.isin(*old), F.lit(new))
    return case.otherwise(x if otherwise is None else F.lit(otherwise))


@dataclass
class Recipe:
    """Numbers (those in ``medians`` have missing values filled by their median) and categories."""

    numeric: Sequence[str] = ()
    medians: Sequence[str] = ()
    categories: Sequence[Category] = ()


def sales_recipe(
    roles: Roles | None = None, style_share: float = 0.05, area_rows: int = 500, references: dict[str, str] | None = None
) -> Recipe:
    """The recipe of ``recipe.recipe_stages``, with the same settings."""
    roles = roles or Roles()
    known = {
        "heat_type": {"named": {"Central Heat": ["Central Heat"], "None": ["None"]}, "missing": "Missing", "otherwise": "Other"},
        "condition_desc": {"impute": True, "groups": CONDITION_GROUPS},
        "grade_desc": {"impute": True, "groups": GRADE_GROUPS},
        "ac_flag": {"impute": True},
        "style_desc": {"least": style_share, "other": "style_other"},
        "geo_id": {"least": area_rows, "other": "school_other"},
    }
    reference = REFERENCE_LEVELS if references is None else references
    categories = [Category(c, **known.get(c, {}), reference=reference.get(c)) for c in roles.nominal]
    medians = [c for c in ("bedrooms", "fullbaths", "halfbaths") if c in roles.numeric]
    return Recipe(roles.numeric, medians, categories)


def prepared(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """``rows`` with the recipe's numbers as ``__x…`` (double) and its categories, as far as no learning is needed, as ``__c…`` (text)."""
    kinds = dict(rows.dtypes)
    made = {f"__x{j}": quoted(name).cast("double") for j, name in enumerate(recipe.numeric)}
    for k, c in enumerate(recipe.categories):
        text = quoted(c.column).cast("string")
        made[f"__c{k}"] = c.first(F.upper(text) if kinds[c.column] == "boolean" else text)
    return rows.withColumns(made) if made else rows


def _by_name(recipe: Recipe, make, otherwise: Column, names: Column | None = None) -> Column:
    """An expression that depends on which category a row of a table of levels belongs to."""
    name = F.col("name") if names is None else names
    return reduce(lambda rest, c: F.when(name == c.column, make(c)).otherwise(rest), recipe.categories, otherwise)


def value_counts(rows: DataFrame, recipe: Recipe, fold: str | None = None) -> DataFrame:
    """(fold, name, value, n) of the ``prepared`` rows: every value (as text) of the categories and of the numbers with medians, in one pass."""
    cells = [F.struct(F.lit(c.column).alias("name"), F.col(f"__c{k}").alias("value")) for k, c in enumerate(recipe.categories)]
    cells += [F.struct(F.lit(name).alias("name"), F.col(f"__x{list(recipe.numeric).index(name)}").cast("string").alias("value")) for name in recipe.medians]
    if not cells:
        return rows.sparkSession.createDataFrame([], "fold long, name string, value string, n long")
    own = F.lit(NO_FOLD) if fold is None else quoted(fold)
    each = rows.select(own.cast("long").alias("fold"), F.explode(F.array(*cells)).alias("cell")).select("fold", "cell.*")
    return each.groupBy("fold", "name", "value").agg(F.count(F.lit(1)).alias("n"))


def less_own_fold(sums: DataFrame, models: Sequence[int], keys: Sequence[str], value: str) -> DataFrame:
    """(k, keys, value): sums over all folds less those of fold ``k``, for each model; ``sums`` has (fold, keys, value)."""
    total = sums.groupBy(*keys).agg(F.sum(value).alias("__total"))
    each = total.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in models])))
    own = sums.select(F.col("fold").alias("__k"), *[F.col(c).alias(f"__{c}") for c in keys], F.col(value).alias("__own"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], F.col("k") == F.col("__k"))
    left = F.col("__total") - F.coalesce("__own", F.lit(0))
    return each.join(own, same, "left").select("k", *keys, left.alias(value))


@dataclass
class Design:
    """What the models of a recipe learnt.

    ``levels``: (k, name, level, n, position, term) of every level a model knows; the reference level has position 1 and
    no term. ``maps``: (k, name, raw, known, term, weight, level, position), what a value before imputation and pooling becomes.
    ``medians`` and ``others`` hold one value for each model and column: the median, and (term, position) of the pooled
    level (term None: it is the reference; absent: no pooled level).
    """

    recipe: Recipe
    models: list[int]
    levels: DataFrame
    maps: DataFrame
    medians: dict[tuple[int, str], float]
    others: dict[tuple[int, str], tuple[int | None, int]]

    @cached_property
    def small(self) -> bool:
        """Whether ``maps`` can be broadcast; the rows that meet it are then not shuffled by their few levels."""
        return fits(self.maps)


def learn(rows: DataFrame, recipe: Recipe, fold: str | None = None, v: int = 0) -> Design:
    """Learn from ``prepared`` rows: model 0 from all, or models 1 to ``v`` from all folds but their own."""
    models = list(range(1, v + 1)) if fold else [ALL_ROWS]
    counts = settle(value_counts(rows, recipe, fold))
    seen = less_own_fold(counts, models, ["name", "value"], "n")
    numbers = list(recipe.medians)
    with ThreadPoolExecutor(2) as pool:
        middle = pool.submit(lambda: _medians(seen.where(F.col("name").isin(*numbers))).collect() if numbers else [])
        levels, maps, others = _levels(seen.where(~F.col("name").isin(*numbers)) if numbers else seen, recipe)
        medians = {(r["k"], r["name"]): r["median"] for r in middle.result()}
    return Design(recipe, models, levels, maps, medians, others)


def _medians(seen: DataFrame) -> DataFrame:
    """(k, name, median) from counted values: as many rows as a column has different values."""
    values = seen.where("value is not null and n > 0").withColumn("value", F.col("value").cast("double"))
    upto = F.sum("n").over(Window.partitionBy("k", "name").orderBy("value"))
    total = F.sum("n").over(Window.partitionBy("k", "name"))
    placed = values.withColumns({"upto": upto, "last": total - 1})
    low = F.min(F.when(F.col("upto") > F.floor(F.col("last") / 2), F.col("value")))
    high = F.min(F.when(F.col("upto") > F.ceil(F.col("last") / 2), F.col("value")))
    return placed.groupBy("k", "name").agg(((low + high) / 2).alias("median"))


def _levels(seen: DataFrame, recipe: Recipe) -> tuple[DataFrame, DataFrame, dict[tuple[int, str], tuple[int | None, int]]]:
    """The tables ``levels`` and ``maps`` of a design, and its pooled levels."""
    nothing = F.lit(None).cast("string")
    trained = seen.where("value is not null and n > 0")
    modes = trained.groupBy("k", "name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))
    filled = seen.join(modes, ["k", "name"], "left").withColumn(
        "value_", F.coalesce("value", F.when(_by_name(recipe, lambda c: F.lit(c.impute), F.lit(False)), F.col("mode")))
    )
    merged = lambda x: _by_name(recipe, lambda c: c.merged(F.col(x)), F.col(x))
    values = settle(filled.select("k", "name", merged("value").alias("raw"), merged("value_").alias("level"), "n"))
    # Levels with their training rows; rare ones are pooled.
    sizes = values.where("level is not null and n > 0").groupBy("k", "name", "level").agg(F.sum("n").alias("n"))
    whole = sizes.groupBy("k", "name").agg(
        F.sum("n").alias("total"), F.max_by("level", F.struct("n", F.col("level"))).alias("top"), F.max("n").alias("top_n")
    )
    least = _by_name(
        recipe, lambda c: F.lit(None).cast("double") if c.least is None else F.lit(float(c.least)) * (1 if c.least >= 1 else F.col("total")), F.lit(None).cast("double")
    )
    other = _by_name(recipe, lambda c: F.lit(c.other), nothing)
    kept = least.isNull() | (F.col("n") >= least) | ((F.col("top_n") < least) & (F.col("level") == F.col("top")))
    pooled = sizes.join(whole, ["k", "name"]).withColumn("final", F.when(kept, F.col("level")).otherwise(other))
    final = pooled.groupBy("k", "name", F.col("final").alias("level")).agg(F.sum("n").alias("n"))
    # Numbers: the reference level first, the rest in alphabetical order; terms follow the intercept and the numbers.
    reference = _by_name(recipe, lambda c: F.lit(c.reference), nothing)
    order = Window.partitionBy("k", "name").orderBy(~F.coalesce(F.col("level") == reference, F.lit(False)), "level")
    placed = settle(final.withColumn("position", F.row_number().over(order)))
    names = [c.column for c in recipe.categories]
    before = placed.groupBy("k", "name").agg((F.count(F.lit(1)) - 1).alias("terms")).withColumn(
        "offset",
        F.coalesce(
            F.sum("terms").over(Window.partitionBy("k").orderBy(F.array_position(F.array(*map(F.lit, names)), F.col("name"))).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ) if names else placed.select("k", "name", F.lit(0).alias("offset"))
    first = 1 + len(recipe.numeric)
    numbered = settle(
        placed.join(before.select("k", "name", "offset"), ["k", "name"]).select(
            "k", "name", "level", "n", F.col("position").cast("long").alias("position"),
            F.when(F.col("position") > 1, F.col("offset") + F.col("position") + (first - 2)).cast("int").alias("term"),
        )
    )
    # What a value leads to: its own level, the pooled one, or nothing known.
    ways = values.select("k", "name", "raw", "level").distinct().join(
        pooled.select("k", "name", "level", "final"), ["k", "name", "level"], "left"
    ).withColumn("level", F.coalesce("final", F.when(F.col("level").isNotNull(), other)))
    maps = ways.join(numbered.drop("n"), ["k", "name", "level"], "left").select(
        "k", "name", "raw", F.col("position").isNotNull().alias("known"), "term", F.when(F.col("term").isNotNull(), 1.0).alias("weight"), "level", "position"
    )
    with ThreadPoolExecutor(2) as pool:
        stored = pool.submit(settle, maps)
        pooled = numbered.where(F.col("level") == other).collect()
        return numbered, stored.result(), {(r["k"], r["name"]): (r["term"], r["position"]) for r in pooled}


def term_names(design: Design) -> DataFrame:
    """(k, term, name) of every entry of a design row: the intercept, the numbers, then ``column_Level.Name``."""
    spark = design.levels.sparkSession
    fixed = spark.createDataFrame(
        [(k, j, name) for k in design.models for j, name in enumerate(["(Intercept)", *design.recipe.numeric])], "k long, term int, name string"
    )
    suffix = F.regexp_replace("level", "[^0-9A-Za-z._]", ".")
    suffix = F.when(suffix.rlike(r"^(\d|\.\d|_)"), F.concat(F.lit("X"), suffix)).otherwise(suffix)
    return fixed.unionByName(design.levels.where("term is not null").select("k", "term", F.concat_ws("_", "name", suffix).alias("name")))


def by_model(values: dict[int, float | int | None], model: Column, kind: str) -> Column:
    """A number that depends on the model of a row."""
    return reduce(lambda rest, kv: F.when(model == kv[0], F.lit(kv[1])).otherwise(rest), values.items(), F.lit(None)).cast(kind)


def _met(rows: DataFrame, design: Design, maps: DataFrame) -> DataFrame:
    """Rows (with a model ``__k``) joined with what their categories become: ``__m0`` and so on, missing for values never seen."""
    for at, c in enumerate(design.recipe.categories):
        found = maps.where(F.col("name") == c.column).select(
            F.col("k").alias("__of"), F.col("raw").alias("__raw"), F.struct(*[x for x in maps.columns if x not in ("k", "name", "raw")]).alias(f"__m{at}")
        )
        if design.small:
            found = F.broadcast(found)
        rows = rows.join(found, (F.col("__k") == F.col("__of")) & c.merged(F.col(f"__c{at}")).eqNullSafe(F.col("__raw")), "left").drop("__of", "__raw")
    return rows


def _pooled(design: Design, at: int) -> tuple[Column, dict[int, tuple[int | None, int]]]:
    """Whether a category's value was never seen and so is pooled, and the pooled level's term and position by model."""
    c = design.recipe.categories[at]
    own = {k: t for (k, name), t in design.others.items() if name == c.column}
    if c.other is None or not own:
        return F.lit(False), {}
    return F.col(f"__m{at}").isNull() & F.col(f"__c{at}").isNotNull() & F.col("__k").isin(*own), own


def _filled(design: Design, j: int) -> Column:
    """A number, the median of the row's model where it is missing and has one."""
    name = list(design.recipe.numeric)[j]
    if name not in design.recipe.medians:
        return F.col(f"__x{j}")
    return F.coalesce(f"__x{j}", by_model({k: design.medians.get((k, name)) for k in design.models}, F.col("__k"), "double"))


def bake(rows: DataFrame, design: Design, model: Column | None = None) -> DataFrame:
    """``prepared`` rows with filled numbers ``__x…``, final levels ``__l…`` and their positions ``__p…``; missing where unknown."""
    rows = rows.withColumn("__k", (F.lit(ALL_ROWS) if model is None else model).cast("long"))
    rows = _met(rows, design, design.maps)
    made = {f"__x{j}": _filled(design, j) for j in range(len(design.recipe.numeric))}
    for at, c in enumerate(design.recipe.categories):
        new, own = _pooled(design, at)
        met = F.col(f"__m{at}")
        made[f"__l{at}"] = F.when(new, F.lit(c.other)).otherwise(F.when(met["known"], met["level"]))
        made[f"__p{at}"] = F.when(new, by_model({k: p for k, (_, p) in own.items()}, F.col("__k"), "long")).otherwise(met["position"])
    return rows.withColumns(made).drop("__k", *[f"__m{at}" for at in range(len(design.recipe.categories))]) if made else rows.drop("__k")


def encode(rows: DataFrame, design: Design, model: Column | None = None, effects: DataFrame | None = None) -> DataFrame:
    """``prepared`` rows with ``terms`` and ``weights``: the non-zero entries of their design row, the intercept left out.

    Both are missing where a number or a category is missing or unknown to the model ``model`` (model 0 if none is given).
    With ``effects`` (k, term, effect) the column ``effect`` is the sum over the categories' terms, and ``__x…`` are the filled numbers.
    """
    recipe = design.recipe
    rows = rows.withColumn("__k", (F.lit(ALL_ROWS) if model is None else model).cast("long"))
    maps, of_pooled = design.maps, {}
    if effects is not None:
        maps = settle(maps.join(effects, ["k", "term"], "left").withColumn("effect", F.coalesce("effect", F.lit(0.0))))
        pooled_terms = {(k, t) for (k, _), (t, _) in design.others.items() if t is not None}
        if pooled_terms:
            wanted = effects.where(F.col("term").isin(*{t for _, t in pooled_terms}))
            of_pooled = {(r["k"], r["term"]): r["effect"] for r in wanted.collect()}
    rows = _met(rows, design, maps)
    parts, sums, whole = [], [], F.lit(True)
    filled = {f"__x{j}": _filled(design, j) for j in range(len(recipe.numeric))}
    for j, x in enumerate(filled.values()):
        parts.append(F.struct(F.lit(j + 1).alias("term"), x.alias("weight")))
        whole &= x.isNotNull()
    for at in range(len(recipe.categories)):
        new, own = _pooled(design, at)
        met = F.col(f"__m{at}")
        known = new | F.coalesce(met["known"], F.lit(False))
        term = F.when(new, by_model({k: t for k, (t, _) in own.items()}, F.col("__k"), "int")).otherwise(met["term"])
        parts.append(F.struct(term.alias("term"), F.lit(1.0).alias("weight")))
        whole &= known
        if effects is not None:
            pooled = by_model({k: of_pooled.get((k, t), 0.0) for k, (t, _) in own.items()}, F.col("__k"), "double")
            sums.append(F.when(new, pooled).otherwise(met["effect"]))
    entries = F.array(*parts) if parts else F.array().cast("array<struct<term:int,weight:double>>")
    there = F.filter(entries, lambda e: e["term"].isNotNull())
    # An effect needs no entries; where only effects are used, none are made.
    made = {"__entries": F.when(whole, there)}
    if effects is not None:
        made |= {"effect": F.when(whole, reduce(lambda a, b: a + b, sums, F.lit(0.0))), **filled}
    rows = rows.withColumns(made).withColumns({"terms": F.col("__entries")["term"], "weights": F.col("__entries")["weight"]})
    return rows.drop("__entries", "__k", *[f"__m{at}" for at in range(len(recipe.categories))])
