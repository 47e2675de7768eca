"""The design of a model: how columns of a table become columns of a linear predictor.

A design is a list of blocks over a narrow table. A dense block is one numeric expression; a
level block is an integer code (with an optional numeric factor), standing for as many
indicator columns as it has levels. Indicators are never built.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabularies up to this size are literal maps in the plan; larger ones a join with the model's own level table,
#: which is broadcast up to a size.
LITERAL_LEVELS, BROADCAST_LEVELS = 200, 500_000
#: Levels of all categorical columns of a fit together.
MAX_LEVELS = 1_000_000
NUMERIC = (T.NumericType, T.BooleanType)


@dataclass
class Factor:
    """One variable of a term: numeric columns, or a categorical one with its levels."""

    name: str
    source: Column
    columns: list[tuple[str, Column]] = field(default_factory=list)
    levels: list | None = None
    missing: bool = False
    method: str = "fail"
    key: str = ""
    #: What the columns are made of, and whether their order follows its values.
    variable: str = ""
    ordered: bool = True

    def __post_init__(self):
        self.variable = self.variable or self.name

    @property
    def categorical(self) -> bool:
        return self.levels is not None

    def labels(self, missing_name: str) -> list[str]:
        return [*map(str, self.levels), *([missing_name] if self.missing else [])]


@dataclass
class Block:
    """``names`` of the design's columns that the block makes, in order."""

    term: str
    names: list[str]
    value: Column | None
    codes: list[tuple[Factor, bool]] = field(default_factory=list)  # (factor, drop first level)


@dataclass
class Design:
    terms: list[tuple[str, list[Factor], tuple[bool, ...]]]
    interaction: str = ":"
    format: str = "{name}[{category}]"
    missing_name: str = "(MISSING)"

    def blocks(self) -> list[Block]:
        out = []
        for term, factors, reduced in self.terms:
            coded = [(f, r) for f, r in zip(factors, reduced) if f.categorical]
            combos: list[list[tuple[str, Column]]] = [[]]
            for f in factors:
                if not f.categorical:
                    combos = [[*c, one] for c in combos for one in f.columns]
            for combo in combos:
                value = None
                for _, column in combo:
                    value = column if value is None else value * column
                numeric = iter(combo)
                parts: list[list[str]] = [[]]
                for f, r in zip(factors, reduced):
                    if f.categorical:
                        names = [self.format.format(name=f.name, category=c) for c in f.labels(self.missing_name)[1 if r else 0 :]]
                    else:
                        names = [next(numeric)[0]]
                    parts = [[*p, n] for p in parts for n in names]
                out.append(Block(term, [self.interaction.join(p) for p in parts], value, coded))
        return [b for b in out if b.names]

    def feature_names(self) -> list[str]:
        return [n for b in self.blocks() for n in b.names]

    def term_names(self) -> list[str]:
        return [b.term for b in self.blocks() for _ in b.names]

    def factors(self) -> list[Factor]:
        return list({f.key or f.name: f for _, fs, _ in self.terms for f in fs}.values())

    def encoded(self, df: DataFrame, extra: list[Column]) -> tuple[DataFrame, list[tuple[str | None, str | None, int]]]:
        """``df`` as value and code columns plus ``extra``; for each block (value, code, size).

        A code is -1 where no indicator is set. Values not among the levels raise on evaluation.
        """
        code_of: dict[int, Column] = {}
        for k, f in enumerate(f for f in self.factors() if f.categorical):
            df, code_of[id(f)] = _coded(df, f, f"_code_{k}")
        columns, layout = list(extra), []
        for k, b in enumerate(self.blocks()):
            value = code = None
            if b.value is not None or not b.codes:
                value = f"v{k}"
                columns.append(b.value.cast("double").alias(value))
            if b.codes:
                joint, gone = F.lit(0), F.lit(False)
                for f, reduced in b.codes:
                    size = len(f.labels(self.missing_name)) - reduced
                    own = code_of[id(f)] - int(reduced)
                    gone = gone | (own < 0)
                    joint = joint * size + own
                code = f"c{k}"
                columns.append(F.when(gone, F.lit(-1)).otherwise(joint).cast("int").alias(code))
            layout.append((value, code, len(b.names)))
        return df.select(*columns), layout

    def predictor(self, df: DataFrame, coefficients, intercept: float) -> tuple[DataFrame, Column]:
        """``df`` (perhaps with joined level codes) and the linear predictor as a Column."""
        code_of: dict[int, Column] = {}
        for k, f in enumerate(f for f in self.factors() if f.categorical):
            df, code_of[id(f)] = _coded(df, f, f"_code_{k}")
        total, at = F.lit(float(intercept)), 0
        for b in self.blocks():
            own = [float(c) for c in coefficients[at : at + len(b.names)]]
            at += len(b.names)
            if not b.codes:
                if own[0]:
                    total = total + F.lit(own[0]) * b.value.cast("double")
                continue
            joint, gone = F.lit(0), F.lit(False)
            for f, reduced in b.codes:
                code = code_of[id(f)] - int(reduced)
                gone = gone | (code < 0)
                joint = joint * (len(f.labels(self.missing_name)) - reduced) + code
            part = F.when(gone, F.lit(0.0)).otherwise(F.element_at(F.array(*map(F.lit, own)), (joint + 1).cast("int")))
            total = total + (part if b.value is None else part * b.value.cast("double"))
        return df, total


def _coded(df: DataFrame, f: Factor, name: str) -> tuple[DataFrame, Column]:
    """The level number of a factor, -1 for a null that sets no indicator."""
    key = f.source.cast("string")
    levels = [str(x) for x in f.levels]
    if len(levels) <= LITERAL_LEVELS:
        found = F.lit(None).cast("int")
        if levels:
            pairs = [F.lit(x) for i, level in enumerate(levels) for x in (level, i)]
            found = F.element_at(F.create_map(*pairs), key)
    else:
        table = df.sparkSession.createDataFrame(list(zip(levels, range(len(levels)))), f"{name}_key string, {name} int")
        table = F.broadcast(table) if len(levels) <= BROADCAST_LEVELS else table
        df = df.join(table, key == F.col(f"{name}_key"), "left").drop(f"{name}_key")
        found = F.col(name)
    null = F.lit(len(levels)) if f.missing else F.lit(-1) if f.method in ("zero", "convert") else F.raise_error(F.lit(f"Categorical data can't have missing values: {f.name}")).cast("int")
    if f.method == "convert" and not f.missing:
        null = F.raise_error(F.lit(f"Column {f.name} contains unseen categories: missing")).cast("int")
    unseen = F.raise_error(F.concat(F.lit(f"Column {f.name} contains unseen categories: "), key)).cast("int")
    return df, F.when(key.isNull(), null).when(found.isNull(), unseen).otherwise(found)


def discover_levels(df: DataFrame, sources: dict[str, Column], given: dict[str, list] | None = None) -> tuple[dict[str, list], dict[str, bool]]:
    """Sorted distinct values and whether there are nulls, for all columns in one job.

    Levels given for a column are taken as they are, unused ones too. Tasks send distinct values
    only; a model has a coefficient for each on the driver, so more than MAX_LEVELS are refused.
    """
    given = given or {}
    if not sources:
        return {}, {}
    kinds = df.select(*(c.alias(f"c{k}") for k, c in enumerate(sources.values()))).schema
    seen = [F.struct(F.lit(k).alias("k"), (c.cast("string") if name not in given else F.when(c.isNotNull(), F.lit(""))).alias("v")) for k, (name, c) in enumerate(sources.items())]
    found = df.select(F.explode(F.array(*seen)).alias("s")).select("s.*").distinct().limit(MAX_LEVELS + 1).collect()
    if len(found) > MAX_LEVELS:
        raise ValueError(f"the categorical columns have more than {MAX_LEVELS} levels: bin them, or group the rare ones")
    levels: dict[str, list] = {name: [] for name in sources}
    nulls = dict.fromkeys(sources, False)
    names = list(sources)
    for k, v in found:
        if v is None:
            nulls[names[k]] = True
        else:
            levels[names[k]].append(v)
    for field, name in zip(kinds, names):
        number = isinstance(field.dataType, T.NumericType)
        levels[name] = list(given[name]) if name in given else sorted(levels[name], key=(lambda v: (float(v), v)) if number else None)
    return levels, nulls


def make_factors(df: DataFrame, wanted: list[tuple[str, Column, bool, str]], levels: dict | None, missing_name: str) -> dict[str, Factor]:
    """Factors for (name, source, categorical, missing method); levels are discovered once."""
    found, nulls = discover_levels(df, {n: c for n, c, cat, _ in wanted if cat}, levels)
    out = {}
    for name, source, categorical, method in wanted:
        if not categorical:
            out[name] = Factor(name, source, [(name, source.cast("double"))])
            continue
        if nulls[name] and method == "fail":
            raise ValueError(f"Categorical data can't have missing values if cat_missing_method='fail': {name}")
        missing = method == "convert" and nulls[name]
        if missing and missing_name in map(str, found[name]):
            raise ValueError(f"Missing category name {missing_name} already exists in column {name}")
        out[name] = Factor(name, source, levels=found[name], missing=missing, method=method)
    return out


def from_columns(df: DataFrame, features: list[str], *, drop_first=False, levels=None, categorical=(), format="{name}[{category}]", missing_method="fail", missing_name="(MISSING)") -> Design:
    """A design with a term for each column: strings (and those named) are categorical."""
    wanted = []
    for name in features:
        kind = df.schema[name].dataType
        is_level = isinstance(kind, T.StringType) or name in categorical or bool(levels and name in levels)
        if not is_level and not isinstance(kind, NUMERIC):
            raise TypeError(f"column {name} of type {kind.simpleString()} cannot be a feature")
        wanted.append((name, F.col(f"`{name}`"), is_level, missing_method))
    factors = make_factors(df, wanted, levels, missing_name)
    return Design([(n, [factors[n]], (drop_first and factors[n].categorical,)) for n in features], format=format, missing_name=missing_name)


def expand_penalty(penalty, df_features: list[str], design: Design) -> list[float] | None:
    """A penalty for each design column: one value a source column is repeated over its levels."""
    names = design.term_names()
    if penalty is None or isinstance(penalty, str) or len(penalty) == len(names) or len(penalty) != len(df_features):
        return penalty
    by = dict(zip(df_features, penalty))
    return [float(by[n]) for n in names]
