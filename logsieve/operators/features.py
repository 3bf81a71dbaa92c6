"""Feature table, profiles and alignment to a stored feature list."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.functions.requests import ALL_FEATURES, PROFILES, scalar_features
from logsieve.operators.windows import add_window_features

META = ["row_id", "is_attack", "attack_type", "ip", "path", "source"]
ALIASES = {"path": "uri", "user_agent": "ua"}


def resolve_aliases(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rename known aliases to the required names; a column that is missing under both is an error."""
    for name in required:
        if name in df.columns:
            continue
        alias = ALIASES.get(name)
        if alias is None or alias not in df.columns:
            raise ValueError(f"column {name!r} not found, available: {df.columns}")
        df = df.withColumnRenamed(alias, name)
    return df


def feature_table(
    df: DataFrame, profile: str = "train", extra: Mapping[str, Column] | None = None, keep: Sequence[str] = META
) -> DataFrame:
    """All 35 features and the meta columns on one row per request.

    Profile ``train`` computes the window features; ``serve`` knows no history, so they are 0 and nothing shuffles.
    ``extra`` adds user features by name.
    """
    if profile == "train":
        df = add_window_features(df)
    else:
        df = df.select("*", *[F.lit(0).alias(f) for f in V.WINDOW_FEATURES])
    computed = {**scalar_features(profile), **(extra or {})}
    names = ALL_FEATURES + [n for n in (extra or {}) if n not in ALL_FEATURES]
    columns = [computed[n].alias(n) if n in computed else F.col(n) for n in names]
    return df.select(*[c for c in keep if c in df.columns], *columns)


def select_profile(features: DataFrame, profile: str) -> DataFrame:
    """Meta columns and the features of v1 (all but path), v3 (no response), v4 (no response, no window)."""
    return features.select(*[c for c in META if c in features.columns], *PROFILES[profile])


def align_features(df: DataFrame, wanted: Sequence[str], strict: bool = False, keep: Sequence[str] = META) -> DataFrame:
    """Stored feature list as floats in its order; absent columns are 0, or an error when ``strict``."""
    absent = [c for c in wanted if c not in df.columns]
    if absent and strict:
        raise ValueError(f"missing features: {absent}")

    def value(name: str) -> Column:
        if name in absent:
            return F.lit(0.0).cast("float")
        kind = dict(df.dtypes)[name]
        number = F.col(name).try_cast("double") if kind == "string" else F.col(name).cast("double")
        return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0)).cast("float")

    return df.select(*[c for c in keep if c in df.columns], *[value(c).alias(c) for c in wanted])
