"""Splits and folds by a hash of the row key.

A row always lands in the same part, whatever the partitioning, the retries or the engine; no
shuffle and no sort is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scalar import col, hash_bucket, hash_number, quoted
from lotwise.operators.cleaning import HouseCleaner, HouseCleanerModel
from lotwise.operators.features import FeatureBuilder, FeatureBuilderModel, add_features
from lotwise.schema import ID, TARGET
from lotwise.session import via_table

SPLIT_SEED = 42
FOLD_SEED = 4242
FOLD_HASH = "_fold_hash"
LOG_TARGET = "log_target"


def with_split(df: DataFrame, test_percent: int = 20, key: str = ID, seed: int = SPLIT_SEED) -> DataFrame:
    return df.withColumn("is_test", hash_bucket(col(key), 100, seed) < test_percent)


def train_test_split(df: DataFrame, test_percent: int = 20, key: str = ID, seed: int = SPLIT_SEED):
    part = hash_bucket(col(key), 100, seed)
    return df.where(part >= test_percent), df.where(part < test_percent)


def with_fold(df: DataFrame, k: int, key: str = ID, seed: int = FOLD_SEED, name: str = "fold") -> DataFrame:
    return df.withColumn(name, hash_bucket(col(key), k, seed))


def with_fold_hash(df: DataFrame, key: str = ID) -> DataFrame:
    """The hash behind the folds as a column: stored with the rows, each later pass is spared the digest of the key."""
    return df.withColumn(FOLD_HASH, hash_number(col(key), FOLD_SEED))


def fold_of(df: DataFrame, k: int, key: str = ID, seed: int = FOLD_SEED) -> Column:
    """The fold of a row, from its stored hash where ``df`` has one."""
    if FOLD_HASH in df.columns and (key, seed) == (ID, FOLD_SEED):
        return F.pmod(col(FOLD_HASH), F.lit(k)).cast("int")
    return hash_bucket(col(key), k, seed)


def to_log_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.withColumn(LOG_TARGET, F.log1p(col(target).cast("double")))


def from_log(c):
    """Back to currency, never below zero."""
    return F.when(c.isNotNull(), F.greatest(F.expm1(c), F.lit(0.0)))


def align(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly ``names`` in order; absent columns become 0, nulls in present columns stay."""
    have = set(df.columns)
    return df.select(*[quoted(n) if n in have else F.lit(0).alias(n) for n in names])


def feature_names(df: DataFrame, target: str = TARGET, key: str = ID) -> list[str]:
    return [c for c in df.columns if c not in (target, key)]


def prepare_train_test(
    raw: DataFrame, seed: int = SPLIT_SEED, stats: str = "frame", target: str = TARGET
) -> tuple[DataFrame, DataFrame, HouseCleanerModel, FeatureBuilderModel | None]:
    """Split, clean (learned on train, test not capped), derive, align.

    ``stats="frame"`` derives each part from its own statistics; ``"fitted"`` uses those of train.
    """
    train_raw, test_raw = train_test_split(raw, seed=seed)
    cleaner = HouseCleaner(targetCol=target).fit(train_raw)
    train = cleaner.transform(train_raw)
    # The statistics of the derived columns read each part several times: clean it once.
    test = via_table(cleaner.copy({cleaner.capOutliers: False}).transform(test_raw), "test_clean")
    builder = None
    if stats == "fitted":
        builder = FeatureBuilder().fit(train)
        train, test = builder.transform(train), builder.transform(test)
    else:
        train, test = add_features(train), add_features(test)
    keep = [c for c in (ID, target) if c in train.columns]
    return train, align(test, keep + feature_names(train, target)).select(*[quoted(c) for c in train.columns]), cleaner, builder
