"""Treatment with an account of what it leaves out.

One job reads the raw rows once and writes both the treated cases and the rejected rows, side by side:

    <path>/destino=casos/<year>=…        treated rows, as ``batch.build_treated`` leaves them
    <path>/destino=recusados/<year>=…    rejected rows: ``motivo`` and the raw row as JSON in ``linha``

The same job counts what it writes, and in how many accepted rows a value of a date, number or age could not
be read and became null. Counters sit behind the last shuffle, where each written row is counted once even if
tasks are repeated."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.functions.clean import parse_age, to_date, to_small_int, whole_number
from epispark.plans.batch import prepare
from epispark.presets import tuberculosis as tb
from epispark.sources.cases import CaseStore, drop_folders, folder_files
from epispark.spec import TB, CaseSpec

TARGET, CASES, REJECTS = "destino", "casos", "recusados"
NO_YEAR, BAD_YEAR, OTHER_YEAR = "sem ano", "ano ilegível", "ano não pedido"


@dataclass(frozen=True)
class Account:
    """Rows read, accepted and rejected by reason, and values of accepted rows that became null, by column."""

    read: int
    accepted: int
    rejected: dict[str, int] = field(default_factory=dict)
    lost: dict[str, int] = field(default_factory=dict)


def reason(year: Column, years: Sequence[int] | None) -> Column:
    """Why a row is rejected; null if it is not."""
    number = whole_number(year)
    out = F.when(year.isNull() | (F.trim(year.cast("string")) == ""), NO_YEAR).when(number.isNull(), BAD_YEAR)
    return out if years is None else out.when(~number.isin(list(years)), OTHER_YEAR)


def _losses(df: DataFrame, spec: CaseSpec) -> dict[str, Column]:
    """Column -> whether it holds something that the treatment cannot read."""
    def lost(c: str, parsed: Column) -> Column:
        return F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") & parsed.isNull()

    out = {c: lost(c, to_date(F.col(c))) for c in tb.DATE_COLUMNS if c in df.columns}
    out |= {c: lost(c, to_small_int(F.col(c))) for c in tb.INT_COLUMNS if c in df.columns and c != spec.year}
    if spec.age_text in df.columns:
        out[spec.age_text] = lost(spec.age_text, parse_age(F.col(spec.age_text)))
    return out


def treat(raw: DataFrame, path: str, years: Sequence[int] | None = None, spec: CaseSpec = TB) -> Account:
    """Writes treated cases and rejected rows below ``path`` and returns the account. ``years``: those asked for,
    all when none are given. Folders of cases of other years stay, a year asked for that has no rows any more loses
    its folder, and the rejected rows are those of this run."""
    spark, losses = raw.sparkSession, _losses(raw, spec)
    mask = reduce(Column.__add__, [F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(losses.values())], F.lit(0)).cast("long")
    why = reason(F.col(spec.year), years)
    marked = raw.select("*", why.alias("motivo"), F.when(why.isNotNull(), F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns]))).alias("linha"),
                        F.when(why.isNull(), mask).otherwise(0).alias("_perdas"))
    rows = prepare(marked, spec)
    accepted = F.col("motivo").isNull()
    # of a rejected row only the reason and the raw text are kept
    kept = [F.when(accepted, F.col(f"`{c}`")).alias(c) for c in rows.columns if c not in ("motivo", "linha", "_perdas", spec.year)]
    year = F.when(accepted, whole_number(F.col(spec.year))).alias(spec.year)
    sides = rows.select(*kept, "motivo", "linha", "_perdas", F.when(accepted, F.lit(CASES)).otherwise(F.lit(REJECTS)).alias(TARGET), year)
    order = [c for c in (TARGET, spec.year, spec.area) if c in sides.columns]
    placed = sides.hint("rebalance", F.col(TARGET), F.col(spec.year)).sortWithinPartitions(*order)

    seen, reasons = Observation("tratamento"), (NO_YEAR, BAD_YEAR, OTHER_YEAR)
    counted = placed.observe(
        seen, F.count(F.lit(1)).alias("lidas"), *[F.count_if(F.col("motivo") == r).alias(f"m{k}") for k, r in enumerate(reasons)],
        *[F.count_if(F.col("_perdas").bitwiseAND(1 << k) != 0).alias(f"p{k}") for k in range(len(losses))])
    sides_of = {side: folder_files(spark, f"{path}/{TARGET}={side}", spec.year) for side in (CASES, REJECTS)}
    (counted.drop("_perdas").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(TARGET, spec.year).parquet(path))
    asked = None if years is None else {str(int(y)) for y in years}
    for side, old in sides_of.items():  # a folder that still has the files it had got no rows: asked years and rejects are emptied
        new = folder_files(spark, f"{path}/{TARGET}={side}", spec.year)
        drop_folders(spark, f"{path}/{TARGET}={side}", spec.year, keep=lambda value, side=side, old=old, new=new: (
            old.get(value) != new.get(value) or side == CASES and (asked is not None and value not in asked)))
    found = seen.get
    rejected = {r: found[f"m{k}"] for k, r in enumerate(reasons) if found[f"m{k}"]}
    return Account(found["lidas"], found["lidas"] - sum(rejected.values()), rejected, {c: found[f"p{k}"] for k, c in enumerate(losses)})


def treated(spark: SparkSession, path: str, schema: T.StructType, spec: CaseSpec = TB) -> CaseStore:
    """The treated cases that ``treat`` left."""
    return CaseStore(spark, f"{path}/{TARGET}={CASES}", schema, spec)


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """(motivo, linha) of the rejected rows."""
    return spark.read.schema(f"motivo string, linha string, {TARGET} string").parquet(path).where(F.col(TARGET) == REJECTS).select("motivo", "linha")
