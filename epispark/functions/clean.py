"""Typing and recoding of case columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.text import replace_values, unaccent_text
from epispark.literals import literal_rows, sql_map, sql_text
from epispark.presets import tuberculosis as tb
from epispark.spec import TB, AreaDim, CaseSpec

# Fixed value: how ages are written.
AGE_PATTERN = r"(\d+)\s+(ano|m[eê]s|dia|hora)"


def drop_if_present(df: DataFrame, columns: Iterable[str] = tb.DROPPED_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def to_date(c: Column) -> Column:
    """Date, or null when the value is not one. Text may also be eight digits, year first."""
    text = c.cast("string")
    compact = F.when(text.rlike(r"^\s*\d{8}\s*$"), F.concat_ws(
        "-", F.substring(F.trim(text), 1, 4), F.substring(F.trim(text), 5, 2), F.substring(F.trim(text), 7, 2)))
    return F.coalesce(c.try_cast("date"), compact.try_cast("date"))


def whole_number(c: Column) -> Column:
    """Whole number as int, also from text such as '3.0'; null for anything else."""
    number = F.when(~F.lower(c.cast("string")).rlike(r"[a-z]\s*$"), c.try_cast("double"))
    return F.when((number == F.floor(number)) & (F.abs(number) < 2**31), number.cast("int"))


def to_small_int(c: Column) -> Column:
    """16-bit integer held as int; null when not numeric or out of range."""
    number = whole_number(c)
    return F.when(number.between(-(2**15), 2**15 - 1), number)


def coerce_dates(df: DataFrame, columns: Iterable[str] = tb.DATE_COLUMNS) -> DataFrame:
    return df.withColumns({c: to_date(F.col(c)) for c in columns if c in df.columns})


def coerce_small_ints(df: DataFrame, columns: Iterable[str] = tb.INT_COLUMNS) -> DataFrame:
    return df.withColumns({c: to_small_int(F.col(c)) for c in columns if c in df.columns})


def parse_age(c: Column, unmatched_as_zero: bool = False) -> Column:
    """Age in years from text such as '34 anos' or '5 meses'.

    Text that does not match gives null; ``unmatched_as_zero`` gives 0 as the older rule did."""
    number = F.regexp_extract(c, AGE_PATTERN, 1).try_cast("int")
    unit = F.regexp_extract(c, AGE_PATTERN, 2)
    years = (F.when(unit == "ano", number)
             .when(unit.isin("mes", "mês"), F.floor(number / 12).cast("int"))
             .when(unit.isin("dia", "hora"), F.lit(0)))
    return F.coalesce(years, F.lit(0)) if unmatched_as_zero else years


def canonical_outcome(c: Column, spec: CaseSpec = TB) -> Column:
    """Unified outcome spelling; a null outcome is a case still open."""
    return replace_values(c, spec.outcome_spellings, F.coalesce(c, F.lit(spec.open_outcome)))


def plain_outcome(c: Column, spec: CaseSpec = TB) -> Column:
    """Older recoding, towards spellings without accents; null and unknown values pass through."""
    plain = {name: unaccent_text(name) for name in spec.outcome_groups if name != unaccent_text(name)}
    opened = {raw: name for raw, name in spec.outcome_spellings.items() if name == spec.open_outcome}
    return replace_values(c, {**opened, **plain}, c)


def outcome_group(canonical: Column, spec: CaseSpec = TB, unmapped_as_null: bool = False) -> Column:
    """Cohort group of a canonical outcome."""
    default = F.lit(None).cast("string") if unmapped_as_null else F.lit(spec.ungrouped)
    named = {k: v for k, v in spec.outcome_groups.items() if unmapped_as_null or v != spec.ungrouped}
    return replace_values(canonical, named, default)


def outcome_spellings(canonical: Iterable[str], spec: CaseSpec = TB) -> list[str]:
    """Every spelling in the data that stands for one of the canonical outcomes."""
    wanted = set(canonical)
    same = [c for c in canonical if c not in spec.outcome_spellings]
    return same + [raw for raw, c in spec.outcome_spellings.items() if c in wanted]


def has_outcome(canonical: str | Iterable[str], spec: CaseSpec = TB, column: Column | None = None) -> Column:
    """Test on the stored outcome. A plain IN list over its spellings: cheaper per row than
    recoding first, and it can be pushed to the reader."""
    names = [canonical] if isinstance(canonical, str) else list(canonical)
    c = F.col(spec.outcome) if column is None else column
    return c.isin(*outcome_spellings(names, spec))


def is_closed(spec: CaseSpec = TB, column: Column | None = None) -> Column:
    """The stored outcome is present and not one of the open spellings."""
    c = F.col(spec.outcome) if column is None else column
    return c.isNotNull() & ~c.isin(*outcome_spellings([spec.open_outcome], spec))


def with_outcome(df: DataFrame, spec: CaseSpec = TB) -> DataFrame:
    """Adds ``desfecho`` (canonical) and ``grupo``; both are pruned when unused."""
    df = df.withColumn("desfecho", canonical_outcome(F.col(spec.outcome), spec))
    return df.withColumn("grupo", outcome_group(F.col("desfecho"), spec))


def band(column: str, bands: Sequence[tuple[str, int, int | None]]) -> Column:
    """Label of the closed interval holding a column's value; null outside all of them."""
    tests = [f"WHEN `{column}` >= {low}" + (f" AND `{column}` <= {high}" if high is not None else "")
             + f" THEN {sql_text(label)}" for label, low, high in bands]
    return F.expr(f"CASE {' '.join(tests)} END")


def band_grid(spark, bands) -> DataFrame:
    """(ordem, faixa): one literal row per band."""
    return literal_rows(spark, [(i, b[0]) for i, b in enumerate(bands)], "ordem int, faixa string")


def young_flag(label: Column) -> Column:
    return label.isin("0-4", "5-9", "10-14")


def month_of(c: Column) -> Column:
    return F.month(to_date(c))


def month_label(month: Column) -> Column:
    return sql_map(dict(enumerate(tb.MONTHS, 1)))[month.cast("int")]


def wait_days(start: Column, end: Column) -> Column:
    """Calendar days from start to end."""
    return F.datediff(end.cast("date"), start.cast("date"))


def clip_upper(c: Column, limit: int) -> Column:
    """Values above ``limit`` become ``limit``; null stays null."""
    return F.when(c.isNotNull(), F.least(c, F.lit(limit)))


def digits_only(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def digits_to_double(c: Column) -> Column:
    return F.when(digits_only(c), c.try_cast("double"))


def registry_year(death_date: Column) -> Column:
    """Year of a DDMMYYYY text; null when not numeric."""
    return F.substring(death_date, 5, 4).try_cast("int")


def registry_area_code(residence: Column) -> Column:
    return F.substring(residence, 1, 2)


def attach_area(df: DataFrame, dim: AreaDim, spec: CaseSpec = TB, how: str = "inner",
                unknown: str | None = None) -> DataFrame:
    """Adds ``sigla``. A small dimension is broadcast, a large one joined by size. Published cells have
    it already, in place of the spelling."""
    if "sigla" in df.columns and spec.area not in df.columns:
        return df.where(F.col("sigla").isNotNull()) if how == "inner" else df
    out = df.join(dim.hinted(dim.names), F.expr(f"`{spec.area}` = spelling"), how).drop("spelling")
    if unknown is not None:
        out = out.withColumn("sigla", F.coalesce("sigla", F.lit(unknown)))
    return out


def enrich_cases(df: DataFrame, dim: AreaDim, spec: CaseSpec = TB) -> DataFrame:
    """Area code, canonical outcome and month, each only when its input exists."""
    if spec.area in df.columns:
        df = attach_area(df, dim, spec, "left", "?").withColumnRenamed("sigla", "uf_sigla")
    extra = {}
    if spec.outcome in df.columns:
        extra["situacao_enc_norm"] = canonical_outcome(F.col(spec.outcome), spec)
    if spec.date in df.columns:
        extra["mes_num"] = month_of(F.col(spec.date))
    return df.withColumns(extra) if extra else df
