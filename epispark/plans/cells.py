"""Published cells: how many cases each distinct combination of labels has, by year and area.

A screen asks for a few labels at a time, never for all together, and all labels together are nearly as
many combinations as cases. So a case counts once in each of a dozen blocks, and a block holds only the
labels that one question crosses, beside the year, the area and the labels that a request may
restrict (``held``). The composites read these cells in place of the cases, with the count as weight; a request that
restricts anything else goes to the cases.

Years are folders, so a changed year is replaced alone; inside a file rows are ordered by block and area."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.functions.clean import attach_area, band, has_outcome, is_closed, month_of
from epispark.functions.filters import DIMENSIONS, VALUE, Filters
from epispark.functions.predicates import PLAUSIBLE_DURATION, PLAUSIBLE_START, plausible
from epispark.functions.text import is_yes
from epispark.operators.waits import duration, start_wait
from epispark.sources.cases import replace_years
from epispark.spec import TB, AreaDim, CaseSpec

KEYS = ("k1", "k2", "k3", "k4")
WEIGHT = "n"
#: Filters that the cells hold beside years and areas, unless the caller says otherwise.
HELD = ("sexes",)
#: Blocks of what the headline, map and area screens cross, with the place and without.
PLACES, STATES = "lugar", "situacao"
#: In the block of flags, the row of all cases.
EVERY = "casos"


def _blocks(spec: CaseSpec) -> dict[str, list[Column]]:
    """Block -> its keys, over the columns of a case."""
    c = F.col
    wait, length = start_wait(spec), duration(spec)
    aged = c(spec.age).isNotNull() & c(spec.sex).isin(*spec.sexes)
    died = F.coalesce(has_outcome(spec.death, spec), F.lit(False))
    return {
        "sexo": [c(spec.sex)], "forma": [c(spec.form)], "tipo_entrada": [c(spec.entry)], "escolaridade": [c(spec.schooling)],
        "raca": [c(spec.race), c(spec.outcome)],
        "idade": [F.when(aged, band(spec.age, spec.age_bands)), c(spec.sex), died],
        "hiv": [c(spec.hiv), c(spec.outcome)], "baciloscopia": [c(spec.smear)], "teste_molecular": [c(spec.molecular)],
        "espera": [F.when(plausible(wait, PLAUSIBLE_START), wait)],
        "duracao": [F.when(is_closed(spec) & plausible(length, PLAUSIBLE_DURATION), length)],
        PLACES: [c(spec.entry), c(spec.outcome), c(spec.hiv), c(spec.place)],
        STATES: [c(spec.entry), c(spec.outcome), c(spec.hiv)],
        "mes": [month_of(c(spec.date))],
    }


def _row(block: str, keys: Sequence[Column]) -> Column:
    padded = [*keys, *[F.lit(None)] * (len(KEYS) - len(keys))]
    return F.struct(F.lit(block).alias("bloco"), *[k.cast("string").alias(name) for name, k in zip(KEYS, padded)])


def _held_columns(held: Sequence[str], spec: CaseSpec) -> list[str]:
    if unknown := [h for h in held if DIMENSIONS.get(h, ("",))[0] != VALUE]:
        raise ValueError(f"not a label that cells can hold: {unknown}")
    return [getattr(spec, DIMENSIONS[h][1]) for h in held]


def cells_of(df: DataFrame, dim: AreaDim, spec: CaseSpec = TB, held: Sequence[str] = HELD) -> DataFrame:
    """(ano, sigla, held labels, bloco, k1 to k4, n) from one scan. Each task counts its own cases first, so what is
    shuffled is cells."""
    labels = _held_columns(held, spec)
    flags = [F.when(is_yes(F.col(c)), _row("agravos", [F.lit(c), F.col(spec.outcome)])) for c in spec.flags]
    every = _row("agravos", [F.lit(EVERY), F.col(spec.outcome)])
    rows = F.array_compact(F.array(*[_row(name, keys) for name, keys in _blocks(spec).items()], every, *flags))
    held_as = [F.col(c).alias(f"f_{h}") for h, c in zip(held, labels)]
    return (attach_area(df, dim, spec, "left").select(F.col(spec.year).cast("int").alias("ano"), "sigla", *held_as, F.inline(rows))
            .groupBy("ano", "sigla", *[f"f_{h}" for h in held], "bloco", *KEYS).agg(F.count(F.lit(1)).alias(WEIGHT)))


def _schema(held: Sequence[str]) -> str:
    return ", ".join(["ano int", "sigla string", *[f"f_{h} string" for h in held], "bloco string", *[f"{k} string" for k in KEYS], f"{WEIGHT} long"])


@dataclass(frozen=True)
class Cells:
    """Cells as a table, and the filters that they hold."""

    frame: DataFrame
    held: tuple[str, ...] = HELD

    def holds(self, f: Filters) -> bool:
        return not any(getattr(f, name) for name in DIMENSIONS if name not in ("years", "areas", *self.held))

    def years(self) -> tuple[int, ...]:
        """Calendar years, from the folders."""
        return tuple(sorted(r["ano"] for r in self.frame.select("ano").distinct().where("ano IS NOT NULL").collect()))

    def rows(self, f: Filters, dim: AreaDim, *blocks: str) -> DataFrame:
        """The cells of some blocks that a request keeps."""
        if not self.holds(f):
            raise ValueError("the cells do not hold what the request restricts; ask the cases")
        out = self.frame.where(F.col("bloco").isin(*blocks))
        if f.years:
            out = out.where(F.col("ano").isin(list(f.years)))
        if areas := f.known_areas(dim):
            out = out.where(F.col("sigla").isin(list(areas)))
        for name in self.held:
            if chosen := getattr(f, name):
                out = out.where(F.col(f"f_{name}").isin(list(chosen)))
        return out

    def states(self, f: Filters, dim: AreaDim, spec: CaseSpec = TB, places: bool = False) -> DataFrame:
        """Entry, outcome and status under their names, if asked for the place too, with ``sigla`` and the weight."""
        names = (spec.entry, spec.outcome, spec.hiv, *([spec.place] if places else []))
        return self.rows(f, dim, PLACES if places else STATES).select("sigla", *[F.col(k).alias(c) for k, c in zip(KEYS, names)], WEIGHT)

    def counts(self, f: Filters, dim: AreaDim, *blocks: str, depth: int = 2) -> DataFrame:
        """(bloco, k1 …, n), as ``multi_counts`` gives them from the cases."""
        keys = KEYS[:depth]
        return self.rows(f, dim, *blocks).groupBy("bloco", *keys).agg(F.sum(WEIGHT).alias("n"))

    def flags(self, f: Filters, dim: AreaDim, spec: CaseSpec = TB) -> DataFrame:
        """(sigla, _out, total, one count per flag), as ``flag_counts`` gives them from the cases."""
        by = self.rows(f, dim, "agravos").groupBy("sigla", F.col("k2").alias("_out"))
        return by.agg(*[F.sum(F.when(F.col("k1") == c, F.col(WEIGHT)).otherwise(0)).alias(name) for c, name in
                        ((EVERY, "total"), *((c, c) for c in spec.flags))])

    def report(self) -> DataFrame:
        """(bloco, celulas, casos, celulas_por_mil): how much smaller than the cases each block is."""
        by = self.frame.where((F.col("bloco") != "agravos") | (F.col("k1") == EVERY)).groupBy("bloco")
        return by.agg(F.count(F.lit(1)).alias("celulas"), F.sum(WEIGHT).alias("casos")).withColumn(
            "celulas_por_mil", F.round(F.col("celulas") / F.col("casos") * 1000.0, 1))


def write_cells(df: DataFrame, dim: AreaDim, path: str, years: Sequence[int], spec: CaseSpec = TB, held: Sequence[str] = HELD) -> None:
    """Writes the cells of ``years`` and leaves the folders of other years alone."""
    chosen = df.where(F.col(spec.year).isin(list(years)))
    cells = cells_of(chosen, dim, spec, held).hint("rebalance", F.col("ano"))
    replace_years(cells, path, years, column="ano", order=("ano", "bloco", "sigla"))


def read_cells(spark: SparkSession, path: str, held: Sequence[str] = HELD) -> Cells:
    return Cells(spark.read.schema(_schema(held)).parquet(path), tuple(held))
