"""What a case table looks like: column roles, vocabularies and the area dimension.

Operators never name a column themselves; they read it from a ``CaseSpec``. Another
disease is another ``CaseSpec``, not other code.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.functions.text import unaccent_text
from epispark.literals import literal_rows
from epispark.presets import tuberculosis as tb

# Up to so many spellings are broadcast and listed in conditions; beyond, they are joined as a table.
SMALL_DIMENSION = 5_000


@dataclass(frozen=True)
class CaseSpec:
    """Column roles and vocabularies of one case table."""

    year: str = "ano_notificacao"
    date: str = "data_notificacao"
    diagnosed: str = "data_diagnostico"
    started: str = "data_inicio_tratamento"
    closed: str = "data_encerramento"
    area: str = "estado_notificacao"
    place: str = "municipio_notificacao"
    sex: str = "sexo"
    age: str = "idade_anos"
    age_text: str = "idade_notificada"
    race: str = "raca_cor"
    schooling: str = "escolaridade"
    entry: str = "tipo_entrada"
    form: str = "forma"
    outcome: str = "situacao_encerramento"
    hiv: str = "status_hiv"
    smear: str = "baciloscopia_primeira_amostra"
    molecular: str = "teste_molecular"

    comorbidities: Mapping[str, str] = field(default_factory=lambda: tb.COMORBIDITIES)
    populations: Mapping[str, str] = field(default_factory=lambda: tb.POPULATIONS)
    outcome_spellings: Mapping[str, str] = field(default_factory=lambda: tb.OUTCOME_SPELLINGS)
    outcome_groups: Mapping[str, str] = field(default_factory=lambda: tb.OUTCOME_GROUPS)
    group_order: tuple[str, ...] = tb.GROUP_ORDER
    open_outcome: str = "Em acompanhamento"
    ungrouped: str = "Não avaliado"
    cure: str = "Cura"
    dropout: tuple[str, ...] = ("Abandono", "Abandono Primário")
    death: str = "Óbito por TB"
    new_case: str = "Caso Novo"
    incidence_entries: tuple[str, ...] = tb.INCIDENCE_ENTRIES
    retreatment_entries: tuple[str, ...] = tb.RETREATMENT_ENTRIES
    sexes: tuple[str, ...] = ("Masculino", "Feminino")
    positive: str = "Positivo"
    negative: str = "Negativo"
    pulmonary: str = "Pulmonar"
    age_bands: tuple = tb.AGE_BANDS_11
    wait_buckets: tuple = tb.WAIT_BUCKETS
    unknown: str = "Não informado"

    @property
    def flags(self) -> dict[str, str]:
        return {**self.comorbidities, **self.populations}


TB = CaseSpec()


@dataclass(frozen=True)
class AreaDim:
    """The area dimension. ``areas`` holds one (sigla, nome, regiao, codigo) per area and
    ``spellings`` pairs every spelling found in the data with its area code, as literal rows or as
    a table (spelling, sigla). ``population`` (sigla, populacao) is a table.

    Literal rows of a small, checked number are broadcast; anything larger is an ordinary join."""

    areas: tuple[tuple[str, str, str, str], ...]
    spellings: tuple[tuple[str, str], ...] | DataFrame
    population: DataFrame

    @property
    def is_small(self) -> bool:
        return not isinstance(self.spellings, DataFrame) and max(len(self.areas), len(self.spellings)) <= SMALL_DIMENSION

    @cached_property
    def codes(self) -> frozenset[str]:
        return frozenset(a[0] for a in self.areas)

    def hinted(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.is_small else table

    @property
    def spark(self) -> SparkSession:
        return self.population.sparkSession

    def variants(self, area_codes) -> list[str]:
        """Spellings of the areas; only for a small dimension."""
        if isinstance(self.spellings, DataFrame):
            raise ValueError("the spellings are a table; join it")
        wanted = set(area_codes)
        return [name for name, code in self.spellings if code in wanted]

    def in_regions(self, regions) -> tuple[str, ...]:
        return tuple(a[0] for a in self.areas if a[2] in set(regions))

    @cached_property
    def table(self) -> DataFrame:
        """(sigla, nome, regiao, codigo), one row per area."""
        return literal_rows(
            self.spark, self.areas, "sigla string, nome string, regiao string, codigo string")

    @cached_property
    def names(self) -> DataFrame:
        """(spelling, sigla), one row per spelling."""
        if isinstance(self.spellings, DataFrame):
            return self.spellings.select("spelling", "sigla")
        return literal_rows(self.spark, self.spellings, "spelling string, sigla string")

    def population_at_risk(self, area_codes=()) -> Column:
        """Scalar population of the chosen areas, or of all when the choice is empty or unknown."""
        total = F.sum("populacao")
        area_codes = [a for a in area_codes if a in self.codes]
        if not area_codes:
            return self.population.agg(total).scalar()
        chosen = F.sum(F.when(F.col("sigla").isin(list(area_codes)), F.col("populacao")))
        return self.population.agg(F.when(chosen > 0, chosen).otherwise(total)).scalar()


def brazil(spark: SparkSession) -> AreaDim:
    """Area dimension of the tuberculosis preset."""
    region_of = {code: region for region, codes in tb.REGIONS.items() for code in codes}
    areas, spellings, population = [], [], []
    for code, (name, number, people) in tb.AREAS.items():
        areas.append((code, name, region_of[code], number))
        population.append((code, people))
        # The data carries each name with and without accents.
        spellings += [(s, code) for s in dict.fromkeys((name, unaccent_text(name)))]
    return AreaDim(tuple(areas), tuple(spellings),
                   literal_rows(spark, population, "sigla string, populacao long"))
