"""Distinct places and quantiles from stored partial results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.q_aggregates import summary_sql
from catalog.q_cells import stored_cells
from catalog.q_composites import LAST
from catalog.q_sources import deaths
from catalog.register import ALL_YEARS, N_YEARS, query
from catalog.views import area_dim, cases, every_year, years
from epispark.functions.filters import Filters
from epispark.operators import mergeable
from epispark.plans import composites
from epispark.session import scratch_dir
from epispark.sources.cases import replace_years

SEEN = ("ano_notificacao", "estado_notificacao", "municipio_notificacao")


def stored_bitmaps(spark, sf):
    """Numbers given in two steps, as years come in; bitmaps written by year and read back."""
    path, rows, dim, known = scratch_dir(spark, "places"), cases(spark, sf, *SEEN), area_dim(spark, sf), years(spark, sf)
    first = mergeable.place_numbers(rows.where(F.col("ano_notificacao") == known[0]))
    first.write.parquet(f"{path}/first")
    mergeable.place_numbers(rows, known=spark.read.parquet(f"{path}/first")).write.parquet(f"{path}/numbers")
    maps = mergeable.place_bitmaps(rows, dim, spark.read.parquet(f"{path}/numbers"))
    replace_years(maps.hint("rebalance", F.col("ano")), f"{path}/maps", known, column="ano", order=("ano", "sigla"))
    return spark.read.schema(mergeable.PLACES).parquet(f"{path}/maps")


def choices(spark, sf) -> dict[str, Filters]:
    known = years(spark, sf)
    return {"tudo": Filters(), "ultimos dois": Filters(years=known[-2:]), "duas areas": Filters(years=known[-1:], areas=("N03", "N07")),
            "area": Filters(areas=("N07", "ZZ")), "ausente": Filters(years=(known[-1] + 50,))}


WHERE = {"tudo": "true", "ultimos dois": f"ano_notificacao >= {LAST} - 1", "duas areas": f"ano_notificacao = {LAST} AND uf IN ('N03', 'N07')",
         "area": "uf = 'N07'", "ausente": "false"}


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("places_from_bitmaps", " UNION ALL ".join(
    f"SELECT '{name}' AS escolha, CAST(count(DISTINCT municipio_notificacao) AS BIGINT) AS municipios FROM cases WHERE {where}" for name, where in WHERE.items()))
def places_from_bitmaps(spark, sf):
    maps, dim = stored_bitmaps(spark, sf), area_dim(spark, sf)
    return together([mergeable.distinct_places_of(mergeable.chosen(maps, f, dim)).select(F.lit(name).alias("escolha"), "municipios")
                     for name, f in choices(spark, sf).items()])


@query("places_in_every_year", """SELECT count(*) AS municipios FROM (SELECT municipio_notificacao FROM cases WHERE municipio_notificacao IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT ano_notificacao) = (SELECT count(DISTINCT ano_notificacao) FROM cases))""")
def places_in_every_year(spark, sf):
    return mergeable.places_in_every_year(stored_bitmaps(spark, sf))


@query("place_numbers", "SELECT count(DISTINCT municipio_notificacao) AS lugares, 1::BIGINT AS menor, count(DISTINCT municipio_notificacao) AS maior FROM cases")
def place_numbers(spark, sf):
    """Numbers are dense."""
    path, rows = scratch_dir(spark, "numbers"), cases(spark, sf, *SEEN)
    mergeable.place_numbers(rows).write.parquet(f"{path}/n")
    return spark.read.parquet(f"{path}/n").agg(F.countDistinct("numero").alias("lugares"), F.min("numero").alias("menor"), F.max("numero").alias("maior"))


@query("cells_resumo_places", summary_sql("uf IN ('N01', 'N07')", N_YEARS, ALL_YEARS, "uf IN ('N01', 'N07')", "sigla IN ('N01', 'N07')"))
def resumo_places(spark, sf):
    """The headline record from cells without places, and the places from bitmaps."""
    f = Filters(years=every_year(spark, sf).years, areas=("N01", "N07"))
    return composites.resumo(cases(spark, sf), area_dim(spark, sf), deaths(spark, sf), f, cells=stored_cells(spark, sf), places=stored_bitmaps(spark, sf))


PARTS = (0.1, 0.5, 0.9, 0.99)
MEASURES = {"espera": "datediff(data_inicio_tratamento, data_diagnostico)", "caso": "case_id * 7919 % 1000003"}


@query("quantiles_from_sketches", " UNION ALL ".join(
    f"SELECT '{measure}' AS medida, '{name}' AS escolha, CAST(p AS DOUBLE) AS parte, count(*) AS n, true AS dentro FROM cases, (VALUES {', '.join(f'({p})' for p in PARTS)}) q(p) "
    f"WHERE {where} AND {value} IS NOT NULL GROUP BY ALL"
    for measure, value in (("espera", "espera"), ("caso", "case_id")) for name, where in WHERE.items() if name != "ausente"))
def quantiles_from_sketches(spark, sf):
    """Merged sketches of a measure of few and of one of many values; ``dentro`` says whether the rank of the answer among
    the cases themselves is within the stated error of the rank asked for."""
    rows, dim = cases(spark, sf, *SEEN, "case_id", "data_diagnostico", "data_inicio_tratamento"), area_dim(spark, sf)
    path, known, out = scratch_dir(spark, "sketches"), years(spark, sf), []
    for measure, value in MEASURES.items():
        sketches = mergeable.value_sketches(rows, dim, F.expr(value))
        replace_years(sketches.hint("rebalance", F.col("ano")), f"{path}/{measure}", known, column="ano", order=("ano", "sigla"))
        stored = spark.read.schema(mergeable.SKETCHES).parquet(f"{path}/{measure}")
        for name, f in choices(spark, sf).items():
            answers = mergeable.quantiles(mergeable.chosen(stored, f, dim), PARTS)
            among = f.apply(rows, dim=dim, spec=composites.TB).select(F.expr(value).alias("v")).where("v IS NOT NULL")
            if name == "ausente":
                out.append(answers.select(F.lit(measure).alias("medida"), F.lit(name).alias("escolha"), "parte", "n", F.lit(False).alias("dentro")))
                continue
            # ranks of all answers in one pass: so many values lie below, so many up to it
            value_at = {p: answers.where(F.col("parte") == p).select("valor").scalar() for p in PARTS}
            ranks = among.agg(*[F.struct(F.lit(p).alias("parte"), F.count_if(F.col("v") < at).alias("abaixo"), F.count_if(F.col("v") <= at).alias("ate"),
                                         F.count(F.lit(1)).alias("n")).alias(f"r{k}") for k, (p, at) in enumerate(value_at.items())])
            error = F.lit(mergeable.rank_error())
            inside = (F.col("abaixo") / F.col("n") <= F.col("parte") + error) & (F.col("ate") / F.col("n") >= F.col("parte") - error)
            out.append(ranks.select(F.inline(F.array(*ranks.columns))).select(F.lit(measure).alias("medida"), F.lit(name).alias("escolha"), "parte", "n", inside.alias("dentro")))
    return together(out)
