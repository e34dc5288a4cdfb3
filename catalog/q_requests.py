"""Composites for requests without a year, with years that do not exist, and with unknown areas."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.q_aggregates import AREA_INPUT, SUMMARY_INPUT, area_sql, summary_sql
from catalog.q_composites import CLINICAL, COMORBID, DETAIL, LAST, PROFILE, TREND, WOMEN, stored_history
from catalog.q_sources import deaths
from catalog.register import INCIDENT, N_YEARS, n_if, query, rate
from catalog.views import area_dim, cases, years
from epispark.functions.filters import Filters
from epispark.operators import kpis
from epispark.plans import composites
from epispark.plans.batch import read_history
from epispark.spec import TB, AreaDim

LATEST = "SELECT max(ano_notificacao) FROM cases"
BEFORE = f"SELECT max(ano_notificacao) FROM cases WHERE ano_notificacao < ({LATEST})"
#: Kind of request -> (its filters for a table with these years, the years that it means in SQL, their number).
REQUESTS = {
    "no_year": (lambda known: Filters(), LATEST, 1),
    "absent_year": (lambda known: Filters(years=(known[-1] + 50,)), LATEST, 1),
    "some_years": (lambda known: Filters(years=(known[-1], known[-1] + 50, known[-2], known[-1])), f"{LATEST} UNION ALL {BEFORE}", 2),
}


def picked(body: str, chosen: str) -> str:
    """A twin over the cases of some years only."""
    return f", picked AS (SELECT * FROM cases WHERE ano_notificacao IN ({chosen})) " + body.replace("FROM cases", "FROM picked cases")


def _register(kind: str) -> None:
    asked, chosen, n = REQUESTS[kind]

    def ask(spark, sf) -> Filters:
        return asked(years(spark, sf))

    @query(f"resumo_{kind}", summary_sql("true", n, chosen))
    def resumo(spark, sf):
        return composites.resumo(cases(spark, sf, *SUMMARY_INPUT), area_dim(spark, sf), deaths(spark, sf), ask(spark, sf))

    @query(f"mapa_{kind}", area_sql(n, chosen))
    def mapa(spark, sf):
        return composites.mapa(cases(spark, sf, "ano_notificacao", *AREA_INPUT), area_dim(spark, sf), deaths(spark, sf), ask(spark, sf))

    @query(f"detalhe_uf_{kind}", picked(DETAIL, chosen))
    def detalhe_uf(spark, sf):
        return composites.detalhe_uf(cases(spark, sf), area_dim(spark, sf), ask(spark, sf), "N07")

    for name, build, body in (("perfil", composites.perfil, PROFILE), ("clinico", composites.clinico, CLINICAL), ("comorbidades", composites.comorbidades, COMORBID)):
        query(f"{name}_{kind}", picked(body, chosen))(lambda spark, sf, build=build: build(cases(spark, sf), area_dim(spark, sf), ask(spark, sf)))

    @query(f"tendencia_{kind}", TREND)
    def tendencia(spark, sf):
        """The reference year is the latest of the existing years in each of these requests."""
        return composites.tendencia(cases(spark, sf), area_dim(spark, sf), read_history(spark, stored_history(spark, sf)), deaths(spark, sf),
                                    replace(WOMEN, years=ask(spark, sf).years), years(spark, sf)[0])


for _kind in REQUESTS:
    _register(_kind)


@query("incidence_rate_no_year", f"""SELECT n AS casos_novos, p AS populacao, {rate('n', 'p', 1)} AS incidencia
FROM (SELECT {n_if(INCIDENT)} AS n, (SELECT CAST(sum(populacao) AS BIGINT) FROM area_dim) AS p FROM cases WHERE ano_notificacao IN ({LATEST}))""")
def incidence_rate_no_year(spark, sf):
    return kpis.incidence_rate(cases(spark, sf, *SUMMARY_INPUT), area_dim(spark, sf), Filters())


def with_table(dim: AreaDim) -> AreaDim:
    """The same dimension with its spellings as a table, which is joined."""
    return AreaDim(dim.areas, dim.names.select("spelling", "sigla"), dim.population)


@query("filter_area_unknown", """SELECT 'literais' AS forma, CAST(count(*) AS BIGINT) AS nenhuma, count(*) FILTER (uf = 'N03') AS algumas FROM cases
UNION ALL SELECT 'tabela', count(*), count(*) FILTER (uf = 'N03') FROM cases""")
def filter_area_unknown(spark, sf):
    """Unknown areas do not restrict, known ones among them do, in either form of the dimension."""
    rows, dim = cases(spark, sf, "ano_notificacao", "estado_notificacao"), area_dim(spark, sf)

    def count(areas, d):
        return Filters(areas=areas).apply(rows, TB, d).agg(F.count(F.lit(1))).scalar()

    found = [spark.range(1).select(F.lit(name).alias("forma"), count(("ZZ",), d).alias("nenhuma"), count(("ZZ", "N03"), d).alias("algumas"))
             for name, d in (("literais", dim), ("tabela", with_table(dim)))]
    return found[0].unionByName(found[1])


@query("resumo_unknown_area", summary_sql("true", N_YEARS, "SELECT ano_notificacao FROM cases"))
def resumo_unknown_area(spark, sf):
    """Cases, registry and population agree that an unknown area does not restrict."""
    f = Filters(years=years(spark, sf), areas=("ZZ",))
    return composites.resumo(cases(spark, sf, *SUMMARY_INPUT), with_table(area_dim(spark, sf)), deaths(spark, sf), f)
