"""Composite queries: each returns one long table of blocks, from as few scans as possible.

The pattern: count once by a few raw key combinations (the only pass over the cases), then
recode, merge and derive shares on those few result rows. With published ``cells``
(``plans.cells``) the first step reads those in place of the cases, if they hold the filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epispark.functions.clean import (
    attach_area, band, canonical_outcome, has_outcome, is_closed, month_label, month_of, outcome_group)
from epispark.functions.filters import Filters, resolve
from epispark.functions.measures import pct1, pct1_min1, pct1_min1_sql, pct1_sql, variation_pct
from epispark.functions.predicates import (
    PLAUSIBLE_DURATION, PLAUSIBLE_START, baseline_years, known_status, plausible)
from epispark.functions.text import clean_label, fold_key, is_valid_label, strip_ws
from epispark.literals import literal_rows, sql_map, sql_text
from epispark.operators.areas import area_indicators, n_if
from epispark.operators.counts import after_count, count_by, multi_counts, selection_choices
from epispark.operators.history import indicator_series_long
from epispark.operators.kpis import base_total, headline, summary_kpis
from epispark.operators.mergeable import chosen, distinct_places_of
from epispark.operators.outcomes import flag_counts, label_of
from epispark.operators.registry import registry_deaths_series
from epispark.operators.waits import duration, start_wait
from epispark.plans.cells import STATES, WEIGHT, Cells
from epispark.sources.tables import microdata
from epispark.spec import TB, AreaDim, CaseSpec


def _row(bloco: str, categoria: str, grupo: str = "string(NULL)", n: str = "n") -> str:
    """One result row as SQL; the arguments are SQL expressions."""
    return f"named_struct('bloco', {bloco}, 'categoria', {categoria}, 'grupo', {grupo}, 'n', bigint({n}))"


def _group_rows(bloco: str, categoria: str, spec: CaseSpec) -> list[str]:
    """One row per outcome group, zero for the groups a cell does not belong to."""
    return [_row(bloco, categoria, sql_text(g), f"IF(grupo_desfecho = {sql_text(g)}, n, 0)") for g in spec.group_order]


def _array(*rows: str) -> str:
    return f"array({', '.join(rows)})"


def _merge(cells: DataFrame, rows: str) -> DataFrame:
    """Turns each counted cell into its block rows and sums equal ones."""
    return (cells.selectExpr(f"inline({rows})").groupBy("bloco", "categoria", "grupo")
            .agg(F.sum("n").alias("n")))


def _recoded(cells: DataFrame, bloco: str, spec: CaseSpec) -> DataFrame:
    """Cleaned first key and, in ``bloco``, the outcome held in the second one: evaluated once per cell."""
    outcome = F.when(F.col("bloco") == bloco, canonical_outcome(F.col("k2"), spec))
    return cells.withColumns({
        "rotulo": clean_label(F.col("k1"), spec.unknown), "aparado": strip_ws(F.col("k1")),
        "valido": is_valid_label(F.col("k1"), ("nao informado",)), "desfecho": outcome,
    }).withColumn("grupo_desfecho", outcome_group(F.col("desfecho"), spec))


def _shares(merged: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """Share inside the category for cross-tab ``blocks``; no share elsewhere."""
    total = F.sum("n").over(W.partitionBy("bloco", "categoria"))
    pct = F.when(F.col("bloco").isin(*blocks), pct1_min1(F.col("n"), total))
    return merged.select("bloco", "categoria", "grupo", F.col("n").cast("double").alias("valor"), pct.alias("pct"))


def meta(df: DataFrame, dim: AreaDim, spec: CaseSpec = TB, choices: DataFrame | None = None) -> DataFrame:
    """(bloco, valor, rotulo, grupo): years, partial year, filter choices, areas and flags.

    With the published ``choices`` (``batch.write_choices``) the cases are not read at all."""
    choices = selection_choices(df, spec) if choices is None else choices
    # Only the calendar years are compared with each other; the choices of other blocks stay spread.
    spread = F.when(F.col("bloco") == "anos", F.lit(0)).otherwise(F.xxhash64("valor"))
    latest = F.max("valor").over(W.partitionBy("bloco", spread))
    marked = choices.withColumn("_last", (F.col("bloco") == "anos") & (F.col("valor") == latest))
    blocks = F.when(F.col("_last"), F.array(F.lit("anos"), F.lit("ano_parcial"))).otherwise(F.array("bloco"))
    found = marked.select(F.explode(blocks).alias("bloco"), "valor", F.expr("string(NULL) AS rotulo"), F.expr("string(NULL) AS grupo"))
    fixed = [("ufs", code, name, region) for code, name, region, _ in dim.areas]
    fixed += [("vulneraveis", c, label, None) for c, label in spec.populations.items()]
    fixed += [("agravos", c, label, None) for c, label in spec.comorbidities.items()]
    schema = "bloco string, valor string, rotulo string, grupo string"
    return found.unionByName(literal_rows(df.sparkSession, fixed, schema))


def _asked(df: DataFrame, dim: AreaDim, f: Filters, spec: CaseSpec, cells: Cells | None) -> tuple[Filters, Cells | None]:
    """The request as it is meant, and the cells if they hold what it restricts."""
    if not f.resolved and cells is not None:
        f = f.resolve(cells.years(), dim)
    f = resolve(df, f, spec, dim)
    return f, cells if cells is not None and cells.holds(f) else None


def resumo(df: DataFrame, dim: AreaDim, deaths: DataFrame | None, f: Filters, spec: CaseSpec = TB,
           annual: DataFrame | None = None, cells: Cells | None = None, places: DataFrame | None = None) -> DataFrame:
    """The headline record; with the published annual history the unfiltered total comes from there. With the
    published bitmaps of ``places``, a choice of years and areas reads cells that do not hold the places."""
    f, cells = _asked(df, dim, f, spec, cells)
    if cells is None:
        return summary_kpis(df, dim, deaths, f, spec, annual)
    if annual is None:
        annual = cells.rows(Filters(), dim, STATES).select(F.col("ano").alias("nu_ano"), F.col(WEIGHT).alias("casos"))
    by_place = places is None or any(getattr(f, name) for name in cells.held)
    found = None if by_place else distinct_places_of(chosen(places, f, dim)).scalar()
    return headline(cells.states(f, dim, spec, places=by_place), base_total(df, f, spec, annual), dim, deaths, f, spec, WEIGHT, found)


def mapa(df: DataFrame, dim: AreaDim, deaths: DataFrame | None, f: Filters, spec: CaseSpec = TB, cells: Cells | None = None) -> DataFrame:
    f, cells = _asked(df, dim, f, spec, cells)
    if cells is not None:
        return area_indicators(cells.states(f, dim, spec), dim, deaths, f.years, f.n_years, spec, WEIGHT)
    return area_indicators(f.apply(df, spec, dim), dim, deaths, f.years, f.n_years, spec)


def detalhe_uf(df: DataFrame, dim: AreaDim, f: Filters, area: str, spec: CaseSpec = TB, cells: Cells | None = None) -> DataFrame:
    """(bloco, rotulo, indicador, valor): places of one area and the area's cohort indicators.

    The places are counted once; the area's record is the sum over its places."""
    if area not in dim.codes:
        raise ValueError(f"unknown area: {area}")
    closed = is_closed(spec)
    cured = has_outcome(spec.cure, spec)
    new = F.col(spec.entry) == spec.new_case
    again = F.col(spec.entry).isin(*spec.retreatment_entries)
    counts = {
        "casos": F.lit(True), "cura": cured, "abandono": has_outcome(spec.dropout, spec),
        "obito": has_outcome(spec.death, spec), "pos": F.col(spec.hiv) == spec.positive,
        "conhecido": known_status(spec), "encerrados": closed, "enc_novo": new & closed, "cura_novo": new & cured,
        "enc_retrat": again & closed, "cura_retrat": again & cured,
    }
    f, cells = _asked(df, dim, f, spec, cells)
    f = f.for_areas(area)
    rows, weight = (f.apply(df, spec, dim), None) if cells is None else (cells.states(f, dim, spec, places=True), WEIGHT)
    places = rows.groupBy(F.trim(spec.place).alias("rotulo")).agg(*[n_if(c, k, weight) for k, c in counts.items()])
    # One row of zeros, so that an empty selection has a record too.
    nothing = literal_rows(df.sparkSession, [(None, *[0] * len(counts))], ", ".join(["rotulo string", *[f"{k} long" for k in counts]]))
    places = places.unionByName(nothing).withColumn("lugares", F.when(F.col("rotulo").isNotNull(), 1).otherwise(0))
    both = places.groupingSets([[F.col("rotulo")], []], "rotulo").agg(
        *[F.sum(k).alias(k) for k in (*counts, "lugares")], F.grouping_id().alias("gid"))

    def item(name: str, value: str) -> str:
        return f"named_struct('indicador', '{name}', 'valor', double({value}))"

    place = _array(item("casos", "casos"), *[item(name, pct1_sql(part, whole)) for name, part, whole in (
        ("cura_pct", "cura", "casos"), ("abandono_pct", "abandono", "casos"), ("obito_pct", "obito", "casos"),
        ("hiv_pct", "pos", "conhecido"))])
    rates = [item(name, pct1_min1_sql(part, whole)) for name, part, whole in (
        ("cura_pct", "cura", "encerrados"), ("abandono_pct", "abandono", "encerrados"), ("obito_pct", "obito", "encerrados"),
        ("cura_novo_pct", "cura_novo", "enc_novo"), ("cura_retrat_pct", "cura_retrat", "enc_retrat"),
        ("hiv_pct", "pos", "conhecido"))]
    numbers = [item(name, value) for name, value in (
        ("total", "casos"), ("total_municipios", "lugares"), ("encerrados", "encerrados"), ("n_enc_novo", "enc_novo"),
        ("n_enc_retrat", "enc_retrat"), ("n_hiv_conhecido", "conhecido"))]
    kept = both.where((F.col("gid") == 1) | F.col("rotulo").isNotNull())
    named = kept.select("*", fold_key(F.col("rotulo")).alias("nm_norm"), F.expr("IF(gid = 1, 'kpis', 'municipios') AS bloco"))
    items = f"IF(gid = 1, {_array(*numbers, *rates)}, {place})"
    return named.selectExpr("bloco", "rotulo", "nm_norm", f"inline({items})")


def perfil(df: DataFrame, dim: AreaDim, f: Filters, spec: CaseSpec = TB, cells: Cells | None = None) -> DataFrame:
    """(bloco, categoria, grupo, valor, pct): five counts, outcomes, outcome by race, pyramids."""
    f, published = _asked(df, dim, f, spec, cells)
    blocks = {"sexo": [spec.sex], "forma": [spec.form], "tipo_entrada": [spec.entry],
              "escolaridade": [spec.schooling], "raca": [spec.race, spec.outcome]}
    rows = f.apply(df, spec, dim)
    cells = multi_counts(rows, blocks) if published is None else published.counts(f, dim, *blocks)
    cells = _recoded(cells, "raca", spec)
    cells = cells.withColumn("desfecho", clean_label(F.col("desfecho"), spec.unknown))
    common = [_row("'raca_cor'", "rotulo"), _row("'desfecho'", "desfecho"), _row("'desfecho_grupo'", "grupo_desfecho")]
    crossed = _array(*common, *_group_rows("'desfecho_por_raca'", "aparado", spec))
    block_rows = f"IF(bloco = 'raca', IF(valido, {crossed}, {_array(*common)}), {_array(_row('bloco', 'rotulo'))})"
    labels = _shares(_merge(cells, block_rows), ["desfecho_por_raca"])

    if published is None:
        aged = rows.where(F.col(spec.age).isNotNull() & F.col(spec.sex).isin(*spec.sexes))
        tower = count_by(aged, band(spec.age, spec.age_bands).alias("faixa"), F.col(spec.sex).alias("sexo"),
                         F.coalesce(has_outcome(spec.death, spec), F.lit(False)).alias("morte"), name="n")
    else:
        tower = published.rows(f, dim, "idade").select(F.col("k1").alias("faixa"), F.col("k2").alias("sexo"), (F.col("k3") == "true").alias("morte"), F.col(WEIGHT).alias("n"))
    tower = tower.where(after_count(F.col("faixa").isNotNull()))
    grid = literal_rows(
        df.sparkSession, [(b[0], s, True, 0) for b in spec.age_bands for s in spec.sexes], "faixa string, sexo string, morte boolean, n long")
    pyramid = _merge(tower.unionByName(grid), _array(
        _row("'piramide_casos'", "faixa", "sexo"), _row("'piramide_obitos'", "faixa", "sexo", "IF(morte, n, 0)")))
    return labels.unionByName(_shares(pyramid, [""]))


def clinico(df: DataFrame, dim: AreaDim, f: Filters, spec: CaseSpec = TB, cells: Cells | None = None) -> DataFrame:
    """(bloco, categoria, grupo, valor, pct): status and test counts, outcome by status,
    positivity by area, waiting times. One scan for the labels, one for the dates."""
    f, published = _asked(df, dim, f, spec, cells)
    if published is None:
        rows = f.apply(df, spec, dim)
        days = _days(rows, spec)
        cells = multi_counts(attach_area(rows, dim, spec, "left"), {
            "hiv": [spec.hiv, spec.outcome], "baciloscopia": [spec.smear], "teste_molecular": [spec.molecular],
            "area": ["sigla", spec.hiv]})
    else:
        days = published.counts(f, dim, "espera", "duracao", depth=1)
        stored = published.rows(f, dim, "hiv", "baciloscopia", "teste_molecular")
        # a status counts in its own block and in that of its area
        copies = F.array(F.struct("bloco", "k1", "k2"), F.when(F.col("bloco") == "hiv", F.struct(F.lit("area").alias("bloco"), F.col("sigla").alias("k1"), F.col("k1").alias("k2"))))
        cells = stored.select(WEIGHT, F.inline(F.array_compact(copies))).groupBy("bloco", "k1", "k2").agg(F.sum(WEIGHT).alias("n"))
    cells = _recoded(cells, "hiv", spec)
    positive, known = sql_text(spec.positive), f"({sql_text(spec.positive)}, {sql_text(spec.negative)})"
    status = _row("'status_hiv'", "rotulo")
    crossed = _array(status, *_group_rows("'desfecho_por_hiv'", "k1", spec))
    by_area = _array(_row("'coinfeccao_uf'", "k1", "'positivos'", f"IF(k2 = {positive}, n, 0)"),
                     _row("'coinfeccao_uf'", "k1", "'n_testado'", f"IF(k2 IN {known}, n, 0)"))
    block_rows = (f"CASE bloco WHEN 'hiv' THEN IF(k1 IN {known}, {crossed}, {_array(status)}) "
                  f"WHEN 'area' THEN IF(k1 IS NOT NULL, {by_area}, NULL) ELSE {_array(_row('bloco', 'rotulo'))} END")
    merged = _merge(cells, block_rows)
    # Positivity: positives over tested; the tested row carries the denominator of its area.
    is_area = F.col("bloco") == "coinfeccao_uf"
    denominator = F.max(F.when(F.col("grupo") == "n_testado", F.col("n"))).over(W.partitionBy("bloco", "categoria"))
    total = F.sum("n").over(W.partitionBy("bloco", "categoria"))
    pct = (F.when(F.col("bloco") == "desfecho_por_hiv", pct1_min1(F.col("n"), total))
           .when(is_area & (F.col("grupo") == "positivos"), pct1(F.col("n"), denominator)))
    labels = merged.select("bloco", "categoria", "grupo", F.col("n").cast("double").alias("valor"), pct.alias("pct"))
    return labels.unionByName(_waiting(days, spec))


def _days(rows: DataFrame, spec: CaseSpec) -> DataFrame:
    """(bloco, k1, n): start wait and duration of treatment per day, from one scan of the date columns."""
    wait, length = start_wait(spec), duration(spec)
    days = rows.select(
        F.when(plausible(wait, PLAUSIBLE_START), wait).alias("espera"),
        F.when(is_closed(spec) & plausible(length, PLAUSIBLE_DURATION), length).alias("duracao"))
    return multi_counts(days, {"espera": ["espera"], "duracao": ["duracao"]})


def _waiting(cells: DataFrame, spec: CaseSpec) -> DataFrame:
    """Figures of the waits from their counts per day."""
    buckets = [F.expr(f"sum(IF(bloco = 'espera' AND faixa = {sql_text(b[0])}, n, 0)) AS b{i}")
               for i, b in enumerate(spec.wait_buckets)]

    def median(bloco: str) -> str:
        # Rows of the other measure weigh nothing in this median.
        return f"percentile(IF(bloco = '{bloco}', d, NULL), 0.5, IF(bloco = '{bloco}', n, 0L)) AS mediana_{bloco}"

    per_day = cells.where(F.col("k1").isNotNull()).withColumn("d", F.col("k1").cast("int"))
    s = per_day.withColumn("faixa", band("d", spec.wait_buckets)).agg(
        F.expr("sum(IF(bloco = 'espera', n, 0)) AS n"), F.expr(median("espera")), F.expr(median("duracao")),
        F.expr("sum(IF(bloco = 'espera' AND d <= 7, n, 0)) AS ate"),
        F.expr("sum(IF(bloco = 'espera' AND d > 30, n, 0)) AS acima"), *buckets).where(F.col("n") > 0)

    def item(bloco: str, name: str, value: str, pct: str = "double(NULL)") -> str:
        return (f"named_struct('bloco', '{bloco}', 'categoria', {sql_text(name)}, 'grupo', string(NULL), "
                f"'valor', double({value}), 'pct', {pct})")

    items = [item("tempo_tratamento", "n", "n"), item("tempo_tratamento", "mediana_inicio", "mediana_espera"),
             item("tempo_tratamento", "ate_7d", "ate", pct1_sql("ate", "n")),
             item("tempo_tratamento", "acima_30d", "acima", pct1_sql("acima", "n")),
             item("tempo_tratamento", "duracao_mediana", "mediana_duracao")]
    items += [item("histograma", b[0], f"b{i}") for i, b in enumerate(spec.wait_buckets)]
    return s.selectExpr(f"inline({_array(*items)})")


def comorbidades(df: DataFrame, dim: AreaDim, f: Filters, spec: CaseSpec = TB, cells: Cells | None = None) -> DataFrame:
    """(bloco, categoria, grupo, valor, pct): flag prevalence, outcome by vulnerable group,
    flags by area. One scan: flags are counted by (area, raw outcome), the rest is sums of that."""
    flags = spec.flags
    f, published = _asked(df, dim, f, spec, cells)
    cells = (flag_counts(attach_area(f.apply(df, spec, dim), dim, spec, "left"), ["sigla", F.col(spec.outcome).alias("_out")], list(flags))
             if published is None else published.flags(f, dim, spec))
    # One cell of zeros, so that an empty selection has a record too.
    sums = cells.unionByName(literal_rows(
        df.sparkSession, [(None, None, *[0] * (1 + len(flags)))], ", ".join(
            ["sigla string", "_out string", "total long", *[f"{c} long" for c in flags]]))).groupingSets([[F.col("sigla")], [F.col("_out")], []], "sigla", "_out").agg(
        *[F.sum(c).alias(c) for c in ("total", *flags)], F.grouping_id().alias("gid"))
    group = outcome_group(canonical_outcome(F.col("_out"), spec), spec)
    long = (sums.withColumn("casos", F.col("total")).unpivot(["sigla", "_out", "gid", "total"], ["casos", *flags], "coluna", "n")
            .withColumns({"rotulo": label_of({"casos": "total", **flags}), "grupo_desfecho": group,
                          "familia": sql_map({"casos": "total", **dict.fromkeys(spec.comorbidities, "agravos"),
                                              **dict.fromkeys(spec.populations, "populacoes")})[F.col("coluna")]}))

    def item(bloco: str, categoria: str, grupo: str, n: str, total: str) -> str:
        return f"named_struct('bloco', {bloco}, 'categoria', {categoria}, 'grupo', {grupo}, 'n', bigint({n}), 'total', bigint({total}))"

    # gid has one bit per key, set when the key is summed over: 3 = whole, 2 = outcome, 1 = area.
    whole = _array(item("familia", "rotulo", "string(NULL)", "n", "total"))
    outcome = _array(*[item("'desfecho_por_vulneravel'", "rotulo", sql_text(g), f"IF(grupo_desfecho = {sql_text(g)}, n, 0)", "n")
                       for g in spec.group_order])
    area = _array(item("'heatmap_uf'", "sigla", "rotulo", "n", "total"))
    rows = (f"CASE WHEN gid = 3 THEN {whole} WHEN gid = 2 AND familia = 'populacoes' THEN {outcome} "
            f"WHEN gid = 1 AND familia = 'agravos' AND sigla IS NOT NULL THEN {area} END")
    merged = (long.selectExpr(f"inline({rows})").groupBy("bloco", "categoria", "grupo")
              .agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    kept = merged.where((F.col("bloco") != "desfecho_por_vulneravel") | (F.col("total") > 0))
    pct = F.when(F.col("bloco") != "total", pct1_min1(F.col("n"), F.col("total")))
    return kept.select("bloco", "categoria", "grupo", F.col("n").cast("double").alias("valor"), pct.alias("pct"))


def tendencia(df: DataFrame, dim: AreaDim, history: dict[str, DataFrame] | None, deaths: DataFrame | None, f: Filters,
              first_year: int, spec: CaseSpec = TB, cells: Cells | None = None) -> DataFrame:
    """(bloco, categoria, indicador, valor): the reference year against the national history.

    Without a history, or a table of it, its blocks are left out and the means are null or zero as
    for years without cases; without a registry the block of official deaths is left out. Filters apply to the reference year only. One scan of that year; everything else comes from
    the history tables, which have a few thousand rows at most."""
    f, published = _asked(df, dim, f, spec, cells)
    year = f.reference_year if f.years else first_year  # a table without years has no cases of any
    history = history or {}
    spark = df.sparkSession
    monthly = history.get("mensal", literal_rows(spark, [], "nu_ano int, mes_num int, casos long"))
    by_state = history.get("estadual", literal_rows(spark, [], "nu_ano int, uf_sigla string, casos long"))
    f = f.for_years(year)
    if published is None:
        rows = attach_area(f.apply(df, spec, dim), dim, spec, "left")
        cells = multi_counts(rows.select(month_of(F.col(spec.date)).alias("mes"), "sigla"), {"mensal": ["mes"], "estadual": ["sigla"]})
    else:
        both = F.array(F.struct(F.lit("mensal").alias("bloco"), "k1"), F.struct(F.lit("estadual").alias("bloco"), F.col("sigla").alias("k1")))
        cells = published.rows(f, dim, "mes").select(WEIGHT, F.inline(both)).groupBy("bloco", "k1").agg(F.sum(WEIGHT).alias("n"))
    cells = cells.where(F.col("k1").isNotNull())
    zero = F.lit(0).cast("long")
    current = cells.select("bloco", F.col("k1").alias("chave"), F.col("n").alias("atual"), zero.alias("soma"), zero.alias("anos"))
    in_base = baseline_years(F.col("nu_ano"), first_year, year)

    def base(table: DataFrame, bloco: str, key: str) -> DataFrame:
        return (table.where(in_base).groupBy(F.col(key).cast("string").alias("chave"))
                .agg(F.sum("casos").alias("soma"), F.count("casos").alias("anos"))
                .select(F.lit(bloco).alias("bloco"), "chave", zero.alias("atual"), "soma", "anos"))

    yearly = monthly.where(in_base).agg(
        F.coalesce(F.sum("casos"), F.lit(0)).alias("soma"), F.countDistinct("nu_ano").alias("anos"))
    yearly = yearly.select(F.lit("kpis").alias("bloco"), F.lit("ano").alias("chave"), zero.alias("atual"), "soma", "anos")
    months = df.sparkSession.range(1, 13).select(
        F.lit("mensal").alias("bloco"), F.col("id").cast("string").alias("chave"),
        zero.alias("atual"), zero.alias("soma"), zero.alias("anos"))
    parts = current.unionByName(base(monthly, "mensal", "mes_num")).unionByName(
        base(by_state, "estadual", "uf_sigla")).unionByName(yearly).unionByName(months)
    # A month also counts towards the yearly total.
    copies = F.when((F.col("bloco") == "mensal") & (F.col("atual") > 0), F.array(
        F.struct("bloco", "chave", "atual", "soma", "anos"),
        F.struct(F.lit("kpis").alias("bloco"), F.lit("ano").alias("chave"), "atual", zero.alias("soma"), zero.alias("anos")),
    )).otherwise(F.array(F.struct("bloco", "chave", "atual", "soma", "anos")))
    sums = (parts.select(F.inline(copies)).groupBy("bloco", "chave")
            .agg(F.sum("atual").alias("atual"), F.sum("soma").alias("soma"), F.sum("anos").alias("anos")))
    has_history = F.max(F.when(F.col("bloco") == "kpis", F.col("anos"))).over(W.partitionBy(F.lit(0))) > 0
    mean = F.try_divide(F.col("soma").cast("double"), F.col("anos").cast("double"))
    ready = sums.withColumn("_h", has_history).withColumn("media", mean).where(
        (F.col("bloco") != "estadual") | (F.col("media") > 0))

    def item(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("indicador"), value.cast("double").alias("valor"))

    filled = F.coalesce("media", F.lit(0.0))
    change = item("variacao_pct", variation_pct(F.col("atual"), F.col("media")))
    by_month = F.array(item("casos", F.col("atual")), item("media_hist", F.when(F.col("_h"), F.round(filled, 0))))
    by_area = F.array(item("casos", F.col("atual")), item("media_hist", F.round("media", 0)), change)
    total = F.array(item("total_ano", F.col("atual")), item("media_anual_hist", F.round(filled, 0)), change)
    pick = F.when(F.col("bloco") == "mensal", by_month).when(F.col("bloco") == "estadual", by_area).otherwise(total)
    label = F.when(F.col("bloco") == "mensal", month_label(F.col("chave").try_cast("int"))).otherwise(F.col("chave"))
    compared = (ready.select("bloco", label.alias("categoria"), F.explode(pick).alias("i"))
                .select("bloco", "categoria", "i.indicador", "i.valor"))

    def series(table: DataFrame, bloco: str, key: str, indicator: Column, value: str) -> DataFrame:
        return table.select(F.lit(bloco).alias("bloco"), F.col(key).cast("string").alias("categoria"),
                            indicator.alias("indicador"), F.col(value).cast("double").alias("valor"))

    if "anual" in history:
        compared = compared.unionByName(series(history["anual"], "anual", "nu_ano", F.lit("casos"), "casos"))
    if deaths is not None:
        compared = compared.unionByName(series(registry_deaths_series(deaths), "obitos_anual", "ano", F.lit("obitos"), "obitos"))
    if "indicadores" in history:
        compared = compared.unionByName(series(
            indicator_series_long(history["indicadores"]), "indicadores", "nu_ano", F.col("indicador"), "valor"))
    return compared


def export(df: DataFrame, dim: AreaDim, f: Filters, spec: CaseSpec = TB) -> DataFrame:
    return microdata(df, f, dim, spec)
