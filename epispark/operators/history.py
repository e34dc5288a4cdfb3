"""Pre-aggregated history and comparison with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epispark.functions.clean import attach_area, has_outcome, is_closed, month_label, month_of
from epispark.functions.measures import direction, pct1_min1, variation_pct
from epispark.functions.predicates import baseline_years
from epispark.functions.text import is_yes
from epispark.operators.areas import n_if
from epispark.literals import sql_map
from epispark.operators.counts import count_by, zero_fill
from epispark.presets.tuberculosis import INDICATOR_LABELS
from epispark.spec import TB, AreaDim, CaseSpec


def _year(spec: CaseSpec):
    return F.col(spec.year).cast("int").alias("nu_ano")


def history_monthly(df: DataFrame, spec: CaseSpec = TB) -> DataFrame:
    """(nu_ano, mes_num, casos), valid dates only."""
    month = month_of(F.col(spec.date))
    return count_by(df.where(month.isNotNull()), _year(spec), month.alias("mes_num"))


def history_by_area(df: DataFrame, dim: AreaDim, spec: CaseSpec = TB) -> DataFrame:
    """(nu_ano, uf_sigla, casos). Spellings are mapped before grouping: one row per year and area."""
    return count_by(attach_area(df, dim, spec), _year(spec), F.col("sigla").alias("uf_sigla"))


def history_annual(df: DataFrame, spec: CaseSpec = TB) -> DataFrame:
    return count_by(df, _year(spec))


def history_indicators(df: DataFrame, spec: CaseSpec = TB, canonical: bool = True) -> DataFrame:
    """Total, twelve conditional counts and nine percentages per year, one pass.

    ``canonical=False`` compares raw, accented spellings as the older job did, which misses
    unaccented source years."""
    outcome = F.trim(F.col(spec.outcome))
    closed = is_closed(spec, outcome) & (outcome != "")
    if canonical:
        cured, dropped, died = (has_outcome(x, spec, outcome) for x in (spec.cure, spec.dropout, spec.death))
    else:
        cured, dropped, died = outcome == spec.cure, outcome.isin(*spec.dropout), outcome == spec.death
    hiv = F.lower(F.trim(F.col(spec.hiv)))
    positive, negative = spec.positive.lower(), spec.negative.lower()
    counts = df.groupBy(_year(spec)).agg(
        F.count(F.lit(1)).alias("total"),
        n_if(hiv == positive, "hiv_pos"), n_if(hiv.isin(positive, negative), "hiv_testado"),
        n_if(cured, "cura"), n_if(dropped, "abandono"), n_if(died, "obito_tb"), n_if(closed, "encerrados"),
        n_if(F.trim(F.col(spec.entry)) == spec.new_case, "caso_novo"),
        n_if(F.trim(F.col(spec.form)) == spec.pulmonary, "pulmonar"),
        n_if(is_yes(F.col("agravo_aids"), True), "aids"),
        n_if(is_yes(F.col("agravo_alcoolismo"), True), "alcool"),
        n_if(is_yes(F.col("populacao_situacao_rua"), True), "pop_rua"),
        n_if(is_yes(F.col("populacao_privada_liberdade"), True), "pop_liber"))
    ratios = {
        "pct_hiv": ("hiv_pos", "hiv_testado"), "pct_test_hiv": ("hiv_testado", "total"),
        "pct_cura": ("cura", "encerrados"), "pct_abandon": ("abandono", "encerrados"),
        "pct_obito": ("obito_tb", "encerrados"), "pct_novo": ("caso_novo", "total"),
        "pct_pulm": ("pulmonar", "total"), "pct_aids": ("aids", "total"), "pct_alcool": ("alcool", "total"),
    }
    return counts.withColumns({k: pct1_min1(F.col(n), F.col(d)) for k, (n, d) in ratios.items()})


def indicator_series_long(indicators: DataFrame, labels=INDICATOR_LABELS) -> DataFrame:
    """(nu_ano, indicador, valor); indicators the table does not have are skipped."""
    present = {c: label for c, label in labels.items() if c in indicators.columns}
    long = indicators.unpivot(["nu_ano"], list(present), "_c", "valor")
    return long.select("nu_ano", sql_map(present)[F.col("_c")].alias("indicador"),
                       F.round("valor", 1).alias("valor"))


def monthly_cases(df: DataFrame, year: int, spec: CaseSpec = TB) -> DataFrame:
    """(mes, casos) of one year, months 1 to 12."""
    rows = df.where(F.col(spec.year) == year)
    month = month_of(F.col(spec.date))
    counts = count_by(rows.where(month.isNotNull()), month.alias("mes"))
    grid = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("mes"))
    return zero_fill(counts, grid, ["casos"])


def monthly_baseline(history: DataFrame, first: int, reference: int, divide_by: str = "present") -> DataFrame:
    """(mes_num, media_hist): mean monthly count over the baseline years, rounded.

    'present' averages the years that have the month and fills the other months with 0;
    'span' divides by the number of baseline years and keeps observed months only."""
    rows = history.where(baseline_years(F.col("nu_ano"), first, reference))
    if divide_by == "span":
        span = float(max(reference - first, 1))
        return rows.groupBy("mes_num").agg(F.round(F.sum("casos") / span, 0).alias("media_hist"))
    sums = rows.groupBy("mes_num").agg(F.sum("casos").alias("_s"), F.count("casos").alias("_n"))
    grid = history.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("mes_num"))
    full = zero_fill(sums, grid, ["_s", "_n"])
    some_history = F.sum("_n").over(W.partitionBy(F.lit(0))) > 0
    mean = F.round(F.coalesce(F.try_divide(F.col("_s"), F.col("_n")), F.lit(0.0)), 0)
    return full.select("mes_num", F.when(some_history, mean).alias("media_hist"))


def annual_baseline(history: DataFrame, current_total, first: int, reference: int) -> DataFrame:
    """(total_ano, media_anual_hist, variacao_pct): mean of the yearly sums, and the change of the
    reference year against it. ``current_total`` is a scalar column."""
    yearly = (history.where(baseline_years(F.col("nu_ano"), first, reference))
              .groupBy("nu_ano").agg(F.sum("casos").alias("casos")))
    base = yearly.agg(F.coalesce(F.avg("casos"), F.lit(0.0)).alias("_m")).withColumn("total_ano", current_total)
    return base.select(F.coalesce("total_ano", F.lit(0)).cast("long").alias("total_ano"),
                       F.round("_m", 0).alias("media_anual_hist"),
                       variation_pct(F.col("total_ano"), F.col("_m")).alias("variacao_pct"))


def area_variation(history: DataFrame, current: DataFrame, first: int, reference: int) -> DataFrame:
    """(uf, casos, media_hist, variacao_pct). ``current`` is (uf, casos) of the reference year;
    areas without history are left out, areas without current cases count 0."""
    base = (history.where(baseline_years(F.col("nu_ano"), first, reference))
            .groupBy(F.col("uf_sigla").alias("uf")).agg(F.avg("casos").alias("_m")))
    joined = base.join(current.select("uf", "casos"), "uf", "left").where(F.col("_m") > 0)
    casos = F.coalesce("casos", F.lit(0).cast("long"))
    return joined.select("uf", casos.alias("casos"), F.round("_m", 0).alias("media_hist"),
                         variation_pct(casos, F.col("_m")).alias("variacao_pct"))


def _against_rounded_base(joined: DataFrame, key: str) -> DataFrame:
    filled = joined.select(key, F.coalesce("casos", F.lit(0).cast("long")).alias("casos"),
                           F.coalesce("media_hist", F.lit(0.0)).alias("media_hist"))
    base = F.when(F.col("media_hist") == 0, F.lit(1.0)).otherwise(F.col("media_hist"))
    change = F.round((F.col("casos") - F.col("media_hist")) / base * 100.0, 1)
    return filled.withColumn("variacao", change).withColumn("direcao", direction(F.col("variacao")))


def area_variation_legacy(history: DataFrame, current: DataFrame, first: int, reference: int) -> DataFrame:
    """Older rule: full join, base = rounded sum over the number of years, zero base counts as 1."""
    span = float(max(reference - first, 1))
    base = (history.where(baseline_years(F.col("nu_ano"), first, reference))
            .groupBy(F.col("uf_sigla").alias("uf")).agg(F.round(F.sum("casos") / span, 0).alias("media_hist")))
    joined = current.select("uf", "casos").where(F.col("uf") != "?").join(base, "uf", "full")
    return _against_rounded_base(joined, "uf")


def month_variation(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(mes_num, mes_label, casos, media_hist, variacao, direcao): observed months of the year
    against the 'span' baseline."""
    joined = current.select(F.col("mes").alias("mes_num"), "casos").join(baseline, "mes_num", "full")
    return _against_rounded_base(joined, "mes_num").withColumn("mes_label", month_label(F.col("mes_num")))


def fallback_month_mean(df: DataFrame, year: int, spec: CaseSpec = TB) -> DataFrame:
    """(mes_num, mes_label, casos, media): without history, the months present and their mean."""
    rows = df.where(F.col(spec.year) == year)
    month = month_of(F.col(spec.date))
    counts = count_by(rows.where(month.isNotNull()), month.alias("mes_num"))
    mean = F.avg("casos").over(W.partitionBy(F.lit(0)))
    return counts.select("mes_num", month_label(F.col("mes_num")).alias("mes_label"), "casos", mean.alias("media"))
