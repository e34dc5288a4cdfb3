"""Surveillance-shaped views over the given tables, in Spark and in SQL.

``cases`` joins only what the asked-for columns need: a query on order attributes alone
reads ``orders`` and nothing else."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.functions.filters import Filters
from epispark.spec import AreaDim

#: Years of the given tables, for tests and the benchmark; queries ask `years`.
YEARS = tuple(range(1995, 2002))
FIRST_YEAR, REFERENCE_YEAR = 1995, 2001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cycle(key: str, names: list[str | None]) -> str:
    """names[key mod n] as a SQL expression"""
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names) if n is not None)
    return f"CASE {key} % {len(names)} {cases} END"


def _flag(key: str, every: int) -> str:
    return f"IF({key} % {every} = 0, 'Sim', 'Não')"


# Column -> SQL expression over orders, over orders + customer + nation, and over the per-order
# summary of lineitem.
ORDER_COLUMNS = {
    "case_id": "o_orderkey",
    "ano_notificacao": "year(o_orderdate)",
    "data_notificacao": "to_date(o_orderdate)",
    "data_diagnostico": "to_date(o_orderdate)",
    "sexo": "CASE WHEN o_custkey % 50 = 7 THEN 'Ignorado' WHEN o_custkey % 3 = 0 THEN 'Feminino' ELSE 'Masculino' END",
    "raca_cor": _cycle("o_custkey", ["Parda", "Branca", "Preta", "Indígena", " Nao informado ", None]),
    "escolaridade": _cycle("o_orderkey", ["Fundamental", "Médio", "Superior", "nan", "Nao informado"]),
    "tipo_entrada": _cycle("o_orderkey", ["Caso Novo"] * 6 + ["Recidiva", "Reingresso após Abandono", "Nao Sabe", "Pós-óbito"]),
    "forma": _cycle("o_orderkey", ["Pulmonar", "Extrapulmonar", "Pulmonar", None, "Pulmonar", "Pulmonar + Extrapulmonar"]),
    "situacao_encerramento": """CASE o_orderstatus WHEN 'F' THEN 'Cura' WHEN 'O' THEN IF(o_orderkey % 2 = 0, 'Nao informado', NULL)
        WHEN 'P' THEN CASE left(o_orderpriority, 1) WHEN '1' THEN 'Óbito por TB' WHEN '2' THEN 'Obito por TB'
            WHEN '3' THEN 'Abandono' WHEN '4' THEN 'Abandono Primario' ELSE 'Transferencia' END END""",
    "status_hiv": _cycle("o_orderkey", ["Positivo", "Negativo", "Negativo", "Negativo", "Em andamento", "Não realizado", None]),
    "baciloscopia_primeira_amostra": _cycle("o_orderkey", ["Positivo", "Negativo", "Não realizado", "Nao informado"]),
    "teste_molecular": _cycle("o_custkey", ["Detectável", "Não detectável", None, "Inconclusivo", "undefined"]),
    "agravo_aids": _cycle("o_orderkey", ["Sim", "sim", None] + ["Não"] * 8),
    "agravo_alcoolismo": _flag("o_orderkey", 23),
    "agravo_diabetes": _flag("o_orderkey", 13),
    "agravo_doenca_mental": _flag("o_orderkey", 29),
    "agravo_drogas_ilicitas": _flag("o_orderkey", 31),
    "agravo_tabagismo": "CASE WHEN o_orderkey % 37 = 0 THEN ' Sim ' WHEN o_orderkey % 5 = 0 THEN 'SIM' ELSE 'Não' END",
    "populacao_privada_liberdade": _flag("o_orderkey", 41),
    "populacao_situacao_rua": _flag("o_orderkey", 17),
    "populacao_imigrante": _flag("o_custkey", 19),
    "profissional_saude": _flag("o_orderkey", 43),
    "beneficiario_governo": _flag("o_orderkey", 3),
}
PERSON_COLUMNS = {
    "estado_notificacao": "IF(o_orderkey % 4 = 0, replace(n_name, 'NATION', 'Nação'), n_name)",
    "municipio_notificacao": "concat(' ', c_mktsegment, ' ', n_name)",
    "idade_anos": "IF(c_acctbal >= 0, int(floor(c_acctbal / 100)), NULL)",
}
LINE_COLUMNS = {
    "data_inicio_tratamento": "ini", "data_encerramento": "fim",
    "numero_contatos": "int(n)", "numero_contatos_examinados": "int(ex)",
}


def cases(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per order; all columns when none is named."""
    every = {**ORDER_COLUMNS, **PERSON_COLUMNS, **LINE_COLUMNS}
    columns = columns or tuple(every)
    rows = table(spark, sf_dir, "orders")
    if any(c in PERSON_COLUMNS for c in columns):
        nations = table(spark, sf_dir, "nation")
        rows = (rows.join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
                .join(nations, F.expr("c_nationkey = n_nationkey")))
    if any(c in LINE_COLUMNS for c in columns):
        # Partial aggregation first: an order with very many lines is one row per task.
        summary = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
            F.expr("to_date(min(l_shipdate)) AS ini"), F.expr("to_date(max(l_shipdate)) AS fim"),
            F.expr("count(*) AS n"), F.expr("count_if(l_returnflag = 'R') AS ex"))
        rows = rows.join(summary, F.expr("o_orderkey = l_orderkey"), "left")
    return rows.selectExpr(*[f"{every[c]} AS {c}" for c in columns])


_areas: dict[tuple[str, str], tuple[tuple[str, str, str, str], ...]] = {}


def area_dim(spark: SparkSession, sf_dir: str) -> AreaDim:
    """Nations as areas (24 stays unmapped on purpose), two spellings each; population is 1000 per
    customer of the nation. Names and regions, one row per area, are read once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _areas:
        named = (table(spark, sf_dir, "nation").where("n_nationkey <> 24")
                 .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
                 .selectExpr("lpad(n_nationkey, 2, '0') AS codigo", "n_name", "r_name").orderBy("codigo"))
        _areas[key] = tuple((f"N{r['codigo']}", r["n_name"], r["r_name"], r["codigo"]) for r in named.collect())
    areas = _areas[key]
    spellings = tuple((s, code) for code, name, _, _ in areas for s in (name, name.replace("NATION", "Nação")))
    people = (table(spark, sf_dir, "customer").where("c_nationkey <> 24")
              .groupBy(F.expr("concat('N', lpad(c_nationkey, 2, '0'))").alias("sigla"))
              .agg(F.expr("count(*) * 1000 AS populacao")))
    return AreaDim(areas, spellings, people)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Death registry: one row per lineitem."""
    suppliers = table(spark, sf_dir, "supplier")
    rows = table(spark, sf_dir, "lineitem").join(suppliers, F.expr("l_suppkey = s_suppkey"))
    return rows.selectExpr(
        "date_format(l_shipdate, 'ddMMyyyy') AS dtobito",
        """CASE WHEN l_orderkey % 23 = 0 THEN NULL WHEN l_orderkey % 29 = 0 THEN ' '
           ELSE concat(lpad(s_nationkey, 2, '0'), lpad(l_partkey % 10000, 4, '0')) END AS codmunres""",
        """CASE l_returnflag WHEN 'R' THEN concat('A15', l_linenumber) WHEN 'A' THEN 'A199' ELSE 'B200' END AS causabas""")


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded extract, all columns text."""
    return table(spark, sf_dir, "orders").selectExpr(
        "string(year(o_orderdate)) AS nu_ano", "string(1 + o_orderkey % 3) AS forma",
        "string(1 + o_custkey % 6) AS tratamento",
        "CASE o_orderkey % 9 WHEN 0 THEN '7' WHEN 1 THEN ' 7' WHEN 2 THEN NULL ELSE '1' END AS situa_ence",
        "string(o_orderkey % 4) AS bacilosc_e", "string(o_orderkey % 5) AS bacilos_e2",
        "string(o_custkey % 7) AS bacilosc_o", "string(o_custkey % 8) AS cultura_es",
        "string(o_orderkey % 6) AS test_molec",
        "IF(o_orderkey % 31 = 0, 'x', string(o_orderkey % 10)) AS nu_contato",
        "string(o_orderkey % 8) AS nu_comu_ex")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untreated extract: text dates, text numbers, ages as text, one administrative column."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS case_id", "string(year(o_orderdate)) AS ano_notificacao",
        """CASE o_orderkey % 7 WHEN 0 THEN concat(o_custkey % 100, ' anos') WHEN 1 THEN concat(o_custkey % 30, ' meses')
           WHEN 2 THEN '1 mês' WHEN 3 THEN '20 dias' WHEN 4 THEN 'sem informação' WHEN 6 THEN '5 horas' END AS idade_notificada""",
        "IF(o_orderkey % 13 = 0, '2024-13-01', string(to_date(o_orderdate))) AS data_notificacao",
        "CASE WHEN o_orderkey % 17 = 0 THEN 'abc' WHEN o_orderkey % 19 = 0 THEN '40000' ELSE string(o_orderkey % 12) END AS numero_contatos",
        "o_orderstatus AS sk_sinan_tube")


def years(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """Years of the cases, ascending: one number per calendar year reaches the driver."""
    found = table(spark, sf_dir, "orders").select(F.expr("year(o_orderdate) AS ano")).where("ano IS NOT NULL").distinct()
    return tuple(sorted(r["ano"] for r in found.collect()))


def every_year(spark: SparkSession, sf_dir: str) -> Filters:
    """A choice of all years that the cases have."""
    return Filters(years=years(spark, sf_dir), resolved=True)


def yearly_parts(df: DataFrame, year: str, years) -> list[DataFrame]:
    return [df.where(F.col(year) == y) for y in years]


def append(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# The same views for the SQL twins. Unused ones cost nothing.
SQL_VIEWS = r"""
WITH li AS (
  SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS ini, CAST(max(l_shipdate) AS DATE) AS fim,
         count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS ex
  FROM lineitem GROUP BY 1),
area_dim AS (
  SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS sigla, n_name AS nome, r_name AS regiao,
         lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS codigo,
         CAST(coalesce(c.n, 0) * 1000 AS BIGINT) AS populacao
  FROM nation JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
  WHERE n_nationkey <> 24),
area_names AS (
  SELECT nome, sigla FROM area_dim UNION ALL SELECT replace(nome, 'NATION', 'Nação'), sigla FROM area_dim),
c0 AS (
  SELECT o_orderkey AS case_id, CAST(year(o_orderdate) AS INTEGER) AS ano_notificacao,
    CAST(o_orderdate AS DATE) AS data_notificacao, CAST(o_orderdate AS DATE) AS data_diagnostico,
    li.ini AS data_inicio_tratamento, li.fim AS data_encerramento,
    CASE WHEN o_orderkey % 4 = 0 THEN replace(n_name, 'NATION', 'Nação') ELSE n_name END AS estado_notificacao,
    ' ' || c_mktsegment || ' ' || n_name AS municipio_notificacao,
    CASE WHEN o_custkey % 50 = 7 THEN 'Ignorado' WHEN o_custkey % 3 = 0 THEN 'Feminino' ELSE 'Masculino' END AS sexo,
    CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS INTEGER) END AS idade_anos,
    CASE o_custkey % 6 WHEN 0 THEN 'Parda' WHEN 1 THEN 'Branca' WHEN 2 THEN 'Preta' WHEN 3 THEN 'Indígena'
      WHEN 4 THEN ' Nao informado ' END AS raca_cor,
    CASE o_orderkey % 5 WHEN 0 THEN 'Fundamental' WHEN 1 THEN 'Médio' WHEN 2 THEN 'Superior' WHEN 3 THEN 'nan'
      ELSE 'Nao informado' END AS escolaridade,
    CASE o_orderkey % 10 WHEN 6 THEN 'Recidiva' WHEN 7 THEN 'Reingresso após Abandono' WHEN 8 THEN 'Nao Sabe'
      WHEN 9 THEN 'Pós-óbito' ELSE 'Caso Novo' END AS tipo_entrada,
    CASE o_orderkey % 6 WHEN 1 THEN 'Extrapulmonar' WHEN 3 THEN NULL WHEN 5 THEN 'Pulmonar + Extrapulmonar'
      ELSE 'Pulmonar' END AS forma,
    CASE WHEN o_orderstatus = 'F' THEN 'Cura'
      WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'Nao informado'
      WHEN o_orderstatus = 'P' THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Óbito por TB'
        WHEN '2' THEN 'Obito por TB' WHEN '3' THEN 'Abandono' WHEN '4' THEN 'Abandono Primario'
        ELSE 'Transferencia' END END AS situacao_encerramento,
    CASE o_orderkey % 7 WHEN 0 THEN 'Positivo' WHEN 1 THEN 'Negativo' WHEN 2 THEN 'Negativo' WHEN 3 THEN 'Negativo'
      WHEN 4 THEN 'Em andamento' WHEN 5 THEN 'Não realizado' END AS status_hiv,
    CASE o_orderkey % 4 WHEN 0 THEN 'Positivo' WHEN 1 THEN 'Negativo' WHEN 2 THEN 'Não realizado'
      ELSE 'Nao informado' END AS baciloscopia_primeira_amostra,
    CASE o_custkey % 5 WHEN 0 THEN 'Detectável' WHEN 1 THEN 'Não detectável' WHEN 3 THEN 'Inconclusivo'
      WHEN 4 THEN 'undefined' END AS teste_molecular,
    CASE o_orderkey % 11 WHEN 0 THEN 'Sim' WHEN 1 THEN 'sim' WHEN 2 THEN NULL ELSE 'Não' END AS agravo_aids,
    CASE WHEN o_orderkey % 23 = 0 THEN 'Sim' ELSE 'Não' END AS agravo_alcoolismo,
    CASE WHEN o_orderkey % 13 = 0 THEN 'Sim' ELSE 'Não' END AS agravo_diabetes,
    CASE WHEN o_orderkey % 29 = 0 THEN 'Sim' ELSE 'Não' END AS agravo_doenca_mental,
    CASE WHEN o_orderkey % 31 = 0 THEN 'Sim' ELSE 'Não' END AS agravo_drogas_ilicitas,
    CASE WHEN o_orderkey % 37 = 0 THEN ' Sim ' WHEN o_orderkey % 5 = 0 THEN 'SIM' ELSE 'Não' END AS agravo_tabagismo,
    CASE WHEN o_orderkey % 41 = 0 THEN 'Sim' ELSE 'Não' END AS populacao_privada_liberdade,
    CASE WHEN o_orderkey % 17 = 0 THEN 'Sim' ELSE 'Não' END AS populacao_situacao_rua,
    CASE WHEN o_custkey % 19 = 0 THEN 'Sim' ELSE 'Não' END AS populacao_imigrante,
    CASE WHEN o_orderkey % 43 = 0 THEN 'Sim' ELSE 'Não' END AS profissional_saude,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Sim' ELSE 'Não' END AS beneficiario_governo,
    CAST(li.n AS INTEGER) AS numero_contatos, CAST(li.ex AS INTEGER) AS numero_contatos_examinados
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN li ON li.l_orderkey = o_orderkey),
c1 AS (
  SELECT c0.*, CASE
      WHEN situacao_encerramento IS NULL OR situacao_encerramento = 'Nao informado' THEN 'Em acompanhamento'
      WHEN situacao_encerramento = 'Obito por TB' THEN 'Óbito por TB'
      WHEN situacao_encerramento = 'Abandono Primario' THEN 'Abandono Primário'
      WHEN situacao_encerramento = 'Transferencia' THEN 'Transferência'
      ELSE situacao_encerramento END AS desfecho,
    an.sigla AS uf
  FROM c0 LEFT JOIN area_names an ON an.nome = c0.estado_notificacao),
cases AS MATERIALIZED (
  SELECT c1.*, CASE WHEN desfecho = 'Cura' THEN 'Cura' WHEN desfecho IN ('Abandono', 'Abandono Primário') THEN 'Interrupção'
      WHEN desfecho = 'Óbito por TB' THEN 'Óbito' ELSE 'Não avaliado' END AS grupo,
    CASE WHEN idade_anos BETWEEN 0 AND 4 THEN '0-4' WHEN idade_anos <= 9 THEN '5-9' WHEN idade_anos <= 14 THEN '10-14'
      WHEN idade_anos <= 19 THEN '15-19' WHEN idade_anos >= 80 THEN '80+'
      WHEN idade_anos >= 20 THEN CAST(idade_anos // 10 * 10 AS VARCHAR) || '-' || CAST(idade_anos // 10 * 10 + 9 AS VARCHAR)
      END AS faixa,
    CASE WHEN idade_anos >= 80 THEN '80+' WHEN idade_anos >= 0
      THEN CAST(idade_anos // 5 * 5 AS VARCHAR) || '-' || CAST(idade_anos // 5 * 5 + 4 AS VARCHAR) END AS faixa17,
    date_diff('day', data_diagnostico, data_inicio_tratamento) AS espera,
    date_diff('day', data_notificacao, data_encerramento) AS duracao,
    CAST(month(data_notificacao) AS INTEGER) AS mes
  FROM c1),
registry AS (
  SELECT strftime(l_shipdate, '%d%m%Y') AS dtobito,
    CASE WHEN l_orderkey % 23 = 0 THEN NULL WHEN l_orderkey % 29 = 0 THEN ' '
      ELSE lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(l_partkey % 10000 AS VARCHAR), 4, '0') END AS codmunres,
    CASE l_returnflag WHEN 'R' THEN 'A15' || CAST(l_linenumber AS VARCHAR) WHEN 'A' THEN 'A199' ELSE 'B200' END AS causabas
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
deaths AS (
  SELECT CAST(substr(dtobito, 5, 4) AS INTEGER) AS ano, sigla AS uf, count(*) AS obitos
  FROM registry JOIN area_dim ON codigo = substr(codmunres, 1, 2)
  WHERE causabas LIKE 'A1%' AND codmunres IS NOT NULL AND length(trim(codmunres)) >= 2 GROUP BY 1, 2),
coded AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS nu_ano, CAST(1 + o_orderkey % 3 AS VARCHAR) AS forma,
    CAST(1 + o_custkey % 6 AS VARCHAR) AS tratamento,
    CASE o_orderkey % 9 WHEN 0 THEN '7' WHEN 1 THEN ' 7' WHEN 2 THEN NULL ELSE '1' END AS situa_ence,
    CAST(o_orderkey % 4 AS VARCHAR) AS bacilosc_e, CAST(o_orderkey % 5 AS VARCHAR) AS bacilos_e2,
    CAST(o_custkey % 7 AS VARCHAR) AS bacilosc_o, CAST(o_custkey % 8 AS VARCHAR) AS cultura_es,
    CAST(o_orderkey % 6 AS VARCHAR) AS test_molec,
    CASE WHEN o_orderkey % 31 = 0 THEN 'x' ELSE CAST(o_orderkey % 10 AS VARCHAR) END AS nu_contato,
    CAST(o_orderkey % 8 AS VARCHAR) AS nu_comu_ex
  FROM orders),
coded1 AS (
  SELECT *, coalesce(forma IN ('1', '3') AND tratamento IN ('1', '4', '6') AND situa_ence NOT IN ('7', ' 7'), false) AS pulm,
    (bacilosc_e = '1' OR bacilos_e2 = '1' OR bacilosc_o = '1' OR cultura_es = '1' OR test_molec IN ('1', '2')) AS lab
  FROM coded),
raw AS (
  SELECT o_orderkey AS case_id, CAST(year(o_orderdate) AS VARCHAR) AS ano_notificacao,
    CASE o_orderkey % 7 WHEN 0 THEN CAST(o_custkey % 100 AS VARCHAR) || ' anos'
      WHEN 1 THEN CAST(o_custkey % 30 AS VARCHAR) || ' meses' WHEN 2 THEN '1 mês' WHEN 3 THEN '20 dias'
      WHEN 4 THEN 'sem informação' WHEN 6 THEN '5 horas' END AS idade_notificada,
    CASE WHEN o_orderkey % 13 = 0 THEN '2024-13-01' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS data_notificacao,
    CASE WHEN o_orderkey % 17 = 0 THEN 'abc' WHEN o_orderkey % 19 = 0 THEN '40000'
      ELSE CAST(o_orderkey % 12 AS VARCHAR) END AS numero_contatos,
    o_orderstatus AS sk_sinan_tube
  FROM orders),
treated AS (
  SELECT case_id, CAST(ano_notificacao AS INTEGER) AS ano_notificacao,
    try_cast(data_notificacao AS DATE) AS data_notificacao, CAST(try_cast(numero_contatos AS SMALLINT) AS INTEGER) AS numero_contatos,
    CASE WHEN idade_notificada LIKE '% anos' THEN CAST(split_part(idade_notificada, ' ', 1) AS INTEGER)
      WHEN idade_notificada LIKE '% m%s' AND idade_notificada NOT LIKE 'sem%' THEN CAST(split_part(idade_notificada, ' ', 1) AS INTEGER) // 12
      WHEN idade_notificada LIKE '% dias' OR idade_notificada LIKE '% horas' THEN 0 END AS idade_anos
  FROM raw)
"""


def sql(body: str) -> str:
    return SQL_VIEWS + body
