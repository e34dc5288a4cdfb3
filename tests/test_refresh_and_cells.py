"""Refreshed folders, cells against cases, resolved requests, bitmaps and treatment on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from catalog import views
from conftest import SF_DIR
from epispark import TB, Filters
from epispark.operators import mergeable
from epispark.plans import composites
from epispark.plans.cells import Cells, cells_of, read_cells
from epispark.plans.refresh import history_columns, refresh_history
from epispark.plans.treat import rejects, treat


@pytest.fixture(scope="module")
def cases(spark):
    return views.cases(spark, SF_DIR).cache()


@pytest.fixture(scope="module")
def dim(spark):
    return views.area_dim(spark, SF_DIR)


def files(path):
    return {folder: sorted(n for n in os.listdir(f"{path}/{folder}") if n.endswith(".parquet")) for folder in os.listdir(path) if "=" in folder}


def test_only_changed_years_are_rewritten(spark, cases, dim, tmp_path):
    path = str(tmp_path)
    states = {r["ano"]: r["estado"] for r in refresh_history(cases, dim, path, cells=True).collect()}
    assert set(states.values()) == {"novo"}
    before = {t: files(f"{path}/{t}") for t in ("contagens", "indicadores", "celulas")}
    less = cases.where(~((F.col("ano_notificacao") == 1998) & (F.col("case_id") % 2 == 0))).where("ano_notificacao <> 1996")
    states = {r["ano"]: r["estado"] for r in refresh_history(less.orderBy("case_id"), dim, path, cells=True).collect()}
    assert states == {y: "alterado" if y == 1998 else "removido" if y == 1996 else "igual" for y in views.YEARS}
    for t, old in before.items():
        new = files(f"{path}/{t}")
        column = "ano" if t == "celulas" else "nu_ano"
        assert f"{column}=1996" not in new and new[f"{column}=1998"] != old[f"{column}=1998"]
        assert all(new[f] == old[f] for f in old if f[-4:] not in ("1996", "1998"))
    assert {r["estado"] for r in refresh_history(less, dim, path, cells=True).collect()} == {"igual"}


def test_a_broken_refresh_is_made_up_for(spark, cases, dim, tmp_path, monkeypatch):
    from epispark.plans import refresh

    path, rows = str(tmp_path), cases.select(*history_columns())
    monkeypatch.setattr(refresh, "_write_history", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        refresh_history(rows, dim, path)
    monkeypatch.undo()
    assert {r["estado"] for r in refresh_history(rows, dim, path).collect()} == {"novo"}


@pytest.mark.parametrize("f", [Filters(), Filters(years=(1999, 2000), sexes=("Feminino",)), Filters(years=(2050,), areas=("N01", "ZZ")), Filters(sexes=("ninguém",))])
def test_cells_answer_as_cases_do(cases, dim, f):
    cells = Cells(cells_of(cases, dim))
    for build in (composites.perfil, composites.clinico, composites.comorbidades, lambda *a, **k: composites.mapa(*a[:2], None, *a[2:], **k),
                  lambda *a, **k: composites.resumo(*a[:2], None, *a[2:], **k), lambda *a, **k: composites.detalhe_uf(*a, "N07", **k)):
        a, b = ([tuple(r) for r in build(cases, dim, f, cells=c).collect()] for c in (None, cells))
        assert sorted(a, key=repr) == sorted(b, key=repr)


def test_cells_refuse_what_they_do_not_hold(spark, cases, dim):
    cells = Cells(cells_of(cases, dim))
    assert not cells.holds(Filters(hiv=("Positivo",))) and Cells(cells_of(cases, dim, held=("sexes", "hiv")), ("sexes", "hiv")).holds(Filters(hiv=("Positivo",)))
    with pytest.raises(ValueError):
        cells.rows(Filters(comorbidities=("agravo_aids",)), dim, "hiv")
    with pytest.raises(ValueError):
        cells_of(cases, dim, held=("years",))
    assert cells_of(cases.limit(0), dim).count() == 0


def test_stored_cells_read_no_other_year(spark, cases, dim, tmp_path):
    from epispark.plans.cells import write_cells

    write_cells(cases, dim, str(tmp_path), views.YEARS)
    cells = read_cells(spark, str(tmp_path))
    assert cells.years() == views.YEARS
    plan = cells.rows(Filters(years=(1999,)), dim, "hiv")._jdf.queryExecution().executedPlan().toString()
    assert "ano#" in plan.split("PartitionFilters: ")[1].split("]")[0] and "bloco" in plan.split("PushedFilters: ")[1].split("]")[0]


def test_requests_are_resolved_once(dim):
    f = Filters(years=(2001, 2050, 1999, 2001), areas=("N01", "ZZ", "N01")).resolve((1999, 2000, 2001), dim)
    assert (f.years, f.areas, f.n_years, f.reference_year, f.resolved) == ((1999, 2001), ("N01",), 2, 2001, True)
    assert Filters(years=(1,)).resolve((1999, 2000)).years == (2000,) and Filters().resolve(()).years == ()
    assert Filters(years=(2001, 2001)).n_years == 1


def test_bitmaps_over_many_buckets(spark, dim):
    df = spark.range(100_000).selectExpr("2000 + id % 3 AS ano_notificacao", "'NATION_1' AS estado_notificacao", "concat('p', id % 70000) AS municipio_notificacao")
    numbers = mergeable.place_numbers(df).cache()
    maps = mergeable.place_bitmaps(df, dim, numbers)
    assert maps.select("balde").distinct().count() == 3
    assert mergeable.distinct_places_of(maps).first()[0] == 70_000
    assert mergeable.distinct_places_of(maps.where("ano = 2001")).first()[0] == df.where("ano_notificacao = 2001").select("municipio_notificacao").distinct().count()
    more = mergeable.place_numbers(spark.range(10).selectExpr("concat('new', id) AS municipio_notificacao"), known=numbers)
    assert more.agg(F.max("numero"), F.countDistinct("numero")).first()[:] == (70_010, 70_010)
    with pytest.raises(ValueError):
        mergeable.chosen(maps, Filters(sexes=("Feminino",)), dim)


def test_treatment_accounts_for_every_row(spark, tmp_path):
    rows = [("2001", "1 ano", "2001-02-03", "7"), ("x", "2 anos", "2001-02-03", "7"), (None, None, None, None), ("2001.0", "?", "03/02/2001", "many"), ("1999", "", "", " ")]
    raw = spark.createDataFrame(rows, "ano_notificacao string, idade_notificada string, data_notificacao string, numero_contatos string")
    path = str(tmp_path)
    account = treat(raw, path, (2000, 2001))
    assert (account.read, account.accepted, account.rejected) == (5, 2, {"sem ano": 1, "ano ilegível": 1, "ano não pedido": 1})
    assert account.lost == {"data_notificacao": 1, "numero_contatos": 1, "idade_notificada": 1}
    assert rejects(spark, path).count() == 3 and spark.read.parquet(f"{path}/destino=casos").count() == 2
    again = treat(raw.where("ano_notificacao = '2001'"), path, (2000, 2001))
    assert (again.read, again.rejected) == (1, {}) and rejects(spark, path).count() == 0
    assert treat(raw, path).accepted == 3 and sorted(files(f"{path}/destino=casos")) == ["ano_notificacao=1999", "ano_notificacao=2001"]
    treat(raw.where("ano_notificacao = '1999'"), path, (2001,))
    assert sorted(files(f"{path}/destino=casos")) == ["ano_notificacao=1999"]
