"""Tuberculosis surveillance preset (Brazilian case notifications).

Every literal below is a fixed value: results depend on these exact spellings,
codes and counts, so they are stated plainly here and nowhere else.
"""

from __future__ import annotations

# Region -> area codes.
REGIONS = {
    "Norte": ["AC", "AM", "AP", "PA", "RO", "RR", "TO"],
    "Nordeste": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "Centro-Oeste": ["DF", "GO", "MS", "MT"],
    "Sudeste": ["ES", "MG", "RJ", "SP"],
    "Sul": ["PR", "RS", "SC"],
}

# Area code -> (display name, numeric area code, census-2022 population).
AREAS = {
    "AC": ("Acre", "12", 906876),
    "AL": ("Alagoas", "27", 3127683),
    "AM": ("Amazonas", "13", 4269995),
    "AP": ("Amapá", "16", 877613),
    "BA": ("Bahia", "29", 14873064),
    "CE": ("Ceará", "23", 9240580),
    "DF": ("Distrito Federal", "53", 3094325),
    "ES": ("Espírito Santo", "32", 4108508),
    "GO": ("Goiás", "52", 7206589),
    "MA": ("Maranhão", "21", 7114598),
    "MG": ("Minas Gerais", "31", 21292666),
    "MS": ("Mato Grosso do Sul", "50", 2839188),
    "MT": ("Mato Grosso", "51", 3658813),
    "PA": ("Pará", "15", 8777124),
    "PB": ("Paraíba", "25", 4059905),
    "PE": ("Pernambuco", "26", 9674793),
    "PI": ("Piauí", "22", 3281480),
    "PR": ("Paraná", "41", 11597484),
    "RJ": ("Rio de Janeiro", "33", 17366189),
    "RN": ("Rio Grande do Norte", "24", 3302406),
    "RO": ("Rondônia", "11", 1590011),
    "RR": ("Roraima", "14", 652713),
    "RS": ("Rio Grande do Sul", "43", 11466630),
    "SC": ("Santa Catarina", "42", 7786786),
    "SE": ("Sergipe", "28", 2338474),
    "SP": ("São Paulo", "35", 46649132),
    "TO": ("Tocantins", "17", 1607363),
}

# Comorbidity flags, column -> label.
COMORBIDITIES = {
    "agravo_aids": "AIDS/HIV",
    "agravo_alcoolismo": "Alcoolismo",
    "agravo_diabetes": "Diabetes",
    "agravo_doenca_mental": "Doença Mental",
    "agravo_drogas_ilicitas": "Drogas Ilícitas",
    "agravo_tabagismo": "Tabagismo",
}

# Vulnerable-population flags, column -> label.
POPULATIONS = {
    "populacao_privada_liberdade": "Privada de Liberdade",
    "populacao_situacao_rua": "Situação de Rua",
    "populacao_imigrante": "Imigrante",
    "profissional_saude": "Profissional de Saúde",
    "beneficiario_governo": "Beneficiário Prog. Social",
}

# Outcome spelling found in the data -> canonical spelling.
OUTCOME_SPELLINGS = {
    "Nao informado": "Em acompanhamento",
    "Não informado": "Em acompanhamento",
    "Obito por TB": "Óbito por TB",
    "Obito por outras causas": "Óbito por outras causas",
    "Mudanca de Esquema": "Mudança de Esquema",
    "Abandono Primario": "Abandono Primário",
    "Transferencia": "Transferência",
    "Falencia": "Falência",
}

# Canonical outcome -> cohort group.
OUTCOME_GROUPS = {
    "Cura": "Cura",
    "Abandono": "Interrupção",
    "Abandono Primário": "Interrupção",
    "Óbito por TB": "Óbito",
    "Óbito por outras causas": "Óbito",
    "Transferência": "Não avaliado",
    "Mudança de Esquema": "Não avaliado",
    "TB-DR": "Não avaliado",
    "Falência": "Não avaliado",
    "Em acompanhamento": "Não avaliado",
}
GROUP_ORDER = ("Cura", "Interrupção", "Óbito", "Não avaliado")

# Entry types.
INCIDENCE_ENTRIES = ("Caso Novo", "Não Sabe", "Nao Sabe", "Pós-óbito", "Pos-obito")
INCIDENCE_ENTRIES_LEGACY = ("Caso Novo", "Não Sabe", "Pós-óbito")
RETREATMENT_ENTRIES = ("Recidiva", "Reingresso após Abandono", "Reingresso Após Abandono")

# Values the older filter panel always restricts to.
LEGACY_HIV = ("Positivo", "Negativo", "Em andamento", "Não realizado", "Ignorado")
LEGACY_FORMS = ("Pulmonar", "Extrapulmonar", "Pulmonar + Extrapulmonar")

# Age bands as (label, first year, last year); None = open.
AGE_BANDS_11 = (
    ("0-4", 0, 4), ("5-9", 5, 9), ("10-14", 10, 14), ("15-19", 15, 19),
    ("20-29", 20, 29), ("30-39", 30, 39), ("40-49", 40, 49), ("50-59", 50, 59),
    ("60-69", 60, 69), ("70-79", 70, 79), ("80+", 80, None),
)
# Five-year bands up to 79, then 80 to 199.
AGE_BANDS_17 = tuple((f"{a}-{a + 4}", a, a + 4) for a in range(0, 80, 5)) + (("80+", 80, 199),)

# Waiting-time buckets as (label, first day, last day).
WAIT_BUCKETS = (
    ("Mesmo dia", 0, 0), ("1–3 dias", 1, 3), ("4–7 dias", 4, 7), ("8–15 dias", 8, 15),
    ("16–30 dias", 16, 30), ("31–60 dias", 31, 60), ("> 60 dias", 61, None),
)

# Month names.
MONTHS = ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez")

# Annual indicator column -> label.
INDICATOR_LABELS = {
    "pct_cura": "Taxa de cura (%)",
    "pct_abandon": "Taxa de abandono (%)",
    "pct_hiv": "Coinfecção HIV (%)",
    "pct_pulm": "Forma pulmonar (%)",
    "pct_test_hiv": "Testagem para HIV (%)",
    "pct_obito": "Óbito por TB (%)",
    "pct_novo": "Casos novos (%)",
    "pct_aids": "AIDS (%)",
    "pct_alcool": "Alcoolismo (%)",
}

# Columns dropped, parsed as dates and parsed as small integers on preparation.
DROPPED_COLUMNS = (
    "data_transferencia_rm", "codigo_fluxo_retorno", "codigo_fluxo_recebido",
    "indicador_migracao", "detalhe_agravo_outros", "detalhe_outras_drogas",
    "data_notificacao_atual", "sk_sinan_tube",
)
DATE_COLUMNS = (
    "data_notificacao", "data_diagnostico", "data_digitacao", "data_inicio_tratamento",
    "data_encerramento", "data_mudanca_situacao", "data_transferencia_us",
    "data_transferencia_dm", "data_transferencia_sm", "data_transferencia_rs",
    "data_transferencia_se",
)
INT_COLUMNS = (
    "numero_contatos", "numero_contatos_examinados", "ano_notificacao", "ano_nascimento",
)

# Columns of the microdata export.
EXPORT_COLUMNS = (
    "estado_notificacao", "municipio_notificacao", "uf_residencia",
    "ano_notificacao", "data_notificacao", "data_diagnostico",
    "data_inicio_tratamento", "data_encerramento",
    "idade_anos", "sexo", "raca_cor", "escolaridade",
    "tipo_entrada", "forma", "situacao_encerramento",
    "status_hiv", "uso_antirretroviral", "raio_x_torax",
    "baciloscopia_primeira_amostra", "cultura_escarro",
    "histopatologia", "teste_molecular", "teste_sensibilidade",
    "tratamento_supervisionado",
    "agravo_aids", "agravo_alcoolismo", "agravo_diabetes",
    "agravo_doenca_mental", "agravo_drogas_ilicitas", "agravo_tabagismo",
    "populacao_privada_liberdade", "populacao_situacao_rua",
    "profissional_saude", "populacao_imigrante", "beneficiario_governo",
    "numero_contatos", "numero_contatos_examinados",
)

# Analysis columns and their friendly names.
FRIENDLY_NAMES = {
    "estado_notificacao": "Estado",
    "municipio_notificacao": "Municipio",
    "uf_residencia": "UF Residencia",
    "ano_notificacao": "Ano",
    "data_notificacao": "Data Notificacao",
    "data_diagnostico": "Data Diagnostico",
    "data_inicio_tratamento": "Data Inicio Tratamento",
    "data_encerramento": "Data Encerramento",
    "idade_anos": "Idade (anos)",
    "sexo": "Sexo",
    "raca_cor": "Raca/Cor",
    "escolaridade": "Escolaridade",
    "tipo_entrada": "Tipo de Entrada",
    "forma": "Forma Clinica",
    "situacao_encerramento": "Situacao Encerramento",
    "status_hiv": "Status HIV",
    "uso_antirretroviral": "Uso Antirretroviral",
    "raio_x_torax": "Raio-X Torax",
    "baciloscopia_primeira_amostra": "Baciloscopia 1a Amostra",
    "cultura_escarro": "Cultura Escarro",
    "histopatologia": "Histopatologia",
    "teste_molecular": "Teste Molecular (TMR-TB)",
    "teste_sensibilidade": "Teste Sensibilidade",
    "tratamento_supervisionado": "Tratamento Supervisionado",
    "baciloscopia_mes_1": "Baciloscopia Mes 1",
    "baciloscopia_mes_2": "Baciloscopia Mes 2",
    "baciloscopia_mes_3": "Baciloscopia Mes 3",
    "baciloscopia_mes_4": "Baciloscopia Mes 4",
    "baciloscopia_mes_5": "Baciloscopia Mes 5",
    "baciloscopia_mes_6": "Baciloscopia Mes 6",
    "baciloscopia_apos_6_meses": "Baciloscopia Apos 6 Meses",
    "agravo_aids": "Agravo AIDS",
    "agravo_alcoolismo": "Agravo Alcoolismo",
    "agravo_diabetes": "Agravo Diabetes",
    "agravo_doenca_mental": "Agravo Doenca Mental",
    "agravo_drogas_ilicitas": "Agravo Drogas Ilicitas",
    "agravo_tabagismo": "Agravo Tabagismo",
    "populacao_privada_liberdade": "Privado de Liberdade",
    "populacao_situacao_rua": "Em Situacao de Rua",
    "profissional_saude": "Profissional de Saude",
    "populacao_imigrante": "Imigrante",
    "beneficiario_governo": "Beneficiario Gov.",
    "numero_contatos": "Numero de Contatos",
    "numero_contatos_examinados": "Contatos Examinados",
}

# Bounding box used for an empty feature collection
# (south, west, north, east).
DEFAULT_BOUNDS = (-34.0, -74.0, 6.0, -28.0)
