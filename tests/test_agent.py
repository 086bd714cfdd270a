"""What questions ask for, whether texts cover it, and how answers are checked: tables of cases."""

import pytest

from corvid.functions import headers
from corvid.operators import agent, coverage

NEEDS = {
    "¿Qué cambió entre 2019 y 2021?": ["2019", "2021", "rango entre 2019 y 2021"],
    "¿Cómo cambiaron los salarios de 2025 a 2026?": ["2025", "2026"],
    "¿Qué rige en 2026?": [],
    "Plan Nacional 2025-2030": [],
    "¿Qué fundamento usaron los PND 2019-2024 y 2025-2030?": ["tema PND 2019-2024", "tema PND 2025-2030"],
    "El Plan Nacional de Desarrollo 2013-2018, 2019-2024": ["tema PND 2013-2018", "tema PND 2019-2024"],
    "¿Qué dice el segundo transitorio sobre el numeral 5.2?": ["transitorio", "numeral 5.2"],
    "Los numerales 8.3, 8.4 y 8.5 citados por el segundo transitorio, ¿qué exigen?": ["transitorio", "numeral 8.3", "numeral 8.4", "numeral 8.5"],
    "el transitorio, sin más": [],
    "¿Qué aplica hasta 15, entre 16 y 50, y con más de 50 trabajadores?": ["rango hasta 15", "rango entre 16 y 50", "rango más de 50"],
    "hasta quince y más de cincuenta": ["rango hasta 15", "rango más de 50"],
    "¿Cuáles son los valores diario, mensual y anual?": ["término diario", "término mensual", "término anual"],
    "el valor mensual": [],
    "¿Cuáles son los siete objetos de la ley?": [],
    "¿Qué ordenó la reforma constitucional de abril de 2025?": ["publicación 2025-04"],
    "¿Qué dispuso el decreto del 11 de diciembre de 2025?": ["publicación 2025-12-11"],
    "publicado en el DOF el 5 de marzo de 2020": ["publicación 2020-03-05"],
    "la nom-001-ssa-2010 y la NOM-001-SSA-2010": ["tema NOM-001-SSA-2010"],
    "¿Cómo se relacionan la NOM-035 y la reforma de vacaciones dignas?": ["tema NOM-035", "tema reforma: vacaciones dignas"],
    "reforma de pensiones de marzo de 2020 y la ley": ["tema reforma: pensiones", "publicación 2020-03"],
    "¿Qué pasó desde la declaratoria de utilidad pública hasta el decreto de expropiación?": ["tema declaratoria de utilidad pública", "tema decreto de expropiación"],
    "¿Qué objetivo y alcance tiene este decreto?": [],
    "": [],
}


@pytest.mark.parametrize("question", NEEDS)
def test_needs(question):
    assert [str(n) for n in coverage.needs(question)] == NEEDS[question]


P, N = coverage.Passage, coverage.Need
COVERS = [
    (N("numeral", "5.2"), P("**5.2** Requisitos"), True),
    (N("numeral", "5.2"), P("intro\n> 5.2 Requisitos"), True),
    (N("numeral", "5.2"), P("véase 5.2"), False),
    (N("published", "2020-03"), P("", publication_date="2020-03-09"), True),
    (N("published", "2020-03-08"), P("", publication_date="2020-03-09"), False),
    (N("published", "2020-03"), P(""), False),
    (N("más de", "15"), P("con MÁS   de quince personas"), True),
    (N("entre", "16 y 50"), P("entre dieciséis y cincuenta"), True),
    (N("entre", "16 y 50"), P("entre 16, y 50"), False),
    (N("hasta", "15"), P("hasta 150"), False),
    (N("year", "2025"), P("x", years=frozenset(["2025"])), True),
    (N("year", "2025"), P("2025"), False),
    (N("plan", "2019-2024"), P("el PND 2019-2024"), True),
    (N("plan", "2019-2024"), P("periodo 2019-2024"), False),
    (N("norm", "NOM-035"), P("", title="Nom-035-STPS"), True),
    (N("reform", "vacaciones dignas"), P("se reforma el artículo de vacaciones"), True),
    (N("reform", "vacaciones dignas"), P("vacaciones"), False),
    (N("action", "decreto de expropiación"), P("Decreto ... expropiacion"), True),
    (N("term", "mensual"), P("valor Mensual"), True),
    (N("transitory", ""), P("**PRIMERO.** Entra en vigor"), True),
    (N("transitory", ""), P("x", heading_path=("TRANSITORIOS",)), True),
    (N("transitory", ""), P("el primero"), False),
]


@pytest.mark.parametrize("case", range(len(COVERS)))
def test_covers(case):
    need, passage, expected = COVERS[case]
    assert coverage.covers(need, passage) is expected


CORRECTS = {
    "No fue la ley sino el decreto que reformó el artículo.": True,
    "No se encontró evidencia.": False,
    "No se encontró nada; la ley vigente es otra.": True,
    "no establece nada": False,
    "La evidencia disponible insuficiente no establece eso.": False,
    "Los chunks leídos no muestran que se reformara.": False,
    "El plan comprende tres ejes": True,
    "": False,
}


@pytest.mark.parametrize("answer", CORRECTS)
def test_corrects(answer):
    assert coverage.corrects(answer) is CORRECTS[answer]


def test_snippet():
    text = "Relleno. " * 40 + "ARTÍCULO 3 dispone lo debido. " + "Más texto. " * 40
    got, cut = coverage.snippet(text, "¿Qué dice el artículo 3?", 200)
    assert cut and len(got) == 200 and "ARTÍCULO 3 dispone" in got and got[0] == got[-1] == "…"
    assert coverage.snippet("corto", "x", 200) == ("corto", False)
    got, _ = coverage.snippet("ﬁ" * 300 + " numeral 5.2 " + "z" * 300, "numeral 5.2", 100)
    assert "numeral 5.2" in got
    got, _ = coverage.snippet("alfa " * 100, "nada", 50)
    assert got.startswith("alfa") and got.endswith("…") and len(got) == 50
    assert "dispone" in coverage.snippet(text, "debido dispone", 60)[0]


GOOD = '{"answer": "x", "citations": [1, 9], "premise_status": "supported"}'
BAD = {
    "no json": "no JSON",
    "[1, 2]": "no JSON",
    '{"answer": "x", "premise_status": "supported"}': "citation",
    '{"answer": "x", "citations": [9], "premise_status": "supported"}': "citation",
    '{"answer": "x", "citations": ["one"], "premise_status": "supported"}': "needed",
    '{"answer": "x", "citations": [true], "premise_status": "supported"}': "needed",
    '{"answer": "x", "citations": 1, "premise_status": "supported"}': "needed",
    '{"answer": " ", "citations": [1], "premise_status": "supported"}': "needed",
    '{"answer": "x", "citations": [1], "premise_status": "valid"}': "needed",
    '{"answer": "No se encontró.", "citations": [1], "premise_status": "false"}': "correction",
}


def test_answers_that_hold():
    a = agent.validated("text {broken " + GOOD, {1: 7})
    assert a.citations == [1] and a.invalid_citations == [9]
    assert agent.validated('{"answer": "La ley vigente es otra.", "citations": [1, 1], "premise_status": "false"}', {1: 7}).citations == [1]
    assert agent.validated(GOOD.replace("supported", "unclear"), {1: 7}).premise_status == "unclear"


@pytest.mark.parametrize("text", BAD)
def test_answers_that_do_not(text):
    with pytest.raises(agent.InvalidAnswer, match=BAD[text]):
        agent.validated(text, {1: 7})
    with pytest.raises(agent.InvalidAnswer, match="2 documents"):
        agent.validated(GOOD, {1: 7}, hops=2)


def test_answer_from_given_chunks():
    seen = []

    def complete(rules, user):
        seen.append(user)
        return 'So: {"answer": " yes ", "citations": ["2", 5, "x", 2], "premise_status": "maybe"}'

    a = agent.from_context("Why?", {2: "two", 3: "three"}, complete, "2024-01-01")
    assert (a.answer, a.citations, a.invalid_citations, a.premise_status) == ("yes", [2], [5], "unclear")
    assert "[CHUNK 3]\nthree" in seen[0] and "2024-01-01" in seen[0]
    assert agent.from_context("Why?", {}, lambda *_: "nothing").answer == ""


SEARCH = {"query": "agua", "strategy": "hybrid", "as_of": None, "date_from": None, "date_to": None, "section": None, "prefer_recent": False, "top_k": 5}


def toolbox():
    read = [{"doc_id": 1, "chunk_id": 5, "text": "La NOM-001-SSA1-2010 dispone"}]
    return agent.Toolbox({"search_documents": lambda a: [{"doc_id": 1}], "search_evidence": lambda a: [{"doc_id": 1, "chunk_id": 5}], "get_document_outline": lambda a: [{"chunk_id": i} for i in range(300)], "read_chunks": lambda a: read})


def test_scripted_run():
    evidence = {"query": "agua", "document_ids": [1], "strategy": "lexical", "prefer_recent": True, "top_k": 5}
    turns = [
        {"tool": "read_chunks", "arguments": {"chunk_ids": [5], "neighbor_window": 0}},
        {"tool": "search_documents", "arguments": SEARCH},
        {"tool": "search_evidence", "arguments": evidence},
        {"tool": "search_evidence", "arguments": evidence | {"document_ids": ["one"]}},
        {"tool": "read_chunks", "arguments": {"chunk_ids": [5], "neighbor_window": 0}},
        {"text": '{"answer": "sí", "citations": ["five"], "premise_status": "supported"}', "usage": {"total_tokens": 1}},
        {"text": '{"answer": "sí", "citations": [5], "premise_status": "supported"}', "usage": {"total_tokens": 3}},
    ]
    out = agent.run("¿Qué dispone la NOM-001-SSA1-2010?", agent.Scripted(turns), toolbox())
    assert out["status"] == "succeeded" and out["usage"] == {"total_tokens": 4} and out["verification"]["coverage_requirements_met"]
    assert [bool(t["error"]) for t in out["traces"]] == [True, False, False, True, False]


def test_tool_limits():
    box = toolbox()
    for _ in range(agent.MOST_SEARCHES):
        box.call("search_documents", dict(SEARCH))
    assert "search_documents" not in box.available()
    assert len(box.call("get_document_outline", {"document_id": 1})) == 200
    for wrong in ({"strategy": "other"}, {"top_k": 11}, {"prefer_recent": 1}, {"query": ""}):
        with pytest.raises(ValueError):
            agent.check_arguments("search_documents", SEARCH | wrong)


HEADERS = {
    "# SECRETARÍA DE SALUD\n\n## Acuerdo por el que se crea.\n\ntexto": ("SECRETARÍA DE SALUD", "Acuerdo por el que se crea"),
    "# Solo uno ;\ntexto\n## Otro título": ("Solo uno", "Solo uno"),
    "## Primero el segundo\n# Institución": ("Institución", "Primero el segundo"),
    "texto antes\n# Institución\n## `Título` con *marcas*,": ("Institución", "Título con marcas"),
    "### Nivel tres\n**UNO DOS**\nx": ("UNO DOS", "Nivel tres"),
    "**PODER EJECUTIVO** **SECRETARÍA**\n![i](x.png)\nDecreto por el que...\n": ("PODER EJECUTIVO SECRETARÍA", "Decreto por el que"),
    "**PODER EJECUTIVO**": ("PODER EJECUTIVO", "PODER EJECUTIVO"),
    "": (None, None),
    "abc": (None, None),
}


@pytest.mark.parametrize("text", HEADERS)
def test_headers(text):
    assert headers.header(text) == HEADERS[text]


def test_long_titles_are_cut_at_a_word():
    title = headers.header("# " + "palabra " * 60)[0]
    assert len(title) <= 330 and title.endswith("palabra")
