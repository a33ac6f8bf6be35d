import json

import pytest

from brindle.llm import residue as R

CASES = [
    "[API Error: Request timeout after 436s. Try reducing input length.]", "You need to enable JavaScript to run this app.", "<html><body><h1>502</h1><p>Upstream not available, node 3.</p></body></html>", "Lorem ipsum dolor sit amet consectetur adipiscing elit.",
    "TBD TBD TBD", "We evaluated {{ model }} on <DATE> and reached [METRIC VALUE].", "A sound start of the report.\n\nTable 2: ${SCORE} against XXX (n runs)\n\nAnd a sound end of it.", "Your session has expired. Log in again to see this page.", "Oops! The page you are looking for does not exist (504).",
    "Contact %(author)s for @@score@@.", "__AUTHOR__ wrote this", "Une erreur inattendue s'est produite. Veuillez réessayer plus tard.",
]
SOUND = [
    "The mirror answered 502 Bad Gateway twice, so I switched to the cached copy and the table is complete.", "The template now uses `{{ title }}` for the header; I rendered it once and the result has 665 lines.", "In the script, `${OUT_DIR}` is replaced by the shell, and TODO comments were removed.",
    "The page needs JavaScript, so I read its JSON file instead; 276 rows came back.", "Code:\n\n```sh\necho ${HOME} {{ x }}\n```\n\nIt prints the folder.", "[INFO] all 12 checks pass and the report is complete.", "", None, "Dolor del paciente: leve, sed sin cambios.",
]


@pytest.mark.parametrize("text", CASES)
def test_case(text):
    assert R.coverage(text) >= R.COVERAGE


@pytest.mark.parametrize("text", SOUND)
def test_sound(text):
    assert R.coverage(text) < R.COVERAGE


def chat(i, episode, seq, response, status=200):
    return (i, episode, seq, "/v1/chat/completions", status, response, "x", True)


def reply(text):
    return json.dumps({"choices": [{"message": {"content": text}}]})


def test_records_and_runs(spark):
    rows = [
        chat(1, "a", 1, reply("A sound answer.")), chat(2, "a", 2, reply(CASES[0])), chat(2, "a", 2, reply(CASES[0])), chat(3, "b", 2, reply("Fine.")), chat(4, "b", 1, reply(CASES[0])), chat(5, "c", 9, reply(CASES[1]), 500),
        chat(6, "c", 1, "<!doctype html><body><noscript>Enable JavaScript to view x.</noscript></body>"), chat(7, None, None, None), chat(8, "d", None, reply(None)), chat(9, "d", 3, "{}"),
    ]
    requests = spark.createDataFrame(rows, "request_id long, episode string, seq long, path string, status int, response string, coverage string, found boolean")
    runs = spark.createDataFrame([(1, "a", True), (1, "a", True), (2, "b", True), (3, "c", True), (4, "a", None), (5, "a", False), (6, None, True), (7, "zz", True)], "status_id long, episode string, trace_has_success_result boolean")
    got = sorted(map(tuple, R.residue_records(requests, runs).collect()))
    assert got == [("api_requests", 2), ("api_requests", 4), ("api_requests", 6), ("run_status", 1), ("run_status", 3)]
    assert R.residue_records(requests.limit(0), runs).count() == 0


def test_very_long_text():
    assert R.coverage("A plain sentence of a report. " * 50_000) == 0


def test_capitals_with_longer_lower_forms_hide_nothing():
    page = "502 Bad Gateway"
    assert R.coverage(page) > 0.5
    assert R.coverage(f"İstanbul\n\n{page}") == R.coverage(f"Istanbul\n\n{page}")


def test_share_of_the_document_decides():
    report = "\n\n".join(f"Paragraph {i} of a sound report, with a finding and its number." for i in range(300))
    assert 0 < R.coverage(f"{report}\n\nSomething went wrong") < R.COVERAGE
    assert R.coverage("Something went wrong") == 1.0


def test_sweep_equals_counting():
    import random

    rng = random.Random(5)
    bits = ["bad gateway", "{{ name }}", "a plain sentence of content here", "\n\n", "\n", "[INSERT", "DATE HERE]", "502", "lorem ipsum dolor", " ", "<html>"]
    for _ in range(500):
        text = " ".join(rng.choices(bits, k=rng.randint(1, 12)))
        spans = R._spans(text)
        inside = [any(s <= i < e for s, e in spans) for i in range(len(text))]
        total, at = 0, 0
        for part in [text] if R._PAGE.search(text) else R.re.split(r"(\n\s*\n)", text):
            solid = [i for i in range(at, at + len(part)) if not text[i].isspace()]
            hit = sum(inside[i] for i in solid)
            total += hit if hit and hit >= R.PARAGRAPH * len(solid) else 0
            at += len(part)
        assert R.coverage(text) == (total / len("".join(text.split())) if text.split() else 0.0)
