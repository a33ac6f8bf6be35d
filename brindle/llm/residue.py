"""Template residue, filler, error pages and script notices in replies.

One multi-pattern automaton finds phrases and the openings of slots; an opening
counts where a whole slot stands. A paragraph that matches fill is residue, and
a record is excluded when the matches in such paragraphs cover a large enough
share of the document. Replies that mention a gateway error or a template in a
sentence of their own have no such paragraph, and inline or fenced code is
content, so both stay; so does a long report that ends with one stray notice.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from brindle.llm.chat import chat_rows, is_blank, map_rows, reply_of, text_of
from brindle.plans.materialize import materialize

#: Share of a paragraph that matches must cover to make it residue: below, the matches are only mentioned in it.
PARAGRAPH = 0.35
#: Share of the document's characters that matches in residue paragraphs must cover to exclude it.
COVERAGE = 0.03

# Phrases of error messages, in lower case.
ERROR_PHRASES = """
[api error
upstream connect error
disconnect/reset before headers
reset reason: connection failure
upstream not available
the gateway did not receive a timely response
service temporarily unavailable
service unavailable
internal server error
bad gateway
gateway time-out
gateway timeout
too many requests
404 not found
403 forbidden
the page you are looking for does not exist
page not found
this site can't be reached
this page isn't working
took too long to respond
an unexpected error occurred
an error occurred while processing your request
something went wrong
our team has been notified
please try again later
the server could not process your request
the server encountered an internal error
access denied
you don't have permission to view
you do not have permission to access
reference #
your session has expired
session expired
log in again to
please log in to continue
please sign in to continue
you have exceeded the
exceeded your current quota
quota of
retry after
rate limit reached
checking your browser before accessing
this may take a few seconds
verify you are human
connection error
request timeout
no stream activity
econnreset
econnrefused
try reducing input length
seite nicht gefunden
ein unerwarteter fehler ist aufgetreten
bitte versuchen sie es später erneut
zugriff verweigert
page introuvable
une erreur inattendue s'est produite
veuillez réessayer plus tard
accès refusé
página no encontrada
se ha producido un error inesperado
inténtelo de nuevo más tarde
acceso denegado
ocorreu um erro inesperado
tente novamente mais tarde
acesso negado
strona nie została znaleziona
wystąpił nieoczekiwany błąd
spróbuj ponownie później
страница не найдена
произошла непредвиденная ошибка
повторите попытку позже
доступ запрещен
页面未找到
发生意外错误
请稍后再试
访问被拒绝
ページが見つかりません
予期しないエラーが発生しました
しばらくしてからもう一度お試しください
アクセスが拒否されました
""".strip().split("\n")

# Phrases of notices that scripts or a session are needed, in lower case.
SCRIPT_PHRASES = """
you need to enable javascript
please enable javascript
enable javascript to
enable javascript and cookies
javascript is disabled in your browser
javascript is required
this page requires javascript
some features of
will not work
turn it on in your browser settings
your browser does not support scripts
cannot be shown
loading application
if nothing happens, activate scripting
activate scripting and reload
bitte aktivieren sie javascript
veuillez activer javascript
por favor, active javascript
por favor, habilite o javascript
włącz obsługę javascript
включите javascript
请启用 javascript
javascriptを有効にしてください
""".strip().split("\n")

# Filler phrases and filler words, in lower case.
FILLER_PHRASES = """
placeholder text
to be written by
add content here
your text goes here
replace this paragraph with
sample heading
sample paragraph
sample text
dummy text
insert text here
text to be added
content coming soon
section intentionally left
left as a stub
fill in later
asdf
test test
tbd tbd
tbd
to do: write
hier steht ihr text
blindtext
texte de remplissage
votre texte ici
texto de relleno
su texto aquí
texto de exemplo
tekst zastępczy
здесь будет текст
текст-заполнитель
此处填写内容
占位文本
ここにテキストを入力
""".strip().split("\n")

FILLER_WORDS = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor
incididunt labore dolore magna aliqua enim minim veniam quis nostrud
exercitation ullamco laboris nisi aliquip commodo consequat
""".split()

# Bracketed capitals that are log levels or states, not slots.
_LEVELS = "INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL|OK|PASS|FAIL|FAILED|DONE|SKIP|SKIPPED|NOTE|IMPORTANT|TIP|CAUTION|API|END|EOF|EOS|BOS|PAD|UNK|CLS|SEP|MASK"

SLOT = re.compile(
    r"\{\{\s*[\w .-]{1,60}\s*\}\}"
    r"|\{%\s*[\w .-]{1,60}\s*%\}"
    r"|\$\{[\w .-]{1,60}\}"
    r"|%\([\w .-]{1,60}\)[sdf]"
    r"|@@[\w .-]{1,60}@@"
    r"|(?<!\w)__[A-Z][A-Z0-9_]{1,60}?__(?!\w)"
    r"|<(?:your|insert)\s[\w .-]{1,60}>"
    r"|<(?:[A-Z][A-Z0-9]+|[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)+)>"
    r"|\[(?:insert|your|enter|add)\s[\w .-]{1,60}\]"
    r"|\[(?!(?:" + _LEVELS + r")\])(?:[A-Z][A-Z0-9]+|[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)+)\](?!\()"
    r"|\bXXX+(?:\s*\([\w .-]{1,60}\))?",
)
#: How slots begin, in lower case.
SLOT_OPENINGS = ("{{", "{%", "${", "%(", "@@", "__", "<", "[", "xxx")
_PHRASE, _SLOT = 0, 1
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]+`", re.S)
_PAGE = re.compile(r"<(?:!doctype|html|head|body|noscript|center)\b", re.I)
_PAGE_ERROR = re.compile(r"\b[45]\d\d\b|not available|timely response|can't be reached|requires? javascript|enable javascript|<noscript", re.I)


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Phrases, filler words and slot openings, with length and kind."""
    a = ahocorasick.Automaton()
    for phrase in [*ERROR_PHRASES, *SCRIPT_PHRASES, *FILLER_PHRASES, *FILLER_WORDS]:
        a.add_word(phrase, (len(phrase), _PHRASE))
    for opening in SLOT_OPENINGS:
        a.add_word(opening, (len(opening), _SLOT))
    a.make_automaton()
    return a


def _bounded(text: str, start: int, end: int) -> bool:
    left = start == 0 or not (text[start - 1].isalnum() and text[start].isalnum())
    right = end == len(text) or not (text[end - 1].isalnum() and text[end].isalnum())
    return left and right


def _lower(text: str) -> str:
    """Lower case of the same length: characters whose lower form is longer stay as they are."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _spans(text: str) -> list[tuple[int, int]]:
    """Matched stretches, sorted and without overlap; a phrase that opens a bracket reaches to its end."""
    spans: list[tuple[int, int]] = []
    lower = _lower(text)
    for last, (n, kind) in automaton().iter(lower):
        start, end = last - n + 1, last + 1
        if kind == _SLOT:
            slot = SLOT.match(text, start)
            if slot:
                spans.append(slot.span())
        elif _bounded(lower, start, end):
            if lower[start] == "[":
                close = lower.find("]", end)
                end = close + 1 if close >= 0 else end
            spans.append((start, end))
    page = _PAGE.search(text)
    if page and _PAGE_ERROR.search(text):
        spans.append((page.start(), max(text.rfind(">") + 1, page.end())))
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    return merged


def _filled(text: str) -> int:
    return len("".join(text.split()))


def coverage(text: str) -> float:
    """Share of the document that matches in residue paragraphs cover; code is content and never matched, blanks do not count. 0 for blank text."""
    if is_blank(text):
        return 0.0
    bare = _CODE.sub(lambda m: "\x01" * len(m.group(0)), text)
    spans = _spans(bare)
    if not spans:
        return 0.0
    total, at, k = 0, 0, 0
    for part in [bare] if _PAGE.search(bare) else re.split(r"(\n\s*\n)", bare):
        end = at + len(part)
        covered = 0
        while k < len(spans) and spans[k][0] < end:
            covered += _filled(bare[max(spans[k][0], at) : min(spans[k][1], end)])
            if spans[k][1] > end:
                break  # goes on in the next part
            k += 1
        if covered and covered >= PARAGRAPH * _filled(part):
            total += covered
        at = end
    return total / _filled(bare)


def residue_of(response: str | None) -> float:
    """Coverage of a response: of its reply's text, of an API error, or of the raw body."""
    message, _, is_json = reply_of(response)
    if message is not None:
        return coverage(text_of(message.get("content")))
    if not is_json:
        return coverage(response) if response else 0.0
    doc = json.loads(response)
    return 1.0 if isinstance(doc, dict) and doc.get("error") else 0.0


def is_residue(response: str | None) -> bool:
    return residue_of(response) >= COVERAGE


_SCORED = StructType(
    [
        StructField("request_id", LongType()),
        StructField("episode", StringType()),
        StructField("seq", LongType()),
        StructField("coverage", DoubleType()),
        StructField("found", BooleanType()),
    ]
)


def _score(request_id: int, episode: str | None, seq: int | None, response: str | None) -> Iterator[tuple]:
    share = residue_of(response)
    yield request_id, episode, seq, share, share >= COVERAGE


def scored_replies(requests: DataFrame) -> DataFrame:
    """(request_id, episode, seq, coverage, found) of every chat record of status 200, each once."""
    rows = chat_rows(requests, ["request_id", "episode", "seq", "response"], only_ok=True)
    return map_rows(rows, _score, _SCORED, batch=10_000).dropDuplicates(["request_id"])


def residue_records(requests: DataFrame, run_status: DataFrame) -> DataFrame:
    """(origin, record_id): replies that are residue, and runs called a success that ended with one.

    Null responses and blank replies are no cases; rows loaded twice count once;
    a null episode or seq never decides a run, and of equal seq numbers the greatest request_id does; empty tables give no rows.
    """
    scored = materialize(scored_replies(requests), "residue")
    last = scored.where("episode is not null and seq is not null").groupBy("episode").agg(F.max_by("found", F.struct("seq", "request_id")).alias("found")).where("found")
    runs = run_status.where("trace_has_success_result and status_id is not null").select("status_id", "episode").distinct()
    return (
        scored.where("found")
        .select(F.lit("api_requests").alias("origin"), F.col("request_id").alias("record_id"))
        .unionByName(runs.join(last.hint("merge"), "episode", "left_semi").select(F.lit("run_status").alias("origin"), F.col("status_id").alias("record_id")))
    )
