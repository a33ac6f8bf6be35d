"""Broken prompt and response pairs: noisy labelling functions and an EM label model.

Every defect has several labelling functions that vote 1, 0 or abstain. Votes
are counted by pattern over all records (at most 3**k patterns, whatever the
corpus), a two-class model with conditionally independent votes is fitted to
those counts by expectation-maximization, and each record gets the posterior of
its pattern. A defect is kept when its posterior exceeds its cutoff, which is
validated on pairs labelled by hand; a record may keep several.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from brindle.llm.chat import chat_rows, is_blank, map_rows, messages_of, reply_of, text_of
from brindle.llm.defect_examples import LABELLED
from brindle.llm.language import asked_languages, decide, script_of, scores_of
from brindle.llm.residue import is_residue
from brindle.plans.materialize import materialize

DEFECTS = ("empty", "refusal", "echo", "language", "truncated")
_YES, _NO, _SKIP = "1", "0", "-"


def _vote(yes: bool, no: bool = True) -> str:
    return _YES if yes else _NO if no else _SKIP


# ---- empty


def empty_votes(answer: str) -> str:
    solid = any(c.isalnum() for c in answer)
    return _vote(is_blank(answer)) + _vote(not solid) + _vote(len(answer.strip()) < 2 and not solid, solid)


# ---- truncated

_END = re.compile(r"[.!?。！？…»”’\"')\]）」』✓✔:]\s*$")
_STOP = re.compile(r"[.!?。！？…]['\"”’)\]»」』）*_]*\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])(?:\s+(.*))?$")
_PATH = re.compile(r"(?:[\w.-]+/)+[\w.-]*\.[A-Za-z0-9]{1,8}$|[\w-]+\.[A-Za-z]{1,8}$")
# Words that cannot end a sentence.
DANGLING = frozenset(
    "the a an of and or but because so that which with without for from to at by in on under is are was were be its our every each as than if when while "
    "der die das und oder weil mit ohne für von zu ist war dass ein eine einen "
    "le la les et ou mais parce avec sans pour de du des dans est une un que "
    "el los las y o pero porque con sin para por en es una del "
    "и или но что потому с без для на в из к".split()
)
#: A sentence does not end in the first half of a decimal number, nor inside a path whose last part still lacks its extension.
_CUT_NUMBER = re.compile(r"(?<![\w.,])0\.$")
_CUT_PATH = re.compile(r"(?<![\w/.-])(?:[\w.-]+/)+(?:[\w-]*[_\d-][\w-]*)?\.?$")


def _complete_tail(answer: str) -> bool:
    """Whether the answer stops where a sentence, list item, table row, code block or JSON value does."""
    body = answer.rstrip()
    lines = body.split("\n")
    last = lines[-1].rstrip()
    if body.count("```") % 2:
        return False
    if last.strip() == "```":
        return True
    if body.lstrip()[:1] in "{[" and re.match(r"\s*(?:\{\s*\"|\[\s*[\[{\"\d])", body):
        return _parses(body)
    if _ITEM.fullmatch(last) and not (_ITEM.fullmatch(last).group(1) or "").strip():
        return False
    if _STOP.search(last):
        return not (_CUT_NUMBER.search(last) or _CUT_PATH.search(last))
    item = _ITEM.match(last)
    if item:
        return bool(item.group(1)) and bool(_PATH.search(item.group(1)) or not _listed_stops(lines))
    if last.count("|") >= 2 or "\t" in last:
        return last.endswith("|") or "\t" in last
    if re.search(r"[✓✔☑✅]$|[)\]}»”\"』」）>]$", last):
        return not re.search(r"[,(\[{]\s*[\"']?$", last)
    return False


def _listed_stops(lines: list[str]) -> bool:
    """Whether earlier items of the list end as sentences, so the last one should."""
    items = [m.group(1) or "" for m in map(_ITEM.match, lines[:-1]) if m]
    return not items or sum(bool(_STOP.search(i)) for i in items) * 2 > len(items)


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def truncated_votes(answer: str, finish: str | None) -> str:
    if is_blank(answer):
        return _NO * 6
    body = answer.rstrip()
    last = body.split("\n")[-1]
    fences = body.count("```")
    looks_json = bool(re.match(r"\s*\{\s*\"", body))
    words = re.findall(r"[^\W\d_]+", last)
    open_now = sum(last.count(c) for c in "([{") > sum(last.count(c) for c in ")]}") or last.count("`") % 2 == 1 and "```" not in last
    complete = _complete_tail(answer)
    return (
        _vote(not complete)
        + _vote(fences % 2 == 1)
        + _vote(looks_json and not _parses(body))
        + _vote(finish == "length", finish is not None)
        + _vote(not _END.search(body) and bool(words) and words[-1].lower() in DANGLING)
        + _vote(open_now and not complete)
    )


# ---- refusal

# How a refusal opens.
_OPENER = re.compile(
    r"^\W*(?:i['’]?m sorry|i am sorry|sorry|unfortunately|with regret|regrettably|i regret|i apologi[sz]e|apologies|i must decline|i have to decline|i have to stop here"
    r"|es tut mir leid|leider|entschuldigung|bedaure"
    r"|je suis désolé|désolé|malheureusement|je regrette"
    r"|lo siento|lamentablemente|desafortunadamente|por desgracia"
    r"|desculpe|infelizmente|lamento|mi dispiace|purtroppo|przepraszam|niestety"
    r"|извините|простите|к сожалению|抱歉|对不起|很遗憾|根据规定|申し訳|すみません|残念ながら)",
    re.I,
)
# Ways to say no, acts that are declined, and statements that decline by themselves, in lower case.
_NEGATIONS = (
    "can't|can’t|cannot|can not|could not|won't|won’t|will not|am not able to|'m not able to|am unable to|'m unable to|won't be able to|will not be able to|"
    "not possible for me to|may not|must not|not allowed to|not permitted to|refuse to|decline to|don't|do not"
).split("|")
_ACTS = "help|assist|answer|fulfil|carry out|prepare|provide|work on|continue|produce|discuss|comply|support this|engage|write this|do this|do that|complete this request|take part".split("|")
_DECLINES = (
    "something i won't do|something i will not do|something i can't do|i must decline|i have to decline|i decline|refrain from answering|not comfortable producing|not comfortable with|not comfortable doing|"
    "not comfortable helping|not comfortable writing|i'd rather not|i would rather not|i prefer not to|guidelines do not allow|guidelines don't allow|guidelines don't permit|against my guidelines|outside what i am permitted|"
    "nicht helfen|keine auskunft|muss ich ablehnen|möchte ich nicht bearbeiten|kann ich nicht beantworten|kann ich nicht bearbeiten|lehne ich ab|"
    "peux pas vous aider|peux pas répondre|pas permis de répondre|préfère ne pas|dois refuser|ne suis pas en mesure|"
    "no puedo ayudar|no me está permitido|prefiero no|debo rechazar|no puedo responder|no puedo continuar|"
    "não posso ajudar|não posso responder|prefiro não|devo recusar|não me é permitido|nie mogę pomóc|nie mogę odpowiedzieć|muszę odmówić|"
    "не могу помочь|не могу ответить|не могу выполнить|не разрешено|вынужден отказать|должен отказать|я отказываюсь|предпочитаю не|"
    "无法协助|无法帮助|不能协助|不能回答|无法回答|必须拒绝|拒绝这项|不便回答|お手伝いできません|お答えできません|お断り"
).split("|")


@functools.cache
def _refusals() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in [*_DECLINES, *(f"{n} {v}" for n in _NEGATIONS for v in _ACTS)]:
        a.add_word(phrase, len(phrase))
    a.make_automaton()
    return a


def _declines(text: str) -> bool:
    return next(_refusals().iter(text.lower().replace("’", "'")), None) is not None


_REDIRECT = re.compile(
    r"please rephrase|choose another topic|something else you would like|consult a |ask someone qualified|misused|could be abused|falls outside"
    r"|wende dich an|fachperson|missbraucht|merci de votre compréhension|consulta a un|especialista|spécialiste|обратитесь|специалист|请咨询|其他问题",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
#: What only an answer holds: a number that is no part of a name, code, a path.
_FACT = re.compile(r"(?<!\w)\d|```|\w/\w")


def sentences_of(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text) if s.strip()]


def refusal_votes(answer: str) -> str:
    if is_blank(answer):
        return _NO * 4
    opener = bool(_OPENER.search(answer))
    if not _declines(answer):
        return _vote(opener) + _NO * 3
    parts = sentences_of(answer)
    rest = [s for s in parts if not (_declines(s) or _REDIRECT.search(s) or (_OPENER.search(s) and len(s) < 60))]
    facts = sum(bool(_FACT.search(s)) for s in rest)
    return _vote(opener) + _YES + _vote(bool(_REDIRECT.search(answer))) + _vote(not facts and len(rest) <= 1)


# ---- echo

_TOKEN = re.compile(r"[぀-ヿ一-鿿가-힣]|[^\W_぀-ヿ一-鿿가-힣]+")


def _grams(text: str) -> list[tuple[str, ...]]:
    """Runs of three words; all words where there are fewer."""
    words = _TOKEN.findall(text.lower())
    return list(zip(words, words[1:], words[2:])) or ([tuple(words)] if words else [])


def echo_votes(question: str, answer: str) -> str:
    a, q = _grams(answer), _grams(question)
    if not a or not q:
        return _NO * 3
    in_question, in_answer = set(q), set(a)
    held = sum(g in in_question for g in a) / len(a)
    covered = sum(g in in_answer for g in q) / len(q)
    repeated = 0.0
    if held >= 0.3:  # else too few sentences can be the question's
        asked = {" ".join(_TOKEN.findall(s.lower())) for s in sentences_of(question)}
        said = [s for s in (" ".join(_TOKEN.findall(x.lower())) for x in sentences_of(answer)) if s]
        repeated = sum(s in asked for s in said) / max(1, len(said))
    return _vote(held >= 0.8, held < 0.65) + _vote(covered >= 0.5, covered < 0.4) + _vote(repeated >= 0.6, repeated < 0.5)


# ---- language


def language_votes(question: str, answer: str) -> str:
    if is_blank(answer) or is_blank(question):
        return _NO * 3
    sq, sa = script_of(question), script_of(answer)
    if not sq or not sa:
        return _SKIP * 3
    wanted = asked_languages(question)
    if sq != sa and "latin" not in (sq, sa):
        return _NO * 3 if sa in wanted else _YES * 3
    qs, ans = scores_of(question), scores_of(answer)
    lq = decide(qs) if sq == "latin" else sq
    la = decide(ans) if sa == "latin" else sa
    if la and la in wanted:
        return _NO * 3
    if sq != sa:
        return _YES + _vote(bool(lq and la), bool(lq and la)) + _YES
    if sq != "latin":
        return _NO * 3
    own, other = max(qs, key=qs.get), max(ans, key=ans.get)
    strong = other != own and ans[other] >= 2 * ans[own] + 2
    return _SKIP + _vote(bool(lq and la and lq != la), bool(lq and la)) + _vote(strong and other not in wanted, not strong)


_VOTED = StructType([StructField("request_id", LongType())] + [StructField(d, StringType()) for d in DEFECTS])


def _pair(request: str | None, response: str | None) -> tuple[str, str, str | None] | None:
    """(question, answer, finish reason) of an answered pair, or None where the record is none."""
    messages = messages_of(request)
    if messages is None:
        return None
    users = [m for m in messages if m.get("role") == "user"]
    reply, finish, _ = reply_of(response)
    if not users or reply is None or reply.get("tool_calls") or is_residue(response):
        return None
    return text_of(users[-1].get("content")), text_of(reply.get("content")), finish


def _votes_of(question: str, answer: str, finish: str | None) -> tuple[str, ...]:
    """The votes of the labelling functions, in the order of ``DEFECTS``."""
    return empty_votes(answer), refusal_votes(answer), echo_votes(question, answer), language_votes(question, answer), truncated_votes(answer, finish)


def _votes(request_id: int, request: str | None, response: str | None) -> Iterator[tuple]:
    pair = _pair(request, response)
    if pair is not None:
        yield request_id, *_votes_of(*pair)


#: Prior beliefs about each labelling function: how often it votes 1 on defective and on sound pairs, where it votes.
BELIEFS = {
    "empty": ((0.98, 0.002), (0.98, 0.01), (0.95, 0.01)),
    "refusal": ((0.70, 0.03), (0.95, 0.005), (0.40, 0.01), (0.85, 0.01)),
    "echo": ((0.95, 0.01), (0.90, 0.03), (0.85, 0.01)),
    "language": ((0.95, 0.005), (0.90, 0.01), (0.90, 0.01)),
    "truncated": ((0.95, 0.003), (0.20, 0.001), (0.20, 0.001), (0.40, 0.10), (0.40, 0.005), (0.30, 0.005)),
}


def posteriors(patterns: list[str], rate: np.ndarray, share: float) -> np.ndarray:
    """Probability of the defect for each vote pattern; a pattern without a vote for it never rises above the share of defects."""
    yes, cast = _cast(patterns)
    post = _posterior(yes, cast, rate, share)
    return np.where(yes.sum(axis=1) == 0, np.minimum(post, share), post)


def _cast(patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([[v == _YES for v in p] for p in patterns], dtype=float), np.array([[v != _SKIP for v in p] for p in patterns], dtype=float)


def _posterior(yes: np.ndarray, cast: np.ndarray, rate: np.ndarray, share: float) -> np.ndarray:
    loglik = (yes[None] * np.log(rate)[:, None] + (cast - yes)[None] * np.log(1 - rate)[:, None]).sum(axis=2)
    odds = loglik[1] - loglik[0] + np.log(share / (1 - share))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_label_model(patterns: list[str], counts: np.ndarray, beliefs: tuple[tuple[float, float], ...], rounds: int = 100, strength: float = 20.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of the patterns, vote rates (sound and defective x functions) and the share of defects.

    EM for a two-class model with conditionally independent votes; abstaining
    says nothing. Beta priors of ``strength`` pseudo-records around ``beliefs``
    keep each function's direction, so the classes cannot swap; the records outweigh them.
    """
    yes, cast = _cast(patterns)
    prior = np.array(beliefs).T[::-1]  # sound, defective
    rate, share = prior.copy(), 0.03
    for _ in range(rounds):
        post = _posterior(yes, cast, rate, share)
        for y, w in ((0, counts * (1 - post)), (1, counts * post)):
            rate[y] = np.clip((w @ yes + strength * prior[y]) / (w @ cast + strength), 1e-9, 1 - 1e-9)
        share = float((counts @ post + 1) / (counts.sum() + 30))
    return posteriors(patterns, rate, share), rate, share


def validated_cutoff(post: np.ndarray, defective: np.ndarray) -> float:
    """The cutoff that separates labelled pairs best (greatest F1); of equally good ones, the middle of the widest gap."""
    levels = np.unique(np.r_[0.0, post, 1.0])
    best, cutoff = (-1.0, 0.0), 0.5
    for low, high in zip(levels, levels[1:]):
        middle = (low + high) / 2
        kept = post > middle
        hit = float((kept & defective).sum())
        f1 = 2 * hit / max(1.0, kept.sum() + defective.sum())
        if (f1, high - low) > best:
            best, cutoff = (f1, high - low), middle
    return float(cutoff)


@functools.cache
def _example_votes() -> dict[str, list[str]]:
    votes = [_votes_of(q, a or "", finish) for q, a, finish, _ in LABELLED]
    return {d: [v[k] for v in votes] for k, d in enumerate(DEFECTS)}


def fitted_patterns(seen: dict[str, dict[str, int]]) -> list[tuple[str, str, float]]:
    """(defect, vote pattern, posterior) of the patterns above their validated cutoff; ``seen`` counts the patterns of each defect."""
    out = []
    for d, own in seen.items():
        patterns = list(own)
        post, rate, share = fit_label_model(patterns, np.array([own[p] for p in patterns], dtype=float), BELIEFS[d])
        cutoff = validated_cutoff(posteriors(_example_votes()[d], rate, share), np.array([d in x for *_, x in LABELLED]))
        out += [(d, p, float(v)) for p, v in zip(patterns, post) if v > cutoff]
    return out


def labelled_pairs(requests: DataFrame) -> DataFrame:
    """(request_id, defect, posterior) of every defect whose posterior exceeds its cutoff; several a record are possible."""
    spark = requests.sparkSession
    rows = chat_rows(requests, ["request_id", "request", "response"], only_ok=True)
    voted = materialize(map_rows(rows, _votes, _VOTED, batch=10_000).dropDuplicates(["request_id"]), "votes")
    long = voted.select("request_id", F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in DEFECTS))).alias("v")).select("request_id", "v.*")
    seen = long.groupBy("defect", "votes").count().collect()  # at most 5 * 3**6 rows
    fitted = fitted_patterns({d: {r["votes"]: r["count"] for r in seen if r["defect"] == d} for d in sorted({r["defect"] for r in seen})})
    schema = StructType([StructField("defect", StringType()), StructField("votes", StringType()), StructField("posterior", DoubleType())])
    return long.join(F.broadcast(spark.createDataFrame(fitted, schema)), ["defect", "votes"]).select("request_id", "defect", "posterior")


def defective_pairs(requests: DataFrame) -> DataFrame:
    """(request_id, defect): each defective pair with its most probable defect.

    Records without valid JSON, user message or reply, with tool calls, or that
    are residue (error pages, templates) are no pairs. A null answer is empty;
    a blank question has no language and is never echoed. Rows loaded twice
    count once. Ties go to the defect named first in ``DEFECTS``.
    """
    rank = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return (
        labelled_pairs(requests)
        .groupBy("request_id")
        .agg(F.max_by("defect", F.struct(F.round("posterior", 1), -rank)).alias("defect"))
        .select("request_id", "defect")
    )
