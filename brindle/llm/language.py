"""Language of a text by script and function words."""

from __future__ import annotations

import functools
import re
from collections import Counter

import ahocorasick

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and is was are with under that by in which not to for it an at our every before after each its so because when keep be this from why we one per than still i something but please or another you my am can t do will would so cannot sorry help",
    "de": "die der das und wurde mit nicht von den ist für haben wir ich sie eine einen noch auch nach ohne weil wäre worden sind auf bei aber als unter über warum zu im des dem bitte",
    "fr": "la le les et été avec une dans est pour nous pas que plus mais elle avant après fin de du des sur il cette où chaque reste peux vous je ne veuillez avons pourquoi",
    "es": "el la los que con una por en fue las más está también después según ninguna había así explica cada hay lo pero del es para sigue quedó favor no de antes",
    "pt": "o os que com uma por em foi não do da na mais está também depois segundo nenhuma havia assim cada há mas dos é para porque ficou favor antes porém acima",
    "it": "il lo gli che con una per di è stata della non più dopo anche sono nel alla ma questa ogni perché prima",
    "pl": "i w na z nie jest się że do została była dla jak ponieważ po przez ale więc każda od oraz tej przed który",
    "nl": "de het een en van is niet met voor op dat die werd zijn maar ook door naar",
}
_LANGUAGES = list(FUNCTION_WORDS)
_OF_WORD: dict[str, tuple[str, ...]] = {w: tuple(k for k, v in FUNCTION_WORDS.items() if w in v.split()) for v in FUNCTION_WORDS.values() for w in v.split()}
# Letters that speak for a language written in Latin script.
LETTERS = {"de": "äöüß", "fr": "èêàçùœîôâû", "es": "ñ¿¡", "pt": "ãõ", "pl": "ąęłśżźćń"}
_WORD = re.compile(r"[^\W\d_]+")
_SCRIPTS = (
    ("ja", re.compile("[぀-ヿ]"), 8.0),
    ("ko", re.compile("[가-힣]"), 2.5),
    ("zh", re.compile("[一-鿿]"), 2.5),
    ("ru", re.compile("[Ѐ-ӿ]"), 1.0),
    ("ar", re.compile("[؀-ۿ]"), 1.0),
    ("hi", re.compile("[ऀ-ॿ]"), 1.0),
)
_LATIN = re.compile("[A-Za-z]")


def script_of(text: str) -> str:
    """ja, ko, zh, ru, ar, hi or latin; empty where the text has no letters of these."""
    latin = len(_LATIN.findall(text))
    if text.isascii():
        return "latin" if latin else ""
    for name, letters, weight in _SCRIPTS:
        n = len(letters.findall(text))
        if n and n * weight > 0.35 * latin:
            return name
    return "latin" if latin else ""


def scores_of(text: str) -> dict[str, float]:
    """Function words per language, letters of their own counting half."""
    got = dict.fromkeys(_LANGUAGES, 0.0)
    counts = Counter(_WORD.findall(text.lower()))
    for w in _OF_WORD.keys() & counts.keys():
        for k in _OF_WORD[w]:
            got[k] += counts[w]
    if not text.isascii():
        for k, letters in LETTERS.items():
            got[k] += 0.5 * sum(map(text.count, letters))
    return got


def decide(got: dict[str, float], margin: float = 1.5) -> str:
    """The language that leads clearly, or an empty string."""
    (best, top), (_, second) = sorted(got.items(), key=lambda kv: -kv[1])[:2]
    return best if top >= 3 and top >= margin * second else ""


def language_of(text: str, margin: float = 1.5) -> str:
    """The language, or an empty string where the evidence does not decide."""
    script = script_of(text)
    return decide(scores_of(text), margin) if script == "latin" else script


# Names under which a question may ask for a language.
LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés|inglês|английск\\w*|英文|英语|英語|angielsk\\w*",
    "de": "german|deutsch|allemand|alemán|alemão|немецк\\w*|德文|德语|ドイツ語|niemieck\\w*",
    "fr": "french|französisch|français|francés|francês|французск\\w*|法文|法语|フランス語|francusk\\w*",
    "es": "spanish|spanisch|espagnol|español|espanhol|испанск\\w*|西班牙文|西班牙语|スペイン語|hiszpańsk\\w*",
    "pt": "portuguese|portugiesisch|portugais|portugués|português|португальск\\w*|葡萄牙语|ポルトガル語|portugalsk\\w*",
    "pl": "polish|polnisch|polonais|polaco|polonês|польск\\w*|波兰语|ポーランド語|polsku",
    "ru": "russian|russisch|russe|ruso|russo|русск\\w*|俄文|俄语|ロシア語|rosyjsk\\w*",
    "zh": "chinese|chinesisch|chinois|chino|chinês|китайск\\w*|中文|汉语|中国語|chińsk\\w*",
    "ja": "japanese|japanisch|japonais|japonés|japonês|японск\\w*|日文|日语|日本語|japońsk\\w*",
}
_ASKED = {k: re.compile(v) for k, v in LANGUAGE_NAMES.items()}


@functools.cache
def _stems() -> ahocorasick.Automaton:
    """The names up to their open endings: most texts hold none."""
    a = ahocorasick.Automaton()
    for name in "|".join(LANGUAGE_NAMES.values()).split("|"):
        a.add_word(name.split("\\")[0], True)
    a.make_automaton()
    return a



def asked_languages(question: str) -> set[str]:
    """Languages the question names, as words of their own where they are written in letters."""
    lower = question.lower()
    if next(_stems().iter(lower), None) is None:
        return set()
    return {k for k, names in _ASKED.items() if any(_alone(lower, *m.span()) for m in names.finditer(lower))}


def _alone(text: str, start: int, end: int) -> bool:
    if ord(text[start]) >= 0x3000:
        return True
    left = start > 0 and text[start - 1].isalpha() and ord(text[start - 1]) < 0x3000
    right = end < len(text) and text[end].isalpha() and ord(text[end]) < 0x3000
    return not left and not right
