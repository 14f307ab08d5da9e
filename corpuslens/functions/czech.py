"""Czech normal forms, content terms and name keys; Arrow functions where Spark has no decomposition of accents."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

# Function words (normal form) that are no content terms.
STOPWORDS = frozenset(
    "a aby aj ale ani ano asi az bez by byl byla byli bylo byt co do ho i ja jak jako je jeho jej jejich jemu jen jenom jeste ji jich jimi jinak jine jsem jsi jsme jsou k kam kde kdo kdy ktera ktere kteri ktery ma mate me mezi mi mit mu my na nad nam nas nasi ne nebo nebyl nebyla neco nejak nejen neni nez nic nich nim nimi no novy o od on ona oni ono po pod podle pokud pro proc pred pres pri s se si smi snad tak take takhle taky tam ten tento teprve tedy teho to tohle tom tomto totiz toto tu tuhle tuto tvuj ty u uz v vam vas vasi ve vice vsak vy za zase zda ze zpet zrovna the and or to of in on for with is are was were be been being that this it".split()
)
# Word endings that are cut, tried in this order; four letters must stay.
SUFFIXES = "oveho ovemu ovych ovymi kami temi tami tosti nosti ech ich ych ami emi ove ovi ova ost osti ani eni aci ace ovat ovat kou kem ami emi ove ovi ach ech ych ich ku ka ky ou at it et em om am ym im ho mu".split()
# Words that are no names, words that lead no name, endings of names (tried in order; three letters must stay).
NAME_STOPWORDS = frozenset(
    "a aby ach ah ale ani ano asi az bez bohuzel boze by byl byla byli bylo co dalsi diky dnes do dr hej ho i ja jak jako je jeho jej jejich jen jeste jsem jsi jsme jsou kam kde kdo kdy leden ledna letos listopad listopadu mam mame mate me mezitim mi mu my na nad nam nas ne nedele nejen neni nez nic noc on ona oni ono pan pani patek po pod pondeli potom pred proc proto pry rano rijen rijna s se si sobota srpen srpna streda strevda tak take taky tam te ted teda ten tentokrat tento to tohle tom u unor unora utery uz v ve vecer vcera vsak za zacatek zari zarij zitra".split()
)
LEADS = frozenset("ma mam mas mame mate maji vola volal volala pise psal psala rika rikal rikala rekl rekla naha nahy nahou".split())
NAME_SUFFIXES = "ovych ovymi oveho ovemu kami tami temi osti ovou ovym ovim ech ich ych ami emi ove ovi ova ino ina iny ou em om am im ym ho mu u y i a e o".split()
# Endings that speak for or against a spelling as the name's base form.
BASE_ENDINGS = ("a", "e", "o", "ek", "ec")
OBLIQUE_ENDINGS = ("kou", "ku", "ky", "ce", "ci", "cu", "cy", "ou", "em", "om", "am", "im", "ym", "ich", "ych", "ech", "ami", "emi", "cina", "cino", "ciny", "cine", "cinu", "cin")


def normal(token: str) -> str:
    """X20. Lower case without accents and apostrophes."""
    plain = unicodedata.normalize("NFD", token.lower())
    return "".join(c for c in plain if not unicodedata.category(c).startswith("M") and c not in "'’`").strip()


def _cut(token: str, endings: list[str], shortest: int, keep: int) -> str:
    if len(token) < shortest:
        return token
    return next((token[: -len(e)] for e in endings if token.endswith(e) and len(token) - len(e) >= keep), token)


def strip_suffix(token: str) -> str:
    """X22."""
    return _cut(token, SUFFIXES, 6, 4)


@functools.lru_cache(1 << 16)
def content_key(token: str) -> str | None:
    """X20, X21. The content term of a token, or None."""
    form = normal(token)
    if len(form) < 3 or form.isdigit() or not re.search("[a-z]", form) or form in STOPWORDS:
        return None
    stem = strip_suffix(form)
    return None if len(stem) < 3 or stem in STOPWORDS else stem


#: Rewrites of a name's normal form, in order: foreign th, possessives, feminine and softened endings.
_NAME_RULES = [(re.compile("^th"), "t"), (re.compile("(?<=^...)cin[a-z]*$|(?<=...)cin[a-z]*$"), "k"), (re.compile("(?<=...)(?:kou|ka|ky|ku)$"), "k"), (re.compile("(?<=..[^aeiouy])c[eiuy]$"), "k")]


@functools.lru_cache(1 << 16)
def name_token_key(token: str) -> str:
    """X33. One key for the forms of a name's word."""
    form = normal(re.sub("['’`\".,;:!?()\\[\\]{}]+", "", token))
    for pattern, to in _NAME_RULES:
        form = pattern.sub(to, form, count=1)
    return _cut(strip_suffix(form), NAME_SUFFIXES, 4, 3) or form


def name_key(name: str) -> str:
    return " ".join(k for k in map(name_token_key, name.split()) if k)


def _is_lead(token: str) -> bool:
    form = normal(token)
    return bool(form) and (form in LEADS or strip_suffix(form) in LEADS)


def _is_name(tokens: list[str]) -> bool:
    if not tokens or len(tokens) == 1 and len(tokens[0]) < 3 or len(tokens) > 1 and _is_lead(tokens[0]):
        return False
    return all(len(k) >= 2 and k not in NAME_STOPWORDS for k in map(name_token_key, tokens))


def _capitalised(token: str) -> bool:
    return len(token) >= 2 and token[0].isupper() and not any(c == "." for c in token)


def names(text: str | None) -> list[str]:
    """X30-X32. Candidate names: runs of capitalised words; a single word not at a sentence's start."""
    found: dict[str, str] = {}
    for segment in re.split(r"[.!?…]+\s*|\n+", (text or "").replace("\r\n", "\n")):
        tokens = re.findall(r"[^\W\d_]+(?:[.'’`-][^\W\d_]+)*", segment)
        at = 0
        while at < len(tokens):
            end = at
            while end < len(tokens) and _capitalised(tokens[end]):
                end += 1
            run = tokens[at:end]
            if len(run) > 1 and not _is_name(run) and _is_lead(run[0]):
                run = run[1:]
                single_allowed = True
            else:
                single_allowed = at > 0
            if run and (len(run) > 1 or single_allowed) and _is_name(run):
                found.setdefault(name_key(" ".join(run)), " ".join(run))
            at = max(end, at + 1)
    return sorted(found.values())


def surface_score(label: str) -> int:
    """X34. How likely a spelling is a name's base form."""
    form = normal(label)
    if not form:
        return 0
    led = form.split()[0] in LEADS
    plain = bool(re.fullmatch("(?:[a-z]+ )+[a-z]+", form))
    return 2 * (plain and not led) + 2 * form.endswith(BASE_ENDINGS) - 3 * form.endswith(OBLIQUE_ENDINGS) - 4 * led


@F.pandas_udf(ArrayType(StringType()))
def names_column(text: pd.Series) -> pd.Series:
    return text.map(names)


@F.pandas_udf(StringType())
def name_key_column(label: pd.Series) -> pd.Series:
    return label.map(name_key)


@F.pandas_udf(IntegerType())
def surface_score_column(label: pd.Series) -> pd.Series:
    return label.map(surface_score).astype("int32")


@F.pandas_udf(StringType())
def content_key_column(token: pd.Series) -> pd.Series:
    """For tables of distinct tokens: Python sees each once, not once for each place that it stands in."""
    return token.map(content_key)
