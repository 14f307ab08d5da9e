"""Text columns: Markdown clean-up, tokens, sentences, openings, phrases, tags, links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark an opening line as temporal, scene-setting or emotional.
TEMPORAL = "today yesterday tomorrow morning evening night monday tuesday wednesday thursday friday saturday sunday dnes včera zítra rano ráno vecer večer noc pondeli pondělí utery úterý streda středa ctvrtek čtvrtek patek pátek sobota nedele neděle".split()
SCENE = "in at on under behind before near outside inside v ve na u pod nad před pred za".split()
EMOTIONAL = "oh ah aha wow uff ach boze bože jejda".split()
SIGNATURES = ("temporal", "emotional", "scene-setting", "fragmentary", "descriptive", "declarative", "other")

# Possessive: nothing follows a run, so giving characters back could never help.
TOKEN = r"[\p{L}\p{N}]++(?:['’_-][\p{L}\p{N}]++)*+"
MOST_PHRASES = 60
#: Tokens from the start of a text that hold its phrases, nearly always.
AHEAD = 2 * MOST_PHRASES


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_frontmatter(content: Column) -> Column:
    return F.when(content.startswith("---"), F.regexp_replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), r"(?s)\A---\n.*?\n---\n?", "")).otherwise(content)


def strip_fences(content: Column) -> Column:
    """Without fenced code: a fence closes with the same mark, as long at least; an open one runs to the end."""
    marks = r"^[ \t]{0,3}(`{3,}|~{3,})"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("mark"))

    def step(state, line):
        mark = F.regexp_extract(line, marks, 1)
        inside = state["mark"] != ""
        closes = inside & (mark != "") & (F.substring(mark, 1, 1) == F.substring(state["mark"], 1, 1)) & (F.length(mark) >= F.length(state["mark"]))
        opens = ~inside & (mark != "")
        return F.struct(
            F.when(inside | opens, state["out"]).otherwise(F.concat(state["out"], F.array(line))).alias("out"),
            F.when(closes, F.lit("")).when(opens, mark).otherwise(state["mark"]).alias("mark"),
        )

    return F.aggregate(F.split(content, "\n", -1), start, step, lambda s: F.array_join(s["out"], "\n"))


def strip_inline_code(content: Column) -> Column:
    """Without code spans: equally long runs of backticks on one line."""
    return F.regexp_replace(content, r"(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)", " ")


def clean_markdown(content: Column, fences: bool = True, inline: bool = True) -> Column:
    """Plain text of a note, in a fixed order of steps."""
    text = strip_frontmatter(F.coalesce(content, F.lit("")))
    text = strip_fences(text) if fences else text
    text = strip_inline_code(text) if inline else text
    for pattern, to in (
        (r"!\[\[([^\[\]]+)\]\]", " "), (r"\[\[[^\[\]|]+\|([^\[\]]*)\]\]", " $1 "), (r"\[\[([^\[\]]+)\]\]", "  "), (r"!?\[([^\]]*)\]\([^)]+\)", " $1 "),
        (r"(?m)^[\t ]{0,3}(?:>\s*)+", ""), (r"(?m)^[\t ]{0,3}#{1,6}[\t ]+", ""), (r"(?m)^[\t ]{0,3}(?:[-+*]|\d+[.)])[\t ]+(?:\[(?: |x|X)\][\t ]+)?", ""),
        (r"(?m)^[\t ]*\[![^\]\n]+\][+-]?[\t ]*", ""), (r"(?m)^[\t ]*\|?(?:[\t ]*:?-{3,}:?[\t ]*\|)+[\t ]*$", " "), (r"(?m)^[\t ]{0,3}(?:-{3,}|\*{3,}|_{3,})[\t *-_]*$", " "), (r"\|", " "), (" ", " "),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def words(cleaned: Column) -> Column:
    """Words for counting: parts between white space that are more than dashes."""
    return F.filter(F.split(cleaned, r"(?U)\s+"), lambda x: (x != "") & ~x.rlike("^[-–—]+$"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, joined by apostrophes, hyphens or underscores."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda x: F.lower(x))


def sentence_lengths(text: Column) -> Column:
    """Tokens of each sentence that has any. No token goes over the end of a sentence, so they add up to all tokens."""
    return F.filter(F.transform(F.split(text, r"[.!?…\n]+"), lambda x: F.size(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)))), lambda n: n > 0)


def opening_line(text: Column) -> Column:
    """The first line that is more than spaces, without those around it."""
    return F.left(F.trim(F.nullif(F.regexp_extract(text, r"[^ \n][^\n]*", 0), F.lit(""))), F.lit(200))


def opening_signature(line: Column) -> Column:
    """How a text opens; null without a token."""
    return _let(F.trim(line), lambda value: _let(tokens(value), lambda toks: _signature(value, toks)))


def _signature(value: Column, toks: Column) -> Column:
    n = F.size(toks)
    among = lambda part, cues: F.arrays_overlap(part, F.array(*map(F.lit, cues)))
    ended = value.rlike(r"[.!?…]$")
    temporal = value.rlike(r"^\d{1,2}[:.]\d{2}\b") | value.rlike(r"^\d{4}-\d{2}-\d{2}\b") | among(F.slice(toks, 1, 3), TEMPORAL)
    emotional = value.contains("!") | value.rlike(r"^[.?!]{2,}") | among(F.slice(toks, 1, 2), EMOTIONAL)
    scene = (n >= 3) & among(F.slice(toks, 1, 2), SCENE)
    return (
        F.when(n == 0, None).when(temporal, "temporal").when(emotional, "emotional").when(scene, "scene-setting").when((n <= 4) & ~ended, "fragmentary")
        .when(value.contains(",") | (n >= 14), "descriptive").when(ended | (n >= 6), "declarative").when(n <= 5, "fragmentary").otherwise("other")
    )


def units(text: Column) -> Column:
    """Q-14. The length in UTF-16 units: a character beyond the first plane counts twice."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


def _grams(toks: Column, n: int) -> Column:
    """The useful runs of n tokens, in order: one token of five characters or more, one that is no number, 3 n in all."""
    marks = F.transform(toks, lambda x: F.when(x.rlike("^[0-9]+$"), -units(x)).otherwise(units(x)))  # numbers count as negative

    def useful(own: Column, i: Column) -> Column:
        part = [F.get(own, i + k) for k in range(n)]
        size = [F.abs(x) for x in part]
        return (F.greatest(*part) > 0) & (F.greatest(*size) >= 5) & (sum(size[1:], size[0]) >= 3 * n)

    starts = _let(marks, lambda own: F.filter(F.sequence(F.lit(0), F.size(own) - n), lambda i: useful(own, i)))
    return F.when(F.size(toks) >= n, F.transform(starts, lambda i: F.array_join(F.slice(toks, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def phrases(toks: Column) -> Column:
    """The first 60 distinct useful phrases: all of four tokens, then all of three.

    If the start of a text has 60 of four tokens, those are the first ones of the whole text too.
    """
    enough = lambda found: F.size(found) >= MOST_PHRASES
    whole = _let(F.array_distinct(_grams(toks, 4)), lambda fours: F.when(enough(fours), fours).otherwise(F.array_distinct(F.concat(fours, _grams(toks, 3)))))
    head = _let(F.array_distinct(_let(F.slice(toks, 1, AHEAD), lambda part: _grams(part, 4))), lambda fours: F.when(enough(fours), fours).otherwise(whole))
    return F.slice(F.when(F.size(toks) > AHEAD, head).otherwise(whole), 1, MOST_PHRASES)


def richness(total: Column, unique: Column) -> Column:
    return F.when((total >= 2) & (unique >= 2), F.ln(unique) / F.ln(total))


def normalize_tag(tag: Column, mode: str = "full") -> Column:
    """Trimmed, without #, slashes straightened, spaces collapsed, lower case."""
    value = F.lower(F.regexp_replace(F.regexp_replace(F.replace(F.trim(tag), F.lit("\\"), F.lit("/")), "^#+", ""), r"\s+", " "))
    parts = F.filter(F.transform(F.split(value, "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")) if mode == "leaf" else F.array_join(parts, "/")


def raw_tags(value: Column) -> Column:
    """Tags of a text such as `a, b` or `["a", "b"]`."""
    inner = F.regexp_replace(F.trim(value), r"^\[|\]$", "")
    return F.transform(F.split(F.regexp_replace(inner, r"[\[\]]", ""), ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))


def tag_set(raw: Column, mode: str = "full", aliases: dict[str, str] | None = None, ignored: tuple[str, ...] = ()) -> Column:
    """Normalised, aliased, not ignored, distinct, sorted."""
    out = F.transform(raw, lambda x: normalize_tag(x, mode))
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        out = F.transform(out, lambda x: F.coalesce(F.try_element_at(table, x), x))
    return F.array_sort(F.array_distinct(F.filter(out, lambda x: (x != "") & ~x.isin(*ignored) if ignored else x != "")))


def wiki_links(content: Column) -> Column:
    """Link targets in order, with repeats: before | and before #."""
    return F.filter(F.transform(F.regexp_extract_all(content, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.trim(F.substring_index(F.substring_index(F.trim(x), "|", 1), "#", 1))), lambda x: x != "")


def folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def highlight(text: Column, query: str) -> Column:
    """All occurrences of a query, marked."""
    import re

    return F.regexp_replace(text, "(?i)" + re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", query), "<mark>$0</mark>")
