"""Settings of an analysis or a recommendation, and the parsers of their text forms."""

from __future__ import annotations

from dataclasses import dataclass, field

ALGORITHM, CACHE_VERSION = 9, 4


@dataclass(frozen=True)
class YearScope:
    """P2, P3. The years of the hour or body-text metrics; without both ends, every year (no other limit than those given)."""

    from_year: int | None = None
    to_year: int | None = None

    def holds(self, year):
        """Column condition; a null year is in no scope."""
        ok = year.isNotNull()
        ok = ok if self.from_year is None else ok & (year >= self.from_year)
        return ok if self.to_year is None else ok & (year <= self.to_year)

    def label(self) -> str:
        """P11."""
        if self.from_year is None and self.to_year is None:
            return "All eligible years"
        return f"{'start' if self.from_year is None else self.from_year} to {'end' if self.to_year is None else self.to_year}"


@dataclass(frozen=True)
class DeepScope:
    """P4, P5. Notes for deep text: all, or those of some years with any of some tags and none of others."""

    defined: bool = False
    years: YearScope = YearScope()
    included: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()

    def resolved(self, config: "AnalysisConfig") -> "DeepScope":
        """The tags as notes have them: normalised, aliased, without ignored ones, distinct."""

        def norm(tag: str) -> str:
            import re

            parts = [x.strip() for x in re.sub(r"\s+", " ", re.sub("^#+", "", tag.strip().replace("\\", "/"))).lower().split("/") if x.strip()]
            return (parts[-1] if parts else "") if config.tag_mode == "leaf" else "/".join(parts)

        aliases = {norm(a): norm(b) for a, b in config.tag_aliases.items() if norm(a) and norm(b)}
        ignored = {norm(t) for t in config.ignored_tags}
        clean = lambda tags: tuple(dict.fromkeys(t for t in (aliases.get(norm(x), norm(x)) for x in tags) if t and t not in ignored))
        return DeepScope(self.defined, self.years, clean(self.included), clean(self.excluded))

    def label(self) -> str:
        """P11."""
        if not self.defined:
            return "Analyze everything"
        ends = ("start" if self.years.from_year is None else self.years.from_year, "end" if self.years.to_year is None else self.years.to_year)
        return f"{ends[0]} to {ends[1]}"

    def holds(self, year, tags):
        """Column condition over a note's year and tags."""
        from pyspark.sql import functions as F

        if not self.defined:
            return F.lit(True)
        among = lambda names: F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, names))), F.lit(False))
        ok = self.years.holds(year)
        ok = ok & among(self.included) if self.included else ok
        return ok & ~among(self.excluded) if self.excluded else ok


@dataclass(frozen=True)
class AnalysisConfig:
    """What an analysis reads and how; years are empty for no limit."""

    scope_mode: str = "all"
    folders: tuple[str, ...] = ()
    ignored_folders: tuple[str, ...] = ()
    subfolders: bool = True
    skip_hidden: bool = True
    created_key: str = "created at"
    updated_key: str = "updated at"
    exclude_fences: bool = True
    exclude_inline_code: bool = True
    body_text: bool = True
    deep_text: bool = False
    tag_mode: str = "full"
    tag_aliases: dict[str, str] = field(default_factory=dict)
    ignored_tags: tuple[str, ...] = ()
    words_per_minute: int = 230
    summary_method: str = "mean"
    combination: str = "single"
    min_tag_count: int = 1
    from_year: int | None = None
    to_year: int | None = None
    include_years: tuple[int, ...] = ()
    exclude_years: tuple[int, ...] = ()
    strict_parity: bool = True
    hour_years: YearScope = YearScope()
    text_years: YearScope = YearScope()
    deep: DeepScope = DeepScope()

    def __post_init__(self):
        if self.scope_mode not in ("all", "include", "exclude") or self.tag_mode not in ("full", "leaf"):
            raise ValueError("unknown mode")
        wpm = self.words_per_minute
        object.__setattr__(self, "words_per_minute", max(1, int(wpm + 0.5)) if isinstance(wpm, (int, float)) and wpm == wpm and wpm > 0 else 230)

    def signature(self) -> str:
        """What parsing depends on: another signature makes stored notes stale."""
        import json

        return json.dumps([ALGORITHM, self.created_key, self.updated_key, self.exclude_fences, self.exclude_inline_code, self.body_text, self.deep_text, self.tag_mode, sorted(self.tag_aliases.items()), sorted(self.ignored_tags)])

    @property
    def combination_size(self) -> int:
        return {"single": 1, "pairs": 2, "triples": 3}.get(self.combination, 1)

    def year_scope(self, year):
        """Column condition: the range, then the included years, then the excluded ones."""
        from pyspark.sql import functions as F

        ok = year.isNotNull()
        if self.from_year is not None:
            ok &= year >= self.from_year
        if self.to_year is not None:
            ok &= year <= self.to_year
        if self.include_years:
            ok &= year.isin(*self.include_years)
        if self.exclude_years:
            ok &= ~year.isin(*self.exclude_years)
        return ok & F.lit(True)

    def scope_label(self) -> str:
        if self.from_year is None and self.to_year is None:
            return "All eligible years"
        return f"{self.from_year if self.from_year is not None else 'start'} to {self.to_year if self.to_year is not None else 'now'}"


@dataclass(frozen=True)
class RecommendConfig:
    """Which notes a recommendation reads, and its weights."""

    indexing: bool = True
    skip_hidden: bool = True
    exclude_folders: tuple[str, ...] = ()
    out_link: float = 5.0
    back_link: float = 3.0
    shared_tag: float = 2.0
    shared_neighbour: float = 2.0
    same_folder: float = 1.0
    limit: int = 10
    diversity: float = 0.3
    #: Not in strict mode: pick notes that are unlike those already picked, from so many of the best (0: off).
    diverse_pool: int = 0


def parse_lines(text: str) -> tuple[str, ...]:
    """Trimmed non-empty lines."""
    return tuple(x.strip() for x in text.splitlines() if x.strip())


def parse_years(text: str) -> tuple[int, ...]:
    """Distinct four-digit years of a comma or space separated list, ascending."""
    import re

    return tuple(sorted({int(x) for x in re.split(r"[\s,;]+", text) if re.fullmatch(r"\d{4}", x)}))


def parse_aliases(text: str) -> dict[str, str]:
    """Lines of `from => to`."""
    out = {}
    for line in parse_lines(text):
        left, arrow, right = line.partition("=>")
        if arrow and left.strip() and right.strip():
            out[left.strip().lower()] = right.strip().lower()
    return out


def describe_scope(mode: str, folders: int) -> str:
    """How the folder list is read."""
    if mode == "all":
        return "All notes are eligible."
    if mode == "include":
        return "No folder is listed, so no note is eligible." if not folders else f"Only notes in {folders} listed folders are eligible."
    return "No folder is listed, so nothing is left out." if not folders else f"Notes in {folders} listed folders are left out."
