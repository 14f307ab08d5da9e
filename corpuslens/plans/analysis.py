"""The whole analysis as a dictionary of lazy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.config import AnalysisConfig
from corpuslens.operators import bodytext as B
from corpuslens.operators import corpus as C
from corpuslens.operators import entities as N
from corpuslens.operators import examples as EX
from corpuslens.operators import readings as RD
from corpuslens.operators import rhythm as H
from corpuslens.operators import tagstructure as G


def analyze(notes: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> dict[str, DataFrame]:
    """G1, G3, G6, G7. notes: path, created, updated, word_count, tags, text. Every table is lazy; persist notes to share them."""
    entries = C.to_entries(notes, config.words_per_minute)
    scoped = entries.where(config.year_scope(entries["year"]))
    dated, year = notes.where("created is not null"), F.col("year")
    every = B.texts(dated if config.body_text else dated.where("false"))
    texts = every.where(config.text_years.holds(year))
    # Without a text in scope the deep layer is empty too (Q-5).
    some = F.broadcast(texts.select(F.lit(1).alias("some")).limit(1))
    deep = config.deep.resolved(config)
    gated = lambda rows, by: (rows.where(deep.holds(by, F.col("tags"))) if config.deep_text else rows.where("false")).join(some).drop("some")
    deep_texts, found = gated(every, year), N.mentions(gated(dated, F.year("created")))
    profiles = B.year_profiles(texts) if config.body_text else None
    shifts = H.regime_shifts(entries, config.strict_parity, profiles)
    years = H.year_profiles(entries, profiles, config.strict_parity)
    qualified = G.qualified(scoped, config.min_tag_count)
    phrases, tag_texts = B.recurring_phrases(texts), B.tag_profiles(texts, config.min_tag_count)
    by_deep_year = N.deep_years(deep_texts)
    openings, pairs = B.opening_shift(every), G.pair_lift(qualified)
    more = {"texts": profiles, "openings": openings} if profiles is not None else {}
    return {
        "totals": C.totals(entries), "month_heatmap": C.month_heatmap(entries), "weekday_heatmap": C.weekday_heatmap(entries), "word_histogram": C.histogram(entries, "word_count"), "lag_histogram": C.histogram(entries.where("lag_days > 0"), "lag_days"),
        "month_profile": C.month_profile(entries), "tag_coverage": C.tag_coverage(entries), "tag_summary": C.tag_summary(scoped), "hours": C.hourly_activity(entries.where(config.hour_years.holds(year)), "created", words="word_count"), "tag_years": C.tag_year_heatmap(scoped, config.min_tag_count), "tags": C.tag_rows(scoped, config.combination_size, config.min_tag_count), "tags_by_year": C.tag_rows(scoped, config.combination_size, config.min_tag_count, True),
        "temporal": H.temporal(entries, strict=config.strict_parity), "volume": H.volume(entries), "revision": H.revision(entries), "weekday_stability": H.weekday_stability(entries), "cadence_depth": H.cadence_depth_correlation(entries), "revision_length": H.revision_length_correlation(entries), "predominant_mode": H.predominant_mode(years),
        "year_profiles": years, "text_years": profiles if profiles is not None else B.year_profiles(texts), "headlines": RD.headlines(years, pairs, shifts, **more), "readings": RD.structural_readings(years, pairs, shifts, **(more | {"phrases": phrases, "tags": tag_texts} if more else {})), "regime_shifts": shifts, "longest_streak": H.longest_streak(entries), "silence_gaps": H.silence_gaps(entries), **G.all_tag_structures(scoped, config.min_tag_count), "persistence_leaders": G.persistence_leaders(qualified),
        "lexical": B.lexical_by_year(texts), "novelty": B.novelty(texts), "month_climate": B.month_climate(texts), "openings": B.opening_signatures(texts), "opening_shift": openings, "phrases": phrases, "tag_texts": tag_texts,
        "records": B.record_sections(B.records(notes, texts)), "revision_examples": B.revision_examples(notes), "phrase_examples": EX.phrase_examples(every, scoped=texts), "deep_years": by_deep_year, "deep_leaders": N.deep_leaders(by_deep_year), "entities": N.candidates(found), "entity_pairs": N.pairs(found), "shift_examples": EX.shift_examples(notes, shifts), "pair_examples": EX.pair_examples(entries, pairs), "bridge_examples": EX.bridge_examples(entries, G.bridge_tags(qualified)),
    }
