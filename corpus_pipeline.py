"""The training-data pipeline: toxicity, language, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm import langid, neardup, packing, suffix, toxicity
from corpuslens.llm.common import discard, free_name, materialize, table

#: A text whose likeliest language has a smaller share than this is in no known language.
LEAST_SHARE = 0.3


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. Null and empty texts score 0 and stay; repeated rows share their fate."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.score(docs, model, into=score).where(F.col(score) < 0.5).select(*docs.columns)


def unknown_language_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus is labelled with. Null, empty and letterless texts go; ties of two languages go by name."""
    lang, share = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = langid.predict(docs, langid.fit(docs), into=(lang, share))
    return found.where((F.col(lang) != "und") & (F.col(share) >= LEAST_SHARE)).select(*docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8): the one of the smallest id.

    A repeated id is one document: of its rows the one whose text has the smallest hash stays. Rows without an id
    and texts without a word stay.
    """
    linked = neardup.link(docs, 5, 80)
    kept = linked.where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    own = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns)
    turn = free_name(docs, "turn")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.coalesce("text", F.lit(""))))
    one = own.withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).drop(turn)
    return one.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that also stand elsewhere; those left empty go.

    Texts that were null or empty before stay, as empty texts. n_chars becomes the length of what is left.
    """
    done = suffix.strip_repeats(docs, 200, keep_text=True, carry=[c for c in docs.columns if c not in ("text", "n_chars")])
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    kept = done.where("n_removed < n_bytes or n_bytes = 0")
    return kept.select(*((new[c] if c in new else F.col("carried").getField(c)).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of 1024 tokens. Null texts count as empty (one end token)."""
    return packing.pack(docs, added=packing.added_tokens())


STAGES = [("toxicity", toxic_out), ("language ID", unknown_language_out), ("MinHash near-dedup", near_duplicates_out), ("suffix-array dedup", repeats_out), ("best-fit packing", packed)]
#: Models, sketches and tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; what is no longer read is deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir))
        discard(docs)
        docs = after
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # the pieces have been written
    return out
