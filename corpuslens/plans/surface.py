"""The operators in SQL: every table as a temporary view, and those with parameters as table functions.

register() takes the tables of an analysis (see plans.analysis.analyze) or any others; nothing is computed until a query
asks. The functions are SQL table functions over these views, planned together with the query that calls them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: parameters, the view it reads, and its body over that view ({v}).
FUNCTIONS = {
    "entries_between": ("first INT, last INT", "entries", "SELECT * FROM {v} WHERE year BETWEEN first AND last"),
    "entries_tagged": ("wanted STRING", "entries", "SELECT * FROM {v} WHERE array_contains(tags, wanted)"),
    "hours_between": ("first INT, last INT", "entries", "SELECT hour(created) AS hour, count(*) AS entries, avg(word_count) AS mean_words FROM {v} WHERE year BETWEEN first AND last GROUP BY hour(created)"),
    "totals_between": ("first INT, last INT", "entries", "SELECT count(*) AS entries, sum(word_count) AS words, avg(word_count) AS mean_words, median(word_count) AS median_words FROM {v} WHERE year BETWEEN first AND last"),
    "tags_of_at_least": ("least BIGINT", "tags", "SELECT * FROM {v} WHERE entries >= least"),
    "strongest_pairs": ("most INT", "pair_lift", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY lift DESC, support DESC, collate(`left`, 'UNICODE'), collate(`right`, 'UNICODE')) AS rank FROM {v}) WHERE rank <= most"),
    "profile_of": ("wanted INT", "year_profiles", "SELECT * FROM {v} WHERE year = wanted"),
    "records_of": ("wanted STRING, most INT", "records", "SELECT * FROM {v} WHERE section = wanted AND rank <= most"),
    "phrases_between": ("first INT, last INT", "phrases", "SELECT * FROM {v} WHERE first_year >= first AND last_year <= last"),
    "recommended_for": ("source STRING, most INT", "recommendations", "SELECT * FROM {v} WHERE src = source AND rank <= most"),
}


def register(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """A temporary view for each table and a table function for each that a table feeds; the names of both."""
    names = []
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    for name, (parameters, source, body) in FUNCTIONS.items():
        if source not in tables:
            continue
        text = body.format(v=f"{prefix}{source}")
        # The columns are those of the body with nulls for its parameters.
        typed = [p.split(" ", 1) for p in parameters.split(", ")]
        shape = spark.sql(f"SELECT * FROM (SELECT {', '.join(f'CAST(NULL AS {kind}) AS {p}' for p, kind in typed)}) AS p, LATERAL ({text}) AS b").schema.fields[len(typed) :]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE ({columns}) RETURN {text}")
        names.append(f"{prefix}{name}")
    return names


def register_queries(spark: SparkSession, sf_dir: str, prefix: str = "q_") -> list[str]:
    """A temporary view for each registered analytics query over a folder of tables."""
    from corpuslens.plans.queries import QUERIES

    return register(spark, {name: query(spark, sf_dir) for name, query in QUERIES.items()}, prefix)
