"""The registered queries of the analytics operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import bodytext as B
from corpuslens.operators import corpus as C
from corpuslens.operators import entities as M
from corpuslens.operators import examples as EX
from corpuslens.operators import grain as GR
from corpuslens.operators import links as L
from corpuslens.operators import readings as RD
from corpuslens.operators import recommend as R
from corpuslens.operators import rhythm as H
from corpuslens.operators import tagstructure as G
from corpuslens.plans import fixtures as X
from corpuslens.sources import flat as FL
from corpuslens.streaming import activity as S

E = """WITH li AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS w, max(l_shipdate) AS u FROM lineitem GROUP BY 1),
e AS (SELECT 'order/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.md' AS path, o_orderdate AS created, u AS updated, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
  CAST(dayofweek(o_orderdate) AS INT) AS weekday, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS epoch_day, coalesce(w, 0) AS word_count, coalesce(w, 0) / 230.0 AS reading_minutes,
  CASE WHEN u >= o_orderdate THEN (epoch_ms(u) - epoch_ms(o_orderdate)) / 86400000.0 END AS lag_days, list_sort([lower(o_orderpriority), lower(c_mktsegment), lower(o_orderstatus)]) AS tags
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey),
et AS (SELECT * EXCLUDE (tags), unnest(tags) AS tag FROM e)"""
D = r"""WITH n AS (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' AS path, TIMESTAMP '2018-01-01 00:00:00' + to_minutes((doc_id * 102947) % 3155760) AS created,
  CASE WHEN doc_id % 3 = 0 THEN to_hours((doc_id * 31) % 2000) ELSE to_hours(0) END AS later, text, [lang, source] AS tags, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’_-][\p{L}\p{N}]+)*'), lambda x: lower(x)) AS tokens,
  list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(replace(regexp_replace(text, '[!?]+', '.', 'g'), '…', '.'), '\n{2,}', '.' || chr(10), 'g'), '', '', 'g'), '[.\n]+'), lambda x: len(regexp_extract_all(x, '[\p{L}\p{N}]+(?:[''’_-][\p{L}\p{N}]+)*'))), lambda k: k > 0) AS sentences FROM documents),
t AS (SELECT *, CAST(year(created) AS INT) AS year, CAST(month(created) AS INT) AS month, CAST(datediff('day', DATE '1970-01-01', CAST(created AS DATE)) AS INT) AS epoch_day, len(tokens) AS token_count, list_distinct(tokens) AS vocabulary, created + later AS updated FROM n)"""
OPEN = r""", o AS (SELECT *, trim(left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 200)) AS line FROM t),
o2 AS (SELECT *, list_transform(regexp_extract_all(line, '[\p{L}\p{N}]+(?:[''’_-][\p{L}\p{N}]+)*'), lambda x: lower(x)) AS lt FROM o),
o3 AS (SELECT year, CASE WHEN line IS NULL OR len(lt) = 0 THEN NULL
  WHEN regexp_matches(line, '^\d{1,2}[:.]\d{2}\b') OR regexp_matches(line, '^\d{4}-\d{2}-\d{2}\b') OR list_has_any(lt[1:3], TEMPORAL) THEN 'temporal'
  WHEN contains(line, '!') OR regexp_matches(line, '^[.?!]{2,}') OR list_has_any(lt[1:2], EMOTIONAL) THEN 'emotional'
  WHEN len(lt) >= 3 AND list_has_any(lt[1:2], SCENE) THEN 'scene-setting'
  WHEN len(lt) <= 4 AND NOT regexp_matches(line, '[.!?…]$') THEN 'fragmentary'
  WHEN contains(line, ',') OR len(lt) >= 14 THEN 'descriptive'
  WHEN regexp_matches(line, '[.!?…]$') OR len(lt) >= 6 THEN 'declarative' WHEN len(lt) <= 5 THEN 'fragmentary' ELSE 'other' END AS opening FROM o2)"""
for _name in ("TEMPORAL", "EMOTIONAL", "SCENE"):
    from corpuslens.functions import text as _text

    OPEN = OPEN.replace(_name, "[" + ", ".join(f"'{w}'" for w in getattr(_text, _name)) + "]")
PHRASES = """, g AS (SELECT path, created, year, epoch_day, tokens, k, i FROM t, (VALUES (4), (3)) AS s(k), LATERAL (SELECT unnest(generate_series(1, token_count - k + 1)) AS i) WHERE token_count >= k),
u AS (SELECT path, created, year, epoch_day, array_to_string(tokens[i:i + k - 1], ' ') AS phrase, (4 - k) * 10000000 + i AS place FROM g
  WHERE len(list_filter(tokens[i:i + k - 1], lambda x: length(x) >= 5)) > 0 AND len(list_filter(tokens[i:i + k - 1], lambda x: NOT regexp_full_match(x, '[0-9]+'))) > 0 AND list_sum(list_transform(tokens[i:i + k - 1], lambda x: length(x))) >= 3 * k),
f AS (SELECT path, any_value(created) AS created, any_value(year) AS year, any_value(epoch_day) AS epoch_day, phrase, min(place) AS place FROM u GROUP BY path, phrase),
p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY place) <= 60),
r AS (SELECT phrase, count(*) AS entries, min(year) AS first_year, max(year) AS last_year, CASE WHEN count(DISTINCT epoch_day) >= 2 THEN (max(epoch_day) - min(epoch_day)) / (count(DISTINCT epoch_day) - 1) END AS mean_gap FROM p GROUP BY phrase HAVING count(*) >= 2),
rs AS (SELECT *, entries * log2(2 + (last_year - first_year)) * log2(2 + coalesce(mean_gap, 0)) AS score FROM r)"""


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: engines add in different orders."""
    return df.select(*[F.round(F.col(f"`{n}`"), 6).alias(n) if k == "double" else F.col(f"`{n}`") for n, k in df.dtypes])


def q_entries(f):
    return lambda spark, sf: rounded(f(X.entries(spark, sf)))


def q_texts(f):
    return lambda spark, sf: rounded(f(B.texts(X.notes(spark, sf))))


def terms(rows: DataFrame) -> DataFrame:
    return rows.select("year", F.explode("tokens").alias("term")).where(F.length("term") >= 3).groupBy("year", "term").agg(F.count("*").alias("n"))


QUERIES, SQL = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _label(ts: str) -> str:
    """SQL of local_label()."""
    ts = f"CAST({ts} AS TIMESTAMP)"
    return f"CASE WHEN hour({ts}) = 0 AND minute({ts}) = 0 THEN strftime({ts}, '%Y-%m-%d') ELSE strftime({ts}, '%Y-%m-%dT%H:%M') END"


def R6(x, name):
    return f"round(CAST({x} AS DOUBLE), 6) AS {name}"


add("corpus_totals", q_entries(C.totals), f"{E} SELECT year, count(*) AS entries, CAST(sum(word_count) AS BIGINT) AS words, {R6('avg(word_count)', 'mean_words')}, {R6('median(word_count)', 'median_words')}, {R6('sum(reading_minutes)', 'reading_minutes')} FROM e GROUP BY ROLLUP (year)")
add("month_heatmap", q_entries(C.month_heatmap), f"{E}, y AS (SELECT DISTINCT year FROM e), c AS (SELECT year, month, count(*) AS n, sum(word_count) AS w FROM e GROUP BY ALL) SELECT y.year, CAST(m AS INT) AS month, coalesce(n, 0) AS entries, CAST(coalesce(w, 0) AS BIGINT) AS words, {R6('coalesce(w / n, 0)', 'mean_words')} FROM y CROSS JOIN generate_series(1, 12) AS s(m) LEFT JOIN c ON c.year = y.year AND c.month = m")
add("weekday_heatmap", q_entries(C.weekday_heatmap), f"{E}, d AS (SELECT y, CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT year AS y FROM e)), g AS (SELECT y, (dayofweek(day) + 6) % 7 AS wd, count(*) AS o FROM d GROUP BY ALL), c AS (SELECT year, (weekday + 6) % 7 AS wd, count(*) AS n FROM e GROUP BY ALL) SELECT y AS year, CAST(g.wd AS INT) AS weekday, coalesce(n, 0) AS entries, o AS occurrences, {R6('coalesce(n, 0) / o', 'per_day')} FROM g LEFT JOIN c ON c.year = y AND c.wd = g.wd")
_HIST = """{prefix}, v AS ({values}), st AS (SELECT count(*) AS n, max(v) AS most FROM v HAVING count(*) > 0), r AS (SELECT *, greatest(1.0, (most + 1) / least(greatest(floor(sqrt(n) + 0.5), 6), 14)) AS rough FROM st), pw AS (SELECT *, power(10.0, floor(log10(rough))) AS p FROM r),
s AS (SELECT *, CASE WHEN rough / p <= 1 THEN 1 WHEN rough / p <= 2 THEN 2 WHEN rough / p <= 5 THEN 5 ELSE 10 END * p AS step FROM pw), b AS (SELECT step, CAST(ceil((most + 1) / step) AS INT) AS bins FROM s),
c AS (SELECT CAST(least(floor(v / step), bins - 1) AS INT) AS bin, count(*) AS n FROM v, b GROUP BY 1), g AS (SELECT step, CAST(unnest(generate_series(0, bins - 1)) AS INT) AS bin FROM b)
SELECT g.bin, round(g.bin * step, 6) AS low, round((g.bin + 1) * step, 6) AS high, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.bin = g.bin"""
add("word_histogram", q_entries(lambda e: C.histogram(e, "word_count")), _HIST.format(prefix=E, values="SELECT word_count AS v FROM e"))
add("lag_histogram", q_entries(lambda e: C.histogram(e.where("lag_days > 0"), "lag_days")), _HIST.format(prefix=E, values="SELECT lag_days AS v FROM e WHERE lag_days > 0"))
add("month_length_profile", q_entries(C.month_profile), f"{E} SELECT CAST(m AS INT) AS month, count(path) AS entries, {R6('coalesce(avg(word_count), 0)', 'mean_words')}, {R6('coalesce(median(word_count), 0)', 'median_words')} FROM generate_series(1, 12) AS s(m) LEFT JOIN e ON month = m GROUP BY m")
add("hour_activity", lambda spark, sf: C.hourly_activity(X.table(spark, sf, "events"), "ts"), "SELECT CAST(h AS INT) AS hour, count(event_id) AS entries FROM generate_series(0, 23) AS s(h) LEFT JOIN events ON hour(ts) = h GROUP BY h")
_MONTHS = f"{E}, m AS (SELECT month, count(*) AS entries, avg(word_count) AS a, median(word_count) AS d FROM e GROUP BY month)"
add("month_extremes", q_entries(lambda e: C.extremes(C.month_profile(e), "month", "mean_words")), f"{_MONTHS} SELECT month, entries, {R6('a', 'mean_words')}, {R6('d', 'median_words')}, which FROM (SELECT * FROM (SELECT *, 'highest' AS which FROM m ORDER BY a DESC, month LIMIT 1) UNION ALL SELECT * FROM (SELECT *, 'lowest' AS which FROM m ORDER BY a, month LIMIT 1))")
add("hour_extremes", lambda spark, sf: C.extremes(C.hourly_activity(X.table(spark, sf, "events"), "ts"), "hour", "entries"), "WITH h AS (SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS entries FROM events WHERE ts IS NOT NULL GROUP BY 1) SELECT * FROM (SELECT *, 'highest' AS which FROM h ORDER BY entries DESC, hour LIMIT 1) UNION ALL SELECT * FROM (SELECT *, 'lowest' AS which FROM h ORDER BY entries, hour LIMIT 1)")
add("tag_summary", q_entries(C.tag_summary), f"{E} SELECT count(*) AS entries, count(*) FILTER (len(tags) > 0) AS tagged, {R6('avg(len(tags))', 'mean_tags')}, {R6('median(len(tags))', 'median_tags')} FROM e")
add("tag_coverage", q_entries(C.tag_coverage), f"{E} SELECT year, count(*) AS entries, count(*) FILTER (len(tags) > 0) AS tagged, {R6('avg(CAST(len(tags) > 0 AS INT))', 'share')}, {R6('avg(len(tags))', 'mean_tags')}, {R6('median(len(tags))', 'median_tags')} FROM e GROUP BY year")
add("tag_year_heatmap", q_entries(C.tag_year_heatmap), f"{E}, b AS (SELECT tag, count(*) AS total FROM et GROUP BY tag ORDER BY total DESC, tag LIMIT 10), c AS (SELECT year, tag, count(*) AS n FROM et GROUP BY ALL) SELECT b.tag, y.year, total, coalesce(n, 0) AS entries FROM b CROSS JOIN (SELECT DISTINCT year FROM e) AS y LEFT JOIN c ON c.tag = b.tag AND c.year = y.year")


def _tag_rows_sql(labels: str, key: str, month: str) -> str:
    k, on = (f"{key}, ", "USING (year, label)") if key else ("", "USING (label)")
    base = f"b AS (SELECT {k}avg(word_count) AS bm, median(word_count) AS bd FROM e {'GROUP BY year' if key else ''})"
    return f"""{E}, l AS ({labels}), {base},
m AS (SELECT {k}label, count(*) AS entries, avg(word_count) AS mw, median(word_count) AS md FROM l GROUP BY {k}label),
d AS (SELECT {k}label, (weekday + 6) % 7 AS day, count(*) AS n, row_number() OVER (PARTITION BY {k}label ORDER BY count(*) DESC, (weekday + 6) % 7) AS turn FROM l GROUP BY {k}label, weekday),
t AS (SELECT {k}label, max(day) FILTER (turn = 1) AS w1, max(n) FILTER (turn = 1) AS n1, max(day) FILTER (turn = 2) AS w2, max(n) FILTER (turn = 2) AS n2 FROM d GROUP BY {k}label),
o AS (SELECT {k}label, {month} AS mo, count(*) AS n, min(path) AS seen FROM l GROUP BY {k}label, mo QUALIFY row_number() OVER (PARTITION BY {k}label ORDER BY n DESC, seen) = 1)
SELECT {k}label, entries, {R6('mw', 'mean_words')}, {R6('md', 'median_words')}, {R6('mw - bm', 'mean_delta')}, {R6('md - bd', 'median_delta')}, CAST(w1 AS INT) AS weekday, CAST(w2 AS INT) AS second_weekday, {R6('n1 / entries', 'weekday_share')}, {R6('n2 / entries', 'second_share')}, mo AS month, {R6('o.n / entries', 'month_share')}
FROM m JOIN t {on} JOIN o {on} {'JOIN b USING (year)' if key else 'CROSS JOIN b'}"""


_ONE = "SELECT year, path, word_count, weekday, created, tag AS label FROM et"
_TWO = _ONE + " UNION ALL SELECT a.year, a.path, a.word_count, a.weekday, a.created, a.tag || ' + ' || b.tag FROM et a JOIN et b ON a.path = b.path AND a.tag < b.tag"
add("tag_rows", q_entries(lambda e: C.tag_rows(e)), _tag_rows_sql(_ONE, "", "strftime(created, '%Y-%m')"))
add("tag_combinations", q_entries(lambda e: C.tag_rows(e, 2)), _tag_rows_sql(_TWO, "", "strftime(created, '%Y-%m')"))
add("tag_rows_by_year", q_entries(lambda e: C.tag_rows(e, 1, 1, True)), _tag_rows_sql(_ONE, "year", "strftime(created, '%B')"))

TEMPORAL = """{E}, da AS (SELECT {k}epoch_day, count(*) AS n FROM e GROUP BY ALL), gp AS (SELECT {k}epoch_day, greatest(1, epoch_day - lag(epoch_day) OVER ({w} ORDER BY epoch_day)) AS gap, lag(epoch_day) OVER ({w} ORDER BY epoch_day) AS b FROM da), ga AS (SELECT * FROM gp WHERE b IS NOT NULL),
pl AS (SELECT *, row_number() OVER ({w} ORDER BY epoch_day) - 1 AS place, count(*) OVER ({w}) AS n FROM ga),
st AS (SELECT {k}CASE WHEN count(*) >= 2 AND stddev_pop(gap) + avg(gap) > 0 THEN (stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)) ELSE 0 END AS bu, max(gap) - 1 AS lg, avg(CAST(gap - 1 >= 30 AS INT)) AS ls,
  max(gap - 1) FILTER (place = floor((n - 1) * 0.9)) AS lo, max(gap - 1) FILTER (place = ceil((n - 1) * 0.9)) AS hi, max((n - 1) * 0.9) - floor(max((n - 1) * 0.9)) AS fr FROM pl {g}),
isl AS (SELECT {k}epoch_day - row_number() OVER ({w} ORDER BY epoch_day) AS i FROM da), rn AS (SELECT {k}i, count(*) AS days FROM isl GROUP BY ALL), fg AS (SELECT {k}CASE WHEN sum(days) >= 2 THEN avg(CAST(days <= 2 AS INT)) ELSE 0 END AS fr2 FROM rn {g}),
sc AS (SELECT {k}CAST(floor((month % 12) / 3) AS INT) AS s, count(*) AS n, sum(word_count) AS w, sum(CAST(coalesce(lag_days > 0, false) AS INT)) AS r FROM e GROUP BY ALL), tt AS (SELECT {k}sum(n) AS tn, sum(w) AS tw, sum(r) AS tr FROM sc {g}),
sh AS (SELECT {tk}q.s, (CASE WHEN tn > 0 THEN coalesce(n, 0) / tn ELSE 0 END + CASE WHEN tw > 0 THEN coalesce(w, 0) / tw ELSE 0 END + CASE WHEN tr > 0 THEN coalesce(r, 0) / tr ELSE 0 END) / greatest(1, CAST(tn > 0 AS INT) + CAST(tw > 0 AS INT) + CAST(tr > 0 AS INT)) AS score FROM tt CROSS JOIN generate_series(0, 3) AS q(s) LEFT JOIN sc ON sc.s = q.s {on}),
sa AS (SELECT {k}max(score) - min(score) AS asym, ['Winter', 'Spring', 'Summer', 'Autumn'][first(s ORDER BY score DESC, s) + 1] AS ds FROM sh {g})"""


def _temporal_sql(year: bool) -> str:
    prefix = TEMPORAL.format(E=E, k="year, " if year else "", w="PARTITION BY year" if year else "", g="GROUP BY year" if year else "", tk="tt.year, " if year else "", on="AND sc.year = tt.year" if year else "")
    joined = "sa LEFT JOIN fg USING (year) LEFT JOIN st USING (year)" if year else "sa CROSS JOIN fg CROSS JOIN st"
    return f"{prefix} SELECT {'year, ' if year else ''}{R6('coalesce(bu, 0)', 'burstiness')}, {R6('coalesce(lg, 0)', 'longest_gap')}, {R6('coalesce(lo + (hi - lo) * fr, 0)', 'p90_gap')}, {R6('coalesce(ls, 0)', 'long_silences')}, {R6('coalesce(fr2, 0)', 'fragility')}, {R6('asym', 'season_asymmetry')}, ds AS dominant_season FROM {joined}"


add("temporal_by_year", q_entries(lambda e: H.temporal(e, "year")), _temporal_sql(True))
add("temporal_overall", q_entries(H.temporal), _temporal_sql(False))
_VOLUME = f"""{E}, s AS (SELECT year, avg(word_count) AS a, median(word_count) AS m, stddev_pop(word_count) AS sd, quantile_cont(word_count, 0.9) AS p FROM e GROUP BY year),
x AS (SELECT year, count(*) FILTER (word_count <= 0.5 * m) AS sh, count(*) FILTER (word_count >= 1.5 * m) AS lo FROM e JOIN s USING (year) GROUP BY year),
h AS (SELECT year, sum(w) AS tw, sum(CAST(w AS DOUBLE) * w) AS sq FROM (SELECT year, month, sum(word_count) AS w FROM e GROUP BY ALL) GROUP BY year)
SELECT year, {R6('CASE WHEN sd > 0 THEN 3 * (a - m) / sd ELSE 0 END', 'skew')}, {R6('CASE WHEN m > 0 THEN p / m ELSE 0 END', 'tail_ratio')}, {R6('(sh + 1) / (lo + 1)', 'short_long')},
  {R6('CASE WHEN tw > 0 THEN sq / (CAST(tw AS DOUBLE) * tw) ELSE 0 END', 'concentration')} FROM s JOIN x USING (year) JOIN h USING (year)"""
add("volume_by_year", q_entries(lambda e: H.volume(e, "year")), _VOLUME)
add("revision_by_year", q_entries(lambda e: H.revision(e, "year")), f"{E}, m AS (SELECT year, count(lag_days) AS usable, count(*) FILTER (lag_days > 0) AS revisited, median(lag_days) FILTER (lag_days > 0) AS ml, quantile_cont(lag_days, 0.9) FILTER (lag_days > 0) AS p, max(lag_days) FILTER (lag_days > 0) AS mx, sum(word_count * ln(1 + lag_days)) FILTER (lag_days > 0) AS i, sum(word_count) AS w FROM e GROUP BY year), c AS (SELECT year, lag_days, sum(greatest(1, word_count)) AS wt FROM e WHERE lag_days > 0 GROUP BY ALL), h AS (SELECT year, min(lag_days) AS hl FROM (SELECT *, sum(wt) OVER (PARTITION BY year ORDER BY lag_days) AS run, sum(wt) OVER (PARTITION BY year) AS tot FROM c) WHERE run >= tot / 2 GROUP BY year) SELECT year, usable, revisited, {R6('CASE WHEN usable > 0 THEN revisited / usable ELSE 0 END', 'revisit_ratio')}, {R6('coalesce(ml, 0)', 'median_lag')}, {R6('coalesce(p, 0)', 'p90_lag')}, {R6('coalesce(mx, 0)', 'max_lag')}, {R6('coalesce(hl, 0)', 'half_life')}, {R6('coalesce(i, 0)', 'intensity')}, {R6('CASE WHEN w > 0 THEN coalesce(i, 0) / w ELSE 0 END', 'intensity_per_word')} FROM m LEFT JOIN h USING (year)")
add("weekday_stability", q_entries(H.weekday_stability), f"{E}, y AS (SELECT year, count(*) AS yn FROM e GROUP BY 1), d AS (SELECT weekday, count(*) AS dn FROM e GROUP BY 1), c AS (SELECT year, weekday, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT y.year, yn, coalesce(n, 0) / yn AS p, dn / (SELECT count(*) FROM e) AS q FROM y CROSS JOIN d LEFT JOIN c ON c.year = y.year AND c.weekday = d.weekday), j AS (SELECT year, yn, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS ds FROM g GROUP BY ALL) SELECT {R6('1 - sum(yn * ds) / sum(yn)', 'stability')} FROM j")
add("tag_distribution", q_entries(G.tag_distribution), f"{E}, c AS (SELECT year, tag, count(*) AS n FROM et GROUP BY ALL UNION ALL SELECT NULL, tag, count(*) FROM et GROUP BY tag), s AS (SELECT year, n / sum(n) OVER (PARTITION BY year) AS p FROM c) SELECT year, count(*) AS tags, {R6('-sum(p * log2(p))', 'entropy')}, {R6('sum(p * p)', 'concentration')} FROM s GROUP BY year")
_PAIRS = ", pc AS (SELECT a.tag AS l, b.tag AS r, count(*) AS support FROM et a JOIN et b ON a.path = b.path AND a.tag < b.tag GROUP BY ALL), tc AS (SELECT tag, count(*) AS n FROM et GROUP BY 1), nn AS (SELECT count(*) AS q FROM e)"
add("tag_pair_lift", q_entries(lambda e: G.pair_lift(G.qualified(e))), f"{E}{_PAIRS} SELECT l AS \"left\", r AS \"right\", support, {R6('(support / q) / ((a.n / q) * (b.n / q))', 'lift')} FROM pc JOIN tc a ON a.tag = l JOIN tc b ON b.tag = r CROSS JOIN nn WHERE support >= 2 ORDER BY (support / q) / ((a.n / q) * (b.n / q)) DESC, support DESC, l, r LIMIT 10")
add("bridge_tags", q_entries(lambda e: G.bridge_tags(G.qualified(e))), f"{E}{_PAIRS}, ed AS (SELECT l AS t, r AS o FROM pc UNION ALL SELECT r, l FROM pc), dg AS (SELECT t, count(*) AS d FROM ed GROUP BY 1), cl AS (SELECT x.t, count(*) AS c FROM ed x JOIN ed y ON x.t = y.t AND x.o < y.o JOIN pc ON l = x.o AND r = y.o GROUP BY 1), f AS (SELECT tag, n, coalesce(d, 0) AS degree, CASE WHEN coalesce(d, 0) >= 2 THEN coalesce(c, 0) / (d * (d - 1) / 2) ELSE 0 END AS cc FROM tc LEFT JOIN dg ON dg.t = tag LEFT JOIN cl ON cl.t = tag) SELECT tag, n, degree, {R6('cc', 'clustering')}, {R6('degree * (1 - cc) * ln(1 + n)', 'score')} FROM f ORDER BY degree * (1 - cc) * ln(1 + n) DESC, degree DESC, tag LIMIT 10")
_PAIR_NOTES = f"""{E} SELECT b."left", b."right", CAST(row_number() OVER (PARTITION BY b."left", b."right" ORDER BY epoch_day, path) AS INT) AS rank, path
FROM ({SQL['tag_pair_lift']}) b JOIN e ON list_contains(tags, b."left") AND list_contains(tags, b."right") QUALIFY rank <= 3"""
_BRIDGE_NOTES = f"""{E} SELECT b.tag, CAST(row_number() OVER (PARTITION BY b.tag ORDER BY epoch_day, path) AS INT) AS rank, path FROM ({SQL['bridge_tags']}) b JOIN e ON list_contains(tags, b.tag) QUALIFY rank <= 3"""
add("pair_examples", q_entries(lambda e: EX.pair_examples(e, G.pair_lift(G.qualified(e)))), _PAIR_NOTES)
add("bridge_examples", q_entries(lambda e: EX.bridge_examples(e, G.bridge_tags(G.qualified(e)))), _BRIDGE_NOTES)
#: A threshold that some tags do not reach.
LEAST_TAG = 500


def at_least(sql: str) -> str:
    """The same query over the entries that keep a tag which is frequent enough, with those tags only."""
    every = E.replace("e AS (", "e0 AS (", 1).replace("et AS (", "et0 AS (", 1).replace("FROM e)", "FROM e0)")
    return sql.replace(E, f"""{every}, kt AS (SELECT tag FROM et0 GROUP BY tag HAVING count(*) >= {LEAST_TAG}), kf AS (SELECT path, list_sort(list(tag)) AS tags FROM et0 SEMI JOIN kt USING (tag) GROUP BY path),
e AS (SELECT e0.* EXCLUDE (tags), kf.tags FROM e0 JOIN kf USING (path)), et AS (SELECT * EXCLUDE (tags), unnest(tags) AS tag FROM e)""")


for _name, _query in {"tag_pair_lift": G.pair_lift, "bridge_tags": G.bridge_tags, "tag_distribution": G.tag_distribution}.items():
    add(f"{_name}_of_frequent", q_entries(lambda e, f=_query: f(G.qualified(e, LEAST_TAG))), at_least(SQL[_name]))
add("weekday_bias", q_entries(G.weekday_bias), f"{E}, d AS (SELECT weekday, count(*) AS dn FROM e GROUP BY 1), tc AS (SELECT tag, count(*) AS n FROM et GROUP BY 1), s AS (SELECT tag, weekday, count(*) AS support FROM et GROUP BY ALL HAVING count(*) >= 2), x AS (SELECT tag, CAST((weekday + 6) % 7 AS INT) AS weekday, support, (support / n) / (dn / (SELECT count(*) FROM e)) AS b FROM s JOIN tc USING (tag) JOIN d USING (weekday)) SELECT tag, weekday, support, {R6('b', 'bias')} FROM x ORDER BY b DESC, support DESC, tag, weekday LIMIT 10")
add("fastest_tag", q_entries(G.fastest_tag), f"{E}, x AS (SELECT tag, count(DISTINCT epoch_day) AS days, (max(epoch_day) - min(epoch_day)) / (count(DISTINCT epoch_day) - 1) AS g FROM et GROUP BY tag HAVING count(DISTINCT epoch_day) >= 2) SELECT tag, days, {R6('g', 'mean_gap')} FROM x ORDER BY g, days DESC, tag LIMIT 1")
add("tag_persistence", q_entries(G.persistence), f"{E}, y AS (SELECT DISTINCT tag, year FROM et), i AS (SELECT tag, year - row_number() OVER (PARTITION BY tag ORDER BY year) AS i FROM y), r AS (SELECT tag, i, count(*) AS run FROM i GROUP BY ALL) SELECT tag, CAST(sum(run) AS BIGINT) AS active_years, max(run) AS longest_run, {R6('max(run) / sum(run)', 'ratio')} FROM r GROUP BY tag")
add("tag_length_coupling", q_entries(G.length_coupling), f"{E}, x AS (SELECT tag, count(*) AS n, avg(word_count) - (SELECT avg(word_count) FROM e) AS d FROM et GROUP BY tag), u AS (SELECT *, 'longer' AS side FROM x WHERE d > 0 ORDER BY d DESC, tag LIMIT 10), v AS (SELECT *, 'shorter' AS side FROM x WHERE d < 0 ORDER BY d, tag LIMIT 10) SELECT tag, n, {R6('d', 'delta')}, side FROM (SELECT * FROM u UNION ALL SELECT * FROM v)")
add("longest_streak", q_entries(H.longest_streak), f"{E}, d AS (SELECT epoch_day, count(*) AS n FROM e GROUP BY 1), i AS (SELECT *, epoch_day - row_number() OVER (ORDER BY epoch_day) AS i FROM d) SELECT min(epoch_day) AS first_day, max(epoch_day) AS last_day, count(*) AS days, CAST(sum(n) AS BIGINT) AS entries FROM i GROUP BY i ORDER BY days DESC, entries DESC, first_day LIMIT 1")
add("silence_gaps", q_entries(H.silence_gaps), f"{E}, d AS (SELECT epoch_day, min(path) AS a, max(path) AS b, {_label('arg_min(created, path)')} AS ca, {_label('arg_max(created, path)')} AS cb FROM e GROUP BY 1), l AS (SELECT lag(b) OVER (ORDER BY epoch_day) AS from_path, a AS to_path, lag(epoch_day) OVER (ORDER BY epoch_day) AS from_day, epoch_day AS to_day, lag(cb) OVER (ORDER BY epoch_day) AS from_date, ca AS to_date FROM d) SELECT *, to_day - from_day - 1 AS gap_days FROM l WHERE to_day - from_day - 1 > 0 ORDER BY gap_days DESC, from_path, to_path LIMIT 25")
add("revision_length_correlation", q_entries(H.revision_length_correlation), f"{E} SELECT {R6('corr(lag_days, word_count)', 'correlation')}, count(*) AS pairs FROM e WHERE lag_days > 0")
add("cadence_depth_correlation", q_entries(H.cadence_depth_correlation), f"{E}, o AS (SELECT epoch_day - lag(epoch_day) OVER (ORDER BY epoch_day, word_count, path) AS g, reading_minutes * (1 + ln(1 + greatest(0, coalesce(lag_days, 0))) / 4) AS d FROM e) SELECT {R6('corr(g, d)', 'correlation')}, count(*) AS pairs FROM o WHERE g IS NOT NULL")
_TAGCHANGE = ", sy AS (SELECT year, tag, count(*) AS n FROM et GROUP BY ALL), sp AS (SELECT year, row_number() OVER (PARTITION BY year ORDER BY tag) AS k, n / sum(n) OVER (PARTITION BY year) AS p FROM sy), yy AS (SELECT year, lag(year) OVER (ORDER BY year) AS b FROM (SELECT DISTINCT year FROM e)), j AS (SELECT coalesce(a.year, c.year) AS year, coalesce(a.p, 0) AS p, coalesce(c.p, 0) AS q FROM (SELECT yy.year, k, p FROM yy JOIN sp ON sp.year = yy.year WHERE b IS NOT NULL) a FULL JOIN (SELECT yy.year, k, p FROM yy JOIN sp ON sp.year = b) c ON a.year = c.year AND a.k = c.k), tch AS (SELECT year, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS tag_change FROM j GROUP BY year)"
add("tag_regime_change", q_entries(H.tag_change), f"{E}{_TAGCHANGE} SELECT yy.year, b AS \"before\", {R6('coalesce(tag_change, 0)', 'tag_change')} FROM yy LEFT JOIN tch USING (year) WHERE b IS NOT NULL")


def exact(sql: str) -> str:
    """The same query without rounding, for use inside another."""
    return sql.replace("round(CAST(", "(CAST(").replace(" AS DOUBLE), 6) AS ", " AS DOUBLE)) AS ")


_SHIFT_PARTS = f"""pr AS (SELECT year, words, burstiness, revisit_ratio FROM (SELECT year, sum(word_count) AS words FROM ({E} SELECT * FROM e) GROUP BY year) JOIN ({exact(SQL['temporal_by_year'])}) USING (year) JOIN ({exact(SQL['revision_by_year'])}) USING (year)),
sh AS (SELECT c."before" AS from_year, c.year AS to_year, tag_change, least(1, abs(ln((a.words + 1) / (b.words + 1)))) AS volume_change, least(1, abs(a.revisit_ratio - b.revisit_ratio)) AS revision_change, least(1, abs(a.burstiness - b.burstiness) * 2) AS cadence_change
  FROM ({exact(SQL['tag_regime_change'])}) c JOIN pr a ON a.year = c.year JOIN pr b ON b.year = c."before")"""
_PLAIN = "tag_change * 0.45 + volume_change * 0.25 + revision_change * 0.15 + cadence_change * 0.15"
_PARTS6 = ", ".join(R6(c, c) for c in ("tag_change", "text_change", "volume_change", "revision_change", "cadence_change"))
add("regime_shifts", q_entries(H.regime_shifts), f"WITH {_SHIFT_PARTS} SELECT from_year, to_year, {_PARTS6}, {R6(_PLAIN, 'score')} FROM (SELECT *, 0 AS text_change FROM sh)")
_PROFILES = f"""WITH {_SHIFT_PARTS},
y AS (SELECT b.*, t.* EXCLUDE (year), v.* EXCLUDE (year), revisit_ratio, median_lag, half_life, intensity AS revision_weighted_words, intensity_per_word, d.entropy AS tag_entropy, d.concentration AS tag_concentration, s.score AS regime_shift
  FROM (SELECT year, count(*) AS entries, CAST(sum(word_count) AS BIGINT) AS words, avg(word_count) AS mean_words FROM ({E} SELECT * FROM e) GROUP BY year) b
  JOIN ({exact(SQL['temporal_by_year'])}) t USING (year) JOIN ({exact(SQL['volume_by_year'])}) v USING (year) JOIN ({exact(SQL['revision_by_year'])}) r USING (year)
  LEFT JOIN ({exact(SQL['tag_distribution'])}) d USING (year) LEFT JOIN (SELECT to_year AS year, {_PLAIN} AS score FROM sh) s USING (year)),
q AS (SELECT median(entries) AS mn, median(mean_words) AS mw, median(concentration) AS mc, median(intensity_per_word) AS mr FROM y),
md AS (SELECT y.*, CASE WHEN revisit_ratio >= 0.25 AND intensity_per_word >= greatest(0.05, mr * 1.2) THEN 'revision-heavy layering' WHEN burstiness >= 0.2 AND mean_words <= mw THEN 'bursty short-form'
  WHEN concentration >= mc * 1.15 AND mean_words >= mw THEN 'concentrated deep-writing' WHEN entries >= mn AND mean_words >= mw THEN 'steady prolific' WHEN entries < mn AND mean_words >= mw THEN 'sparse deep-writing' ELSE 'mixed cadence' END AS mode FROM y, q)"""
_NUMBERS = ("mean_words", "burstiness", "longest_gap", "p90_gap", "long_silences", "fragility", "season_asymmetry", "skew", "tail_ratio", "short_long", "concentration", "revisit_ratio", "median_lag", "half_life", "revision_weighted_words", "intensity_per_word", "tag_entropy", "tag_concentration", "regime_shift")
add("year_profiles", q_entries(H.year_profiles), f"{_PROFILES} SELECT year, entries, words, mode, dominant_season, {', '.join(R6(c, c) for c in _NUMBERS)} FROM md")
add("productivity_modes", q_entries(lambda e: H.year_profiles(e).select("year", "mode", "entries", "words")), f"{_PROFILES} SELECT year, mode, entries, words FROM md")
add("predominant_mode", q_entries(lambda e: H.predominant_mode(H.year_profiles(e))), f"{_PROFILES} SELECT mode, count(*) AS years FROM md GROUP BY mode ORDER BY years DESC, mode LIMIT 1")
add("structural_trend", q_entries(lambda e: H.year_profiles(e).select("year", "burstiness", "concentration", "tag_entropy", "regime_shift")), f"{_PROFILES} SELECT year, {', '.join(R6(c, c) for c in ('burstiness', 'concentration', 'tag_entropy', 'regime_shift'))} FROM md")
add("lexical_by_year", q_texts(B.lexical_by_year), f"{D}, m AS (SELECT year, sum(token_count) AS tk, sum(len(sentences)) AS sn, sum(list_sum(sentences)) AS sw, sum(list_sum(list_transform(sentences, lambda x: x * x))) AS sq FROM t GROUP BY year), v AS (SELECT year, count(DISTINCT w) AS vc FROM (SELECT year, unnest(vocabulary) AS w FROM t) GROUP BY year) SELECT year, CAST(tk AS BIGINT) AS tokens, coalesce(vc, 0) AS vocabulary, {R6('CASE WHEN tk >= 2 AND vc >= 2 THEN ln(vc) / ln(tk) END', 'richness')}, {R6('sw / sn', 'sentence_mean')}, {R6('sqrt(greatest(0, sq / sn - (sw / sn) * (sw / sn)))', 'sentence_variation')} FROM m LEFT JOIN v USING (year)")
add("vocabulary_novelty", q_texts(B.novelty), f"{D}, w AS (SELECT DISTINCT year, unnest(vocabulary) AS w FROM t), f AS (SELECT w, min(year) AS y0 FROM w GROUP BY 1) SELECT year, count(*) AS vocabulary, count(*) FILTER (y0 = year) AS fresh, {R6('count(*) FILTER (y0 = year) / count(*)', 'novelty')} FROM w JOIN f USING (w) GROUP BY year")
add("month_climate", q_texts(B.month_climate), f"{D}, m AS (SELECT month, sum(token_count) AS tk, sum(len(sentences)) AS sn, sum(list_sum(sentences)) AS sw, sum(list_sum(list_transform(sentences, lambda x: x * x))) AS sq FROM t GROUP BY month) SELECT CAST(x AS INT) AS month, CAST(tk AS BIGINT) AS tokens, {R6('sw / sn', 'sentence_mean')}, {R6('sqrt(greatest(0, sq / sn - (sw / sn) * (sw / sn)))', 'sentence_variation')} FROM generate_series(1, 12) AS s(x) LEFT JOIN m ON month = x")
add("opening_signatures", q_texts(B.opening_signatures), f"{D}{OPEN} SELECT opening, count(*) AS n, {R6('count(*) / sum(count(*)) OVER ()', 'share')} FROM o3 WHERE opening IS NOT NULL GROUP BY opening")
add("opening_shift", q_texts(B.opening_shift), f"{D}{OPEN}, y AS (SELECT year, count(opening) AS tot FROM o3 GROUP BY 1), c AS (SELECT year, opening, count(*) AS n FROM o3 GROUP BY ALL), g AS (SELECT y.year, s.o, CASE WHEN tot > 0 THEN coalesce(n, 0) / tot ELSE 0 END AS p FROM y CROSS JOIN (SELECT unnest(['temporal', 'emotional', 'scene-setting', 'fragmentary', 'descriptive', 'declarative', 'other']) AS o) AS s LEFT JOIN c ON c.year = y.year AND c.opening = s.o), d AS (SELECT year, lag(year) OVER (PARTITION BY o ORDER BY year) AS b, abs(p - lag(p) OVER (PARTITION BY o ORDER BY year)) AS d FROM g) SELECT b AS \"before\", year, {R6('sum(d) / 2', 'distance')} FROM d WHERE b IS NOT NULL GROUP BY ALL")
add("recurring_phrases", q_texts(B.recurring_phrases), f"{D}{PHRASES} SELECT phrase, entries, first_year, last_year, {R6('mean_gap', 'mean_gap')}, {R6('score', 'score')} FROM rs")
add("phrase_examples", q_texts(EX.phrase_examples), f"{D}{PHRASES}, b AS (SELECT phrase FROM rs ORDER BY score DESC, icu_sort_key(phrase, 'und'), phrase LIMIT 10) SELECT phrase, CAST(row_number() OVER (PARTITION BY phrase ORDER BY epoch_day, path) AS INT) AS rank, path FROM p JOIN b USING (phrase) QUALIFY rank <= 3")
add("tag_text_profiles", q_texts(B.tag_profiles), f"""{D}, x AS (SELECT unnest(list_distinct(tags)) AS tag, token_count AS k, CASE WHEN token_count >= 2 AND len(vocabulary) >= 2 THEN ln(len(vocabulary)) / ln(token_count) END AS r, len(sentences) AS sn, coalesce(list_sum(sentences), 0) AS sw,
  CASE WHEN len(sentences) > 0 THEN list_sum(sentences) / len(sentences) END AS s, nullif(CASE WHEN updated > created THEN floor((epoch_ms(updated) - epoch_ms(created)) / 86400000.0) END, 0) AS lag FROM t)
SELECT tag, count(*) AS entries, {R6('avg(k)', 'mean_words')}, {R6('median(k)', 'median_words')}, {R6('avg(r)', 'mean_richness')}, {R6('sum(sw) / sum(sn)', 'mean_sentence')}, {R6('median(s) FILTER (s > 0)', 'median_sentence')}, {R6('avg(lag)', 'mean_lag')}, {R6('median(lag)', 'median_lag')} FROM x GROUP BY tag""")
_TEXTS = f"""{D}{OPEN.replace("SELECT year, CASE", "SELECT path, year, CASE")}{PHRASES.replace(", g AS", ", g AS", 1)}, rp AS (SELECT DISTINCT path FROM p JOIN r USING (phrase)),
sy AS (SELECT year, count(*) AS entries, avg(CAST(rp.path IS NOT NULL AS INT)) AS recurring_share, sum(token_count) AS tk, sum(len(sentences)) AS sn, sum(list_sum(sentences)) AS sw, sum(list_sum(list_transform(sentences, lambda x: x * x))) AS sq FROM t LEFT JOIN rp ON rp.path = t.path GROUP BY year),
vw AS (SELECT DISTINCT year, unnest(vocabulary) AS w FROM t), vf AS (SELECT w, min(year) AS y0 FROM vw GROUP BY 1), vy AS (SELECT year, count(*) AS vc, count(*) FILTER (y0 = year) / count(*) AS novelty FROM vw JOIN vf USING (w) GROUP BY year),
oc AS (SELECT year, opening, count(*) AS n, sum(count(*)) OVER (PARTITION BY year) AS total FROM o3 WHERE opening IS NOT NULL GROUP BY year, opening), ob AS (SELECT year, opening, n / total AS opening_share FROM oc QUALIFY row_number() OVER (PARTITION BY year ORDER BY n DESC, opening) = 1),
ty AS (SELECT year, entries, CASE WHEN tk >= 2 AND vc >= 2 THEN ln(vc) / ln(tk) END AS richness, novelty, sw / sn AS sentence_mean, sqrt(greatest(0, sq / sn - (sw / sn) * (sw / sn))) AS sentence_variation, opening, opening_share, recurring_share FROM sy LEFT JOIN vy USING (year) LEFT JOIN ob USING (year))"""
_TEXT_NUMBERS = ("richness", "novelty", "sentence_mean", "sentence_variation", "opening_share", "recurring_share")
add("text_year_profiles", q_texts(B.year_profiles), f"{_TEXTS} SELECT year, entries, opening, {', '.join(R6(c, c) for c in _TEXT_NUMBERS)} FROM ty")
add("text_trend", q_texts(lambda r: B.year_profiles(r).select("year", "richness", "novelty", "sentence_mean", "recurring_share")), f"{_TEXTS} SELECT year, {', '.join(R6(c, c) for c in ('richness', 'novelty', 'sentence_mean', 'recurring_share'))} FROM ty")
add("period_signature", q_texts(lambda r: B.period_signature(terms(r), 2021, 2023, 2018, 2020)), f"{D}, w AS (SELECT year, unnest(tokens) AS term FROM t), c AS (SELECT term, count(*) FILTER (year BETWEEN 2021 AND 2023) AS s, count(*) FILTER (year BETWEEN 2018 AND 2020) AS o FROM w WHERE length(term) >= 3 GROUP BY term HAVING s + o > 0), z AS (SELECT count(*) AS v, sum(s) AS ns, sum(o) AS nc FROM c), q AS (SELECT term, s, o, (s + 0.5) / (ns + 0.5 * v) AS sr, (o + 0.5) / (nc + 0.5 * v) AS cr FROM c CROSS JOIN z) SELECT term, s AS selected, o AS compared, {R6('sr', 'selected_rate')}, {R6('cr', 'compared_rate')}, {R6('log2(sr / cr)', 'score')}, CASE WHEN o = 0 THEN 'emergent' WHEN s = 0 THEN 'fading' ELSE 'distinctive' END AS kind FROM q WHERE s + o >= 2")
add("revision_examples", lambda spark, sf: B.revision_examples(X.notes(spark, sf)), f"{D} SELECT path, CAST(token_count AS BIGINT) AS word_count, CAST(floor((epoch_ms(updated) - epoch_ms(created)) / 86400000) AS BIGINT) AS lag, {_label('t.created')} AS created, {_label('t.updated')} AS updated FROM t WHERE floor((epoch_ms(updated) - epoch_ms(created)) / 86400000) > 0 ORDER BY lag DESC, word_count DESC, path LIMIT 25")


def record_sections(spark, sf):
    """The ten record sections."""
    notes = X.notes(spark, sf)
    return rounded(B.record_sections(B.records(notes, B.texts(notes))))


_SECTIONS = {
    "longest-notes": ("CAST(token_count AS DOUBLE)", "DESC"), "shortest-notes": ("CASE WHEN token_count > 0 THEN CAST(token_count AS DOUBLE) END", "ASC"), "most-tags": ("CAST(len(tags) AS DOUBLE)", "DESC"),
    "longest-revision-lags": ("CASE WHEN updated > created THEN (epoch_ms(updated) - epoch_ms(created)) / 86400000.0 END", "DESC"), "highest-lexical-richness": ("CASE WHEN token_count >= 2 AND len(vocabulary) >= 2 THEN ln(len(vocabulary)) / ln(token_count) END", "DESC"),
    "fewest-tags": ("CAST(len(tags) AS DOUBLE)", "ASC"), "longest-average-sentences": ("CASE WHEN len(sentences) > 0 THEN list_sum(sentences) / len(sentences) END", "DESC"), "most-repetitive-phrases": ("CAST(hits AS DOUBLE)", "DESC"),
    "most-unique-words": ("CAST(len(vocabulary) AS DOUBLE)", "DESC"), "highest-tag-density": ("CASE WHEN token_count > 0 THEN 100 * len(tags) / token_count END", "DESC"),
}
add("record_sections", record_sections, f"{D}{PHRASES}, hp AS (SELECT path, count(*) AS hits FROM p JOIN r USING (phrase) GROUP BY path), c AS (SELECT t.*, hits FROM t LEFT JOIN hp ON hp.path = t.path), " + ", ".join(
    f"s{k} AS (SELECT '{name}' AS section, path, CAST({value} AS DOUBLE) AS score, CAST(token_count AS BIGINT) AS word_count, CAST(row_number() OVER (ORDER BY {value} {way}, token_count DESC, path) AS INT) AS rank FROM c WHERE ({value}) IS NOT NULL QUALIFY rank <= 10)" for k, (name, (value, way)) in enumerate(_SECTIONS.items())
) + " SELECT section, path, round(score, 6) AS score, word_count, rank FROM (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(len(_SECTIONS))) + ")")
add("recommend_all", lambda spark, sf: rounded(R.recommend_all(X.linked_pages(spark, sf)).select("src", "rank", "dst", "score", "explanation")), """WITH n AS (SELECT 'page/' || page_id || '.md' AS path, list_append(regexp_extract_all(html, 'href="([^"]+)"', 1), 'page/' || ((page_id * 17 + 1) % (SELECT count(*) FROM pages)) || '.md') AS links, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS lang FROM pages),
l AS (SELECT path AS src, unnest(links) AS dst FROM n), d AS (SELECT DISTINCT path AS p, unnest(links) AS x FROM n),
k AS (SELECT src, dst, 5.0 AS s, 1 AS kind FROM (SELECT DISTINCT src, dst FROM l) JOIN n ON n.path = dst UNION ALL SELECT x, p, 3.0, 2 FROM d JOIN n ON n.path = x UNION ALL SELECT a.path, b.path, 2.0, 3 FROM n a JOIN n b ON a.lang = b.lang UNION ALL SELECT src, p, 2.0, 4 FROM l JOIN d ON l.dst = d.x UNION ALL SELECT a.path, b.path, 1.0, 5 FROM n a JOIN n b ON a.lang = b.lang AND a.lang <> ''),
g AS (SELECT src, dst, sum(s) AS score, list_sort(list(DISTINCT kind)) AS kinds FROM k WHERE src <> dst GROUP BY ALL), b AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS INT) AS rank, dst, score, kinds FROM g QUALIFY rank <= 10)
SELECT src, rank, dst, round(CAST(score AS DOUBLE), 6) AS score, array_to_string(list_transform(kinds, lambda x: CASE x WHEN 1 THEN 'It is directly linked from the current note.' WHEN 2 THEN 'It links back to the current note.' WHEN 3 THEN 'It shares tags with the current note.' WHEN 4 THEN 'It shares neighbouring notes with the current note.' ELSE 'It is in the same folder context.' END), ' ') AS explanation FROM b""")
_PAGE = lambda k: f"'d' || ({k}) % 7 || '/e' || (({k}) // 350) || '/p' || ({k}) % 50"
add("resolved_links", lambda spark, sf: L.resolve_links(X.named_pages(spark, sf)).select("path", F.posexplode("links").alias("place", "link")), f"""WITH n AS (SELECT page_id AS k, (SELECT count(*) FROM pages) AS n, page_id % 7 AS d, page_id // 350 AS e, 'p' || page_id % 50 AS base, {_PAGE('page_id')} || '.md' AS path FROM pages),
l AS (SELECT *, unnest([{_PAGE('k * 3 % n')} || '.md', {_PAGE('(k * 5 + 1) % n')}, 'p' || (k * 11 + 2) % 50, 'p' || (k + 1) % 50 || '#part', 'nowhere']) AS link, unnest([0, 1, 2, 3, 4]) AS place FROM n),
t AS (SELECT *, split_part(link, '#', 1) AS text FROM l),
c AS (SELECT t.path, place, x.path AS found, 1 AS way, 0 AS steps FROM t JOIN n x ON x.path = text UNION ALL SELECT t.path, place, x.path, 2, 0 FROM t JOIN n x ON x.path = text || '.md'
  UNION ALL SELECT t.path, place, x.path, 3, CASE WHEN t.d <> x.d THEN 4 WHEN t.e <> x.e THEN 2 ELSE 0 END FROM t JOIN n x ON x.base = text),
b AS (SELECT path, place, found FROM c QUALIFY row_number() OVER (PARTITION BY path, place ORDER BY way, steps, found) = 1)
SELECT t.path, CAST(t.place AS INT) AS place, coalesce(found, link) AS link FROM t LEFT JOIN b ON b.path = t.path AND b.place = t.place""")
add("windowed_activity", lambda spark, sf: S.windowed_activity(X.table(spark, sf, "events")), "SELECT date_trunc('hour', ts) AS window_start, count(*) AS events FROM events GROUP BY 1")
add("session_activity", lambda spark, sf: S.session_activity(X.table(spark, sf, "events")), "WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 DAY AS session_end, count(*) AS events FROM s GROUP BY user_id, k")


def q_names(f):
    return lambda spark, sf: rounded(f(M.mentions(X.notes(spark, sf))))


add("entity_candidates", q_names(M.candidates))
add("entity_pairs", q_names(lambda found: M.pairs(found).orderBy(F.desc("strength"), "left_key", "right_key").limit(25)))
add("deep_text_years", q_texts(M.deep_years))
add("deep_period_signature", q_texts(lambda r: M.deep_signature(r, 2021, 2023, 2018, 2020)))
add("entity_lists", q_names(lambda found: M.top_candidates(M.candidates(found))))
add("deep_period_lists", q_texts(lambda r: B.period_lists(B.period_terms(M.term_rows(r), 2023, 2023, True))))
add("period_lists", q_texts(lambda r: B.period_lists(B.period_terms(terms(r), 2023, 2023, True))), f"""{D}, w AS (SELECT year, unnest(tokens) AS term FROM t), c AS (SELECT term, count(*) FILTER (year = 2023) AS s, count(*) FILTER (year < 2023) AS o FROM w WHERE length(term) >= 3 AND year <= 2023 GROUP BY term), z AS (SELECT count(*) AS v, sum(s) AS ns, sum(o) AS nc FROM c),
q AS (SELECT term, s, o, (s + 0.5) / (ns + 0.5 * v) AS sr, log2(((s + 0.5) / (ns + 0.5 * v)) / ((o + 0.5) / (nc + 0.5 * v))) AS score FROM c CROSS JOIN z WHERE s + o >= 2),
a AS (SELECT 'distinctive' AS list, row_number() OVER (ORDER BY round(score, 9) DESC, s DESC, icu_sort_key(term, 'und'), term) AS rank, * FROM q WHERE score > 0 QUALIFY rank <= 10), b AS (SELECT 'emergent' AS list, row_number() OVER (ORDER BY s DESC, icu_sort_key(term, 'und'), term) AS rank, * FROM q WHERE o = 0 AND s >= 2 QUALIFY rank <= 10), f AS (SELECT 'fading' AS list, row_number() OVER (ORDER BY round(score, 9), o DESC, icu_sort_key(term, 'und'), term) AS rank, * FROM q WHERE score < 0 QUALIFY rank <= 10)
SELECT list, CAST(rank AS INT) AS rank, term, s AS selected, o AS compared, round(score, 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM f)""")


def _both(spark, sf):
    notes = X.notes(spark, sf)
    return C.to_entries(notes), B.texts(notes)


def text_shifts(spark, sf):
    """Changes from year to year of notes with body text."""
    entries, texts = _both(spark, sf)
    return rounded(H.regime_shifts(entries, texts=B.year_profiles(texts)))


#: The documents as entries: E's columns from D.
E2 = f"""{D}, e AS (SELECT path, created, updated, year, month, CAST(dayofweek(created) AS INT) AS weekday, epoch_day, CAST(token_count AS BIGINT) AS word_count, token_count / 230.0 AS reading_minutes,
  (epoch_ms(updated) - epoch_ms(created)) / 86400000.0 AS lag_days, list_sort(list_distinct(tags)) AS tags FROM t), et AS (SELECT * EXCLUDE (tags), unnest(tags) AS tag FROM e)"""
_TEXT_SHIFTS = f"""{_TEXTS}, {_SHIFT_PARTS.replace(E, E2)},
tp AS (SELECT *, lag(year) OVER (ORDER BY year) AS b, lag(coalesce(richness, 0)) OVER (ORDER BY year) AS r0, lag(coalesce(novelty, 0)) OVER (ORDER BY year) AS n0, lag(coalesce(sentence_mean, 0)) OVER (ORDER BY year) AS s0, lag(coalesce(recurring_share, 0)) OVER (ORDER BY year) AS p0 FROM ty),
tc2 AS (SELECT b AS from_year, year AS to_year, least(1, abs(coalesce(richness, 0) - r0) * 4) * 0.35 + least(1, abs(coalesce(novelty, 0) - n0) * 2) * 0.25 + least(1, abs(ln((coalesce(sentence_mean, 0) + 1) / (s0 + 1)))) * 0.2 + least(1, abs(coalesce(recurring_share, 0) - p0) * 2) * 0.2 AS text_change FROM tp WHERE b IS NOT NULL),
ts AS (SELECT sh.*, text_change, tag_change * 0.35 + text_change * 0.2 + volume_change * 0.2 + revision_change * 0.125 + cadence_change * 0.125 AS score FROM sh JOIN tc2 USING (from_year, to_year))"""
add("text_regime_shifts", text_shifts, f"{_TEXT_SHIFTS} SELECT from_year, to_year, {_PARTS6}, {R6('score', 'score')} FROM ts")
add("shift_examples", lambda spark, sf: EX.shift_examples(X.notes(spark, sf), text_shifts(spark, sf).select("from_year", "to_year")), f"""{_TEXT_SHIFTS}, sx AS (SELECT from_year, to_year, 'before' AS side, CAST(row_number() OVER (PARTITION BY to_year ORDER BY epoch_day DESC, path) AS INT) AS rank, path FROM ts JOIN t ON t.year = from_year QUALIFY rank <= 3),
sz AS (SELECT from_year, to_year, 'after' AS side, CAST(row_number() OVER (PARTITION BY to_year ORDER BY epoch_day, path) AS INT) AS rank, path FROM ts JOIN t ON t.year = to_year QUALIFY rank <= 3) SELECT * FROM sx UNION ALL SELECT * FROM sz""")


def _notes(spark, sf):
    """The notes, whose words are their tokens."""
    return X.notes(spark, sf).drop("word_count")


def headlines(spark, sf):
    """The eleven headline cards."""
    return RD.headlines(**GR.structure(_notes(spark, sf)))


def readings(spark, sf):
    """The structural readings."""
    return RD.structural_readings(**GR.structure(_notes(spark, sf), full=True))


_M = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', {x}) END"
add("headline_cards_plain", lambda spark, sf: RD.headlines(H.year_profiles(X.entries(spark, sf)), G.pair_lift(G.qualified(X.entries(spark, sf))), H.regime_shifts(X.entries(spark, sf))), f"""{_PROFILES}, pl AS (SELECT * FROM ({exact(SQL['tag_pair_lift'])}) LIMIT 1), sc AS (SELECT *, {_PLAIN} AS score FROM sh ORDER BY score DESC, to_year LIMIT 1),
""" + ", ".join(f"k{k} AS (SELECT {k} AS place, '{label}' AS label, CAST(year AS VARCHAR) AS value, '{said} ' || {_M(c)} AS detail FROM md ORDER BY {c} DESC, year LIMIT 1)" for k, label, c, said in (
    (1, "Most bursty year", "burstiness", "Burstiness"), (2, "Most revision-heavy year", "intensity_per_word", "Revision intensity"), (3, "Most thematically concentrated year", "tag_concentration", "Tag concentration"),
    (4, "Most semantically diverse year", "tag_entropy", "Tag entropy"), (7, "Most concentrated writing year", "concentration", "Concentration"), (8, "Most revisited year", "revisit_ratio", "Revisit ratio"),
)) + f""" SELECT * FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4 UNION ALL SELECT * FROM k7 UNION ALL SELECT * FROM k8
UNION ALL SELECT 5, 'Strongest recurring motif', "left" || ' + ' || "right", 'Lift ' || {_M('lift')} || ', support ' || support FROM pl UNION ALL SELECT 6, 'Sharpest regime shift year', CAST(to_year AS VARCHAR), 'From ' || from_year || ', score ' || {_M('score')} FROM sc)""")



def _cards_sql() -> tuple[str, str]:
    """SQL of the cards and readings over the documents."""
    of = lambda name: f"({exact(SQL[name]).replace(E, E2)})"
    tags = f"(SELECT * FROM {of('tag_distribution')} WHERE year IS NOT NULL)"
    rows = []

    def top(kind, place, label, source, value, detail, *order):
        rows.append((kind, f"(SELECT {place} AS place, '{label}' AS label, CAST({value} AS VARCHAR) AS value, {detail} AS detail FROM {source} ORDER BY {', '.join(order)} LIMIT 1)"))

    for place, label, source, column, said in (
        (1, "Most bursty year", of("temporal_by_year"), "burstiness", "Burstiness"), (2, "Most revision-heavy year", of("revision_by_year"), "intensity_per_word", "Revision intensity"),
        (3, "Most thematically concentrated year", tags, "concentration", "Tag concentration"), (4, "Most semantically diverse year", tags, "entropy", "Tag entropy"),
        (7, "Most concentrated writing year", of("volume_by_year"), "concentration", "Concentration"), (8, "Most revisited year", of("revision_by_year"), "revisit_ratio", "Revisit ratio"),
    ):
        top("card", place, label, source, "year", f"'{said} ' || {_M(column)}", f"{column} DESC", "year")
    pair, by_lift = "\"left\" || ' + ' || \"right\"", ("lift DESC", "support DESC", '"left"', '"right"')
    shifts, profiles = f"({_TEXT_SHIFTS} SELECT * FROM ts)", f"({_TEXTS} SELECT * FROM ty)"
    openings = of("opening_shift")
    top("card", 5, "Strongest recurring motif", of("tag_pair_lift"), pair, f"'Lift ' || {_M('lift')} || ', support ' || support", *by_lift)
    top("card", 6, "Sharpest regime shift year", shifts, "to_year", f"'From ' || from_year || ', score ' || {_M('score')}", "score DESC", "to_year")
    top("card", 9, "Richest vocabulary year", profiles, "year", f"'Lexical richness ' || {_M('richness')}", "richness DESC NULLS LAST", "year")
    top("card", 10, "Most repetitive phrasing year", profiles, "year", f"'Recurring phrase share ' || {_M('recurring_share')}", "recurring_share DESC NULLS LAST", "year")
    top("card", 11, "Sharpest opening-style shift", openings, "year", f"'From ' || \"before\" || ', score ' || {_M('distance')}", "distance DESC", "year")
    top("reading", 1, "Sharpest structural shift", shifts, "to_year", f"'From ' || from_year || '; combined score ' || {_M('score')} || '.'", "score DESC", "to_year")
    top("reading", 2, "Most concentrated writing year", of("volume_by_year"), "year", f"'Writing concentration ' || {_M('concentration')} || '.'", "concentration DESC", "year")
    top("reading", 3, "Strongest recurring tag motif", of("tag_pair_lift"), pair, f"'Lift ' || {_M('lift')} || ' across ' || support || ' entries.'", *by_lift)
    top("reading", 4, "Richest vocabulary period", profiles, "year", f"'Lexical richness ' || {_M('richness')} || ' with novelty ' || {_M('coalesce(novelty, 0)')} || '.'", "richness DESC NULLS LAST", "year")
    top("reading", 5, "Most persistent recurrent phrase", of("recurring_phrases"), "phrase", "entries || ' entries from ' || first_year || ' to ' || last_year || '.'", "score DESC", "entries DESC", "icu_sort_key(phrase, 'und')", "phrase")
    top("reading", 6, "Most revision-heavy tag", f"(SELECT * FROM {of('tag_text_profiles')} WHERE mean_lag IS NOT NULL)", "tag", f"'Average revision lag ' || {_M('mean_lag')} || ' days.'", "mean_lag DESC", "entries DESC", "mean_richness DESC NULLS LAST", "tag")
    top("reading", 7, "Sharpest opening-style drift", openings, "year", f"'Shift from ' || \"before\" || ' with score ' || {_M('distance')} || '.'", "distance DESC", "year")
    both = (" UNION ALL ".join(f"SELECT * FROM {row}" for kind, row in rows if kind == wanted) for wanted in ("card", "reading"))
    return tuple(both)


_CARDS_SQL, _READINGS_SQL = _cards_sql()
add("headline_cards", headlines, _CARDS_SQL)
add("structural_readings", readings, _READINGS_SQL)
# Files with missing and invalid dates, without words or tags.
F0 = f"""{D}, f0 AS (SELECT *, CAST(regexp_extract(path, '/([0-9]+)[.]md$', 1) AS BIGINT) AS k FROM t),
f1 AS (SELECT path, tags, CASE WHEN k % 11 = 0 THEN 0 ELSE token_count END AS word_count, CASE WHEN k % 7 = 0 THEN 'missing' WHEN k % 7 <= 2 THEN 'invalid' END AS ci, CASE WHEN k % 2 = 1 THEN 'missing' END AS ui,
  CASE WHEN k % 7 > 2 THEN 'frontmatter' WHEN k % 7 = 0 AND k % 5 = 0 THEN 'unresolved' ELSE 'filesystem-ctime' END AS cs, CASE WHEN k % 2 = 0 THEN 'frontmatter' ELSE 'filesystem-mtime' END AS us,
  CASE WHEN k % 7 > 2 THEN date_trunc('minute', created) WHEN k % 5 <> 0 THEN created END AS cv, CASE WHEN k % 2 = 0 THEN date_trunc('day', updated) ELSE updated END AS uv FROM f0)"""
_LABEL = lambda m: f"CASE WHEN floor({m} + 0.5) < 60 THEN CAST(CAST(floor({m} + 0.5) AS BIGINT) AS VARCHAR) || ' min' WHEN floor({m} + 0.5) < 1440 THEN CAST(CAST(floor(floor({m} + 0.5) / 60) AS BIGINT) AS VARCHAR) || ' h ' || CAST(CAST(floor({m} + 0.5) % 60 AS BIGINT) AS VARCHAR) || ' min' ELSE CAST(CAST(floor(floor({m} + 0.5) / 1440) AS BIGINT) AS VARCHAR) || ' d ' || CAST(CAST(floor(floor({m} + 0.5) / 60) % 24 AS BIGINT) AS VARCHAR) || ' h' END"
add("file_totals", lambda spark, sf: rounded(C.file_totals(X.facts(spark, sf), 230, "median")), f"""{F0}, a AS (SELECT count(*) AS entries, CAST(sum(word_count) AS BIGINT) AS words, avg(word_count) AS mw, median(word_count) AS md, count(*) FILTER (cs LIKE 'filesystem%') AS created_fallbacks, count(*) FILTER (us LIKE 'filesystem%') AS updated_fallbacks,
  count(*) FILTER (ci = 'missing') AS created_missing, count(*) FILTER (ci = 'invalid') AS created_invalid, count(*) FILTER (ui = 'missing') AS updated_missing, count(*) FILTER (ui = 'invalid') AS updated_invalid, count(*) FILTER (cv IS NULL) AS undated FROM f1)
SELECT * EXCLUDE (mw, md), {R6('mw', 'mean_words')}, {R6('md', 'median_words')}, {R6('md', 'selected_words')}, {R6('words / 230.0', 'reading_minutes')}, {_LABEL('words / 230.0')} AS reading_label, {R6('md / 230.0', 'selected_minutes')} FROM a""")
add("file_years", lambda spark, sf: rounded(C.file_years(X.facts(spark, sf))), f"""{F0} SELECT CAST(year(cv) AS INT) AS year, count(*) AS entries, CAST(sum(word_count) AS BIGINT) AS words, {R6('sum(word_count / 230.0)', 'reading_minutes')}, {_LABEL('sum(word_count / 230.0)')} AS reading_label, {R6('avg(word_count)', 'mean_words')}, {R6('median(word_count)', 'median_words')},
  count(*) FILTER (cs LIKE 'filesystem%') AS created_fallbacks, count(*) FILTER (us LIKE 'filesystem%') AS updated_fallbacks FROM f1 WHERE cv IS NOT NULL GROUP BY 1""")
add("date_issues", lambda spark, sf: C.date_issues(X.facts(spark, sf)), f"{F0} SELECT path, ci AS created_issue, cs AS created_source, ui AS updated_issue, us AS updated_source FROM f1 WHERE ci IS NOT NULL OR ui IS NOT NULL")
#: Entries of those files: undated ones are gone, a fourth or so has no tags, some lags are negative.
E3 = f"""{F0}, e AS (SELECT path, cv AS created, uv AS updated, CAST(year(cv) AS INT) AS year, CAST(month(cv) AS INT) AS month, CAST(dayofweek(cv) AS INT) AS weekday, CAST(datediff('day', DATE '1970-01-01', CAST(cv AS DATE)) AS INT) AS epoch_day, CAST(word_count AS BIGINT) AS word_count, word_count / 230.0 AS reading_minutes,
  CASE WHEN uv >= cv THEN (epoch_ms(uv) - epoch_ms(cv)) / 86400000.0 END AS lag_days, CASE WHEN word_count % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE list_sort(list_distinct(tags)) END AS tags FROM f1 WHERE cv IS NOT NULL),
et AS (SELECT * EXCLUDE (tags), unnest(tags) AS tag FROM e)"""


def q_sparse(f):
    return lambda spark, sf: rounded(f(X.sparse_entries(spark, sf)))


for _name, _query in {
    "temporal_by_year": lambda e: H.temporal(e, "year"), "volume_by_year": lambda e: H.volume(e, "year"), "revision_by_year": lambda e: H.revision(e, "year"), "tag_distribution": G.tag_distribution, "tag_coverage": C.tag_coverage, "tag_summary": C.tag_summary, "month_heatmap": C.month_heatmap,
    "word_histogram": lambda e: C.histogram(e, "word_count"), "revision_length_correlation": H.revision_length_correlation, "cadence_depth_correlation": H.cadence_depth_correlation, "tag_regime_change": H.tag_change, "regime_shifts": H.regime_shifts,
}.items():
    add(f"sparse_{_name}", q_sparse(_query), SQL[_name].replace(E, E3))


def flat_tables(spark, sf):
    """What the registered flat export holds: files of facts(), entries of entries(), hours of the events."""
    e, files, events = X.entries(spark, sf), X.facts(spark, sf), X.table(spark, sf, "events")
    years, shifts = H.year_profiles(e), H.regime_shifts(e)
    pairs, bridges = G.pair_lift(G.qualified(e)), G.bridge_tags(G.qualified(e))
    return {
        "file_totals": C.file_totals(files, 230, "median"), "file_years": C.file_years(files), "tag_summary": C.tag_summary(e), "tags": C.tag_rows(e), "tag_coverage": C.tag_coverage(e), "tags_by_year": C.tag_rows(e, 1, 1, True), "year_profiles": years,
        "pair_lift": pairs, "bridge_tags": bridges, "regime_shifts": shifts, "longest_streak": H.longest_streak(e), "hours": C.hourly_activity(events, "ts"), "tag_years": C.tag_year_heatmap(e), "month_profile": C.month_profile(e),
        "pair_examples": EX.pair_examples(e, pairs), "bridge_examples": EX.bridge_examples(e, bridges),
        "silence_gaps": H.silence_gaps(e), "headlines": RD.headlines(years, pairs, shifts),
    }


def flat_export(spark, sf):
    """The flat export of 34 columns."""
    return FL.flat_rows(flat_tables(spark, sf), "median", examples=5).select(*FL.COLUMNS)


def _flat_sql() -> str:
    d = lambda x: (lambda v: f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', sign({v}) * floor(abs({v}) * 100 + 0.5) / 100) END")(f"round(CAST(coalesce({x}, 0) AS DOUBLE), 9)")
    t = lambda x: f"CAST({x} AS VARCHAR)"
    said = lambda *parts: " || '; ' || ".join(f"'{k}=' || {v}" for k, v in parts)
    day = lambda x: f"strftime(DATE '1970-01-01' + CAST({x} AS INT), '%Y-%m-%d')"
    week = "[" + ", ".join(f"'{x}'" for x in FL.WEEKDAYS) + "]"
    months = "[" + ", ".join(f"'{x}'" for x in FL.MONTHS) + "]"
    blocks = []

    def block(kind, source, **cells):
        blocks.append("SELECT " + ", ".join(f"'{kind}' AS row_type" if c == "row_type" else f"coalesce(CAST({cells.get(c, chr(39) * 2)} AS VARCHAR), '') AS {c}" for c in FL.COLUMNS) + f" FROM {source}")

    def advanced(kind, source, group, name, value, detail="''", score="''", year="''"):
        block(kind, source, advanced_group=f"'{group}'", advanced_name=name, advanced_value=value, advanced_detail=detail, advanced_score=score, year=year)

    of = lambda name: f"({exact(SQL[name])})"
    sizes = f"{of('tag_summary')} sz, (SELECT count(*) AS labels FROM {of('tag_rows')}) lb"
    block(
        "overall", f"{of('file_totals')} f, {sizes}", entries=t("f.entries"), words=t("words"), reading_time_minutes=d("reading_minutes"), reading_time_label="reading_label", average_entry_words=d("selected_words"), average_entry_method="'median'",
        average_entry_reading_minutes=d("selected_minutes"), average_entry_reading_label=_LABEL("selected_minutes"), created_fallback_count="created_fallbacks", updated_fallback_count="updated_fallbacks", tag_filtered_entries="sz.entries", tag_candidate_count="labels",
        tag_mean_tags_per_note=d("mean_tags"), tag_median_tags_per_note=d("median_tags"),
    )
    block("year", of("file_years"), year="year", entries="entries", words="words", reading_time_minutes=d("reading_minutes"), reading_time_label="reading_label", created_fallback_count="created_fallbacks", updated_fallback_count="updated_fallbacks")
    tag = dict(
        label="label", tag_entry_count="r.entries", tag_average_words=d("r.mean_words"), tag_median_words=d("r.median_words"), tag_mean_word_delta=d("mean_delta"), tag_median_word_delta=d("median_delta"), tag_primary_weekday=f"{week}[weekday + 1]", tag_primary_weekday_share=d("weekday_share"),
        tag_secondary_weekday=f"{week}[second_weekday + 1]", tag_secondary_weekday_share=f"CASE WHEN second_weekday IS NOT NULL THEN {d('second_share')} END", tag_dominant_month="month", tag_dominant_month_share=d("month_share"),
    )
    block("tag_overall", f"{of('tag_rows')} r, {sizes}", **tag, tag_filtered_entries="sz.entries", tag_candidate_count="labels")
    block("tag_year", f"{of('tag_rows_by_year')} r JOIN (SELECT year, entries AS considered FROM {of('tag_coverage')}) USING (year) JOIN (SELECT year, count(*) AS labels FROM {of('tag_rows_by_year')} GROUP BY year) USING (year)", year="year", **tag, tag_filtered_entries="considered", tag_candidate_count="labels")
    advanced("advanced_headline", f"({SQL['headline_cards_plain']})", "headline", "label", "value", "detail")
    advanced("advanced_year", of("year_profiles"), "year_profile", "'productivity_mode'", "mode", said(("burstiness", d("burstiness")), ("concentration", d("concentration")), ("revisit_ratio", d("revisit_ratio"))), d("regime_shift"), "year")
    advanced("advanced_tag_pair", of("tag_pair_lift"), "tag_structure", "\"left\" || ' + ' || \"right\"", "support", "'pair_lift'", d("lift"))
    advanced("advanced_bridge_tag", of("bridge_tags"), "tag_structure", "tag", "n", said(("degree", t("degree"))), d("score"))
    advanced("advanced_regime_shift", of("regime_shifts"), "hidden_structure", "from_year || '->' || to_year", d("score"), said(("tag", d("tag_change")), ("text", d("text_change")), ("volume", d("volume_change")), ("revision", d("revision_change")), ("cadence", d("cadence_change"))), d("score"), "to_year")
    extra = lambda source, name, value, detail="''", score="''": advanced("extra_metric", source, "extra_metrics", f"'{name}'", value, detail, score)
    extra(of("longest_streak"), "longest_writing_streak", "days", said(("start", day("first_day")), ("end", day("last_day")), ("entries", t("entries"))), d("days"))
    hours = SQL["hour_activity"]
    extra(f"(SELECT sum(entries) AS n FROM ({hours}))", "timed_entries", t("CAST(n AS BIGINT)"), score=d("n"))
    for name, way in (("most_active_hour", "DESC"), ("quietest_active_hour", "ASC")):
        extra(f"(SELECT * FROM ({hours}) WHERE entries > 0 ORDER BY entries {way}, hour LIMIT 1)", name, "printf('%02d:00', hour)", said(("entries", t("entries")), ("mean_words", "'0'")), d("entries"))
    top = f"(SELECT count(*) AS shown, arg_max(tag, total) AS tag, max(total) AS total FROM (SELECT DISTINCT tag, total FROM {of('tag_year_heatmap')} ORDER BY total DESC, tag))"
    extra(top, "displayed_heatmap_tags", "shown", score=d("shown"))
    extra(top, "top_tag_in_scope", "tag", said(("count", d("total"))), d("total"))
    advanced("extra_month", of("month_length_profile"), "extra_metrics", f"{months}[month]", "entries", said(("mean_words", d("mean_words")), ("median_words", d("median_words"))), d("mean_words"))
    advanced("extra_hour", f"(SELECT * FROM ({hours}) WHERE entries > 0)", "extra_metrics", "printf('%02d:00', hour)", "entries", said(("mean_words", "'0'")), d("entries"))
    advanced("extra_tag_frequency", f"(SELECT * FROM {of('tag_year_heatmap')} WHERE entries > 0)", "extra_metrics", "tag", "entries", "'tag_frequency_over_years'", d("entries"), "year")
    advanced("structural_example_silence_gap", f"(SELECT * FROM {of('silence_gaps')} ORDER BY gap_days DESC, from_path, to_path LIMIT 5)", "structural_examples", "'silence_gap'", d("gap_days"), said(("before", "from_path"), ("before_date", "from_date"), ("after", "to_path"), ("after_date", "to_date")), d("gap_days"))
    notes = "string_agg(path, ' | ' ORDER BY rank) AS notes"
    pairs = f"""(SELECT * FROM {of('tag_pair_lift')} LEFT JOIN (SELECT "left", "right", {notes} FROM ({_PAIR_NOTES}) GROUP BY ALL) USING ("left", "right") ORDER BY lift DESC, support DESC, "left", "right" LIMIT 5)"""
    advanced("structural_example_tag_pair", pairs, "structural_examples", "\"left\" || ' + ' || \"right\"", "support", said(("lift", d("lift")), ("notes", "notes")), d("lift"))
    bridges = f"(SELECT * FROM {of('bridge_tags')} LEFT JOIN (SELECT tag, {notes} FROM ({_BRIDGE_NOTES}) GROUP BY ALL) USING (tag) ORDER BY score DESC, degree DESC, tag LIMIT 5)"
    advanced("structural_example_bridge_tag", bridges, "structural_examples", "tag", "n", said(("degree", t("degree")), ("notes", "notes")), d("score"))
    return " UNION ALL ".join(f"SELECT * FROM ({b})" for b in blocks)


def export_all(spark, sf):
    """The flat export of the tag structures alone."""
    own = G.qualified(X.entries(spark, sf))
    return FL.flat_rows({"pair_lift": G.pair_lift(own), "bridge_tags": G.bridge_tags(own)}).select(*FL.COLUMNS)


add("flat_export", flat_export, _flat_sql())
add("export_rows", export_all, f"SELECT * FROM ({_flat_sql()}) WHERE row_type IN ('advanced_tag_pair', 'advanced_bridge_tag')")
