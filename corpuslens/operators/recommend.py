"""Note recommendations: weighted links, backlinks, shared tags and neighbours, same folder.

notes: path (distinct), links ARRAY, tags ARRAY, folder. recommend_all() finds every note's best pairs without meeting
all pairs of a common tag, folder or link target; recommend() is the plain plan for one note.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from corpuslens.config import RecommendConfig
from corpuslens.functions.order import named


#: Notes of a feature up to which its pairs are met, heavy classes of a note at most, and notes that may have more.
LIGHT, MOST, WIDE = 64, 10, 64


def _links(notes: DataFrame, src: DataFrame) -> DataFrame:
    """src, dst, kind, hits: links out and back, and shared neighbours. A neighbour that the source repeats counts again."""
    out = src.select(F.col("path").alias("src"), F.explode("links").alias("dst"))
    known = notes.select(F.col("path").alias("dst"))
    direct = out.distinct().join(known, "dst").select("src", "dst", F.lit("out").alias("kind"), F.lit(1).cast("long").alias("hits"))
    back = notes.select(F.col("path").alias("dst"), F.explode(F.array_distinct("links")).alias("src")).join(src.select(F.col("path").alias("src")), "src").select("src", "dst", F.lit("back").alias("kind"), F.lit(1).cast("long").alias("hits"))
    near = out.withColumnRenamed("dst", "n").join(notes.select(F.col("path").alias("dst"), F.explode(F.array_distinct("links")).alias("n")), "n").groupBy("src", "dst").agg(F.count("*").alias("hits"))
    return direct.unionByName(back).unionByName(near.select("src", "dst", F.lit("neighbour").alias("kind"), "hits"))


def _shared(src: DataFrame, notes: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, kind, hits: shared tags (a tag that the source repeats counts again) and the same folder, of rows with tags and folder."""
    tags = src.select(a, F.explode("tags").alias("t")).join(notes.select(b, F.explode(F.array_distinct("tags")).alias("t")), "t").groupBy(a, b).agg(F.count("*").alias("hits")).select(a, b, F.lit("tag").alias("kind"), "hits")
    folder = src.where("folder != ''").select(a, "folder").join(notes.select(b, "folder"), "folder").select(a, b, F.lit("folder").alias("kind"), F.lit(1).cast("long").alias("hits"))
    return tags.unionByName(folder)


def _linked(notes: DataFrame, one: str | None, config: RecommendConfig) -> DataFrame:
    """src, dst, kind, hits: all that connects two notes."""
    src = notes if one is None else notes.where(F.col("path") == one)
    rows = _links(notes, src).unionByName(_shared(src.withColumnRenamed("path", "src"), notes.withColumnRenamed("path", "dst"), "src", "dst"))
    return rows.where("src != dst")


def _features(notes: DataFrame, config: RecommendConfig) -> DataFrame:
    """path, feature, weight: a note's tags, link targets and folder; as a source each counts as often as it repeats, as a target once."""
    kind = lambda name, key, weight: F.struct(F.lit(name).alias("kind"), key.alias("key"), F.lit(float(weight)).alias("weight"))
    some = lambda c, name, weight: F.transform(F.coalesce(F.col(c), F.array()), lambda x: kind(name, x, weight))
    folder = F.filter(F.array(kind("folder", F.coalesce("folder", F.lit("")), config.same_folder)), lambda x: x["key"] != "")
    every = F.concat(some("tags", "tag", config.shared_tag), some("links", "neighbour", config.shared_neighbour), folder)
    rows = notes.select("path", F.explode(every).alias("f")).where("f.key is not null")
    return rows.groupBy("path", F.struct("f.kind", "f.key").alias("feature")).agg(F.sum("f.weight").alias("weight"))


def _subsets(classes: Column) -> Column:
    """All non-empty subsets of an array of (class, weight): their classes in order, and the sum of their weights."""
    start = F.array(F.struct(F.array().cast("array<long>").alias("classes"), F.lit(0.0).alias("weight")))
    grown = lambda all_, c: F.concat(all_, F.transform(all_, lambda s: F.struct(F.concat(s["classes"], F.array(c["class"])).alias("classes"), (s["weight"] + c["weight"]).alias("weight"))))
    return F.filter(F.aggregate(classes, start, grown), lambda s: F.size(s["classes"]) > 0)


def _first(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first rows of each key; tasks cut theirs before the shuffle."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("turn") <= most).drop("turn")


def _best_pairs(notes: DataFrame, config: RecommendConfig) -> DataFrame:
    """src, dst: the best `limit` pairs of every source, without meeting all pairs of a common tag, folder or link target.

    1. Features of at most `light` notes are joined: at most `light` rows for each note and feature.
    2. Features of more notes are heavy. Those that stand in the same notes are one class (told by count and hashes of
       their notes), whose weights add up. A note has the set of its heavy classes.
    3. A target that shares nothing else with a source scores the weight of the classes that both have, a subset X. It
       can only be among the best if it is one of the first limit + 1 notes, by path, that have all of X: any other
       one there scores as much or more. So these heads, of the subsets of every set that occurs, are all that counts,
       and of a source's subsets only those that weigh as much as one with limit + 2 notes.
    4. Notes with more than MOST heavy classes have too many subsets. Up to WIDE of them are joined feature by feature
       with all notes; if there are more, `light` is raised until no more are left.

    Rows grow with the notes: at most 2**MOST subsets, `light` rows a light feature and WIDE rows for each.
    """
    weights = _features(notes, config).where("weight > 0")
    support = weights.groupBy("feature").agg(F.count("*").alias("many"), F.sum(F.xxhash64("path").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "path")).alias("x")).where("many > 1")
    known = weights.join(support, "feature")
    # The (MOST + 1)th largest class of a note, for the WIDE + 1 notes where it is largest: light reaches up to the last of these.
    sizes = known.where(F.col("many") > LIGHT).groupBy("path").agg(F.collect_set(F.struct("many", "s", "x")).alias("c")).where(F.size("c") > MOST)
    most = sizes.select(F.element_at(F.sort_array("c", asc=False), MOST + 1)["many"].alias("m")).orderBy(F.desc("m")).limit(WIDE + 1).collect()
    light = max(LIGHT, most[-1].m if len(most) > WIDE else 0)
    heavy = known.where(F.col("many") > light).groupBy("path", F.xxhash64("many", "s", "x").alias("class")).agg(F.sum("weight").alias("weight"))
    sets = heavy.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("class", "weight"))).alias("classes"))
    wide = sets.where(F.size("classes") > MOST).select("path")
    narrow = sets.where(F.size("classes") <= MOST)

    # Light features, and all features of wide notes, pair by pair.
    low = known.where(F.col("many") <= light).select("feature", "path", "weight")
    of_wide = known.where(F.col("many") > light).join(F.broadcast(wide), "path").select("feature", "path", "weight")
    rest = known.where(F.col("many") > light).join(F.broadcast(wide), "path", "left_anti").select("feature", "path", "weight")
    target = lambda rows: rows.select("feature", F.col("path").alias("dst"))
    meet = lambda a, b: a.withColumnRenamed("path", "src").join(target(b), "feature").where("src != dst").select("src", "dst", "weight")
    shared = meet(low, low).unionByName(meet(of_wide, of_wide)).unionByName(meet(of_wide, rest)).unionByName(meet(rest, of_wide))
    own = notes.select(F.col("path").alias("src"), F.explode(F.array_distinct("links")).alias("dst")).where("src != dst")
    linked = own.join(notes.select(F.col("path").alias("dst")), "dst").select("src", "dst")
    direct = linked.select("src", "dst", F.lit(float(config.out_link)).alias("weight")).unionByName(linked.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(float(config.back_link)).alias("weight")))
    near = shared.unionByName(direct).groupBy("src", "dst").agg(F.sum("weight").alias("part"))
    both = near.join(narrow.select(F.col("path").alias("src"), F.col("classes").alias("mine")), "src", "left").join(narrow.select(F.col("path").alias("dst"), F.transform("classes", lambda c: c["class"]).alias("other")), "dst", "left")
    common = F.aggregate(F.filter("mine", lambda c: F.array_contains("other", c["class"])), F.lit(0.0), lambda s, c: s + c["weight"])
    near = both.select("src", "dst", (F.col("part") + F.coalesce(common, F.lit(0.0))).alias("score"))

    # What shares heavy classes only. Equal sets have the same first notes.
    limit = config.limit
    plain = narrow.select("path", F.transform("classes", lambda c: F.struct(c["class"].alias("class"), F.lit(0.0).alias("weight"))).alias("set"))
    few = _first(plain, "set", named("path"), limit + 2)
    having = few.select("path", F.explode(_subsets(F.col("set"))).alias("s")).select(F.col("s.classes").alias("subset"), F.col("path").alias("dst"))
    heads = _first(having, "subset", named("dst"), limit + 2)
    enough = heads.groupBy("subset").agg((F.count("*") >= limit + 2).alias("enough"))
    sources = narrow.select("classes").distinct()
    parts = sources.select("classes", F.explode(_subsets(F.col("classes"))).alias("s")).select("classes", F.col("s.classes").alias("subset"), F.col("s.weight").alias("score")).join(enough, "subset")
    bar = F.coalesce(F.max(F.when(F.col("enough"), F.col("score"))).over(Window.partitionBy("classes")), F.lit(0.0))
    parts = parts.withColumn("bar", bar).where("score >= bar").select("classes", "subset", "score")
    found = parts.join(heads, "subset").groupBy("classes", "dst").agg(F.max("score").alias("score"))
    best = _first(found, "classes", [F.desc("score"), *named("dst")], limit + 1)
    far = narrow.select(F.col("path").alias("src"), "classes").join(best, "classes").where("src != dst").select("src", "dst", "score")
    rows = near.unionByName(far).groupBy("src", "dst").agg(F.max("score").alias("score")).where("score > 0")
    return _first(rows, "src", [F.desc("score"), *named("dst")], limit).select("src", "dst")


def _between(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """src, dst, kind, hits of given pairs, from the two notes' own lists."""
    list_of = lambda c: F.coalesce(F.col(c), F.array())
    ends = notes.select("path", list_of("links").alias("links"), list_of("tags").alias("tags"), F.coalesce("folder", F.lit("")).alias("folder"))
    src = ends.select(*(F.col(c).alias(f"s_{c}" if c != "path" else "src") for c in ends.columns))
    dst = ends.select(*(F.col(c).alias(f"d_{c}" if c != "path" else "dst") for c in ends.columns))

    def hits(c: str) -> Column:
        shared = F.array_intersect(f"s_{c}", f"d_{c}")
        return F.size(F.filter(f"s_{c}", lambda x: F.array_contains(shared, x)))

    one = lambda condition: F.when(condition, 1).otherwise(0)
    kinds = {
        "out": one(F.array_contains("s_links", F.col("dst"))), "back": one(F.array_contains("d_links", F.col("src"))), "tag": hits("tags"), "neighbour": hits("links"),
        "folder": one((F.col("s_folder") != "") & (F.col("s_folder") == F.col("d_folder"))),
    }
    cells = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), n.cast("long").alias("hits")) for k, n in kinds.items())), lambda x: x["hits"] > 0)
    return pairs.join(src, "src").join(dst, "dst").select("src", "dst", F.explode(cells).alias("c")).select("src", "dst", "c.kind", "c.hits")


def score_pairs(notes: DataFrame, config: RecommendConfig = RecommendConfig(), one: str | None = None, linked: DataFrame | None = None) -> DataFrame:
    """R2, R3, J15, J16. src, dst, the five signals, score and explanation; linked: what connects the pairs, if it is known."""
    count = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("hits"))), F.lit(0)).cast("long")
    rows = (linked if linked is not None else _linked(notes, one, config)).groupBy("src", "dst").agg(count("out").alias("out_link"), count("back").alias("back_link"), count("tag").alias("shared_tags"), count("neighbour").alias("shared_neighbours"), count("folder").alias("same_folder"))
    score = F.col("out_link") * config.out_link + F.col("back_link") * config.back_link + F.col("shared_tags") * config.shared_tag + F.col("shared_neighbours") * config.shared_neighbour + F.col("same_folder") * config.same_folder
    say = lambda c, text: F.when(F.col(c) > 0, F.lit(text))
    # The sentences of a recommendation, in their order.
    reasons = F.filter(F.array(
        say("out_link", "It is directly linked from the current note."), say("back_link", "It links back to the current note."), say("shared_tags", "It shares tags with the current note."),
        say("shared_neighbours", "It shares neighbouring notes with the current note."), say("same_folder", "It is in the same folder context."),
    ), lambda x: x.isNotNull())
    return rows.withColumn("score", score).withColumn("explanation", F.array_join(reasons, " ")).where("score > 0")


def recommend_all(notes: DataFrame, config: RecommendConfig = RecommendConfig()) -> DataFrame:
    """R1, R4. The best notes for every note; the diversity step compares paths only, so it changes nothing."""
    weights = (config.out_link, config.back_link, config.shared_tag, config.shared_neighbour, config.same_folder)
    # Bounds by parts of a score hold where no part takes away.
    linked = _between(_best_pairs(notes, config), notes) if min(weights) >= 0 else None
    order = Window.partitionBy("src").orderBy(F.desc("score"), *named("dst"))
    if config.diverse_pool > 0:
        return _diverse(notes, config)
    return score_pairs(notes, config, linked=linked).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.limit)


def _diverse(notes: DataFrame, config: RecommendConfig) -> DataFrame:
    """R4, not strict. From the `diverse_pool` best notes of each source, one after another, the one whose score less
    10 x diversity x its largest similarity to those already picked is highest, while that is not negative.

    Two notes are as similar as their tags and links overlap (Jaccard). A source's pool is an array of bounded size.
    """
    pool = recommend_all(notes, replace(config, limit=max(config.limit, config.diverse_pool), diverse_pool=0))
    mark = lambda c, kind: F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.concat(F.lit(kind), x))
    traits = notes.select(F.col("path").alias("dst"), F.array_distinct(F.concat(mark("tags", "#"), mark("links", "@"))).alias("traits"))
    shown = [c for c in pool.columns if c not in ("src", "rank")]
    rows = pool.join(traits, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "traits", F.struct(*shown).alias("row")))).alias("pool"))
    one = rows.select("src", "pool").schema["pool"].dataType.elementType

    def alike(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(F.size(F.array_intersect(a["traits"], b["traits"])), F.size(F.array_union(a["traits"], b["traits"]))), F.lit(0.0))

    def less(candidate: Column, picked: Column) -> Column:
        likest = F.aggregate(picked, F.lit(0.0), lambda s, p: F.greatest(s, alike(candidate, p)))
        return candidate["row"]["score"] - likest * (10 * config.diversity)

    def step(state: Column, _: Column) -> Column:
        # Ranks are the order of equal scores: the smallest of the best.
        scored = F.transform(state["left"], lambda c: F.struct((-less(c, state["picked"])).alias("cost"), c["rank"].alias("rank"), c.alias("c")))
        best = F.array_min(F.filter(scored, lambda x: (x["cost"] <= 0) | (F.size(state["picked"]) == 0)))
        return F.when(best.isNull(), state).otherwise(F.struct(F.concat(state["picked"], F.array(best["c"])).alias("picked"), F.filter(state["left"], lambda c: c["rank"] != best["rank"]).alias("left")))

    start = F.struct(F.array().cast(ArrayType(one, False)).alias("picked"), F.col("pool").alias("left"))
    picked = F.aggregate(F.sequence(F.lit(1), F.lit(config.limit)), start, step, lambda s: s["picked"])
    found = rows.select("src", F.posexplode(picked).alias("at", "c"))
    return found.select("src", "c.row.*", (F.col("at") + 1).alias("rank"))


def recommend(notes: DataFrame, path: str, config: RecommendConfig = RecommendConfig()) -> DataFrame:
    """R1. The best notes for one; none for an unknown path."""
    return score_pairs(notes, config, path).orderBy(F.desc("score"), *named("dst")).limit(config.limit)
