"""Links resolved to notes (Q-10, not strict): by full path, path without extension, then base name, nearest folder first.

The strict mode compares a link's text with paths as it stands; resolve_links() gives notes whose links are paths, which
every operator over links takes as well. A link's text may end in #heading.

No pair of a common base name's links and notes is met. For a base name and a folder, the notes at or below the folder
are reduced to the one that lies least deep (of several, the first by path). A link asks its own folder and every folder
above it; the distance is the steps up plus the steps down, and the smallest is that over the nearest common folder. So
rows grow with the depth of folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.order import local


def _folders(path: Column) -> Column:
    """The folders of a path from the root ('') down to its own."""
    parts = F.filter(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), lambda p: p != "")
    grown = F.aggregate(parts, F.array(F.lit("")), lambda all_, p: F.concat(all_, F.array(F.concat(F.element_at(all_, -1), p, F.lit("/")))))
    return F.transform(grown, lambda f, i: F.struct(f.alias("folder"), i.alias("depth")))


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def _base(path: Column) -> Column:
    return _bare(F.substring_index(path, "/", -1))


def resolve_links(notes: DataFrame) -> DataFrame:
    """notes (path distinct, links ARRAY, others) with every link that names a note replaced by that note's path, in its place."""
    asked = notes.select("path", F.posexplode("links").alias("at", "link")).withColumn("text", F.trim(F.regexp_replace("link", "#.*$", ""))).where("text != ''")
    # By path, with and without its extension.
    whole = notes.select(F.col("path").alias("found"), F.explode(F.array(F.struct(F.lit(1).alias("way"), F.col("path").alias("text")), F.struct(F.lit(2).alias("way"), _bare(F.col("path")).alias("text")))).alias("k"))
    by_path = whole.groupBy("k.text").agg(F.min_by("found", F.struct("k.way", local("found"), "found")).alias("found"), F.min("k.way").alias("way"))
    direct = asked.select("path", "at", "text").join(by_path, "text").select("path", "at", "way", F.lit(0).alias("steps"), "found")
    # By base name, through the folders above both.
    places = notes.select("path", _base(F.col("path")).alias("text"), F.explode(_folders(F.col("path"))).alias("f"), F.size(_folders(F.col("path"))).alias("size"))
    near = places.groupBy("text", "f.folder").agg(F.min(F.struct((F.col("size") - 1 - F.col("f.depth")).alias("down"), local("path").alias("l"), F.col("path").alias("found"))).alias("best"))
    named = asked.where(~F.col("text").contains("/")).select("path", "at", _base(F.col("text")).alias("text"), F.explode(_folders(F.col("path"))).alias("f"), F.size(_folders(F.col("path"))).alias("size"))
    up = F.col("size") - 1 - F.col("f.depth")
    by_name = named.select("path", "at", "text", F.col("f.folder").alias("folder"), up.alias("up")).join(near, ["text", "folder"])
    by_name = by_name.select("path", "at", F.lit(3).alias("way"), (F.col("up") + F.col("best.down")).alias("steps"), F.col("best.found").alias("found"))
    order = F.struct("way", "steps", local("found").alias("l"), "found")
    one = direct.unionByName(by_name).groupBy("path", "at").agg(F.min(order)["found"].alias("found"))
    lists = one.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("at", "found"))).alias("__found"))
    joined = notes.join(lists, "path", "left")
    own = F.when(F.col("__found").isNull(), F.col("links")).otherwise(F.transform("links", lambda x, i: F.coalesce(F.try_element_at(F.col("__found"), i), x)))
    return joined.select(*(own.alias("links") if c == "links" else c for c in notes.columns))
