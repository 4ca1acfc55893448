"""Where files are offered to be filed: what a model said, what the user has taught, and what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.functions.text import course_key, phrase_key
from filewright.operators.learned import applied

# States of files that may move, the folder of all courses, and the kind for all others.
MOVABLE, COURSES, OTHER_KIND = ("candidate", "kept", "restored"), "Courses", "Other"


def filable(items: DataFrame, views: DataFrame) -> DataFrame:
    """``items(id, sha256, status, error, ...)`` that may move and have a view, or a copy of their content has one.

    ``views(item)`` may name an item often. Contents are looked up as a distinct list, so copies of one
    content meet one row however many have a view. A null sha256 is no content.
    """
    seen = views.select(F.col("item").alias("id")).distinct()
    contents = items.join(seen, "id", "left_semi").where("sha256 is not null").select("sha256").distinct()
    flagged = items.join(seen.withColumn("__own", F.lit(True)), "id", "left").join(contents.withColumn("__copy", F.lit(True)), "sha256", "left")
    live = F.col("status").isin(*MOVABLE) & F.col("error").isNull()
    return flagged.where(live & (F.col("__own").isNotNull() | F.col("__copy").isNotNull())).select(*items.columns)


def spellings(folders: DataFrame) -> DataFrame:
    """``(key, spelled)``: the folder of ``folders(name)`` for each course key, the first by name."""
    return folders.select(course_key(F.col("name")).alias("key"), "name").where("key <> ''").groupBy("key").agg(F.min("name").alias("spelled"))


def kind_folder(kind: Column, kinds: list[str]) -> Column:
    """One of the fixed kinds; whatever else a model says is other."""
    return F.when(F.trim(kind).isin(*kinds), F.trim(kind)).otherwise(OTHER_KIND)


def offered(opinions: DataFrame, store: DataFrame, folders: DataFrame, groups: DataFrame, kinds: list[str]) -> DataFrame:
    """``(item, owner, course, kind, folder, learned_course, learned_kind, also_known_as, was_rejected)``.

    ``opinions(item, owner, course, kind, phrase)``: what a model said, course empty where it could not
    tell; ``store(owner, kind, k, v)``: learned preferences, keys of kinds and rejections being two parts
    with a line break between; ``folders(name)``: courses that have a folder; ``groups(phrase, folder)``:
    folders for what a file is, by phrase key.

    A learned name replaces the model's course, and a folder that is there gives its spelling; a learned
    kind replaces the model's for that course. also_known_as is the old course's own folder. Without a
    course the phrase's folder is offered, unless it has the name of the courses' folder, and without
    that none is: folder is null. Nulls count as empty; a rejected folder is offered, but marked.
    """
    text = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("course", "kind", "phrase")}
    rows = opinions.select("item", "owner", text["course"].alias("__model"), kind_folder(text["kind"], kinds).alias("__kind"), phrase_key(text["phrase"]).alias("__phrase"))
    rows = rows.withColumn("__course_key", course_key(F.col("__model")))
    rows = applied(rows, store, {"course": F.col("__course_key"), "file_kind": F.concat_ws("\n", "__course_key", "__kind")}, F.lit(None).cast("string")).drop("was_rejected")
    there = F.col("__model") != ""
    wanted_key = course_key(F.trim("learned_course"))
    taught = F.coalesce(there & (wanted_key != "") & (wanted_key != F.col("__course_key")), F.lit(False))
    rows = rows.withColumn("__taught", taught).withColumn("__want", F.when(taught, F.trim("learned_course")).otherwise(F.col("__model")))
    rows = rows.withColumn("__want_key", course_key(F.col("__want")))
    known = spellings(folders)
    rows = rows.join(known.select(F.col("key").alias("__want_key"), F.col("spelled").alias("__spelled")), "__want_key", "left")
    rows = rows.join(known.select(F.col("key").alias("__course_key"), F.col("spelled").alias("__old")), "__course_key", "left")
    mapped = groups.select(phrase_key(F.col("phrase")).alias("__phrase"), "folder").groupBy("__phrase").agg(F.min("folder").alias("__folder"))
    rows = rows.join(mapped, "__phrase", "left")
    kind_taught = kind_folder(F.col("learned_file_kind"), kinds)
    kind_learned = F.coalesce(there & F.col("learned_file_kind").isNotNull() & (F.trim("learned_file_kind") != "") & (kind_taught != F.col("__kind")), F.lit(False))
    course = F.when(there, F.coalesce("__spelled", "__want")).otherwise("")
    kind = F.when(kind_learned, kind_taught).otherwise(F.col("__kind"))
    grouped = F.when((F.col("__folder") != "") & (F.lower("__folder") != COURSES.lower()), F.col("__folder"))
    also = F.when(F.col("__taught") & F.col("__old").isNotNull() & (F.col("__course_key") != course_key(course)), F.col("__old"))
    out = rows.select("item", "owner", course.alias("course"), kind.alias("kind"), F.when(there, F.concat_ws("/", F.lit(COURSES), course, kind)).otherwise(grouped).alias("folder"), F.col("__taught").alias("learned_course"), kind_learned.alias("learned_kind"), also.alias("also_known_as"))
    return applied(out, store, {}, F.concat_ws("\n", F.col("item").cast("string"), "folder"))


def taught_course(offered_course: Column, offered_name: Column, asked: Column) -> Column:
    """The course that a user typed in place of the offered one, where the rest of the name is the same; else null."""
    tail = F.substr(offered_name, F.length(offered_course) + 1)
    head = F.substr(asked, F.lit(1), F.length(asked) - F.length(tail))
    same = (offered_course != "") & offered_name.startswith(offered_course) & (tail != "") & asked.endswith(tail) & (F.length(asked) > F.length(tail))
    return F.when(same & (course_key(head) != course_key(offered_course)), head)
