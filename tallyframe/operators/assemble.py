"""Final label ids over existing entries, and vocabularies built under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import spatial as sp


def assembled(choice: DataFrame, kinds: DataFrame, entries: DataFrame, size: float, minimum: int) -> tuple[DataFrame, DataFrame]:
    """(entity, label) and the new entries (id, name, class_id, size, merged) of chosen classes.

    ``choice`` is (entity, class_id, x, y, z), ``kinds`` (class_id, name, stuff) and
    ``entries`` the existing (id, name, class_id). A stuff class takes its existing id, or the next; a
    thing class gets an id and a number for every spatial component of ``minimum``
    entities or more, counted on from its existing entries. New ids follow the
    largest existing one in order of class and least entity.
    """
    rows = choice.where("class_id > 0").join(kinds, "class_id")
    stuff = rows.where("stuff").groupBy("class_id", "name").agg(F.min("entity").alias("component"), F.count("*").alias("size"))
    members = sp.voxel_components(rows.where("not stuff"), size, ["class_id"])
    things = members.groupBy("class_id", "name", "component").agg(F.count("*").alias("size")).where(F.col("size") >= minimum)
    known = entries.where("id > 0").groupBy("class_id").agg(F.min("id").alias("known"), F.count("*").alias("used"))
    found = stuff.withColumn("stuff", F.lit(True)).unionByName(things.withColumn("stuff", F.lit(False))).join(known, "class_id", "left")
    found = found.withColumn("merged", F.col("stuff") & F.col("known").isNotNull())
    top = entries.agg(F.max("id").alias("top"))
    new = found.where("not merged").withColumn("place", F.row_number().over(Window.orderBy("class_id", "component")))
    new = new.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("place")).drop("place", "top")
    numbered = new.withColumn("ordinal", F.coalesce("used", F.lit(0)) + F.row_number().over(Window.partitionBy("class_id").orderBy("component")))
    title = F.when(F.col("stuff"), F.col("name")).otherwise(F.concat("name", F.lit("_"), F.lpad(F.col("ordinal").cast("string"), 2, "0")))
    columns = ["id", "title", "class_id", "component", "size", "stuff", "merged"]
    done = numbered.withColumn("title", title).select(columns).unionByName(found.where("merged").select(F.col("known").alias("id"), F.col("name").alias("title"), "class_id", "component", "size", "stuff", "merged"))
    of_stuff = rows.where("stuff").select("entity", "class_id").join(done.where("stuff").select("class_id", "id"), "class_id")
    of_things = members.select("entity", "class_id", "component").join(done.where("not stuff").select("class_id", "component", "id"), ["class_id", "component"])
    labels = of_stuff.select("entity", F.col("id").alias("label")).union(of_things.select("entity", "id"))
    return labels, done.select("id", F.col("title").alias("name"), "class_id", "size", "merged")


def eligible(records: DataFrame, ontology: DataFrame, aliases: DataFrame, min_size: int, min_views: int) -> DataFrame:
    """Classes (class, size, views) with reasons against them, their kind, prompts in order and priority.

    A class qualifies if the ontology (class, kind) knows it and size and views reach
    their bounds; its prompts are its aliases (class, place, prompt), then its own name, without repeats.
    Things come first, then larger, then by name.
    """
    own = records.select("class", F.lit(1 << 30).alias("place"), F.col("class").alias("prompt"))
    prompts = aliases.join(records.select("class"), "class", "left_semi").unionByName(own).withColumn("key", tx.prompt_key(F.col("prompt"))).where("key <> ''")
    first = prompts.groupBy("class", "key").agg(F.min("place").alias("place"))
    lists = first.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x.key).alias("prompts"))
    reasons = F.array_compact(F.array(F.when(F.col("kind").isNull(), "not_in_ontology"), F.when(F.col("size") < min_size, "size"), F.when(F.col("views") < min_views, "views")))
    j = records.join(ontology, "class", "left").join(lists, "class").withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)
    order = Window.partitionBy("ok").orderBy((F.col("kind") == "stuff"), F.desc("size"), "class")
    return j.withColumn("priority", F.when(F.col("ok"), F.row_number().over(order)).otherwise(F.lit(0))).drop("ok")


def guards(records: DataFrame, specs: DataFrame, extensions: list[str]) -> DataFrame:
    """(class, role, size, sources, prompts): scene specs (class, place, prompts) that guard existing classes
    (class, size), unmatched ones under their own names, and the extension classes."""
    scene = specs.where(~F.col("class").isin(extensions)) if extensions else specs
    best = tx.best_guard(records.select(F.col("class").alias("name")), scene.select("class", "prompts")).select("name", F.col("class").alias("guard"))
    j = records.select(F.col("class").alias("name"), "size").join(best, "name", "left")
    named = j.select(F.coalesce("guard", "name").alias("class"), "name", "size", F.col("guard").isNotNull().alias("matched"))
    own = named.groupBy("class").agg(F.sum("size").alias("size"), F.sort_array(F.collect_list("name")).alias("sources"), F.max("matched").alias("matched"))
    own = own.join(specs.select("class", "prompts"), "class", "left").select(
        "class", F.lit("guard").alias("role"), "size", "sources", F.when(F.col("matched"), F.col("prompts")).otherwise(F.array(F.replace("class", F.lit("_"), F.lit(" ")))).alias("prompts")
    )
    more = specs.where(F.col("class").isin(extensions)).select("class", F.lit("extension").alias("role"), F.lit(0).cast("bigint").alias("size"), F.array().cast("array<string>").alias("sources"), "prompts")
    return own.unionByName(more)


def shared_prompts(vocabulary: DataFrame) -> DataFrame:
    """Prompts that two classes claim; must be empty."""
    p = vocabulary.select("class", F.explode("prompts").alias("prompt")).select("class", tx.words(F.col("prompt")).alias("prompt"))
    return p.groupBy("prompt").agg(F.countDistinct("class").alias("classes")).where("classes > 1")
