"""Names, phrases, colours and nested data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as op
from ..sources.encodings import table
from .registry import query

RAW = "raw AS (SELECT p_partkey AS k, '  ' || p_type || '-' || p_name || '_' || (p_partkey % 7) || '  ' AS s FROM part)"


def _raw(spark, d):
    s = F.concat(F.lit("  "), "p_type", F.lit("-"), "p_name", F.lit("_"), F.pmod("p_partkey", F.lit(7)), F.lit("  "))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), s.alias("s"))


@query(
    "STR1 STR2 STR3 STR4 STR5 STR6 STR7 STR8 STR17",
    f"""WITH {RAW} SELECT k, coalesce(nullif(replace(trim(regexp_replace(replace(lower(s), '-', ' '), '\\s+', ' ', 'g')), ' ', '_'), ''), 'unknown') AS class_key,
  replace(lower(trim(s)), ' ', '_') AS spaced_key, replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), ' ', '_') AS joined, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS words,
  trim(regexp_replace(replace(lower(s), '_', ' '), '\\s+', ' ', 'g')) AS prompt_key, regexp_replace(regexp_replace(s, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS file_part FROM raw""",
)
def name_normalisers(spark, d):
    s = F.col("s")
    return _raw(spark, d).select(
        "k",
        op.class_key(s).alias("class_key"),
        op.spaced_key(s).alias("spaced_key"),
        op.words(s, "_").alias("joined"),
        op.words(s).alias("words"),
        op.prompt_key(s).alias("prompt_key"),
        op.file_part(s).alias("file_part"),
    )


@query("STR9 SRC17", "SELECT p_type AS kind, len(list_filter(list_transform(regexp_split_to_array(p_type || '. ' || p_brand || ' ;; ' || p_type || '|', '[.,;|]+'), lambda x: trim(x)), lambda x: x <> ''))::INT AS n, count(*) AS rows_of FROM part GROUP BY ALL")
def prompt_terms(spark, d):
    s = F.concat("p_type", F.lit(". "), "p_brand", F.lit(" ;; "), "p_type", F.lit("|"))
    return table(spark, d, "part").groupBy(F.col("p_type").alias("kind"), F.size(op.terms(s)).alias("n")).agg(F.count("*").alias("rows_of"))


PROMPTS = [("piano", "piano"), ("guitar", "guitar"), ("guitar", "acoustic guitar"), ("indoor_plant", "indoor plant"), ("indoor_plant", "potted plant"), ("chair", "chair"), ("chair", "armchair"), ("sofa", "sofa"), ("sofa", "couch"), ("television", "television"), ("television", "tv"), ("media_console", "television stand"), ("media_console", "entertainment center"), ("table", "table"), ("table", "desk"), ("speaker", "speaker"), ("speaker", "floor speaker"), ("floor", "floor")]
PHRASES = [("wooden chair", "chair"), ("acoustic", "guitar"), ("indoor", "indoor_plant"), ("wardrobe", "unknown"), ("chair armchair sofa couch", "unknown"), ("television stand table desk", "unknown"), ("floor speaker", "speaker"), ("television stand", "media_console"), ("", "unknown")]


@query("STR10", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}')" for p, c in PHRASES) + ") t(phrase, class)")
def phrase_to_class(spark, d):
    phrases = spark.createDataFrame([(p,) for p, _ in PHRASES], "phrase string")
    return op.resolved_phrases(phrases, spark.createDataFrame(PROMPTS, "class string, prompt string"))


@query(
    "STR10 JN11",
    """WITH k AS (SELECT DISTINCT p_type FROM part), q AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS asked FROM part)
SELECT p_type AS phrase, CASE WHEN count(asked) = 1 THEN min(asked) ELSE 'unknown' END AS class FROM k LEFT JOIN q ON contains(' ' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || asked || ' ') GROUP BY 1""",
)
def part_types_to_class(spark, d):
    kinds = table(spark, d, "part").select("p_type").distinct()
    first = F.lower(F.split("p_type", " ")[0])
    return op.resolved_phrases(kinds.select(F.col("p_type").alias("phrase")), kinds.select(first.alias("class"), first.alias("prompt")).distinct())


@query("STR11 STR12 JN11", "SELECT * FROM (VALUES ('armchair', 'chair', 95.0::DOUBLE), ('guitar', 'guitar', 100.0), ('floor lamp', 'floor', 85.5), ('center', 'media_console', 75.5), ('speakers', 'speaker', 65.0)) t(name, class, score)")
def guard_matches(spark, d):
    specs = spark.createDataFrame(PROMPTS, "class string, prompt string").groupBy("class").agg(F.collect_list("prompt").alias("prompts"))
    names = spark.createDataFrame([("armchair",), ("guitar",), ("floor lamp",), ("center",), ("speakers",), ("zebra",)], "name string")
    return op.best_guard(names, specs)


@query("STR13 STR16 CHK14", "WITH w AS (SELECT DISTINCT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS p FROM part) SELECT count(*) AS prompts, CAST(sum(len(string_split(p, ' '))) AS BIGINT) AS words FROM w")
def prompt_budget(spark, d):
    p = table(spark, d, "part").select(op.words(F.col("p_type")).alias("p")).where("p <> ''").distinct()
    return p.agg(F.count("*").alias("prompts"), F.sum(F.size(F.split("p", " "))).alias("words"))


@query("STR14 AGG24 TOP11", "WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY ALL) SELECT p_brand AS brand, string_agg(p_type, ' . ' ORDER BY first) AS prompt FROM f GROUP BY 1")
def joined_prompts(spark, d):
    first = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "p_type"))), lambda x: x.p_type)
    return first.groupBy(F.col("p_brand").alias("brand")).agg(F.array_join(ordered, " . ").alias("prompt"))


@query("STR15 STR19", "SELECT * FROM (VALUES ('window', 16), ('door', 18)) t(name, id)")
def name_id_map(spark, d):
    m = spark.createDataFrame([("window=16, door=18",)], "s string").select(F.explode(F.expr("str_to_map(s, ', ?', '=')")).alias("name", "id"))
    return m.select("name", F.col("id").cast("int").alias("id"))


@query("STR18", "SELECT s_suppkey AS observer, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || '_cam' || lpad(CAST(s_nationkey AS VARCHAR), 4, '0') || '.png' AS file FROM supplier")
def observer_files(spark, d):
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("observer"), F.format_string("%05d_cam%04d.png", F.col("s_suppkey"), F.col("s_nationkey")).alias("file")
    )


@query("STR20", "SELECT replace(t, '{}', lower(r_name)) AS prompt FROM region, (VALUES ('a photo of {}'), ('{} in a room')) v(t)")
def template_prompts(spark, d):
    t = spark.createDataFrame([("a photo of {}",), ("{} in a room",)], "t string")
    return table(spark, d, "region").crossJoin(F.broadcast(t)).select(F.replace("t", F.lit("{}"), F.lower("r_name")).alias("prompt"))


@query("STR22", "SELECT n_nationkey AS k, CAST(n_nationkey // 10 AS INT) AS major, CAST(n_nationkey % 10 AS INT) AS minor FROM nation")
def version_parts(spark, d):
    v = F.concat(F.lit("v"), F.expr("n_nationkey div 10"), F.lit("."), F.pmod("n_nationkey", F.lit(10)), F.lit(".dev"))
    n = table(spark, d, "nation").withColumn("v", v)
    return n.select(F.col("n_nationkey").alias("k"), *(F.regexp_extract("v", r"(\d+)\.(\d+)", i + 1).cast("int").alias(c) for i, c in enumerate(("major", "minor"))))


@query("STR23 JSN3", "SELECT event_id, CAST(coalesce(TRY_CAST(json_extract_string(props, '$.confidence') AS DOUBLE), TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS DOUBLE) AS score FROM events")
def first_score(spark, d):
    p = F.from_json("props", "confidence string, k string")
    pick = F.coalesce(p["confidence"].try_cast("double"), p["k"].try_cast("double"), F.lit(0.0))
    return table(spark, d, "events").select("event_id", pick.alias("score"))


@query("JSN2 TOP11", "WITH f AS (SELECT role, min(conv_id * 1000 + turn) AS p FROM conversations GROUP BY 1) SELECT role, CAST(row_number() OVER (ORDER BY p, role) AS INT) AS place FROM f")
def first_seen_classes(spark, d):
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    flat = nested.select("conv_id", F.posexplode("turns").alias("at", "t")).select("conv_id", "t.turn", "t.role")
    first = flat.groupBy("role").agg(F.min(F.struct("conv_id", "turn")).alias("p"))
    return first.select("role", F.row_number().over(Window.orderBy("p", "role")).alias("place"))


COLOUR = """dg AS (SELECT r_name, sha256(replace(trim(regexp_replace(replace(lower(r_name), '-', ' '), '\\s+', ' ', 'g')), ' ', '_')) AS g FROM region),
hsv AS (SELECT r_name, CAST(('0x' || g[1:4]) AS BIGINT) / 65535.0 AS h, 0.68 + CAST(('0x' || g[5:6]) AS BIGINT) / 255.0 * 0.22 AS s, 0.78 + CAST(('0x' || g[7:8]) AS BIGINT) / 255.0 * 0.18 AS v FROM dg),
rgb AS (SELECT r_name, {channels} FROM hsv)""".replace(
    "{channels}",
    ", ".join(f"v - v * s * greatest(0, least(fmod({n} + h * 6, 6), 4 - fmod({n} + h * 6, 6), 1)) AS {c}" for n, c in ((5, "r"), (3, "g"), (1, "b"))),
)


@query("HSH3 HSH4 HSH5", f"WITH {COLOUR} SELECT r_name AS name, CAST(round(r, 6) AS DOUBLE) AS r, CAST(round(g, 6) AS DOUBLE) AS g, CAST(round(b, 6) AS DOUBLE) AS b FROM rgb")
def class_colours(spark, d):
    rgb = op.class_colour(F.col("r_name"))
    return table(spark, d, "region").select(F.col("r_name").alias("name"), *(F.round(x, 6).alias(n) for x, n in zip(rgb, "rgb", strict=True)))


@query("HSH6", "SELECT CAST(i AS BIGINT) AS i, round(fmod(i * 0.61803398875, 1.0), 6)::DOUBLE AS hue FROM range(12) t(i)")
def instance_hues(spark, d):
    return spark.range(12).select(F.col("id").alias("i"), F.round(F.pmod(F.col("id") * F.lit(0.61803398875), F.lit(1.0)), 6).alias("hue"))


@query("HSH7 SNK4", f"WITH {COLOUR} SELECT r_name AS name, CAST(round((r - 0.5) / {op.SH_C0}, 6) AS DOUBLE) AS dc FROM rgb")
def harmonic_colours(spark, d):
    return table(spark, d, "region").select(F.col("r_name").alias("name"), F.round(op.sh_dc(op.class_colour(F.col("r_name"))[0]), 6).alias("dc"))


@query("AGG25", f"WITH {COLOUR} SELECT r_regionkey % 2 AS colour_key, string_agg(r_name, ',' ORDER BY r_name) AS names, count(*) AS n FROM region GROUP BY 1")
def colour_legend(spark, d):
    return table(spark, d, "region").groupBy(F.pmod("r_regionkey", F.lit(2)).alias("colour_key")).agg(
        F.array_join(F.sort_array(F.collect_list("r_name")), ",").alias("names"), F.count("*").alias("n")
    )
