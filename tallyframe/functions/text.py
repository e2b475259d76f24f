"""Name rules, phrase resolution and colours as column expressions.

The name rules differ on purpose; each keeps its own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def class_key(c: Column, default: str | None = "unknown") -> Column:
    """Lower case, hyphens as spaces, runs of white space as one underscore."""
    out = F.replace(_squeezed(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("_"))
    return F.when(out != "", out).otherwise(F.lit(default)) if default else out


def spaced_key(c: Column) -> Column:
    """Trimmed lower case, each space an underscore, hyphens kept."""
    out = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit("_"))
    return F.when(out != "", out).otherwise(F.lit("unknown"))


def words(c: Column, joiner: str = " ") -> Column:
    """Runs of ASCII letters and digits in lower case, joined."""
    return F.replace(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "), F.lit(joiner))


def prompt_key(c: Column) -> Column:
    """Trimmed lower case, underscores as spaces, white space squeezed."""
    return _squeezed(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit(" ")))


def terms(c: Column) -> Column:
    """Parts between full stops, commas, semicolons and bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"[.,;|]+"), F.trim), lambda x: x != "")


def file_part(c: Column) -> Column:
    """Safe in a file name: other characters become underscores, none at the ends."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", ""), F.lit("")), F.lit("item"))


def token_relation(a: Column, b: Column) -> Column:
    """Of two sets of words: 1 if equal, the ratio of sizes if one holds the other, else 0."""
    a, b = F.array_distinct(F.split(words(a), " ")), F.array_distinct(F.split(words(b), " "))
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    empty = F.array_contains(a, "") | F.array_contains(b, "")
    return F.when(empty, 0.0).when(F.size(F.array_intersect(a, b)) == low, low / high).otherwise(0.0)


def guard_score(name: Column, target: Column, prompts: Column) -> Column:
    """How well a name matches a class and its prompts: 100, 95, 85 to 86, 75 to 76, 65 or 0."""
    text, own = words(name), words(target)
    asked = F.transform(prompts, lambda p: words(p))
    relation = token_relation(name, target)
    best = F.coalesce(F.array_max(F.transform(prompts, lambda p: token_relation(name, p))), F.lit(0.0))
    near = F.exists(
        F.concat(F.array(own), asked),
        lambda c: (F.least(F.length(text), F.length(c)) >= 5) & (F.contains(c, text) | F.contains(text, c)),
    )
    return (
        F.when(text == own, 100.0)
        .when(F.array_contains(asked, text), 95.0)
        .when(relation > 0, 85 + relation)
        .when(best > 0, 75 + best)
        .when(near, 65.0)
        .otherwise(0.0)
    )


def best_guard(names: DataFrame, specs: DataFrame) -> DataFrame:
    """(name, class, score): the one best class of each name; none if several are equally good."""
    scored = names.crossJoin(specs).withColumn("score", guard_score(F.col("name"), F.col("class"), F.col("prompts"))).where("score > 0")
    top = scored.withColumn("best", F.max("score").over(Window.partitionBy("name"))).where("score = best")
    return top.groupBy("name").agg(F.count("*").alias("n"), F.min("class").alias("class"), F.max("score").alias("score")).where("n = 1").drop("n")


def resolved_phrases(phrases: DataFrame, prompts: DataFrame) -> DataFrame:
    """(phrase, class): by whole-word prompts, those inside a longer matched one left aside; if none matches, by the
    largest share of a prompt's words that the phrase has; 'unknown' unless one class is left.

    ``prompts`` is a small dimension (class, prompt).
    """
    p = phrases.select("phrase").distinct().withColumn("text", words(F.col("phrase")))
    p = p.withColumn("tokens", F.array_distinct(F.split("text", " ")))
    q = prompts.select("class", words(F.col("prompt")).alias("asked")).where("asked <> ''").withColumn("own", F.array_distinct(F.split("asked", " ")))
    j = p.join(q, F.lit(True), "left")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    j = j.withColumn("whole", F.contains(pad(F.col("text")), pad(F.col("asked"))))
    inside = (F.size(F.array_except("tokens", "own")) == 0) & (F.size("tokens") < F.size("own")) & (F.col("text") != "")
    j = j.withColumn("partial", F.when(inside, F.size("tokens") / F.size("own")))
    found = j.groupBy("phrase").agg(
        F.collect_list(F.when(F.col("whole"), F.struct("class", "own"))).alias("hits"),
        F.collect_list(F.when(F.col("partial").isNotNull(), F.struct("partial", "class"))).alias("parts"),
    )
    longest = F.filter(
        "hits",
        lambda h: ~F.exists("hits", lambda o: (F.size(F.array_except(h.own, o.own)) == 0) & (F.size(h.own) < F.size(o.own))),
    )
    exact = F.array_distinct(F.transform(longest, lambda h: h["class"]))
    best = F.array_max(F.transform("parts", lambda x: x.partial))
    near = F.array_distinct(F.transform(F.filter("parts", lambda x: x.partial == best), lambda x: x["class"]))
    one = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))).otherwise(F.lit("unknown"))
    return found.select("phrase", F.when(F.size("hits") > 0, one(exact)).otherwise(one(near)).alias("class"))


def hsv_channel(h: Column, s: Column, v: Column, n: int) -> Column:
    """Red, green or blue (n = 5, 3, 1) of a colour with hue, saturation and value in [0, 1]."""
    k = F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))
    return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))


def digest_byte(digest: Column, at: int, size: int = 1) -> Column:
    """Number in some bytes of a hexadecimal digest."""
    return F.conv(F.substring(digest, 2 * at + 1, 2 * size), 16, 10).cast("double")


def class_colour(name: Column) -> list[Column]:
    """A colour that depends on the class's key alone: hue, saturation and value from its digest."""
    digest = F.sha2(class_key(name), 256)
    h = digest_byte(digest, 0, 2) / 65535.0
    s = F.lit(0.68) + digest_byte(digest, 2) / 255.0 * 0.22
    v = F.lit(0.78) + digest_byte(digest, 3) / 255.0 * 0.18
    return [hsv_channel(h, s, v, n) for n in (5, 3, 1)]


#: Fixed value: the constant of the zeroth spherical harmonic.
SH_C0 = 0.28209479177387814


def sh_dc(channel: Column) -> Column:
    return (channel - 0.5) / SH_C0
