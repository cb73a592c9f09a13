"""Best recipes for requests by shared keywords, without scoring every recipe that shares one.

A request's score for a recipe is the weight of its keywords that the recipe's text contains. Most keywords are
in many recipes, so joining requests with all recipes of a keyword grows with requests times recipes. Instead:

* A probe reads the postings of a request's rarest keywords, a bounded number, and scores the recipes that hold
  most of them. The k-th best of these scores is a floor that no recipe of the answer is below.
* A recipe that holds none of a request's rare keywords scores at most the weight of the other ones. The rarest
  keywords are taken until that bound is below the floor: every recipe of the answer is in their postings.
* What a recipe holds of the rare keywords plus the weight of the others bounds its score; only
  recipes whose bound reaches the floor are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from custlytics.functions.text import BLANK
from custlytics.operators.matching import words_in
from custlytics.operators.windows import top_within
from custlytics.session import stored

MAX_RANKED = 12
#: Postings that the probe of a request reads, besides those of its rarest keyword, and what it scores of
#: them for each recipe that may be asked for.
PROBED_POSTINGS, PROBED_PER_RANK = 1_000, 4
#: Rare keywords are taken until the weight of the others is below this part of the floor: a recipe must then hold
#: several of them, which leaves few to score for little more postings.
SLACK = 0.9
#: Characters of keywords up to which tasks get them all: an automaton of some hundred megabytes at most.
AUTOMATON_CHARACTERS = 4_000_000
ANCHOR = 3


def keywords_of(names: Column) -> Column:
    """Lower-cased words of a name: it is split at dots, underscores and white space."""
    return F.filter(F.split(F.regexp_replace(F.lower(names), "[._]", " "), f"{BLANK}+"), lambda w: w != "")


def _anchors(token: Column) -> Column:
    """All different substrings of one to three characters."""
    singles = F.split(token, "")

    def extended(pieces: Column, by: int) -> Column:
        later = F.slice(singles, by + 1, F.size(singles))
        return F.zip_with(pieces, later, lambda piece, next_one: F.concat(piece, F.coalesce(next_one, F.lit(""))))

    pairs = extended(singles, 1)
    return F.array_distinct(F.concat(singles, pairs, extended(pairs, 2)))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a small file is read by one task, which is
    right for a scan but not for what takes long by row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def recipe_keywords(keywords: DataFrame, recipes: DataFrame, most_characters: int = AUTOMATON_CHARACTERS) -> DataFrame:
    """(id, place, keys): the numbers of the keywords (keyword, number) that each recipe's text contains, ascending.
    Recipes without any are left out.

    Up to ``most_characters`` characters of keywords go to every task, which finds them all in one pass over each
    text, and no text moves. More keywords than that are joined: see :func:`_joined_keywords`.
    """
    parts = [F.coalesce("description", F.lit("")), F.coalesce("usage_context", F.lit("")), F.col("id")]
    texts = spread(recipes).select("id", "place", F.lower(F.concat_ws(" ", *parts)).alias("text"))
    characters = keywords.agg(F.sum(F.length("keyword"))).first()[0] or 0
    if characters > most_characters:
        return _joined_keywords(keywords, texts)
    words = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in keywords.select("keyword", "number").collect()])
    schema = T.StructType([*texts.schema.fields[:2], T.StructField("keys", T.ArrayType(T.LongType()))])
    return texts.mapInArrow(words_in(words, "text", "keys"), schema).filter(F.size("keys") > 0)


def _joined_keywords(keywords: DataFrame, texts: DataFrame) -> DataFrame:
    """A keyword has no white space, so it lies within one token of the text. Keywords are matched with the
    different tokens of all texts (joined on the keyword's first characters, then checked), and the
    matching tokens lead to the recipes."""
    tokens = texts.select("id", "place", F.explode(F.array_distinct(F.split("text", f"{BLANK}+"))).alias("token")).filter("token <> ''")
    vocabulary = tokens.select("token").distinct().withColumn("anchor", F.explode(_anchors(F.col("token"))))
    wanted = keywords.withColumn("anchor", F.substring("keyword", 1, ANCHOR))
    matches = vocabulary.join(wanted, "anchor").filter(F.contains("token", "keyword")).select("token", "number")
    hits = tokens.join(matches, "token").select("id", "place", "number")
    return hits.groupBy("id", "place").agg(F.sort_array(F.collect_set("number")).alias("keys"))


def _limits(weighted: DataFrame, postings: DataFrame) -> DataFrame:
    """(bag, number, weight) with, in the order of rarity, how many postings come up to a keyword (``upto``) and
    the weight from it on (``rest``)."""
    frequency = postings.groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    found = weighted.join(frequency, "number")
    rare_first = Window.partitionBy("bag").orderBy("df", "number")
    from_here = rare_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    added = {"upto": F.sum("df").over(rare_first), "nth": F.row_number().over(rare_first), "rest": F.sum("weight").over(from_here)}
    return found.withColumns(added)


def _levels(weighted: DataFrame) -> DataFrame:
    """(bag, numbers): one row with the keywords of at least weight 1, one with those of at least weight 2 and so on."""
    steps = weighted.select("bag", "number", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))).alias("step"))
    return steps.groupBy("bag", "step").agg(F.collect_list("number").alias("numbers")).drop("step")


def _scored(pairs: DataFrame, levels: DataFrame, leaders: DataFrame) -> DataFrame:
    """(bag, group, at, score) of pairs (bag, group): the weight of the bag's keywords that the group has."""
    whole = pairs.select("bag", "group").join(leaders, "group").join(levels, "bag")
    common = whole.select("bag", "group", "at", F.size(F.array_intersect("numbers", "keys")).cast("bigint").alias("common"))
    return common.groupBy("bag", "group", "at").agg(F.sum("common").alias("score"))


def best_groups(weighted: DataFrame, leaders: DataFrame, k: int, probed: int = PROBED_POSTINGS) -> DataFrame:
    """(bag, group, at, score) of the ``k`` best groups of each bag, ties by ``at``.

    ``weighted`` has (bag, number, weight), ``leaders`` (group, at, keys). Exact: see the module's text."""
    postings = leaders.select("group", F.explode("keys").alias("number"))
    limits = stored(_limits(weighted, postings))
    levels = stored(_levels(limits.select("bag", "number", "weight")))

    def held(part: DataFrame) -> DataFrame:
        return part.join(postings, "number").groupBy("bag", "group").agg(F.sum("weight").alias("held"))

    probe = top_within(held(limits.filter((F.col("upto") <= probed) | (F.col("nth") == 1))), ["bag"], ["-held", "group"], PROBED_PER_RANK * k, "_nth")
    kth = top_within(_scored(probe, levels, leaders), ["bag"], ["-score", "at"], k, "_nth").groupBy("bag")
    floor = kth.agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0).alias("floor"))
    essential = stored(limits.join(floor, "bag").filter(F.col("rest") >= SLACK * F.col("floor")))
    others = limits.groupBy("bag").agg(F.sum("weight").alias("whole")).join(essential.groupBy("bag").agg(F.sum("weight").alias("taken"), F.first("floor").alias("floor")), "bag")
    reach = held(essential).join(others, "bag").filter("held + whole - taken >= floor")
    return top_within(_scored(reach, levels, leaders), ["bag"], ["-score", "at"], k, "_nth").drop("_nth")


def rank_recipes(requests: DataFrame, recipes: DataFrame, top_k: int | None = None) -> DataFrame:
    """The recipes that contain most of a request's keywords, best first, ties in recipe order.

    ``requests`` has ``request_id`` and ``functions`` (names, split at dots, underscores and spaces; a
    repeated keyword counts each time); ``recipes`` has ``id``, ``place`` and its texts. Without ``top_k``
    each request gets twice its number of functions, but at least 3 and at most 12.

    Requests with the same keywords are ranked once, and of the recipes that contain the same keywords only
    the first ``k`` can be among anyone's best ``k``: they are one group, taken at its first recipe.
    """
    limit = top_k or MAX_RANKED
    keep = F.lit(limit) if top_k else F.greatest(F.lit(3), F.least(F.lit(MAX_RANKED), F.size("functions") * 2))
    words = F.sort_array(F.flatten(F.transform("functions", keywords_of)))
    asked = requests.select("request_id", keep.alias("_keep"), words.alias("_words")).filter(F.size("_words") > 0)
    bags = stored(asked.groupBy("_words").agg(F.min("request_id").alias("bag")))
    each = bags.select("bag", F.explode("_words").alias("keyword"))
    keywords = stored(each.select("keyword").distinct().withColumn("number", F.monotonically_increasing_id()))
    weighted = each.join(keywords, "keyword").groupBy("bag", "number").agg(F.count(F.lit(1)).alias("weight"))

    # Recipes with the same keywords are a group, known by hashes of their numbers.
    marks = [F.xxhash64(F.lit(seed), "keys").alias(f"mark{seed}") for seed in (1, 2)]
    found = recipe_keywords(keywords, recipes).select("*", *marks, F.size("keys").alias("n"))
    same = ["mark1", "mark2", "n"]
    leader = F.first("id").over(Window.partitionBy(*same).orderBy("_nth"))
    members = stored(top_within(found, same, ["place", "id"], limit, "_nth").withColumn("group", leader))
    leaders = members.filter("_nth = 1").select("group", F.col("place").alias("at"), "keys")

    groups = best_groups(weighted, leaders, limit).select("bag", "group", "score")
    best = top_within(groups.join(members.select("group", "id", "place"), "group"), ["bag"], ["-score", "place"], limit, "rank")
    ranked = asked.join(bags, "_words").join(best, "bag").filter(F.col("rank") <= F.col("_keep"))
    return ranked.select("request_id", "id", "score", "rank")
