"""Levels and cycles of dependency graphs, many graphs at once.

Both work in rounds over tables of edges, whose number grows with the logarithm of the longest chain where
functions need few others, and never exceeds the number of levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from custlytics.session import forget, stored

#: A function is replaced by what it needs if it needs at most so many others ...
FEW = 4
#: ... and whoever needs it needs at most so many.
WIDTH = 64

KEY = ["script_id", "function_name"]


def inner_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Distinct calls of another function of the same script."""
    known = functions.select("script_id", F.col("function_name").alias("depends_on")).distinct()
    others = calls.filter(F.col("function_name") != F.col("depends_on")).select(*KEY, "depends_on").distinct()
    return others.join(known, ["script_id", "depends_on"], "left_semi").join(functions.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "depends_on")


def _with_open(rows: DataFrame) -> DataFrame:
    """Rows with ``open``, how many functions are still needed."""
    rows = rows.groupBy(*KEY, "needs").agg(F.max("above").alias("above"))
    return rows.join(rows.groupBy(*KEY).agg(F.count("needs").alias("open")), KEY)


def elimination(functions: DataFrame, calls: DataFrame, few: int = FEW, width: int = WIDTH) -> tuple[DataFrame, int]:
    """(script_id, function_name, level) and the rounds it took; on and behind cycles the level is null.

    A row (function, needs, above) says that the function lies at least ``above`` levels over what it needs, or, where
    ``needs`` is null, that it has at least level ``above``. In each round every needed function that itself
    needs few others is replaced by these, so that a chain halves. A function that needs nothing is always
    replaced: each round settles at least one more function of every graph that has one to settle, and
    when no graph gains one, what is left lies on or behind cycles.
    """
    start = functions.select(*KEY).distinct().select(*KEY, F.lit(None).cast("string").alias("needs"), F.lit(0).cast("bigint").alias("above"))
    edges = calls.select(*KEY, F.col("depends_on").alias("needs"), F.lit(1).cast("bigint").alias("above"))
    rows, rounds = stored(_with_open(start.unionByName(edges))), 0
    unsettled = _unsettled(rows)
    while unsettled:
        target = rows.filter(F.col("open") <= few).groupBy("script_id", F.col("function_name").alias("needs"))
        target = target.agg(F.collect_list(F.struct(F.col("needs").alias("to"), "above")).alias("by"), F.first("open").alias("then"))
        replaced = F.col("by").isNotNull() & ((F.col("then") == 0) | (F.col("open") <= width))
        next_rows = F.transform("by", lambda r: F.struct(r["to"].alias("needs"), (r["above"] + F.col("above")).alias("above")))
        own = F.array(F.struct("needs", "above"))
        stepped = rows.join(target, ["script_id", "needs"], "left").select(*KEY, F.explode(F.when(replaced, next_rows).otherwise(own)).alias("r"))
        before, rows = rows, stored(_with_open(stepped.select(*KEY, "r.needs", "r.above")))
        forget(before)
        rounds += 1
        was, unsettled = unsettled, _unsettled(rows)
        if unsettled == was:
            break
    level = F.when(F.max("open") == 0, F.max("above")).cast("int").alias("level")
    return rows.groupBy(*KEY).agg(level), rounds


def _unsettled(rows: DataFrame) -> int:
    """Functions with open needs; each has one row without ``needs``."""
    return rows.filter("needs is null and open > 0").count()


def _least_reached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(script_id, function_name, least): the least of all functions that can be reached, by a hash of the name.

    Each round looks one edge ahead and at what the least one found so far has found: the stretch that is
    known grows by a factor, as the hash scatters the least ones over it."""
    least = stored(nodes.select(*KEY, _scattered(F.col("function_name")).alias("least")))
    mark = None
    while True:
        ahead = edges.join(least.select("script_id", F.col("function_name").alias("depends_on"), "least"), ["script_id", "depends_on"])
        known = least.unionByName(ahead.select(*KEY, "least")).groupBy(*KEY).agg(F.min("least").alias("least"))
        further = least.select("script_id", F.col("function_name").alias("_at"), F.col("least").alias("_further"))
        known = known.withColumn("_at", F.col("least.name")).join(further, ["script_id", "_at"])
        before, least = least, stored(known.select(*KEY, F.least("least", "_further").alias("least")))
        forget(before)
        now = least.agg(F.bit_xor(F.xxhash64(*KEY, "least.name"))).first()[0]
        if now == mark:
            return least
        mark = now


def _scattered(name: Column) -> Column:
    return F.struct(F.xxhash64(name).alias("hash"), name.alias("name"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(script_id, function_name, component): functions that reach each other have the same component, named by the
    least of their names.

    Functions of one colour have the same least function that they reach. Those of them that it reaches in
    turn, seen by colouring the reversed edges inside each colour, are its component. Components found go,
    the rest is coloured again.
    """
    found = None
    while True:
        colours = _least_reached(nodes, edges)
        inside = _inside(edges, colours.select(*KEY, F.col("least.name").alias("colour")))
        backward = _least_reached(nodes, inside.select("script_id", F.col("depends_on").alias("function_name"), F.col("function_name").alias("depends_on")))
        root = F.col("least.name").alias("root")
        both = colours.select(*KEY, root).join(backward.select(*KEY, F.col("least.name").alias("back")), KEY)
        both = stored(both.withColumn("done", F.col("root") == F.col("back")))
        done = both.filter("done").select(*KEY, "root")
        found = done if found is None else found.unionByName(done)
        nodes = stored(both.filter("not done").select(*KEY))
        if nodes.isEmpty():
            break
        left = nodes.select("script_id", F.col("function_name").alias("depends_on"))
        edges = stored(edges.join(nodes, KEY, "left_semi").join(left, ["script_id", "depends_on"], "left_semi").select(*KEY, "depends_on"))
    least = found.groupBy("script_id", "root").agg(F.min("function_name").alias("component"), F.count("*").alias("size"))
    return found.join(least, ["script_id", "root"]).select(*KEY, "component", "size")


def _inside(edges: DataFrame, coloured: DataFrame) -> DataFrame:
    """Edges between functions of one colour."""
    to = coloured.select("script_id", F.col("function_name").alias("depends_on"), F.col("colour").alias("_to"))
    both = edges.join(coloured, KEY).join(to, ["script_id", "depends_on"])
    return stored(both.filter(F.col("colour") == F.col("_to")).select(*KEY, "depends_on"))


def dependency_cycles(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(script_id, function_name, level, cycle_id, behind) of every function.

    ``level`` is 0 for functions that need no other function of their script, else one above what they
    need. ``cycle_id`` names the cycle that a function lies on (functions that need each other, by the least of their
    names); ``behind`` says that a function lies on none but needs one that does. Both have no level.

    Only functions between cycles and on them are searched for cycles: those that an elimination leaves
    open both along the calls and against them.
    """
    functions = functions.select(*KEY).distinct()
    calls = stored(inner_calls(functions, calls))
    levels = stored(elimination(functions, calls)[0])
    none = levels.withColumns({"cycle_id": F.lit(None).cast("string"), "behind": F.col("level").isNull()})
    behind = levels.filter("level is null").select(*KEY)
    if behind.isEmpty():
        return none
    edges = stored(_among(calls, behind))
    reverse = edges.select("script_id", F.col("depends_on").alias("function_name"), F.col("function_name").alias("depends_on"))
    core = stored(elimination(behind, reverse)[0].filter("level is null").select(*KEY))
    components = strong_components(core, stored(_among(edges, core))).filter("size > 1").select(*KEY, F.col("component").alias("cycle_id"))
    whole = levels.join(components, KEY, "left")
    return whole.select(*KEY, "level", "cycle_id", (F.col("level").isNull() & F.col("cycle_id").isNull()).alias("behind"))


def _among(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    needed = nodes.select("script_id", F.col("function_name").alias("depends_on"))
    return calls.join(nodes, KEY, "left_semi").join(needed, ["script_id", "depends_on"], "left_semi").select(*KEY, "depends_on")
