"""Queries on script corpora, recipes, reviews, model responses and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from custlytics.functions import fixed_values as fixed
from custlytics.operators import corpus, dependencies
from custlytics.plans.registry import query
from custlytics.session import scratch_path
from custlytics.sources import writers
from custlytics.sources.scripts import SCRIPTS_SQL, scripts
from custlytics.sources.tables import table, with_sql

S_SQL = with_sql(SCRIPTS_SQL)


@query(
    S_SQL
    + """,
found as (
  select script_id, 0 as position, 'load_' || script_id as function_name, header_lines + 1 as start_line,
         header_lines + text_lines + 2 as end_line,
         'def load_' || script_id || '(path):' || chr(10) || comments || chr(10) || '    return path' as source
  from scripts where source <> 'src7'
  union all
  select script_id, 1, 'main_' || script_id, header_lines + text_lines + 5, header_lines + text_lines + 8,
         'def main_' || script_id || '(path):' || chr(10) || '    def step(x):' || chr(10) || '        return x' || chr(10)
         || '    return step(load_' || script_id || '(path))'
  from scripts where source <> 'src7'
  union all
  select script_id, 2, 'step', header_lines + text_lines + 6, header_lines + text_lines + 7,
         '    def step(x):' || chr(10) || '        return x'
  from scripts where source <> 'src7'
  union all
  select script_id, 0, null, 1, length(content) - length(replace(content, chr(10), '')) + 1, content
  from scripts where source = 'src7')
select script_id, position, function_name, cast(start_line as integer) as start_line,
       cast(end_line as integer) as end_line, source from found"""
)
def extract_functions(spark, sf_dir):
    return corpus.extract_functions(scripts(spark, sf_dir))


IMPORTS_SQL = (
    S_SQL
    + """,
statements as (
  select script_id, 0 as position, 'import os' as statement, 'os' as module, 'standard_libs' as kind
  from scripts where source <> 'src7'
  union all
  select script_id, 1, 'from pyspark.sql import DataFrame', 'pyspark.sql', 'third_party'
  from scripts where source <> 'src7'
  union all
  select script_id, 2, trim(extra, chr(10)),
         case lang when 'fr' then 'utils.helper' when 'de' then 'requests' else 'common.io' end,
         case lang when 'de' then 'third_party' else 'custom_modules' end
  from scripts where source <> 'src7' and extra <> '')
"""
)


@query(IMPORTS_SQL + "select * from statements")
def import_inventory(spark, sf_dir):
    return corpus.import_inventory(scripts(spark, sf_dir))


TRIAGE_SQL = (
    IMPORTS_SQL
    + """,
decided as (
  select script_id, string_agg(statement, '; ' order by position) as dependencies,
         string_agg(case when contains(statement, 'requests') then statement end, '; ' order by position) as blocking,
         string_agg(case when contains(statement, 'utils.') or contains(statement, 'common.') then statement end, '; '
                    order by position) as own
  from statements group by script_id
  union all
  select script_id, '', null, null from scripts where source = 'src7'),
triaged as (
  select script_id, dependencies,
         case when blocking is not null then 'ABORT_AND_FLAG' when own is not null then 'PROCEED_AND_ANNOTATE'
              else 'PROCEED_AND_MIGRATE' end as action,
         coalesce(blocking, own, '') as details
  from decided)
"""
)


def _triaged(spark, sf_dir):
    return corpus.triage(corpus.with_dependencies(scripts(spark, sf_dir)))


@query(TRIAGE_SQL + "select * from triaged")
def triage(spark, sf_dir):
    return _triaged(spark, sf_dir).select(
        "script_id",
        F.array_join("dependencies", "; ").alias("dependencies"),
        "action",
        F.array_join("details", "; ").alias("details"),
    )


@query(
    TRIAGE_SQL
    + """
select script_id,
       case action when 'PROCEED_AND_ANNOTATE' then
         replace(content, details,
                 '# MIGRATION TOOL WARNING: Manual check required for the following custom import.' || chr(10)
                 || '# Please ensure the module ''' || case lang when 'fr' then 'utils.helper' else 'common.io' end
                 || ''' is available in the target environment' || chr(10)
                 || '# and its internal logic is compatible.' || chr(10) || details)
       else content end as content
from triaged join scripts using (script_id)"""
)
def annotate_imports(spark, sf_dir):
    annotated = corpus.annotate_imports(F.col("content"), F.col("details"))
    noted = F.when(F.col("action") == fixed.ANNOTATE, annotated).otherwise(F.col("content"))
    return _triaged(spark, sf_dir).select("script_id", noted.alias("content"))


@query(
    TRIAGE_SQL
    + """
select script_id,
       chr(10) || '# ' || repeat('#', 78) || chr(10)
       || '# ### MIGRATION SKIPPED: MANUAL INTERVENTION REQUIRED                          ###' || chr(10)
       || '# ' || repeat('#', 78) || chr(10) || '#' || chr(10) || '# REASON: ' || details || chr(10) || '#' || chr(10)
       || '# The following PySpark function could not be automatically migrated.' || chr(10)
       || '# Please review the code and manually convert it to its target equivalent.' || chr(10) || '#' || chr(10)
       || '# --- ORIGINAL PYSPARK CODE ---' || chr(10) || '#' || chr(10) || '''''''' || chr(10) || content || chr(10)
       || '''''''' || chr(10) as stub
from triaged join scripts using (script_id) where action = 'ABORT_AND_FLAG'"""
)
def manual_stub(spark, sf_dir):
    stopped = _triaged(spark, sf_dir).filter(F.col("action") == fixed.ABORT)
    stub = corpus.manual_stub(F.col("details")[0], F.col("content"))
    return stopped.select("script_id", stub.alias("stub"))


def _turn_functions(spark, sf_dir):
    """Each conversation is a script and each of its turns a function."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("script_id"),
        F.concat(F.lit("turn_"), F.col("turn").cast("string")).alias("function_name"),
        "turn",
    )


def _turn_calls(spark, sf_dir):
    """A turn calls the one before it, the one half as far on, and a function from elsewhere."""
    turn = F.col("turn")
    needs = F.array_compact(
        F.array(
            F.when(turn > 0, F.concat(F.lit("turn_"), (turn - 1).cast("string"))),
            F.when(turn > 0, F.concat(F.lit("turn_"), F.floor(turn / 2).cast("string"))),
            F.lit("outside"),
        )
    )
    return _turn_functions(spark, sf_dir).select("script_id", "function_name", F.explode(needs).alias("depends_on"))


ORDER_SQL = """
with recursive functions as (
  select conv_id as script_id, 'turn_' || turn as function_name, turn from conversations
),
calls as (
  select script_id, function_name, 'turn_' || (turn - 1) as depends_on from functions where turn > 0
  union select script_id, function_name, 'turn_' || (turn // 2) from functions where turn > 0
),
levels as (
  select script_id, function_name, 0 as level from functions
  union
  select c.script_id, c.function_name, l.level + 1
  from levels l join calls c on c.script_id = l.script_id and c.depends_on = l.function_name
),
ordered as (
  select script_id, function_name, max(level) as level,
         row_number() over (partition by script_id order by max(level), function_name) as place
  from levels group by script_id, function_name)
"""


@query(ORDER_SQL + "select script_id, function_name, cast(level as integer) as level, cast(place as bigint) as place from ordered")
def conversion_order(spark, sf_dir):
    return corpus.conversion_order(_turn_functions(spark, sf_dir), _turn_calls(spark, sf_dir))


@query(
    """
with recursive turns as (select distinct conv_id as script_id, turn from conversations),
calls as (
  select distinct c.* from (
    select script_id, turn, turn - 1 as needed from turns
    union all select script_id, 1, 2 from turns where script_id % 3 = 0 and turn = 1
    union all select script_id, 4, 6 from turns where script_id % 5 = 0 and turn = 4) c
  join turns t on t.script_id = c.script_id and t.turn = c.needed),
reach as (
  select script_id, turn, needed from calls
  union select r.script_id, r.turn, c.needed from reach r join calls c on c.script_id = r.script_id and c.turn = r.needed),
cycles as (
  select a.script_id, a.turn, min('turn_' || a.needed) as cycle_id
  from reach a join reach b on a.script_id = b.script_id and a.turn = b.needed and a.needed = b.turn group by a.script_id, a.turn),
behind as (
  select distinct r.script_id, r.turn from reach r join cycles c on c.script_id = r.script_id and c.turn = r.needed
  where (r.script_id, r.turn) not in (select (script_id, turn) from cycles)),
levels as (
  select script_id, turn, 0 as level from turns
  union select c.script_id, c.turn, l.level + 1 from levels l join calls c on c.script_id = l.script_id and c.needed = l.turn
  where l.level < 100)
select t.script_id, 'turn_' || t.turn as function_name, cycle_id, b.turn is not null as behind,
       case when cycle_id is null and b.turn is null then cast(max(level) as integer) end as level
from turns t left join cycles c using (script_id, turn) left join behind b on b.script_id = t.script_id and b.turn = t.turn
join levels l on l.script_id = t.script_id and l.turn = t.turn group by t.script_id, t.turn, cycle_id, b.turn"""
)
def dependency_cycles(spark, sf_dir):
    """A turn needs the one before it; in some conversations turn 1 also needs turn 2, in some turn 4 turn 6."""
    turns = _turn_functions(spark, sf_dir)
    script, turn = F.col("script_id"), F.col("turn")
    needs = F.array_compact(F.array(turn - 1, F.when((script % 3 == 0) & (turn == 1), 2), F.when((script % 5 == 0) & (turn == 4), 6)))
    calls = turns.select("script_id", "function_name", F.explode(needs).alias("needed"))
    calls = calls.select("script_id", "function_name", F.concat(F.lit("turn_"), F.col("needed").cast("string")).alias("depends_on"))
    return dependencies.dependency_cycles(turns, calls)


@query(
    """
with listing as (select conv_id as script_id, 'turn_' || turn as function_name, turn as position, role from conversations),
proposed as (
  select script_id, function_name, 100 - position as place from listing where role = 'assistant'
  union all
  select script_id, 'missing', position from listing where role = 'system')
select script_id, function_name, place from proposed where function_name <> 'missing'
union all
select script_id, function_name, position from listing where script_id not in (select script_id from proposed)"""
)
def processing_order(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    listing = _turn_functions(spark, sf_dir).withColumnRenamed("turn", "position")
    proposed = turns.filter(F.col("role").isin("assistant", "system")).select(
        F.col("conv_id").alias("script_id"),
        F.when(F.col("role") == "system", "missing")
        .otherwise(F.concat(F.lit("turn_"), F.col("turn").cast("string")))
        .alias("function_name"),
        F.when(F.col("role") == "system", F.col("turn")).otherwise(100 - F.col("turn")).alias("place"),
    )
    return corpus.processing_order(proposed, listing)


# --- recipes ---


def _recipes(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        F.concat_ws(".", F.lit("recipe"), F.col("source"), F.col("doc_id").cast("string")).alias("id"),
        F.col("doc_id").alias("place"),
        F.col("text").alias("description"),
        F.col("lang").alias("usage_context"),
    )


RECIPES_SQL = """
recipes as (
  select 'recipe.' || source || '.' || doc_id as id, doc_id as place, text as description, lang as usage_context
  from documents)"""


@query(
    with_sql(RECIPES_SQL)
    + r""",
requests as (
  select item_id as request_id, string_split(text, ' ') as functions from benchmark),
words as (
  select request_id, greatest(3, least(12, len(functions) * 2)) as keep,
         unnest(string_split_regex(regexp_replace(lower(array_to_string(functions, ' ')), '[._]', ' ', 'g'), '\s+')) as keyword
  from requests),
weighted as (select request_id, keep, keyword, count(*) as weight from words where keyword <> '' group by all),
texts as (select id, place, lower(description || ' ' || usage_context || ' ' || id) as body from recipes),
hits as (
  select keyword, id, place from (select distinct keyword from weighted) join texts on contains(body, keyword)),
scored as (
  select request_id, keep, id, place, sum(weight) as score from weighted join hits using (keyword) group by all),
ranked as (select *, row_number() over (partition by request_id order by score desc, place) as rank from scored)
select request_id, id, cast(score as bigint) as score, cast(rank as integer) as rank from ranked where rank <= keep"""
)
def recipe_rank(spark, sf_dir):
    requests = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("request_id"), F.split("text", " ").alias("functions")
    )
    return corpus.rank_recipes(requests, _recipes(spark, sf_dir))


@query(
    with_sql(RECIPES_SQL)
    + """,
asked as (
  select doc_id as request_id, unnest(['recipe.' || source || '.' || doc_id, 'recipe.missing',
                                       'recipe.src1.' || (doc_id + 1), 'recipe.' || source || '.' || doc_id]) as id,
         generate_subscripts([1, 2, 3, 4], 1) - 1 as place
  from documents)
select request_id, cast(asked.place as integer) as place, id, description from asked join recipes using (id)"""
)
def recipe_lookup(spark, sf_dir):
    own = F.concat_ws(".", F.lit("recipe"), F.col("source"), F.col("doc_id").cast("string"))
    other = F.concat(F.lit("recipe.src1."), (F.col("doc_id") + 1).cast("string"))
    requests = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), F.array(own, F.lit("recipe.missing"), other, own).alias("recipe_ids")
    )
    found = corpus.lookup_recipes(requests, _recipes(spark, sf_dir).drop("place"))
    return found.select("request_id", "place", "id", "description")


@query(
    """
with listed as (
  select doc_id, 0 as slot, 'recipe.' || source || '.' || lang as id, text as description, lang as usage_context from documents
  union all
  select doc_id, 2, 'recipe.' || source, text, source from documents where lang <> 'en'),
numbered as (
  select *, row_number() over (partition by id order by doc_id desc, slot desc) as newest,
         min(doc_id) over (partition by id) as first_file from listed)
select id, first_file, description, usage_context, 'run_' || doc_id as code,
       '{"n":' || doc_id || ',"tags":["a","' || usage_context || '"]}' as notes
from numbered where newest = 1"""
)
def load_recipes(spark, sf_dir):
    def recipe(identifier, context):
        return F.struct(
            identifier.alias("id"), F.col("text").alias("description"), F.col(context).alias("usage_context"),
            F.concat(F.lit("run_"), F.col("doc_id").cast("string")).alias("code"),
            F.struct(F.col("doc_id").alias("n"), F.array(F.lit("a"), F.col(context)).alias("tags")).alias("notes"),
        )

    own = recipe(F.concat_ws(".", F.lit("recipe"), F.col("source"), F.col("lang")), "lang")
    nameless = recipe(F.lit(None).cast("string"), "lang")
    shared = recipe(F.concat_ws(".", F.lit("recipe"), F.col("source")), "source")
    text = F.when(F.col("lang") == "en", F.to_json(own)).otherwise(F.to_json(F.array(own, nameless, shared)))
    files = table(spark, sf_dir, "documents").select("doc_id", text.alias("json"))
    loaded = corpus.parse_recipes(files, "doc_id", "json")
    further = [F.col("fields")[name].alias(name) for name in ("code", "notes")]
    return loaded.select("id", F.col("place.doc_id").alias("first_file"), "description", "usage_context", *further)


@query("select doc_id from documents where not json_valid(case when lang = 'en' then '{\"id\": 1}' else text end)")
def broken_recipes(spark, sf_dir):
    text = F.when(F.col("lang") == "en", F.lit('{"id": 1}')).otherwise(F.col("text"))
    files = table(spark, sf_dir, "documents").select("doc_id", text.alias("json"))
    return corpus.broken_recipes(files, "json").select("doc_id")


@query(
    r"""
with ids as (select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as id from pages)
select split_part(id, '.', 1) || '.' || split_part(id, '.', 2) as namespace, count(*) as patterns
from ids where contains(id, '.') group by 1"""
)
def pattern_counts(spark, sf_dir):
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    functions = table(spark, sf_dir, "pages").select(F.array(host).alias("suggested_patterns"))
    return corpus.pattern_counts(functions)


# --- reviews ---


def _reviews(spark, sf_dir):
    """A report on each turn: users' are perfect, assistants' have two findings, the system's has no known status."""
    turns = table(spark, sf_dir, "conversations")
    opening = F.substring_index("text", " ", 1)
    finding = [
        F.struct(
            F.lit(category).alias("category"),
            faulty.alias("faulty_code_snippet"),
            F.lit("wording").alias("issue_description"),
            better.alias("suggested_correction"),
        )
        for category, faulty, better in (
            ("STYLE_ISSUE", opening, F.concat(opening, F.lit("!"))),
            ("API_MISUSE", F.lit(" "), F.lit("_")),
        )
    ]
    status = (
        F.when(F.col("role") == "user", "PERFECT").when(F.col("role") == "assistant", "NEEDS_REFINEMENT").otherwise("DONE")
    )
    findings = F.when(F.col("role") != "user", F.array(*finding)).otherwise(F.array().cast("array<struct<category:string,faulty_code_snippet:string,issue_description:string,suggested_correction:string>>"))
    report = F.struct(
        F.struct(status.alias("status"), F.lit("checked").alias("summary")).alias("overall_assessment"),
        findings.alias("findings"),
    )
    raw = turns.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("report_id"),
        F.col("text").alias("code"),
        F.to_json(report).alias("report"),
    )
    return corpus.parse_reviews(raw)


REVIEWS_SQL = """
with reviews as (
  select conv_id || '/' || turn as report_id, text as code, split_part(text, ' ', 1) as opening,
         case role when 'user' then 'PERFECT' when 'assistant' then 'NEEDS_REFINEMENT' else 'DONE' end as status
  from conversations)
"""


@query(
    REVIEWS_SQL
    + """
select report_id, status, 0 as place, 'STYLE_ISSUE' as category, opening as faulty_code_snippet,
       'wording' as issue_description, opening || '!' as suggested_correction
from reviews where status = 'NEEDS_REFINEMENT'
union all
select report_id, status, 1, 'API_MISUSE', ' ', 'wording', '_' from reviews where status = 'NEEDS_REFINEMENT'"""
)
def review_findings(spark, sf_dir):
    return corpus.review_findings(_reviews(spark, sf_dir))


@query(
    REVIEWS_SQL
    + """
select status, category, count(*) as findings
from reviews, (values ('STYLE_ISSUE'), ('API_MISUSE')) v(category)
where status = 'NEEDS_REFINEMENT' group by status, category"""
)
def review_summary(spark, sf_dir):
    return corpus.review_summary(_reviews(spark, sf_dir))


@query(REVIEWS_SQL + "select report_id, status from reviews where status = 'DONE'")
def invalid_reviews(spark, sf_dir):
    return corpus.invalid_reviews(_reviews(spark, sf_dir)).select("report_id", "status")


@query(
    REVIEWS_SQL
    + """
select report_id, case when status = 'PERFECT' then code
                       else replace(replace(code, opening, opening || '!'), ' ', '_') end as corrected_code
from reviews where status <> 'DONE'"""
)
def apply_corrections(spark, sf_dir):
    return corpus.apply_corrections(_reviews(spark, sf_dir)).select("report_id", "corrected_code")


# --- responses ---


@query(
    r"""
with responses as (
  select conv_id, turn, turn % 5 as form, text, '{"text":' || cast(to_json(text) as varchar) || '}' as body
  from conversations)
select conv_id, turn, case when form = 4 then null else body end as json from responses"""
)
def response_json(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct("text"))
    fence = F.lit("```")
    form = F.col("turn") % 5
    response = (
        F.when(form == 0, F.concat(F.lit("\n "), body, F.lit(" \n")))
        .when(form == 1, F.concat(F.lit("Here:\n"), fence, F.lit("json\n"), body, F.lit("\n"), fence, F.lit("\nDone.")))
        .when(form == 2, F.concat(fence, F.lit("\nnone\n"), fence, F.lit(" or "), fence, body, fence))
        .when(form == 3, F.concat(F.lit("The answer is "), body, F.lit(" as asked")))
        .otherwise(F.concat(F.lit("{broken "), F.col("text")))
    )
    return turns.select("conv_id", "turn", corpus.response_json(response).alias("json"))


@query(
    r"""
with lines as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as place,
         rtrim(unnest(string_split(text, chr(10))), ' ') as line
  from documents),
spans as (select doc_id, min(place) filter (line <> '') as first, max(place) filter (line <> '') as last from lines group by doc_id)
select doc_id, string_agg(line, chr(10) order by place) as code
from lines join spans using (doc_id) where place between first and last group by doc_id"""
)
def strip_fence(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    opening = F.when(F.col("lang") == "en", "\n```python\n").when(F.col("lang") == "fr", "```\n").otherwise("")
    closing = F.when(F.col("lang") == "es", "").otherwise("  \n\n```\n ")
    fenced = F.concat(opening, F.replace("text", F.lit("\n"), F.lit(" \t\n")), closing)
    return documents.select("doc_id", corpus.strip_fence(fenced).alias("code"))


# --- analysis and artifacts ---


@query(
    """
with names as (
  select distinct conv_id as script_id, unnest(['user', 'assistant', 'tool']) as function_name from conversations),
first as (
  select conv_id as script_id, role as function_name, turn as position, text as purpose from conversations
  qualify row_number() over (partition by conv_id, role order by turn) = 1)
select script_id, function_name, position, purpose from names left join first using (script_id, function_name)"""
)
def analysis_lookup(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    analysis = turns.select(
        F.col("conv_id").alias("script_id"),
        F.col("role").alias("function_name"),
        F.col("turn").alias("position"),
        F.col("text").alias("purpose"),
    )
    names = (
        turns.select(F.col("conv_id").alias("script_id"))
        .distinct()
        .withColumn("function_name", F.explode(F.array(*[F.lit(n) for n in ("user", "assistant", "tool")])))
    )
    return corpus.analysis_lookup(names, analysis)


def _artifacts(spark, sf_dir):
    """The files of a conversation's function: one per turn, in the order they are made; turns beyond the
    known files have files of their own."""
    files = F.array(*[F.lit(name) for name in fixed.ARTIFACTS_DUAL_TRACK])
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("fn_"), F.col("conv_id").cast("string")).alias("function_name"),
        F.coalesce(F.get(files, F.col("turn").cast("int")), F.concat(F.lit("turn_"), F.col("turn").cast("string"))).alias("file_name"),
        F.struct("role", "text").alias("content"),
    )


FILES_SQL = "unnest([" + ", ".join(f"'{name}'" for name in fixed.ARTIFACTS_DUAL_TRACK) + "])"


@query(
    f"""
with files as (select {FILES_SQL} as file_name, unnest(range({len(fixed.ARTIFACTS_DUAL_TRACK)})) as turn)
select 'fn_' || conv_id as function_name, coalesce(file_name, 'turn_' || turn) as file_name,
       '{{"role":' || cast(to_json(role) as varchar) || ',"text":' || cast(to_json(text) as varchar) || '}}' as content
from conversations left join files using (turn)"""
)
def artifact_sink(spark, sf_dir):
    path = scratch_path(spark, "artifacts")
    writers.save_artifacts(corpus.as_artifacts(_artifacts(spark, sf_dir)), path)
    return spark.read.parquet(path).select("function_name", "file_name", "content")


@query(
    f"""
with files as (select {FILES_SQL} as file_name, unnest(range({len(fixed.ARTIFACTS_DUAL_TRACK)})) as turn)
select 'fn_' || conv_id as function_name, file_name from (select distinct conv_id from conversations), files
where (conv_id, turn) not in (select (conv_id, turn) from conversations)"""
)
def artifact_gaps(spark, sf_dir):
    made = _artifacts(spark, sf_dir).drop("content")
    return corpus.artifact_gaps(made, made)
