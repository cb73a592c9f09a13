"""One query per corpus operator, over whole tables and with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from custlytics.llm import byte_bpe, decontamination, html_text, line_dedup, ngram_join, packing, periodic_runs, personal_data, prefix_trie, quality_rules, sharding, substring_dedup, tokens
from custlytics.llm.common import table

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if oracle:
            ORACLES[plan.__name__] = oracle
        return plan

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def kept_digest(text: str = "text"):
    return F.sha2(F.col(text).cast("binary"), 256)


#: The blanks of the contracts and A-Z, as DuckDB writes them.
_SQL_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQL_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
        FROM documents),
    keyed AS (SELECT *, {_SQL_LOWER.format(f"trim(line, {_SQL_BLANKS})")} AS key FROM lines),
    frequent AS (
        SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines,
           count(*) FILTER (WHERE key IN (SELECT key FROM frequent)) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place)
                           FILTER (WHERE key NOT IN (SELECT key FROM frequent)), '')) AS kept_sha256
    FROM keyed GROUP BY doc_id
    """
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(_documents(spark, sf_dir), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", kept_digest().alias("kept_sha256"))


_SQL_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"


@query(
    f"""
    WITH docs AS (SELECT doc_id, coalesce({_SQL_WORDS.format('text')}, []) AS words FROM documents),
    windows AS (
        SELECT doc_id, k, md5(array_to_string(list_slice(words, k, k + 49), ' ')) AS win
        FROM (SELECT *, unnest(range(1, len(words) - 48)) AS k FROM docs)),
    firsts AS (SELECT win, min(doc_id) AS first_id FROM windows GROUP BY win),
    removed AS (
        SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS place
        FROM windows JOIN firsts USING (win) WHERE doc_id > first_id),
    each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs),
    kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
        FROM each ANTI JOIN removed USING (doc_id, place) GROUP BY doc_id)
    SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)
    """
)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeats(_documents(spark, sf_dir), window=50)
    return kept.select("doc_id", "n_words", "n_removed", kept_digest().alias("kept_sha256"))


@query()
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(_documents(spark, sf_dir))
    base = F.filter("personal_data", lambda s: s.base)
    of_kind = {f"n_{kind}": personal_data.span_count(base, kind) for kind in personal_data.BASE_KINDS}
    return found.select(
        "doc_id",
        *[n.alias(name) for name, n in of_kind.items()],
        F.sha2(personal_data.span_list(base).cast("binary"), 256).alias("base_sha256"),
        personal_data.span_list(F.col("personal_data")).alias("spans"),
    )


@query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(_documents(spark, sf_dir))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "posterior")


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_documents(spark, sf_dir), n_shards=40, law="bytes")


@query()
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query(
    f"""
    WITH RECURSIVE
    docs AS (SELECT doc_id, coalesce({_SQL_WORDS.format(_SQL_LOWER.format('text'))}, []) AS words FROM documents),
    grams AS (
        SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN words ELSE list_slice(words, k, k + 3) END AS gram
        FROM (SELECT *, unnest(range(1, greatest(len(words) - 2, 2))) AS k FROM docs WHERE len(words) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM grams a JOIN grams b USING (gram)
        WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (
        SELECT x, y FROM common JOIN sizes sx ON x = sx.doc_id JOIN sizes sy ON y = sy.doc_id
        WHERE 100 * i >= 85 * (sx.n + sy.n - i)),
    ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT r.doc_id, w.y FROM reached r JOIN ways w ON r.other = w.x)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
    FROM docs d LEFT JOIN sizes s USING (doc_id)
    JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) r USING (doc_id)
    """
)
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(_documents(spark, sf_dir), words=4, similarity=85)
    return found.select("doc_id", "n_shingles", "component_id")


_SQL_ITEM_WORDS = f"regexp_extract_all({_SQL_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    f"""
    WITH items AS (
        SELECT item_id, words, least(13, len(words)) AS n
        FROM (SELECT item_id, {_SQL_ITEM_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
    windows AS (
        SELECT DISTINCT item_id, n, list_slice(words, k, k + n - 1) AS win
        FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS k FROM items)),
    docs AS (SELECT doc_id, coalesce({_SQL_ITEM_WORDS}, []) AS words FROM documents),
    places AS (
        SELECT doc_id, n, k, list_slice(words, k, k + n - 1) AS win
        FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows))),
    hits AS (SELECT DISTINCT doc_id, k, n, item_id FROM places JOIN windows USING (n, win)),
    hit_words AS (
        SELECT doc_id, count(DISTINCT place) AS n_hit
        FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
    hit_items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """
)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_passages(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *[c.alias(name) for name, c in decontamination.hit_columns("found").items()])


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_documents(spark, sf_dir), limit=512)


@query()
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.decode(byte_bpe.encode(_documents(spark, sf_dir)))
    digests = [F.sha2(c, 256).alias(f"{name}_sha256") for name, c in (("ids", F.col("ids")), ("decoded", F.col("decoded")))]
    return decoded.select("doc_id", "n_tokens", *digests, "n_split")


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.with_periodic_tails(_documents(spark, sf_dir)), min_length=6, min_exponent=4)
    best = found.withColumn("best", periodic_runs.longest_run(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(periodic_runs.run_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        kept_digest().alias("collapsed_sha256"),
    )


@query(
    r"""
    WITH convs AS (
        SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns,
               list_concat([4294967295], flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    heads AS (
        SELECT c, turns, xor(list_reduce(steps, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h
        FROM convs),
    rebuilt AS (
        SELECT a.c, list_concat(coalesce(list_slice(b.turns, 1, a.h), []), coalesce(list_slice(a.turns, a.h + 1, len(a.turns)), [])) AS turns
        FROM heads a LEFT JOIN convs b ON b.c = a.c - a.c % 20),
    paths AS (
        SELECT c, d, len(turns) AS n, md5(to_json(list_slice(turns, 1, d))::varchar) AS node,
               CASE WHEN d > 0 THEN md5(to_json(list_slice(turns, 1, d - 1))::varchar) END AS parent,
               CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
        FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
    nodes AS (
        SELECT node, min(parent) AS parent, min(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
               string_agg(c::varchar, ',' ORDER BY c) FILTER (WHERE d = n) AS ends
        FROM paths GROUP BY node),
    children AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
    below AS (
        SELECT p.node, sum(u.saved) AS saved_tokens, count(*) FILTER (WHERE u.node NOT IN (SELECT node FROM children WHERE node IS NOT NULL)) AS n_leaves
        FROM nodes u JOIN paths p ON p.c = u.conv_id AND p.d <= u.depth GROUP BY p.node)
    SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves,
           b.saved_tokens::bigint AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM nodes n LEFT JOIN nodes m ON n.parent = m.node LEFT JOIN children k ON k.node = n.node JOIN below b ON b.node = n.node
    """
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_head_trie(table(spark, sf_dir, "conversations"))
