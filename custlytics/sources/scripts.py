"""A corpus of pipeline scripts, reports and model responses written from the text tables.

Every document becomes a small script that carries its whole text in comments; language and source decide
what the script imports and whether it is well-formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from custlytics.sources.tables import table

# Imports by language of the document, besides the two that every script has.
EXTRA_IMPORTS = {
    "fr": "from utils.helper import process",
    "de": "import requests",
    "es": "import common.io as io",
}
BROKEN_SOURCE = "src7"


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``script_id``, ``content``."""
    documents = table(spark, sf_dir, "documents")
    doc = F.col("doc_id").cast("string")
    extra = F.lit("")
    for lang, statement in EXTRA_IMPORTS.items():
        extra = F.when(F.col("lang") == lang, statement + "\n").otherwise(extra)
    comments = F.concat(F.lit("    # "), F.replace("text", F.lit("\n"), F.lit("\n    # ")))
    content = F.concat(
        F.lit("import os\nfrom pyspark.sql import DataFrame\n"),
        extra,
        F.lit("\ndef load_"),
        doc,
        F.lit("(path):\n"),
        comments,
        F.lit("\n    return path\n\n@print\ndef main_"),
        doc,
        F.lit("(path):\n    def step(x):\n        return x\n    return step(load_"),
        doc,
        F.lit("(path))"),
        F.when(F.col("source") == BROKEN_SOURCE, "\ndef broken(:").otherwise(""),
    )
    return documents.select(F.col("doc_id").alias("script_id"), content.alias("content"))


SCRIPTS_SQL = """
shaped as (
  select doc_id, lang, source, text, '    # ' || replace(text, chr(10), chr(10) || '    # ') as comments,
         length(text) - length(replace(text, chr(10), '')) + 1 as text_lines,
         case lang when 'fr' then 'from utils.helper import process' || chr(10)
                   when 'de' then 'import requests' || chr(10)
                   when 'es' then 'import common.io as io' || chr(10) else '' end as extra
  from documents
),
scripts as (
  select doc_id as script_id, lang, source, text_lines, comments, extra,
         case when extra = '' then 3 else 4 end as header_lines,
         'import os' || chr(10) || 'from pyspark.sql import DataFrame' || chr(10) || extra || chr(10)
         || 'def load_' || doc_id || '(path):' || chr(10) || comments || chr(10) || '    return path' || chr(10) || chr(10)
         || '@print' || chr(10) || 'def main_' || doc_id || '(path):' || chr(10) || '    def step(x):' || chr(10)
         || '        return x' || chr(10) || '    return step(load_' || doc_id || '(path))'
         || case when source = 'src7' then chr(10) || 'def broken(:' else '' end as content
  from shaped
)"""
