"""The registered queries of this package, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    chat, decontamination, mixing, near_duplicates, notices, periodic_runs, prefix_trie, quality, sharding,
    token_counts, token_files, twins, url_templates, vectors,
)
from ledgerlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MARKED = "</s>[INST] ok [/INST]"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_OP1_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_decontamination", f"""
WITH dw AS (SELECT doc_id, {_OP1_WORDS} AS w FROM documents),
bw AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_OP1_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w)-k+2)) AS i FROM bw)),
dwin AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w)-k+2)) AS i FROM dw, (SELECT DISTINCT k FROM win))),
hits AS (SELECT DISTINCT doc_id, item_id, i, k FROM dwin JOIN win USING (k, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CONTROL = r"(<s>|</s>|\[INST\]|\[/INST\])"
_ESCAPED = "(length(replace({0}, chr(92), chr(92)||chr(92))) + 2*len(regexp_extract_all({0}, '" + _CONTROL + "')))"


@query("op2_chat_format", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{MARKED}' UNION ALL SELECT -1, 1, 'assistant', '{MARKED}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role='assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role='assistant'), '')) AS loss_sha256,
  CAST(sum(20 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations, read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        f"SELECT * FROM VALUES (-1L, 0L, 'user', '{MARKED}'), (-1L, 1L, 'assistant', '{MARKED}') AS t(conv_id, turn, role, text)"
    )
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of every document."""
    return quality.rate_table(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op5_neighbours")
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth vector."""
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op6_near_duplicates", rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-4, 1)+1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*shared >= 85*(x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""")
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates over all documents, confirmed on full shingle sets."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), 85)


@query("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@query("op8_token_ids")
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Parquet lists and read back."""
    return token_files.store_and_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    pages = url_templates.labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return url_templates.judge(pages)


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and position of every document."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs", twins.RUNS)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one in ten made periodic, and the text without repeated periods."""
    return periodic_runs.summaries(periodic_runs.scan(table(spark, sf_dir, "documents"), plant=True))


@query("op12_prefix_trie", twins.TRIE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared prefix of the rebuilt conversations."""
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


@query("op13_license_scan", twins.notices_sql(notices.notices()))
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return notices.licenses(table(spark, sf_dir, "documents"))
