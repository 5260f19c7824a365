"""Registered queries of this subpackage and, where DuckDB can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return put


#: Shared by the SQL below: smallest vertex reachable over table links(a, b) from table nodes(id).
_REACH = """reach(id, to_id) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.to_id
), component AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)"""

_SHINGLES = r"""words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
      THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id)"""


@query("op6_near_duplicates", f"""
WITH RECURSIVE {_SHINGLES}, shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * both_n >= 85 * (p.n + q.n - both_n)
), nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN size s USING (doc_id) JOIN component c ON c.id = d.doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=3)


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.learnable(docs))
    said = langid.identify(docs.select("doc_id", "text"), model)
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs)).drop("text") \
        .select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


@query("op1_robust_outliers")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge
    return judge(table(spark, sf_dir, "documents"))


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tiffin.session import scratch_path
    from .tokenfile import read_tokens, write_tokens
    path = scratch_path(spark, "token-table")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path, with_ids=False)


@query("op9_nbest_segmentation")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from .nbest import encode, piece_counts
    docs, model = table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    return encode(docs, model, n=4, with_ids=False, counts=piece_counts(docs, model))


@query("op8_soft_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_metric_join", f"""
WITH RECURSIVE unit AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.9
), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a
), nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT e.vec_id, coalesce(g.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN degree g ON g.a = e.vec_id JOIN component c ON c.id = e.vec_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .metricjoin import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_url_words")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op2_style_tree")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .styletree import extract
    return extract(table(spark, sf_dir, "pages"))


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from .tokencount import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def _edit(cost: str, name: str, rest: str) -> str:
    """SQL: an edit put before an outcome, which is its cost in nine digits and its audit."""
    return f"(lpad(CAST(CAST(left({rest}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || '{name}' || substr({rest}, 10))"


def _outcomes(e0: str, e1: str, e2: str, e3: str) -> str:
    """SQL: best outcome by state, inserts first, from the outcomes without them."""
    two, one = f"least({e2}, {_edit('5', 'I', e3)})", f"least({e3}, {_edit('5', 'I', e2)})"
    return f"[least({e0}, {_edit('5', 'I', two)}), least({e1}, {_edit('5', 'I', two)}), {two}, {one}]"


_NEVER = "'900000000~'"
_FINE = "(CASE WHEN x[1] <> lower(x[1]) THEN 5 ELSE 0 END)"


def _edits(state: int) -> str:
    """SQL: outcome of the row x from a state, given the outcomes ``acc`` after it."""
    to, role = ("acc[4]", "a") if state == 2 else ("acc[3]", "u")
    keep = f"CASE WHEN lower(x[1]) = '{role}' THEN {_edit(_FINE, 'K', to)} "
    if state == 0:
        keep += f"WHEN lower(x[1]) = 's' THEN {_edit(_FINE, 'K', 'acc[2]')} "
    return (f"least({_edit('2', 'D', f'acc[{state + 1}]')}, {keep}ELSE {_NEVER} END, "
            f"CASE WHEN x[1] <> 'x' THEN {_edit(f'1 + {_FINE}', 'R', to)} ELSE {_NEVER} END)")


@query("op12_conversation_repair", rf"""
WITH keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                        lambda c: CAST(ord(c) AS BIGINT)) AS bytes FROM conversations
), harmed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda crc, b: list_reduce(range(8),
      lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, b)), 4294967295), 4294967295) % 20 AS harm FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN harm = 3 THEN [1, 2] ELSE [1] END) AS copy FROM harmed WHERE harm <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last_char FROM damaged
), judged AS (
  SELECT *, CASE WHEN last_char = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS c,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) || left(role, 1) AS pair FROM ordered
), conversation AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
         count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
         count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, list(role ORDER BY k) AS roles, list(text ORDER BY k) AS texts,
         list([CASE fault WHEN 'truncated' THEN upper(c) WHEN '' THEN c ELSE 'x' END] ORDER BY k DESC) AS symbols FROM judged GROUP BY conv_id
), best AS (
  SELECT *, list_reduce(symbols, lambda acc, x: list_transform([[{', '.join(_edits(s) for s in range(4))}]],
      lambda e: {_outcomes('e[1]', 'e[2]', 'e[3]', 'e[4]')})[1], ['000000000', '000000010II', '000000005I', '000000000'])[1] AS outcome FROM conversation
), written AS (
  SELECT *, CAST(left(outcome, 9) AS BIGINT) AS cost, substr(outcome, 10) AS audit,
    list_reduce(list_transform(string_split(substr(outcome, 10), ''), lambda o: {{'state': 0, 'k': 1, 'op': o, 'rows': CAST([] AS VARCHAR[])}}),
      lambda acc, x: CASE WHEN x.op = '' THEN acc WHEN x.op = 'D' THEN {{'state': acc.state, 'k': acc.k + 1, 'op': '', 'rows': acc.rows}} ELSE
        {{'state': CASE WHEN acc.state = 2 THEN 3 WHEN x.op = 'K' AND left(roles[acc.k], 1) = 's' THEN 1 ELSE 2 END,
          'k': acc.k + CASE WHEN x.op = 'I' THEN 0 ELSE 1 END, 'op': '',
          'rows': list_append(acc.rows, CASE WHEN x.op = 'K' THEN roles[acc.k] WHEN acc.state = 2 THEN 'assistant' ELSE 'user' END || ':'
                              || CASE WHEN x.op = 'I' THEN '' ELSE texts[acc.k] END)}} END,
      {{'state': 0, 'k': 1, 'op': '', 'rows': CAST([] AS VARCHAR[])}}).rows AS repaired FROM best
)
SELECT a.conv_id, CAST(coalesce(w.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(w.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(w.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(w.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(w.illegal, 0) AS BIGINT) AS illegal, coalesce(w.cost, 0) AS cost, coalesce(w.audit, '') AS audit,
       sha256(coalesce(array_to_string(w.repaired, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN written w ON a.conv_id IS NOT DISTINCT FROM w.conv_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, repair_conversations
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import find_runs, periodic_tail
    return find_runs(table(spark, sf_dir, "documents"), rewrite=periodic_tail)
