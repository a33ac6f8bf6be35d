"""Queries of this subpackage; each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.conversations import conversation_messages, sound_conversations
from brindle.llm.defects import defective_pairs, labelled_pairs
from brindle.llm.encodings import garbled_documents, repaired_documents
from brindle.llm.mixture import character_sizes, mixture, mixture_shares, token_sizes
from brindle.llm.near_duplicates import duplicate_classes, near_duplicate_openings
from brindle.llm.ranking import global_ranking, leaders, win_matrix
from brindle.llm.residue import residue_records, scored_replies
from brindle.llm.splitting import split_blocks, split_blocks_by_weight
from brindle.llm.tokens import encode_documents
from brindle.plans.materialize import materialize
from brindle.sources.tables import table


def _on(fn: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(*(table(spark, sf_dir, n) for n in names))


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(token_sizes(table(spark, sf_dir, "documents")), "sizes")
    return mixture(sizes, table(spark, sf_dir, "mix_targets"))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(token_sizes(table(spark, sf_dir, "documents")), "sizes")
    targets = table(spark, sf_dir, "mix_targets")
    return mixture_shares(materialize(mixture(sizes, targets), "mixture"), sizes, targets)


def _by_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(character_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))
    return mixed.select("doc_id", "copy", "source", F.col("n_tokens").alias("n_chars"), F.round("position", 3).alias("position"))


def _shares_by_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = character_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")
    got = mixture_shares(materialize(mixture(sizes, targets), "mixture"), sizes, targets)
    return got.withColumn("actual_share", F.round("actual_share", 9)).withColumnRenamed("tokens", "n_chars")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_matrix(table(spark, sf_dir, "pairwise_judge_result"), table(spark, sf_dir, "workflows")).select("item", "other", "wins", F.col("n").cast("long").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _on(near_duplicate_openings, "api_requests"),
        "p1_classes": _on(duplicate_classes, "api_requests"),
        "p2_found": _on(sound_conversations, "api_requests"),
        "p2_messages": _on(conversation_messages, "api_requests"),
        "p3_found": _on(defective_pairs, "api_requests"),
        "p3_labels": _on(labelled_pairs, "api_requests"),
        "p4_found": _on(split_blocks, "blocks", "split_limits", "boundary_tokens"),
        "p4_pieces": _on(split_blocks_by_weight, "blocks", "split_limits", "boundary_tokens"),
        "p5_found": _on(residue_records, "api_requests", "run_status"),
        "p5_coverage": _on(scored_replies, "api_requests"),
        "p6_found": _on(leaders, "pairwise_judge_result", "workflows"),
        "p6_ranking": _on(global_ranking, "pairwise_judge_result", "workflows"),
        "p6_matrix": _matrix,
        "p7_ids": _on(encode_documents, "documents"),
        "p8_mixture": _mixture,
        "p8_shares": _shares,
        "p8_mixture_chars": _by_characters,
        "p8_shares_chars": _shares_by_characters,
        "p9_found": _on(garbled_documents, "documents"),
        "p9_repaired": _on(repaired_documents, "documents"),
    }


_OPENINGS = """
WITH RECURSIVE chat AS (SELECT DISTINCT request_id, request FROM api_requests WHERE path = '/v1/chat/completions' AND request_id IS NOT NULL AND json_valid(request)),
message AS (SELECT request_id, unnest(json_extract(request, '$.messages[*]')) AS m FROM chat),
opening AS (
  SELECT request_id, any_value(m) FILTER (WHERE m->>'$.role' = 'user') AS m FROM message GROUP BY request_id
  HAVING count(*) FILTER (WHERE m->>'$.role' = 'user') = 1 AND count(*) FILTER (WHERE m->>'$.role' = 'assistant') = 0),
prompt AS (
  SELECT request_id, CASE WHEN json_type(m, '$.content') = 'ARRAY'
    THEN array_to_string(list_transform(list_filter(json_extract(m, '$.content[*]'), lambda p: p->>'$.type' = 'text'), lambda p: p->>'$.text'), ' ')
    ELSE m->>'$.content' END AS t FROM opening),
words AS (SELECT request_id, list_sort(list_distinct(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+'))) AS w FROM prompt WHERE t IS NOT NULL)
"""


def _text(m: str) -> str:
    return f"""coalesce(CASE WHEN json_type({m}, '$.content') = 'ARRAY'
    THEN array_to_string(list_transform(list_filter(json_extract({m}, '$.content[*]'), lambda p: p->>'$.type' = 'text'), lambda p: p->>'$.text'), ' ') ELSE {m}->>'$.content' END, '')"""


_SCALED = """
WITH RECURSIVE m AS MATERIALIZED (SELECT DISTINCT ON (match_id) match_id, a, b, upper(trim(winner)) AS w FROM pairwise_judge_result
           WHERE a <> b AND a IN (SELECT workflow FROM workflows) AND b IN (SELECT workflow FROM workflows)),
s AS MATERIALIZED (SELECT a, b, CASE w WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END::DOUBLE AS x FROM m),
wins AS MATERIALIZED (SELECT item, other, sum(x) AS wins, count(*) AS n FROM (SELECT a AS item, b AS other, x FROM s UNION ALL SELECT b, a, 1 - x FROM s) GROUP BY item, other),
it AS MATERIALIZED (SELECT workflow AS item, row_number() OVER (ORDER BY workflow) AS k FROM (SELECT DISTINCT workflow FROM workflows WHERE workflow IS NOT NULL)),
cell AS MATERIALIZED (SELECT x.k AS i, y.k AS j, coalesce(w.wins, 0) + 0.05 AS v FROM it x, it y LEFT JOIN wins w ON w.item = x.item AND w.other = y.item),
mat AS MATERIALIZED (SELECT (SELECT list(r ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS r FROM cell GROUP BY i)) AS rows_, (SELECT list(c ORDER BY j) FROM (SELECT j, list(v ORDER BY i) AS c FROM cell GROUP BY j)) AS cols_),
f AS (SELECT 0 AS t, list_transform(rows_, lambda r: 1.0::DOUBLE) AS d, list_transform(rows_, lambda r: 1.0::DOUBLE) AS o FROM mat
  UNION ALL
  SELECT t + 1, list_transform(cols_, lambda c: list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] / o2[i]))), o2 FROM (
    SELECT f.t, mat.cols_, list_transform(mat.rows_, lambda r: list_sum(list_transform(range(1, len(r) + 1), lambda j: r[j] / f.d[j]))) AS o2 FROM f, mat WHERE f.t < 400)),
raw AS MATERIALIZED (SELECT it.item, ln(list_sum(list_transform(range(1, len(f.d) + 1), lambda j: mat.rows_[it.k][j] / f.d[j]))) - ln(f.d[it.k]) AS s FROM it, f, mat WHERE f.t = 400),
z AS MATERIALIZED (SELECT item AS workflow, s - (SELECT avg(s) FROM raw) AS s FROM raw),
ranked AS MATERIALIZED (SELECT workflow, row_number() OVER (ORDER BY round(s, 9) DESC, workflow) AS rank, round(s, 6) + 0.0 AS strength, coalesce((SELECT sum(n) FROM wins WHERE item = workflow), 0)::BIGINT AS n_comparisons FROM z)
"""

_MIXED = """
WITH sizes AS MATERIALIZED (SELECT doc_id, source, length(text) AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND length(text) > 0),
held AS (SELECT source, sum(n)::BIGINT AS held, avg(n) AS len FROM sizes GROUP BY source),
target AS (SELECT source, max(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY source),
got AS (SELECT * FROM target JOIN held USING (source) WHERE target_share > 0 AND max_repeats > 0),
sums AS (SELECT sum(target_share) AS us, sum(target_share * ln(len)) AS ll FROM got),
lean AS (SELECT got.*, target_share / us AS share, ln(len) - ll / us AS lean FROM got, sums),
bounds AS (SELECT min(max_repeats * held / share) AS total, max(abs(lean)) AS widest FROM lean),
plan AS MATERIALIZED (SELECT source, held, total, floor(round(total * share, 6))::BIGINT AS demand, CASE WHEN widest > 0 THEN 0.5 * lean / widest ELSE 0 END AS k FROM lean, bounds),
pass AS (SELECT *, unnest(range(ceil(demand / held)::BIGINT)) AS copy FROM plan WHERE demand > 0),
placed AS (SELECT doc_id, copy, source, n, demand, total, k, copy * held + sum(n) OVER (PARTITION BY source, copy ORDER BY ('0x' || substr(md5(doc_id || '/' || copy), 1, 15))::BIGINT, doc_id) - n AS start FROM sizes JOIN pass USING (source)),
kept AS MATERIALIZED (SELECT *, start::DOUBLE / demand AS c FROM placed WHERE start < demand),
mixed AS MATERIALIZED (SELECT doc_id, copy, source, n::BIGINT AS n_chars, round(CASE WHEN abs(k) < 1e-9 THEN c ELSE (k - 1 + sqrt((1 - k) * (1 - k) + 4 * k * c)) / (2 * k) END * total, 3) + 0.0 AS position FROM kept)
"""

# Messages are compared by role, text, reasoning and call ids, which agrees with comparing canonical JSON on these tables.
_STEPS = f"""
WITH raw AS MATERIALIZED (SELECT DISTINCT request_id, episode, seq, request, CASE WHEN json_valid(response) THEN response END AS response FROM api_requests
  WHERE path = '/v1/chat/completions' AND status = 200 AND request_id IS NOT NULL AND seq IS NOT NULL AND json_valid(request)),
req AS MATERIALIZED (SELECT *, json_extract(response, '$.choices[0].message') AS r FROM raw WHERE json_array_length(request, '$.messages') >= 2),
cut AS (SELECT request_id, unnest(range(json_array_length(request, '$.messages')::BIGINT)) AS pos, unnest(json_extract(request, '$.messages[*]')) AS m FROM req),
msg AS MATERIALIZED (SELECT request_id, pos, m->>'$.role' AS role, {_text('m')} AS text, coalesce(json_array_length(m, '$.tool_calls'), 0) AS calls,
  md5(concat_ws('|', m->>'$.role', {_text('m')}, m->>'$.reasoning_content', m->>'$.tool_call_id', m->>'$.tool_calls[0].id')) AS fp FROM cut),
agg AS MATERIALIZED (SELECT request_id, list(fp ORDER BY pos) AS fps, list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts,
  bool_or(calls = 0 AND regexp_replace(text, '[\\s\u00a0\u200b\ufeff]+', '', 'g') = '') AS blank FROM msg GROUP BY request_id),
step AS MATERIALIZED (SELECT q.request_id, q.episode, q.seq, a.*  EXCLUDE (request_id), {_text('q.r')} AS reply,
  q.r IS NOT NULL AND json_type(q.r) = 'OBJECT' AND (coalesce(json_array_length(q.r, '$.tool_calls'), 0) > 0 OR regexp_replace({_text('q.r')}, '[\\s\u00a0\u200b\ufeff]+', '', 'g') <> '') AS answered FROM req q JOIN agg a USING (request_id)),
lagged AS (SELECT *, lag(fps) OVER w AS bf, lag(reply) OVER w AS br FROM step WINDOW w AS (PARTITION BY episode, fps[1], fps[2] ORDER BY seq)),
judged AS (SELECT *, NOT blank AND answered AND roles[1] = 'system' AND roles[2] = 'user' AND CASE WHEN bf IS NULL THEN NOT list_contains(roles, 'assistant') ELSE
  len(fps) >= len(bf) + 2 AND fps[1:len(bf)] = bf AND roles[len(bf) + 1] = 'assistant' AND texts[len(bf) + 1] = br AND NOT list_contains(roles[len(bf) + 2:], 'assistant') END AS ok FROM lagged),
sound AS MATERIALIZED (SELECT episode, fps[1] AS k1, fps[2] AS k2, arg_min(request_id, seq) AS first_id, arg_max(request_id, seq) AS last_id, (arg_max(len(fps), seq) + 1)::BIGINT AS n_messages FROM judged GROUP BY ALL HAVING bool_and(coalesce(ok, FALSE)))
"""


def oracle_sql() -> dict[str, str]:
    boundary = "(ids[e] IN (SELECT token_id FROM boundary_tokens) OR (mask IS NOT NULL AND len(mask) = len(ids) AND mask[e + 1] IS DISTINCT FROM mask[e]))"
    return {
        "p1_found": _OPENINGS
        + """, kept AS (SELECT request_id, w FROM words WHERE len(w) >= 5),
term AS (SELECT request_id, unnest(w) AS t, len(w) AS n FROM kept),
both_ AS (SELECT a.request_id AS id_a, b.request_id AS id_b, any_value(a.n) + any_value(b.n) AS total, count(*) AS shared
          FROM term a JOIN term b ON a.t = b.t AND a.request_id < b.request_id GROUP BY 1, 2)
SELECT id_a, id_b FROM both_ WHERE shared * 1.0 / (total - shared) >= 0.8""",
        "p1_classes": _OPENINGS
        + """, kept AS MATERIALIZED (SELECT request_id, w FROM words WHERE len(w) >= 5),
sets AS MATERIALIZED (SELECT w, row_number() OVER (ORDER BY w) AS k FROM (SELECT DISTINCT w FROM kept)),
term AS (SELECT k, unnest(w) AS t, len(w) AS n FROM sets),
pair AS MATERIALIZED (SELECT a.k AS x, b.k AS y FROM term a JOIN term b ON a.t = b.t AND a.k <> b.k GROUP BY a.k, b.k HAVING count(*) * 1.0 / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8),
reach AS (SELECT k AS x, k AS y FROM sets UNION SELECT r.x, p.y FROM reach r JOIN pair p ON p.x = r.y),
member AS MATERIALIZED (SELECT request_id, k FROM kept JOIN sets USING (w)),
named AS (SELECT r.x, min(m.request_id) AS class_id FROM reach r JOIN member m ON m.k = r.y GROUP BY r.x),
link AS (SELECT x, count(*) AS n FROM pair GROUP BY x)
SELECT m.request_id, n.class_id, coalesce(l.n, 0)::BIGINT AS n_links FROM member m JOIN named n ON n.x = m.k LEFT JOIN link l ON l.x = m.k""",
        "p2_found": _STEPS + "SELECT first_id, last_id, n_messages FROM sound",
        "p2_messages": _STEPS
        + f""", last AS MATERIALIZED (SELECT s.first_id, s.n_messages, q.* FROM sound s JOIN req q ON q.request_id = s.last_id)
SELECT l.first_id, m.pos AS position, m.role, m.text, m.calls::BIGINT AS n_tool_calls FROM last l JOIN msg m USING (request_id)
UNION ALL SELECT first_id, n_messages - 1, 'assistant', {_text('r')}, coalesce(json_array_length(r, '$.tool_calls'), 0)::BIGINT FROM last""",
        "p4_found": f"""
WITH RECURSIVE big AS MATERIALIZED (
  SELECT DISTINCT b.block_id, b.ids, b.mask, len(b.ids) AS n, l.max_tokens AS lim, l.overlap_tokens AS ov
  FROM blocks b JOIN split_limits l ON b.kind = l.kind WHERE len(b.ids) > l.max_tokens),
bound AS MATERIALIZED (
  SELECT block_id, list_sort(list(e)) AS es FROM (SELECT block_id, ids, mask, unnest(range(1, n)) AS e FROM big) WHERE {boundary} GROUP BY block_id),
src AS MATERIALIZED (SELECT big.block_id, n, lim, ov, coalesce(es, []::BIGINT[]) AS es FROM big LEFT JOIN bound ON big.block_id = bound.block_id),
piece AS (
  SELECT block_id, 0::BIGINT AS piece_no, 0::BIGINT AS start_pos, 0::BIGINT AS end_pos, 0::BIGINT AS nxt FROM src
  UNION ALL
  SELECT s.block_id, p.piece_no + 1, p.nxt,
    CASE WHEN s.n - p.nxt <= s.lim THEN s.n ELSE coalesce(list_max(list_filter(s.es, lambda e: e > p.nxt + s.lim // 2 AND e <= p.nxt + s.lim)), p.nxt + s.lim) END,
    CASE WHEN s.n - p.nxt <= s.lim THEN NULL ELSE coalesce(list_max(list_filter(s.es, lambda e: e > p.nxt + s.lim // 2 AND e <= p.nxt + s.lim)), p.nxt + s.lim) - s.ov END
  FROM piece p JOIN src s ON s.block_id = p.block_id WHERE p.nxt IS NOT NULL)
SELECT block_id, piece_no, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos FROM piece WHERE piece_no > 0""",
        "p8_mixture_chars": _MIXED + "SELECT doc_id, copy, source, n_chars, position FROM mixed",
        "p8_shares_chars": _MIXED
        + """SELECT t.source, t.target_share, round(coalesce(sum(n_chars) / (SELECT sum(n_chars) FROM mixed), 0.0), 9)::DOUBLE AS actual_share, coalesce(sum(n_chars), 0)::BIGINT AS n_chars,
  count(DISTINCT doc_id)::BIGINT AS documents, coalesce(max(copy) + 1, 0)::BIGINT AS most_copies FROM target t LEFT JOIN mixed m ON m.source = t.source GROUP BY t.source, t.target_share""",
        "p6_found": _SCALED + "SELECT workflow FROM ranked WHERE rank <= 6",
        "p6_ranking": _SCALED + "SELECT workflow, rank, strength, n_comparisons FROM ranked",
        "p6_matrix": """
WITH m AS (SELECT DISTINCT ON (match_id) match_id, a, b, upper(trim(winner)) AS w FROM pairwise_judge_result
           WHERE a <> b AND a IN (SELECT workflow FROM workflows) AND b IN (SELECT workflow FROM workflows)),
s AS (SELECT a, b, CASE w WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END AS x FROM m)
SELECT item, other, sum(x)::DOUBLE AS wins, count(*)::BIGINT AS n
FROM (SELECT a AS item, b AS other, x::DOUBLE AS x FROM s UNION ALL SELECT b, a, (1 - x)::DOUBLE FROM s) GROUP BY item, other""",
    }
