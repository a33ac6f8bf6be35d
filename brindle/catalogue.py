"""All queries of the core and their SQL twins.

The entities of the pipeline (requests, runs, blocks, judgments, workflows) are
tables; where an operator's own input is no table, an adapter derives it from
one that is, in the same way on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from brindle.functions import chat_json as J
from brindle.functions import text as X
from brindle.operators import checks, evidence, history, matches, packing, prompts, replies, report, selection, threads, traces, training, validation
from brindle.plans.materialize import materialize, shared_dir
from brindle.sources import json_lines, sinks
from brindle.sources.tables import table as T
from brindle.streaming import ledgers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        name = fn.__name__.strip("_")
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- threads

_CHAT = """
WITH raw AS MATERIALIZED (SELECT DISTINCT request_id, episode, seq, request, response FROM api_requests
  WHERE path = '/v1/chat/completions' AND status = 200 AND json_valid(request) AND json_valid(response)),
chat AS MATERIALIZED (SELECT * FROM raw WHERE json_array_length(response, '$.choices') > 0 AND json_array_length(request, '$.messages') > 0),
cut AS (SELECT request_id, episode, seq, unnest(range(json_array_length(request, '$.messages')::BIGINT)) AS pos, unnest(json_extract(request, '$.messages[*]')) AS m FROM chat),
msg AS MATERIALIZED (SELECT request_id, episode, seq, pos, m->>'$.role' AS role,
  coalesce(CASE WHEN json_type(m, '$.content') = 'ARRAY'
    THEN array_to_string(list_transform(list_filter(json_extract(m, '$.content[*]'), lambda p: p->>'$.type' = 'text'), lambda p: p->>'$.text'), ' ')
    ELSE m->>'$.content' END, '') AS text, coalesce(json_array_length(m, '$.tool_calls'), 0)::BIGINT AS calls,
  CASE WHEN json_type(m, '$.content') = 'ARRAY' THEN '[' || array_to_string(list_transform(json_extract(m, '$.content[*]'), lambda p: '{"type": "text", "text": ' || to_json(coalesce(p->>'$.text', ''))::VARCHAR || '}'), ', ') || ']' ELSE to_json(coalesce(m->>'$.content', ''))::VARCHAR END AS content,
  md5(concat_ws(chr(1), m->>'$.role', m->>'$.content', m->>'$.reasoning_content', m->>'$.tool_call_id', json_extract(m, '$.tool_calls[*].id')::VARCHAR, json_extract(m, '$.tool_calls[*].function.name')::VARCHAR, json_extract(m, '$.tool_calls[*].function.arguments')::VARCHAR)) AS stamp FROM cut),
head AS MATERIALIZED (SELECT request_id, any_value(episode) AS episode, any_value(seq) AS seq, count(*)::BIGINT AS n, coalesce(any_value(text) FILTER (WHERE pos = 0), '') AS sys,
  substr(md5(coalesce(any_value(text) FILTER (WHERE pos = 0), '') || chr(0) || coalesce(any_value(content) FILTER (WHERE pos = 1), '""')), 1, 10) AS thread_key FROM msg GROUP BY request_id)
"""


@_query(
    _CHAT
    + f"SELECT request_id, thread_key, CASE WHEN starts_with(sys, '{threads.MAIN_PREFIX}') THEN 'orchestrator' WHEN starts_with(sys, '{threads.WORKER_PREFIX}') THEN 'worker' ELSE 'auxiliary' END AS role, n AS n_messages FROM head"
)
def thread_key(spark: SparkSession, d: str) -> DataFrame:
    return threads.thread_keys(T(spark, d, "api_requests"))


@_query(
    _CHAT
    + """, s AS (SELECT *, CASE WHEN role = 'tool' AND coalesce(lag(role) OVER (PARTITION BY request_id ORDER BY pos) = 'tool', FALSE) THEN 0 ELSE 1 END AS fresh FROM msg),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY request_id ORDER BY pos) - 1 AS block_no FROM s)
SELECT request_id, block_no::BIGINT AS block_no, arg_min(role, pos) AS kind, min(pos)::BIGINT AS msg_start, (max(pos) + 1)::BIGINT AS msg_end FROM b GROUP BY request_id, block_no"""
)
def block_plan(spark: SparkSession, d: str) -> DataFrame:
    return threads.run_length_blocks(threads.message_roles(T(spark, d, "api_requests")))


@_query(
    _CHAT
    + """, s AS (SELECT *, greatest(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY pos) - 1, 0)::BIGINT AS segment FROM msg)
SELECT request_id, segment, min(pos)::BIGINT AS msg_start, (max(pos) + 1)::BIGINT AS msg_end, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS n_assistant FROM s GROUP BY request_id, segment"""
)
def query_segments(spark: SparkSession, d: str) -> DataFrame:
    return threads.query_segments(threads.message_roles(T(spark, d, "api_requests")))


@_query(
    _CHAT
    + """, stamp AS (SELECT request_id, list(stamp ORDER BY pos) AS now FROM msg GROUP BY request_id),
l AS (SELECT h.request_id, h.episode, h.seq, h.thread_key, now, lag(now) OVER (PARTITION BY h.episode, h.thread_key ORDER BY h.seq, h.request_id) AS before FROM head h JOIN stamp USING (request_id)),
b AS (SELECT *, CASE WHEN before IS NOT NULL AND (len(before) > len(now) OR now[1:len(before)] <> before) THEN 1 ELSE 0 END AS x FROM l)
SELECT request_id, thread_key, sum(x) OVER (PARTITION BY episode, thread_key ORDER BY seq, request_id)::BIGINT AS segment FROM b"""
)
def prefix_segments(spark: SparkSession, d: str) -> DataFrame:
    return threads.prefix_segments(T(spark, d, "api_requests"))


@_query("SELECT episode, try_cast(nullif(regexp_extract(condition_name, '^t(\\d+)_', 1), '') AS BIGINT) AS task_id, CASE WHEN task BETWEEN 1 AND 99 THEN 'first' WHEN task BETWEEN 200 AND 299 THEN 'second' WHEN task BETWEEN 300 AND 399 THEN 'third' ELSE 'other' END AS band FROM episodes")
def condition_tasks(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "episodes").select("episode", threads.task_of_condition(F.col("condition_name")).alias("task_id"), X.band(F.col("task")).alias("band"))


# ---- packing

_WINDOW, _OVERLAP = 2400, 400


_PACK = f"""
WITH RECURSIVE uniq AS MATERIALIZED (SELECT DISTINCT ON (block_id) block_id, episode, thread, segment::BIGINT AS segment, block_no::BIGINT AS block_no, coalesce(is_query, FALSE) AS q,
    coalesce(len(ids), 0)::BIGINT AS n, CASE WHEN len(mask) = coalesce(len(ids), 0) THEN coalesce(list_sum(mask), 0) ELSE 0 END::BIGINT AS loss FROM blocks
    WHERE block_id IS NOT NULL AND episode IS NOT NULL AND thread IS NOT NULL AND segment IS NOT NULL AND block_no IS NOT NULL),
hdr AS MATERIALIZED (SELECT episode, thread, {_WINDOW} - sum(n)::BIGINT AS room FROM uniq WHERE block_no < 2 GROUP BY episode, thread HAVING count(*) = 2 AND sum(n) <= 0.9 * {_WINDOW}),
body AS MATERIALIZED (SELECT u.*, h.room, row_number() OVER w AS idx, sum(n) OVER w AS c FROM uniq u JOIN hdr h USING (episode, thread) WHERE block_no >= 2 WINDOW w AS (PARTITION BY u.episode, u.thread ORDER BY block_no)),
ql AS MATERIALIZED (SELECT episode, thread, segment, min(idx) AS qi FROM body WHERE q GROUP BY episode, thread, segment),
qs AS MATERIALIZED (SELECT ql.*, b.n AS qn FROM ql JOIN body b ON b.episode = ql.episode AND b.thread = ql.thread AND b.idx = ql.qi),
seg AS MATERIALIZED (SELECT episode, thread, segment, max(idx) AS hi FROM body GROUP BY episode, thread, segment),
cand0 AS MATERIALIZED (SELECT b.episode, b.thread, b.segment, b.idx, b.block_no, b.n, b.c, b.room, s.hi, qs.qi, qs.qn,
    (SELECT min(x.idx) FROM body x WHERE x.episode = b.episode AND x.thread = b.thread AND x.idx < b.idx AND (b.c - b.n) - (x.c - x.n) <= {_OVERLAP}) AS j
  FROM body b JOIN seg s ON s.episode = b.episode AND s.thread = b.thread AND s.segment = b.segment LEFT JOIN qs ON qs.episode = b.episode AND qs.thread = b.thread AND qs.segment = b.segment
  WHERE b.loss > 0 AND b.n <= b.room),
cand1 AS MATERIALIZED (SELECT k.*, coalesce(k.qi < k.idx, FALSE) AS ahead, coalesce(k.idx - k.j, 0) AS nc, coalesce((k.c - k.n) - (SELECT x.c - x.n FROM body x WHERE x.episode = k.episode AND x.thread = k.thread AND x.idx = k.j), 0) AS ctx FROM cand0 k),
cand2 AS MATERIALIZED (SELECT *, ctx + CASE WHEN ahead AND qi < idx - nc THEN qn ELSE 0 END AS u0, nc + CASE WHEN ahead AND qi < idx - nc THEN 1 ELSE 0 END AS n0 FROM cand1),
cand3 AS MATERIALIZED (SELECT *, CASE WHEN u0 + n <= room THEN u0 WHEN ahead AND qn + n <= room THEN qn ELSE 0 END AS used, CASE WHEN u0 + n <= room THEN n0 WHEN ahead AND qn + n <= room THEN 1 ELSE 0 END AS n_context,
    CASE WHEN u0 + n <= room THEN ahead ELSE ahead AND qn + n <= room END AS has_query FROM cand2),
cand AS MATERIALIZED (SELECT k.*, (SELECT max(x.idx) FROM body x WHERE x.episode = k.episode AND x.thread = k.thread AND x.idx >= k.idx AND x.idx <= k.hi AND x.loss > 0 AND k.used + x.c - (k.c - k.n) <= k.room) AS last FROM cand3 k),
chain AS (
  SELECT episode, thread, segment, 1::BIGINT AS window_no, min(idx) AS idx FROM cand GROUP BY episode, thread, segment
  UNION ALL
  SELECT * FROM (SELECT p.episode, p.thread, p.segment, p.window_no + 1, (SELECT min(y.idx) FROM cand y WHERE y.episode = p.episode AND y.thread = p.thread AND y.segment = p.segment AND y.idx > k.last) AS idx
    FROM chain p JOIN cand k ON k.episode = p.episode AND k.thread = p.thread AND k.segment = p.segment AND k.idx = p.idx) WHERE idx IS NOT NULL)
"""
_PACKED = """FROM chain p JOIN cand k ON k.episode = p.episode AND k.thread = p.thread AND k.segment = p.segment AND k.idx = p.idx
JOIN body e ON e.episode = k.episode AND e.thread = k.thread AND e.idx = k.last"""


@_query(_PACK + f"""SELECT p.episode, p.thread, p.segment, p.window_no, k.block_no AS first_block, e.block_no + 1 AS end_block, k.n_context::BIGINT AS n_context, k.has_query,
  ({_WINDOW} - k.room + k.used + e.c - (k.c - k.n))::BIGINT AS n_tokens,
  (SELECT sum(x.loss) FROM body x WHERE x.episode = k.episode AND x.thread = k.thread AND x.idx BETWEEN k.idx AND k.last)::BIGINT AS n_loss_tokens
{_PACKED}""")
def sft_window_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_windows(T(spark, d, "blocks"), _WINDOW, _OVERLAP)


@_query(
    _PACK
    + f""", full_ AS MATERIALIZED (SELECT DISTINCT ON (block_id) block_id, episode, thread, block_no, coalesce(ids, []::INTEGER[]) AS ids, CASE WHEN len(mask) = len(coalesce(ids, []::INTEGER[])) THEN mask END AS mask FROM blocks
  WHERE block_id IS NOT NULL AND episode IS NOT NULL AND thread IS NOT NULL AND segment IS NOT NULL AND block_no IS NOT NULL),
w AS MATERIALIZED (SELECT p.episode, p.thread, p.segment, p.window_no, k.idx, k.last, {_WINDOW} - k.room AS header_tokens,
  CASE WHEN u0 + k.n <= k.room THEN (CASE WHEN ahead AND qi < k.idx - nc THEN [qi] ELSE []::BIGINT[] END) || range(k.idx - nc, k.idx) WHEN ahead AND qn + k.n <= k.room THEN [qi] ELSE []::BIGINT[] END AS ctx {_PACKED}),
part AS MATERIALIZED (SELECT episode, thread, segment, window_no, pos, FALSE AS own, pos AS block_no FROM w, (SELECT unnest([0, 1]) AS pos)
  UNION ALL SELECT z.episode, z.thread, z.segment, z.window_no, 2 + z.k, FALSE, b.block_no FROM (SELECT *, unnest(ctx) AS idx_, unnest(range(len(ctx))) AS k FROM w) z JOIN body b ON b.episode = z.episode AND b.thread = z.thread AND b.idx = z.idx_
  UNION ALL SELECT w.episode, w.thread, w.segment, w.window_no, 1000000 + b.idx, TRUE, b.block_no FROM w JOIN body b ON b.episode = w.episode AND b.thread = w.thread AND b.idx BETWEEN w.idx AND w.last),
piece AS MATERIALIZED (SELECT part.*, f.ids, list_transform(range(1, len(f.ids) + 1), lambda i: CASE WHEN own AND f.mask[i] <> 0 THEN f.ids[i] ELSE -100 END) AS labels, b.loss FROM part
  JOIN full_ f ON f.episode = part.episode AND f.thread = part.thread AND f.block_no = part.block_no LEFT JOIN body b ON b.episode = part.episode AND b.thread = part.thread AND b.block_no = part.block_no)
SELECT episode, thread, segment, window_no, md5(array_to_string(flatten(list(ids ORDER BY pos)), ',')) AS input_ids, md5(array_to_string(flatten(list(labels ORDER BY pos)), ',')) AS labels, sum(len(ids))::BIGINT AS n_tokens,
  coalesce(string_agg(block_no::VARCHAR, ',' ORDER BY pos) FILTER (WHERE NOT own AND pos > 1), '') AS ctx_blocks, string_agg(block_no::VARCHAR, ',' ORDER BY pos) FILTER (WHERE own AND loss > 0) AS loss_blocks, sum(len(ids)) FILTER (WHERE pos < 2)::BIGINT AS header_tokens
FROM piece GROUP BY episode, thread, segment, window_no"""
)
def window_tokens(spark: SparkSession, d: str) -> DataFrame:
    windows, _ = packing.rendered(T(spark, d, "blocks"), _WINDOW, _OVERLAP)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return windows.select("episode", "thread", "segment", "window_no", F.md5(joined("input_ids")).alias("input_ids"), F.md5(joined("labels")).alias("labels"), "n_tokens", joined("ctx_blocks").alias("ctx_blocks"), joined("loss_blocks").alias("loss_blocks"), "header_tokens")


@_query(
    _PACK
    + f""", w AS MATERIALIZED (SELECT p.episode, p.thread, ({_WINDOW} - k.room + k.used + e.c - (k.c - k.n))::BIGINT AS n_tokens,
  (SELECT sum(x.loss) FROM body x WHERE x.episode = k.episode AND x.thread = k.thread AND x.idx BETWEEN k.idx AND k.last)::BIGINT AS n_loss {_PACKED}),
head AS MATERIALIZED (SELECT episode, thread, count(*) FILTER (WHERE block_no < 2) AS h, coalesce(sum(n) FILTER (WHERE block_no < 2), 0) AS t, count(*) FILTER (WHERE block_no >= 2) AS b FROM uniq GROUP BY episode, thread),
row_ AS (SELECT episode, thread, 'window' AS kind, n_tokens, n_loss FROM w UNION ALL SELECT episode, thread, 'skipped', n, loss FROM body WHERE loss > 0 AND n > room
  UNION ALL SELECT episode, thread, 'error', t, 0 FROM head WHERE h <> 2 OR t > 0.9 * {_WINDOW})
SELECT episode, count(DISTINCT episode || chr(0) || thread)::BIGINT AS threads, count(*) FILTER (WHERE kind = 'window')::BIGINT AS windows, coalesce(sum(n_tokens) FILTER (WHERE kind = 'window'), 0)::BIGINT AS total_tokens,
  coalesce(sum(n_loss) FILTER (WHERE kind = 'window'), 0)::BIGINT AS loss_tokens, count(*) FILTER (WHERE kind = 'skipped')::BIGINT AS skipped_blocks, count(*) FILTER (WHERE kind = 'error')::BIGINT AS errors FROM row_ GROUP BY GROUPING SETS ((episode), ())"""
)
def window_statistics(spark: SparkSession, d: str) -> DataFrame:
    return packing.render_statistics(packing.plan_windows(T(spark, d, "blocks"), _WINDOW, _OVERLAP))


@_query("""SELECT DISTINCT ON (block_id) block_id, least(64, len(ids))::BIGINT AS n_kept, ids[greatest(len(ids) - 63, 1)] AS first_id,
  len(list_filter((mask[greatest(len(ids) - 63, 1):])[2:], lambda x: x = 1)) > 0 AS trainable FROM blocks WHERE block_id IS NOT NULL AND len(ids) > 0 AND len(ids) = len(mask)""")
def tail_crop(spark: SparkSession, d: str) -> DataFrame:
    return training.tail_crop(T(spark, d, "blocks"), 64)


# ---- matches


@_query("""WITH m AS (SELECT DISTINCT ON (match_id) provider, upper(trim(winner)) AS w FROM pairwise_judge_result WHERE match_id IS NOT NULL),
c AS (SELECT provider, count(*) FILTER (WHERE w = 'A')::BIGINT AS wins, count(*) FILTER (WHERE w = 'B')::BIGINT AS losses, count(*) FILTER (WHERE w IS NULL OR w NOT IN ('A', 'B'))::BIGINT AS ties FROM m GROUP BY provider)
SELECT *, round(wins * 1.0 / nullif(wins + losses, 0), 6)::DOUBLE AS win_rate FROM c""")
def win_rate_report(spark: SparkSession, d: str) -> DataFrame:
    return matches.win_rates(T(spark, d, "pairwise_judge_result").where("match_id is not null"), "provider")


@_query("""SELECT match_id, CASE WHEN w NOT IN ('A', 'B') OR w IS NULL THEN 'tie' WHEN swapped THEN CASE w WHEN 'A' THEN 'B' ELSE 'A' END ELSE w END AS winner
FROM (SELECT DISTINCT match_id, upper(trim(winner)) AS w, coalesce(swapped, FALSE) AS swapped FROM pairwise_judge_result)""")
def unswapped(spark: SparkSession, d: str) -> DataFrame:
    label = matches.clean_label(F.col("winner"))
    return T(spark, d, "pairwise_judge_result").select("match_id", matches.unswap(label, F.coalesce("swapped", F.lit(False))).alias("winner")).distinct()


_RING = """WITH e AS MATERIALIZED (SELECT task, episode, row_number() OVER (PARTITION BY task ORDER BY md5('7-' || task || '-' || episode), episode) - 1 AS i, count(*) OVER (PARTITION BY task) AS n
  FROM (SELECT DISTINCT task, episode FROM episodes)),
p AS MATERIALIZED (SELECT DISTINCT x.task, least(x.episode, y.episode) AS p, greatest(x.episode, y.episode) AS q FROM e x JOIN e y ON x.task = y.task AND x.episode <> y.episode
  AND (y.i = (x.i + 1) % x.n OR y.i = (x.i + 2) % x.n OR y.i = (x.i + 3) % x.n))"""


@_query(_RING + """ SELECT task, CASE WHEN md5('7-' || task || '-' || p || '-' || q) < '8' THEN q ELSE p END AS a, CASE WHEN md5('7-' || task || '-' || p || '-' || q) < '8' THEN p ELSE q END AS b FROM p""")
def tournament_schedule(spark: SparkSession, d: str) -> DataFrame:
    return matches.tournament(T(spark, d, "episodes"), "task", "episode", 6, 7)


@_query("""WITH m AS (SELECT DISTINCT ON (match_id) provider, a, b, CASE upper(trim(winner)) WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END::DOUBLE AS s FROM pairwise_judge_result WHERE provider IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b)
SELECT provider, i, j, sum(w)::DOUBLE AS wins FROM (SELECT provider, a AS i, b AS j, s AS w FROM m UNION ALL SELECT provider, b, a, 1 - s FROM m) GROUP BY provider, i, j""")
def win_counts(spark: SparkSession, d: str) -> DataFrame:
    return matches.win_counts(T(spark, d, "pairwise_judge_result").where("provider is not null"), "provider")


@_query("""WITH RECURSIVE m AS MATERIALIZED (SELECT DISTINCT ON (match_id) provider, a, b, CASE upper(trim(winner)) WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END::DOUBLE AS s FROM pairwise_judge_result WHERE provider IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b),
o AS MATERIALIZED (SELECT provider, i, j, sum(w)::DOUBLE AS w FROM (SELECT provider, a AS i, b AS j, s AS w FROM m UNION ALL SELECT provider, b, a, 1 - s FROM m) GROUP BY provider, i, j),
it AS MATERIALIZED (SELECT provider, i, row_number() OVER (PARTITION BY provider ORDER BY i) AS k, sum(w) + 0.5 AS g FROM o GROUP BY provider, i),
g AS MATERIALIZED (SELECT x.provider, ia.k AS a, ib.k AS b, x.w + coalesce(y.w, 0) AS n FROM o x LEFT JOIN o y ON x.provider = y.provider AND x.i = y.j AND x.j = y.i
  JOIN it ia ON ia.provider = x.provider AND ia.i = x.i JOIN it ib ON ib.provider = x.provider AND ib.i = x.j),
gl AS MATERIALIZED (SELECT provider, a, list(b ORDER BY b) AS bs, list(n ORDER BY b) AS ns FROM g GROUP BY provider, a),
par AS MATERIALIZED (SELECT it.provider, list(it.g ORDER BY k) AS gs, list(gl.bs ORDER BY k) AS bs, list(gl.ns ORDER BY k) AS ns, count(*) AS c FROM it JOIN gl ON gl.provider = it.provider AND gl.a = it.k GROUP BY it.provider),
f AS (SELECT provider, 0 AS r, list_transform(gs, lambda x: 1.0::DOUBLE) AS p FROM par
  UNION ALL
  SELECT provider, r, list_transform(q, lambda x: x / (list_sum(q) / len(q))) FROM (
    SELECT f.provider, f.r + 1 AS r, list_transform(range(1, len(f.p) + 1), lambda k: par.gs[k] / (0.5 / (f.p[k] + 1) + list_sum(list_transform(range(1, len(par.bs[k]) + 1), lambda h: par.ns[k][h] / (f.p[k] + f.p[par.bs[k][h]]))))) AS q
    FROM f JOIN par USING (provider) WHERE f.r < 500))
SELECT it.provider, it.i AS item, round(ln(f.p[it.k]), 6) + 0.0 AS rating FROM it JOIN f ON f.provider = it.provider AND f.r = 500""")
def bt_ratings(spark: SparkSession, d: str) -> DataFrame:
    return matches.ratings(T(spark, d, "pairwise_judge_result"), "provider")


@_query("""WITH m AS (SELECT DISTINCT ON (match_id) provider, a, b, CASE upper(trim(winner)) WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END::DOUBLE AS s FROM pairwise_judge_result WHERE provider IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b),
w AS (SELECT provider, i, sum(w) AS won FROM (SELECT provider, a AS i, s AS w FROM m UNION ALL SELECT provider, b, 1 - s FROM m) GROUP BY provider, i)
SELECT provider, i, r::BIGINT AS rank, CASE WHEN r <= 15 THEN 'train' WHEN r = 16 THEN 'validation' ELSE 'none' END AS band FROM (SELECT provider, i, row_number() OVER (PARTITION BY provider ORDER BY won DESC, i) AS r FROM w)""")
def rank_bands(spark: SparkSession, d: str) -> DataFrame:
    won = matches.win_counts(T(spark, d, "pairwise_judge_result").where("provider is not null"), "provider").groupBy("provider", "i").agg(F.sum("wins").alias("won"))
    return matches.rank_bands(won, "provider", "i", "won")


@_query("SELECT DISTINCT match_id, a, b FROM pairwise_judge_result WHERE a IN (SELECT workflow FROM workflows WHERE beats_reference) AND b IN (SELECT workflow FROM workflows WHERE beats_reference)")
def eligible_semi(spark: SparkSession, d: str) -> DataFrame:
    good = T(spark, d, "workflows").where("beats_reference").select("workflow")
    rows = T(spark, d, "pairwise_judge_result").select("match_id", "a", "b")
    return rows.join(good.withColumnRenamed("workflow", "a"), "a", "left_semi").join(good.withColumnRenamed("workflow", "b"), "b", "left_semi").select("match_id", "a", "b").distinct()


# ---- keyed joins, usage, trials


@_query("SELECT episode, task FROM episodes WHERE episode NOT IN (SELECT episode FROM run_status WHERE episode IS NOT NULL AND coalesce(exit_code = 0 AND coalesce(trace_has_success_result, FALSE), FALSE))")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    done = T(spark, d, "run_status").where(traces.completed(F.col("exit_code"), F.col("trace_has_success_result")))
    return report.remaining(T(spark, d, "episodes").select("episode", "task"), done, ["episode"])


@_query("""SELECT r.episode, n_runs, n_blocks FROM (SELECT episode, count(DISTINCT status_id)::BIGINT AS n_runs FROM run_status WHERE episode IS NOT NULL GROUP BY episode) r
JOIN (SELECT episode, count(DISTINCT block_id)::BIGINT AS n_blocks FROM blocks WHERE episode IS NOT NULL GROUP BY episode) b ON b.episode = r.episode""")
def keyed_pairs(spark: SparkSession, d: str) -> DataFrame:
    runs = T(spark, d, "run_status").where("episode is not null").groupBy("episode").agg(F.countDistinct("status_id").alias("n_runs"))
    blocks = T(spark, d, "blocks").where("episode is not null").groupBy("episode").agg(F.countDistinct("block_id").alias("n_blocks"))
    return report.keyed_pairs(runs.join(blocks.select("episode"), "episode", "left_semi"), blocks.join(runs.select("episode"), "episode", "left_semi"), ["episode"])


@_query("""WITH u AS (SELECT DISTINCT ON (request_id) episode, path, CASE WHEN json_valid(response) THEN try_cast(response->>'$.usage.prompt_tokens' AS BIGINT) END AS p,
  CASE WHEN json_valid(response) THEN try_cast(response->>'$.usage.completion_tokens' AS BIGINT) END AS c FROM api_requests)
SELECT episode, count(*)::BIGINT AS n_requests, count(*) FILTER (WHERE path = '/v1/chat/completions')::BIGINT AS n_chat, coalesce(sum(p), 0)::BIGINT AS prompt_tokens,
  coalesce(sum(c), 0)::BIGINT AS completion_tokens, coalesce(max(p), 0)::BIGINT AS max_prompt FROM u GROUP BY episode""")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return report.request_usage(T(spark, d, "api_requests"))


_RATES = [("standard", 0.5), ("standard anodized", 0.75), ("small", 0.3), ("medium plated", 0.9), ("economy", 0.1), ("promo", 1.25)]
_CASE = "CASE " + " ".join(f"WHEN starts_with(lower(p_type), '{p}') THEN {r}" for p, r in sorted(_RATES, key=lambda x: -len(x[0]))) + " END"


@_query(f"SELECT p_partkey, ({_CASE})::DOUBLE AS rate, round(p_retailprice * ({_CASE}), 4)::DOUBLE AS cost FROM part")
def longest_prefix_rate(spark: SparkSession, d: str) -> DataFrame:
    return report.longest_prefix(T(spark, d, "part"), "p_type", _RATES).select("p_partkey", "rate", F.round(F.col("p_retailprice") * F.col("rate"), 4).alias("cost"))


@_query(f"SELECT p_brand, count(*)::BIGINT AS n, count(c)::BIGINT AS costed, round(sum(c), 4)::DOUBLE AS cost FROM (SELECT p_brand, p_retailprice * ({_CASE}) AS c FROM part) GROUP BY p_brand")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    rated = report.longest_prefix(T(spark, d, "part"), "p_type", _RATES)
    return report.cost_rollup(rated.withColumn("cost", F.col("p_retailprice") * F.col("rate")), "p_brand")


_SCORES = """SELECT model AS grp, seed % 3 AS trial, task, provider AS judge, CASE upper(trim(winner)) WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END::DOUBLE AS score FROM (SELECT DISTINCT ON (match_id) * FROM pairwise_judge_result WHERE match_id IS NOT NULL)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Adapter: the verdicts of a judge on a task as scores, three trials by seed."""
    label = matches.clean_label(F.col("winner"))
    score = F.when(label == "A", 1.0).when(label == "B", 0.0).otherwise(0.5)
    rows = T(spark, d, "pairwise_judge_result").where("match_id is not null").dropDuplicates(["match_id"])
    return rows.select(F.col("model").alias("grp"), (F.col("seed") % 3).alias("trial"), "task", F.col("provider").alias("judge"), score.alias("score"))


@_query(f"""WITH s AS ({_SCORES}), t AS (SELECT grp, trial, task, avg(score) AS s FROM s GROUP BY ALL), r AS (SELECT grp, trial, avg(s) AS s FROM t GROUP BY ALL)
SELECT grp, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, count(*)::BIGINT AS n_trials FROM r GROUP BY grp""")
def trial_rollup(spark: SparkSession, d: str) -> DataFrame:
    return report.trial_rollup(_scores(spark, d))


@_query(f"""WITH s AS ({_SCORES}), j AS (SELECT grp, trial, task, list(DISTINCT judge) AS js FROM s GROUP BY grp, trial, task)
SELECT grp, trial, task, array_to_string(list_filter(['ext_a', 'ext_b', 'other', 'self'], lambda x: NOT list_contains(js, x)), ',') AS missing FROM j""")
def missing_judges(spark: SparkSession, d: str) -> DataFrame:
    return report.missing_judges(_scores(spark, d), ["ext_a", "ext_b", "other", "self"]).withColumn("missing", F.array_join("missing", ","))


@_query("""WITH l AS (SELECT episode, arg_max(text, {'c': created_at, 'd': doc_id}) AS t FROM documents WHERE length(trim(text, ' ')) > 0 AND created_at IS NOT NULL GROUP BY episode)
SELECT e.episode, md5(coalesce(l.t, 'ERROR')) AS h FROM (SELECT DISTINCT episode FROM episodes) e LEFT JOIN l ON l.episode = e.episode""")
def latest_nonempty_default(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents").where("created_at is not null")
    got = report.latest_or_default(T(spark, d, "episodes"), docs, "episode", "text", ["created_at", "doc_id"], "ERROR")
    return got.select("episode", F.md5("text").alias("h"))


@_query("SELECT doc_id, coalesce(target_share, 1.0)::DOUBLE AS weight FROM documents d LEFT JOIN mix_targets m ON d.source = m.source")
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id", "source").join(T(spark, d, "mix_targets"), "source", "left").select("doc_id", F.coalesce("target_share", F.lit(1.0)).alias("weight"))


# ---- training


@_query("""SELECT l_returnflag, l_linestatus, l_linenumber, round(sum(l_extendedprice) / greatest(1, sum(l_quantity)), 4)::DOUBLE AS mean_loss, sum(l_quantity)::BIGINT AS tokens
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), ())""")
def loss_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "lineitem").withColumnsRenamed({"l_extendedprice": "loss", "l_quantity": "tokens"})
    return training.grouped_losses(rows, ["l_returnflag", "l_linestatus", "l_linenumber"])


@_query("SELECT l_returnflag AS strata, count(*)::BIGINT AS draws, sum(l_quantity)::BIGINT AS tokens, count(DISTINCT l_partkey)::BIGINT AS windows FROM lineitem GROUP BY l_returnflag")
def exposure(spark: SparkSession, d: str) -> DataFrame:
    steps = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("rows"), F.collect_list("l_returnflag").alias("strata"), F.collect_list("l_quantity").alias("tokens"))
    return training.exposure(steps)


@_query("SELECT arg_min(o_orderkey, {'v': o_totalprice, 's': o_orderkey}) AS step, min(o_totalprice) AS val_loss FROM orders WHERE o_orderkey > 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def checkpoint_argmin(spark: SparkSession, d: str) -> DataFrame:
    log = T(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("val_loss"))
    return training.best_checkpoint(log, T(spark, d, "lineitem").select(F.col("l_orderkey").alias("step")))


@_query("""SELECT range::BIGINT AS step, round(CASE WHEN range < 50 THEN 0.0002 * (range + 1) / 50 ELSE 0.0002 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (range - 50) / 950.0)))) END, 9)::DOUBLE AS lr FROM range(1000)""")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    return training.schedule(spark, 1000, 50, 0.0002, 0.1)


_U = "(('0x' || substr(md5('11-' || rank || '-' || step || '-{}'), 1, 13))::BIGINT / 4503599627370496.0)"


def _strata(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "blocks").where("block_id is not null and episode is not null").select("block_id", "episode", F.when(F.col("kind") == "assistant", "orch").otherwise("nonmain").alias("role_group")).distinct()
    return rows.select(F.col("block_id").alias("window_id"), F.regexp_extract("episode", r"^t(\d+)_", 1).alias("task"), "role_group", F.regexp_extract("episode", r"^([^_]*_[^_]*)_", 1).alias("condition"))


def _draws(spark: SparkSession) -> DataFrame:
    return spark.range(1000).select(F.floor(F.col("id") / 250).cast("long").alias("rank"), (F.col("id") % 250).alias("step"))


_STRATA = """WITH s AS MATERIALIZED (SELECT DISTINCT block_id AS window_id, regexp_extract(episode, '^t(\\d+)_', 1) AS task, CASE WHEN kind = 'assistant' THEN 'orch' ELSE 'nonmain' END AS g, regexp_extract(episode, '^([^_]*_[^_]*)_', 1) AS cond
  FROM blocks WHERE block_id IS NOT NULL AND episode IS NOT NULL),
d AS MATERIALIZED (SELECT a.range AS rank, b.range AS step FROM range(4) a, range(250) b)"""


@_query(
    _STRATA
    + f""", z AS MATERIALIZED (SELECT task, count(*) FILTER (WHERE g = 'orch') AS n1, count(*) FILTER (WHERE g = 'nonmain') AS n2, row_number() OVER (ORDER BY task) AS t, count(*) OVER () AS m FROM s GROUP BY task),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY task, g ORDER BY window_id) AS k FROM s),
p AS MATERIALIZED (SELECT d.*, z.*, CASE WHEN n2 = 0 THEN 'orch' WHEN n1 = 0 THEN 'nonmain' WHEN {_U.format('role')} < 0.6 THEN 'orch' ELSE 'nonmain' END AS g FROM d JOIN z ON z.t = floor({_U.format('task')} * z.m) + 1)
SELECT p.rank, p.step, k.window_id FROM p JOIN k ON k.task = p.task AND k.g = p.g AND k.k = floor({_U.format('window')} * CASE WHEN p.g = 'orch' THEN n1 ELSE n2 END) + 1"""
)
def task_role_sampler(spark: SparkSession, d: str) -> DataFrame:
    return training.stratified_draws(_strata(spark, d), _draws(spark), 0.6, 11)


@_query(
    _STRATA
    + f""", z AS MATERIALIZED (SELECT cond, n, hi - w AS lo, hi, max(hi) OVER () AS al FROM (SELECT cond, n, w, sum(w) OVER (ORDER BY cond) AS hi FROM (SELECT cond, count(*) AS n, CASE WHEN cond LIKE '%bare' THEN 0.5 ELSE 1.0 END AS w FROM s GROUP BY cond))),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY window_id) AS k FROM s),
p AS MATERIALIZED (SELECT d.*, z.* FROM d JOIN z ON {_U.format('condition')} * z.al >= z.lo AND {_U.format('condition')} * z.al < z.hi)
SELECT p.rank, p.step, k.window_id FROM p JOIN k ON k.cond = p.cond AND k.k = floor({_U.format('window')} * p.n) + 1"""
)
def condition_sampler(spark: SparkSession, d: str) -> DataFrame:
    windows = _strata(spark, d)
    weights = windows.select("condition").distinct().where(F.endswith("condition", F.lit("bare"))).select("condition", F.lit(0.5).alias("weight"))
    return training.weighted_draws(windows, weights, _draws(spark), 11)


@_query("SELECT vec_id, round(greatest(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 448.0, 1e-12), 12) AS scale FROM embeddings")
def block_absmax(spark: SparkSession, d: str) -> DataFrame:
    return training.absmax_scales(T(spark, d, "embeddings"))


@_query("SELECT episode, condition_name NOT LIKE '%bare' AS train FROM episodes WHERE task IS NOT NULL AND NOT (condition_name LIKE '%ourTeam')")
def split_holdout(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "episodes").where("task is not null and not (condition_name like '%ourTeam')")
    return rows.select("episode", (~F.col("condition_name").rlike("bare$")).alias("train"))


# ---- histories


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    won = F.when(F.col("event_type") == "purchase", "B").when(F.col("event_type") == "error", "A").otherwise("tie")
    ev = T(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("version"), won.alias("winner"), "value")
    # Versions whose value is above 20 have met each of the five before them.
    before = F.sequence(F.greatest(F.col("version") - 5, F.lit(0).cast("long")), F.col("version"))
    met = F.map_from_entries(F.transform(before, lambda c: F.struct(c, F.when(F.col("value") > 40, "B").otherwise("A"))))
    return ev.withColumn("arbitration", F.when(F.col("value") > 20, met))


_FOLD = """WITH RECURSIVE ev AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS version, CASE event_type WHEN 'purchase' THEN 'B' WHEN 'error' THEN 'A' ELSE 'tie' END AS winner,
  CASE WHEN value > 40 THEN 'B' WHEN value > 20 THEN 'A' END AS arb FROM events),
f AS (SELECT user_id, 0::BIGINT AS version, 0::BIGINT AS champion, {start} AS has_win, FALSE AS needs FROM ev WHERE version = 0
  UNION ALL
  SELECT f.user_id, e.version, CASE WHEN e.winner = 'B' AND ({direct} OR (e.arb = 'B' AND e.version - f.champion <= 5)) THEN e.version ELSE f.champion END, f.has_win OR (e.winner = 'B' AND ({direct} OR coalesce((e.arb = 'B' AND e.version - f.champion <= 5), FALSE))),
    e.winner = 'B' AND NOT {direct} AND (e.arb IS NULL OR e.version - f.champion > 5) FROM f JOIN ev e ON e.user_id = f.user_id AND e.version = f.version + 1)
SELECT f.user_id, champion, has_win, needs FROM f JOIN (SELECT user_id, max(version) AS v FROM ev GROUP BY user_id) m ON m.user_id = f.user_id AND m.v = f.version"""


@_query(_FOLD.replace("{start}", "FALSE").replace("{direct}", "(f.champion = e.version - 1)"))
def champion_fold(spark: SparkSession, d: str) -> DataFrame:
    return history.champions(_rounds(spark, d), "user_id", baseline=False)


@_query(_FOLD.replace("{start}", "(winner = 'B')").replace("{direct}", "(NOT f.has_win)"))
def champion_baseline_fold(spark: SparkSession, d: str) -> DataFrame:
    return history.champions(_rounds(spark, d), "user_id", baseline=True)


@_query("""WITH v AS MATERIALIZED (SELECT provider, w.version, CASE WHEN s > 0 THEN 'B' WHEN s < 0 THEN 'A' ELSE 'tie' END AS winner FROM (
    SELECT provider, w.version, sum(CASE upper(trim(winner)) WHEN 'A' THEN 1 WHEN 'B' THEN -1 ELSE 0 END) AS s FROM (SELECT DISTINCT ON (match_id) * FROM pairwise_judge_result) p JOIN workflows w ON w.workflow = p.a GROUP BY ALL) w),
g AS (SELECT provider, unnest(range(max(version) + 1)) AS version FROM v GROUP BY provider)
SELECT g.provider, string_agg('v' || g.version || ' ' || CASE v.winner WHEN 'B' THEN 'W' WHEN 'A' THEN 'L' WHEN 'tie' THEN 'T' ELSE '?' END, ' · ' ORDER BY g.version) AS board FROM g LEFT JOIN v ON v.provider = g.provider AND v.version = g.version WHERE g.provider IS NOT NULL GROUP BY g.provider""")
def scoreboard(spark: SparkSession, d: str) -> DataFrame:
    label = matches.clean_label(F.col("winner"))
    rows = T(spark, d, "pairwise_judge_result").dropDuplicates(["match_id"]).join(T(spark, d, "workflows").select(F.col("workflow").alias("a"), "version"), "a")
    net = rows.where("provider is not null").groupBy("provider", "version").agg(F.sum(F.when(label == "A", 1).when(label == "B", -1).otherwise(0)).alias("s"))
    return history.scoreboards(net.withColumn("winner", F.when(F.col("s") > 0, "B").when(F.col("s") < 0, "A").otherwise("tie")), "provider")


def _squash(col: str) -> str:
    return f"trim(regexp_replace({col}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' ')"


def _short(col: str, n: int) -> str:
    t = _squash(col)
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(substr({t}, 1, {n - 3}), ' ') || '...' END"


@_query(f"""SELECT doc_id, row_number() OVER w AS version, (length(text) - lag(length(text)) OVER w)::BIGINT AS delta,
  length(CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 3 THEN {_short('text', 1500)} ELSE {_short('text', 400)} END)::BIGINT AS kept FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def version_delta(spark: SparkSession, d: str) -> DataFrame:
    return history.version_deltas(T(spark, d, "documents").select("doc_id", "source", "text"), "source", "doc_id")


_LIKE = " OR ".join(f"contains(lower(s), '{c}')" for c in X.CUES)
_ITEMS = f"list_filter(string_split(regexp_replace({_squash('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 0 AND ({_LIKE}))"
# The order of first occurrences is kept.
_DISTINCT = f"list_transform(list_filter(list_zip({_ITEMS}, range(len({_ITEMS}))), lambda z: list_position({_ITEMS}, z[1]) = z[2] + 1), lambda z: z[1])"


@_query(f"SELECT doc_id, array_to_string(({_DISTINCT})[1:6], '|') AS items FROM documents WHERE text IS NOT NULL")
def action_items(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(X.action_items(F.col("text")), "|").alias("items"))


_BUCKETS = " UNION ALL ".join(f"SELECT '{n}' AS bucket, '{p}' AS pat" for n, p in history.ISSUES)


@_query(f"""WITH b AS ({_BUCKETS}), r AS (SELECT doc_id, text, ({_DISTINCT})[1] AS item FROM documents WHERE length(trim(text, ' ')) > 0)
SELECT bucket, count(*)::BIGINT AS n, arg_min(item, doc_id) FILTER (WHERE item IS NOT NULL) AS example FROM r JOIN b ON regexp_matches(lower(text), pat) GROUP BY bucket""")
def issue_buckets(spark: SparkSession, d: str) -> DataFrame:
    return history.issue_counts(T(spark, d, "documents").select("doc_id", "text"), "doc_id")


# ---- texts


@_query("SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS single, greatest(1, floor((length(text) + length(coalesce(source, '')) + 3) / 4.0))::BIGINT AS pair FROM documents WHERE text IS NOT NULL")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return T(spark, d, "documents").where("text is not null").select("doc_id", X.token_estimate(t).alias("single"), X.pair_token_estimate(t, F.coalesce("source", F.lit(""))).alias("pair"))


@_query(f"SELECT doc_id, md5({_short('text', 120)}) AS h FROM documents WHERE text IS NOT NULL")
def shorten_text(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.shorten(F.col("text"), 120)).alias("h"))


@_query("""SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 200) || ' [cut] ' || right(text, 200) END) AS cut,
  md5(CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 200) || chr(10) || '...' || chr(10) || right(text, 100) END) AS excerpt FROM documents WHERE text IS NOT NULL""")
def head_tail_truncate(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return T(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.head_tail(t, 400, " [cut] ")).alias("cut"), F.md5(X.log_excerpt(t, 200, 100)).alias("excerpt"))


_SHRINK = "floor(length(text) / 4.0)::BIGINT"


@_query(f"""SELECT doc_id, CASE WHEN greatest(1, ceil(length(text) / 4.0)) <= 60 THEN NULL ELSE (SELECT CASE WHEN ceil(z * 2 / 4.0) <= 60 THEN z ELSE 256 END FROM
  (SELECT list_reduce([{_SHRINK}] || range(1, 25), lambda n, i: CASE WHEN ceil(n * 2 / 4.0) <= 60 THEN n ELSE floor(n * 0.7::DOUBLE)::BIGINT END) AS z)) END::BIGINT AS kept FROM documents WHERE text IS NOT NULL""")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").where("text is not null").select("doc_id", X.fit_budget(F.col("text"), 60).alias("kept"))


@_query("""SELECT doc_id, ((length(text) - length(replace(text, ' the ', ''))) / 5)::BIGINT AS n,
  md5(CASE WHEN instr(text, ' the ') > 0 THEN substr(text, 1, instr(text, ' the ') - 1) || ' THE ' || substr(text, instr(text, ' the ') + 5) ELSE text END) AS h FROM documents WHERE text IS NOT NULL""")
def prompt_substitute(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.col("text"), F.lit(" the ")
    return T(spark, d, "documents").where("text is not null").select("doc_id", X.occurrences(t, n).alias("n"), F.md5(X.replace_first(t, n, F.lit(" THE "))).alias("h"))


def _prompts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Adapter: the prompt of an episode is that of its first request, kept exactly, with blanks around it, or under another form that an index resolves; a quarter of the episodes has none."""
    rows = threads.answered(T(spark, d, "api_requests")).select("request_id", "episode", "seq", prompts.first_user_texts(F.col("messages")).alias("texts")).dropDuplicates(["request_id"])
    first = rows.groupBy("episode").agg(F.min_by(F.array_join("texts", " "), F.struct("seq", "request_id")).alias("p"))
    kind = F.substring(F.md5("episode"), 1, 1)
    form = F.when(kind < "4", F.col("p")).when(kind < "8", F.concat(F.lit("  "), "p", F.lit("\n"))).when(kind < "c", F.concat(F.lit("@"), "p"))
    return rows, first.select("episode", "p", form.alias("prompt"))


_FIRST_USER = """, item AS MATERIALIZED (SELECT request_id, any_value(episode) AS episode, any_value(seq) AS seq, arg_min(CASE WHEN json_type(m, '$.content') = 'ARRAY' THEN list_transform(json_extract(m, '$.content[*]'), lambda p: coalesce(p->>'$.text', '')) ELSE [coalesce(m->>'$.content', '')] END, pos) AS texts
  FROM (SELECT cut.*, m->>'$.role' AS role FROM cut) WHERE role = 'user' GROUP BY request_id),
first_ AS MATERIALIZED (SELECT episode, arg_min(array_to_string(texts, ' '), {'s': seq, 'r': request_id}) AS p, substr(md5(episode), 1, 1) AS k FROM item GROUP BY episode),
asked AS MATERIALIZED (SELECT episode, CASE WHEN k < '4' THEN p WHEN k < '8' THEN '  ' || p || chr(10) WHEN k < 'c' THEN '@' || p END AS prompt, CASE WHEN k >= '8' AND k < 'c' THEN p END AS sent FROM first_),
form AS MATERIALIZED (SELECT episode, 0 AS o, 'exact' AS mode, prompt AS v FROM asked UNION ALL SELECT episode, 1, 'sent', sent FROM asked UNION ALL SELECT episode, 2, 'strip', regexp_replace(prompt, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') FROM asked)"""


@_query(
    _CHAT
    + _FIRST_USER
    + """, hit AS MATERIALIZED (SELECT i.request_id, i.texts, f.o, f.mode, f.v, list_sum(list_transform(texts, lambda t: ((length(t) - length(replace(t, v, ''))) / length(v))::BIGINT))::BIGINT AS hits FROM item i JOIN form f ON f.episode = i.episode WHERE length(v) > 0),
best AS (SELECT request_id, min(o) AS o FROM hit WHERE hits > 0 GROUP BY request_id)
SELECT h.request_id, h.mode, h.hits, md5(array_to_string(CASE WHEN hits = 1 THEN list_transform(texts, lambda t: CASE WHEN instr(t, v) > 0 THEN substr(t, 1, instr(t, v) - 1) || 'Do the task.' || substr(t, instr(t, v) + length(v)) ELSE t END) ELSE texts END, chr(1))) AS h FROM hit h JOIN best USING (request_id, o)"""
)
def prompt_match(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _prompts(spark, d)
    index = prompts.sent_index(asked.where(F.col("prompt") == F.concat(F.lit("@"), "p")), "prompt", "p")
    forms = prompts.with_sent(asked.where("prompt is not null"), "prompt", index).select("episode", prompts.variants(F.col("prompt"), F.col("sent")).alias("forms"))
    found = rows.join(forms, "episode").withColumn("found", prompts.match(F.col("texts"), F.col("forms"))).where("found is not null")
    bare = F.lit("Do the task.")
    changed = prompts.substitute(F.col("texts"), F.col("found"), bare, F.lit(None).cast("string"))
    return found.select("request_id", "found.mode", "found.hits", F.md5(F.array_join(changed, "\u0001")).alias("h"))


@_query("""SELECT e.episode, CASE WHEN e.condition_name LIKE '%bare' THEN coalesce(m.p, 'default') WHEN teacher_prompt IS NOT NULL THEN coalesce(m.p, teacher_prompt) ELSE m.p END AS prompt
FROM episodes e LEFT JOIN (SELECT condition_name, min(workspace) AS p FROM episodes WHERE condition_name LIKE 't2%' GROUP BY condition_name) m ON m.condition_name = e.condition_name
WHERE e.condition_name LIKE '%bare' OR teacher_prompt IS NOT NULL OR m.p IS NOT NULL""")
def condition_prompts(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "episodes")
    own = e.where("condition_name like 't2%'").select(F.col("condition_name").alias("condition"), F.col("workspace").alias("prompt"))
    return prompts.prompts_by_condition(e, own, F.when(F.endswith("condition_name", F.lit("bare")), "default").otherwise(F.col("teacher_prompt")))


@_query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '([A-Za-z0-9_-]+/[A-Za-z0-9_/-]+\\.[a-z]+)', 1))), '|') AS paths,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)([A-Za-z0-9_./-]+\\.png)', 1))), '|') AS images FROM documents WHERE text IS NOT NULL""")
def path_mentions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return T(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(X.file_paths(t), "|").alias("paths"), F.array_join(X.image_paths(t), "|").alias("images"))


@_query("""WITH r AS (SELECT doc_id, text, instr(text, '##') AS a, substr(text, instr(text, '##') + 2) AS rest FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, instr(reverse(rest), '.') AS b, length(rest) - instr(reverse(rest), '.') + 1 AS z FROM r)
SELECT doc_id, CASE WHEN a > 0 AND b > 0 THEN md5(substr(text, 1, a - 1)) END AS before, CASE WHEN a > 0 AND b > 0 THEN md5(substr(rest, 1, z - 1)) END AS block, CASE WHEN a > 0 AND b > 0 THEN md5(substr(rest, z + 1)) END AS after FROM s""")
def template_split(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = X.template_parts(F.col("text"), "##", ".")
    return T(spark, d, "documents").where("text is not null").select("doc_id", F.md5(a).alias("before"), F.md5(b).alias("block"), F.md5(c).alias("after"))


@_query("""WITH raw AS MATERIALIZED (SELECT DISTINCT request_id, response FROM api_requests WHERE path = '/v1/chat/completions' AND status = 200 AND json_valid(response)),
t AS MATERIALIZED (SELECT request_id, response->>'$.choices[0].message.content' AS t FROM raw WHERE length(response->>'$.choices[0].message.content') > 0),
c AS (SELECT request_id, trim(t, ' ') AS w, regexp_extract(t, '(?s)(\\{.*\\})', 1) AS o, regexp_extract(t, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1) AS f FROM t)
SELECT request_id, CASE WHEN starts_with(w, '{') AND json_valid(w) THEN 'whole' WHEN starts_with(o, '{') AND json_valid(o) THEN 'braces' WHEN starts_with(f, '{') AND json_valid(f) THEN 'fenced' ELSE 'none' END AS part FROM c""")
def json_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "api_requests").where((F.col("path") == threads.CHAT_PATH) & (F.col("status") == 200))
    text = F.try_variant_get(J.chat_variant("response"), "$.choices[0].message.content", "string")
    return rows.select("request_id", text.alias("t")).where(F.length("t") > 0).select("request_id", X.json_candidate(F.col("t")).alias("part")).distinct()


@_query("""SELECT episode, CASE WHEN regexp_full_match(x, '(query_?)?[0-9]+') THEN 'query_' || regexp_extract(x, '^(?:query_?)?0*(\\d+)$', 1) ELSE 'query_' || x END AS id,
  coalesce(nullif(regexp_extract(f, 'query_?(\\d+)', 1), ''), nullif(regexp_extract(f, '\\bq(\\d+)\\b', 1), ''), nullif(regexp_extract(f, '^(\\d+)', 1), '')) AS folder
FROM (SELECT episode, coalesce('query' || task, 'none') AS x, string_split(workspace, '/')[-1] AS f FROM episodes WHERE workspace IS NOT NULL)""")
def query_id_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.coalesce(F.concat(F.lit("query"), F.col("task").cast("string")), F.lit("none"))
    return T(spark, d, "episodes").where("workspace is not null").select("episode", X.normalise_id(raw).alias("id"), X.folder_id(F.col("workspace")).alias("folder"))


_KINDS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind FROM documents WHERE regexp_matches(text, '{p}')" for k, p in X.LEAKS.items())


@_query(_KINDS + " UNION ALL SELECT doc_id, 'denied:glacier' FROM documents WHERE contains(lower(text), 'glacier')")
def leak_scan(spark: SparkSession, d: str) -> DataFrame:
    return checks.leaks(T(spark, d, "documents").select("doc_id", "text"), "doc_id", ("glacier",))


@_query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN sha256(text) <> sha256(trim(text, ' ')) THEN 'changed' ELSE 'same' END AS status FROM documents""")
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents")
    manifest = docs.select("doc_id", F.sha2(F.coalesce(F.trim("text"), F.lit("")), 256).alias("sha256"))
    return checks.manifest_status(manifest, docs.where("text is not null").select("doc_id", F.col("text").alias("content")), "doc_id")


@_query("""WITH RECURSIVE i AS MATERIALIZED (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL),
f AS (SELECT source, doc_id, k, CASE WHEN coalesce(n <= 20000, FALSE) THEN n ELSE 0 END AS used, coalesce(n <= 20000, FALSE) AS kept FROM i WHERE k = 1
  UNION ALL SELECT i.source, i.doc_id, i.k, CASE WHEN coalesce(f.used + i.n <= 20000, FALSE) THEN f.used + i.n ELSE f.used END, coalesce(f.used + i.n <= 20000, FALSE) FROM f JOIN i ON i.source = f.source AND i.k = f.k + 1)
SELECT doc_id, used::BIGINT AS used FROM f WHERE kept""")
def skip_greedy_budget(spark: SparkSession, d: str) -> DataFrame:
    return evidence.skip_greedy(T(spark, d, "documents").where("source is not null").withColumn("n", F.length("text")), "source", "doc_id", "n", 20000)


@_query(f"""WITH p AS MATERIALIZED (SELECT DISTINCT episode, string_split(unnest(regexp_extract_all(text, '([A-Za-z0-9_-]+/[A-Za-z0-9_/-]+\\.[a-z]+)', 1)), '/') AS p FROM documents WHERE episode IS NOT NULL),
q AS MATERIALIZED (SELECT episode, list_filter(p, lambda x: length(x) > 0) AS p FROM p),
e AS MATERIALIZED (SELECT episode, parts, bool_or(dir) AS dir FROM (SELECT episode, p[1:d] AS parts, d < len(p) AS dir FROM (SELECT episode, p, unnest(range(1, least(len(p), 6) + 1)) AS d FROM q)) GROUP BY episode, parts),
seen AS MATERIALIZED (SELECT * FROM e WHERE len(list_intersect(CASE WHEN dir THEN parts ELSE parts[1:len(parts) - 1] END, {list(evidence.SKIPPED_FOLDERS)})) = 0),
crowd AS MATERIALIZED (SELECT episode, parts[1:len(parts) - 1] AS folder, count(*) AS n FROM seen GROUP BY ALL HAVING count(*) > 12),
kept AS MATERIALIZED (SELECT * FROM seen s WHERE NOT EXISTS (SELECT 1 FROM crowd c WHERE c.episode = s.episode AND len(c.folder) < len(s.parts) AND s.parts[1:len(c.folder)] = c.folder)),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY list_transform(range(1, len(parts) + 1), lambda i: (CASE WHEN i < len(parts) OR dir THEN '0' ELSE '1' END) || lower(parts[i]) || chr(1) || parts[i])) AS rank FROM kept),
line AS (
  SELECT episode, rank, 0 AS k, array_to_string(parts, '/') AS path, CASE WHEN dir THEN 'dir' ELSE 'file' END AS kind,
    repeat('  ', len(parts)) || parts[-1] || CASE WHEN dir THEN '/' WHEN list_contains({list(evidence.BINARY_SUFFIXES)}, lower(regexp_extract(parts[-1], '[^.](\\.[^.]+)$', 1))) THEN '  [' || lower(regexp_extract(parts[-1], '[^.](\\.[^.]+)$', 1)) || ' binary/large]' ELSE '' END AS text FROM r WHERE rank <= 40
  UNION ALL SELECT c.episode, coalesce(r.rank, 0), 1, array_to_string(folder, '/'), 'omitted', repeat('  ', len(folder) + 1) || '... [contents omitted: ' || n || ' entries exceed per-directory limit 12]' FROM crowd c LEFT JOIN r ON r.episode = c.episode AND r.parts = c.folder WHERE r.rank < 40 OR len(folder) = 0
  UNION ALL SELECT DISTINCT episode, 41, 2, '', 'truncated', '... (tree truncated)' FROM r WHERE rank > 40 OR (rank = 40 AND dir))
SELECT episode, row_number() OVER (PARTITION BY episode ORDER BY rank, k)::BIGINT AS line, path, kind, text FROM line""")
def tree_budget(spark: SparkSession, d: str) -> DataFrame:
    paths = T(spark, d, "documents").where("episode is not null").select("episode", F.explode(X.file_paths(F.col("text"))).alias("path"))
    return evidence.tree_listing(paths, "episode", entries=40, children=12)


@_query()
def design_diff(spark: SparkSession, d: str) -> DataFrame:
    return evidence.version_diffs(T(spark, d, "documents").where("episode is not null").select("episode", "doc_id", "text"), "episode", "doc_id")


@_query(f"""SELECT episode, min(path) AS path FROM (SELECT episode, 'tests/test_' || regexp_extract(path, '([^/]*)\\.[a-z]+$', 1) || '.py' AS path FROM (SELECT episode, unnest(regexp_extract_all(text, '([A-Za-z0-9_-]+/[A-Za-z0-9_/-]+\\.[a-z]+)', 1)) AS path FROM documents WHERE episode IS NOT NULL) WHERE NOT starts_with(path, 'data/')) GROUP BY episode""")
def first_test_files(spark: SparkSession, d: str) -> DataFrame:
    paths = T(spark, d, "documents").where("episode is not null").select("episode", F.explode(X.file_paths(F.col("text"))).alias("path"))
    name = F.regexp_extract("path", r"([^/]*)\.[a-z]+$", 1)
    moved = F.concat(F.when(F.startswith("path", F.lit("data/")), "data/").otherwise("tests/test_"), name, F.lit(".py"))
    return evidence.first_test_file(paths.select("episode", moved.alias("path")), "episode")


# ---- traces


_MARK = " OR ".join(f"contains(failure.message, '{m}')" for m in traces.INFRA_MARKERS)
_DONE = "coalesce(exit_code = 0 AND coalesce(trace_has_success_result, FALSE), FALSE)"
_FAIL = "(coalesce(exit_code <> 0, FALSE) OR coalesce(NOT trace_has_success_result, FALSE))"


@_query(f"""SELECT DISTINCT ON (status_id) status_id, {_DONE} AS completed, {_FAIL} AS failed,
  CASE WHEN {_DONE} THEN 'success' WHEN coalesce(starts_with(failure.message, '{traces.INFRA_START}') AND ({_MARK}), FALSE) THEN 'infra_error' WHEN exit_code = 124 THEN 'timeout' WHEN {_FAIL} THEN 'failure' ELSE 'unknown' END AS outcome,
  coalesce(array_to_string(list_transform((list_reverse(failure.last_tool_calls))[1:5], lambda c: coalesce(c.tool, '') || ' ' || coalesce(substr(c.args, 1, 200), '')), '|'), '') AS last_tools
FROM run_status WHERE status_id IS NOT NULL""")
def trace_classify(spark: SparkSession, d: str) -> DataFrame:
    return traces.classify_runs(T(spark, d, "run_status"))


@_query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' ELSE 'other' END AS kind FROM events)
SELECT user_id, coalesce(bool_or(kind = 'success'), FALSE) AS any_success, coalesce(arg_max(kind = 'success', event_id) FILTER (WHERE kind <> 'other'), FALSE) AS last_success FROM e GROUP BY user_id""")
def any_or_last_success(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "error").otherwise("other")
    return traces.last_any_success(T(spark, d, "events").select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id")


def sse_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as event streams: pieces of 40 characters, one bad chunk after the first, a reasoning, a call in two pieces, an end mark."""
    docs = T(spark, d, "documents").where(F.length("text") > 0).select(F.col("doc_id").alias("stream_id"), "text", "source")
    pieces = docs.select("stream_id", F.posexplode(F.sequence(F.lit(1), F.length("text"), F.lit(40))).alias("k", "at"), "text")
    delta = F.struct(F.substr(F.col("text"), F.col("at"), F.lit(40)).alias("content"))
    body = F.to_json(F.struct(F.concat(F.lit("s"), F.col("stream_id").cast("string")).alias("id"), F.array(F.struct(F.lit(0).alias("index"), delta.alias("delta"))).alias("choices")))
    chunks = pieces.select("stream_id", (F.col("k") * 2).cast("long").alias("ord"), F.concat(F.lit("data: "), body).alias("line"))
    call = lambda args, **more: F.to_json(F.struct(F.array(F.struct(F.struct(*(v.alias(k) for k, v in more.items()), F.array(F.struct(*((F.concat(F.lit("c"), F.col("stream_id").cast("string")).alias("id"),) if more else ()), F.struct(*((F.lit("save").alias("name"),) if more else ()), args.alias("arguments")).alias("function"))).alias("tool_calls")).alias("delta"))).alias("choices")))
    late = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit('data: {"choices": [').alias("line")),
        F.struct(F.lit(0).alias("ord"), F.concat(F.lit("data: "), call(F.lit('{"doc": '), reasoning=F.coalesce("source", F.lit("")))).alias("line")),
        F.struct(F.lit(1).alias("ord"), F.concat(F.lit("data: "), call(F.concat(F.col("stream_id").cast("string"), F.lit("}")))).alias("line")),
        F.struct(F.lit(2).alias("ord"), F.lit('data: {"choices": [{"index": 0, "delta": {}, "finish_reason": "stop", "stop_reason": 7}], "usage": {"prompt_tokens": 5}}').alias("line")),
        F.struct(F.lit(3).alias("ord"), F.lit("data: [DONE]").alias("line")),
    )
    rest = docs.select("stream_id", F.posexplode(late).alias("k", "x")).select("stream_id", (F.when(F.col("k") > 0, F.lit(1 << 40)).otherwise(F.lit(0).cast("long")) + F.col("x.ord")).alias("ord"), "x.line")
    return chunks.unionByName(rest)


@_query("""SELECT doc_id AS stream_id, md5(text) AS h, (ceil(length(text) / 40.0) + 3)::BIGINT AS n_chunks, 1::BIGINT AS n_bad, 'stop' AS finish_reason, '7' AS stop_reason, 's' || doc_id AS id, nullif(source, '') AS reasoning,
  'c' || doc_id || '|function|save|{"doc": ' || doc_id || '}' AS call, 5::BIGINT AS prompt_tokens FROM documents WHERE length(text) > 0""")
def sse_reassemble(spark: SparkSession, d: str) -> DataFrame:
    got = traces.assemble_streams(sse_lines(spark, d))
    call = F.concat_ws("|", *(F.get("tool_calls", F.lit(0))[c] for c in ("id", "type", "name", "arguments")))
    return got.select("stream_id", F.md5("content").alias("h"), "n_chunks", "n_bad", "finish_reason", "stop_reason", "id", "reasoning", call.alias("call"), "usage.prompt_tokens")


@_query("SELECT task, (3100000 + 1000 * (row_number() OVER (ORDER BY task) - 1))::BIGINT AS seed FROM (SELECT DISTINCT task FROM episodes WHERE task IS NOT NULL)")
def seed_map(spark: SparkSession, d: str) -> DataFrame:
    tasks = T(spark, d, "episodes").where("task is not null").select("task").distinct()
    return tasks.select("task", (F.lit(3100000) + 1000 * (F.row_number().over(Window.orderBy("task")) - 1)).cast("long").alias("seed"))


@_query("SELECT condition_name, min(seed)::BIGINT AS min, max(seed)::BIGINT AS max, count(seed)::BIGINT AS n FROM episodes GROUP BY condition_name")
def seed_registry(spark: SparkSession, d: str) -> DataFrame:
    return report.seed_registry(T(spark, d, "episodes"), ["condition_name"])


@_query("SELECT 9::BIGINT AS n, round(sum(target_share) / 9, 9) AS share, round(sum(max_repeats) / 9.0, 9)::DOUBLE AS repeats FROM mix_targets")
def complete_means(spark: SparkSession, d: str) -> DataFrame:
    got = report.complete_means(T(spark, d, "mix_targets"), {"target_share": "share", "max_repeats": "repeats"}, 9)
    return got.select("n", *(F.round(c, 9).alias(c) for c in ("share", "repeats")))


# ---- checks


@_query("SELECT DISTINCT episode FROM episodes WHERE episode NOT IN (SELECT episode FROM run_status WHERE episode IS NOT NULL) ORDER BY episode LIMIT 5")
def first_differences(spark: SparkSession, d: str) -> DataFrame:
    return checks.outside(T(spark, d, "episodes"), T(spark, d, "run_status").where("episode is not null"), "episode", 5)


@_query("""WITH u AS (SELECT episode FROM run_status WHERE episode IS NOT NULL UNION SELECT episode FROM blocks WHERE episode IS NOT NULL), w AS (SELECT DISTINCT episode FROM episodes)
SELECT episode, 'left' AS side FROM u WHERE episode NOT IN (SELECT episode FROM w) UNION ALL SELECT episode, 'right' FROM w WHERE episode NOT IN (SELECT episode FROM u)""")
def union_equality(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name: T(spark, d, name).where("episode is not null")
    return checks.unions_differ([part("run_status"), part("blocks")], part("episodes"), "episode")


@_query("SELECT doc_id, md5(trim(replace(string_split(text, 'Use ')[1], chr(92) || 'n', chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS h FROM documents WHERE text IS NOT NULL")
def text_before_marker(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.before_marker(F.col("text"), "Use ")).alias("h"))


@_query("SELECT episode, CASE WHEN min(s) = max(s) THEN min(s) ELSE 'both' END AS side FROM (SELECT DISTINCT episode, 'left' AS s FROM run_status WHERE episode IS NOT NULL UNION ALL SELECT DISTINCT episode, 'right' FROM blocks WHERE episode IS NOT NULL) GROUP BY episode")
def split_isolation(spark: SparkSession, d: str) -> DataFrame:
    a, b = T(spark, d, "run_status").where("episode is not null"), T(spark, d, "blocks").where("episode is not null")
    return checks.overlap(a, b, "episode").select("episode", F.lit("both").alias("side")).unionByName(checks.unequal(a, b, "episode"))


@_query("SELECT request_id, count(*)::BIGINT AS n FROM api_requests GROUP BY request_id HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return checks.repeated(T(spark, d, "api_requests"), ["request_id"])


# ---- replies

_REPLY = """WITH raw AS MATERIALIZED (SELECT DISTINCT request_id, response FROM api_requests WHERE path = '/v1/chat/completions' AND status = 200 AND json_valid(response)),
c AS MATERIALIZED (SELECT request_id, response, json_extract(response, '$.choices[0]') AS c FROM raw WHERE json_array_length(response, '$.choices') > 0)"""


@_query(
    _REPLY
    + """, k AS MATERIALIZED (SELECT request_id, unnest(json_extract(c, '$.message.tool_calls[*]'))->>'$.function.arguments' AS a FROM c WHERE json_type(c, '$.message.tool_calls') = 'ARRAY')
SELECT c.request_id, md5(coalesce(c->>'$.message.content', '')) AS content, coalesce(length(c->>'$.message.reasoning_content') > 0, FALSE) AS reasoning,
  (SELECT count(*) FROM k WHERE k.request_id = c.request_id)::BIGINT AS n_calls, (SELECT count(*) FROM k WHERE k.request_id = c.request_id AND starts_with(ltrim(a), '{') AND json_valid(a))::BIGINT AS n_objects,
  coalesce(c->>'$.finish_reason', '') <> 'length' AS kept FROM c"""
)
def replay_messages(spark: SparkSession, d: str) -> DataFrame:
    return replies.replay_form(T(spark, d, "api_requests")).withColumn("content", F.md5("content"))


@_query(
    _REPLY
    + """, k AS MATERIALIZED (SELECT request_id, unnest(json_extract(c, '$.message.tool_calls[*]')) AS t, unnest(range(json_array_length(c, '$.message.tool_calls')::BIGINT)) AS i FROM c WHERE json_type(c, '$.message.tool_calls') = 'ARRAY'),
g AS (SELECT request_id, string_agg(concat_ws('/', t->>'$.id', coalesce(nullif(t->>'$.type', ''), 'function'), t->>'$.function.name',
  CASE WHEN json_valid(t->>'$.function.arguments') THEN array_to_string(list_sort(json_keys(t->>'$.function.arguments')), ',') ELSE t->>'$.function.arguments' END), '|' ORDER BY i) AS calls FROM k GROUP BY request_id)
SELECT c.request_id, c->>'$.finish_reason' AS finish_reason, md5(coalesce(c->>'$.message.content', '')) AS content, md5(nullif(c->>'$.message.reasoning_content', '')) AS reasoning, calls FROM c LEFT JOIN g ON g.request_id = c.request_id"""
)
def replay_forms(spark: SparkSession, d: str) -> DataFrame:
    m = replies.replayed(T(spark, d, "api_requests"))
    text = lambda c: F.coalesce(F.array_join(F.array_sort(F.json_object_keys(c["arguments"].cast("string"))), ","), c["arguments"].cast("string"))
    calls = F.transform("message.tool_calls", lambda c: F.concat_ws("/", c["id"], c["type"], c["name"], text(c)))
    return m.select("request_id", "finish_reason", F.md5("message.content").alias("content"), F.md5("message.reasoning_content").alias("reasoning"), F.array_join(calls, "|").alias("calls"))


@_query("""SELECT DISTINCT request_id, try_cast(response->>'$.usage.prompt_tokens' AS BIGINT) AS input, try_cast(response->>'$.usage.completion_tokens' AS BIGINT) AS output,
  try_cast(response->>'$.usage.prompt_tokens' AS BIGINT) + try_cast(response->>'$.usage.completion_tokens' AS BIGINT) AS total FROM (SELECT request_id, CASE WHEN json_valid(response) THEN response END AS response FROM api_requests)""")
def usage_shapes(spark: SparkSession, d: str) -> DataFrame:
    i, o, t = replies.usage_of(F.col("response"))
    return T(spark, d, "api_requests").select("request_id", i.alias("input"), o.alias("output"), t.alias("total")).distinct()


@_query(_REPLY + " SELECT request_id, md5(c->>'$.message.content') AS h FROM c WHERE c->>'$.message.content' IS NOT NULL")
def response_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "api_requests").where((F.col("path") == threads.CHAT_PATH) & (F.col("status") == 200))
    return rows.select("request_id", F.md5(replies.response_text(F.col("response"))).alias("h")).where("h is not null").distinct()


@_query("""WITH raw AS MATERIALIZED (SELECT DISTINCT request_id, response FROM api_requests WHERE path = '/v1/chat/completions' AND status = 200 AND json_valid(response)),
t AS MATERIALIZED (SELECT request_id, response->>'$.choices[0].message.content' AS t FROM raw WHERE length(response->>'$.choices[0].message.content') > 0),
c AS (SELECT request_id, t, trim(t, ' ') AS w, regexp_extract(t, '(?s)(\\{.*\\})', 1) AS o, regexp_extract(t, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1) AS f FROM t)
SELECT request_id, CASE WHEN starts_with(f, '{') AND json_valid(f) THEN 'fenced' WHEN starts_with(o, '{') AND json_valid(o) THEN 'braces' WHEN starts_with(w, '{') AND json_valid(w) THEN 'whole' ELSE 'none' END AS part,
  (list_filter(regexp_extract_all(t, '(?s)```json\\s*(.*?)```', 1), lambda b: json_valid(b)))[1] AS fenced FROM c""")
def json_fenced_first(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "api_requests").where((F.col("path") == threads.CHAT_PATH) & (F.col("status") == 200))
    t = rows.select("request_id", F.try_variant_get(J.chat_variant("response"), "$.choices[0].message.content", "string").alias("t")).where(F.length("t") > 0)
    return t.select("request_id", X.json_fenced_first(F.col("t")).alias("part"), X.first_fenced_json(F.col("t")).alias("fenced")).distinct()


# ---- validation


@_query("""SELECT doc_id, CASE WHEN text IS NULL OR strlen(text) < 200 THEN 0.0 ELSE length(text) / 100.0 END::DOUBLE AS score FROM documents""")
def zero_if_short(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("doc_id") > 0, F.concat(F.lit('{"score": '), (F.length("text") / 100).cast("string"), F.lit("}")))
    return T(spark, d, "documents").select("doc_id", validation.zero_if_short(F.col("text"), validation.number_of(value)).alias("score"))


@_query("SELECT event_id, value FROM events WHERE value IS NULL OR value NOT BETWEEN 1 AND 50")
def range_violations(spark: SparkSession, d: str) -> DataFrame:
    return validation.out_of_range(T(spark, d, "events"), "value", 1, 50).select("event_id", "value")


@_query("""SELECT match_id, array_to_string(list_filter([CASE WHEN provider IS DISTINCT FROM 'self' THEN 'provider=' || coalesce(provider, 'null') || ', expected self' END, CASE WHEN model IS DISTINCT FROM 'base-27b-l1' THEN 'model=' || coalesce(model, 'null') || ', expected base-27b-l1' END], lambda e: e IS NOT NULL), '; ') AS errors
FROM (SELECT DISTINCT match_id, provider, model FROM pairwise_judge_result) WHERE provider IS DISTINCT FROM 'self' OR model IS DISTINCT FROM 'base-27b-l1'""")
def provenance_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "pairwise_judge_result").select("match_id", "provider", "model").distinct()
    return validation.mismatches(rows, "match_id", {"provider": "self", "model": "base-27b-l1"}).withColumn("errors", F.array_join("errors", "; "))


@_query("SELECT doc_id, greatest(1, floor((length(text) + length(coalesce(source, '')) + 3) / 4.0)) + 100 <= 512 - 64 AS fits, array_to_string(list_transform(list_filter(list_zip(regexp_extract_all(text, 'Use (\\d+) folds', 1), range(len(regexp_extract_all(text, 'Use (\\d+) folds', 1)))), lambda z: list_position(regexp_extract_all(text, 'Use (\\d+) folds', 1), z[1]) = z[2] + 1), lambda z: z[1]), ',') AS limits FROM documents WHERE text IS NOT NULL")
def context_guard(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    fits = validation.fits_context(F.coalesce("source", F.lit("")), t, 100, 512, 64)
    return T(spark, d, "documents").where("text is not null").select("doc_id", fits.alias("fits"), F.array_join(validation.stated_limits(t, r"Use (\d+) folds"), ",").alias("limits"))


@_query("""WITH n AS (SELECT DISTINCT condition_name AS name FROM episodes), w AS (SELECT DISTINCT task, v.range AS version, 't' || task || '_bare' AS base FROM episodes, range(3) v WHERE task IS NOT NULL)
SELECT task, version::INTEGER AS version, CASE WHEN version = 0 THEN base WHEN base || '-v' || version IN (SELECT name FROM n) THEN base || '-v' || version WHEN base IN (SELECT name FROM n) THEN base END AS resolved FROM w""")
def path_resolution(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "episodes")
    wanted = e.where("task is not null").select("task", F.concat(F.lit("t"), F.col("task").cast("string"), F.lit("_bare")).alias("base")).distinct().withColumn("version", F.explode(F.array(*map(F.lit, range(3)))))
    return validation.resolve(wanted, e.select(F.col("condition_name").alias("name")), "base", "version").select("task", "version", "resolved")


@_query("SELECT DISTINCT condition_name, CASE WHEN regexp_matches(condition_name, '_v\\d+$') THEN regexp_replace(condition_name, '_v\\d+$', '_v9') END AS next, CASE WHEN regexp_matches(condition_name, '_v\\d+$') THEN regexp_replace(condition_name, '_v\\d+$', '') END AS base FROM episodes")
def version_siblings(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("condition_name")
    return T(spark, d, "episodes").select(c, validation.sibling(c, 9).alias("next"), validation.sibling(c, 0).alias("base")).distinct()


# ---- prompts and evidence


@_query(_CHAT + _FIRST_USER + """ SELECT episode, mode, md5(v) AS h FROM (SELECT *, row_number() OVER (PARTITION BY episode, v ORDER BY o) AS k FROM form WHERE length(v) > 0) WHERE k = 1""")
def prompt_variants(spark: SparkSession, d: str) -> DataFrame:
    _, asked = _prompts(spark, d)
    index = prompts.sent_index(asked.where(F.col("prompt") == F.concat(F.lit("@"), "p")), "prompt", "p")
    forms = prompts.with_sent(asked.where("prompt is not null"), "prompt", index).select("episode", F.explode(prompts.variants(F.col("prompt"), F.col("sent"))).alias("v"))
    return forms.select("episode", "v.mode", F.md5("v.text").alias("h"))


@_query("""WITH r AS (SELECT doc_id, text, instr(reverse(text), reverse('.')) AS b FROM documents WHERE text IS NOT NULL), s AS (SELECT *, CASE WHEN b > 0 THEN length(text) - b - 1 + 2 ELSE 0 END AS e FROM r)
SELECT doc_id, CASE WHEN starts_with(text, '# ') THEN md5(rtrim(CASE WHEN e > length(text) * 0.7::DOUBLE THEN substr(text, 1, e - 1) ELSE text END, ' ')) END AS h FROM s""")
def design_normalise(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.trim_block(F.col("text"), "# ", ".")).alias("h"))


@_query("""SELECT w.workflow, format('v{}_vs_v{}', version, version + 1) AS adjacent, format('champion_v{}_vs_v{}', 0, version) AS champion, format('v{}_vs_no_harness', version) AS baseline, 'adjacent' AS kind, version AS old, version + 1 AS new FROM workflows w""")
def history_keys(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("version")
    rows = T(spark, d, "workflows").select("workflow", report.comparison_key(v, v + 1).alias("adjacent"), report.comparison_key(F.lit(0), v, "champion").alias("champion"), report.comparison_key(v, v, "baseline").alias("baseline"))
    return rows.withColumn("k", report.parse_key(F.col("adjacent"))).select("*", "k.kind", "k.old", "k.new").drop("k")


@_query("""SELECT task, sha256('{"a":"' || a || '","b":"' || b || '","task":' || task || '}') AS pair_id, (3100000 + 100 * task + 7)::BIGINT AS seed, md5('5-' || match_id) < '8' AS swapped FROM (SELECT DISTINCT match_id, task, a, b FROM pairwise_judge_result WHERE task IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)""")
def pair_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "pairwise_judge_result").where("task is not null and a is not null and b is not null").select("match_id", "task", "a", "b").distinct()
    turned = F.md5(F.concat(F.lit("5-"), F.col("match_id").cast("string"))) < F.lit("8")
    return rows.select("task", report.pair_id(F.col("task"), F.col("a"), F.col("b")).alias("pair_id"), (F.lit(3100000) + 100 * F.col("task") + 7).cast("long").alias("seed"), turned.alias("swapped"))


@_query("""SELECT a, b, r.match_id AS match_id, r.winner AS winner FROM (SELECT a, b, max({'judged_at': judged_at, 'match_id': match_id, 'winner': winner}) AS r FROM (SELECT DISTINCT a, b, judged_at, match_id, winner FROM pairwise_judge_result WHERE judged_at IS NOT NULL AND winner IS NOT NULL) GROUP BY a, b)""")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "pairwise_judge_result").where("judged_at is not null and winner is not null").select("a", "b", "judged_at", "match_id", "winner").distinct()
    return report.latest(rows, ["a", "b"], ["judged_at"]).select("a", "b", "match_id", "winner")


@_query("SELECT event_type, arg_min(user_id, {'n': n, 'u': user_id}) AS user_id FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def least_loaded(spark: SparkSession, d: str) -> DataFrame:
    loads = T(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return report.least_loaded(loads, "event_type", "user_id", "n")


@_query("""WITH p AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings), q AS (SELECT x, round_even(x * 8, 0) / 8 AS y FROM p)
SELECT round(sqrt(sum((x - y) * (x - y))) / sqrt(sum(x * x)), 6) AS relative_error, round(avg((x - y = 0)::INTEGER), 6) AS identical FROM q""")
def norm_errors(spark: SparkSession, d: str) -> DataFrame:
    coarse = F.transform("embedding", lambda x: F.rint(x.cast("double") * 8) / 8)
    return report.norm_errors(T(spark, d, "embeddings").withColumn("coarse", coarse), "embedding", "coarse")


@_query("SELECT l_returnflag, round_even(avg(l_quantity), 2) AS mean, count(*) FILTER (WHERE l_discount > 0.05)::BIGINT AS n_high FROM lineitem GROUP BY l_returnflag")
def rounded_means(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "lineitem").groupBy("l_returnflag").agg(F.bround(F.avg("l_quantity"), 2).alias("mean"), F.count_if(F.col("l_discount") > 0.05).alias("n_high"))


_PATHS = "regexp_extract_all(text, '([A-Za-z0-9_-]+/[A-Za-z0-9_/-]+\\.[a-z]+)', 1)"


@_query(
    _CHAT
    + _FIRST_USER
    + """, m AS (SELECT DISTINCT episode, unnest(regexp_extract_all(array_to_string(texts, ' '), '([A-Za-z0-9_-]+/[A-Za-z0-9_/-]+\\.[a-z]+)', 1)) AS path FROM item),
f AS (SELECT DISTINCT episode, unnest(regexp_extract_all(text, '([A-Za-z0-9_-]+/[A-Za-z0-9_/-]+\\.[a-z]+)', 1)) AS path FROM documents)
SELECT m.episode, count(*)::BIGINT AS mentioned, count(f.path)::BIGINT AS found FROM m LEFT JOIN f ON f.episode = m.episode AND f.path = m.path WHERE m.episode IS NOT NULL GROUP BY m.episode"""
)
def deliverables(spark: SparkSession, d: str) -> DataFrame:
    asked = threads.answered(T(spark, d, "api_requests")).where("episode is not null").select("episode", F.array_join(prompts.first_user_texts(F.col("messages")), " ").alias("text"))
    of = lambda rows: rows.select("episode", F.explode(X.file_paths(F.col("text"))).alias("path"))
    return evidence.deliverables(of(asked), of(T(spark, d, "documents")), "episode")


@_query("""WITH RECURSIVE i AS MATERIALIZED (SELECT episode, doc_id, text, source, length(text) AS n, row_number() OVER (PARTITION BY episode ORDER BY doc_id) AS k FROM documents WHERE episode IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL),
f AS (SELECT episode, doc_id, k, CASE WHEN n <= 5000 THEN n ELSE 0 END AS used, n <= 5000 AS kept FROM i WHERE k = 1
  UNION ALL SELECT i.episode, i.doc_id, i.k, CASE WHEN f.used + i.n <= 5000 THEN f.used + i.n ELSE f.used END, f.used + i.n <= 5000 FROM f JOIN i ON i.episode = f.episode AND i.k = f.k + 1)
SELECT i.episode, md5(string_agg('## ' || i.source || chr(10) || chr(10) || i.text, chr(10) || chr(10) ORDER BY i.doc_id)) AS h FROM f JOIN i ON i.episode = f.episode AND i.k = f.k WHERE f.kept GROUP BY i.episode""")
def evidence_bundle(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents").where("episode is not null and source is not null and text is not null")
    kept = evidence.skip_greedy(docs.withColumn("n", F.length("text")), "episode", "doc_id", "n", 5000).select("doc_id")
    parts = docs.join(kept, "doc_id", "left_semi")
    return evidence.assemble(parts, "episode", "doc_id", "source", "text").select("episode", F.md5("text").alias("h"))


# ---- selection


@_query(f"""WITH ok AS (SELECT DISTINCT episode FROM run_status WHERE {_DONE}), b AS MATERIALIZED (SELECT DISTINCT ON (block_id) episode, kind, ids, mask, block_id FROM blocks WHERE block_id IS NOT NULL)
SELECT block_id, b.episode IN (SELECT episode FROM ok) AS used, coalesce(len(list_filter(mask[2:], lambda x: x = 1)) > 0, FALSE) AS trainable FROM b WHERE kind <> 'system'""")
def window_filters(spark: SparkSession, d: str) -> DataFrame:
    status = T(spark, d, "run_status")
    done = status.where(traces.completed(F.col("exit_code"), F.col("trace_has_success_result"))).select("episode").distinct().withColumn("used", F.lit(True))
    rows = T(spark, d, "blocks").where("block_id is not null and kind <> 'system'").select("block_id", "episode", F.exists(F.slice("mask", F.lit(2), F.greatest(F.size("mask") - 1, F.lit(0))), lambda m: m == 1).alias("t")).dropDuplicates(["block_id"])
    return rows.join(done, "episode", "left").select("block_id", F.coalesce("used", F.lit(False)).alias("used"), F.coalesce("t", F.lit(False)).alias("trainable"))


def _verdicts(spark: SparkSession, d: str) -> Callable[[DataFrame], DataFrame]:
    """Adapter: the episode with fewer requests in its completed runs wins."""
    n = T(spark, d, "run_status").where(traces.completed(F.col("exit_code"), F.col("trace_has_success_result"))).groupBy("episode").agg(F.min("api_requests").alias("n"))
    winner = F.when(F.col("na") < F.col("nb"), "A").when(F.col("na") > F.col("nb"), "B").otherwise("tie")
    return lambda pairs: pairs.join(n.select(F.col("episode").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("episode").alias("b"), F.col("n").alias("nb")), "b").withColumn("winner", winner)


@_query(f"""WITH RECURSIVE ok AS MATERIALIZED (SELECT episode, min(api_requests) AS n FROM run_status WHERE {_DONE} GROUP BY episode),
e AS MATERIALIZED (SELECT task, episode, row_number() OVER (PARTITION BY task ORDER BY md5('7-' || task || '-' || episode), episode) - 1 AS i, count(*) OVER (PARTITION BY task) AS n FROM (SELECT DISTINCT task, episode FROM episodes WHERE task IS NOT NULL AND episode IN (SELECT episode FROM ok))),
p AS MATERIALIZED (SELECT DISTINCT x.task, least(x.episode, y.episode) AS p, greatest(x.episode, y.episode) AS q FROM e x JOIN e y ON x.task = y.task AND x.episode <> y.episode AND (y.i = (x.i + 1) % x.n OR y.i = (x.i + 2) % x.n)),
o AS MATERIALIZED (SELECT p.task, z.i, z.j, z.w FROM p JOIN ok a ON a.episode = p.p JOIN ok b ON b.episode = p.q, LATERAL (SELECT p.p AS i, p.q AS j, CASE WHEN coalesce(a.n < b.n, FALSE) THEN 1.0 WHEN coalesce(a.n > b.n, FALSE) THEN 0.0 ELSE 0.5 END::DOUBLE AS w UNION ALL SELECT p.q, p.p, CASE WHEN coalesce(a.n > b.n, FALSE) THEN 1.0 WHEN coalesce(a.n < b.n, FALSE) THEN 0.0 ELSE 0.5 END::DOUBLE) z),
it AS MATERIALIZED (SELECT task, i, row_number() OVER (PARTITION BY task ORDER BY i) AS k, sum(w) + 0.5 AS g FROM o GROUP BY task, i),
gl AS MATERIALIZED (SELECT o.task, ia.k AS a, list(ib.k ORDER BY ib.k) AS bs FROM o JOIN it ia ON ia.task = o.task AND ia.i = o.i JOIN it ib ON ib.task = o.task AND ib.i = o.j GROUP BY o.task, ia.k),
par AS MATERIALIZED (SELECT it.task, list(it.g ORDER BY k) AS gs, list(gl.bs ORDER BY k) AS bs FROM it JOIN gl ON gl.task = it.task AND gl.a = it.k GROUP BY it.task),
f AS (SELECT task, 0 AS r, list_transform(gs, lambda x: 1.0::DOUBLE) AS p FROM par
  UNION ALL SELECT task, r, list_transform(q, lambda x: x / (list_sum(q) / len(q))) FROM (
    SELECT f.task, f.r + 1 AS r, list_transform(range(1, len(f.p) + 1), lambda k: par.gs[k] / (0.5 / (f.p[k] + 1) + list_sum(list_transform(par.bs[k], lambda h: 1.0 / (f.p[k] + f.p[h]))))) AS q FROM f JOIN par USING (task) WHERE f.r < 500)),
s AS MATERIALIZED (SELECT it.task, it.i AS episode, round(ln(f.p[it.k]), 6) AS rating FROM it JOIN f ON f.task = it.task AND f.r = 500)
SELECT task, episode, rank, CASE WHEN rank <= 3 THEN 'train' WHEN rank = 4 THEN 'validation' ELSE 'none' END AS band FROM (SELECT task, episode, row_number() OVER (PARTITION BY task ORDER BY rating DESC, episode) AS rank FROM s)""")
def rank_select(spark: SparkSession, d: str) -> DataFrame:
    pool = selection.completed_pool(T(spark, d, "episodes"), T(spark, d, "run_status"))
    return selection.rank_and_select(pool, _verdicts(spark, d), 4, 7, 3, 4)


# ---- files


@_query("SELECT status_id, episode, model, FALSE AS bad FROM run_status UNION ALL SELECT NULL, NULL, NULL, TRUE")
def json_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger written compressed, with one line that is cut, and read again in counting mode."""
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows = T(spark, d, "run_status").select("status_id", "episode", "model")
    sinks.append(rows, path, compressed=True)
    spark.createDataFrame([('{"status_id": 1, "epi',)], "line string").coalesce(1).write.mode("append").text(path)
    got = json_lines.read_lines(spark, path, rows.schema, "count")
    return got.select("status_id", "episode", "model", F.col(json_lines.BAD).isNotNull().alias("bad"))


@_query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN 'long' ELSE coalesce(lang, 'none') END AS kind FROM documents")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of all documents, in which the long ones are replaced."""
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    docs = T(spark, d, "documents")
    sinks.upsert(docs.select("doc_id", F.coalesce("lang", F.lit("none")).alias("kind")), path, ["doc_id"])
    sinks.upsert(docs.where(F.length("text") > 1000).select("doc_id", F.lit("long").alias("kind")), path, ["doc_id"])
    return sinks.read_table(spark, path)


@_query("SELECT workflow, version, beats_reference FROM workflows")
def counted_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return json_lines.expect_count(T(spark, d, "workflows").select("workflow", "version", "beats_reference"), 24, "workflows")


@_query("SELECT string_agg(workflow, chr(10) ORDER BY workflow) || chr(10) AS content FROM workflows")
def file_texts(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    T(spark, d, "workflows").select("workflow").repartition(1).sortWithinPartitions("workflow").write.text(path)
    return json_lines.read_texts(spark, path, "part-*").select("content")


_SCRIPTS = "CASE WHEN doc_id % 3 = 0 THEN 'run_' || doc_id || '.py' WHEN doc_id % 3 = 1 THEN source || '/' || CASE WHEN n_chars > 500 THEN 'main.py' ELSE 'domain.py' END ELSE '../' || source || '/a..b' END"


@_query(f"SELECT DISTINCT path FROM (SELECT {_SCRIPTS} AS path FROM documents) WHERE regexp_matches(path, '(^|/)(run_[^/]*\\.py|main\\.py|pipeline\\.py)$')")
def entry_scripts(spark: SparkSession, d: str) -> DataFrame:
    return json_lines.entry_scripts(T(spark, d, "documents").select(F.expr(_SCRIPTS).alias("path")))


@_query(f"SELECT doc_id, starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') AS unsafe FROM (SELECT doc_id, {_SCRIPTS} AS path FROM documents)")
def unsafe_paths(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id", X.unsafe_path(F.expr(_SCRIPTS)).alias("unsafe"))


_MAGIC = "CASE doc_id % 4 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN '25504446' WHEN 2 THEN 'FFD8FF' ELSE '00' END"


@_query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'pdf' WHEN 2 THEN 'jpeg' END AS kind FROM documents")
def media_kinds(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id", validation.media_kind(F.unhex(F.expr(_MAGIC))).alias("kind"))


@_query("SELECT count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS sources FROM documents")
def json_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/one-{uuid.uuid4().hex}.json"
    for _ in range(2):  # the second replaces the first
        sinks.write_json_file(T(spark, d, "documents").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")), path)
    return json_lines.read_document(spark, path, StructType([StructField("n", LongType()), StructField("sources", LongType())]))


@_query("SELECT kind, max_tokens, overlap_tokens FROM split_limits")
def written_once(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/frozen-{uuid.uuid4().hex}"
    for _ in range(2):  # the same rows again change nothing
        sinks.write_once(T(spark, d, "split_limits"), path)
    return spark.read.parquet(path)


@_query("SELECT kind, max_tokens FROM split_limits WHERE kind = 'tool'")
def catalogue_lookup(spark: SparkSession, d: str) -> DataFrame:
    return json_lines.lookup(T(spark, d, "split_limits").select("kind", "max_tokens"), "kind", "tool")


# ---- streams


@_query("SELECT event_id, user_id, event_type FROM events")
def ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    out = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    schema = T(spark, d, "events").schema
    rows = ledgers.file_stream(spark, d, schema, "events.parquet").select("event_id", "user_id", "event_type")
    ledgers.ledger_stream(rows, f"{out}/rows", ["event_id"], f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).json(f"{out}/rows/batch=*")


@_query("SELECT doc_id AS stream_id, md5(text) AS h FROM documents WHERE length(text) > 0")
def sse_stream(spark: SparkSession, d: str) -> DataFrame:
    out = f"{shared_dir(spark)}/sse-{uuid.uuid4().hex}"
    lines = materialize(sse_lines(spark, d), "sse-lines")
    source = ledgers.file_stream(spark, lines.inputFiles()[0].rsplit("/", 1)[0], lines.schema, "*.parquet")
    ledgers.reassembly_stream(source, out, f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("stream_id long, content string").json(f"{out}/batch=*").select("stream_id", F.md5("content").alias("h"))
