"""DuckDB SQL for the queries of ``registry``, over the same tables."""

from __future__ import annotations

from tracemill.functions.fidelity import ERROR, HARD_WORDS, PROMPT, RUNTIME_ANY, WEIGHTS
from tracemill.operators.worldmodel import SYSTEM
from tracemill.sources.tables import COMMANDS, OUTPUTS

EPISODES = r"""ep_lines AS (
  SELECT l_orderkey, list(struct_pack(n := l_linenumber, p := l_partkey, s := l_suppkey, d := l_shipdate, x := l_extendedprice, q := l_quantity::BIGINT, f := l_returnflag, t := l_linestatus, c := l_discount, tax := l_tax)
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_returnflag, l_linestatus, l_discount, l_tax) AS lines
  FROM lineitem GROUP BY l_orderkey),
ep_base AS (
  SELECT o.*, coalesce(lines, []) AS lines, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at
  FROM orders o LEFT JOIN ep_lines ON o_orderkey = l_orderkey),
ep AS MATERIALIZED (
  SELECT o_orderkey AS ord, o_custkey, 'ep_' || lpad(o_orderkey::VARCHAR, 10, '0') AS id, created_at, (['claude-code', 'codex', 'unknown'])[o_orderkey % 3 + 1] AS agent,
    CASE WHEN o_custkey % 5 = 0 THEN ' Fix ' ELSE 'Please refactor the billing module and add tests for ' END || 'customer ' || o_custkey AS intent,
    CASE WHEN o_custkey % 7 = 6 THEN '' ELSE 'repo' || (o_custkey % 7) END AS repo, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'https://git.example.org/r.git' END AS remote_url, 'b' || (o_orderkey % 9) AS branch,
    list_transform(lines, lambda l, i: {'index': i - 1, 'type': CASE WHEN l.f = 'A' THEN 'file_edit' WHEN l.f = 'R' THEN 'shell_command' WHEN l.n % 2 = 1 THEN 'file_read' ELSE 'user_prompt' END,
      'tool': CASE WHEN l.f = 'A' THEN 'Edit' WHEN l.f = 'R' THEN 'Bash' WHEN l.n % 2 = 1 THEN 'Read' END, 'test': l.f = 'R' AND l.p % 2 = 0,
      'prompt': CASE WHEN l.f = 'N' AND l.n % 2 = 0 THEN 'look at part ' || l.p END,
      'input': CASE WHEN l.f = 'R' THEN '{"command": "' || CASE WHEN l.p % 2 = 0 THEN 'pytest -q' ELSE 'ls src' END || '"}' WHEN l.f = 'N' AND l.n % 2 = 0 THEN '{"prompt": "look at part ' || l.p || '"}' ELSE '{"file_path": "src/m' || (l.p % 50) || '.py"}' END,
      'observation': CASE WHEN l.n = 5 THEN '' ELSE 'part ' || l.p || ' has ' || l.q || CASE WHEN l.f = 'R' THEN ' failed' ELSE ' lines' END END, 'cwd': CASE WHEN l.s % 3 = 0 THEN NULL ELSE '/w/' || (l.s % 4) END}) AS steps,
    list_transform(list_filter(lines, lambda l: l.f = 'A'), lambda l: {'file': CASE WHEN l.p % 3 = 0 THEN 'docs/d' || (l.p % 50) || '.md' WHEN l.p % 3 = 1 THEN 'src/m' || (l.p % 50) || '.py' ELSE CASE WHEN l.p % 2 = 0 THEN 'tests/test_' ELSE 'src/auth_' END || (l.p % 50) || '.py' END,
      'status': CASE WHEN l.p % 4 = 0 THEN 'deleted' ELSE 'modified' END, 'additions': l.q, 'deletions': l.n::BIGINT, 'todo': CASE WHEN l.p % 5 = 0 THEN 'TODO part ' || l.p END}) AS diffs,
    list_transform(list_filter(lines, lambda l: l.f <> 'N' AND l.n <> 7), lambda l: {'passed': CASE WHEN l.f = 'R' AND l.t = 'O' THEN 0 WHEN l.f = 'R' THEN l.q // 2 ELSE l.q END, 'failed': CASE WHEN l.f = 'R' AND l.t = 'O' THEN 0 WHEN l.f = 'R' THEN l.q - l.q // 2 ELSE 0 END,
      'errors': CASE WHEN l.f = 'R' AND l.t = 'O' THEN l.q ELSE 0 END, 'ok': l.f <> 'R'}) AS runs,
    substr(o_orderpriority, 1, 1) AS prio, CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'failed' END AS status, o_orderkey % 17 = 0 AS regressed, substr(md5(o_orderkey::VARCHAR), 1, 12) AS commit_id,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 1000 END AS pr_number, CASE o_orderstatus WHEN 'O' THEN 'OPEN' ELSE 'CLOSED' END AS pr_state, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'pending' ELSE 'success' END AS ci_status,
    len(list_filter(lines, lambda l: l.f = 'A')) AS edits, len(list_filter(lines, lambda l: l.f = 'N')) AS reads, len(list_filter(lines, lambda l: l.f = 'R')) AS shells, len(list_filter(lines, lambda l: l.f <> 'N')) AS tests_run,
    len(list_filter(lines, lambda l: l.tax > 0.07)) AS denials, round(coalesce(list_sum(list_transform(lines, lambda l: l.c)), 0), 2) AS cost,
    CASE WHEN o_orderkey % 2 = 0 THEN 'area' || (o_orderkey % 6) END AS label, CASE WHEN o_orderkey % 7 = 0 THEN (['yes', 'partial', 'no', 'unclear'])[o_orderkey % 4 + 1] END AS hint, (o_orderkey % 11) / 10.0::DOUBLE AS hint_confidence,
    o_orderkey % 5 = 0 AS deployed, o_orderkey % 2 = 0 AS to_prod, o_orderkey % 3 AS deploy_exit
  FROM ep_base)"""

SCORED = EPISODES + r""",
s1 AS (
  SELECT *, len(runs) > 0 AS has_tests, runs[-1] AS last, len(list_filter(runs, lambda r: r.ok)) > 0 AS green,
    CASE prio WHEN '1' THEN 1.0::DOUBLE WHEN '3' THEN (-0.3::DOUBLE * 0.5::DOUBLE + 0.5::DOUBLE * 0.9::DOUBLE) / (0.5::DOUBLE + 0.9::DOUBLE) WHEN '5' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS hl, prio IN ('1', '3', '5') AS has_feedback,
    CASE WHEN NOT deployed THEN NULL WHEN deploy_exit <> 0 THEN false WHEN (status = 'merged' OR prio IN ('1', '3')) AND prio <> '5' THEN true END AS verified,
    CASE WHEN cost > 0 THEN greatest(1, edits)::DOUBLE / (greatest(1, edits)::DOUBLE + cost * 10) END AS ce, CASE WHEN edits + reads + shells = 0 THEN 0.0::DOUBLE ELSE edits::DOUBLE / (edits + reads + shells) END AS ef,
    list_min(list_transform(list_filter(steps, lambda s: s.type = 'file_edit'), lambda s: s.index)) AS first_edit, list_min(list_transform(list_filter(steps, lambda s: s.test), lambda s: s.index)) AS first_test,
    len(list_distinct(list_transform(diffs, lambda d: d.file))) AS n_files
  FROM ep),
s2 AS (
  SELECT *, CASE WHEN NOT has_tests THEN 0.0::DOUBLE ELSE r4(CASE WHEN last.ok THEN 1.0::DOUBLE ELSE last.passed::DOUBLE / (last.passed + last.failed + last.errors) * CASE WHEN green THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END END) END AS ts,
    has_tests AND NOT last.ok AND last.errors > 0 AND last.passed = 0 AND last.failed = 0 AS blocked,
    CASE WHEN deployed AND to_prod AND verified = false THEN -1.0::DOUBLE WHEN deployed AND to_prod AND verified THEN 1.0::DOUBLE END AS dsig,
    len(list_filter(steps, lambda s: s.type = 'file_read' AND s.index < first_edit)) > 0 AS explored
  FROM s1),
s3 AS (
  SELECT *, CASE WHEN status = 'merged' THEN 1.0::DOUBLE WHEN status = 'failed' THEN -1.0::DOUBLE WHEN dsig IS NOT NULL THEN dsig WHEN hint IS NOT NULL THEN CASE hint WHEN 'yes' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.3::DOUBLE WHEN 'no' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END * hint_confidence ELSE 0.0::DOUBLE END AS raw_out,
    CASE WHEN status <> 'open' THEN 'authoritative' WHEN dsig IS NOT NULL THEN 'deploy' WHEN hint IS NOT NULL THEN 'mined' ELSE 'none' END AS osource,
    CASE WHEN has_tests THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c1, CASE WHEN has_tests THEN CASE WHEN blocked THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END AS c2, CASE WHEN has_tests THEN ts END AS c3,
    CASE WHEN first_edit IS NOT NULL AND first_test IS NOT NULL THEN CASE WHEN first_test < first_edit THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END END AS c4, CASE WHEN first_edit IS NOT NULL THEN CASE WHEN explored THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END END AS c5,
    CASE WHEN n_files > 0 THEN CASE WHEN n_files <= 3 THEN 1.0::DOUBLE WHEN n_files <= 8 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END END AS c6, greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.25::DOUBLE * denials) AS c7
  FROM s2),
s4 AS (
  SELECT *, CASE WHEN regressed THEN least(raw_out, -1.0::DOUBLE) ELSE raw_out END AS oscore,
    (2 * c1 + coalesce(2 * c2, 0) + coalesce(3 * c3, 0) + coalesce(c4, 0) + coalesce(c5, 0) + coalesce(c6, 0) + c7) / (3 + CASE WHEN has_tests THEN 5 ELSE 0 END + (c4 IS NOT NULL)::INT + (c5 IS NOT NULL)::INT + (c6 IS NOT NULL)::INT)::DOUBLE AS base,
    list_filter([CASE WHEN c1 < 1 THEN 'has_test_evidence' END, CASE WHEN c2 < 1 THEN 'not_blocked_on_env' END], lambda x: x IS NOT NULL) AS broken
  FROM s3),
s5 AS (SELECT *, r4(CASE WHEN len(broken) > 0 THEN base * 0.5::DOUBLE ELSE base END) AS rub FROM s4),
s6 AS MATERIALIZED (
  SELECT *, r4(0.25::DOUBLE * CASE WHEN has_tests THEN ts ELSE 0.5::DOUBLE END + 0.25::DOUBLE * ((oscore + 1) / 2) + 0.20::DOUBLE * rub + 0.15::DOUBLE * CASE WHEN has_feedback THEN (hl + 1) / 2 ELSE 0.5::DOUBLE END + 0.075::DOUBLE * ef + 0.075::DOUBLE * coalesce(ce, 0.5::DOUBLE)) AS composite
  FROM s5),
s7 AS (
  SELECT *, prio IN ('1', '3') OR coalesce(hint = 'yes', false) OR status = 'merged' OR r4(hl) > 0.1 AS pos, prio = '5' OR coalesce(hint = 'no', false) OR status = 'failed' OR r4(hl) < -0.1 AS neg,
    len(list_filter(diffs, lambda d: d.file NOT LIKE '%.md')) > 0 AS src, len(list_filter(diffs, lambda d: contains(lower(d.file), 'test'))) > 0 AS touches
  FROM s6),
sc AS (
  SELECT *, list_filter([
    CASE WHEN green AND neg THEN {'code': 'test_reward_false_positive', 'category': 'low_coverage_tests', 'severity': 'high'} END,
    CASE WHEN len(list_filter(runs, lambda r: NOT r.ok)) > 0 AND pos THEN {'code': 'test_reward_false_negative', 'category': 'overly_strict_tests', 'severity': 'high'} END,
    CASE WHEN pos AND verified = false THEN {'code': 'outcome_contradiction', 'category': 'reward_contradiction', 'severity': 'high'} END,
    CASE WHEN neg AND verified THEN {'code': 'outcome_contradiction', 'category': 'reward_contradiction', 'severity': 'high'} END,
    CASE WHEN blocked THEN {'code': 'env_blocked', 'category': 'low_coverage_tests', 'severity': 'medium'} END,
    CASE WHEN composite >= 0.5 AND NOT has_tests AND NOT coalesce(verified, false) AND NOT pos THEN {'code': 'unverified_success', 'category': 'low_coverage_tests', 'severity': 'medium'} END,
    CASE WHEN src AND NOT touches AND NOT has_tests AND composite >= 0.5 THEN {'code': 'low_coverage_proxy', 'category': 'low_coverage_tests', 'severity': 'medium'} END,
    CASE WHEN len(trim(intent)) < 40 THEN {'code': 'underspecified_intent', 'category': 'underspecified_intent', 'severity': CASE WHEN prio = '5' THEN 'high' ELSE 'medium' END} END,
    CASE WHEN prio = '5' AND ord % 3 <= greatest(1, len(steps) // 3) THEN {'code': 'misleading_early_correction', 'category': 'misleading_intent', 'severity': 'medium'} END], lambda x: x IS NOT NULL) AS flags
  FROM s7),
v AS (
  SELECT *, CASE WHEN len(list_filter(flags, lambda f: f.severity = 'high')) > 0 THEN 'low' WHEN len(flags) > 0 THEN 'medium' ELSE 'high' END AS trust,
    list_sort(list_distinct(list_transform(flags, lambda f: f.category))) AS categories, status = 'failed' OR regressed OR prio = '5' AS bad
  FROM sc),
g AS MATERIALIZED (SELECT *, trust <> 'low' AS trusted, trust <> 'low' AND (composite >= 0.5 OR status = 'merged' OR prio IN ('1', '3')) AS good, lower(trim(intent)) AS key FROM v)"""

LINES = r"""
lines_ AS (
  SELECT id, intent, s.index AS index, s.type AS type, s.observation AS observation,
    CASE WHEN s.type = 'user_prompt' THEN 'ACTION user_prompt(' || s.prompt || ')' ELSE 'ACTION ' || s.tool || '(' || left(s.input, 120) || ')' || CASE WHEN s.cwd IS NULL THEN '' ELSE ' @ ' || s.cwd END END AS line
  FROM (SELECT id, intent, unnest(steps) AS s FROM {rows}))"""

STEPS = r"""
st AS (
  SELECT conv_id AS episode_id, turn AS index, CASE role WHEN 'user' THEN 'user_prompt' WHEN 'assistant' THEN 'tool_post' ELSE 'note' END AS type, CASE WHEN role = 'assistant' THEN 'Reply' END AS tool, role, text AS observation,
    first(text ORDER BY turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS intent
  FROM conversations)"""

SAMPLES = STEPS.replace("first(text ORDER BY turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS intent", "(SELECT arg_min(c.text, c.turn) FROM conversations c WHERE c.conv_id = conversations.conv_id AND c.role = 'user') AS intent") + r""",
acts AS (SELECT *, coalesce(tool, type) || ': ' || left(observation, 200) AS action FROM st),
ctx AS (
  SELECT *, coalesce(lag(observation) OVER w, '') AS prev_observation,
    right(coalesce(string_agg('ACTION: ' || action || chr(10) || 'OBSERVATION: ' || left(observation, 400), chr(10)) OVER (PARTITION BY episode_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 4000) AS context
  FROM acts WINDOW w AS (PARTITION BY episode_id ORDER BY index)),
samples AS (
  SELECT episode_id, index AS turn_index, action, 'INTENT: ' || coalesce(intent, '') || CASE WHEN context = '' THEN '' ELSE chr(10) || context END || chr(10) || 'ACTION: ' || action || chr(10) || 'OBSERVATION:' AS history, prev_observation, observation AS target_observation
  FROM ctx WHERE trim(observation) <> '')"""


def _pick(values: tuple[str, ...], index: str) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN {_text(v)}" for i, v in enumerate(values)) + " END"


def _text(v: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in v.split("\n"))


EVENTS = rf"""
ev AS (
  SELECT *, CASE WHEN source_type = 'purchase' THEN {_pick(COMMANDS, f"seq % {len(COMMANDS)}")} END AS command, CASE WHEN source_type = 'purchase' THEN {_pick(OUTPUTS, f"seq % {len(OUTPUTS)}")} END AS output,
    CASE WHEN source_type = 'purchase' AND k % 4 <> 3 THEN k % 4 END AS exit_code, CASE WHEN source_type IN ('click', 'view') THEN 'src/f' || (k % 20) || '.py' END AS file_path,
    CASE WHEN source_type = 'signup' THEN CASE WHEN k % 3 = 0 THEN 'yes, ' ELSE '' END || 'work on item ' || k || CASE WHEN k % 2 = 0 THEN ' and describe in detail what has changed there' ELSE '' END END AS prompt
  FROM (SELECT user_id AS session_id, event_id AS seq, ts, event_type AS source_type, value, (props->>'$.k')::INT AS k,
    CASE event_type WHEN 'signup' THEN 'user_prompt' WHEN 'view' THEN 'file_read' WHEN 'click' THEN 'file_edit' WHEN 'purchase' THEN 'shell_command' ELSE 'denial' END AS type FROM events)),
evsteps AS (
  SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS index, type, prompt,
    CASE type WHEN 'user_prompt' THEN prompt WHEN 'shell_command' THEN command WHEN 'file_edit' THEN 'edit ' || file_path WHEN 'file_read' THEN 'read ' || file_path ELSE 'denied tool' END AS intent
  FROM ev),
evseg AS (
  SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY seq) - 1 AS segment
  FROM (SELECT *, (row_number() OVER w = 1 OR (type = 'user_prompt' AND (coalesce(sum((type = 'user_prompt')::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 OR (len(prompt) >= 40 AND prompt NOT LIKE 'yes,%'))))::INT AS opens
    FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY seq))),
evturns AS (
  SELECT session_id, turn, min(index) AS index, arg_min(prompt, index) AS prompt, count_if(type = 'file_edit') AS edits, count_if(type = 'shell_command') AS commands, count_if(type = 'file_read') AS reads, count_if(type = 'denial') AS denials
  FROM (SELECT *, sum((type = 'user_prompt')::INT) OVER (PARTITION BY session_id ORDER BY index) AS turn FROM evsteps) WHERE turn > 0 GROUP BY session_id, turn)"""

OBSERVED = rf"""
ob0 AS (
  SELECT doc_id, source, lang AS domain, CASE WHEN doc_id % 5 = 0 THEN '2024-01-02 03:04:05 pid=77 took 12ms ' WHEN doc_id % 7 = 0 THEN 'error: not found ' ELSE '' END || text AS real FROM documents),
ob1 AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN real WHEN 1 THEN left(real, 150) WHEN 2 THEN '' ELSE '2024-09-09 09:09:09 ' || substr(real, 20, 200) || chr(10) || 'more' END AS fake FROM ob0),
ob2 AS (
  SELECT *, list_distinct(list_filter(regexp_split_to_array(regexp_replace(fake, '{RUNTIME_ANY}', '§RT§', 'g'), '\s+'), lambda x: x <> '')) AS pw, list_distinct(list_filter(regexp_split_to_array(regexp_replace(real, '{RUNTIME_ANY}', '§RT§', 'g'), '\s+'), lambda x: x <> '')) AS gw,
    CASE WHEN fake = '' THEN 0 ELSE len(fake) - len(replace(fake, chr(10), '')) + CASE WHEN suffix(fake, chr(10)) THEN 0 ELSE 1 END END AS pl, CASE WHEN real = '' THEN 0 ELSE len(real) - len(replace(real, chr(10), '')) + CASE WHEN suffix(real, chr(10)) THEN 0 ELSE 1 END END AS gl,
    CASE WHEN trim(fake) = '' THEN 'empty' WHEN regexp_matches(fake, '{ERROR}') THEN 'error' ELSE 'success' END AS pt, CASE WHEN trim(real) = '' THEN 'empty' WHEN regexp_matches(real, '{ERROR}') THEN 'error' ELSE 'success' END AS gt,
    regexp_matches(fake, '{PROMPT}') AS pp, regexp_matches(real, '{PROMPT}') AS gp, real = fake AS exact
  FROM ob1),
ob3 AS (
  SELECT *, CASE WHEN exact THEN 1.0::DOUBLE ELSE ((1.0::DOUBLE - least(1.0::DOUBLE, abs(pl - gl)::DOUBLE / greatest(1, gl))) + 1.0::DOUBLE + CASE WHEN pp = gp THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 3.0::DOUBLE END AS f1,
    CASE WHEN exact OR len(gw) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(pw, gw))::DOUBLE / len(gw) END AS f2, CASE WHEN exact THEN 1.0::DOUBLE WHEN len(pw) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(pw, gw))::DOUBLE / len(pw) END AS f3,
    CASE WHEN exact OR pt = gt THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f4, CASE WHEN exact THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(len(fake) - len(real))::DOUBLE / len(real)) END AS f5
  FROM ob2),
ob AS (
  SELECT *, r4(f1) AS format, r4(f2) AS factuality, r4(f3) AS consistency, r4(f4) AS realism, r4(f5) AS quality, r4(0.15::DOUBLE * f1 + 0.35::DOUBLE * f2 + 0.20::DOUBLE * f3 + 0.15::DOUBLE * f4 + 0.15::DOUBLE * f5) AS composite
  FROM ob3)"""

ORDERED = r"""
ol AS (
  SELECT l_orderkey, list(struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_shipdate, e := l_extendedprice, disc := l_discount, tax := l_tax, qty := l_quantity, flag := l_returnflag)
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax, l_quantity, l_returnflag) AS x
  FROM lineitem GROUP BY l_orderkey)"""

PAIRS = SCORED + r""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY (NOT good), composite DESC, ord) AS r_best, row_number() OVER (PARTITION BY key ORDER BY (NOT bad), composite, ord) AS r_worst, row_number() OVER (PARTITION BY key ORDER BY good, composite, ord) AS r_other,
    row_number() OVER (PARTITION BY key ORDER BY composite, ord) AS r_low, row_number() OVER (PARTITION BY key ORDER BY composite DESC, ord DESC) AS r_high
  FROM g),
top AS (
  SELECT key, count(*) AS n, max(CASE WHEN r_best = 1 AND good THEN {'id': id, 'c': composite} END) AS best, max(CASE WHEN r_worst = 1 AND bad THEN {'id': id, 'c': composite} END) AS worst, max(CASE WHEN r_other = 1 AND NOT good THEN {'id': id, 'c': composite} END) AS other,
    max(CASE WHEN r_low = 1 THEN {'id': id, 'c': composite} END) AS low, max(CASE WHEN r_high = 1 THEN {'id': id, 'c': composite} END) AS high
  FROM ranked GROUP BY key),
dpo AS (
  SELECT key, CASE WHEN worst IS NULL AND other IS NULL THEN high ELSE best END AS ch, coalesce(worst, other, low) AS re FROM top WHERE best IS NOT NULL AND (worst IS NOT NULL OR other IS NOT NULL OR n >= 2)),
pref AS (
  SELECT key, CASE WHEN best IS NOT NULL AND worst IS NOT NULL THEN best ELSE high END AS ch, CASE WHEN best IS NOT NULL AND worst IS NOT NULL THEN worst ELSE low END AS re FROM top
  WHERE n >= 2 AND ((best IS NOT NULL AND worst IS NOT NULL) OR high.c <> low.c))"""
_PAIR = "key, ch.id AS chosen_id, re.id AS rejected_id, ch.c AS chosen_reward, re.c AS rejected_reward"


def _e(sql: str) -> str:
    return "WITH " + EPISODES + "\n" + sql


def _s(sql: str) -> str:
    return "WITH " + SCORED + "\n" + sql


def _v(sql: str) -> str:
    return "WITH " + EVENTS + "\n" + sql


_HELD = "('0x' || substr(sha256('0:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2"
_OUTPUT_LINES = "array_to_string(list_slice(str_split(output, chr(10)), -15, -1), chr(10))"

SQL = {
    "terminal_test_signal": _s("SELECT id, ts AS score, has_tests, blocked FROM s2"),
    "human_label_score": _s("SELECT id, r4(hl) AS human_label FROM s1"),
    "outcome_score": _s("SELECT id, r4(oscore) AS score, osource AS source FROM s4"),
    "cost_and_focus": _s("SELECT id, r4(ce) AS cost_efficiency, r4(ef) AS edit_focus FROM s1"),
    "deploy_verify": _s("SELECT id, CASE WHEN to_prod THEN 'prod' ELSE 'staging' END AS target_env, deploy_exit::INTEGER AS exit_code, verified FROM s1 WHERE deployed"),
    "rubric_score": _s("SELECT id, rub AS score, r4(base) AS base, len(broken) = 0 AS hard_pass, array_to_string(broken, ',') AS hard_violations FROM s5"),
    "rubric_criteria": _s("""SELECT id, c.n AS criterion, c.k AS kind, c.w::DOUBLE AS weight, c.s AS satisfied FROM (SELECT id, unnest([{'n': 'has_test_evidence', 'k': 'hard', 'w': 2, 's': c1}, {'n': 'not_blocked_on_env', 'k': 'hard', 'w': 2, 's': c2},
        {'n': 'tests_end_green', 'k': 'principle', 'w': 3, 's': c3}, {'n': 'reproduce_before_fix', 'k': 'principle', 'w': 1, 's': c4}, {'n': 'explored_before_edit', 'k': 'principle', 'w': 1, 's': c5}, {'n': 'change_is_scoped', 'k': 'principle', 'w': 1, 's': c6}, {'n': 'low_denials', 'k': 'principle', 'w': 1, 's': c7}]) AS c FROM s3) WHERE c.s IS NOT NULL"""),
    "reward_vector": _s("SELECT id, ts AS test_pass, r4(hl) AS human_label, r4(oscore) AS outcome, r4(coalesce(ce, 0)) AS cost_efficiency, r4(ef) AS edit_focus, rub AS rubric, composite, osource AS outcome_source FROM s6"),
    "validity_flags": _s("SELECT id, f.code AS code, f.category AS category, f.severity AS severity FROM (SELECT id, unnest(flags) AS f FROM sc)"),
    "trust_tiers": _s("SELECT id, trust, CASE trust WHEN 'low' THEN 'high' WHEN 'medium' THEN 'medium' END AS severity, array_to_string(categories, ',') AS categories FROM v"),
    "audit_report": _s("SELECT 'trust' AS kind, trust AS name, count(*) AS n FROM v GROUP BY trust UNION ALL SELECT 'category', c, count(*) FROM (SELECT unnest(categories) AS c FROM v) GROUP BY c"),
    "good_and_bad": _s("SELECT id, trusted, good, bad FROM g"),
    "quality_filter": _s("SELECT id, composite FROM v WHERE composite >= 0.5 AND NOT bad"),
    "quality_stats": _s("SELECT count_if(composite >= 0.5 AND NOT bad) AS kept, count_if(NOT (composite >= 0.5 AND NOT bad)) AS dropped, count(*) AS total FROM v"),
    "episode_difficulty": _s("SELECT id, r4(least(1, greatest(0, (1 - composite) + CASE trust WHEN 'low' THEN 0.25::DOUBLE WHEN 'medium' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len(broken) > 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + least(0.15::DOUBLE, 0.05::DOUBLE * denials)))) AS difficulty FROM v"),
    "reward_features": _s("SELECT id, round(ts, 6) AS f0, round(r4(ef), 6) AS f1, round(least(edits / 10.0::DOUBLE, 1), 6) AS f2, round(least(tests_run / 5.0::DOUBLE, 1), 6) AS f3, CASE WHEN has_feedback THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f4, round(least(reads / 20.0::DOUBLE, 1), 6) AS f5, 1.0::DOUBLE AS f6 FROM s6"),
    "feature_correlation": _s("SELECT count(*) AS n, round(corr(r4(ef), composite), 6) AS pearson, round(avg(abs(r4(ef) - composite)), 6) AS mae FROM s6"),
    "validation_errors": _e("SELECT id, 'outcome.status: lost not allowed' AS error FROM ep WHERE ord % 10 = 0 UNION ALL SELECT id, 'intent: required' FROM ep WHERE ord % 15 = 0"),
    "dpo_pairs": f"WITH {PAIRS} SELECT {_PAIR} FROM dpo",
    "dpo_pairs_strict": f"WITH {PAIRS} SELECT {_PAIR} FROM dpo WHERE ch.id <> re.id",
    "dpo_texts": f"WITH {PAIRS}, {LINES.format(rows='ep')}, texts AS (SELECT ep.id, 'USER: ' || any_value(ep.intent) || coalesce(string_agg(chr(10) || line || chr(10) || 'OBS: ' || left(observation, 200), '' ORDER BY index), '') AS t FROM ep LEFT JOIN lines_ ON ep.id = lines_.id GROUP BY ep.id) SELECT ch.id AS chosen_id, re.id AS rejected_id, ep.intent AS prompt, md5(a.t) AS chosen_md5, md5(b.t) AS rejected_md5 FROM dpo JOIN texts a ON a.id = ch.id JOIN texts b ON b.id = re.id JOIN ep ON ep.id = ch.id",
    "preference_pairs": f"WITH {PAIRS} SELECT {_PAIR} FROM pref",
    "trajectory_text": _e(f", {LINES.format(rows='ep')} SELECT ep.id, 'USER: ' || any_value(ep.intent) || coalesce(string_agg(chr(10) || line || chr(10) || 'OBS: ' || left(observation, 200), '' ORDER BY index), '') AS trajectory FROM ep LEFT JOIN lines_ ON ep.id = lines_.id GROUP BY ep.id"),
    "reward_rows": _s(f", {LINES.format(rows='ep')}, texts AS (SELECT ep.id, len('USER: ' || any_value(ep.intent) || coalesce(string_agg(chr(10) || line || chr(10) || 'OBS: ' || left(observation, 200), '' ORDER BY index), '')) AS t FROM ep LEFT JOIN lines_ ON ep.id = lines_.id GROUP BY ep.id) SELECT s6.id AS episode_id, intent AS prompt, t AS trajectory_chars, composite AS scalar_reward FROM s6 JOIN texts ON s6.id = texts.id"),
    "sft_segments": _s(f", {LINES.format(rows='g WHERE good')}, h AS (SELECT *, right(coalesce(string_agg(line || CASE WHEN type = 'user_prompt' THEN '' ELSE chr(10) || 'OBS: ' || left(observation, 200) END, chr(10)) OVER (PARTITION BY id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 4000) AS context FROM lines_) SELECT h.id AS episode_id, index::INTEGER AS step_index, 'USER: ' || left(h.intent, 600) || CASE WHEN context = '' THEN '' ELSE chr(10) || context END AS user, line AS assistant, composite AS reward FROM h JOIN g ON g.id = h.id WHERE type <> 'user_prompt'"),
    "flat_parquet": _s("SELECT id, intent, agent, branch, status AS outcome_status, composite, ts AS test_pass, edits::INTEGER AS file_edits, tests_run::INTEGER AS tests_run, coalesce(list_sum(list_transform(diffs, lambda d: d.additions)), 0)::BIGINT AS additions, coalesce(list_sum(list_transform(diffs, lambda d: d.deletions)), 0)::BIGINT AS deletions FROM s6"),
    "index_rows": _s("SELECT id, created_at, agent, CASE WHEN ord % 10 = 3 THEN 'again: ' ELSE '' END || left(intent, 140) AS intent, branch, status AS outcome, composite AS composite_reward, tests_run::INTEGER AS tests_run, edits::INTEGER AS file_edits, CASE WHEN ord % 10 = 3 THEN 2 ELSE 1 END AS version FROM s6"),
    "rl_transitions": f"WITH {STEPS.split(',' + chr(10) + '    first(')[0] + chr(10) + '  FROM conversations)'} SELECT episode_id, index AS step_index, coalesce(lag(observation) OVER w, '') AS prev_observation, type, observation AS next_observation, lag(index) OVER w IS NULL AS is_first, lead(index) OVER w IS NULL AS done, CASE WHEN lead(index) OVER w IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, CASE WHEN lead(index) OVER w IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS discount FROM st WINDOW w AS (PARTITION BY episode_id ORDER BY index)",
    "rlds_steps": f"WITH {STEPS.split(',' + chr(10) + '    first(')[0] + chr(10) + '  FROM conversations)'} SELECT episode_id, count(*)::INTEGER AS n_steps, 0.5::DOUBLE AS total_reward, string_agg(type, ',' ORDER BY index) AS types, (sum(len(observation)) - arg_max(len(observation), index))::INTEGER AS prev_chars FROM st GROUP BY episode_id",
    "unique_prompts": "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS rn FROM conversations WHERE role = 'user' AND trim(text) <> '') WHERE rn = 1",
    "task_eligibility": _s("SELECT id, skip, coalesce(skip, CASE WHEN remote_url IS NULL THEN 'no_remote' END) AS skip_remote FROM (SELECT *, CASE WHEN NOT trusted THEN 'low_trust' WHEN bad THEN 'bad_outcome' WHEN tests_run - shells = 0 AND ord % 8 <> 3 THEN 'no_verifier' END AS skip FROM g)"),
    "captured_verifier": _e("SELECT id, 'pytest -q' AS command, 'pytest' AS framework, l.q AS passed, 0::BIGINT AS failed, CASE WHEN l.n = 7 THEN 0 ELSE l.q END AS total, 'python:3.12-slim' AS image, true AS portable FROM (SELECT 'ep_' || lpad(o_orderkey::VARCHAR, 10, '0') AS id, list_filter(lines, lambda l: l.f = 'A')[1] AS l FROM ep_base) WHERE l IS NOT NULL UNION ALL SELECT id, 'make test', 'unknown', NULL, NULL, NULL, 'python:3.12-slim', true FROM ep WHERE edits = 0 AND ord % 8 = 3"),
    "wm_samples": f"WITH {SAMPLES} SELECT * FROM samples",
    "wm_one_per_trajectory": f"WITH {SAMPLES}, p AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY turn_index) - 1 AS k, count(*) OVER (PARTITION BY episode_id) AS n FROM samples) SELECT episode_id, turn_index, action FROM p WHERE k = ('0x' || substr(sha256('0:' || episode_id), 1, 8))::BIGINT % n",
    "wm_source_keys": _e("SELECT id, coalesce(nullif(repo, ''), nullif(remote_url, ''), label, 'unknown') AS source FROM ep"),
    "ood_split": "SELECT doc_id, source, CASE WHEN ('0x' || substr(sha256(source || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3 THEN 'holdout' ELSE 'train' END AS split FROM documents",
    "fidelity_score": f"WITH {OBSERVED} SELECT doc_id, format, factuality, consistency, realism, quality, composite, exact FROM ob",
    "bench_grouping": f"WITH {OBSERVED} SELECT CASE WHEN grouping(domain) = 0 THEN 'domain' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS level, coalesce(domain, source, '') AS name, count(*) AS n, r4(avg(format)) AS format, r4(avg(factuality)) AS factuality, r4(avg(consistency)) AS consistency, r4(avg(realism)) AS realism, r4(avg(quality)) AS quality, r4(avg(composite)) AS composite, r4(avg(exact::INT)) AS exact_rate FROM ob GROUP BY GROUPING SETS ((), (domain), (source))",
    "trajectory_scores": f"WITH {OBSERVED} SELECT source, count(*) AS n, r4(avg(composite)) AS mean_composite, arg_max(composite, doc_id) AS final_composite, r4(arg_min(composite, doc_id) - arg_max(composite, doc_id)) AS drift FROM ob GROUP BY source",
    "blended_scores": f"WITH {OBSERVED}, b AS (SELECT *, " + ", ".join(f"CASE WHEN doc_id % 3 = {i % 3} THEN r4(0.5::DOUBLE * {k} + 0.5::DOUBLE * ((doc_id % 10) / 10::DOUBLE)) ELSE {k} END AS b{i}" for i, k in enumerate(WEIGHTS)) + " FROM ob) SELECT doc_id, r4(0.15::DOUBLE * b0 + 0.35::DOUBLE * b1 + 0.20::DOUBLE * b2 + 0.15::DOUBLE * b3 + 0.15::DOUBLE * b4) AS composite FROM b",
    "mask_runtime": f"WITH {OBSERVED} SELECT doc_id, regexp_replace(real, '{RUNTIME_ANY}', '§RT§', 'g') AS masked FROM ob1",
    "classify_content": f"WITH {OBSERVED}, t AS (SELECT *, list_filter(regexp_split_to_array(real, '\\s+'), lambda x: x <> '') AS w FROM ob2) SELECT doc_id, (len(w) - len(list_filter(w, lambda x: regexp_matches(x, '{RUNTIME_ANY}'))))::INTEGER AS deterministic, 0 AS pre_existing, len(list_filter(w, lambda x: regexp_matches(x, '{RUNTIME_ANY}')))::INTEGER AS runtime_metadata, gl::INTEGER AS lines, len(real)::INTEGER AS chars, false AS is_json, gt AS response_type FROM t",
    "session_stats": _v("SELECT session_id, min(ts) AS started_at, max(ts) AS ended_at, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms, count_if(type IN ('file_edit', 'file_read', 'shell_command')) AS tool_calls, count_if(type = 'file_read') AS file_reads, count_if(type = 'file_edit') AS file_edits, count_if(type = 'shell_command') AS shell_commands, count_if(type = 'denial') AS denials, count_if(source_type <> 'error') AS approvals FROM ev GROUP BY session_id"),
    "session_steps": _v("SELECT session_id, seq, index::INTEGER AS index, type, intent FROM evsteps"),
    "touched_files": _v("SELECT DISTINCT session_id, file_path AS file, 'modified' AS status FROM ev WHERE type = 'file_edit'"),
    "session_segments": _v("SELECT session_id, seq, segment::BIGINT AS segment FROM evseg"),
    "feedback_asof": _v(", starts AS (SELECT session_id, segment, min(ts) AS start FROM evseg GROUP BY session_id, segment) SELECT e.session_id, e.seq, (CASE WHEN e.seq % 9 = 0 THEN max(s.segment) ELSE coalesce(max(s.segment) FILTER (WHERE s.start <= e.ts - INTERVAL 3 HOUR), 0) END)::BIGINT AS segment FROM ev e JOIN starts s USING (session_id) WHERE e.type = 'denial' GROUP BY e.session_id, e.seq"),
    "feedback_turns": _v("SELECT session_id, turn::BIGINT AS turn, index::INTEGER AS index, prompt, edits, commands, reads, denials FROM evturns"),
    "rendered_turns": _v("SELECT session_id, right(string_agg('[#' || index || '] USER: ' || prompt || CASE WHEN edits + commands + reads + denials > 0 THEN chr(10) || '    agent: ' || concat_ws(', ', CASE WHEN edits > 0 THEN edits || ' edit(s)' END, CASE WHEN commands > 0 THEN commands || ' command(s)' END, CASE WHEN reads > 0 THEN reads || ' read(s)' END, CASE WHEN denials > 0 THEN denials || ' denial(s)' END) ELSE '' END, chr(10) ORDER BY turn), 6000) AS text FROM evturns GROUP BY session_id"),
    "command_classes": _v(f"SELECT session_id, seq, framework, method, framework IS NOT NULL AS is_test, CASE WHEN method IS NOT NULL AND coalesce(exit_code, 0) <> 0 THEN false END AS verified FROM (SELECT *, CASE seq % {len(COMMANDS)} WHEN 0 THEN 'pytest' WHEN 1 THEN 'pytest' WHEN 3 THEN 'npm-test' WHEN 5 THEN 'go-test' WHEN 6 THEN 'make-test' WHEN 7 THEN 'npm-test' WHEN 14 THEN 'maven-test' END AS framework, CASE seq % {len(COMMANDS)} WHEN 8 THEN 'kubectl' WHEN 9 THEN 'wrangler' WHEN 10 THEN 'flyctl' WHEN 12 THEN 'helm' WHEN 13 THEN 'docker-push' END AS method FROM ev WHERE type = 'shell_command')"),
    "test_runs": _v(f"""SELECT session_id, seq, framework, c.p::BIGINT AS passed, c.f::BIGINT AS failed, c.s::BIGINT AS skipped, c.e::BIGINT AS errors, (c.p + c.f + c.s + c.e)::BIGINT AS total, coalesce(exit_code, 0) = 0 AND c.p + c.f + c.s + c.e > 0 AND c.f = 0 AND c.e = 0 AS ok
        FROM (SELECT *, CASE seq % {len(COMMANDS)} WHEN 0 THEN 'pytest' WHEN 1 THEN 'pytest' WHEN 3 THEN 'npm-test' WHEN 5 THEN 'go-test' WHEN 6 THEN 'make-test' WHEN 7 THEN 'npm-test' WHEN 14 THEN 'maven-test' END AS framework,
          CASE seq % {len(OUTPUTS)} WHEN 0 THEN {{'p': 5, 'f': 0, 's': 0, 'e': 0}} WHEN 1 THEN {{'p': 3, 'f': 2, 's': 1, 'e': 0}} WHEN 2 THEN {{'p': 7, 'f': 1, 's': 2, 'e': 0}} WHEN 3 THEN {{'p': 1, 'f': 1, 's': 0, 'e': 0}} WHEN 4 THEN {{'p': 1, 'f': 1, 's': 0, 'e': 0}} WHEN 5 THEN {{'p': 12, 'f': 0, 's': 0, 'e': 0}} WHEN 6 THEN {{'p': 0, 'f': 0, 's': 0, 'e': 0}} ELSE {{'p': 0, 'f': 0, 's': 0, 'e': 1}} END AS c
        FROM ev WHERE type = 'shell_command') WHERE framework IS NOT NULL AND NOT (seq % {len(OUTPUTS)} = 6 AND exit_code IS NULL)"""),
    "ordinal_backfill": _v(", a AS (SELECT *, row_number() OVER (PARTITION BY session_id, command ORDER BY seq) AS kk, count(*) OVER (PARTITION BY session_id, command) AS nn FROM ev WHERE type = 'shell_command'), b AS (SELECT session_id, command, seq % 3 AS code, row_number() OVER (PARTITION BY session_id, command ORDER BY seq) AS kk, count(*) OVER (PARTITION BY session_id, command) AS nn FROM ev WHERE type = 'shell_command' AND seq % 101 <> 0) SELECT a.session_id, a.seq, a.command, coalesce(a.exit_code, b.code)::INTEGER AS exit_code FROM a LEFT JOIN b ON a.session_id = b.session_id AND a.command = b.command AND a.kk = b.kk AND a.nn = b.nn"),
    "reconstructed_failures": _v(", c AS (SELECT *, seq % 4 = 1 AS bad FROM ev WHERE type = 'shell_command'), q AS (SELECT session_id, command, count(*) AS n, count_if(NOT bad) AS okays, count_if(NOT bad OR seq % 29 = 0) AS posts FROM c GROUP BY ALL) SELECT c.session_id, c.seq * 2 AS seq, c.command, 1 AS exit_code, c.output FROM c JOIN q ON c.session_id = q.session_id AND c.command = q.command WHERE bad AND posts = okays"),
    "merged_feedback": _v(", f AS (SELECT session_id, seq AS ord, 'label' || (k % 4) AS label, CASE WHEN k % 5 <> 0 THEN k % 3 END AS evidence_step_index, CASE source_type WHEN 'signup' THEN 0 ELSE 1 END AS p FROM ev WHERE source_type IN ('signup', 'error')) SELECT session_id, ord, label, evidence_step_index::INTEGER AS evidence_step_index FROM (SELECT *, row_number() OVER (PARTITION BY session_id, label, evidence_step_index ORDER BY p, ord) AS rn FROM f) WHERE p = 0 OR rn = 1"),
    "resolved_intents": _v("SELECT session_id, coalesce(CASE WHEN session_id % 6 = 0 THEN 'task ' || session_id END, arg_min(prompt, seq) FILTER (WHERE type = 'user_prompt'), '') AS intent, arg_min(CASE k % 3 WHEN 1 THEN '/w/app/sub' WHEN 2 THEN '/w/app' END, seq) AS cwd FROM ev GROUP BY session_id"),
    "usage_aggregate": "SELECT 's' || user_id AS session_id, coalesce(sum(floor(value)::BIGINT) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS input_tokens, coalesce(sum(floor(value)::BIGINT) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS output_tokens, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS cost_usd FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id",
    "usage_merge": "WITH u AS (SELECT 's' || user_id AS session_id, coalesce(sum(floor(value)::BIGINT) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS i, coalesce(sum(floor(value)::BIGINT) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS o, coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0) AS c FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id) SELECT session_id, i + CASE WHEN i % 2 = 0 THEN 10 ELSE 0 END AS input_tokens, o + CASE WHEN i % 2 = 0 THEN 5 ELSE 0 END AS output_tokens, round(c + CASE WHEN i % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END, 4) AS cost_usd FROM u",
    "hook_events": r"""WITH h AS (SELECT *, user_id::VARCHAR AS session_id, (['Bash', 'Edit', 'Write', 'Read', 'DeleteFile', 'Grep'])[event_id % 6 + 1] AS tool, event_type IN ('click', 'purchase') AS post, event_id % 11 = 0 AS denied, CASE WHEN event_id % 11 = 0 THEN 'Permission denied' ELSE 'ran ' || event_id END || CASE WHEN event_id % 4 = 0 THEN chr(10) || 'warn' ELSE '' END AS answer FROM events),
        k AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'user_prompt' WHEN event_type = 'view' THEN 'tool_pre' WHEN event_type = 'error' THEN 'note' WHEN denied THEN 'denial' WHEN tool = 'Bash' THEN 'shell_command' WHEN tool = 'Edit' THEN 'file_edit' WHEN tool = 'Write' THEN 'file_write' WHEN tool = 'Read' THEN 'file_read' WHEN tool = 'DeleteFile' THEN 'file_delete' ELSE 'tool_post' END AS type FROM h)
        SELECT session_id, event_id AS seq, type, CASE WHEN post OR event_type = 'view' THEN tool END AS tool_name, CASE WHEN event_type = 'signup' THEN 'do it' END AS prompt, CASE WHEN post THEN answer END AS response, CASE WHEN post THEN NOT denied END AS approved, CASE WHEN type = 'shell_command' THEN 'make all' END AS command,
          CASE WHEN type = 'shell_command' THEN CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 10 = 0 THEN 130 END ELSE event_id % 3 END END::INTEGER AS exit_code, CASE WHEN type LIKE 'file\_%' ESCAPE '\' THEN 'f' || event_id END AS file_path FROM k""",
    "hash_split": _e(f"SELECT id, CASE WHEN {_HELD} THEN 'holdout' ELSE 'train' END AS split FROM ep"),
    "loop_partition": _s(f"SELECT id, CASE WHEN {_HELD} THEN 'holdout' ELSE 'train' END AS split FROM g WHERE composite >= 0.5 AND NOT bad AND trusted"),
    "ranked_holdout": _s(f"SELECT id, CASE WHEN ord % 3 <> 0 THEN r4(ef) END AS score FROM g WHERE composite >= 0.5 AND NOT bad AND trusted AND {_HELD} ORDER BY coalesce(score, 1.0), id LIMIT 50"),
    "promote_decision": _s(f"SELECT count(*) AS n, round(avg(composite), 6) AS candidate_mean, round(avg(rub), 6) AS base_mean, CASE WHEN avg(composite) >= avg(rub) THEN 'promote' ELSE 'keep_base' END AS decision FROM s6 WHERE {_HELD} AND ord % 7 <> 0"),
    "correlate": _s(", p AS (SELECT r4(ef) AS x, composite AS y FROM s6 WHERE ord % 11 <> 0 AND ord % 5 <> 0), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM p) SELECT count(*) AS n, round(corr(x, y), 4) AS pearson, round(corr(rx, ry), 4) AS spearman FROM r"),
    "average_ranks": "SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS rank_p_size FROM part",
    "stratified_split": _e(", c AS (SELECT id, status || '-' || branch AS class FROM ep), w AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY id) AS rn, count(*) OVER (PARTITION BY class) AS n FROM c) SELECT id, class, rn <= CASE WHEN n > 5 THEN 5 ELSE greatest(1, n // 3) END AS held FROM w"),
    "lift_rollup": _s("SELECT CASE WHEN grouping(status) = 1 THEN 'all' ELSE status END AS class, count(*) AS n, count_if(rub >= 0.6) AS base_solved, count_if(composite >= 0.5) AS tuned_solved, count_if(composite >= 0.5) - count_if(rub >= 0.6) AS lift FROM s6 GROUP BY ROLLUP (status)"),
    "regression_map": _e(", b AS (SELECT commit_id AS sha, sum(CASE WHEN ord % 13 + 1 > 5 THEN 2 ELSE 1 END * (ord % 13 + 1)) AS n FROM ep WHERE ord % 40 = 1 GROUP BY commit_id), hit AS (SELECT id, commit_id, n::BIGINT AS n FROM ep JOIN b ON commit_id = sha), f AS (SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(diffs, lambda d: d.file), lambda x: x IN ('src/m0.py', 'src/m10.py', 'src/m20.py', 'src/m30.py', 'src/m40.py')))), ',') AS files FROM ep) SELECT id, 'commit' AS via, commit_id AS commit, n AS blamed_lines, NULL::VARCHAR AS files FROM hit UNION ALL SELECT id, 'file', NULL, 0, files FROM f WHERE files <> '' AND id NOT IN (SELECT id FROM hit)"),
    "should_refresh": _e("SELECT id, pr_number IS NOT NULL AND (status = 'open' OR pr_state = 'OPEN' OR ci_status IS NULL OR ci_status = 'pending') AS refresh FROM ep"),
    "pull_request_outcomes": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'abandoned' END AS status, o_orderstatus = 'F' AS merged, CASE o_orderstatus WHEN 'O' THEN 'OPEN' ELSE 'CLOSED' END AS pr_state, CASE o_orderkey % 5 WHEN 1 THEN 'success' WHEN 2 THEN 'failure' WHEN 3 THEN 'pending' END AS ci_status FROM orders",
    "running_baseline": "SELECT event_id, round(coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), avg(value) OVER (ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0), 6) AS baseline FROM events",
    "gae_advantages": f"WITH {ORDERED}, u AS (SELECT l_orderkey, unnest(x) AS v, unnest(range(0, len(x))) AS pos FROM ol), m AS (SELECT *, v.flag <> 'N' AS act FROM u) SELECT l_orderkey, pos::INTEGER AS pos, round(CASE WHEN act THEN (sum(v.disc) FILTER (WHERE act) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - v.tax ELSE 0 END, 6) + 0 AS advantage FROM m",
    "dis_masks": f"WITH {ORDERED}, u AS (SELECT l_orderkey, unnest(x) AS v FROM ol), r AS (SELECT l_orderkey, v.disc AS a, exp(v.qty / 100 - 0.2::DOUBLE) AS ratio FROM u) SELECT l_orderkey, count_if(NOT (ratio > 1 - 0.2::DOUBLE AND ratio < 1 + 0.2::DOUBLE))::INTEGER AS masked, round(coalesce(sum(a) FILTER (WHERE ratio > 1 - 0.2::DOUBLE AND ratio < 1 + 0.2::DOUBLE), 0), 6) AS kept_sum FROM r GROUP BY l_orderkey",
    "jaccard_overlap": _s(", j AS (SELECT id, ts, list_distinct(list_transform(diffs, lambda d: d.file)) AS a, list_distinct(list_filter(list_transform(steps, lambda s: CASE WHEN s.input LIKE '{\"file_path%' THEN s.input[16:-3] END), lambda x: x IS NOT NULL)) AS b FROM s2), k AS (SELECT id, ts, CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS j FROM j) SELECT id, round(j, 6) AS jaccard, round(0.6::DOUBLE * ts + 0.4::DOUBLE * j, 4) AS replay FROM k"),
    "action_formats": _e(f", {LINES.format(rows='ep')} SELECT id AS episode_id, index::INTEGER AS step_index, line, 1.0::DOUBLE AS reward FROM lines_"),
    "feedback_labels": _e("SELECT id, array_to_string(list_sort(list_filter([label, CASE WHEN regressed THEN 'regression' END, CASE prio WHEN '1' THEN 'useful' WHEN '3' THEN 'too_slow' WHEN '5' THEN 'wrong' END, CASE WHEN prio = '3' THEN 'accepted_after_edits' END], lambda x: x IS NOT NULL)), ',') AS labels FROM ep"),
    "patch_parts": "SELECT p_partkey, o.op, o.path, o.body, o.tool FROM (SELECT p_partkey, unnest([{'op': 'Add', 'path': 'a/' || trim(p_name), 'body': '+x', 'tool': 'Write'}, {'op': 'Delete', 'path': 'b', 'body': '', 'tool': 'DeleteFile'}, {'op': 'Update', 'path': 'c', 'body': '-y' || chr(10) || '+z', 'tool': 'Edit'}]) AS o FROM part)",
    "diff_files": "SELECT p_partkey, d.file, d.status, d.a AS additions, d.d AS deletions, 1 AS n_ranges FROM (SELECT p_partkey, unnest([{'file': 'f', 'status': 'modified', 'a': 2, 'd': 1}, {'file': 'g', 'status': 'added', 'a': 1, 'd': 0}]) AS d FROM part)",
    "prompt_rows": _s("SELECT id AS episode_id, composite AS composite_reward, true AS portable, CASE WHEN edits > 0 THEN 'pytest -q' ELSE 'make test' END AS test_command, substr(md5(ord::VARCHAR), 1, 7) AS base_commit FROM g WHERE trusted AND NOT bad AND (edits > 0 OR ord % 8 = 3) AND remote_url IS NOT NULL"),
    "dataset_manifest": f"WITH {PAIRS} SELECT count(*) AS rows, (SELECT count(DISTINCT x) FROM (SELECT ch.id AS x FROM dpo UNION ALL SELECT re.id FROM dpo))::INTEGER AS episodes FROM dpo",
    "flat_export": _s("SELECT id, intent, agent, branch, status AS outcome_status, composite, ts AS test_pass, edits::INTEGER AS file_edits, tests_run::INTEGER AS tests_run, coalesce(list_sum(list_transform(diffs, lambda d: d.additions)), 0)::BIGINT AS additions, coalesce(list_sum(list_transform(diffs, lambda d: d.deletions)), 0)::BIGINT AS deletions FROM s6"),
    "verdict_majority": "WITH v AS (SELECT l_orderkey AS id, count(*) AS passes, count_if(l_returnflag = 'R') AS broken, avg(l_discount) AS c, count_if(l_linenumber % 2 = 1) AS odd FROM lineitem GROUP BY l_orderkey) SELECT id, passes, broken < passes // 2 + 1 AS trustworthy, CASE WHEN odd >= passes // 2 + 1 THEN 'low_coverage_tests,' ELSE '' END || 'misleading_intent' AS categories, CASE WHEN broken < passes // 2 + 1 THEN 'medium' ELSE 'high' END AS severity, round(c + 1e-9::DOUBLE, 3) AS confidence, round(greatest(broken, passes - broken) / passes::DOUBLE + 1e-9::DOUBLE, 3) AS agreement, greatest(broken, passes - broken) < passes AS escalate FROM v",
    "train_valid_split": "WITH r AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) AS rn, count(*) OVER () AS n FROM part) SELECT p_partkey, p_size, rn, rn <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS valid, rn > greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS train, (rn - 1) // 8 AS batch FROM r",
    "gate_report": "SELECT o_orderkey AS task, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 2 AS clean FROM orders",
    "clipped_texts": "SELECT doc_id, md5(CASE WHEN len(text) <= 400 THEN text ELSE left(text, 123) || chr(10) || '...[trajectory truncated]...' || chr(10) || right(text, 247) END) AS clipped_md5 FROM documents",
    "file_kinds": _e("SELECT DISTINCT file, false AS noise, file LIKE 'tests/%' AS verifier, contains(file, 'test') AS test, suffix(file, '.py') AND NOT contains(file, 'test') AS source FROM (SELECT unnest(list_transform(diffs, lambda d: d.file)) AS file FROM ep)"),
    "replay_ids": _e("SELECT id, 'rp_' || substr(id, 4) || '_' || substr(sha256(id), 1, 8) AS replay_id FROM ep"),
    "escalations": "SELECT doc_id, doc_id % 10 = 0 OR len(text) > 3000 AS escalate FROM documents",
    "applied_regressions": _e("SELECT id, ord % 12 = 0 OR regressed AS caused_regression, concat_ws(',', CASE WHEN ord % 12 = 0 THEN 'c' || (ord % 5) END, CASE WHEN ord % 17 = 0 THEN 'zz' END) AS commits, concat_ws(',', label, CASE WHEN ord % 12 = 0 THEN 'regression' END) AS labels FROM ep"),
    "turn_notices": "WITH n AS (SELECT user_id AS session_id, event_id AS seq, event_type AS t, CASE WHEN event_id % 2 = 0 THEN 'go' END AS prompt FROM events) SELECT session_id, seq, 0 AS part, 'UserPromptSubmit' AS hook, prompt FROM n WHERE t = 'signup' OR (t = 'error' AND prompt IS NOT NULL) UNION ALL SELECT session_id, seq, CASE WHEN prompt IS NULL THEN 0 ELSE 1 END, 'Stop', NULL FROM n WHERE t = 'error'",
    "text_features": "WITH w AS (SELECT doc_id, text, lower(text) AS low, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, round(ln(1 + len(text)), 6) AS log_length, round((" + " + ".join(f"(len(low) - len(replace(low, '{k}', ''))) / {len(k)}::DOUBLE" for k in HARD_WORDS) + "), 6) AS keyword_hits, (len(text) - len(replace(text, '?', '')))::DOUBLE AS question_marks, (len(text) - len(replace(text, '```', ''))) / 3::DOUBLE AS code_fences, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: len(x)))::DOUBLE / len(w) ELSE 0 END, 6) AS avg_word_length FROM w",
    "turing_test": f"WITH {OBSERVED}, r AS (SELECT doc_id, real, fake, len(regexp_extract_all(real, '{RUNTIME_ANY}')) + 2 * gp::INT + least(3, len(real) // 100) AS a, len(regexp_extract_all(fake, '{RUNTIME_ANY}')) + 2 * pp::INT + least(3, len(fake) // 100) AS b, ('0x' || substr(sha256('0:' || doc_id), 1, 8))::BIGINT % 2 AS slot FROM ob2), c AS (SELECT CASE WHEN real = fake THEN 0.5::DOUBLE WHEN (slot = 0 AND a >= b) OR (slot = 1 AND NOT b >= a) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM r) SELECT count(*) AS n, round(avg(p), 4) AS accuracy, round(1 - abs(avg(p) - 0.5::DOUBLE) * 2, 4) AS indistinguishability FROM c",
    "wm_messages": f"WITH {SAMPLES} SELECT episode_id, turn_index, m.place AS place, m.role AS role, md5(m.content) AS content_md5 FROM (SELECT episode_id, turn_index, unnest([{{'place': 0, 'role': 'system', 'content': '{SYSTEM}'}}, {{'place': 1, 'role': 'user', 'content': history}}, {{'place': 2, 'role': 'assistant', 'content': target_observation}}]) AS m FROM samples)",
    "built_episodes": _v(f", s AS (SELECT *, seq % {len(COMMANDS)} AS c, seq % {len(OUTPUTS)} AS o FROM ev) SELECT session_id, 'ep_' || substr(sha1(session_id::VARCHAR), 1, 12) AS id, coalesce(arg_min(prompt, seq) FILTER (WHERE type = 'user_prompt'), '') AS intent, count(*)::INTEGER AS n_steps, count_if(type = 'shell_command')::INTEGER AS n_commands, count_if(type = 'shell_command' AND c IN (0, 1, 3, 5, 6, 7, 14) AND NOT (o = 6 AND exit_code IS NULL))::INTEGER AS n_tests, count_if(type = 'shell_command' AND c IN (8, 9, 10, 12, 13))::INTEGER AS n_deployments, count(DISTINCT file_path) FILTER (WHERE type = 'file_edit')::INTEGER AS n_diffs, count_if(type IN ('file_edit', 'file_read', 'shell_command')) AS tool_calls FROM s GROUP BY session_id"),
    "target_environments": _v(f"SELECT command, m AS method, t AS target_env, count(*) AS n FROM (SELECT command, CASE seq % {len(COMMANDS)} WHEN 8 THEN 'kubectl' WHEN 9 THEN 'wrangler' WHEN 10 THEN 'flyctl' WHEN 12 THEN 'helm' WHEN 13 THEN 'docker-push' END AS m, CASE seq % {len(COMMANDS)} WHEN 9 THEN 'prod' WHEN 10 THEN 'prod' WHEN 12 THEN 'staging' ELSE 'unknown' END AS t FROM ev WHERE type = 'shell_command') WHERE m IS NOT NULL GROUP BY ALL"),
    "built_heads": _v(f", s AS (SELECT *, seq % {len(COMMANDS)} AS c, seq % {len(OUTPUTS)} AS o, session_id % 2 = 0 AS m FROM ev) SELECT session_id, 'ep_' || substr(sha1(session_id::VARCHAR), 1, 12) AS id, CASE WHEN session_id % 4 = 0 THEN 'codex' ELSE 'unknown' END AS agent, coalesce(CASE WHEN session_id % 6 = 0 THEN 'task ' || session_id END, arg_min(prompt, seq) FILTER (WHERE type = 'user_prompt'), '') AS intent, CASE WHEN session_id % 2 = 0 THEN '2024-05-01T00:00:00' ELSE min(ts)::VARCHAR END AS created_at, CASE WHEN session_id % 2 = 0 THEN 'main' END AS branch, CASE WHEN session_id % 2 = 0 THEN 'area' || (session_id % 3) || CASE WHEN session_id % 10 = 0 THEN ',mined_feedback,useful' ELSE '' END || ',zone' ELSE '' END AS labels, 'events' AS diff_source, CASE WHEN session_id % 12 = 0 THEN 'merged' ELSE 'open' END AS status, count_if(type IN ('file_edit', 'file_read', 'shell_command')) AS tool_calls, count_if(type = 'file_read') AS file_reads, count_if(type = 'file_edit') AS file_edits, count_if(type = 'shell_command') AS shell_commands, count_if(type = 'shell_command' AND c IN (0, 1, 3, 5, 6, 7, 14) AND NOT (o = 6 AND exit_code IS NULL)) AS tests_run, count_if(source_type <> 'error') AS approvals, count_if(type = 'denial') AS denials, CASE WHEN session_id % 2 = 0 THEN session_id * 10 ELSE 0 END AS input_tokens, CASE WHEN session_id % 2 = 0 THEN session_id ELSE 0 END AS output_tokens, CASE WHEN session_id % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS cost_usd FROM s GROUP BY session_id"),
    "built_steps": _v("SELECT e.session_id, index::INTEGER AS index, e.type, CASE e.type WHEN 'file_edit' THEN 'Edit' WHEN 'file_read' THEN 'Read' WHEN 'user_prompt' THEN NULL ELSE 'Bash' END AS tool, CASE WHEN e.type = 'denial' THEN 'denied Bash' ELSE replace(s.intent, ' src/', ' /w/app/src/') END AS intent, CASE WHEN e.type = 'user_prompt' THEN '{\"prompt\":\"' || e.prompt || '\"}' WHEN e.type = 'shell_command' THEN '{\"command\":\"' || replace(e.command, '\"', '\\\"') || '\"}' WHEN e.type = 'denial' THEN '{}' ELSE '{\"file_path\":\"/w/app/' || e.file_path || '\"}' END AS input, coalesce(nullif(e.output, ''), e.prompt, '') AS observation, e.source_type <> 'error' AS approved, CASE k % 3 WHEN 1 THEN '/w/app/sub' WHEN 2 THEN '/w/app' END AS cwd FROM ev e JOIN evsteps s ON e.session_id = s.session_id AND e.seq = s.seq"),
    "built_commands": _v(f"SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1)::INTEGER AS place, command, CASE k % 3 WHEN 1 THEN '/w/app/sub' WHEN 2 THEN '/w/app' END AS cwd, exit_code::INTEGER AS exit_code, output AS output_excerpt, seq % {len(COMMANDS)} IN (0, 1, 3, 5, 6, 7, 14) AS is_test, false AS reconstructed FROM ev WHERE type = 'shell_command'"),
    "built_files": _v(", d AS (SELECT session_id, arg_min(CASE k % 3 WHEN 1 THEN '/w/app/sub' WHEN 2 THEN '/w/app' END, seq) AS folder FROM ev GROUP BY session_id), p AS (SELECT ev.session_id, '/w/app/' || file_path AS f, CASE WHEN ev.session_id % 8 = 0 THEN '/w/app/src' ELSE folder END AS base FROM ev JOIN d ON d.session_id = ev.session_id WHERE type = 'file_edit') SELECT DISTINCT session_id, CASE WHEN base IS NOT NULL AND starts_with(f, base || '/') THEN substr(f, len(base) + 2) ELSE f END AS file, 'modified' AS status, 0::BIGINT AS additions FROM p"),
    "session_listing": "SELECT user_id AS session_id, count(*) AS n_events, user_id % 2 = 0 AS has_meta FROM events GROUP BY user_id",
    "meta_patches": _v("SELECT session_id, 'k' || (seq % 3) AS key, arg_max(k::VARCHAR, seq) AS value FROM ev GROUP BY ALL"),
    "index_fallback": _s("SELECT id, created_at, agent, status AS outcome, composite AS composite_reward FROM s6"),
    "renormalised_episodes": _v("SELECT session_id, 'ep_' || substr(sha1(session_id::VARCHAR), 1, 12) AS id, CASE WHEN session_id % 5 > 0 THEN 1 ELSE 0 END AS version, count(*)::INTEGER AS n_steps FROM ev GROUP BY session_id"),
    "command_folders": _e("SELECT id, CASE ord % 8 WHEN 3 THEN '/w/app' WHEN 5 THEN '/w' END AS cwd FROM ep"),
    "low_trust_list": _s("SELECT id, 'high' AS severity, array_to_string(categories, ',') AS categories, array_to_string(list_transform(flags, lambda f: f.code), ',') AS codes FROM v WHERE trust = 'low' ORDER BY id LIMIT 15"),
    "culprit_order": _e("SELECT (ord % 50)::VARCHAR AS sha, sum(ord % 13 + 1)::BIGINT AS blamed_lines FROM ep WHERE ord % 4 = 1 GROUP BY ALL"),
    "limited_rows": "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 50",
    "linked_outcomes": _e("SELECT id, CASE WHEN NOT pr THEN 'open' WHEN ord % 2 = 0 THEN 'merged' WHEN pr_state = 'CLOSED' THEN 'abandoned' ELSE 'open' END AS status, pr AND ord % 2 = 0 AS merged, CASE WHEN pr THEN 'h' ELSE substr(commit_id, 1, 7) END AS commit, CASE WHEN pr THEN 'topic' ELSE branch END AS branch, CASE WHEN pr THEN 'm' END AS merge_commit, CASE WHEN pr THEN pr_state END AS pr_state, CASE WHEN pr THEN CASE ord % 4 WHEN 1 THEN 'success' WHEN 2 THEN 'failure' END END AS ci_status, NULL::VARCHAR AS review_decision, CASE WHEN pr THEN ord END AS pr_number, ord % 5 = 0 AND ord % 2 > 0 AS manual_edits_after_agent, ord % 5 = 0 AND ord % 4 > 0 AS reverted FROM (SELECT * REPLACE (CASE WHEN ord % 3 > 0 AND ord % 31 > 0 THEN pr_state END AS pr_state), ord % 3 > 0 AND ord % 31 > 0 AS pr FROM ep)"),
    "pipeline_sft": _s(f", {LINES.format(rows='g WHERE composite >= 0.5 AND NOT bad')}, texts AS (SELECT g.id, any_value(g.intent) AS intent, any_value(g.composite) AS c, 'USER: ' || any_value(g.intent) || coalesce(string_agg(chr(10) || line || chr(10) || 'OBS: ' || left(observation, 200), '' ORDER BY index), '') AS t FROM g LEFT JOIN lines_ ON g.id = lines_.id WHERE g.composite >= 0.5 AND NOT g.bad GROUP BY g.id) SELECT id AS episode_id, intent AS prompt, md5(t) AS answer_md5, c AS reward FROM texts"),
    "reward_pairs": _s("SELECT intent AS prompt, composite AS target FROM s6 WHERE intent <> ''"),
    "minted_sft": _e("SELECT id, md5(intent || chr(10) || chr(10) || 'Answer with a unified diff in a ```diff block.') AS user_md5, md5('```diff' || chr(10) || coalesce(array_to_string(list_transform(list_filter(diffs, lambda d: d.todo IS NOT NULL), lambda d: '+++ b/x' || chr(10) || '+# ' || replace(d.todo, 'TODO', 'TODO:') || chr(10) || '-old' || chr(10)), ''), '') || '```') AS assistant_md5 FROM ep"),
    "run_summary": "SELECT count(*) AS steps, count_if(event_type = 'click') AS updates, round(avg(value) FILTER (WHERE event_id % 3 <> 0), 6) AS mean_reward, round(avg((event_id % 10) / 10.0::DOUBLE), 6) AS clip_fraction FROM events",
    "response_texts": "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'out ' || event_id || chr(10) || 'bad' WHEN 1 THEN 'a' || chr(10) || 'b' || event_id || chr(10) || 'c' || chr(10) || '7' || chr(10) WHEN 2 THEN 'said ' || event_id WHEN 3 THEN '{\"count\": ' || event_id || '}' WHEN 4 THEN '' WHEN 5 THEN 'plain ' || event_id WHEN 6 THEN 'm' ELSE repeat('x', 6000) || chr(10) || '... [truncated 10 chars]' END AS text FROM events",
    "relative_commands": _v("SELECT session_id, seq, 'cd ./src && ls .; cat /w/a.bc/' || seq AS command FROM ev WHERE type = 'shell_command'"),
    "first_prompts": "SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), arg_min(text, turn), '') AS prompt FROM conversations GROUP BY conv_id",
    "terminal_rewards": "SELECT o_orderkey, (o_orderkey % 5)::INTEGER AS n, CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS last, CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS total FROM orders",
    "verdict_scores": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(1.0::DOUBLE, event_id % 30 / 10.0::DOUBLE) WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM events",
    "fenced_diffs": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '+' || p_name || chr(10) WHEN 1 THEN 'diff --git a b' || chr(10) || '+' || p_name || chr(10) WHEN 2 THEN p_name || chr(10) ELSE p_name END AS diff FROM part",
    "refreshed_verdicts": _s("SELECT id, CASE WHEN ord % 6 = 0 THEN 'low' ELSE trust END AS trust FROM v"),
    "refreshed_outcomes": _e("SELECT id, 'merged' AS status, true AS merged, regressed AS caused_regression, ord % 2 = 0 AS manual_edits_after_agent, 'r' AS commits FROM ep"),
    "first_json_objects": "SELECT event_id, props AS object FROM events",
}


def _expanded(sql: str) -> str:
    # r4(x) stands for four digits as score.r4 gives them, without negative zeros.
    while (at := sql.find("r4(")) >= 0:
        depth, end = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}(round({sql[at + 3 : end - 1]} + 1e-9::DOUBLE, 4) + 0){sql[end:]}"
    return sql


SQL = {name: _expanded(sql) for name, sql in SQL.items()}
