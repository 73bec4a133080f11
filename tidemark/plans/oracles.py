"""The same results as plans.queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

_ENV = """
env as (
  select event_id as n, 'evt_' || event_id as event_id, 'ses_u' || user_id as session_id, ts as occurred_at, 'adapter' || (user_id % 4) as source, '/repo/p' || (user_id % 3) as project,
    case event_type when 'error' then 'tool.failed' when 'purchase' then 'tool.completed' when 'click' then 'tool.called' when 'signup' then 'session.started' when 'view' then 'file.read' end as type,
    cast(json_extract_string(props, '$.k') as bigint) as k
  from events
), ops as (
  select *, case when type like 'tool.%' then 'shell|job --shard ' || (k % 20) end as op, case type when 'tool.failed' then 1 when 'tool.completed' then 0 end as exit_code,
    case when type = 'tool.failed' then 'failure/v2|shell|job --shard ' || (k % 20) || '|exit:1' end as failure_signature
  from env
)"""
_SCORE = """
scored as (
  select *, case when n + cx = 0 then 0 else n * 10000 // (n + cx) end as ratio_bps from groups
), rated as (
  select *, least(10000, ratio_bps * 6 // 10 + least(n - 1, 6) * 500 + least(sessions - 1, 4) * 750) as score_bps from scored
)"""
_FAILURES = """
failures as (
  select failure_signature as signature, op, count(*) as n, count(distinct session_id) as sessions from ops where failure_signature is not null group by all
), passed as (
  select op, count(*) as cx from ops where type = 'tool.completed' group by op
), failure_groups as (
  select signature, op, n, sessions, coalesce(cx, 0) as cx from failures left join passed using (op)
)"""
_PAIRS = """
tried as (
  select *, lag(type) over own as before_type, lag(event_id) over own as before_id, lag(occurred_at) over own as before_at, lag(failure_signature) over own as before_signature,
    last_value(case when type = 'tool.completed' then event_id end ignore nulls) over whole as done_id,
    last_value(case when type = 'tool.completed' then op end ignore nulls) over whole as done_op,
    last_value(case when type = 'tool.completed' then occurred_at end ignore nulls) over whole as done_at
  from ops where type in ('tool.completed', 'tool.failed')
  window own as (partition by session_id, op order by occurred_at, event_id), whole as (partition by session_id order by occurred_at, event_id rows between unbounded preceding and 1 preceding)
), pairs as (
  select session_id, event_id as recovered_id, before_id as failure_id, before_signature, op,
    case when (done_at, done_id) > (before_at, before_id) then done_id end as step_id,
    case when (done_at, done_id) > (before_at, before_id) then done_op end as step_op
  from tried where type = 'tool.completed' and before_type = 'tool.failed'
), signed as (
  select *, 'recovery/v2|' || regexp_replace(before_signature, '^failure/v2\\|', '') || '|via|' || step_op as signature from pairs
)"""
_MOTIFS = """
direct as (
  select before_signature, count(*) as cx from signed where step_id is null group by all
), motifs as (
  select signature, before_signature, op as failure_op, step_op, count(*) as n, count(distinct session_id) as sessions from signed where step_id is not null group by all
), recovery_groups as (
  select signature, failure_op, step_op, n, sessions, coalesce(cx, 0) as cx from motifs left join direct using (before_signature)
)"""
_LABEL = "split_part({0}, '|', 1) || ': ' || substr({0}, instr({0}, '|') + 1)"
_ALL = f"""
groups as (
  select 'repeated_command_failure' as detector, signature, 'Repeated command failure: ' || {_LABEL.format('op')} as title, n, sessions, cx from failure_groups
  union all
  select 'repeated_successful_recovery', signature, 'Repeated successful recovery: ' || {_LABEL.format('failure_op')} || ' via ' || {_LABEL.format('step_op')}, n, sessions, cx from recovery_groups
)"""
_FINDINGS = f"with {_ENV}, {_FAILURES}, {_PAIRS}, {_MOTIFS}, {_ALL}, {_SCORE}, gated as (select *, case when n < 3 then 'occurrences' when sessions < 2 then 'distinct_sessions' end as unmet_gate, 'fnd_' || sha256(detector || chr(0) || signature) as finding_id from rated)"
_TALK = """
talk as (
  select conv_id, turn, 'evt_c_' || conv_id || '_' || turn as event_id, 'ses_c' || conv_id as session_id, role,
    case when role = 'user' and turn > 0 then 'user.corrected_agent' when role = 'user' then 'prompt.submitted' when role = 'assistant' then 'decision.recorded' else 'context.compacted' end as type,
    'rule ' || (length(regexp_extract(coalesce(text, ''), '^([^ \\n\\t,.;:!?]+)', 1)) % 7) as label,
    case when role = 'assistant' then case when length(text) % 3 = 0 then 'followed' else 'ignored' end end as outcome
  from conversations
)"""
_STOP = r"""\s'"(){}\[\],&|;<>`""".replace("'", "''")
_HEX = "|".join(f"[0-9]{{{i}}}[a-fA-F][0-9a-fA-F]{{{7 - i},}}" for i in range(7)) + "|[0-9]{7,}[a-fA-F][0-9a-fA-F]*"
_REWRITES = (
    (rf"[a-zA-Z][a-zA-Z0-9+.\-]*://[^{_STOP}]*", "«url»"),
    (rf"(^|[={_STOP}:$])(/[^{_STOP}$#]+/[^{_STOP}$#]*)", r"\1«path»"),
    (rf"(^|[={_STOP}:$])(~/[^{_STOP}$#]*)", r"\1«path»"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "«uuid»"),
    (_HEX, "«hex»"),
    ("[0-9]{4,}", "«n»"),
)
_SECRETS = (
    (r"\bsk-[A-Za-z0-9_-]{16,}\b", "[REDACTED]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[REDACTED]"),
    (r"\bAKIA[A-Z0-9]{16}\b", "[REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}", "Bearer [REDACTED]"),
    (r"(?i)\b(api[_-]?key|access[_-]?token|password|secret)\s*[:=]\s*[""" + "\"''" + r"]?[A-Za-z0-9._~+/=-]{8,}[""" + "\"''" + r"]?", r"\1=[REDACTED]"),
)


def _replaced(text: str, rules) -> str:
    for pattern, mark in rules:
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    return text


_WORDS = r"list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_CASES = """
cases as (
  select 'mut_' || l_suppkey as mutation_id, l_returnflag = 'R' as hit, l_discount > 0.04 as wanted, l_tax < 0.05 as happened from lineitem
)"""
_BPS = "case when {1} = 0 then 0 else ({0}) * 10000 // ({1}) end"

_HELD = """
owned as (select *, 'mut_k' || k as mutation_id, n % 9 = 0 as ninth from env),
cited as (select mutation_id, event_id from owned where type = 'tool.failed' or (ninth and type in ('tool.completed', 'tool.called')))"""

def _match(units: list[str], fits: str) -> str:
    """BM25 of documents by counts of phrases; w and s are the words of text and source."""
    tf = ", ".join(f"{u} as t{k}" for k, u in enumerate(units))
    df = ", ".join(f"count(*) filter (t{k} > 0) as d{k}" for k in range(len(units)))
    score = " + ".join(f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(units)))
    return f"""with w as (select doc_id, coalesce({_WORDS}, []) as w, coalesce({_WORDS.replace('(text)', '(source)')}, []) as s from documents),
c as (select doc_id, len(w) + len(s) as dl, w, {tf} from w), a as (select count(*) as n, avg(dl) as avgdl, {df} from c)
select doc_id, round(-({score}), 6) as bm25 from c, a where {fits}"""


def _word(test: str, words: str = "w") -> str:
    return f"len(list_filter({words}, lambda x: {test}))"


_NEAR = "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = '{0}' and list_contains(w[i + 1:i + 7], '{1}'))) > 0"

ORACLE_SQL = {
    "failure_findings": f"""with {_ENV}, {_FAILURES}, groups as (select * from failure_groups), {_SCORE}
select 'fnd_' || sha256('repeated_command_failure' || chr(0) || signature) as finding_id, signature, n, sessions, cx, ratio_bps, score_bps,
  'mut_' || sha256('deterministic-template/v1' || chr(0) || 'fnd_' || sha256('repeated_command_failure' || chr(0) || signature)) as mutation_id
from rated where n >= 3 and sessions >= 2""",
    "failure_groups": f"with {_ENV}, {_FAILURES} select signature, n, sessions, cx from failure_groups",
    "failure_evidence": f"with {_ENV} select 'fnd_' || sha256('repeated_command_failure' || chr(0) || failure_signature) as finding_id, event_id, session_id, occurred_at from ops where failure_signature is not null",
    "correction_findings": f"""with {_TALK}, corrected as (select label, count(*) as n, count(distinct session_id) as sessions from talk where type = 'user.corrected_agent' group by label),
heeded as (select label, count(*) as cx from talk where type = 'decision.recorded' and outcome = 'followed' group by label),
groups as (select 'correction/v2|' || label as signature, n, sessions, coalesce(cx, 0) as cx from corrected left join heeded using (label)), {_SCORE}
select signature, n, sessions, cx, ratio_bps, score_bps, case when n < 3 then 'occurrences' when sessions < 3 then 'distinct_sessions' end as unmet_gate from rated""",
    "recovery_pairs": f"with {_ENV}, {_PAIRS} select recovered_id, failure_id, step_id, signature from signed",
    "recovery_motifs": f"with {_ENV}, {_PAIRS}, {_MOTIFS}, groups as (select * from recovery_groups), {_SCORE} select signature, n, sessions, cx, ratio_bps, score_bps from rated",
    "direct_retries": f"with {_ENV}, {_PAIRS} select op, count(*) as retries from signed where step_id is null group by op",
    "all_findings": f"{_FINDINGS} select finding_id, detector, signature, title, n, sessions, cx, score_bps from gated where unmet_gate is null",
    "observations_top5": f"{_FINDINGS} select detector, signature, n, sessions, cx, score_bps, unmet_gate from gated where unmet_gate is not null order by n desc, sessions desc, score_bps desc, signature, detector limit 5",
    "scan_report": f"{_FINDINGS} select (select count(*) from env) as events, (select count(distinct session_id) from env) as sessions, count(*) as candidates from gated",
    "fingerprint": f"with {_ENV} select count(*) as events, count(distinct session_id) as sessions, max(occurred_at) as last_event_at, max(n) as last_ingest from env",
    "operation_keys": f"with {_ENV} select 'operation/v2|' || op as operation_key, count(*) as events, count(*) filter (type = 'tool.failed') as failures from ops where op is not null group by op",
    "normalized_text": "select doc_id, sha256(" + _replaced(r"trim(regexp_replace(coalesce(text, '') || ' /srv/data/run-' || doc_id || '/x.txt https://h.example/a?b=' || doc_id || ' ~/w/' || doc_id || ' id ' || md5(doc_id::varchar) || ' n ' || (doc_id + 10000), '\s+', ' ', 'g'))", _REWRITES) + ") as normalized_sha256 from documents",
    "redacted_text": "select doc_id, sha256(" + _replaced("coalesce(text, '') || ' API_KEY=' || md5(doc_id::varchar) || ' Authorization: bearer ' || sha1(doc_id::varchar) || ' sk-' || md5(doc_id::varchar)", _SECRETS) + ") as redacted_sha256, 1::bigint as changed from documents",
    "selectors": f"""with {_ENV} select 'event/v1|type:' || type || case when op is null then '' else '|tool:' || case n % 3 when 0 then 'bash' when 1 then 'exec_command' else 'shell' end end || case when exit_code is null then '' else '|exit:' || exit_code end as selector, count(*) as events from ops group by 1""",
    "parsed_selectors": f"with {_ENV} select distinct failure_signature, 'operation/v2|' || op as operation_key, 1::bigint as exit_code, 2::bigint as grammar from ops where failure_signature is not null",
    "grammar_versions": f"with {_ENV} select distinct 2::bigint as grammar from ops where op is not null",
    "session_rollup": f"""with {_ENV} select session_id, arg_min(source, (occurred_at, event_id)) as source, arg_min(project, (occurred_at, event_id)) as project, min(occurred_at) filter (type = 'session.started') as started_at,
  max(occurred_at) filter (type = 'session.ended') as ended_at, min(occurred_at) as first_event_at, max(occurred_at) as last_event_at, count(*) as events from env group by session_id""",
    "topk_sessions": f"with {_ENV} select session_id, max(occurred_at) as last_event_at, count(*) as events from env group by session_id order by last_event_at desc, session_id limit 50",
    "adapter_activity": f"""with {_ENV}, adapters as (select distinct source from env union all select distinct source || '-idle' from env)
select source, count(distinct session_id) as sessions, count(session_id) as events, max(occurred_at) as last_event_at from adapters left join env using (source) group by source""",
    "global_counts": f"""with {_ENV} select 'events' as "table", count(*) as rows from env union all select 'sessions', count(distinct session_id) from env union all select 'sources', count(distinct source) from env
union all select 'event_artifacts', count(*) from env union all select 'artifacts', count(distinct k) from env""",
    "artifact_identity": f"with {_ENV} select 'file' as type, 'src/' || k || '.py' as path, count(*) as events from env group by k",
    "dedup_first_wins": f"with {_ENV} select event_id, type, n as ingest_seq from env",
    "duplicate_deliveries": f"with {_ENV} select event_id, n + 1000000000 as ingest_seq from env where n % 3 = 0 and n % 6 <> 0",
    "conflict_quarantine": f"with {_ENV} select event_id, 1::bigint as observation_count, n + 1000000000 as first_seen, n + 1000000000 as last_seen from env where n % 6 = 0",
    "sequence_conflicts": f"with {_TALK}, placed as (select *, turn // 2 as sequence from talk) select event_id, session_id, sequence, 'sequence_conflict' as reason from placed qualify turn > min(turn) over (partition by session_id, sequence)",
    "prune_preview": f"with {_ENV}, last as (select session_id, max(occurred_at) as t, count(*) as events from env group by session_id) select session_id, events from last where t < (select max(t) from last) - interval 12 hours",
    "orphan_artifacts": f"with {_ENV} select 'src/' || k || '.py' as path, count(*) as events from env group by k having count(*) filter (type = 'session.started' and n % 7 = 0) = 0",
    "search_projection": f"with {_ENV} select event_id, 'operation/v2|' || op as operation_key from ops where op is not null",
    "exact_signature_lookup": f"with {_ENV} select event_id, occurred_at, type from ops where op = 'shell|job --shard 7'",
    "outcome_filter": f"with {_ENV} select event_id, type, 'outcome=failure' as applied_filters from env where type = 'tool.failed'",
    "project_filter": f"with {_ENV} select type, project, count(*) as events from env where project = '/repo/p1' and occurred_at >= timestamp '2024-01-02' and type in ('tool.failed', 'file.read') group by all",
    "bm25_terms": f"""with w as (select doc_id, {_WORDS} as w from documents), c as (select doc_id, len(w) as dl, len(list_filter(w, lambda x: x = 'the')) as t0, len(list_filter(w, lambda x: x = 'license')) as t1 from w),
s as (select count(*) as n, avg(dl) as avgdl, count(*) filter (t0 > 0) as d0, count(*) filter (t1 > 0) as d1 from c)
select doc_id, round(-(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as bm25
from c, s where t0 > 0 and t1 > 0""",
    "phrase_search": f"with w as (select doc_id, {_WORDS} as w from documents), p as (select doc_id, w, unnest(range(len(w) - 1)) as i from w) select doc_id, i as \"at\" from p where w[i + 1] = 'under' and w[i + 2] = 'the'",
    "hybrid_search": f"""with {_ENV}, hit as (select *, op = 'shell|job --shard 7' as exact, type = 'tool.failed' as failed from ops where op is not null)
select event_id, case when failed then 15000 else 10000 end as score_bps, case when failed then 'signature_and_full_text' else 'exact_signature' end as match_kind from hit where exact order by score_bps desc, occurred_at desc, event_id limit 40""",
    "generated_candidates": f"""{_FINDINGS} select finding_id, 'candidate' as status, 'mut_' || sha256('deterministic-template/v1' || chr(0) || finding_id) as mutation_id,
  'eqv_' || sha256('equivalence/v1' || chr(0) || detector || chr(0) || 'agent_instruction' || chr(0) || signature) as equivalence_key, 'tool_call' as trigger_kind,
  case when detector = 'repeated_successful_recovery' then regexp_replace(title, '^Repeated successful recovery', 'Reuse successful recovery') else regexp_replace(title, '^Repeated', 'Prevent repeated') end as title
from gated where unmet_gate is null""",
    "state_counts": """with moves as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice) as k from lineitem),
log as (select 'mut_' || l_orderkey as mutation_id, k as transition_id, case when l_quantity > 45 and k > 1 then 'rejected' else (['candidate','challenged','replay_passed','shadow_passed','active','retired','rejected'])[least(k, 7)] end as to_state from moves)
select state, count(*) as mutations from (select mutation_id, arg_max(to_state, transition_id) as state from log group by mutation_id) group by state""",
    "illegal_transitions": """with moves as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice) as k from lineitem),
log as (select 'mut_' || l_orderkey as mutation_id, k as transition_id, case when l_quantity > 45 and k > 1 then 'rejected' else (['candidate','challenged','replay_passed','shadow_passed','active','retired','rejected'])[least(k, 7)] end as to_state from moves),
moved as (select *, lag(to_state) over (partition by mutation_id order by transition_id) as from_state from log)
select mutation_id, transition_id, from_state, to_state from moved
where case when from_state is null then to_state <> 'candidate' else from_state || '>' || to_state not in ('candidate>challenged', 'challenged>replay_passed', 'replay_passed>shadow_passed', 'shadow_passed>active', 'active>retired', 'candidate>rejected', 'challenged>rejected', 'replay_passed>rejected', 'shadow_passed>rejected') end""",
    "latest_verdict": """with r as (select 'mut_' || o_custkey as mutation_id, arg_max((['improved', 'unchanged', 'regressed', 'insufficient_data'])[o_orderkey % 4 + 1], (o_orderdate, o_orderkey)) as verdict from orders group by o_custkey)
select coalesce(verdict, 'not_measured') as verdict, count(*) as mutations from (select distinct 'mut_' || c_custkey as mutation_id from customer) left join r using (mutation_id) group by 1""",
    "replay_summary": f"""with {_CASES}, c as (select mutation_id, count(*) as scenarios, count(*) filter (wanted and hit and happened) as successes, count(*) filter (not wanted and not hit) as no_ops,
  count(*) filter (wanted and not (hit and happened)) as contradictions, count(*) filter (not wanted and hit) as false_interventions from cases group by mutation_id),
r as (select *, {_BPS.format('successes + no_ops', 'scenarios')} as success_rate_bps, {_BPS.format('false_interventions', '(no_ops + false_interventions)')} as false_intervention_rate_bps from c),
t as (select *, list_filter([case when scenarios < 5 then 'insufficient_scenarios' end, case when successes + contradictions = 0 then 'missing_intervention_coverage' end, case when no_ops + false_interventions = 0 then 'missing_no_op_coverage' end,
  case when success_rate_bps < 8000 then 'success_rate_below_minimum' end, case when false_intervention_rate_bps > 1000 then 'false_intervention_rate_above_maximum' end], lambda x: x is not null) as f from r)
select * exclude (f), coalesce(array_to_string(f, ','), '') as threshold_failures, len(f) = 0 as passed from t""",
    "shadow_matrix": f"""with {_CASES}, c as (select mutation_id, count(*) as observations, count(*) filter (hit and wanted) as tp, count(*) filter (not hit and not wanted) as tn, count(*) filter (hit and not wanted) as fp, count(*) filter (not hit and wanted) as fn from cases group by mutation_id),
r as (select *, {_BPS.format('tp', '(tp + fp)')} as precision_bps, {_BPS.format('fp', '(tp + fp)')} as false_positive_rate_bps, {_BPS.format('tp', '(tp + fn)')} as recall_bps from c),
t as (select *, list_filter([case when observations < 5 then 'insufficient_observations' end, case when tp + fn = 0 then 'missing_positive_coverage' end, case when tn + fp = 0 then 'missing_negative_coverage' end,
  case when tp + fp = 0 then 'missing_trigger_coverage' end, case when false_positive_rate_bps > 1000 then 'false_positive_rate_above_maximum' end], lambda x: x is not null) as f from r)
select * exclude (f), coalesce(array_to_string(f, ','), '') as threshold_failures, len(f) = 0 as passed from t""",
    "efficacy_windows": f"""with {_ENV}, span as (select min(occurred_at) as a, max(occurred_at) as z, make_timestamp((epoch_us(min(occurred_at)) + epoch_us(max(occurred_at))) // 2) as mid from ops),
fails as (select *, occurred_at >= mid as post from ops, span where type = 'tool.failed' and occurred_at between mid - (z - mid) and z),
c as (select failure_signature, count(*) filter (not post) as pre_n, count(*) filter (post) as post_n, count(distinct session_id) filter (not post) as pre_sessions, count(distinct session_id) filter (post) as post_sessions from fails group by 1),
s as (select epoch_us(z) // 1000000 - epoch_us(mid) // 1000000 as seconds from span),
r as (select *, case when seconds <= 0 then 0 else pre_n * 604800 * 1000 // seconds end as pre_rate_milli, case when seconds <= 0 then 0 else post_n * 604800 * 1000 // seconds end as post_rate_milli
  from (select distinct failure_signature from ops where failure_signature is not null) left join (select failure_signature as fs, * exclude (failure_signature) from c) on fs = failure_signature, s),
d as (select *, case when pre_rate_milli = 0 then null else (post_rate_milli - pre_rate_milli) * 10000 // pre_rate_milli end as delta_bps, case when seconds < 604800 then 'post_window_too_short' end as r1, case when pre_n + post_n < 2 then 'sparse_occurrences' end as r2 from r)
select 'mut_' || sha256('deterministic-template/v1' || chr(0) || 'fnd_' || sha256('repeated_command_failure' || chr(0) || failure_signature)) as mutation_id, pre_n, post_n, pre_sessions, post_sessions, pre_rate_milli::bigint as pre_rate_milli, post_rate_milli::bigint as post_rate_milli, delta_bps::bigint as delta_bps, 10000::bigint as coverage_bps,
  concat_ws(',', r1, r2) as reasons,
  case when r1 is not null or r2 is not null then 'insufficient_data' when delta_bps is null then case when post_n > pre_n then 'regressed' else 'unchanged' end when delta_bps <= -2000 then 'improved' when delta_bps >= 2000 then 'regressed' else 'unchanged' end as verdict
from d""",
    "context_window": f"""with {_ENV}, marked as (select *, type = 'tool.failed' and n % 50 = 0 as is_evidence from env)
select session_id, event_id, is_evidence from marked qualify max(is_evidence::int) over (partition by session_id order by occurred_at, event_id rows between 2 preceding and 2 following) = 1""",
    "forward_fill": f"""with {_ENV} select event_id, last_value(case when type = 'file.read' then 'src/' || k || '.py' end ignore nulls) over (partition by session_id order by occurred_at, event_id rows between unbounded preceding and current row) as place from env""",
    "call_result_pairing": f"""with {_ENV}, b as (select *, lag(type) over w as bt, lag(event_id) over w as bid from ops where op is not null window w as (partition by session_id, op order by occurred_at, event_id))
select event_id as result_id, bid as call_id from b where type <> 'tool.called' and bt = 'tool.called'""",
    "evidence_union": f"with {_ENV}, {_PAIRS} select session_id from ops where failure_signature is not null union select session_id from signed",
    "evidence_intersect": f"with {_ENV} select session_id, op from ops where type = 'tool.failed' intersect select session_id, op from ops where type = 'tool.completed'",
    "missing_evidence": f"with {_ENV} select session_id, op from ops where type = 'tool.failed' except select session_id, op from ops where type = 'tool.completed'",
    "full_outer_merge": f"with {_ENV} select session_id, op, count(*) filter (type = 'tool.failed') as failures, count(*) filter (type = 'tool.completed') as successes from ops where type in ('tool.failed', 'tool.completed') group by all",
    "event_positions": f"with {_ENV} select event_id, row_number() over (partition by session_id order by occurred_at, event_id) - 1 as \"at\" from env",
    "source_upsert": f"with {_ENV} select source as adapter, project as instance_key, case when project = '/repo/p1' and count(*) filter (n % 2 = 1) > 0 then 'Agent ' || project end as display_name, min(occurred_at) as first_seen_at, max(occurred_at) as last_seen_at from env group by source, project",
    "cursor_upsert": f"with {_ENV} select source as adapter, project as instance_key, session_id as origin, arg_max(n, (occurred_at, n)) as position, max(occurred_at) as updated_at from env group by all",
    "within_span": f"with {_ENV} select type, count(*) as events from env where n % 50 <> 0 and date_trunc('second', occurred_at) between timestamp '2024-01-02 04:00:00' and timestamp '2024-01-02 08:00:00' group by type",
    "evidence_presence": f"with {_ENV} select 'fnd_' || sha256('repeated_command_failure' || chr(0) || failure_signature) as finding_id, count(*) as cited, count(*) filter (n % 10 = 3) as missing from ops where failure_signature is not null group by 1",
    "session_listing": f"with {_ENV} select event_id, occurred_at, type from env where session_id = 'ses_u7'",
    "attested_mutations": "select distinct 'mut_' || o_custkey as mutation_id from orders where o_orderstatus = 'F'",
    "applied_transitions": """with moves as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice) as k from lineitem),
log as (select 'mut_' || l_orderkey as mutation_id, k, case when l_quantity > 45 and k > 1 then 'rejected' else (['candidate','challenged','replay_passed','shadow_passed','active','retired','rejected'])[least(k, 7)] end as to_state from moves),
current as (select mutation_id, arg_max(to_state, k) as from_state from log group by mutation_id),
asked as (select 'mut_' || case when o_orderkey % 5 = 0 then -o_orderkey else o_orderkey end as mutation_id, (['challenged', 'rejected', 'active', 'retired'])[o_orderkey % 4 + 1] as to_state from orders where o_orderkey % 7 = 0)
select mutation_id, from_state, to_state, case when from_state is null then 'not_found' when from_state = to_state then 'unchanged'
  when from_state || '>' || to_state in ('candidate>challenged', 'challenged>replay_passed', 'replay_passed>shadow_passed', 'shadow_passed>active', 'active>retired', 'candidate>rejected', 'challenged>rejected', 'replay_passed>rejected', 'shadow_passed>rejected') then 'changed' else 'refused' end as outcome
from asked left join current using (mutation_id)""",
    "word_search": f"""with w as (select doc_id, {_WORDS} as w from documents),
c as (select doc_id, len(w) as dl, len(list_filter(w, lambda x: x = 'the')) as t0, len(list_filter(w, lambda x: x = 'password')) as t1, len(list_filter(w, lambda x: starts_with(x, 'licens'))) as t2, len(list_filter(range(1, len(w)), lambda i: w[i] = 'under' and w[i + 1] = 'the')) as t3, list_contains(w, 'token') as bad from w),
s as (select count(*) as n, avg(dl) as avgdl, count(*) filter (t0 > 0) as d0, count(*) filter (t1 > 0) as d1, count(*) filter (t2 > 0) as d2, count(*) filter (t3 > 0) as d3 from c)
select doc_id, round(-({" + ".join(f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(4))}), 6) as bm25
from c, s where t0 > 0 and t1 + t2 + t3 > 0 and not bad""",
    "constraint_violations": f"""with {_ENV}, e as (
  select n, k, type as sound_type, case when n % 997 = 3 then 'event' when n % 1009 = 8 then 'evt_8' else event_id end as event_id, case when n % 499 <> 7 then session_id end as session_id, case when n % 701 = 5 then 'tool.other' else type end as type,
    case when n % 503 = 4 then -n else n % 2000 end as sequence, case when n % 311 = 6 then 'evt_' else 'evt_' || (n - 1) end as parent, n % 353 = 2 as bad_json, n % 401 = 9 as short
  from env
), s as (
  select session_id, min(project) as project from env where n % 3 < 2 group by session_id having cast(substr(session_id, 6) as bigint) % 50 <> 11
), b as (
  select event_id, 'src/' || k || '.py' as path from env
), known as (
  select event_id from e
)
select * from (
  select 'events' as "table", 'given(event_id,session_id,occurred_at,type,content_hash)' as rule, count(*) as violations from e where session_id is null
  union all select 'events', 'unique(event_id)', (select count(*) from (select event_id from e group by event_id having count(*) > 1))
  union all select 'events', 'unique(session_id,sequence)', (select count(*) from (select session_id, sequence from e where session_id is not null group by all having count(*) > 1))
  union all select 'events', 'prefix(event_id)', count(*) from e where event_id = 'event'
  union all select 'events', 'prefix(parent_event_id)', count(*) from e where parent = 'evt_'
  union all select 'events', 'one_of(type)', count(*) from e where type = 'tool.other'
  union all select 'events', 'at_least(sequence)', count(*) from e where sequence < 0
  union all select 'events', 'json(metadata_json)', count(*) from e where bad_json
  union all select 'events', 'hash(content_hash)', count(*) from e where short
  union all select 'events', 'refers(session_id)', count(*) from e where session_id is not null and session_id not in (select session_id from s)
  union all select 'sessions', 'at_least(events)', count(*) from s where project = '/repo/p1'
  union all select 'event_artifacts', 'some(path,uri,digest)', count(*) from b where path like '%7.py'
  union all select 'event_artifacts', 'refers(event_id)', count(*) from b where event_id not in (select event_id from known)
  union all select 'event_artifacts', 'refers(artifact_id)', count(*) from b where path like '%7.py'
) where violations > 0""",
    "match_or": _match([_word("x = 'password'"), _word("x = 'license'"), _word("x = 'token'")], "t0 > 0 or t1 > 0 and t2 = 0"),
    "match_not": _match([_word("x = 'the'"), _word("x = 'license'"), _word("x = 'password'")], "t0 > 0 and t1 = 0 and t2 = 0"),
    "match_near": _match([_word("x = 'under'"), _word("x = 'license'"), _word("x = 'the'")], f"t2 > 0 and ({_NEAR.format('under', 'license')} or {_NEAR.format('license', 'under')})"),
    "match_columns": _match([_word("starts_with(x, 'src1')", "s"), "len(list_filter(range(1, len(w)), lambda i: w[i] = 'under' and w[i + 1] = 'the'))"], "t0 > 0 and t1 > 0"),
    "match_prefix": _match([_word("starts_with(x, 'licens')"), _word("starts_with(x, 'passw')")], "t0 > 0 or t1 > 0"),
    "draft_cases": f"""with {_ENV}, cited as (
  select event_id, session_id, case when type = 'tool.failed' then 'evidence' else 'counterexample' end as role from ops where op = 'shell|job --shard 7' and type <> 'tool.called'
), sides as (
  select session_id, count(distinct role) as k, min(role) as side from cited group by session_id
), marked as (
  select env.event_id, env.session_id, occurred_at, role, max((role is not null)::int) over (partition by env.session_id order by occurred_at, env.event_id rows between 1 preceding and 1 following) as near
  from env left join cited using (event_id)
), cases as (
  select session_id, case when coalesce(role, side) = 'evidence' then 'intervene' else 'no_op' end as expected, event_id, occurred_at
  from marked join sides using (session_id) where near = 1 and (role is not null or k = 1)
)
select session_id, expected, count(*) as n_events, 'rps_' || sha256('replay-draft/v1' || chr(0) || 'mut_demo' || chr(0) || session_id || chr(0) || expected || chr(0) || string_agg(event_id, chr(0) order by occurred_at, event_id)) as scenario_id
from cases group by session_id, expected""",
    "guarded_sessions": f"with {_ENV}, {_HELD} select distinct session_id from env join cited using (event_id) where mutation_id in (select mutation_id from owned where type = 'tool.failed' and k % 10 = 0)",
    "deleted_session": f"""with {_ENV}, {_HELD}, lost as (select distinct mutation_id from cited join env using (event_id) where session_id = 'ses_u7')
select (select count(*) from env where session_id = 'ses_u7') as events_deleted, (select count(*) from (select k from env group by k having count(*) filter (session_id <> 'ses_u7') = 0)) as artifacts_deleted,
  (select count(distinct mutation_id) from owned where type = 'tool.failed' and mutation_id in (select mutation_id from lost)) as mutations_deleted""",
    "surviving_reports": f"""with {_ENV}, {_HELD}, lost as (select distinct mutation_id from cited join env using (event_id) where session_id = 'ses_u7'),
reports as (select 'eff_' || (n % 50) || '_' || mutation_id as efficacy_id, mutation_id, session_id from owned where type = 'tool.completed' and mutation_id not in (select mutation_id from lost))
select efficacy_id, mutation_id, count(*) as events from reports group by all having count(*) filter (session_id = 'ses_u7') = 0""",
}
