"""SQL for DuckDB that gives the rows of the engine's queries.

Outcomes and claims of the derived steps are stated here as values, not computed by
patterns, so that the SQL is an independent account of what the engine must find.
"""

from __future__ import annotations

from veriloom.functions import patterns as P
from veriloom.plans.derived import RAN, SAID

# Fixed values: (event type, id modulo 4, order, activity, outcome, basis) of observed runs.
_RUNS = [
    ("error", 0, 0, "lint", "failed", "exit-status"), ("error", 1, 0, "lint", "passed", "exit-status"),
    ("error", 2, 0, "lint", "failed", "output-summary"), ("error", 3, 0, "lint", "indeterminate", "none"),
    ("view", 0, 0, "test", "passed", "exit-status"), ("view", 1, 0, "test", "failed", "exit-status"),
    ("view", 2, 0, "test", "failed", "output-summary"), ("view", 3, 0, "test", "indeterminate", "none"),
    ("click", 1, 0, "build", "passed", "exit-status"),
    ("click", 2, 0, "typecheck", "passed", "output-summary"), ("click", 2, 1, "build", "indeterminate", "none"),
]
# Fixed values: (event type, id modulo 4, order, activity, assertion, sentence) of claims.
_CLAIMS = [
    ("purchase", 0, 0, "test", "pass", "All tests pass."), ("purchase", 1, 0, "build", "pass", "The build compiles cleanly."),
    ("purchase", 2, 0, "test", "pass", "make the tests pass."), ("purchase", 3, 0, "typecheck", "pass", "Typecheck passes."), ("purchase", 3, 1, "test", "pass", "All tests pass."),
    ("signup", 0, 0, "lint", "pass", "Lint clean."), ("signup", 1, 0, "test", "pass", "Lint clean, and the suite passes."), ("signup", 1, 1, "lint", "pass", "Lint clean, and the suite passes."),
]


def _q(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_q(x) for x in r) + ")" for r in rows)


_BASE = f"""
WITH ran_(kind, k, command, stdout, code) AS (VALUES {_values([(*a, *b) for a, b in RAN.items()])}),
runs_(kind, k, run_ord, activity, outcome, basis) AS (VALUES {_values(_RUNS)}),
claims_(kind, k, claim_no, activity, assertion, sentence) AS (VALUES {_values(_CLAIMS)}),
said_(kind, k, said) AS (VALUES {_values([(*a, b) for a, b in SAID.items()])}),
steps AS (
    SELECT CAST(user_id AS VARCHAR) AS session_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
           event_id, event_type AS kind, event_id % 4 AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts
    FROM events
),
execs AS (SELECT s.*, r.command, r.stdout, r.code FROM steps s JOIN ran_ r USING (kind, k)),
runs AS (
    SELECT e.session_id, e.seq, CAST(r.run_ord AS INTEGER) AS run_ord, r.activity, r.outcome, r.basis, CAST(e.code AS BIGINT) AS exit_code, e.command
    FROM execs e JOIN runs_ r USING (kind, k)
),
claims AS (SELECT s.session_id, s.seq, c.claim_no, c.activity, c.assertion, c.sentence FROM steps s JOIN claims_ c USING (kind, k)),
nexec AS (SELECT session_id, count(*) AS n FROM execs GROUP BY session_id),
met AS (
    SELECT c.*, arg_max(struct_pack(o := r.outcome, b := r.basis, x := r.exit_code, cmd := r.command), r.seq * 10 + r.run_ord) FILTER (WHERE r.seq <= c.seq) AS latest,
           list(struct_pack(s := r.seq, cmd := r.command) ORDER BY r.seq, r.run_ord) FILTER (WHERE r.seq IS NOT NULL) AS every_run
    FROM claims c LEFT JOIN runs r ON r.session_id = c.session_id AND r.activity = c.activity
    GROUP BY ALL
),
findings AS (
    SELECT m.*, label,
        CASE WHEN latest IS NULL AND every_run IS NOT NULL THEN 'UNKNOWN' WHEN latest IS NULL AND coalesce(n, 0) = 0 THEN 'UNKNOWN' WHEN latest IS NULL THEN 'UNSUPPORTED'
             WHEN latest.o = 'failed' THEN 'CONTRADICTED' WHEN latest.o = 'passed' THEN 'VERIFIED' ELSE 'UNKNOWN' END AS verdict,
        CASE WHEN latest IS NULL AND every_run IS NOT NULL THEN label || ' ran only after this statement — cannot tell what it referred to'
             WHEN latest IS NULL AND coalesce(n, 0) = 0 THEN 'no shell activity recorded in this transcript — evidence may be incomplete'
             WHEN latest IS NULL THEN 'claimed ' || label || ' — no ' || label || ' command was run in ' || n || ' shell invocations'
             WHEN latest.o = 'failed' THEN 'claimed ' || label || ' passed — the last observed ' || label || ' run failed (exit ' || latest.x || ')'
             WHEN latest.o = 'passed' THEN label || ' observed passing via ' || CASE latest.b WHEN 'exit-status' THEN 'exit status 0' ELSE 'runner summary' END
             ELSE label || ' ran but its outcome is not recoverable from the transcript (output piped or suppressed)' END AS reason,
        CASE WHEN latest IS NULL AND every_run IS NOT NULL THEN list_transform(every_run[:3], lambda x: x.cmd) WHEN latest IS NULL THEN [] ELSE [latest.cmd] END AS shown
    FROM (SELECT *, CASE activity WHEN 'test' THEN 'tests' ELSE activity END AS label FROM met) m LEFT JOIN nexec USING (session_id)
),
ranked AS (SELECT *, CASE verdict WHEN 'CONTRADICTED' THEN 0 WHEN 'UNSUPPORTED' THEN 1 WHEN 'UNKNOWN' THEN 2 ELSE 3 END AS rank FROM findings),
per_claim AS (
    SELECT session_id, min(rank) AS rank, arg_min(label, CAST(rank AS BIGINT) * 1000000000 + seq * 10 + claim_no) AS label, count(*) AS claims,
           count(*) FILTER (WHERE rank = 0) AS contradicted, count(*) FILTER (WHERE rank = 1) AS unsupported, count(*) FILTER (WHERE rank = 2) AS unknown, count(*) FILTER (WHERE rank = 3) AS verified
    FROM ranked GROUP BY session_id
),
seen AS (SELECT session_id, string_agg(activity, ',' ORDER BY first) AS observed FROM (SELECT session_id, activity, min(seq * 10 + run_ord) AS first FROM runs GROUP BY ALL) GROUP BY session_id),
nrun AS (SELECT session_id, count(*) AS n FROM runs GROUP BY session_id),
sessions AS (
    SELECT session_id, user_id, min(ts) AS started_at, count(*) FILTER (WHERE event_id % 7 = 0) AS edits, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(event_id % 10) AS BIGINT) AS output_tokens
    FROM steps GROUP BY ALL
),
reports0 AS (
    SELECT s.*, coalesce(p.claims, 0) AS claims, coalesce(contradicted, 0) AS contradicted, coalesce(unsupported, 0) AS unsupported, coalesce(unknown, 0) AS unknown, coalesce(verified, 0) AS verified,
           coalesce(r.n, 0) AS runs, coalesce(e.n, 0) AS execs, coalesce(observed, '') AS observed, p.label,
           coalesce(p.rank, CASE WHEN ',' || coalesce(observed, '') || ',' LIKE '%,test,%' THEN 3 ELSE 2 END) AS rank
    FROM sessions s LEFT JOIN per_claim p USING (session_id) LEFT JOIN nrun r USING (session_id) LEFT JOIN nexec e USING (session_id) LEFT JOIN seen USING (session_id)
),
reports AS (
    SELECT *, ['CONTRADICTED', 'UNSUPPORTED', 'UNKNOWN', 'VERIFIED'][rank + 1] AS verdict,
        CASE WHEN claims > 0 THEN label || [' claimed passing, observed failing', ' claimed, never observed', ' claim not verifiable', ' claimed and observed'][rank + 1]
                  || CASE WHEN claims > 1 THEN ' (' || [contradicted, unsupported, unknown, verified][rank + 1] || ' of ' || claims || ' claims)' ELSE '' END
             WHEN rank = 3 THEN 'tests observed, none claimed' ELSE 'no execution claims made' END AS summary,
        CASE WHEN contradicted + unsupported > 0 THEN 'high' WHEN unknown > 0 THEN 'medium' ELSE 'low' END AS risk,
        ['/work/client/app', '/work/server/app', '/srv/data'][user_id % 3 + 1] AS cwd, ['client/app', 'server/app', 'data'][user_id % 3 + 1] AS folder, 'topic-' || (user_id % 5) AS branch
    FROM reports0
),
branches AS (
    SELECT folder || '/' || branch AS label, branch, cwd, min(rank) AS rank, arg_min(summary, (rank, started_at, session_id)) AS summary,
           count(*) AS n_sessions, arg_min(session_id, (started_at, session_id)) AS first_session, min((started_at, session_id)) AS row_ord,
           CAST(sum(execs) AS BIGINT) AS execs, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens
    FROM reports GROUP BY folder, branch, cwd
)
"""
_VERDICT = "['CONTRADICTED', 'UNSUPPORTED', 'UNKNOWN', 'VERIFIED'][rank + 1] AS verdict"
_LINES = r"list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^\s{4,}\S') AND NOT regexp_matches(l, '^\s*\|'))"
_NO = " OR ".join(f"regexp_matches(s, {_q('(?i)' + p)})" for p in [P.INSTRUCTION, P.INTENT, P.NEGATIVE])
_MAY = f"(NOT (s LIKE '%?' OR s LIKE '%:' OR {_NO}) AND length(s) <= {P.LONGEST})"
_PROSE = rf"""
WITH told AS (SELECT {"[" + ", ".join(_q(s) for s in SAID.values()) + "]"} AS t),
stripped AS (
    SELECT conv_id, turn, array_to_string({_LINES}, chr(10)) || chr(10) || t[(conv_id + turn) % len(t) + 1] AS text
    FROM conversations, told WHERE role = 'assistant'
),
cut AS (
    SELECT conv_id, turn, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?:])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM stripped
),
sentences AS (SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS s FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut))
"""


def _any(name: str, assertion: str | None = None) -> str:
    return "(" + " OR ".join(f"regexp_matches(s, {_q('(?i)' + p)})" for n, a, p in P.CLAIMS if n == name and assertion in (None, a)) + ")"


_HEADS = """
WITH heads AS (
    SELECT CAST(user_id AS VARCHAR) AS session_id, event_id // 4096 AS stretch, count(*) AS events,
           list_reduce(list_prepend(sha256(CAST(user_id AS VARCHAR) || chr(10) || (event_id // 4096)), list(event_type || ' ' || props ORDER BY event_id)), lambda a, x: sha256(a || chr(10) || x)) AS head
    FROM events GROUP BY user_id, event_id // 4096
)
"""
_TREE = """, l3 AS (
    SELECT CAST(3 AS INTEGER) AS level, place, sha256('leaf' || chr(10) || place || chr(10) || events || chr(10) || head) AS hash, CAST(1 AS BIGINT) AS leaves, events
    FROM (SELECT *, sha256(session_id || chr(10) || stretch) AS place FROM heads)
)
""" + "".join(f""", l{k} AS (
    SELECT CAST({k} AS INTEGER) AS level, place[1:{2 * k}] AS place, sha256(string_agg(place || ' ' || hash, chr(10) ORDER BY place)) AS hash, CAST(sum(leaves) AS BIGINT) AS leaves, CAST(sum(events) AS BIGINT) AS events
    FROM l{k + 1} GROUP BY place[1:{2 * k}]
)
""" for k in (2, 1, 0))
_SUFFIX = "list_transform(range(1, len(parts) + 1), lambda d: struct_pack(d := d, s := array_to_string(parts[len(parts) - d + 1:], '/')))"
_URLESC = {"html": "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')", "data": "replace(replace(replace(replace({}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), '::', '%3A%3A')", "property": "replace(replace(replace(replace(replace({}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C')", "script": "replace(replace(replace({}, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"}


SQL = {
    "asof_verdict": _BASE + "SELECT session_id, seq, activity, assertion, sentence, verdict, reason, CAST(len(shown) AS INTEGER) AS runs_shown FROM findings",
    "observed_runs": _BASE + "SELECT * FROM runs",
    "session_reports": _BASE + "SELECT session_id, verdict, summary, risk, claims, contradicted, unsupported, unknown, verified, runs, execs, edits, observed FROM reports",
    "branch_rollup": _BASE + f"SELECT label, branch, cwd, {_VERDICT}, summary, rank < 2 AS needs_attention, CAST(n_sessions AS INTEGER) AS n_sessions, first_session, execs, edits, tokens FROM branches",
    "risk_queue": _BASE + f"SELECT CAST(row_number() OVER (ORDER BY rank, execs DESC, row_ord) AS INTEGER) AS place, label, {_VERDICT}, execs FROM branches",
    "headline_finding": _BASE + """SELECT b.label, f.verdict, f.activity, f.sentence, f.reason
        FROM (SELECT label FROM branches WHERE rank < 2 ORDER BY rank, execs DESC, row_ord LIMIT 1) b
        JOIN reports r ON r.folder || '/' || r.branch = b.label JOIN ranked f ON f.session_id = r.session_id
        ORDER BY f.rank, r.started_at, r.session_id, f.seq * 10 + f.claim_no LIMIT 1""",
    "verdict_tally": _BASE + "SELECT count(*) FILTER (WHERE rank = 0) AS CONTRADICTED, count(*) FILTER (WHERE rank = 1) AS UNSUPPORTED, count(*) FILTER (WHERE rank = 2) AS UNKNOWN, count(*) FILTER (WHERE rank = 3) AS VERIFIED FROM ranked",
    "policy_gate": _BASE + "SELECT policy, count(*) FILTER (WHERE rank < worst) AS violations FROM (VALUES ('contradicted', 1), ('unsupported', 2), ('unknown', 3), ('never', 0)) p(policy, worst), branches GROUP BY policy",
    "report_digest": _BASE + """SELECT session_id, verdict, sentence, CAST(any_value(len(shown)) AS INTEGER) AS runs_shown, array_to_string(shown, '|') AS commands, string_agg(activity, ',' ORDER BY first) AS activities
        FROM (SELECT session_id, verdict, sentence, shown, activity, min(seq * 10 + claim_no) AS first FROM findings GROUP BY ALL) GROUP BY session_id, verdict, sentence, shown""",
    "later_runs": _BASE + "SELECT session_id, seq, activity, array_to_string(list_transform(every_run[:3], lambda x: x.s), ',') AS run_seqs FROM findings WHERE latest IS NULL AND every_run IS NOT NULL",
    "judged_cases": """
        WITH own AS (SELECT user_id || '/' || (event_id % 40) AS s, event_id AS n, event_type AS kind, user_id FROM events WHERE user_id % 4 <> 3 OR event_type <> 'view'),
        acts AS (SELECT *, ['test', 'build', 'lint', 'typecheck'][n % 4 + 1] AS act FROM own),
        ran AS (SELECT s, count(*) AS execs, bool_or(n % 3 = 0) AS denied FROM own WHERE kind = 'view' GROUP BY s),
        met AS (
            SELECT c.s, c.n, c.act, c.user_id, max(r.n) FILTER (WHERE r.n <= c.n) AS last, count(r.n) AS runs
            FROM acts c LEFT JOIN acts r ON r.s = c.s AND r.act = c.act AND r.kind = 'click' WHERE c.kind = 'purchase' GROUP BY ALL
        ),
        told AS (
            SELECT m.*, coalesce(execs, 0) AS execs, coalesce(denied, false) AS denied, CASE act WHEN 'test' THEN 'tests' ELSE act END AS label, n % 3 = 0 AS says_ran,
                   ['passed', 'failed', 'indeterminate'][last % 3 + 1] AS outcome
            FROM met m LEFT JOIN ran USING (s)
        )
        SELECT s AS session_id, n AS seq, act AS activity, CASE WHEN says_ran THEN 'ran' ELSE 'pass' END AS assertion, CAST(CASE WHEN last IS NOT NULL THEN 1 ELSE least(runs, 3) END AS INTEGER) AS shown,
            CASE WHEN last IS NULL THEN CASE WHEN runs > 0 OR execs = 0 OR user_id % 5 = 0 OR denied THEN 'UNKNOWN' ELSE 'UNSUPPORTED' END
                 WHEN outcome = 'failed' THEN 'CONTRADICTED' WHEN outcome = 'passed' OR says_ran THEN 'VERIFIED' ELSE 'UNKNOWN' END AS verdict,
            CASE WHEN last IS NULL AND runs > 0 THEN label || ' ran only after this statement — cannot tell what it referred to'
                 WHEN last IS NULL AND execs = 0 THEN 'no shell activity recorded in this transcript — evidence may be incomplete'
                 WHEN last IS NULL AND user_id % 5 = 0 THEN 'no ' || label || ' command observed, but py_exec, Task can execute code we cannot inspect'
                 WHEN last IS NULL AND denied THEN 'no ' || label || ' command observed, and at least one command was denied before it could run'
                 WHEN last IS NULL THEN 'claimed ' || label || ' — no ' || label || ' command was run in ' || execs || ' shell invocations'
                 WHEN outcome = 'failed' THEN 'claimed ' || label || ' passed — the last observed ' || label || ' run failed' || CASE WHEN last % 2 = 0 THEN ' (exit ' || (last % 5) || ')' ELSE '' END
                 WHEN outcome = 'passed' AND says_ran THEN label || ' did run and succeeded'
                 WHEN outcome = 'passed' THEN label || ' observed passing via ' || CASE last % 2 WHEN 0 THEN 'exit status 0' ELSE 'runner summary' END
                 WHEN says_ran THEN label || ' did run; outcome not determinable'
                 ELSE label || ' ran but its outcome is not recoverable from the transcript (output piped or suppressed)' END AS reason
        FROM told""",
    "transcript_claims": _BASE + """, lined AS (SELECT *, sum(CASE WHEN kind IN ('purchase', 'signup') THEN 1 ELSE 2 END) OVER (PARTITION BY session_id ORDER BY seq) AS line FROM steps)
        SELECT l.session_id, CAST(l.line AS INTEGER) AS seq, c.activity, c.assertion, c.sentence FROM lined l JOIN claims_ c USING (kind, k)""",
    "transcript_execs": _BASE + """, lined AS (SELECT *, sum(CASE WHEN kind IN ('purchase', 'signup') THEN 1 ELSE 2 END) OVER (PARTITION BY session_id ORDER BY seq) AS line FROM steps)
        SELECT l.session_id, CAST(l.line - 1 AS INTEGER) AS seq, 't' || (l.event_id % 5) AS tool_use_id, r.command,
               CASE WHEN r.code = 0 THEN r.stdout ELSE 'Exit code ' || r.code || chr(10) || r.stdout END AS stdout, CAST(r.code AS BIGINT) AS exit_code, CASE WHEN r.code = 0 THEN 'passed' ELSE 'failed' END AS outcome
        FROM lined l JOIN ran_ r USING (kind, k)""",
    "asof_join_orders": """
        SELECT u.o_orderkey, u.o_custkey, arg_max(r.o_orderkey, (r.o_orderdate, r.o_orderkey)) AS last_orderkey, arg_max(r.o_orderpriority, (r.o_orderdate, r.o_orderkey)) AS last_priority
        FROM orders u LEFT JOIN orders r ON r.o_custkey = u.o_custkey AND r.o_orderdate <= u.o_orderdate AND r.o_orderpriority <> '1-URGENT'
        WHERE u.o_orderpriority = '1-URGENT' GROUP BY u.o_orderkey, u.o_custkey""",
    "output_signs": """
        WITH o AS (SELECT p_partkey, p_partkey % 4 AS n, p_size % 3 AS s FROM part)
        SELECT p_partkey, CASE WHEN s = 0 AND n > 0 THEN 'failed' WHEN s = 0 THEN 'passed' ELSE 'none' END AS test, CASE WHEN s = 1 AND n > 0 THEN 'failed' WHEN s = 1 THEN 'passed' ELSE 'none' END AS lint, 'none' AS build, 'none' AS migrate FROM o""",
    "split_segments": """
        WITH o AS (SELECT o_orderkey, 'run-' || o_orderkey || ' 2>&1' AS a, 'grep "a|b;c" ' || o_orderstatus AS b, o_orderkey % 7 IN (3, 4) AS piped FROM orders)
        SELECT o_orderkey, 0 AS pos, a AS text, 0 AS pipe_index, NOT piped AS last_in_pipe FROM o
        UNION ALL SELECT o_orderkey, 1, b, CASE WHEN piped THEN 1 ELSE 0 END, false FROM o
        UNION ALL SELECT o_orderkey, 2, 'tail &> log', CASE WHEN piped THEN 2 ELSE 1 END, true FROM o""",
    "prose_sentences": _PROSE + f"SELECT conv_id, turn, pos, s AS sentence, {_MAY} AS may_claim FROM sentences",
    "prose_claims": _PROSE + " UNION ALL ".join(f"SELECT conv_id, turn, {_q(n)} AS activity, CASE WHEN bool_or({_any(n, 'pass')}) THEN 'pass' ELSE 'ran' END AS assertion, arg_min(CASE WHEN length(s) > {P.QUOTED} THEN s[:{P.QUOTED - 3}] || '…' ELSE s END, pos) AS sentence FROM sentences WHERE {_MAY} AND {_any(n)} GROUP BY conv_id, turn" for n in P.CLAIMABLE),
    "redact_text": """SELECT doc_id, sha256(regexp_replace(text, '(token = ")[0-9a-f]{40}(")', '\\1«redacted:sensitive-key»\\2', 'g')) AS sha, CAST(coalesce(len(regexp_extract_all(text, 'token = "[0-9a-f]{40}"')), 0) AS BIGINT) AS sensitive FROM documents""",
    "redaction_counts": """SELECT 'sensitive-key' AS kind, CAST(sum(len(regexp_extract_all(text, 'token = "[0-9a-f]{40}"'))) AS BIGINT) AS n FROM documents HAVING n > 0""",
    "entropy": """SELECT page_id, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM (
        SELECT page_id, ch, count(*) AS c, any_value(length(url)) AS n FROM (SELECT page_id, url, unnest(string_split(url, '')) AS ch FROM pages) WHERE ch <> '' GROUP BY page_id, ch) GROUP BY page_id""",
    "html_escape": f"SELECT page_id, md5({_URLESC['html'].format('html')}) AS escaped, md5({_URLESC['script'].format('html')}) AS script, md5({_URLESC['data'].format('html')}) AS data, md5({_URLESC['property'].format('html')}) AS property FROM pages",
    "encode_path": "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9]', '-', 'g') AS folder, url AS plain FROM pages",
    "labels": f"""
        WITH paths AS (SELECT DISTINCT '/' || n_name || '/' || c_mktsegment || '/' || (c_custkey % 7) || '/app' || (c_custkey % 40) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey),
        cut AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM paths),
        suffixes AS (SELECT path, len(parts) AS n, unnest({_SUFFIX}) AS x FROM cut),
        shared AS (SELECT x.s AS s, count(*) AS k FROM suffixes GROUP BY x.s)
        SELECT path, arg_min(s, x.d) AS label FROM suffixes JOIN shared ON shared.s = suffixes.x.s WHERE k = 1 OR x.d = n GROUP BY path""",
    "chain_build": "SELECT count(*) AS events, list_reduce(list_prepend(repeat('0', 64), list(event_type || ' ' || props ORDER BY event_id)), lambda a, x: sha256(a || chr(10) || x)) AS head FROM events",
    "chain_breaks": """
        WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS id, lag(event_id) OVER (ORDER BY event_id) AS before FROM events)
        SELECT id FROM e WHERE event_id % 2500 <> 7 AND (event_id % 1000 = 3 OR before % 2500 = 7)""",
    "stretch_heads": _HEADS + "SELECT session_id, stretch, events, head FROM heads",
    "stretch_breaks": """
        WITH e AS (SELECT user_id, event_id, row_number() OVER own AS id, lag(event_id) OVER own AS before FROM events WINDOW own AS (PARTITION BY user_id, event_id // 4096 ORDER BY event_id))
        SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, id FROM e WHERE event_id % 2500 <> 7 AND (event_id % 1000 = 3 OR before % 2500 = 7)""",
    "merkle_heads": _HEADS + _TREE + "SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0",
    "merkle_update": _HEADS.replace("FROM events", "FROM events WHERE event_id % 8192 < 6000 OR user_id % 3 = 0") + _TREE + """, touched AS (
            SELECT DISTINCT sha256(CAST(user_id AS VARCHAR) || chr(10) || (event_id // 4096)) AS place FROM events WHERE event_id % 8192 >= 6000 AND user_id % 3 = 0)
        SELECT l3.* FROM l3 SEMI JOIN touched USING (place) UNION ALL SELECT * FROM l2 WHERE place IN (SELECT place[1:4] FROM touched)
        UNION ALL SELECT * FROM l1 WHERE place IN (SELECT place[1:2] FROM touched) UNION ALL SELECT * FROM l0 WHERE EXISTS (SELECT 1 FROM touched)""",
    "transcript_lines": """
        WITH rows_ AS (SELECT conv_id % 40 AS project, conv_id, turn, (conv_id + turn) % 4 AS kind FROM conversations),
        counted AS (SELECT *, sum(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END) OVER (PARTITION BY project ORDER BY conv_id, turn) AS last FROM rows_)
        SELECT project, CAST(last - k AS BIGINT) AS seq, valid FROM counted
        JOIN (VALUES (0, 0, true), (1, 2, true), (1, 0, false), (3, 1, true), (3, 0, false)) v(kind, k, valid) USING (kind)""",
    "utf8_truncate": """
        WITH h AS (SELECT doc_id, strlen(text) AS bytes, text, hex(encode(text)) AS x FROM documents),
        cut AS (SELECT *, x[1:1600] AS head, x[len(x) - 2399:] AS tail FROM h),
        ends AS (
            SELECT *, CASE WHEN head[-2:] >= 'C2' THEN 1 WHEN head[-4:-3] >= 'E0' AND head[-2:] BETWEEN '80' AND 'BF' THEN 2
                           WHEN head[-6:-5] >= 'F0' AND head[-4:-3] BETWEEN '80' AND 'BF' AND head[-2:] BETWEEN '80' AND 'BF' THEN 3 ELSE 0 END AS half,
                   CASE WHEN NOT tail[1:2] BETWEEN '80' AND 'BF' THEN 0 WHEN NOT tail[3:4] BETWEEN '80' AND 'BF' THEN 1 WHEN NOT tail[5:6] BETWEEN '80' AND 'BF' THEN 2 ELSE 3 END AS rest
            FROM cut
        ),
        shown AS (
            SELECT doc_id, bytes, CASE WHEN bytes <= 2000 THEN text ELSE decode(unhex(head[1:1600 - 2 * half])) || CASE WHEN half > 0 THEN '�' ELSE '' END
                || chr(10) || '…[' || (bytes - 2000) || ' bytes elided]…' || chr(10) || repeat('�', rest) || decode(unhex(tail[2 * rest + 1:])) END AS t FROM ends
        )
        SELECT doc_id, CAST(bytes AS INTEGER) AS bytes, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS sha FROM shown""",
    "anti_join_seen": "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0",
    "highwater_append": """
        WITH h AS (SELECT user_id, max(event_id) AS high FROM events WHERE event_id % 1000 < 700 GROUP BY user_id)
        SELECT e.user_id, e.event_id FROM events e LEFT JOIN h USING (user_id) WHERE e.event_id > coalesce(h.high, -1)""",
    "highwater_files": """
        WITH h AS (SELECT user_id, max(event_id) AS high FROM events WHERE event_id % 1000 < 700 GROUP BY user_id),
        parts AS (SELECT user_id, event_type, max(max(event_id)) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events GROUP BY user_id, event_type)
        SELECT e.user_id, e.event_id FROM events e JOIN parts USING (user_id, event_type) LEFT JOIN h USING (user_id)
        WHERE e.event_id > greatest(coalesce(h.high, -1), coalesce(before, -1))""",
    "upsert_coalesce": """
        SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'old' ELSE 'new' END AS seen, CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 0 END AS balance
        FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""",
}
SQL["transcript_sessions"] = _BASE + """, spent AS (
        SELECT session_id, user_id, min(ts) AS started_at, max(ts) AS ended_at, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(event_id % 10) AS BIGINT) AS output_tokens FROM steps GROUP BY ALL)
    SELECT session_id, ['/work/client/app', '/work/server/app', '/srv/data'][user_id % 3 + 1] AS cwd, 'topic-' || (user_id % 5) AS git_branch, started_at, ended_at, input_tokens, output_tokens, CAST(0 AS BIGINT) AS unparsed_lines FROM spent"""


def classified(commands: dict[str, str]) -> str:
    """What the commands are and what is left of them without their prefixes, by value."""
    bare = {"FOO=1 sudo -E pytest": "pytest", "( time tox": "tox", "env A='b c' vite build": "vite build"}
    names, kinds = "[" + ", ".join(_q(bare.get(c, c)) for c in commands) + "]", "[" + ", ".join(_q(a) for a in commands.values()) + "]"
    at = f"p_partkey % {len(commands)} + 1"
    return f"SELECT p_partkey, ({kinds})[{at}] AS activity, ({names})[{at}] || ' ' || p_size AS stripped FROM part"


def planted(kinds: dict[str, tuple[str, str, str]]) -> str:
    """What is left of texts with a secret of each kind, by value."""
    rows = ", ".join(f"({k}, {_q(kind)}, {_q(before)}, {_q(after)})" for k, (kind, (_, before, after)) in enumerate(kinds.items()))
    return f"""
        SELECT doc_id, md5(regexp_replace(coalesce(text, '')[1:300], '[^a-z ]', '', 'g') || ' note ' || before || '«redacted:' || kind || '»' || after || ' end') AS text, kind AS kinds
        FROM documents JOIN (VALUES {rows}) v(k, kind, before, after) ON doc_id % {len(kinds)} = k"""
