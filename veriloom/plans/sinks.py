"""Text, JSON, CI and HTML outputs, as columns of lines or fragments.

Each function adds text to rows that Spark made; a caller writes them with
``df.write.text`` or streams them to a terminal with ``toLocalIterator``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.plans.reconcile import VERDICTS, rank

# Marks of verdicts, the width of the tag column, lengths that are shown.
MARKS = {"CONTRADICTED": "✕", "UNSUPPORTED": "!", "UNKNOWN": "–", "VERIFIED": "✓"}
TAG, COMMAND, BRANCH = 14, 96, 60
STYLE = "body{font:16px system-ui;margin:2rem auto;max-width:60rem}details{border:1px solid #ccc;margin:.5rem 0;padding:.5rem}pre{white-space:pre-wrap}.CONTRADICTED{color:#b00020}.UNSUPPORTED{color:#a05a00}.UNKNOWN{color:#666}.VERIFIED{color:#0a7d33}"
SCRIPT = "const q=document.querySelector('#q'),v=[...document.querySelectorAll('input[name=v]')];function f(){const t=q.value.toLowerCase(),on=v.filter(x=>x.checked).map(x=>x.value);for(const d of document.querySelectorAll('details')){const own=d.dataset.verdicts.split(' ');d.hidden=!(d.dataset.search.includes(t)&&(on.length===0||on.some(x=>own.includes(x))))}}q.oninput=f;v.forEach(x=>x.onchange=f)"


def number(n: Column) -> Column:
    return F.format_number(n, 0)


def plural(n: Column, noun: str) -> Column:
    return F.concat(number(n), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def mark(verdict: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair]), verdict)


def cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def shown_command(command: Column) -> Column:
    return F.when(F.length(command) > COMMAND, F.concat(F.substring(command, 1, COMMAND - 3), F.lit("…"))).otherwise(command)


def queue_lines(rows: DataFrame, width: int = BRANCH) -> DataFrame:
    """Two lines of text per branch, worst branch first."""
    tag = F.rpad(F.concat(mark(F.col("verdict")), F.lit(" "), "verdict"), TAG, " ")
    label = cut(F.col("label"), width)
    facts = F.concat_ws(" · ", plural(F.size("sessions"), "session"), plural(F.col("execs"), "command"), plural(F.col("edits"), "edit"), F.concat(number(F.col("tokens")), F.lit(" tokens")))
    pad = F.greatest(F.lit(width), F.length(label))
    return rows.select(F.concat(tag, F.lit(" "), F.rpad(label, pad, " "), F.lit("  "), "summary").alias("line"), F.concat(F.lit(" " * (TAG + 1)), F.repeat(F.lit(" "), pad), F.lit("  "), facts).alias("facts"))


def queue_json(rows: DataFrame) -> DataFrame:
    """One JSON object per branch."""
    return rows.select(F.to_json(F.struct("label", "branch", "cwd", "verdict", "summary", F.col("needs_attention").alias("needsAttention"), "sessions", F.col("execs").alias("commands"), "edits", "tokens")).alias("json"))


def _run(e: Column) -> Column:
    return F.struct(e["command"].alias("command"), e["activity"].alias("activity"), e["outcome"].alias("outcome"), e["basis"].alias("basis"), e["exit_code"].alias("exitCode"), e["seq"].alias("seq"), e["ts"].alias("ts"))


def evidence_json(reports: DataFrame, runs: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON object per session, with its runs and findings in order."""
    said = F.struct("claim_ord", F.struct("verdict", "reason", "activity", "assertion", "sentence", F.transform("evidence", _run).alias("evidence")).alias("f"))
    ran = F.struct("seq", "ord", "run_ord", F.struct("command", "activity", "outcome", "basis", F.col("exit_code").alias("exitCode"), F.col("seq"), "ts").alias("r"))
    f = findings.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["f"]).alias("findings"))
    r = runs.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(ran)), lambda x: x["r"]).alias("run_list"))
    met = reports.join(f, "session_id", "left").join(r, "session_id", "left")
    usage = F.struct(F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"), F.col("cache_read_tokens").alias("cacheReadTokens"), F.col("cache_creation_tokens").alias("cacheCreationTokens"))
    out = F.struct(
        "id", F.col("git_branch").alias("branch"), "cwd", "models", F.col("started_at").alias("startedAt"), F.col("ended_at").alias("endedAt"), F.col("agent_version").alias("agentVersion"),
        F.col("opaque_executors").alias("opaqueExecutors"), usage.alias("usage"), F.struct("verdict", F.col("summary").alias("text")).alias("badge"), "risk",
        F.col("observed_activities").alias("observedActivities"), F.coalesce("run_list", F.array()).alias("runs"), F.coalesce("findings", F.array()).alias("findings"),
    )
    return met.orderBy(F.coalesce("started_at", F.lit("")), "session_id").select(F.to_json(out).alias("json"))


def evidence_lines(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """The detail view of each session, as one text."""
    tag = lambda v: F.concat(mark(v), F.lit(" "), v)
    seen = F.transform(F.slice("evidence", 1, 2), lambda e: F.concat(F.lit("      run "), shown_command(e["command"]), F.lit(": "), e["outcome"], F.lit(", by "), e["basis"]))
    block = F.concat_ws("\n", F.concat(F.lit("  "), tag(F.col("verdict")), F.lit("  "), "reason"), F.concat(F.lit("      claim “"), "sentence", F.lit("”")), F.array_join(seen, "\n"))
    told = findings.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_ord", F.regexp_replace(block, "\n$", "").alias("b")))), lambda x: x["b"]), "\n").alias("told"))
    met = reports.join(told, "session_id", "left")
    head = F.concat_ws(" | ", F.coalesce("git_branch", F.lit("no branch")), F.substring("id", 1, 8), "cwd", F.when(F.size("models") > 0, F.array_join("models", ", ")))
    count = lambda name, c: F.concat(F.lit(f"{name} "), number(c))
    facts = F.concat(F.lit("  "), F.concat_ws(", ", count("commands", F.col("execs")), count("runs", F.col("runs")), count("edits", F.col("edits")), count("tokens", F.col("input_tokens") + F.col("output_tokens"))))
    note = F.when(F.col("unparsed_lines") > 0, F.concat(F.lit("\n  lines that are no JSON: "), F.col("unparsed_lines").cast("string"))).otherwise("")
    return met.orderBy(F.coalesce("started_at", F.lit("")), "session_id").select(F.concat(head, F.lit("\n  "), tag(F.col("verdict")), F.lit("  "), F.col("summary"), F.lit("\n"), facts, F.lit("\n"), F.coalesce("told", F.lit("  nothing claimed")), note).alias("line"))


def broken(state: dict) -> str:
    """Where a store's verification failed, in words."""
    if state.get("broken_at") is None:
        return "the root over all sessions differs"
    return f"line {state['broken_at']}" + (f" of session {state['session']}" if state.get("session") else "")


def annotations(violations: DataFrame, name: str = "veriloom") -> DataFrame:
    """Workflow commands; untrusted labels and summaries are escaped."""
    level = F.when(F.col("verdict") == "UNKNOWN", "warning").otherwise("error")
    title = X.workflow_property(F.concat(F.lit(f"{name}: "), "verdict", F.lit(" on "), "label"))
    body = X.workflow_data(F.concat(F.col("summary"), F.lit(" ("), F.col("label"), F.lit(")")))
    return violations.select(F.concat(F.lit("::"), level, F.lit(" title="), title, F.lit("::"), body).alias("line"))


def summary_markdown(violations: list, counts: dict, branches: int, sessions: int, policy: str, chain: dict | None = None, report: str | None = None) -> str:
    """The job summary of a gate; ``violations`` are the rows that fail it."""
    passed, n = not violations and (chain is None or chain["ok"]), len(violations)
    out = ["## ✓ gate passed" if passed else f"## ✕ {n} branch{'es need' if n != 1 else ' needs'} reading", ""]
    if chain is not None:
        out += [f"The hashes of all {chain['events']:,} stored events agree." if chain["ok"] else f"**The store was changed: {broken(chain)}**, so it proves nothing.", ""]
    out += ["| Verdict | Claims |", "|---|---:|", *[f"| {MARKS[v]} {w} | {counts[v]} |" for v, w in zip(VERDICTS, ("Contradicted", "Unsupported", "Not determinable", "Verified"), strict=True)], ""]
    out.append(f"Branches: {branches}; sessions: {sessions}; policy: `{policy}`.")
    if violations:
        out += ["", "### Branches that fail the policy", "", *[f"- **{v['label']}** — {v['verdict']}: {v['summary']}" for v in sorted(violations, key=lambda v: VERDICTS.index(v["verdict"]))]]
    if report:
        out += ["", f"HTML report: `{report}`"]
    return "\n".join(out) + "\n"


def step_outputs(violations: list, counts: dict, branches: int, chain: dict | None = None) -> str:
    """Step outputs in heredoc form, so no value can open another."""
    ok = chain is None or chain["ok"]
    pairs = {"passed": not violations and ok, "worst-verdict": violations[0]["verdict"] if violations else "VERIFIED", "violations": len(violations), "branches": branches, **{v.lower(): counts[v] for v in VERDICTS}, "chain-ok": ok}
    return "".join(f"{k}<<veriloom_{k}_eof\n{str(v).lower() if isinstance(v, bool) else v}\nveriloom_{k}_eof\n" for k, v in pairs.items())


def plain_gate(violations: list, counts: dict, branches: int, policy: str, chain: dict | None = None) -> str:
    told = ", ".join(f"{v.lower()} {counts[v]}" for v in VERDICTS)
    out = [f"{branches} branches; claims: {told}"]
    if chain is not None:
        out.append(f"store: {chain['events']} events, hashes agree" if chain["ok"] else f"store changed: {broken(chain)}")
    out += [f"  {v['label']}: {v['verdict']}, {v['summary']}" for v in violations]
    out.append(f"policy {policy}: " + (f"fails on {len(violations)}" if violations else "holds"))
    return "\n".join(out) + "\n"


def _e(c: Column | str) -> Column:
    return X.html_escape(F.col(c) if isinstance(c, str) else c)


def _card() -> Column:
    """The HTML of one digested finding."""
    shown = F.transform(F.slice("evidence", 1, 3), lambda r: F.concat(F.lit("<pre><code>"), _e(r["command"]), F.lit("</code></pre><p>outcome <b>"), _e(r["outcome"]), F.lit("</b> basis <b>"), _e(r["basis"]), F.lit("</b> exit <b>"), F.coalesce(r["exit_code"].cast("string"), F.lit("n/a")), F.lit("</b></p>")))
    scope = F.when(F.size("activities") > 1, F.concat(F.lit("claims "), F.array_join("activities", ", "))).otherwise(F.col("activities")[0])
    return F.concat(F.lit('<article class="'), "verdict", F.lit('"><b>'), mark(F.col("verdict")), F.lit("&nbsp;"), "verdict", F.lit("</b> <span>"), _e(scope), F.lit("</span><p>"), _e("reason"), F.lit("</p><blockquote>"), _e("sentence"), F.lit("</blockquote>"), F.array_join(shown, ""), F.lit("</article>"))


def _session() -> Column:
    """The HTML that stands before a session's findings."""
    return F.concat(F.lit("<h3>"), _e(F.substring("id", 1, 8)), F.lit("</h3><p>commands "), number(F.col("execs")), F.lit(", runs "), number(F.col("runs")), F.lit(", edits "), number(F.col("edits")), F.lit("</p>"))


def _branch(present: Column) -> Column:
    """The HTML that opens a branch; ``present`` has the verdicts of its findings."""
    search = F.lower(F.concat_ws(" ", "label", "summary", "verdict"))
    verdicts = F.array_join(F.array_distinct(F.concat(F.array("verdict"), F.coalesce(present, F.array().cast("array<string>")))), " ")
    return F.concat(F.lit('<details data-verdicts="'), verdicts, F.lit('" data-search="'), _e(search), F.lit('"><summary class="'), "verdict", F.lit('">'), mark(F.col("verdict")), F.lit(" "), _e("label"), F.lit(": "), _e("summary"), F.lit(" ["), number(F.col("execs")), F.lit(" commands, "), number(F.col("edits")), F.lit(" edits]</summary>"))


def html_rows(rows: DataFrame, reports: DataFrame, findings: DataFrame, digests: DataFrame) -> DataFrame:
    """One escaped HTML fragment per branch, worst first, with its findings digested."""
    cards = digests.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank(F.col("verdict")).alias("k"), "claim_ord", _card().alias("h")))), lambda x: x["h"]), "").alias("cards"), F.collect_set("verdict").alias("present"))
    member = rows.select("label", F.posexplode("sessions").alias("no", "id")).join(reports.select("id", "session_id", "execs", "runs", "edits"), "id").join(cards, "session_id", "left")
    block = F.concat(_session(), F.coalesce("cards", F.lit("")))
    inner = member.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", block.alias("h")))), lambda x: x["h"]), "").alias("inner"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("present", F.array().cast("array<string>"))))).alias("present"))
    body = F.when(F.coalesce("inner", F.lit("")) == "", "<p>No claims on this branch.</p>").otherwise(F.col("inner"))
    out = F.concat(_branch(F.col("present")), body, F.lit("</details>"))
    return rows.join(inner, "label", "left").orderBy(rank(F.col("verdict")), F.col("execs").desc(), "row_ord").select(out.alias("html"))


def report_pages(rows: DataFrame, reports: DataFrame, digests: DataFrame, path: str, title: str = "Execution evidence", each: int = 500, slices: int = 1) -> int:
    """Writes the report as pages of ``each`` branches, by tasks, and an index of the pages; the number of pages.

    A page is made of pieces (its head, branches, sessions, findings) that a task writes in
    order, so no branch is held as a whole.  With each page goes an index of its branches,
    a JSON line for each.  The driver sees one row for each page.
    """
    from veriloom.operators.ordered import running

    spark = rows.sparkSession
    worst, execs = rank(F.col("verdict")), F.col("execs")
    placed = running(rows, [], [worst, execs.desc(), "row_ord"], sums={"place": F.lit(1)}, slices=slices, by=worst * float(1 << 40) - execs)
    placed = placed.withColumn("page", F.floor((F.col("place") - 1) / each))
    member = placed.select("page", "place", F.posexplode("sessions").alias("no", "id")).join(reports.select("id", "session_id", "execs", "runs", "edits"), "id")
    cards = member.select("page", "place", "no", "session_id").join(digests, "session_id")
    present = cards.groupBy("place").agg(F.collect_set("verdict").alias("present"))  # four verdicts
    none = F.struct(F.lit(-1).alias("rank"), F.lit(None).cast(digests.schema["claim_ord"].dataType).alias("claim_ord"))
    before, after = html_frame(title, None, None)
    pages = placed.select("page").distinct()
    last = 1 << 62
    pieces = placed.join(present, "place", "left").select("page", F.col("place").cast("long").alias("place"), F.lit(-1).cast("long").alias("no"), none.alias("card"), _branch(F.col("present")).alias("html"))
    pieces = pieces.unionByName(member.select("page", F.col("place").cast("long").alias("place"), F.col("no").cast("long").alias("no"), none.alias("card"), _session().alias("html")))
    pieces = pieces.unionByName(cards.select("page", F.col("place").cast("long").alias("place"), F.col("no").cast("long").alias("no"), F.struct(rank(F.col("verdict")).alias("rank"), "claim_ord").alias("card"), _card().alias("html")))
    pieces = pieces.unionByName(placed.select("page", F.col("place").cast("long").alias("place"), F.lit(last).alias("no"), none.alias("card"), F.lit("</details>").alias("html")))
    for place, html in ((-1, before), (last, after)):
        pieces = pieces.unionByName(pages.select("page", F.lit(place).cast("long").alias("place"), F.lit(0).cast("long").alias("no"), none.alias("card"), F.lit(html).alias("html")))
    ordered = pieces.repartition("page").sortWithinPartitions("page", "place", "no", "card").select("page", "html")
    ordered.write.mode("overwrite").partitionBy("page").text(f"{path}/pages")
    index = placed.select("page", F.to_json(F.struct("label", "verdict", "summary", "place")).alias("json")).repartition("page").sortWithinPartitions("page", "json")
    index.write.mode("overwrite").partitionBy("page").text(f"{path}/index")
    tallies = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    told = placed.groupBy("page").agg(F.min_by("label", "place").alias("first"), F.max_by("label", "place").alias("last"), F.count(F.lit(1)).alias("n"), *tallies).orderBy("page").collect()  # a row for each page
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, end in (("pages", "html"), ("index", "jsonl")):
        for r in told:
            made = [x.getPath() for x in fs.globStatus(jvm(f"{path}/{kind}/page={r['page']}/part-*"))]
            fs.rename(made[0], jvm(f"{path}/{kind}-{r['page']:05d}.{end}"))
        fs.delete(jvm(f"{path}/{kind}"), True)
    from html import escape

    line = lambda r: f'<li><a href="pages-{r["page"]:05d}.html">{escape(r["first"])} to {escape(r["last"])}</a> {r["n"]:,} branches: ' + ", ".join(f"{v.lower()} {r[v]:,}" for v in VERDICTS) + "</li>"
    out = fs.create(jvm(f"{path}/index.html"), True)
    out.write(bytearray(f"{before}<ol>{''.join(map(line, told))}</ol>{after}".encode()))
    out.close()
    return len(told)


def html_headline(lead: DataFrame) -> DataFrame:
    """An escaped HTML fragment of the report's headline finding."""
    e = lambda c: X.html_escape(F.col(c))
    out = F.concat(F.lit('<section class="'), "verdict", F.lit('"><h2>'), mark(F.col("verdict")), F.lit(" "), e("label"), F.lit("</h2><p>"), e("reason"), F.lit("</p><blockquote>"), e("sentence"), F.lit("</blockquote></section>"))
    return lead.select(out.alias("html"))


def html_frame(title: str, counts: dict | None, rows: int | None, head: str | None = None, lead: str = "") -> tuple[str, str]:
    """What stands before and after the branches of the self-contained report; ``lead`` is HTML."""
    from html import escape

    chips = "".join(f'<label><input type="checkbox" name="v" value="{v}"> {v.lower()}{f" {counts[v]:,}" if counts else ""}</label> ' for v in VERDICTS)
    said = f"<p>{rows:,} branches, {sum(counts.values()):,} claims</p>" if counts else ""
    policy = "default-src 'none'; style-src 'unsafe-inline'; script-src 'unsafe-inline'"
    chain = f"<p>chain head <code>{escape(head)}</code></p>" if head else ""
    before = f'<!doctype html><html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{said}{chain}{lead}<p><input id="q" placeholder="filter"> {chips}</p>'
    return before, f"<script>{SCRIPT}</script></body></html>\n"
