"""Oracle SQL (DuckDB dialect) for every registered query that SQL can express.

Each binding view is written here as a CTE with the same definition as in
``bindings.py``. Doubles are rounded exactly where the Spark query rounds.
"""

from __future__ import annotations

from ..functions.passk import K_VALUES, pass_at_k_sql

METRICS = ("plan", "apply", "spec")

# ------------------------------------------------------------------ views
V_SAMPLES = """samples AS (
  SELECT CAST(user_id AS VARCHAR) || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS task_id,
         event_id,
         event_type <> 'error' AS plan_ok,
         event_type IN ('purchase', 'click', 'signup') AS apply_ok,
         CASE WHEN event_type = 'purchase' THEN TRUE
              WHEN event_type = 'view' THEN NULL ELSE FALSE END AS spec_ok,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 + 1 AS iterations,
         value AS gen_s,
         event_id % 3 AS folder
  FROM events)"""


def _r(expr: str, places: int = 9) -> str:
    return f"ROUND({expr}, {places})"


def _counts_cte(keys: str) -> str:
    cs = ", ".join(
        f"count(*) FILTER (WHERE coalesce({m}_ok, FALSE)) AS c_{m}" for m in METRICS
    )
    return f"counts AS (SELECT {keys}, count(*) AS n, {cs} FROM samples GROUP BY {keys})"


def _passk_cols(rounding: bool = True) -> str:
    cols = []
    for m in METRICS:
        for k in K_VALUES:
            e = pass_at_k_sql("n", f"c_{m}", k)
            cols.append(f"{_r(e) if rounding else e} AS pass{k}_{m}")
    return ", ".join(cols)


def _macro_cols(rounding: bool = True) -> str:
    cols = []
    for m in METRICS:
        for k in K_VALUES:
            e = f"avg(CASE WHEN n >= {k} THEN pass{k}_{m} END)"
            cols.append(f"{_r(e) if rounding else e} AS pass{k}_{m}")
    return ", ".join(cols)


ORACLE: dict[str, str] = {}

ORACLE["pass_at_k_by_task"] = f"""
WITH {V_SAMPLES}, {_counts_cte('task_id')}
SELECT task_id, n, c_plan, c_apply, c_spec, {_passk_cols()} FROM counts"""

ORACLE["pass_at_k_summary"] = f"""
WITH {V_SAMPLES}, {_counts_cte('task_id')},
pt AS (SELECT n, {_passk_cols(False)} FROM counts),
macro AS (SELECT {_macro_cols()}, count(*) AS unique_tasks FROM pt),
tot AS (SELECT count(*) AS total_samples,
               {_r('avg(coalesce(iterations, 1))')} AS avg_iterations,
               {_r('avg(coalesce(gen_s, 0.0))')} AS avg_gen_s FROM samples)
SELECT * FROM tot CROSS JOIN macro"""

ORACLE["per_task_breakdown"] = f"""
WITH {V_SAMPLES}
SELECT task_id, count(*) AS n,
       {_r('avg(CAST(coalesce(plan_ok, FALSE) AS DOUBLE))')} AS plan_pct,
       {_r('avg(CAST(coalesce(spec_ok = TRUE, FALSE) AS DOUBLE))')} AS spec_pct,
       {_r('avg(coalesce(iterations, 1))')} AS avg_iterations
FROM samples GROUP BY task_id"""

ORACLE["per_experiment_metrics"] = f"""
WITH {V_SAMPLES}, {_counts_cte('folder, task_id')},
pt AS (SELECT folder, n, {_passk_cols(False)} FROM counts),
macro AS (SELECT folder, {_macro_cols()}, count(*) AS unique_tasks FROM pt GROUP BY folder),
tot AS (SELECT folder, count(*) AS total_samples,
               {_r('avg(coalesce(iterations, 1))')} AS avg_iterations,
               {_r('avg(coalesce(gen_s, 0.0))')} AS avg_gen_s FROM samples GROUP BY folder)
SELECT * FROM tot JOIN macro USING (folder)"""

ORACLE["running_progress_outliers"] = f"""
WITH {V_SAMPLES},
k AS (SELECT folder, CASE WHEN event_id % 1000 = 999 THEN event_id + 1152921504606846976 ELSE event_id // 50 * 1000000000 + event_id % 50 END AS position,
             CAST(round(gen_s * 100) AS BIGINT) AS cs FROM samples),
r AS (SELECT folder, position, row_number() OVER w AS seq, sum(cs) OVER w AS run_cs, count(*) OVER (PARTITION BY folder) AS run_rows
      FROM k WINDOW w AS (PARTITION BY folder ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT folder, position, seq, run_cs / 100.0 AS elapsed_s, run_cs / 100.0 / seq AS avg_per_sample_s, run_rows - seq AS remaining,
       run_cs / 100.0 / seq * (run_rows - seq) AS eta_s, 100.0 * seq / run_rows AS pct_done, run_rows
FROM r"""

ORACLE["running_progress"] = f"""
WITH {V_SAMPLES},
r AS (SELECT folder, event_id,
             row_number() OVER (PARTITION BY folder ORDER BY event_id) AS seq,
             sum(CAST(round(gen_s * 100) AS BIGINT)) OVER (PARTITION BY folder ORDER BY event_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_cs,
             count(*) OVER (PARTITION BY folder) AS run_rows
      FROM samples)
SELECT folder, event_id, seq, run_cs / 100.0 AS elapsed_s,
       run_cs / 100.0 / seq AS avg_per_sample_s,
       run_rows - seq AS remaining,
       run_cs / 100.0 / seq * (run_rows - seq) AS eta_s,
       100.0 * seq / run_rows AS pct_done,
       run_rows
FROM r"""

ORACLE["duplicate_plan_keys"] = """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""

# ------------------------------------------------------------------ judge
V_JUDGED = """judged AS (
  SELECT doc_id, 'T' || CAST(doc_id % 7 AS VARCHAR) AS task_id,
         CASE doc_id % 5
           WHEN 0 THEN 'Review done.' || chr(10) || 'Rating: ' || v
           WHEN 1 THEN 'looks fine overall. rating: ' || lower(v)
           WHEN 2 THEN 'The configuration is ' || lower(v) || '  ' || chr(10)
           WHEN 3 THEN 'No clear verdict here.'
           ELSE '' END AS judge_text,
         CASE WHEN doc_id % 11 = 0 THEN NULL ELSE toxic = 0 END AS spec_passed
  FROM (SELECT *, CASE WHEN quality = 1 THEN 'Correct' ELSE 'Incorrect' END AS v FROM labels))"""

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
NON_WS = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+\\z', '', 'g')"


def _verdict(t: str) -> str:
    hit = f"regexp_extract(coalesce({t}, ''), '(?i)Rating:\\s*(Correct|Incorrect)', 1)"
    low = _strip(f"lower({t})")
    return f"""CASE WHEN {t} IS NULL OR {t} = '' THEN 'Unknown'
      WHEN {hit} <> '' THEN upper(left({hit}, 1)) || lower(substr({hit}, 2))
      WHEN ends_with({low}, 'incorrect') OR contains({low}, 'rating: incorrect') THEN 'Incorrect'
      WHEN ends_with({low}, 'correct') OR contains({low}, 'rating: correct') THEN 'Correct'
      ELSE 'Unknown' END"""


V_VERDICTS = f"""jv AS (SELECT *, {_verdict('judge_text')} AS verdict FROM judged),
valid AS (SELECT * FROM jv WHERE verdict IN ('Correct', 'Incorrect') AND spec_passed IS NOT NULL)"""


def _confusion(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""
WITH {V_JUDGED}, {V_VERDICTS},
c AS (SELECT {k}count(*) FILTER (WHERE verdict = 'Correct' AND spec_passed) AS tp,
             count(*) FILTER (WHERE verdict = 'Incorrect' AND spec_passed) AS fp,
             count(*) FILTER (WHERE verdict = 'Correct' AND NOT spec_passed) AS fn,
             count(*) FILTER (WHERE verdict = 'Incorrect' AND NOT spec_passed) AS tn,
             count(*) AS n_valid
      FROM valid {g}),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
             CASE WHEN n_valid > 0 THEN (tp + tn) / n_valid ELSE 0.0 END AS accuracy FROM c)
SELECT {k}tp, fp, fn, tn, n_valid, {_r('precision')} AS precision, {_r('recall')} AS recall,
       {_r('accuracy')} AS accuracy,
       {_r('CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f1
FROM m"""


ORACLE["judge_verdicts"] = f"""
WITH {V_JUDGED}, {V_VERDICTS}
SELECT doc_id, task_id, verdict, spec_passed,
       CASE WHEN verdict IN ('Correct', 'Incorrect') AND spec_passed IS NOT NULL
            THEN (verdict = 'Correct') = spec_passed END AS agree
FROM jv"""

ORACLE["judge_confusion"] = _confusion()
ORACLE["judge_confusion_by_task"] = _confusion("task_id")

ORACLE["judge_disagreements"] = f"""
WITH {V_JUDGED}, {V_VERDICTS}
SELECT CASE WHEN verdict = 'Incorrect' AND spec_passed THEN 'too_lenient' ELSE 'too_strict' END AS kind,
       task_id, doc_id
FROM valid WHERE (verdict = 'Incorrect' AND spec_passed) OR (verdict = 'Correct' AND NOT spec_passed)"""

ORACLE["judge_skip_existing"] = f"""
WITH {V_JUDGED}, {V_VERDICTS}
SELECT doc_id, verdict, 'judged' AS source FROM jv WHERE doc_id % 4 <> 0
UNION ALL
SELECT doc_id, 'Correct' AS verdict, 'existing' AS source FROM judged WHERE doc_id % 4 = 0"""

# ------------------------------------------------------------------ ground truth
V_GT = """res AS (SELECT * FROM samples WHERE folder <> 0),
gt AS (SELECT task_id, plan_ok AS gt_plan, apply_ok AS gt_apply, spec_ok AS gt_spec, iterations AS gt_iterations
       FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY event_id) AS rn
             FROM samples WHERE folder = 0) WHERE rn = 1),
cmp AS (SELECT res.*, gt_plan, gt_apply, gt_spec, gt_iterations,
               plan_ok = gt_plan AS plan_match, apply_ok = gt_apply AS apply_match,
               spec_ok IS NOT DISTINCT FROM gt_spec AS spec_match
        FROM res JOIN gt USING (task_id))"""

ORACLE["ground_truth_compare"] = f"""
WITH {V_SAMPLES}, {V_GT}
SELECT task_id, event_id, plan_match, apply_match, spec_match, iterations, gt_iterations FROM cmp"""

ORACLE["ground_truth_summary"] = f"""
WITH {V_SAMPLES}, {V_GT},
s AS (SELECT count(*) AS total, count(*) FILTER (WHERE plan_match) AS plan_matches,
             count(*) FILTER (WHERE apply_match) AS apply_matches,
             count(*) FILTER (WHERE spec_match) AS spec_matches FROM cmp)
SELECT *, {_r('100.0 * plan_matches / total')} AS plan_pct, {_r('100.0 * apply_matches / total')} AS apply_pct,
       {_r('100.0 * spec_matches / total')} AS spec_pct,
       CASE WHEN 100.0 * spec_matches / total > 80 THEN 'high'
            WHEN 100.0 * spec_matches / total >= 50 THEN 'moderate' ELSE 'low' END AS spec_band
FROM s"""

ORACLE["ground_truth_unmatched"] = f"""
WITH {V_SAMPLES}
SELECT DISTINCT task_id FROM samples r WHERE folder <> 0
  AND NOT EXISTS (SELECT 1 FROM samples g WHERE g.folder = 0 AND g.task_id = r.task_id)"""

# ------------------------------------------------------------------ code extraction
V_FENCED = """fenced AS (
  SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'READ' ELSE 'CREATE' END AS category,
    CASE (conv_id + turn) % 6
      WHEN 0 THEN 'Here is the code:' || chr(10) || '```hcl' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
      WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```'
      WHEN 2 THEN '```TF' || chr(13) || chr(10) || text || chr(13) || chr(10) || '```'
      WHEN 3 THEN '```hcl' || chr(10) || 'example' || chr(10) || '```' || chr(10) || 'Then:' || chr(10)
                  || '```terraform' || chr(10) || text || chr(10) || '```'
      WHEN 4 THEN 'Partial answer:' || chr(10) || '```hcl' || chr(10) || text
      ELSE CASE WHEN turn % 2 = 0 THEN 'resource "vm" "x" {}' || chr(10) || text ELSE text END
    END AS response
  FROM conversations)"""


def _extract_code(r: str) -> str:
    blocks = f"list_filter(string_split(coalesce({r}, ''), '```'), lambda b, i: i % 2 = 0)"
    cleaned = (
        f"list_transform({blocks}, lambda b: regexp_replace({_strip('b')}, "
        "'^(?i:hcl|terraform|tf)(?:[\\r\\n]+|\\z)', ''))"
    )
    last = f"list_filter({cleaned}, lambda b: b <> '')[-1]"
    whole = _strip(f"coalesce({r}, '')")
    markers = " OR ".join(
        f"contains({whole}, '{m}')"
        for m in ('resource "', 'data "', 'provider "', 'terraform {', 'variable "', 'output "')
    )
    words = f"len(regexp_extract_all({whole}, '{NON_WS}+'))"
    fallback = (
        f"CASE WHEN ({markers}) AND NOT ({words} > 100 AND NOT starts_with({whole}, 'terraform')) "
        f"THEN {whole} ELSE '' END"
    )
    return f"coalesce({last}, {fallback})"


ORACLE["code_extraction"] = f"""
WITH {V_FENCED}, x AS (SELECT conv_id, turn, category, {_extract_code('response')} AS code FROM fenced)
SELECT conv_id, turn, code, CAST(length(code) AS INTEGER) AS code_chars,
       {_strip('code')} = '' OR (upper(category) NOT IN ('DELETE', 'READ')
         AND NOT (contains(code, 'resource "') OR contains(code, 'data "'))) AS no_usable_code
FROM x"""

# ------------------------------------------------------------------ text hygiene
REDACT = (
    r"""(?i)\b(username|password|api[_-]?key|token)\b\s*([:=])\s*("[^\n]*?"|'[^\n]*?'|[^\s,\n}]+)"""
)
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
V_ERR = """errtext AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN chr(27) || '[31m' || text || chr(27) || '[0m' ELSE text END AS text
  FROM documents)"""


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE["text_hygiene"] = f"""
WITH {V_ERR},
t AS (SELECT doc_id, text, regexp_replace(text, {_sql_str(ANSI)}, '', 'g') AS clean FROM errtext)
SELECT doc_id,
       CAST(len(regexp_extract_all(text, {_sql_str(REDACT)})) AS INTEGER) AS redaction_hits,
       md5(regexp_replace(text, {_sql_str(REDACT)}, '\\1\\2"[REDACTED]"', 'g')) AS redacted_md5,
       CAST(length(CASE WHEN length(clean) > 4000 THEN left(clean, 2000) || chr(10) || '... [TRUNCATED] ...' || chr(10) || right(clean, 2000) ELSE clean END) AS INTEGER) AS sanitized_chars,
       md5(CASE WHEN length(clean) > 4000 THEN left(clean, 2000) || chr(10) || '... [TRUNCATED] ...' || chr(10) || right(clean, 2000) ELSE clean END) AS sanitized_md5,
       md5(CASE WHEN length(text) > 4000 THEN left(text, 4000) || chr(10) || '... [TRUNCATED - extracted context]' ELSE text END) AS head_md5,
       length(clean) > 4000 AS truncated
FROM t"""

# ------------------------------------------------------------------ BLEU
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
V_PAIRS = """pairs AS (
  SELECT a.conv_id, a.turn, a.text AS reference, b.text AS candidate
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

V_BLEU = f"""tk AS (SELECT conv_id, turn, coalesce(reference, '') = '' AS unscored,
                  regexp_extract_all(coalesce(reference, ''), '{TOKEN}') AS rt,
                  regexp_extract_all(coalesce(candidate, ''), '{TOKEN}') AS ct FROM pairs),
el AS (SELECT * FROM tk WHERE NOT unscored AND len(rt) >= 4 AND len(ct) >= 4),
gi AS (SELECT conv_id, turn, 'c' AS side, n, unnest(generate_series(1, len(ct) - n + 1)) AS i, ct AS toks
       FROM el, (VALUES (1), (2), (3), (4)) v(n)
       UNION ALL
       SELECT conv_id, turn, 'r' AS side, n, unnest(generate_series(1, len(rt) - n + 1)) AS i, rt AS toks
       FROM el, (VALUES (1), (2), (3), (4)) v(n)),
gr AS (SELECT conv_id, turn, side, n, array_to_string(toks[i:i + n - 1], chr(1)) AS g FROM gi),
cl AS (SELECT conv_id, turn, n, least(count(*) FILTER (WHERE side = 'c'), count(*) FILTER (WHERE side = 'r')) AS clip
       FROM gr GROUP BY conv_id, turn, n, g),
nm AS (SELECT conv_id, turn,
              coalesce(sum(clip) FILTER (WHERE n = 1), 0) AS num1, coalesce(sum(clip) FILTER (WHERE n = 2), 0) AS num2,
              coalesce(sum(clip) FILTER (WHERE n = 3), 0) AS num3, coalesce(sum(clip) FILTER (WHERE n = 4), 0) AS num4
       FROM cl GROUP BY conv_id, turn),
z AS (SELECT nm.*, CAST(len(el.rt) AS INTEGER) AS ref_tokens, CAST(len(el.ct) AS INTEGER) AS cand_tokens,
             1 AS inc1,
             1 + (CASE WHEN num1 = 0 THEN 1 ELSE 0 END) AS inc2,
             1 + (CASE WHEN num1 = 0 THEN 1 ELSE 0 END) + (CASE WHEN num2 = 0 THEN 1 ELSE 0 END) AS inc3,
             1 + (CASE WHEN num1 = 0 THEN 1 ELSE 0 END) + (CASE WHEN num2 = 0 THEN 1 ELSE 0 END)
               + (CASE WHEN num3 = 0 THEN 1 ELSE 0 END) AS inc4
      FROM nm JOIN el USING (conv_id, turn)),
pz AS (SELECT conv_id, turn, ref_tokens, cand_tokens, num1,
              CASE WHEN num1 > 0 THEN num1 / greatest(cand_tokens, 1) ELSE 1.0 / (pow(2.0, inc1) * greatest(cand_tokens, 1)) END AS p1,
              CASE WHEN num2 > 0 THEN num2 / greatest(cand_tokens - 1, 1) ELSE 1.0 / (pow(2.0, inc2) * greatest(cand_tokens - 1, 1)) END AS p2,
              CASE WHEN num3 > 0 THEN num3 / greatest(cand_tokens - 2, 1) ELSE 1.0 / (pow(2.0, inc3) * greatest(cand_tokens - 2, 1)) END AS p3,
              CASE WHEN num4 > 0 THEN num4 / greatest(cand_tokens - 3, 1) ELSE 1.0 / (pow(2.0, inc4) * greatest(cand_tokens - 3, 1)) END AS p4
       FROM z),
bl AS (SELECT conv_id, turn, ref_tokens, cand_tokens,
              CASE WHEN num1 = 0 THEN 0.0 ELSE
                (CASE WHEN cand_tokens > ref_tokens THEN 1.0 ELSE exp(1.0 - ref_tokens / cand_tokens) END)
                * exp(ln(p1) * 0.25 + ln(p2) * 0.25 + ln(p3) * 0.25 + ln(p4) * 0.25) END AS bleu
       FROM pz
       UNION ALL
       SELECT conv_id, turn, CAST(len(rt) AS INTEGER) AS ref_tokens, CAST(len(ct) AS INTEGER) AS cand_tokens,
              CASE WHEN unscored THEN NULL ELSE 0.0 END AS bleu
       FROM tk WHERE unscored OR len(rt) < 4 OR len(ct) < 4)"""

ORACLE["bleu_pairs"] = f"""
WITH {V_PAIRS}, {V_BLEU}
SELECT conv_id, turn, ref_tokens, cand_tokens, {_r('bleu')} AS bleu FROM bl"""

ORACLE["bleu_summary"] = f"""
WITH {V_PAIRS}, {V_BLEU}
SELECT count(*) AS n_pairs, count(bleu) AS n_scored, {_r('avg(bleu)')} AS avg_bleu,
       count(*) FILTER (WHERE bleu >= 0.9) AS n_excellent,
       count(*) FILTER (WHERE bleu >= 0.7 AND bleu < 0.9) AS n_good,
       count(*) FILTER (WHERE bleu >= 0.5 AND bleu < 0.7) AS n_fair,
       count(*) FILTER (WHERE bleu < 0.5) AS n_poor
FROM bl"""

# ------------------------------------------------------------------ complexity
V_HCL = """frag AS (
  SELECT p_brand AS doc, p_partkey AS frag_pos,
         'resource "' || p_type || '" "p' || CAST(p_partkey AS VARCHAR) || '" {' || chr(10)
         || '  cpus = ' || CAST(p_size AS VARCHAR) || chr(10)
         || '  memory_max = ' || CAST(p_size AS VARCHAR) || ' * 1024 * 1024' || chr(10)
         || '  sr_id = data.sr.' || p_brand || '.id' || chr(10)
         || '  name_label = "' || p_name || '"' || chr(10) || '}' AS hcl
  FROM part),
hcl AS (SELECT doc, string_agg(hcl, chr(10) ORDER BY frag_pos) AS hcl FROM frag GROUP BY doc)"""

LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _count(t: str, p: str) -> str:
    return f"CAST((length({t}) - length(replace({t}, {_sql_str(p)}, ''))) // {len(p)} AS BIGINT)"


def _loc(t: str) -> str:
    return (f"CAST(len(list_filter(string_split_regex(coalesce({t}, ''), '{LINE_BREAK}'), "
            f"lambda x: regexp_matches(x, '{NON_WS}'))) AS INTEGER)")


def _setting_total(t: str, key: str, mode: str = "reference") -> str:
    value = r"\d(?:[\d\s]*[+\-*]\s*\d+)*" if mode == "reference" else r"\d+(?:\s*[+\-*]\s*\d+)*"
    pat = rf"(?m)^\s*{key}\s*=\s*({value})\s*$"
    ev = (
        "lambda v: CASE WHEN regexp_matches(trim(v), '^[0-9]+$') THEN CAST(trim(v) AS BIGINT) "
        "WHEN regexp_matches(v, '[0-9]\\s+[0-9]') OR regexp_matches(trim(v), '(^|[^0-9])0[0-9]') THEN NULL "
        "ELSE CAST(list_sum(list_transform(regexp_extract_all(regexp_replace(v, '\\s+', '', 'g'), '[+\\-]?[0-9*]+'), "
        "lambda u: (CASE WHEN starts_with(u, '-') THEN -1 ELSE 1 END) * "
        "CAST(list_product(list_transform(string_split(regexp_replace(u, '^[+\\-]', ''), '*'), "
        "lambda x: CAST(x AS BIGINT))) AS BIGINT))) AS BIGINT) END"
    )
    vals = f"list_filter(list_transform(regexp_extract_all(coalesce({t}, ''), {_sql_str(pat)}, 1), {ev}), lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({vals}) > 0 THEN CAST(list_sum({vals}) AS BIGINT) END"


def _level(loc: str, res: str, inter: str) -> str:
    bounds = ((10, 2, 2), (20, 4, 4), (40, 6, 6), (60, 8, 8), (80, 10, 10))
    whens = " ".join(
        f"WHEN {loc} < {a} AND {res} < {b} AND {inter} < {c} THEN '{i}'"
        for i, (a, b, c) in enumerate(bounds, start=1)
    )
    return f"CASE {whens} ELSE '6' END"


def _scored(src: str, key: str, mode: str = "reference") -> str:
    t = "hcl"
    types = f"list_sort(list_distinct(regexp_extract_all({t}, '(?:resource|data)\\s+\"([^\"]+)\"', 1)))"
    return f"""SELECT {key}, {_loc(t)} AS loc,
       {_count(t, 'resource "')} + {_count(t, 'data "')} AS resources,
       {_count(t, '.id')} + {_count(t, '.name')} - {_count(t, 'name_label')} AS interconnections,
       {types} AS resource_types,
       {_setting_total(t, 'cpus', mode)} AS total_cpus,
       {_setting_total(t, 'memory_max', mode)} AS total_memory_max,
       {_setting_total(t, 'size', mode)} AS total_size,
       contains({t}, 'provider "xenorchestra"') AS provider_config_included,
       contains({t}, 'resource "xenorchestra_vm"') AS vm_resource_defined
FROM {src}"""


ORACLE["hcl_complexity"] = f"""
WITH {V_HCL}, s AS ({_scored('hcl', 'doc')})
SELECT doc, CAST(loc AS BIGINT) AS loc, resources, interconnections,
       {_level('loc', 'resources', 'interconnections')} AS level,
       CAST(len(resource_types) AS INTEGER) AS n_types, array_to_string(resource_types, ',') AS types,
       total_cpus, total_memory_max, total_size, provider_config_included, vm_resource_defined
FROM s"""

ORACLE["hcl_complexity_integers"] = f"""
WITH {V_HCL}, s AS ({_scored('hcl', 'doc', 'integers')})
SELECT doc, total_cpus, total_memory_max FROM s"""

ORACLE["part_block_complexity"] = f"""
WITH {V_HCL}, s AS ({_scored('frag', 'frag_pos')})
SELECT frag_pos, loc, resources, interconnections,
       {_level('loc', 'resources', 'interconnections')} AS level,
       array_to_string(resource_types, ',') AS types, total_cpus, total_memory_max
FROM s"""

ORACLE["resource_type_distribution"] = f"""
WITH {V_HCL}, s AS ({_scored('hcl', 'doc')}),
per_type AS (SELECT resource_type, count(DISTINCT doc) AS n_tasks
             FROM (SELECT doc, unnest(resource_types) AS resource_type FROM s) GROUP BY resource_type)
SELECT resource_type, n_tasks, repeat('█', CAST(n_tasks AS INTEGER)) AS bar FROM per_type"""

ORACLE["complexity_summary"] = f"""
WITH {V_HCL}, s AS ({_scored('hcl', 'doc')}),
l AS (SELECT {_level('loc', 'resources', 'interconnections')} AS level FROM s)
SELECT count(*) FILTER (WHERE level IS NOT NULL) AS total_tasks_scored, count(*) AS total_tasks,
       count(*) FILTER (WHERE level = '1') AS n_level_1, count(*) FILTER (WHERE level = '2') AS n_level_2,
       count(*) FILTER (WHERE level = '3') AS n_level_3, count(*) FILTER (WHERE level = '4') AS n_level_4,
       count(*) FILTER (WHERE level = '5') AS n_level_5, count(*) FILTER (WHERE level = '6') AS n_level_6
FROM l"""

# ------------------------------------------------------------------ rules
V_PLAN_ROWS = """plan_rows AS (
  SELECT l_orderkey AS plan_id,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos,
         l_linenumber AS linenumber, 'xenorchestra_vm' AS type,
         CASE WHEN l_returnflag = 'A' THEN ['delete'] WHEN l_returnflag = 'N' THEN ['create']
              WHEN l_linestatus = 'F' THEN ['delete', 'create'] ELSE ['update'] END AS actions,
         'vm-' || CAST(l_suppkey AS VARCHAR) AS name_label,
         CAST(l_quantity AS BIGINT) AS cpus,
         CAST(l_quantity AS BIGINT) * 67108864 AS memory_max,
         [l_partkey * 16777216] AS disk_sizes
  FROM lineitem)"""

ACTION_SQL = """CASE WHEN list_contains(actions, 'delete') AND list_contains(actions, 'create') THEN 'replace'
     WHEN list_contains(actions, 'delete') THEN 'delete' WHEN list_contains(actions, 'create') THEN 'create'
     WHEN list_contains(actions, 'update') THEN 'update' WHEN list_contains(actions, 'no-op') THEN 'no-op'
     ELSE coalesce(actions[1], 'unknown') END"""

V_PLANS = f"""plans AS (
  SELECT plan_id, list({{'pos': pos, 'type': type, 'action': {ACTION_SQL},
                        'address': type || '.vm_' || CAST(pos AS VARCHAR), 'name_label': name_label,
                        'memory_max': memory_max, 'cpus': cpus, 'disk_sizes': disk_sizes}} ORDER BY pos) AS rc
  FROM plan_rows GROUP BY plan_id)"""

V_SPECS = """specs AS (
  SELECT k AS plan_id, o_custkey AS host_id, cat AS category,
         CASE WHEN cat = 'CREATE' AND k % 3 <> 0 THEN k % 4 + 1 END AS vm_count,
         CASE WHEN cat = 'CREATE' AND k % 3 = 0 THEN 2 END AS min_vm_count,
         CASE WHEN cat = 'CREATE' AND k % 3 = 0 THEN 4 END AS max_vm_count,
         CASE WHEN cat = 'CREATE' AND k % 2 = 0 THEN 8.0::DOUBLE END AS max_total_ram_gb,
         CASE WHEN cat = 'CREATE' AND k % 5 = 1 THEN 60 END AS max_total_cpus,
         CASE WHEN cat = 'CREATE' AND k % 7 = 0 THEN (k % 50 + 1) * 67108864 END AS per_vm_memory_max,
         CASE WHEN cat = 'CREATE' AND k % 7 = 1 THEN k % 50 + 1 END AS per_vm_cpus,
         CASE WHEN cat = 'CREATE' AND k % 7 = 2 THEN (k % 2000) * 16777216 END AS per_vm_disk_size,
         CASE WHEN cat = 'CREATE' AND k % 4 = 3 THEN ['vm-' || CAST(k % 100 AS VARCHAR), 'vm-' || CAST((k + 37) % 100 AS VARCHAR)] END AS vm_names,
         CASE WHEN cat = 'UPDATE' THEN CASE WHEN k % 2 = 0 THEN 'cpus' ELSE 'memory_max' END END AS updated_field,
         CASE WHEN cat = 'UPDATE' THEN CASE WHEN k % 2 = 0 THEN k % 50 + 1 ELSE (k % 50 + 1) * 67108864 END END AS new_value,
         CASE WHEN cat = 'UPDATE' OR (cat = 'DELETE' AND k % 2 = 0) THEN 'vm-' || CAST(k % 100 AS VARCHAR) END AS target_vm,
         CASE WHEN cat = 'DELETE' THEN ['vm-' || CAST((k + 11) % 100 AS VARCHAR), 'vm-' || CAST(k % 100 AS VARCHAR)] END AS target_vms,
         CASE WHEN cat = 'DELETE' THEN k % 3 END AS delete_count
  FROM (SELECT *, o_orderkey AS k,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CREATE' WHEN '2' THEN 'READ'
                    WHEN '3' THEN 'UPDATE' WHEN '4' THEN 'DELETE' ELSE 'MIGRATE' END AS cat
        FROM orders)
  WHERE k % 13 <> 0)"""


def _s(e: str) -> str:
    return f"CAST({e} AS VARCHAR)"


def _pylist(e: str) -> str:
    return f"'[' || array_to_string(list_transform({e}, lambda q: '''' || q || ''''), ', ') || ']'"


def _names_sql(e: str) -> str:
    return f"list_distinct(list_filter(list_transform({e}, lambda v: v.name_label), lambda q: q IS NOT NULL AND q <> ''))"


def _except(a: str, b: str) -> str:
    return f"list_sort(list_filter(list_distinct({a}), lambda q: NOT list_contains({b}, q)))"


def _nn(e: str) -> str:
    return f"list_filter({e}, lambda q: q IS NOT NULL)"


def _str_checks(items: str, errs: str) -> str:
    return (f"list_transform({items}, lambda c: {{'check': c.check, 'passed': "
            f"len(list_filter({errs}, lambda e: contains(e, c.check))) = 0, 'ok': c.ok}})")


def _lsum(e: str) -> str:
    return f"CAST(coalesce(list_sum({e}), 0) AS BIGINT)"


V_RULES = f"""x AS (SELECT p.plan_id, p.rc, s.*, s.plan_id IS NOT NULL AS has_spec,
                  list_filter(p.rc, lambda v: v.type = 'xenorchestra_vm') AS vms
           FROM plans p LEFT JOIN specs s ON p.plan_id = s.plan_id),
y AS (SELECT *, list_filter(vms, lambda v: v.action = 'create') AS creates,
             list_filter(vms, lambda v: v.action NOT IN ('create', 'no-op')) AS c_others,
             list_filter(vms, lambda v: v.action = 'update') AS updates,
             list_filter(vms, lambda v: v.action IN ('create', 'delete', 'replace')) AS u_forb,
             list_filter(vms, lambda v: v.action = 'delete') AS deletes,
             list_filter(vms, lambda v: v.action IN ('create', 'replace', 'update')) AS d_forb,
             list_filter(rc, lambda v: v.action <> 'no-op') AS r_changes,
             coalesce(vm_names, []::VARCHAR[]) AS exp_names,
             CASE WHEN coalesce(target_vm, '') <> '' THEN [target_vm] ELSE coalesce(target_vms, []::VARCHAR[]) END AS d_targets
      FROM x),
z AS (SELECT *, {_lsum("list_transform(creates, lambda v: coalesce(v.memory_max, 0))")} AS c_ram,
             {_lsum("list_transform(creates, lambda v: coalesce(v.cpus, 0))")} AS c_cpu,
             {_names_sql('creates')} AS c_names, {_names_sql('updates')} AS u_names, {_names_sql('deletes')} AS d_names,
             list_filter(vms, lambda v: coalesce(v.name_label, '') <> '' AND v.action IN ('create', 'update', 'replace', 'delete')) AS q_ev
      FROM y),
z2 AS (SELECT *, {_except('exp_names', 'c_names')} AS c_missing, {_except('c_names', 'exp_names')} AS c_extra,
              {_except('u_names', '[target_vm]')} AS u_extra,
              list_filter(d_targets, lambda t: NOT coalesce(list_contains(d_names, t), FALSE)) AS d_missing,
              {_except('d_names', 'd_targets')} AS d_extra,
              list_filter(list_filter(q_ev, lambda e: len(list_filter(q_ev, lambda w: w.name_label = e.name_label AND w.pos > e.pos)) = 0),
                          lambda e: e.action <> 'delete') AS q_live
       FROM z),
z3 AS (SELECT *,
  CASE WHEN category = 'READ' THEN 0 ELSE {_lsum("list_transform(q_live, lambda e: coalesce(e.memory_max, 0))")} END AS q_ram,
  CASE WHEN category = 'READ' THEN 0 ELSE {_lsum("list_transform(q_live, lambda e: coalesce(e.cpus, 0))")} END AS q_cpu,
  CASE WHEN category = 'READ' THEN 0 ELSE {_lsum("list_transform(q_live, lambda e: " + _lsum("list_transform(coalesce(e.disk_sizes, []::BIGINT[]), lambda d: coalesce(d, 0))") + ")")} END AS q_disk,
  {_nn(f'''list_concat([
     CASE WHEN len(c_others) > 0 THEN 'SPEC ERROR: CREATE task should not ' || c_others[1].action || ' VMs.' END,
     CASE WHEN vm_count IS NOT NULL AND len(creates) <> vm_count THEN 'SPEC ERROR: Expected ' || {_s('vm_count')} || ' VMs, found ' || {_s('len(creates)')} || '.' END,
     CASE WHEN vm_count IS NULL AND len(creates) < min_vm_count THEN 'SPEC ERROR: Expected at least ' || {_s('min_vm_count')} || ' VMs, found ' || {_s('len(creates)')} || '.' END,
     CASE WHEN vm_count IS NULL AND len(creates) > max_vm_count THEN 'SPEC ERROR: Expected at most ' || {_s('max_vm_count')} || ' VMs, found ' || {_s('len(creates)')} || '.' END,
     CASE WHEN max_total_ram_gb IS NOT NULL AND c_ram > max_total_ram_gb * 1073741824.0 THEN 'SPEC ERROR: Total RAM ' || {_s('round_even(c_ram / 1073741824.0, 2)')} || 'GB exceeds limit ' || {_s('max_total_ram_gb')} || 'GB.' END,
     CASE WHEN max_total_cpus IS NOT NULL AND c_cpu > max_total_cpus THEN 'SPEC ERROR: Total CPUs ' || {_s('c_cpu')} || ' exceeds limit ' || {_s('max_total_cpus')} || '.' END],
   flatten(list_transform(creates, lambda v, i: [
     CASE WHEN per_vm_memory_max IS NOT NULL AND NOT coalesce(v.memory_max = per_vm_memory_max, FALSE) THEN 'SPEC ERROR: VM ' || {_s('i')} || ' memory_max mismatch. Expected ' || {_s('per_vm_memory_max')} || ', got ' || coalesce({_s('v.memory_max')}, 'None') || '.' END,
     CASE WHEN per_vm_cpus IS NOT NULL AND NOT coalesce(v.cpus = per_vm_cpus, FALSE) THEN 'SPEC ERROR: VM ' || {_s('i')} || ' cpus mismatch. Expected ' || {_s('per_vm_cpus')} || ', got ' || coalesce({_s('v.cpus')}, 'None') || '.' END,
     CASE WHEN per_vm_disk_size IS NOT NULL AND coalesce(list_max(v.disk_sizes), 0) <> per_vm_disk_size THEN 'SPEC ERROR: VM ' || {_s('i')} || ' disk size mismatch. Expected ' || {_s('per_vm_disk_size')} || ', got ' || {_s('coalesce(list_max(v.disk_sizes), 0)')} || '.' END])),
   [CASE WHEN len(exp_names) > 0 AND len(c_missing) > 0 THEN 'SPEC ERROR: Missing expected VM names: ' || {_pylist('c_missing')} || '.' END,
    CASE WHEN len(exp_names) > 0 AND len(c_extra) > 0 THEN 'SPEC ERROR: Unexpected VM names created: ' || {_pylist('c_extra')} || '.' END])''')} AS create_err,
  list_concat(list_filter([
      CASE WHEN vm_count IS NOT NULL THEN {{'check': 'vm_count', 'ok': len(creates) = vm_count}} END,
      CASE WHEN vm_count IS NULL AND min_vm_count IS NOT NULL THEN {{'check': 'min_vm_count', 'ok': len(creates) >= min_vm_count}} END,
      CASE WHEN vm_count IS NULL AND max_vm_count IS NOT NULL THEN {{'check': 'max_vm_count', 'ok': len(creates) <= max_vm_count}} END,
      CASE WHEN max_total_ram_gb IS NOT NULL THEN {{'check': 'total_ram_limit', 'ok': c_ram <= max_total_ram_gb * 1073741824.0}} END,
      CASE WHEN max_total_cpus IS NOT NULL THEN {{'check': 'total_cpu_limit', 'ok': c_cpu <= max_total_cpus}} END],
      lambda q: q IS NOT NULL),
    flatten(list_transform(creates, lambda v: list_filter([
      CASE WHEN per_vm_memory_max IS NOT NULL THEN {{'check': 'memory_max', 'ok': coalesce(v.memory_max = per_vm_memory_max, FALSE)}} END,
      CASE WHEN per_vm_cpus IS NOT NULL THEN {{'check': 'cpus', 'ok': coalesce(v.cpus = per_vm_cpus, FALSE)}} END,
      CASE WHEN per_vm_disk_size IS NOT NULL THEN {{'check': 'per_vm_disk_size', 'ok': coalesce(list_max(v.disk_sizes), 0) = per_vm_disk_size}} END],
      lambda q: q IS NOT NULL)))) AS create_chk_names,
  CASE WHEN len(r_changes) > 0 THEN ['SPEC ERROR: READ task must not modify infrastructure. Found ' || {_s('len(r_changes)')} || ' changes: ' || {_pylist('list_transform(list_slice(r_changes, 1, 3), lambda v: v.address)')}] ELSE []::VARCHAR[] END AS read_err,
  {_nn(f'''list_concat([CASE WHEN len(updates) = 0 THEN 'SPEC ERROR: No update actions found in plan.' END],
     CASE WHEN coalesce(updated_field, '') <> '' AND new_value IS NOT NULL THEN
       list_transform(list_filter(updates, lambda v: NOT coalesce((CASE WHEN updated_field = 'memory_max' THEN v.memory_max WHEN updated_field = 'cpus' THEN v.cpus END) = new_value, FALSE)),
         lambda v: 'SPEC ERROR: Expected ' || updated_field || '=' || {_s('new_value')} || ', got ' || coalesce({_s("CASE WHEN updated_field = 'memory_max' THEN v.memory_max WHEN updated_field = 'cpus' THEN v.cpus END")}, 'None') || '.')
     ELSE []::VARCHAR[] END,
     [CASE WHEN coalesce(target_vm, '') <> '' AND NOT coalesce(list_contains(u_names, target_vm), FALSE) THEN 'SPEC ERROR: Expected target VM ' || chr(39) || target_vm || chr(39) || ' to be updated.' END,
      CASE WHEN coalesce(target_vm, '') <> '' AND len(u_extra) > 0 THEN 'SPEC ERROR: Unexpected VMs updated: ' || {_pylist('u_extra')} || '.' END])''')} AS update_err_ok,
  {_nn(f'''list_concat([CASE WHEN delete_count IS NOT NULL AND len(deletes) <> delete_count THEN 'SPEC ERROR: Expected ' || {_s('delete_count')} || ' deletions, found ' || {_s('len(deletes)')} || '.' END],
     CASE WHEN len(d_targets) > 0 THEN list_transform(d_missing, lambda t: 'SPEC ERROR: Target VM ' || chr(39) || t || chr(39) || ' not marked for deletion.') ELSE []::VARCHAR[] END,
     [CASE WHEN len(d_targets) > 0 AND len(d_extra) > 0 THEN 'SPEC ERROR: Extra VMs deleted: ' || {_pylist('d_extra')} END])''')} AS delete_err_ok
  FROM z2),
z4 AS (SELECT *, {_nn(f'''[CASE WHEN q_ram > 21474836480 THEN 'HOST QUOTA ERROR: Final projected RAM (' || printf('%.2f', round_even(q_ram / 1073741824.0, 2)) || ' GB) exceeds host limit (20.00 GB).' END,
                           CASE WHEN q_cpu > 30 THEN 'HOST QUOTA ERROR: Final projected vCPUs (' || {_s('q_cpu')} || ') exceeds host limit (30).' END,
                           CASE WHEN q_disk > 966367641600 THEN 'HOST QUOTA ERROR: Final projected Disk space (' || printf('%.2f', round_even(q_disk / 1073741824.0, 2)) || ' GB) exceeds host limit (900.00 GB).' END]''')} AS q_err
       FROM z3),
r AS (SELECT plan_id, category,
  CASE WHEN NOT has_spec THEN ['SPEC ERROR: No spec found for task ''' || {_s('plan_id')} || '''.']
       WHEN category NOT IN ('CREATE', 'READ', 'UPDATE', 'DELETE') THEN ['SPEC ERROR: Unknown task category ''' || category || ''' for task ''' || {_s('plan_id')} || '''.']
       ELSE list_concat(CASE category
         WHEN 'CREATE' THEN create_err
         WHEN 'READ' THEN read_err
         WHEN 'UPDATE' THEN CASE WHEN len(u_forb) > 0 THEN ['SPEC ERROR: UPDATE task should not create/delete/replace VMs (found ' || u_forb[1].action || ').'] ELSE update_err_ok END
         ELSE CASE WHEN len(d_forb) > 0 THEN ['SPEC ERROR: DELETE task should not create/update/replace VMs (found ' || d_forb[1].action || ').'] ELSE delete_err_ok END
       END, q_err) END AS errors,
  CASE WHEN NOT has_spec THEN [{{'check': 'spec_exists', 'passed': FALSE, 'ok': FALSE}}]
       WHEN category NOT IN ('CREATE', 'READ', 'UPDATE', 'DELETE') THEN [{{'check': 'category_valid', 'passed': FALSE, 'ok': FALSE}}]
       ELSE list_concat(CASE category
         WHEN 'CREATE' THEN list_concat({_str_checks('create_chk_names', 'create_err')},
              CASE WHEN len(exp_names) > 0 THEN [{{'check': 'vm_names', 'passed': len(c_missing) = 0 AND len(c_extra) = 0, 'ok': len(c_missing) = 0 AND len(c_extra) = 0}}] ELSE [] END)
         WHEN 'READ' THEN CASE WHEN len(r_changes) > 0 THEN [{{'check': 'no_resource_changes', 'passed': FALSE, 'ok': FALSE}}]
              ELSE [{{'check': 'no_resource_changes', 'passed': TRUE, 'ok': TRUE}}, {{'check': 'has_data_sources', 'passed': NULL::BOOLEAN, 'ok': NULL::BOOLEAN}}, {{'check': 'has_outputs', 'passed': NULL::BOOLEAN, 'ok': NULL::BOOLEAN}}] END
         WHEN 'UPDATE' THEN CASE WHEN len(u_forb) > 0 THEN [{{'check': 'action_type_only_update', 'passed': FALSE, 'ok': FALSE}}]
              ELSE list_concat({_str_checks("list_filter([{'check': 'action_type_only_update', 'ok': TRUE}, CASE WHEN coalesce(updated_field, '') <> '' AND new_value IS NOT NULL THEN {'check': updated_field || '_update', 'ok': len(list_filter(updates, lambda v: NOT coalesce((CASE WHEN updated_field = 'memory_max' THEN v.memory_max WHEN updated_field = 'cpus' THEN v.cpus END) = new_value, FALSE))) = 0} END], lambda q: q IS NOT NULL)", 'update_err_ok')},
                   CASE WHEN coalesce(target_vm, '') <> '' THEN [{{'check': 'target_vm', 'passed': coalesce(list_contains(u_names, target_vm), FALSE) AND len(u_extra) = 0, 'ok': coalesce(list_contains(u_names, target_vm), FALSE) AND len(u_extra) = 0}}] ELSE [] END) END
         ELSE CASE WHEN len(d_forb) > 0 THEN [{{'check': 'action_type_only_delete', 'passed': FALSE, 'ok': FALSE}}]
              ELSE list_concat({_str_checks("[{'check': 'action_type_only_delete', 'ok': TRUE}]", 'delete_err_ok')},
                   CASE WHEN len(d_targets) > 0 THEN [{{'check': 'correct_vms_targeted', 'passed': len(d_missing) = 0 AND len(d_extra) = 0, 'ok': len(d_missing) = 0 AND len(d_extra) = 0}}] ELSE [] END) END
       END, [{{'check': 'host_resource_quotas', 'passed': len(q_err) = 0, 'ok': len(q_err) = 0}}]) END AS checks,
  CASE WHEN category = 'UPDATE' THEN len(list_filter(vms, lambda v: v.action = 'replace')) > 0 END AS had_replace_actions
FROM z4)"""

ORACLE["spec_check"] = f"""
WITH {V_PLAN_ROWS}, {V_PLANS}, {V_SPECS}, {V_RULES}
SELECT plan_id, category, len(errors) = 0 AS passed, CAST(len(errors) AS INTEGER) AS n_errors,
       array_to_string(errors, ' | ') AS errors,
       array_to_string(list_transform(checks, lambda c: c.check || '=' || coalesce(CAST(c.passed AS VARCHAR), 'null')), ',') AS checks,
       array_to_string(list_transform(checks, lambda c: c.check || '=' || coalesce(CAST(c.ok AS VARCHAR), 'null')), ',') AS checks_true,
       had_replace_actions
FROM r"""

ORACLE["spec_check_summary"] = f"""
WITH {V_PLAN_ROWS}, {V_PLANS}, {V_SPECS}, {V_RULES}
SELECT category, count(*) AS n_plans, count(*) FILTER (WHERE len(errors) = 0) AS n_passed,
       CAST(sum(len(errors)) AS BIGINT) AS n_errors,
       count(*) FILTER (WHERE len(list_filter(errors, lambda e: starts_with(e, 'HOST QUOTA'))) > 0) AS n_quota_failures
FROM r GROUP BY category"""

ORACLE["host_quota"] = f"""
WITH {V_PLAN_ROWS},
st AS (SELECT o.o_custkey AS host_id, p.name_label,
              CASE WHEN p.linenumber = 1 THEN 'existing' ELSE {ACTION_SQL.replace('actions', 'p.actions')} END AS action,
              p.memory_max, p.cpus, CAST(list_sum(p.disk_sizes) AS BIGINT) AS disk,
              CASE WHEN p.linenumber = 1 THEN 0 ELSE 1 END AS prio, p.plan_id, p.pos
       FROM plan_rows p JOIN orders o ON o.o_orderkey = p.plan_id),
ev AS (SELECT * FROM st WHERE coalesce(name_label, '') <> ''
        AND action IN ('existing', 'create', 'update', 'replace', 'delete')),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host_id, name_label ORDER BY prio DESC, plan_id DESC, pos DESC) AS rn FROM ev) WHERE rn = 1),
tot AS (SELECT host_id, count(*) AS n_vms, CAST(sum(coalesce(memory_max, 0)) AS BIGINT) AS total_ram,
               CAST(sum(coalesce(cpus, 0)) AS BIGINT) AS total_cpus, CAST(sum(coalesce(disk, 0)) AS BIGINT) AS total_disk
        FROM lst WHERE action <> 'delete' GROUP BY host_id),
e AS (SELECT *, {_nn('''[CASE WHEN total_ram > 21474836480 THEN 'HOST QUOTA ERROR: Final projected RAM (' || printf('%.2f', round_even(total_ram / 1073741824.0, 2)) || ' GB) exceeds host limit (20.00 GB).' END,
                        CASE WHEN total_cpus > 30 THEN 'HOST QUOTA ERROR: Final projected vCPUs (' || CAST(total_cpus AS VARCHAR) || ') exceeds host limit (30).' END,
                        CASE WHEN total_disk > 966367641600 THEN 'HOST QUOTA ERROR: Final projected Disk space (' || printf('%.2f', round_even(total_disk / 1073741824.0, 2)) || ' GB) exceeds host limit (900.00 GB).' END]''')} AS errs FROM tot)
SELECT host_id, n_vms, total_ram, total_cpus, total_disk, len(errs) = 0 AS passed, array_to_string(errs, ' | ') AS errors FROM e"""

# ------------------------------------------------------------------ post state
V_SNAP = """pre AS (SELECT c_nationkey AS task_id, c_name AS name, 'u-' || CAST(c_custkey AS VARCHAR) AS uuid,
                  CAST(c_custkey % 8 + 1 AS INTEGER) AS cpus, (c_custkey % 16 + 1) / 4.0::DOUBLE AS ram_gb FROM customer),
post AS (SELECT c_nationkey AS task_id, c_name AS name,
                CASE WHEN c_custkey % 10 = 0 THEN 'r-' ELSE 'u-' END || CAST(c_custkey AS VARCHAR) AS uuid,
                CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 8 + 2 ELSE c_custkey % 8 + 1 END AS INTEGER) AS cpus,
                CASE WHEN c_custkey % 5 = 0 THEN (c_custkey % 16 + 1) / 4.0::DOUBLE + 0.5 ELSE (c_custkey % 16 + 1) / 4.0::DOUBLE END AS ram_gb
         FROM customer WHERE c_custkey % 7 <> 0),
g AS (SELECT c_nationkey AS task_id, arg_min(c_name, c_custkey) AS lo_name, min(c_custkey) AS lo,
             arg_max(c_name, c_custkey) AS hi_name FROM customer GROUP BY c_nationkey),
specs AS (SELECT task_id, CASE WHEN task_id % 2 = 0 THEN 'UPDATE' ELSE 'DELETE' END AS category,
                 CASE WHEN task_id % 2 = 0 THEN lo_name END AS target_vm,
                 CASE WHEN task_id % 2 <> 0 THEN [lo_name, hi_name] END AS target_vms,
                 CASE WHEN task_id % 2 = 0 THEN CASE WHEN task_id % 4 = 0 THEN 'cpus' ELSE 'memory_max' END END AS updated_field,
                 CASE WHEN task_id % 2 = 0 THEN CASE WHEN task_id % 4 = 0 THEN lo % 8 + 2
                      ELSE CAST(trunc(((lo % 16 + 1) / 4.0::DOUBLE + 0.5) * 1073741824.0) AS BIGINT) END END AS new_value
          FROM g)"""

ORACLE["post_state_check"] = f"""
WITH {V_SNAP},
np AS (SELECT task_id, count(*) AS n FROM pre GROUP BY task_id),
nq AS (SELECT task_id, count(*) AS n FROM post GROUP BY task_id),
u AS (SELECT s.task_id, s.target_vm AS t, s.updated_field AS f, s.new_value AS v, coalesce(np.n, 0) AS n_pre, coalesce(nq.n, 0) AS n_post,
             a.uuid AS pu, b.uuid AS qu, b.cpus AS qc, b.ram_gb AS qr, a.name IS NOT NULL AS has_a, b.name IS NOT NULL AS has_b
      FROM specs s LEFT JOIN np USING (task_id) LEFT JOIN nq USING (task_id)
      LEFT JOIN pre a ON a.task_id = s.task_id AND a.name = s.target_vm
      LEFT JOIN post b ON b.task_id = s.task_id AND b.name = s.target_vm
      WHERE s.category = 'UPDATE'),
ue AS (SELECT task_id, 'UPDATE' AS category, list_filter([
         CASE WHEN n_pre <> n_post THEN 'POST-STATE ERROR: VM count changed during UPDATE.' END,
         CASE WHEN coalesce(t, '') <> '' AND NOT has_b THEN 'POST-STATE ERROR: Target VM ' || chr(39) || t || chr(39) || ' not found after UPDATE.' END,
         CASE WHEN coalesce(t, '') <> '' AND has_a AND has_b AND f = 'memory_max' AND CAST(trunc(coalesce(qr, 0.0) * 1073741824.0) AS BIGINT) <> v
              THEN 'POST-STATE ERROR: VM ' || chr(39) || t || chr(39) || ' memory_max is ' || CAST(CAST(trunc(coalesce(qr, 0.0) * 1073741824.0) AS BIGINT) AS VARCHAR) || ', expected ' || CAST(v AS VARCHAR) || '.' END,
         CASE WHEN coalesce(t, '') <> '' AND has_a AND has_b AND f = 'cpus' AND coalesce(qc, 0) <> v
              THEN 'POST-STATE ERROR: VM ' || chr(39) || t || chr(39) || ' cpus is ' || CAST(coalesce(qc, 0) AS VARCHAR) || ', expected ' || CAST(v AS VARCHAR) || '.' END,
         CASE WHEN coalesce(t, '') <> '' AND has_a AND has_b AND pu IS DISTINCT FROM qu
              THEN 'POST-STATE ERROR: VM ' || chr(39) || t || chr(39) || ' UUID changed (replace instead of in-place update).' END],
       lambda e: e IS NOT NULL) AS errors FROM u),
dt AS (SELECT task_id, unnest(target_vms) AS name, generate_subscripts(target_vms, 1) AS tpos FROM specs WHERE category = 'DELETE'),
de AS (SELECT s.task_id, 'DELETE' AS category,
              coalesce(list(CASE WHEN b.name IS NOT NULL THEN 'POST-STATE ERROR: VM ' || chr(39) || dt.name || chr(39) || ' still exists.' END ORDER BY dt.tpos)
                       FILTER (WHERE b.name IS NOT NULL), []::VARCHAR[]) AS errors
       FROM specs s LEFT JOIN dt USING (task_id) LEFT JOIN post b ON b.task_id = dt.task_id AND b.name = dt.name
       WHERE s.category = 'DELETE' GROUP BY s.task_id),
al AS (SELECT * FROM ue UNION ALL SELECT * FROM de)
SELECT task_id, category, len(errors) = 0 AS passed, array_to_string(errors, ' | ') AS errors FROM al"""

ORACLE["update_validation"] = f"""
WITH {V_SNAP}
SELECT s.task_id, s.target_vm, TRUE AS plan_shows_in_place_update, FALSE AS plan_shows_destroy_create,
       coalesce(a.uuid, 'unknown') AS vm_uuid_before, coalesce(b.uuid, 'unknown') AS vm_uuid_after,
       coalesce(a.uuid = b.uuid, FALSE) AS uuid_unchanged, 0 AS vm_downtime_seconds, TRUE AS resource_change_correct,
       {_r('coalesce(a.ram_gb, 0.0)')} AS ram_before_gb, {_r('coalesce(b.ram_gb, 0.0)')} AS ram_after_gb,
       coalesce(a.cpus, 0) AS cpu_before, coalesce(b.cpus, 0) AS cpu_after
FROM specs s LEFT JOIN pre a ON a.task_id = s.task_id AND a.name = s.target_vm
LEFT JOIN post b ON b.task_id = s.task_id AND b.name = s.target_vm
WHERE s.category = 'UPDATE'"""

# ------------------------------------------------------------------ object graph
V_INV = """disks AS (SELECT 'vm-' || CAST(l.l_orderkey AS VARCHAR) AS vm_id, CAST(sum(CAST(p.p_size AS BIGINT) * 1073741824) AS BIGINT) AS disk_bytes
          FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey AND p.p_partkey % 9 <> 0 GROUP BY 1),
inv AS (SELECT o.o_custkey AS host_id, 'vm-' || CAST(o.o_orderkey AS VARCHAR) AS vm_id, 'vm-' || CAST(o.o_orderkey AS VARCHAR) AS name,
               CASE WHEN o.o_orderstatus <> 'P' THEN '10.0.' || CAST(o.o_orderkey % 250 AS VARCHAR) || '.' || CAST(o.o_orderkey % 200 AS VARCHAR) ELSE 'unknown' END AS ip,
               CASE WHEN o.o_orderstatus = 'F' THEN 'Running' WHEN o.o_orderstatus = 'O' THEN 'Halted' ELSE 'Paused' END AS status,
               CAST(o.o_orderkey % 8 + 1 AS INTEGER) AS cpus,
               CAST((o.o_orderkey % 16 + 1) * 268435456 AS BIGINT) AS ram_bytes,
               coalesce(d.disk_bytes, 0) AS disk_bytes
        FROM orders o LEFT JOIN disks d ON d.vm_id = 'vm-' || CAST(o.o_orderkey AS VARCHAR)
        WHERE o.o_orderkey % 97 <> 0)"""

ORACLE["vm_inventory"] = f"""
WITH {V_INV}
SELECT host_id, vm_id, name, vm_id AS uuid, ip, status, cpus, ram_bytes, disk_bytes,
       {_r('round_even(ram_bytes / 1073741824.0, 2)')} AS ram_gb, {_r('round_even(disk_bytes / 1073741824.0, 2)')} AS disk_gb
FROM inv"""

ORACLE["host_snapshot"] = f"""
WITH {V_INV}
SELECT host_id, count(*) AS actual_vm_count, count(*) > 0 AS vms_exist, bool_and(status = 'Running') AS all_vms_running,
       CAST(sum(disk_bytes) AS BIGINT) AS total_disk_bytes, CAST(sum(ram_bytes) AS BIGINT) AS total_ram_bytes,
       CAST(sum(cpus) AS BIGINT) AS total_cpus
FROM inv GROUP BY host_id"""

# ------------------------------------------------------------------ embeddings
ORACLE["embedding_match"] = """
WITH e AS (SELECT vec_id, vec_id // 16 AS label, CAST(embedding AS DOUBLE[]) AS v, vec_id % 50 = 7 AS zero FROM embeddings),
tok AS (SELECT label AS pair_id, 'ref' AS side, vec_id, v, zero FROM e
        UNION ALL SELECT label - 1 AS pair_id, 'cand' AS side, vec_id, v, zero FROM e),
prs AS (SELECT DISTINCT pair_id FROM tok),
pb AS (SELECT c.pair_id, c.vec_id, max(CASE WHEN c.zero OR r.zero THEN 0.0 ELSE list_cosine_similarity(c.v, r.v) END) AS best
       FROM tok c JOIN tok r ON r.pair_id = c.pair_id AND r.side = 'ref' WHERE c.side = 'cand' GROUP BY 1, 2),
rb AS (SELECT r.pair_id, r.vec_id, max(CASE WHEN c.zero OR r.zero THEN 0.0 ELSE list_cosine_similarity(r.v, c.v) END) AS best
       FROM tok r JOIN tok c ON c.pair_id = r.pair_id AND c.side = 'cand' WHERE r.side = 'ref' GROUP BY 1, 2),
pp AS (SELECT pair_id, avg(best) AS p FROM pb GROUP BY 1),
rr AS (SELECT pair_id, avg(best) AS r FROM rb GROUP BY 1),
j AS (SELECT prs.pair_id, p, r FROM prs LEFT JOIN pp USING (pair_id) LEFT JOIN rr USING (pair_id))
SELECT pair_id,
       CASE WHEN p IS NOT NULL AND r IS NOT NULL THEN round(p, 4) END AS precision,
       CASE WHEN p IS NOT NULL AND r IS NOT NULL THEN round(r, 4) END AS recall,
       CASE WHEN p IS NOT NULL AND r IS NOT NULL THEN round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) END AS f1,
       CASE WHEN p IS NOT NULL AND r IS NOT NULL THEN round(CASE WHEN 9 * p + r <> 0 THEN 10 * p * r / (9 * p + r) ELSE 0.0 END, 4) END AS f3
FROM j"""

# ------------------------------------------------------------------ attempts / chains
V_ATTEMPTS = """att AS (
  SELECT user_id AS run_id, event_id AS iteration,
         CASE event_type WHEN 'error' THEN 'plan_failed' WHEN 'view' THEN 'spec_failed' WHEN 'click' THEN 'validate_ok'
              WHEN 'signup' THEN 'init_ok' ELSE 'applied' END AS stage,
         event_type = 'purchase' AS success, value AS gen_s, event_type IN ('error', 'view') AS is_error
  FROM events)"""

ORACLE["attempt_rollup"] = f"""
WITH {V_ATTEMPTS}
SELECT run_id, count(*) AS iterations, round(sum(gen_s), 2) AS total_gen_s,
       count(*) FILTER (WHERE stage = 'spec_failed') AS spec_fail_count,
       arg_max(stage, iteration) AS final_stage, arg_max(success, iteration) AS success,
       min(CASE WHEN success THEN iteration END) AS first_success_iter
FROM att GROUP BY run_id"""

ORACLE["error_tail"] = f"""
WITH {V_ATTEMPTS},
t AS (SELECT run_id, iteration, stage, row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC) AS tail_rank
      FROM att WHERE is_error)
SELECT run_id, iteration, stage, CAST(tail_rank AS INTEGER) AS tail_rank,
       CAST(CASE WHEN tail_rank <= 2 THEN 3 - tail_rank END AS INTEGER) AS prompt_no
FROM t WHERE tail_rank <= 5"""

ORACLE["chain_progress"] = """
WITH st AS (
  SELECT CAST(floor(event_id / 3) AS BIGINT) AS chain_id, CAST(event_id % 3 AS INTEGER) AS step, event_id AS pos,
         CASE WHEN floor(event_id / 3) % 2 = 0 THEN ['c1.3', 'u1.2', 'd1.2'] ELSE ['c2.3', 'r1.2', 'd2.2'] END[event_id % 3 + 1] AS task,
         event_type <> 'error' AS ok FROM events),
s2 AS (SELECT *, CASE left(task, 1) WHEN 'c' THEN 'CREATE' WHEN 'u' THEN 'UPDATE' WHEN 'r' THEN 'READ' ELSE 'DELETE' END AS category FROM st),
c AS (SELECT chain_id, count(*) AS n, min(pos) AS unit_start,
             string_agg(replace(task, '.', '_'), '_' ORDER BY step) AS slug,
             bool_or(step = 0 AND ok) AS ok0, bool_or(step = 1 AND ok) AS ok1,
             max(CASE WHEN step = 1 THEN category END) AS cat1 FROM s2 GROUP BY chain_id),
c2 AS (SELECT *, CASE WHEN n >= 1 THEN CASE WHEN ok0 THEN CASE WHEN n > 1 THEN 1 END ELSE CASE WHEN n = 3 THEN 2 END END END AS nx0 FROM c),
c3 AS (SELECT *, CASE WHEN nx0 = 1 THEN CASE WHEN ok1 THEN CASE WHEN n > 2 THEN 2 END ELSE CASE WHEN n = 3 THEN 2 END END END AS nx1 FROM c2)
SELECT s2.chain_id, c3.unit_start, c3.slug, s2.step, s2.task, s2.category, s2.ok,
       CASE s2.step WHEN 0 THEN TRUE WHEN 1 THEN coalesce(nx0 = 1, FALSE) ELSE coalesce(nx0 = 2, FALSE) OR coalesce(nx1 = 2, FALSE) END AS executed,
       CAST(CASE s2.step WHEN 0 THEN nx0 WHEN 1 THEN CASE WHEN nx0 = 1 THEN nx1 END END AS INTEGER) AS next_step,
       CAST(CASE s2.step WHEN 0 THEN NULL
            WHEN 1 THEN CASE WHEN nx0 = 1 AND ok0 THEN 0 END
            ELSE CASE WHEN coalesce(nx0 = 2, FALSE) OR coalesce(nx1 = 2, FALSE) THEN
                   CASE WHEN nx0 = 1 AND ok1 AND cat1 <> 'READ' THEN 1 WHEN ok0 THEN 0 END END END AS INTEGER) AS state_from
FROM s2 JOIN c3 USING (chain_id)"""

# ------------------------------------------------------------------ run matrix / entries
V_BENCH = """bt AS (
  SELECT item_id, substr('CRUDM', CAST(item_id % 5 + 1 AS INTEGER), 1) AS letter, text AS prompt,
         'model' || CAST(item_id % 2 AS VARCHAR) AS folder, 'm' || CAST(item_id % 2 AS VARCHAR) AS model_short,
         CASE WHEN item_id % 3 <> 0 THEN item_id % 7 END AS base_seed
  FROM benchmark),
bt2 AS (SELECT *, letter || CAST(item_id % 5 + 1 AS VARCHAR) || '.' || CAST(item_id % 3 + 1 AS VARCHAR) AS task_id,
               CASE letter WHEN 'C' THEN 'CREATE' WHEN 'R' THEN 'READ' WHEN 'U' THEN 'UPDATE' WHEN 'D' THEN 'DELETE' ELSE 'MIGRATE' END AS category
        FROM bt),
ex AS (SELECT category, arg_min(prompt, item_id) AS ex_prompt, 'Plan the ' || category || '.' AS thought, arg_max(prompt, item_id) AS hcl
       FROM bt2 WHERE category <> 'MIGRATE' GROUP BY category),
grid AS (SELECT * FROM (VALUES (1), (2), (3)) p(pass_no), (VALUES (''), ('COT'), ('FSP'), ('dataset'), ('multi-turn')) s(strategy)),
m AS (SELECT bt2.*, grid.pass_no, grid.strategy, ex.ex_prompt, ex.thought, ex.hcl
      FROM bt2, grid LEFT JOIN ex ON ex.category = CASE WHEN bt2.category IN ('CREATE', 'READ', 'UPDATE', 'DELETE') THEN bt2.category ELSE 'CREATE' END)"""

ORACLE["run_matrix"] = f"""
WITH {V_BENCH}
SELECT item_id, pass_no, strategy,
       replace(lower(task_id), '.', '_') || '_' || model_short || '_pass' || CAST(pass_no AS VARCHAR)
         || CASE WHEN strategy <> '' THEN '_' || strategy ELSE '' END AS entry_id,
       CASE WHEN strategy <> '' AND strategy <> 'baseline' THEN folder || '_' || strategy ELSE folder END AS folder,
       CASE WHEN base_seed IS NOT NULL THEN base_seed + pass_no - 1 END AS seed,
       md5(CASE WHEN strategy = 'COT' THEN 'Here is an example:' || chr(10) || chr(10) || 'Example prompt: ' || coalesce(ex_prompt, '') || chr(10)
                  || 'Example output: Let''s think step by step. ' || coalesce(thought, '') || chr(10) || '```hcl' || chr(10) || coalesce(hcl, '')
                  || chr(10) || '```' || chr(10) || chr(10) || 'Here is the actual prompt to answer. Let''s think step by step:' || chr(10) || prompt
                WHEN strategy = 'FSP' THEN 'Here is an example:' || chr(10) || chr(10) || 'Example prompt: ' || coalesce(ex_prompt, '') || chr(10)
                  || 'Example output:' || chr(10) || '```hcl' || chr(10) || coalesce(hcl, '')
                  || chr(10) || '```' || chr(10) || chr(10) || 'Here is the actual prompt to answer:' || chr(10) || prompt
                WHEN strategy = 'dataset' THEN 'TASK:' || chr(10) || 'Generate the definitive ground-truth Terraform HCL for the following infrastructure requirement.'
                     || chr(10) || chr(10) || 'REQUIREMENT:' || chr(10) || prompt || chr(10) || chr(10)
                     || 'Follow the structural rules defined in the system prompt. RESOLVE ALL IDENTIFIERS using data sources.' || chr(10)
                     || 'Provide the code in a single ```hcl block.' || chr(10)
                ELSE 'Here is the actual prompt: ' || prompt END) AS prompt_md5
FROM m"""

ALT = r"(?i)(\d+)\s*[*_]*\s*VMs?[*_]*\s*with\s*(\d+(?:\.\d+)?)\s*(GB|MB)"

ORACLE["entry_outcomes"] = f"""
WITH {V_FENCED},
r0 AS (SELECT f.conv_id AS c, f.turn AS t, f.response, cv.text,
              c % 3 + 1 AS vms, c % 4 + 1 AS gb
       FROM fenced f JOIN conversations cv ON cv.conv_id = f.conv_id AND cv.turn = f.turn),
r1 AS (SELECT *, substr('CRUD', CAST(c % 4 + 1 AS INTEGER), 1) AS letter,
              'Create ' || CAST(vms AS VARCHAR) || ' VMs with ' || CAST(gb AS VARCHAR) || ' GB RAM'
                || CASE WHEN t % 2 = 0 THEN ' and 2 cpu' ELSE '' END
                || CASE WHEN c % 5 = 0 THEN ' on network xenbr0' ELSE '' END
                || CASE WHEN c % 3 = 0 THEN ' with a 20 GB disk' ELSE '' END AS prompt,
              CASE WHEN t % 3 <> 0 THEN 'resource "xenorchestra_vm" "vm" {{' || chr(10) || '  cpus = ' || CAST(c % 4 + 1 AS VARCHAR)
                   || chr(10) || '  memory_max = ' || CAST(gb AS VARCHAR) || ' * 1024 * 1024 * 1024' || chr(10) || '  network {{' || chr(10)
                   || '    network_id = data.xenorchestra_network.net.id' || chr(10) || '  }}' || chr(10) || '}}'
                   ELSE {_extract_code('response')} END AS code,
              text || CASE WHEN c % 11 = 0 THEN chr(10) || 'Try 2 VMs with 4 GB instead. password: hunter2' ELSE '' END AS raw,
              CASE WHEN (c + t) % 5 = 0 THEN 1 ELSE 0 END AS plan_exit,
              c % 11 = 0 AS matched,
              CASE WHEN t % 3 = 0 THEN NULL ELSE c % 2 = 0 END AS spec_passed,
              CAST(t % 3 + 1 AS INTEGER) AS iterations
       FROM r0),
r2 AS (SELECT *, CASE WHEN t % 4 = 3 THEN 'skipped_plan_only' WHEN plan_exit = 0 AND t % 2 = 0 THEN 'success' ELSE 'failed' END AS apply_status,
              CASE WHEN letter IN ('U', 'D') THEN c % 3 <> 0 END AS post_passed,
              {_setting_total('code', 'memory_max')} AS tmem, {_setting_total('code', 'cpus')} AS tcpu, {_setting_total('code', 'size')} AS tdisk,
              lower(prompt) AS lp
       FROM r1),
r3 AS (SELECT *, CASE WHEN apply_status = 'success' THEN 0 ELSE 1 END AS apply_exit,
              CAST(round_even(tmem / vms, 0) AS BIGINT) AS amem, CAST(round_even(tcpu / vms, 0) AS BIGINT) AS acpu,
              CAST(round_even(tdisk / vms, 0) AS BIGINT) AS adisk,
              CAST(gb * 1073741824 AS BIGINT) AS exp_mem,
              CASE WHEN t % 2 = 0 THEN 2 END AS exp_cpu
       FROM r2),
r4 AS (SELECT *, plan_exit = 0 AS plan_success, apply_status = 'success' AND apply_exit = 0 AS apply_success FROM r3),
r5 AS (SELECT *, matched OR (CASE WHEN apply_status = 'skipped_plan_only' THEN plan_success ELSE apply_success END) AS execution FROM r4)
SELECT replace(lower(letter || '1.' || CAST(t % 3 + 1 AS VARCHAR)), '.', '_') || '_m0_pass' || CAST(t + 1 AS VARCHAR)
         || CASE WHEN c % 3 = 0 THEN '_COT' ELSE '' END AS entry_id,
       letter || '1.' || CAST(t % 3 + 1 AS VARCHAR) AS task_id,
       CASE c % 4 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'READ' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END || ' - '
         || CASE WHEN c % 2 = 0 THEN 'detailed' ELSE 'brief' END AS task_description,
       plan_success, apply_success, execution AS execution_successful,
       matched OR (execution AND coalesce(spec_passed = TRUE, FALSE) AND coalesce(post_passed, TRUE)) AS meets_requirements,
       iterations - 1 AS total_fixes_needed, coalesce(spec_passed, TRUE) AS resource_allocation_correct,
       CASE WHEN apply_status = 'skipped_plan_only' THEN 'skipped_plan_only' WHEN apply_exit = 0 THEN 'success' ELSE 'failed' END AS apply_status,
       CAST(vms AS INTEGER) AS to_create, CAST(t % 2 AS INTEGER) AS to_destroy,
       CASE WHEN c % 7 = 0 THEN 'failed' ELSE 'success' END AS validate_status,
       CASE WHEN plan_exit <> 0 THEN 'Error: plan failed' END AS plan_error,
       array_to_string(list_filter([CASE WHEN contains(lp, 'ram') THEN 'ram' END, CASE WHEN contains(lp, 'cpu') THEN 'cpu' END,
                                    CASE WHEN contains(lp, 'disk') THEN 'disk' END, CASE WHEN contains(lp, 'network') THEN 'network' END],
                                   lambda q: q IS NOT NULL), ',') AS info_provided,
       array_to_string(list_filter([CASE WHEN c % 2 <> 0 THEN 'ip_configuration' END, CASE WHEN NOT contains(lp, 'disk') THEN 'disk_size' END,
                                    CASE WHEN NOT contains(lp, 'network') THEN 'network_bridge' END], lambda q: q IS NOT NULL), ',') AS info_missing,
       coalesce(CAST(acpu AS VARCHAR), CASE WHEN NOT contains(lp, 'cpu') THEN 'not_specified' ELSE 'not_detected' END) AS inferred_cpus,
       coalesce(CAST(amem AS VARCHAR), CASE WHEN NOT contains(lp, 'ram') THEN 'not_specified' ELSE 'not_detected' END) AS inferred_ram,
       coalesce(CAST(adisk AS VARCHAR), CASE WHEN NOT contains(lp, 'disk') THEN 'not_specified' ELSE 'not_detected' END) AS inferred_disk,
       CASE WHEN contains(lower(code), 'dhcp') OR contains(code, 'network {{') THEN 'dhcp' ELSE 'not_detected' END AS ip_mode,
       md5(regexp_replace(raw, {_sql_str(REDACT)}, '\\1\\2"[REDACTED]"', 'g')) AS response_md5,
       exp_mem AS expected_mem, tmem AS actual_total_mem,
       matched OR coalesce(amem = exp_mem, FALSE) AS ram_ok,
       matched OR CASE WHEN exp_cpu IS NOT NULL THEN coalesce(acpu = exp_cpu, FALSE) ELSE coalesce(acpu >= 1, FALSE) END AS vcpu_ok,
       matched OR coalesce(adisk >= 10737418240, FALSE) AS disk_ok,
       abs(CAST(round(CAST(gb AS DOUBLE) * 1073741824) AS BIGINT) - CASE WHEN coalesce(amem, 0) <> 0 THEN amem ELSE 1073741824 END)
         <= floor(0.05 * CASE WHEN coalesce(amem, 0) <> 0 THEN amem ELSE 1073741824 END) AS vm_ram_ok,
       t % 2 = 0 AS dhcp_ip, contains(code, 'network {{') AS dhcp_configured,
       CASE WHEN c % 11 = 0 THEN 'over_provisioning' ELSE 'none' END AS edge_case,
       round_even(20.0::DOUBLE - gb, 2) AS avail_after,
       CASE WHEN c % 11 = 0 THEN array_to_string(list_transform(list_zip(regexp_extract_all(raw, {_sql_str(ALT)}, 1),
              regexp_extract_all(raw, {_sql_str(ALT)}, 2), regexp_extract_all(raw, {_sql_str(ALT)}, 3)),
              lambda z: z[1] || ' VMs with ' || z[2] || upper(z[3]) || ' each'), ';') END AS alternatives,
       CASE WHEN c % 11 = 0 THEN round_even(greatest(0.0::DOUBLE, vms * gb - (20.0::DOUBLE - CASE WHEN c % 8 = 2 THEN 1.0 ELSE 0.0 END)), 2) END AS shortfall_gb,
       round_even(20.0::DOUBLE - CASE WHEN c % 8 = 2 THEN 1.0 ELSE 0.0 END, 2) AS avail_before,
       CASE WHEN c % 8 = 2 THEN '1' ELSE '0' END || '_vms_running' AS state_before,
       CASE WHEN letter = 'U' THEN c % 8 = 2 END AS uuid_unchanged,
       CASE WHEN letter = 'U' THEN CASE WHEN c % 8 = 2 THEN 1 ELSE 0 END END AS cpu_before,
       'screenshots/' || replace(lower(letter || '1.' || CAST(t % 3 + 1 AS VARCHAR)), '.', '_') || '_m0_apply.png' AS apply_screenshot,
       'Task ' || letter || '1.' || CAST(t % 3 + 1 AS VARCHAR) || ' executed by m0. Iterations: ' || CAST(iterations AS VARCHAR) || '.' AS evaluator_notes,
       strftime(make_timestamp((1700000000 + c * 60 + t) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
       strftime(make_timestamp((1700000000 + c * 60 + t) * 1000000), '%Y-%m-%dT%H:%M:%S.000000+00:00') AS timestamp_utc,
       left(sha256(CASE WHEN c % 2 = 0 THEN '{{"model":{{"a":' || CAST(c % 4 AS VARCHAR) || ',"b":[2,"x"]}},"z":1}}'
         ELSE '{{"enhance_strat":"' || CASE WHEN c % 3 = 0 THEN 'COT' ELSE '' END || '","model":"m0","model_version":"unknown"}}' END), 16) AS config_hash,
       CASE WHEN t % 2 = 0 THEN 'http://host/v1' ELSE 'unknown' END AS base_url,
       CAST(c % 7 * 0.5 AS DOUBLE) AS plan_seconds, 1::INTEGER AS vms_found,
       CASE WHEN spec_passed IS NULL THEN 'skipped' ELSE 'executed' END AS spec_status,
       CASE WHEN post_passed IS NULL THEN 'not_applicable' ELSE 'executed' END AS post_status,
       CASE WHEN c % 11 = 0 THEN CASE WHEN matched THEN 'excellent' ELSE 'poor' END END AS rating,
       CASE WHEN contains(lower(code), 'ubuntu') THEN 'Ubuntu 22.04' ELSE 'unknown' END AS os_version
FROM r5"""

ORACLE["stream_pass_at_k"] = ORACLE["pass_at_k_by_task"]

# whatever was delivered before, the newest version of each entry counts
ORACLE["stream_pass_at_k_replaced"] = ORACLE["pass_at_k_by_task"]

ORACLE["entries_roundtrip_pass_at_k"] = f"""
WITH {V_FENCED},
r0 AS (SELECT f.conv_id AS c, f.turn AS t FROM fenced f),
samples AS (
  SELECT substr('CRUD', CAST(c % 4 + 1 AS INTEGER), 1) || '1.' || CAST(t % 3 + 1 AS VARCHAR) AS task_id,
         (c + t) % 5 <> 0 AS plan_ok,
         t % 4 <> 3 AND (c + t) % 5 <> 0 AND t % 2 = 0 AS apply_ok,
         CASE WHEN t % 3 = 0 THEN NULL ELSE c % 2 = 0 END AS spec_ok
  FROM r0),
{_counts_cte('task_id')}
SELECT task_id, n, c_plan, c_apply, c_spec, {_passk_cols()} FROM counts"""

ORACLE["infra_context"] = """
WITH c AS (SELECT c_custkey, c_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT c_custkey AS state_id, 'data_resources' AS kind, 'xenorchestra_pool' AS type, 0 AS resource_pos,
             CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 3 END AS n_fields,
             CASE WHEN c_custkey % 2 = 0 THEN 'cpus,id,master,name_label' ELSE 'cpus,id,name_label' END AS field_keys,
             '"' || n.n_name || '"' AS name_label_json
      FROM customer cu JOIN nation n ON cu.c_nationkey = n.n_nationkey JOIN c USING (c_custkey)),
v AS (SELECT c_custkey AS state_id, 'managed_vms' AS kind, 'xenorchestra_vm' AS type, 2 AS resource_pos,
             CASE WHEN c_acctbal > 0 THEN 6 ELSE 5 END AS n_fields,
             CASE WHEN c_acctbal > 0 THEN 'cpus,id,memory_max,name_label,power_state,tags'
                  ELSE 'cpus,id,name_label,power_state,tags' END AS field_keys,
             '"' || c_name || '"' AS name_label_json
      FROM c)
SELECT state_id, kind, type, CAST(resource_pos AS INTEGER) AS resource_pos, CAST(n_fields AS INTEGER) AS n_fields,
       field_keys, name_label_json FROM d
UNION ALL
SELECT state_id, kind, type, CAST(resource_pos AS INTEGER), CAST(n_fields AS INTEGER), field_keys, name_label_json FROM v"""

ORACLE["reference_precedence"] = f"""
WITH {V_BENCH}, {V_HCL},
t AS (SELECT item_id, task_id, category,
             CASE WHEN item_id % 2 = 0 THEN prompt WHEN item_id % 3 = 1 THEN 'nan' ELSE '' END AS csv FROM bt2),
f AS (SELECT t.item_id, frag.hcl FROM t JOIN frag ON frag.frag_pos = t.item_id WHERE t.item_id % 4 <> 3),
j AS (SELECT t.*, f.hcl FROM t LEFT JOIN f USING (item_id)),
r AS (SELECT item_id, task_id, category,
             coalesce(hcl, csv, '') AS m0,
             coalesce(nullif(csv, ''), hcl) AS sc,
             coalesce(hcl, csv, '') AS synced
      FROM j)
SELECT item_id,
       md5(CASE WHEN lower(m0) = 'nan' THEN '' ELSE m0 END) AS metrics_ref_md5,
       md5(CASE WHEN lower(coalesce(sc, '')) = 'nan' THEN '' ELSE coalesce(sc, '') END) AS scoring_ref_md5,
       sc IS NULL AS unscored,
       md5(synced) AS synced_md5,
       array_to_string(list_filter([
         CASE WHEN NOT coalesce(regexp_matches(task_id, '^[CRUD]\\d\\.\\d$'), FALSE) THEN 'task_id_format' END,
         CASE WHEN {_strip('synced')} = '' THEN 'reference_blank' END,
         CASE WHEN NOT coalesce(upper(category) IN ('CREATE', 'READ', 'UPDATE', 'DELETE'), FALSE) THEN 'category_invalid' END],
         lambda q: q IS NOT NULL), ',') AS violations
FROM r"""

ORACLE["judge_report_with_code"] = f"""
WITH {V_JUDGED},
dr AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '```hcl' || chr(10) || text || chr(10) || '```' ELSE text END AS response
       FROM documents),
j AS (SELECT judged.*, {_extract_code('dr.response')} AS code FROM judged JOIN dr USING (doc_id)),
v AS (SELECT *, CASE WHEN {_strip("coalesce(code, '')")} = '' THEN 'Skip' ELSE {_verdict('judge_text')} END AS verdict FROM j)
SELECT doc_id, task_id, verdict,
       CASE WHEN verdict IN ('Correct', 'Incorrect') AND spec_passed IS NOT NULL THEN (verdict = 'Correct') = spec_passed END AS agree,
       CAST(length(code) AS INTEGER) AS code_chars
FROM v"""

ORACLE["bleu_by_conversation"] = f"""
WITH {V_PAIRS}, {V_BLEU}
SELECT conv_id, count(*) AS n_pairs, {_r('avg(bleu)')} AS avg_bleu, {_r('max(bleu)')} AS max_bleu FROM bl GROUP BY conv_id"""

ORACLE["evaluated_entries"] = f"""
WITH {V_PLAN_ROWS}, {V_PLANS}, {V_SPECS}, {V_RULES}, {V_FENCED},
res AS (SELECT conv_id AS c, turn AS t, CAST(conv_id * 8 + turn AS BIGINT) AS plan_id FROM fenced),
j AS (SELECT res.*, r.errors AS spec_errors FROM res LEFT JOIN r USING (plan_id)),
k AS (SELECT *, CASE WHEN spec_errors IS NULL THEN NULL ELSE len(spec_errors) = 0 END AS spec_passed,
             (c + t) % 5 <> 0 AS plan_success,
             CASE WHEN t % 4 = 3 THEN 'skipped_plan_only' WHEN (c + t) % 5 <> 0 AND t % 2 = 0 THEN 'success' ELSE 'failed' END AS apply_status,
             c % 11 = 0 AS matched,
             CASE WHEN substr('CRUD', CAST(c % 4 + 1 AS INTEGER), 1) IN ('U', 'D') THEN c % 3 <> 0 END AS post_passed,
             substr('CRUD', CAST(c % 4 + 1 AS INTEGER), 1) || '1.' || CAST(t % 3 + 1 AS VARCHAR) AS task_id
      FROM j),
ev AS (SELECT *, matched OR (CASE WHEN apply_status = 'skipped_plan_only' THEN plan_success ELSE apply_status = 'success' END) AS execution
      FROM k)
SELECT plan_id,
       replace(lower(task_id), '.', '_') || '_m0_pass' || CAST(t + 1 AS VARCHAR) || CASE WHEN c % 3 = 0 THEN '_COT' ELSE '' END AS entry_id,
       spec_passed, CAST(len(spec_errors) AS INTEGER) AS n_spec_errors,
       CAST(coalesce(len(spec_errors), 0) AS INTEGER) AS n_entry_errors, CASE WHEN spec_errors IS NULL THEN 'skipped' ELSE 'executed' END AS spec_status,
       matched OR (execution AND coalesce(spec_passed = TRUE, FALSE) AND coalesce(post_passed, TRUE)) AS meets_requirements,
       coalesce(spec_passed, TRUE) AS resource_allocation_correct
FROM ev"""

ORACLE["state_key_search"] = """
SELECT c_custkey AS state_id, CAST(6 + c_custkey % 4 * 4 AS INTEGER) AS depth, '{"cores":"' || CAST(c_nationkey % 8 + 1 AS VARCHAR) || '"}' AS value FROM customer
UNION ALL
SELECT c_custkey AS state_id, CAST(6 + c_custkey % 4 * 4 AS INTEGER) AS depth, CAST(c_custkey % 8 + 1 AS VARCHAR) AS value FROM customer"""

ORACLE["repair_prompts"] = f"""
WITH {V_ATTEMPTS},
e AS (SELECT run_id, iteration,
             CASE WHEN stage = 'spec_failed' THEN 'SPEC ACCURACY ERRORS: iteration ' ELSE 'Error: plan failed at iteration ' END
               || CAST(iteration AS VARCHAR) AS error,
             row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC) AS rk
      FROM att WHERE is_error),
t AS (SELECT run_id, list(error ORDER BY rk DESC) AS errs FROM e WHERE rk <= 2 GROUP BY run_id),
p AS (SELECT run_id, errs, 'Provision the VMs for user ' || CAST(run_id AS VARCHAR) AS prompt,
             'resource "xenorchestra_vm" "u' || CAST(run_id AS VARCHAR) || '" {{}}' AS code,
             errs[-1] AS newest FROM t)
SELECT run_id, CAST(len(errs) AS INTEGER) AS n_errors,
       md5('Here is the actual prompt:' || chr(10) || prompt || chr(10) || chr(10)
           || 'Give me the full complete code, without these below errors:' || chr(10) || chr(10)
           || array_to_string(list_transform(errs, lambda x, i: chr(10) || 'Error ' || CAST(i AS VARCHAR) || ':' || chr(10) || x || chr(10)), '')
           || chr(10)) AS multi_error_md5,
       md5('TASK:' || chr(10) || 'Refine the ground-truth Terraform HCL to resolve the documented errors.' || chr(10) || chr(10)
           || 'ORIGINAL REQUIREMENT:' || chr(10) || prompt || chr(10) || chr(10) || 'ERROR HISTORY:' || chr(10)
           || array_to_string(list_transform(errs, lambda x, i: 'ERROR ' || CAST(i AS VARCHAR) || ':' || chr(10) || x || chr(10) || chr(10)), '')
           || chr(10) || chr(10) || 'INSTRUCTION:' || chr(10)
           || 'The generation MUST NOT contain the errors listed above. Provide a single, complete, and definitive ground-truth HCL block using standard Markdown (```hcl).'
           || chr(10) || chr(10) || 'Follow the structural rules defined in the system prompt.' || chr(10)) AS dataset_repair_md5,
       md5(CASE WHEN contains(newest, 'SPEC ACCURACY ERRORS')
                THEN 'Here is the actual prompt:' || chr(10) || prompt || chr(10) || chr(10) || 'Here is the incorrect configuration:' || chr(10)
                     || code || chr(10) || chr(10) || 'Give me the full complete code, without these below errors:' || chr(10) || chr(10) || newest
                ELSE 'Here is the actual prompt:' || chr(10) || prompt || chr(10) || chr(10) || 'Here is the incorrect configuration:' || chr(10)
                     || code || chr(10) || chr(10) || 'Here is the Terraform plan error message (potentially empty):' || chr(10) || newest
                     || chr(10) || chr(10) || 'Give me the full complete code, without these below errors:' END) AS repair_md5,
       md5('Task Description:' || chr(10) || prompt || chr(10) || chr(10) || 'Task Category: CREATE' || chr(10) || chr(10)
           || 'Generated Terraform Code:' || chr(10) || '```hcl' || chr(10) || code || chr(10) || '```' || chr(10) || chr(10)
           || 'Does this generated code correctly fulfill the task? Evaluate it carefully, then end with your rating.') AS judge_user_md5
FROM p"""

ORACLE["execution_units"] = """
WITH t AS (SELECT user_id AS run_id, ['c1.1', 'c1.2', 'c2.2', 'c5.2', 'c1.3', 'u1.2', 'd1.2', 'c2.3', 'r1.2', 'd2.2'][CAST(event_id % 10 + 1 AS INTEGER)] AS task_id,
                  min(event_id) AS pos
           FROM events GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN task_id IN ('c1.3', 'u1.2', 'd1.2') THEN 'c1.3' WHEN task_id IN ('c2.3', 'r1.2', 'd2.2') THEN 'c2.3' ELSE task_id END AS unit FROM t)
SELECT run_id, unit, min(pos) AS start, string_agg(task_id, ',' ORDER BY pos) AS members FROM u GROUP BY run_id, unit"""

ORACLE["requested_tasks"] = f"""
WITH {V_BENCH},
req(task_id, rank) AS (VALUES ('c1.1', 1), ('c1.2', 2), ('c2.2', 3), ('c5.2', 4), ('c1.3', 5), ('u1.2', 6),
                              ('d1.2', 7), ('c2.3', 8), ('r1.2', 9), ('d2.2', 10)),
avail AS (SELECT lower(trim(task_id)) AS task_id, max(item_id) AS item_id FROM bt2 GROUP BY 1)
SELECT req.task_id, CAST(req.rank AS INTEGER) AS rank, avail.item_id,
       CASE WHEN avail.task_id IS NULL THEN 'missing' ELSE 'present' END AS status
FROM req LEFT JOIN avail USING (task_id)"""

ORACLE["snapshot_names"] = """
WITH d AS (SELECT doc_id, text AS content,
                  regexp_replace(regexp_replace(regexp_replace(' run/' || source || ' :: ' || lang || '!',
                      '[^A-Za-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS label,
                  sha256(text) AS digest
           FROM documents WHERE coalesce(length(text), 0) > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY digest, CAST(doc_id AS VARCHAR)) AS n FROM d)
SELECT doc_id, label,
       'terraform_tfstate_pre_destroy_' || label || CASE WHEN n > 1 THEN '_' || digest || '_' || CAST(doc_id AS VARCHAR) ELSE '' END || '.json'
         AS snapshot_name
FROM f"""

ORACLE["distribution_document"] = f"""
WITH {V_HCL}, s AS ({_scored('hcl', 'doc')}),
per_type AS (SELECT resource_type, count(DISTINCT doc) AS n_tasks
             FROM (SELECT doc, unnest(resource_types) AS resource_type FROM s) GROUP BY resource_type)
SELECT (SELECT count(*) FROM s) AS total_tasks_scored, CAST(count(*) AS INTEGER) AS n_types,
       string_agg(resource_type || '=' || CAST(n_tasks AS VARCHAR), ',' ORDER BY resource_type) AS resource_type_counts
FROM per_type"""

ORACLE["verdict_writeback"] = f"""
WITH {V_JUDGED}, {V_VERDICTS}
SELECT doc_id AS entry_id,
       CASE WHEN doc_id % 2 = 0 THEN verdict WHEN doc_id % 3 = 0 THEN 'Correct' END AS verdict,
       CASE WHEN doc_id % 2 = 0 THEN 'judge-1' WHEN doc_id % 3 = 0 THEN 'judge-0' END AS judge_model
FROM jv"""

ORACLE["artifacts_roundtrip"] = f"""
WITH {V_ATTEMPTS}
SELECT CAST(run_id AS VARCHAR) AS task_id, stage AS kind, count(*) AS n, max(iteration) AS last_iteration,
       'iteration ' || CAST(max(iteration) AS VARCHAR) AS last_content, count(*) AS n_content
FROM att GROUP BY 1, 2"""

ORACLE["artifacts_lookup"] = f"""
WITH {V_ATTEMPTS}, latest AS (SELECT run_id, max(iteration) AS iteration FROM att GROUP BY run_id)
SELECT CAST(att.run_id AS VARCHAR) AS task_id, 1 AS sample, CAST(att.iteration AS INTEGER) AS iteration, stage AS kind, count(*) AS n,
       'iteration ' || CAST(att.iteration AS VARCHAR) AS content
FROM att JOIN latest ON att.run_id = latest.run_id AND att.iteration = latest.iteration
GROUP BY att.run_id, att.iteration, stage"""

ORACLE["plans_roundtrip_spec_check"] = ORACLE["spec_check"]

ORACLE["tasks_csv_roundtrip"] = f"""
WITH {V_BENCH}, {V_HCL}
SELECT 'T' || CAST(bt2.item_id AS VARCHAR) AS task_id, category, md5(prompt) AS prompt_md5,
       md5(frag.hcl) AS reference_md5, CAST(length(prompt) AS INTEGER) AS prompt_chars
FROM bt2 LEFT JOIN frag ON frag.frag_pos = bt2.item_id
WHERE bt2.item_id % 10 <> 9"""

ORACLE["tasks_csv_overflow"] = rf"""
WITH {V_BENCH}
SELECT 'T' || CAST(item_id AS VARCHAR) AS task_id, category, md5(regexp_replace(prompt, '[\r\n]+', ' ', 'g')) AS prompt_md5,
       CASE WHEN item_id % 3 = 0 THEN CAST(item_id % 6 + 1 AS VARCHAR) ELSE '2' END AS complexity_level
FROM bt2"""

ORACLE["complexity_report"] = f"""
WITH {V_BENCH}, {V_HCL},
t AS (SELECT bt2.item_id, coalesce(CASE WHEN item_id % 2 = 0 THEN nullif(prompt, '') WHEN item_id % 3 = 1 THEN 'nan' END,
                                   CASE WHEN item_id % 4 <> 3 THEN frag.hcl END) AS hcl
      FROM bt2 LEFT JOIN frag ON frag.frag_pos = bt2.item_id),
texts AS (SELECT * FROM t WHERE trim(coalesce(hcl, '')) <> ''),
s AS ({_scored('texts', 'item_id')}),
d AS (SELECT resource_type, count(DISTINCT item_id) AS n_tasks FROM (SELECT item_id, unnest(resource_types) AS resource_type FROM s) GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY n_tasks DESC, resource_type) AS INTEGER) AS rank, resource_type, n_tasks, repeat('█', CAST(n_tasks AS INTEGER)) AS bar FROM d"""

ORACLE["conversations_roundtrip"] = """
SELECT CAST(conv_id AS VARCHAR) AS conv_id,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS BIGINT) AS turn,
       role, md5(text) AS content_md5
FROM conversations"""

ORACLE["states_roundtrip_context"] = ORACLE["infra_context"]


# ------------------------------------------------------------------ plan samples on hosts
_ASKED = "[['create'], ['no-op'], ['update'], ['delete'], ['create']][CAST(t % 5 + 1 AS INTEGER)]"
V_SAMPLE_PLANS = f"""o AS (SELECT o_orderkey AS k, o_orderkey % 200 AS t, (o_orderkey // 200) % 2 = 0 AS good FROM orders),
line AS (
  SELECT k, t, good, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos,
         CASE WHEN l_linenumber = 5 THEN 'xenorchestra_network' ELSE 'xenorchestra_vm' END AS type,
         CASE WHEN good THEN {_ASKED} WHEN l_returnflag = 'A' THEN ['delete'] WHEN l_returnflag = 'N' THEN ['create']
              WHEN l_linestatus = 'F' THEN ['delete', 'create'] ELSE ['update'] END AS actions,
         CASE WHEN l_linenumber <> 7 THEN 'vm-' || CAST(l_suppkey AS VARCHAR) END AS name_label,
         CASE WHEN good THEN 268435456 ELSE CAST(l_quantity AS BIGINT) * 67108864 END AS memory_max,
         CASE WHEN good THEN t % 4 + 1 ELSE CAST(l_quantity AS BIGINT) END AS cpus,
         CASE WHEN good THEN 1073741824 ELSE l_partkey * 16777216 END AS disk
  FROM lineitem JOIN o ON o.k = l_orderkey),
acted AS (SELECT *, {ACTION_SQL} AS action FROM line),
docs AS (
  SELECT k, list({{'pos': CAST(pos AS BIGINT), 'type': type, 'action': action, 'address': type || '.r_' || CAST(pos AS VARCHAR),
                   'name_label': name_label, 'memory_max': CASE WHEN action <> 'delete' THEN CAST(memory_max AS BIGINT) END,
                   'cpus': CASE WHEN action <> 'delete' THEN CAST(cpus AS BIGINT) END,
                   'disk_sizes': CASE WHEN action <> 'delete' THEN [CAST(disk AS BIGINT)] ELSE []::BIGINT[] END}} ORDER BY pos) AS rc
  FROM acted GROUP BY k),
typed AS (SELECT rc[1:0] AS none FROM docs LIMIT 1),
plans AS (
  SELECT CAST(o.k AS VARCHAR) AS plan_id, 'T' || CAST(t AS VARCHAR) AS task, coalesce(rc, (SELECT none FROM typed)) AS rc,
         CASE WHEN o.k % 3 = 0 THEN [
           {{'pos': CAST(-3 AS BIGINT), 'type': '', 'action': 'existing', 'address': '', 'name_label': 'vm-host', 'memory_max': CAST(1073741824 AS BIGINT),
             'cpus': CAST(2 AS BIGINT), 'disk_sizes': [CAST(1073741824 AS BIGINT)]}},
           {{'pos': CAST(-2 AS BIGINT), 'type': '', 'action': 'existing', 'address': '', 'name_label': 'vm-' || CAST(o.k % 100 AS VARCHAR),
             'memory_max': CAST(o.k % 25 * 1073741824 AS BIGINT), 'cpus': CAST(o.k % 33 AS BIGINT), 'disk_sizes': [CAST(8589934592 AS BIGINT)]}}]
         ELSE (SELECT none FROM typed) END AS pre
  FROM o LEFT JOIN docs ON docs.k = o.k WHERE o.k % 97 <> 0),
specs AS (
  SELECT 'T' || CAST(t AS VARCHAR) AS spec_task, cat AS category,
         CASE WHEN cat = 'CREATE' AND t % 2 = 0 THEN t % 4 + 1 END AS vm_count,
         CASE WHEN cat = 'CREATE' AND t % 2 = 1 THEN 1 END AS min_vm_count,
         CASE WHEN cat = 'CREATE' AND t % 2 = 1 THEN 7 END AS max_vm_count,
         CASE WHEN cat = 'CREATE' THEN CASE WHEN t % 4 = 0 THEN 8.0::DOUBLE ELSE 4.5::DOUBLE END END AS max_total_ram_gb,
         CASE WHEN cat = 'CREATE' THEN CASE WHEN t % 4 = 0 THEN '8' ELSE '4.5' END END AS ram_text,
         CAST(NULL AS BIGINT) AS max_total_cpus,
         CASE WHEN cat = 'CREATE' AND t % 3 = 0 THEN 268435456 END AS per_vm_memory_max,
         CASE WHEN cat = 'CREATE' AND t % 3 = 1 THEN t % 4 + 1 END AS per_vm_cpus,
         CASE WHEN cat = 'CREATE' AND t % 3 = 2 THEN 1073741824 END AS per_vm_disk_size,
         CAST(NULL AS VARCHAR[]) AS vm_names,
         CASE WHEN cat = 'UPDATE' THEN 'cpus' END AS updated_field, CASE WHEN cat = 'UPDATE' THEN t % 4 + 1 END AS new_value,
         CASE WHEN cat = 'UPDATE' AND t % 4 = 2 THEN 'vm-' || CAST(t % 100 AS VARCHAR) END AS target_vm,
         CAST(NULL AS VARCHAR[]) AS target_vms, CASE WHEN cat = 'DELETE' AND t % 2 = 1 THEN 3 END AS delete_count
  FROM (SELECT DISTINCT t, ['CREATE', 'READ', 'UPDATE', 'DELETE', 'MIGRATE'][CAST(t % 5 + 1 AS INTEGER)] AS cat FROM o WHERE t % 13 <> 12))"""

V_SAMPLE_RULES = (
    V_RULES.replace("s.*, s.plan_id IS NOT NULL AS has_spec", "p.pre, p.task, s.*, s.spec_task IS NOT NULL AS has_spec")
    .replace("ON p.plan_id = s.plan_id", "ON p.task = s.spec_task")
    .replace("list_filter(vms, lambda v: coalesce(v.name_label, '') <> '' AND v.action IN ('create', 'update', 'replace', 'delete')) AS q_ev",
             "list_filter(list_concat(pre, CASE WHEN category = 'READ' THEN rc[1:0] ELSE vms END), lambda v: coalesce(v.name_label, '') <> '' "
             "AND v.action IN ('existing', 'create', 'update', 'replace', 'delete')) AS q_ev")
    .replace("CASE WHEN category = 'READ' THEN 0 ELSE", "CASE WHEN FALSE THEN 0 ELSE")
    .replace(_s("max_total_ram_gb"), "ram_text")
    .replace("r AS (SELECT plan_id, category,", "r AS (SELECT plan_id, task, category,")
    .replace(_s("plan_id"), "task")
)

ORACLE["plan_samples_spec_check"] = f"""
WITH {V_SAMPLE_PLANS}, {V_SAMPLE_RULES}
SELECT plan_id, task AS task_id, category, 'executed' AS status, len(errors) = 0 AS passed, CAST(len(errors) AS INTEGER) AS n_errors,
       array_to_string(errors, ' | ') AS errors,
       array_to_string(list_transform(checks, lambda c: c.check || '=' || coalesce(CAST(c.passed AS VARCHAR), 'null')), ',') AS checks,
       had_replace_actions
FROM r
UNION ALL
SELECT NULL, NULL, NULL, 'skipped', NULL, 1, 'plan document can''t be parsed as JSON', '', NULL FROM o WHERE k % 97 = 0"""

ORACLE["entries_merge"] = f"""
WITH e AS (SELECT entry_id FROM ({ORACLE["entry_outcomes"]}))
SELECT entry_id, CAST(regexp_extract(entry_id, '_pass(\\d+)', 1) AS BIGINT) AS sample_num,
       regexp_extract(entry_id, '_pass(\\d+)', 1) = '1' AS rerun
FROM e"""

ORACLE["text_predicates"] = """
WITH d AS (SELECT doc_id, doc_id % 2 AS exit_code,
                  text || CASE WHEN doc_id % 5 = 0 THEN ' Error: Out of MEMORY on host' WHEN doc_id % 5 = 1 THEN ' not enough memory' ELSE '' END AS stderr,
                  text, upper(lang) || ' - ' || source AS description,
                  CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN CAST(-doc_id AS VARCHAR) WHEN 2 THEN 'x' || CAST(doc_id AS VARCHAR) END AS setting
           FROM documents)
SELECT doc_id,
       exit_code <> 0 AND regexp_matches(lower(stderr), 'insufficient memory|out of memory|not enough memory') AS exhausted,
       octet_length(encode(coalesce(text, ''))) >= 11 AS has_content, octet_length(encode(coalesce(text, ''))) >= 51 AS has_context,
       split_part(description, ' - ', 1) AS category,
       CASE WHEN try_cast(setting AS INTEGER) > 0 THEN try_cast(setting AS INTEGER) ELSE 4 END AS workers
FROM d"""

ORACLE["run_predicates"] = """
SELECT event_id,
       coalesce(CASE WHEN user_id % 3 <> 0 THEN event_type = 'click' END, CASE WHEN event_type <> 'view' THEN event_type = 'purchase' END, FALSE) AS judge_apply_ok,
       user_id % 3 > 0 AND event_id % 2 = 0 AND lower(['U1.2', 'D1.2', 'C1.1', 'D2.2'][CAST(event_id % 4 + 1 AS INTEGER)]) IN ('u1.2', 'd1.2', 'd2.2')
         AND event_type <> 'signup' AS needs_context
FROM events"""

ORACLE["redacted_messages"] = f"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN chr(10) || 'api_key = s3cret, Password: "a b"' ELSE '' END AS content
           FROM conversations)
SELECT conv_id, turn, role, md5(regexp_replace(content, {_sql_str(REDACT)}, '\\1\\2"[REDACTED]"', 'g')) AS redacted_md5, md5(content) AS kept_md5
FROM m"""

ORACLE["system_prompts"] = f"""
WITH {V_BENCH},
p AS (SELECT item_id, pass_no, strategy, CASE WHEN item_id % 2 = 0 THEN 'model prompt ' || folder END AS model_prompt,
             CASE WHEN item_id % 3 = 0 THEN 'baseline' || CASE WHEN item_id % 4 = 0 THEN ' on host ' || CAST(item_id AS VARCHAR) ELSE '' END END AS baseline,
             'on host ' || CAST(item_id AS VARCHAR) AS context
      FROM m),
b AS (SELECT *, CASE WHEN strategy = 'dataset' THEN 'dataset prompt' ELSE coalesce(model_prompt, baseline, 'generic') END AS base FROM p)
SELECT item_id, pass_no, strategy, CASE WHEN contains(base, context) THEN base ELSE base || chr(10) || chr(10) || context END AS system_prompt
FROM b"""

ORACLE["task_filter"] = f"""
WITH {V_BENCH}
SELECT item_id, task_id, category FROM bt2 WHERE lower(task_id) = 'c1.1'"""

ORACLE["registered_rule"] = f"""
WITH {V_SAMPLE_PLANS}
SELECT p.plan_id, s.category, s.category = 'MIGRATE' AND len(list_filter(rc, lambda v: v.action = 'delete')) = 0 AS passed,
       CASE WHEN len(list_filter(rc, lambda v: v.action = 'delete')) > 0
            THEN 'MIGRATE task must not delete (' || CAST(len(list_filter(rc, lambda v: v.action = 'delete')) AS VARCHAR) || ').' END AS error
FROM plans p JOIN specs s ON p.task = s.spec_task WHERE s.category = 'MIGRATE'"""

ORACLE["metrics_report"] = f"""
WITH s AS (SELECT conv_id, turn, conv_id % 7 AS task, coalesce(text, '') AS code FROM conversations),
refs AS (SELECT task, arg_min(code, {{'c': conv_id, 't': turn}}) AS reference FROM s WHERE task <> 6 GROUP BY task),
pairs AS (SELECT s.conv_id, s.turn, refs.reference, s.code AS candidate FROM s LEFT JOIN refs USING (task)),
{V_BLEU},
e AS (SELECT vec_id // 4 AS g, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cs AS (SELECT c.g AS cg, r.g AS rg, c.vec_id AS ci, r.vec_id AS ri, list_cosine_similarity(c.v, r.v) AS sim FROM e c JOIN e r ON r.g = c.g % 7),
pp AS (SELECT cg, rg, avg(best) AS p FROM (SELECT cg, rg, ci, max(sim) AS best FROM cs GROUP BY 1, 2, 3) GROUP BY 1, 2),
rr AS (SELECT cg, rg, avg(best) AS r FROM (SELECT cg, rg, ri, max(sim) AS best FROM cs GROUP BY 1, 2, 3) GROUP BY 1, 2),
f AS (SELECT cg, rg, round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1 FROM pp JOIN rr USING (cg, rg))
SELECT 'T' || CAST(s.task AS VARCHAR) AS task_id, count(*) AS n, {_r('avg(CASE WHEN s.turn % 2 = 0 THEN 1.0 ELSE 0.0 END)')} AS plan_pct,
       {_r('avg(CASE WHEN s.conv_id % 3 <> 0 AND s.turn % 3 = 0 THEN 1.0 ELSE 0.0 END)')} AS spec_pct,
       {_r('avg(s.turn % 3 + 1)')} AS avg_iterations, {_r('avg(bl.bleu)')} AS avg_bleu, {_r('avg(f.f1)')} AS avg_f1
FROM s JOIN bl ON bl.conv_id = s.conv_id AND bl.turn = s.turn LEFT JOIN f ON f.cg = s.conv_id AND f.rg = s.task
GROUP BY s.task"""

ORACLE["ground_truth_report"] = f"""
WITH {V_FENCED},
r0 AS (SELECT f.conv_id AS c, f.turn AS t, f.response, c % 4 + 1 AS gb FROM fenced f),
e AS (SELECT c, t, substr('CRUD', CAST(c % 4 + 1 AS INTEGER), 1) || '1.' || CAST(t % 3 + 1 AS VARCHAR) AS task_id,
             (c + t) % 5 <> 0 AS plan_ok, t % 4 <> 3 AND (c + t) % 5 <> 0 AND t % 2 = 0 AS apply_ok,
             CASE WHEN t % 3 = 0 THEN NULL ELSE c % 2 = 0 END AS spec_ok,
             coalesce(CASE WHEN t % 3 <> 0 THEN 'resource "xenorchestra_vm" "vm" {{' || chr(10) || '  cpus = ' || CAST(c % 4 + 1 AS VARCHAR)
                   || chr(10) || '  memory_max = ' || CAST(gb AS VARCHAR) || ' * 1024 * 1024 * 1024' || chr(10) || '  network {{' || chr(10)
                   || '    network_id = data.xenorchestra_network.net.id' || chr(10) || '  }}' || chr(10) || '}}'
                   ELSE {_extract_code('response')} END, '') AS code
      FROM r0),
gt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY c, t) AS n FROM e WHERE c % 3 = 0) WHERE n = 1),
j AS (SELECT e.c AS conv_id, e.t AS turn, e.plan_ok = gt.plan_ok AS plan_match, e.apply_ok = gt.apply_ok AS apply_match,
             e.spec_ok IS NOT DISTINCT FROM gt.spec_ok AS spec_match, gt.code AS reference, e.code AS candidate
      FROM e JOIN gt USING (task_id) WHERE e.c % 3 <> 0),
pairs AS (SELECT conv_id, turn, reference, candidate FROM j WHERE reference <> '' AND candidate <> ''),
{V_BLEU}
SELECT count(*) AS total, count(*) FILTER (WHERE plan_match) AS plan_matches, count(*) FILTER (WHERE apply_match) AS apply_matches,
       count(*) FILTER (WHERE spec_match) AS spec_matches, {_r('coalesce(avg(bleu), 0.0)')} AS avg_bleu,
       {_r('100.0 * count(*) FILTER (WHERE plan_match) / count(*)')} AS plan_pct,
       {_r('100.0 * count(*) FILTER (WHERE apply_match) / count(*)')} AS apply_pct,
       {_r('100.0 * count(*) FILTER (WHERE spec_match) / count(*)')} AS spec_pct
FROM j LEFT JOIN bl USING (conv_id, turn)"""

ORACLE["reference_sync"] = f"""
WITH {V_BENCH},
d AS (SELECT doc_id % 30 AS k, arg_min(text, doc_id) AS hcl FROM documents GROUP BY 1),
files AS (SELECT substr('CRUDM', CAST(k % 5 + 1 AS INTEGER), 1) || CAST(k % 5 + 1 AS VARCHAR) || '.' || CAST(k % 3 + 1 AS VARCHAR) AS task_id, hcl FROM d WHERE k < 15),
j AS (SELECT item_id, bt2.task_id, category, coalesce(files.hcl, CASE WHEN item_id % 2 = 0 THEN prompt END, '') AS reference FROM bt2 LEFT JOIN files USING (task_id))
SELECT item_id, task_id, md5(reference) AS reference_md5,
       array_to_string(list_filter([CASE WHEN NOT regexp_matches(task_id, '^[CRUD]\\d\\.\\d$') THEN 'task_id_format' END,
                                    CASE WHEN trim(reference) = '' THEN 'reference_blank' END,
                                    CASE WHEN category NOT IN ('CREATE', 'READ', 'UPDATE', 'DELETE') THEN 'category_invalid' END], lambda q: q IS NOT NULL), ',') AS violations
FROM j"""

ORACLE["run_matrix_models"] = f"""
WITH {V_BENCH}
SELECT item_id, pass_no, strategy, short AS model_short,
       replace(lower(task_id), '.', '_') || '_' || short || '_pass' || CAST(pass_no AS VARCHAR) || CASE WHEN strategy <> '' THEN '_' || strategy ELSE '' END AS entry_id,
       mf || CASE WHEN strategy NOT IN ('', 'baseline') THEN '_' || strategy ELSE '' END AS folder
FROM m, (VALUES ('model_a', 'a'), ('model_b', 'b'), ('model_c', 'c')) v(mf, short)"""
