"""DuckDB twins of the case queries, written independently of the Spark code over the same adapter views."""

from __future__ import annotations

from zlib import crc32

from mailspark.plans import expected as E

_TECHNIQUE_ROWS = [(signal, t) for signal, techniques in E.SIGNAL_TECHNIQUES.items() for t in techniques]
_TECH = "(VALUES " + ", ".join(f"({i}, '{a}', '{t}', '{E.TECHNIQUE_NAMES[t][1]}', {E.TACTICS.index(E.TECHNIQUE_NAMES[t][1])})" for i, (a, t) in enumerate(_TECHNIQUE_ROWS)) + ") AS tt(ord, id, technique, tactic, tactic_ord)"
_SAYS = lambda x, words: "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"
_HAS_ID = lambda *names: "list_has_any(ids, [" + ", ".join(f"'{n}'" for n in names) + "])"
_ANON = ("tor", "vpn", "proxy", "open relay", "open-relay", "anonymis", "anonymiz", "bulletproof")
_SOC = _HAS_ID("nlp.payment_diversion", "nlp.bec_no_payload", "nlp.credential_lure", "nlp.authority_pressure", "nlp.secrecy")
_POINTS = {
    "compromised-account": [(300, f"aligned AND dmarc_pass AND {_SOC}"), (60, f"aligned AND dmarc_pass AND NOT {_SOC}"), (100, "aligned AND dmarc_pass AND domain_age > 365"), (80, f"aligned AND {_HAS_ID('hdr.mass_recipients')}")],
    "spoofed-domain": [(100, f"{_HAS_ID('id.brand_impersonation')} AND coalesce(domain_age, 0) = 0"), (80, _HAS_ID("auth.no_auth"))] + [(120, _HAS_ID(n)) for n in ("auth.spf_fail", "auth.dkim_fail", "auth.dmarc_fail", "auth.spf_unaligned", "id.returnpath_mismatch")],
    "anonymised": [(300, f"{_SAYS('indicators', _ANON)} OR {_SAYS('hop_hosts', _ANON)}"), (200, _HAS_ID("intel.tor_exit")), (150, "manipulated"), (50, "unplaced"), (100, _SAYS("indicators", ("dynamic", "residential", "botnet", "cpe", "dsl", "broadband")))],
    "direct-actor": [(200, "domain_age <= 30"), (120, _HAS_ID("id.lookalike_domain", "id.confusable_chars", "id.punycode_sender")),
                     (80, f"{_SAYS('indicators', ('hosting', 'cloud', 'data center', 'datacenter', 'colo', 'vps'))} AND NOT {_SAYS('indicators', _ANON)}"), (60, _HAS_ID("intel.abuse_reports"))],
}
_SUMS = " UNION ALL ".join(f"SELECT case_id, malicious, '{a}' AS actor, {i} AS o, " + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for p, c in rules) + " AS pts FROM cx" for i, (a, rules) in enumerate(_POINTS.items()))
_CANON = r"regexp_replace(signal_id, '\.\d+$', '')"
_DEDUPE = "dd AS (SELECT * FROM v_signals QUALIFY row_number() OVER (PARTITION BY case_id, signal_id ORDER BY abs(w100) DESC, pos) = 1)"
_SCORE = """sc AS (SELECT case_id, (sum(w100) - 260) / 100e0 AS logit FROM dd WHERE triggered GROUP BY 1),
  rk AS (SELECT case_id, logit, round(least(99.9e0, greatest(0.1e0, 100 / (1 + exp(-logit)))), 1) AS risk FROM sc),
  lv AS (SELECT case_id, logit, risk, CASE WHEN risk >= 85 THEN 'critical' WHEN risk >= 65 THEN 'high' WHEN risk >= 40 THEN 'medium' WHEN risk >= 15 THEN 'low' ELSE 'clean' END AS level FROM rk)"""
_CONF = """cx AS (SELECT case_id, CASE WHEN case_id % 4 <> 0 THEN (case_id % 97) / 97e0 END AS p, 1e0 - (case_id % 5) / 10e0 AS cov FROM v_cases),
  ag AS (SELECT case_id, bool_or(severity IN ('high', 'critical')) AS strong, bool_and(w100 <= 0 OR (category = 'heuristic' AND signal_type = 'language')) AS lang FROM dd WHERE triggered GROUP BY 1),
  cf AS (SELECT case_id, risk, p, cov, strong, lang, abs(risk - 50) / 50 AS dec, coalesce(1 - abs(risk / 100 - p), 0.62e0) AS agr FROM cx JOIN ag USING (case_id) JOIN rk USING (case_id)),
  fl AS (SELECT *, (dec < 0.2e0)::INT + (p IS NOT NULL AND agr < 0.6e0)::INT + (p IS NULL)::INT + (cov < 0.7e0)::INT + (risk >= 50 AND NOT strong)::INT + (risk BETWEEN 35 AND 70 AND lang)::INT AS n_flags FROM cf),
  cn AS (SELECT case_id, risk, CAST(n_flags AS BIGINT) AS n_flags,
           round(round(greatest(1e0, least(99e0, 100 * pow(greatest(dec, 1e-6), 0.45e0) * pow(greatest(agr, 1e-6), 0.35e0) * pow(greatest(cov, 1e-6), 0.2e0))), 1) * pow(0.9e0, n_flags), 1) AS confidence FROM fl)"""
_RATIONALE = """ra AS (SELECT case_id, string_agg(signal_id || ' (+' || CAST(CAST(w100 / 100e0 AS DECIMAL(9, 2)) AS VARCHAR) || ' logit)', '; ' ORDER BY nth) AS rationale FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY w100 DESC, pos, signal_id) AS nth FROM dd WHERE triggered AND w100 > 0) WHERE nth <= 3 GROUP BY 1)"""
_EXPOSED = """ex AS (SELECT e.*, s.name, s.role, s.department, regexp_matches(lower(concat_ws(' ', s.role, s.department)), 'ceo|cfo|cto|chief|director|president|head|finance|payroll|treasury|admin|manager') AS is_high_value
    FROM v_exposures AS e LEFT JOIN v_staff AS s ON lower(e.email) = lower(s.email))"""
_RADIUS = _EXPOSED + """,
  pp AS (SELECT wave, email, bool_or(opened) AS opened, bool_or(clicked) AS clicked, bool_or(submitted) AS submitted, bool_or(reported) AS reported, bool_or(is_high_value) AS hv, max(department) AS department FROM ex GROUP BY ALL),
  br AS (SELECT wave, count(*) AS recipients, count(*) FILTER (opened) AS opened, count(*) FILTER (clicked) AS clicked, count(*) FILTER (submitted) AS submitted, count(*) FILTER (reported) AS reported,
           count(*) FILTER (hv) AS high_value, coalesce(string_agg(DISTINCT department, ',' ORDER BY department), '') AS departments FROM pp GROUP BY 1)"""
_PRIORITY = """CASE WHEN submitted > 0 THEN 'P1 - credentials submitted' WHEN clicked > 0 AND high_value > 0 THEN 'P1 - high-value target clicked' WHEN clicked > 0 THEN 'P2 - link clicked'
    WHEN risk >= 80 AND recipients > 5 THEN 'P2 - high-risk wave' WHEN high_value > 0 THEN 'P3 - high-value target in recipient list' WHEN risk >= 45 THEN 'P3 - suspicious' ELSE 'P4 - monitor' END"""
_PATH = """dl AS (SELECT *, ts_s - last_value(ts_s IGNORE NULLS) OVER w AS delay_s, coalesce(bool_or(is_private) OVER w, FALSE) AS after_private FROM v_hops
    WINDOW w AS (PARTITION BY case_id ORDER BY hop_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  rp AS (SELECT case_id, hop_index, ip, country, is_private, delay_s, list_sort(list_filter([
    CASE WHEN delay_s < -60 THEN 'backwards time' END, CASE WHEN delay_s > 3600 THEN 'long gap' END, CASE WHEN NOT is_private AND after_private THEN 'public after private' END,
    CASE WHEN NOT parse_ok THEN 'unparsed' END, CASE WHEN NOT is_private AND country IS NULL THEN 'unresolved' END], lambda x: x IS NOT NULL)) AS reasons FROM dl)"""
_RELIABLE = """er AS (SELECT case_id, hop_index, ip, country, NOT is_documentation AND parse_ok AS reliable FROM v_hops WHERE NOT is_private
    QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN NOT is_documentation AND parse_ok THEN 0 ELSE 1 END, hop_index) = 1)"""
_PAIRS = """st AS (SELECT a.case_id AS a, b.case_id AS b, a.kind, a.value FROM v_links AS a JOIN v_links AS b ON a.kind = b.kind AND a.value = b.value AND a.case_id < b.case_id WHERE a.kind NOT IN ('subject_shape', 'asn')),
  cd AS (SELECT DISTINCT a, b FROM st),
  wk AS (SELECT cd.a, cd.b, x.kind FROM cd JOIN v_links AS x ON x.case_id = cd.a AND x.kind IN ('subject_shape', 'asn') JOIN v_links AS y ON y.case_id = cd.b AND y.kind = x.kind AND y.value = x.value),
  rl AS (SELECT a, b, CAST(sum(CASE kind WHEN 'attachment' THEN 100 WHEN 'sender' THEN 85 WHEN 'url_host' THEN 75 WHEN 'ip' THEN 70 WHEN 'domain' THEN 60 WHEN 'subject_shape' THEN 40 ELSE 20 END) AS BIGINT) AS w100
    FROM (SELECT a, b, kind FROM st UNION SELECT a, b, kind FROM wk) GROUP BY ALL HAVING w100 >= 80)"""
_CHAIN = """RECURSIVE e AS MATERIALIZED (SELECT * FROM v_custody),
  ch AS (SELECT case_id, idx, kind, payload_hash, repeat('0', 64) AS prev_hash, sha256(concat_ws('|', case_id::VARCHAR, idx::VARCHAR, kind, payload_hash, repeat('0', 64))) AS entry_hash FROM e WHERE idx = 0
    UNION ALL SELECT e.case_id, e.idx, e.kind, e.payload_hash, ch.entry_hash, sha256(concat_ws('|', e.case_id::VARCHAR, e.idx::VARCHAR, e.kind, e.payload_hash, ch.entry_hash)) FROM ch JOIN e ON e.case_id = ch.case_id AND e.idx = ch.idx + 1)"""
_HASTERM = lambda t: f"len(list_filter(w, lambda x: starts_with(x, '{t}')))"

SQL = {
    "queue_filter": "SELECT case_id, risk, threat_class, created_s FROM v_cases WHERE status = 'open' AND verdict = 'phishing' AND risk >= 40 AND NOT is_duplicate",
    "case_summary": """SELECT case_id, case_number, subject, sender, from_domain, status, verdict, threat_class, actor_type, risk, created_s, coalesce(n_signals, 0) AS n_signals, coalesce(n_triggered, 0) AS n_triggered, coalesce(n_strong, 0) AS n_strong, needs_review, is_duplicate
      FROM v_cases LEFT JOIN (SELECT case_id, count(*) AS n_signals, count(*) FILTER (triggered) AS n_triggered, count(*) FILTER (triggered AND severity IN ('high', 'critical')) AS n_strong FROM v_signals GROUP BY 1) USING (case_id)""",
    "search_prefix": f"""SELECT msg_id, CAST({_HASTERM('th')} + {_HASTERM('ex')} AS BIGINT) AS hits FROM (SELECT msg_id, string_split_regex(lower(concat_ws(' ', subject, source, from_domain)), '[^a-z0-9]+') AS w FROM v_messages)
      WHERE {_HASTERM('th')} > 0 AND {_HASTERM('ex')} > 0""",
    "search_contains": "SELECT case_id, subject, created_s FROM v_cases WHERE contains(lower(subject), 'wave 17') OR contains(lower(sender), 'wave 17') OR contains(lower(from_domain), 'wave 17') OR contains(lower(case_number), 'wave 17') OR contains(lower(fingerprint), 'wave 17') ORDER BY created_s DESC, case_id LIMIT 50",
    "ioc_pivot": "SELECT case_id, created_s FROM v_cases WHERE case_id IN (SELECT case_id FROM v_iocs WHERE lower(value) = 'd7.example.org') ORDER BY created_s DESC, case_id LIMIT 20",
    "audit_trail": "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events QUALIFY nth <= 5",
    "alert_candidates": "SELECT case_id, verdict, threat_class, risk FROM v_cases WHERE verdict IN ('phishing', 'suspicious', 'bec', 'malware') OR threat_class IN ('phishing', 'fraud', 'impersonated') OR risk >= 40",
    "enrichment_gate": """WITH m AS (SELECT case_id, bool_or(regexp_matches(signal_id, '^id\\.(lookalike|brand|confusable|punycode|suspicious_tld)')) AS doubt FROM v_signals WHERE triggered GROUP BY 1),
      h AS (SELECT case_id, bool_or(lower(indicators) LIKE '%tor%' OR lower(hop_hosts) LIKE '%proxy%') AS anon FROM v_context GROUP BY 1),
      r AS (SELECT case_id, CASE WHEN risk > 20 AND risk < 80 THEN 'not conclusive' WHEN anon THEN 'anonymised origin' WHEN doubt THEN 'identity doubt' ELSE 'conclusive' END AS reason FROM v_cases LEFT JOIN m USING (case_id) LEFT JOIN h USING (case_id))
      SELECT case_id, reason, reason <> 'conclusive' AS enrich FROM r""",
    "retention_redact": "SELECT msg_id, CASE WHEN received_s < 1704067200 + 86400 THEN 0 ELSE length(body) END::BIGINT AS body_chars, sha256(body) AS body_sha256, CASE WHEN received_s < 1704067200 + 86400 THEN '[redacted]' ELSE subject END AS subject, received_s < 1704067200 + 86400 AS redacted FROM v_messages",
    "retention_preview": "SELECT age_days, count(*) AS messages, CAST(sum(strlen(body)) AS BIGINT) AS bytes FROM (SELECT (1704067200 + 400 * 86400 - received_s) // 86400 AS age_days, body FROM v_messages) WHERE age_days >= 399 GROUP BY 1",
    "resubmission_join": "SELECT msg_id, first_value(msg_id) OVER (PARTITION BY sha256(body) ORDER BY received_s, msg_id) AS first_id, count(*) OVER (PARTITION BY sha256(body)) - 1 AS resubmissions FROM v_messages",
    "stats_counters": """SELECT count(*) AS total, count(*) FILTER (verdict = 'phishing') AS phishing, count(*) FILTER (verdict = 'suspicious') AS suspicious, count(*) FILTER (verdict = 'bec') AS bec, count(*) FILTER (verdict = 'malware') AS malware,
      count(*) FILTER (verdict = 'likely_benign') AS likely_benign, count(*) FILTER (verdict = 'benign') AS benign, count(*) FILTER (needs_review) AS awaiting_review, count(*) FILTER (is_duplicate) AS duplicates, count(*) FILTER (anchored) AS anchored,
      round(avg(risk), 4) AS avg_risk, round(avg(confidence), 4) AS avg_confidence FROM v_cases""",
    "stats_breakdowns": "SELECT 'threat_class' AS breakdown, threat_class AS name, count(*) AS n FROM v_cases WHERE threat_class <> '' GROUP BY ALL UNION ALL SELECT 'actor_type', actor_type, count(*) FROM v_cases WHERE actor_type <> '' GROUP BY ALL",
    "top_techniques": f"SELECT technique, count(DISTINCT case_id) AS cases FROM (SELECT case_id, {_CANON} AS id FROM v_signals WHERE triggered) JOIN {_TECH} USING (id) GROUP BY 1 ORDER BY cases DESC, technique LIMIT 10",
    "top_origins": "SELECT n_name AS country, count(*) AS cases FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY cases DESC, country LIMIT 10",
    "campaign_rollup": """SELECT fingerprint, count(*) AS cases, max(risk) AS max_risk, floor(sum(CAST(round(risk * 10) AS BIGINT)) * 100e0 / count(*)) / 1000 AS avg_risk, min(created_s) AS first_seen_s, max(created_s) AS last_seen_s, count(*) FILTER (verdict = 'phishing') AS phishing,
      string_agg(DISTINCT from_domain, ',' ORDER BY from_domain) AS domains, coalesce(string_agg(DISTINCT nullif(threat_class, ''), ',' ORDER BY nullif(threat_class, '')), '') AS classes FROM v_cases GROUP BY 1""",
    "signal_dedupe": f"WITH {_DEDUPE} SELECT case_id, signal_id, w100, triggered FROM dd",
    "logodds_score": f"""WITH {_DEDUPE}, {_SCORE}, pc AS (SELECT case_id, category, sum(w100) AS w FROM dd WHERE triggered GROUP BY ALL), bd AS (SELECT case_id, string_agg(category || '=' || CAST(w AS VARCHAR), ',' ORDER BY category) AS breakdown FROM pc GROUP BY 1)
      SELECT case_id, logit, risk, level, breakdown FROM lv JOIN bd USING (case_id)""",
    "verdict_confidence": f"WITH {_DEDUPE}, {_SCORE}, {_CONF} SELECT case_id, risk, n_flags, confidence FROM cn",
    "class_risk": f"""WITH {_DEDUPE}, n AS (SELECT case_id, count(*) FILTER (triggered AND w100 > 0 AND severity = 'critical') AS c, count(*) FILTER (triggered AND w100 > 0 AND severity = 'high') AS h, count(*) FILTER (triggered AND w100 > 0 AND severity = 'medium') AS m FROM dd GROUP BY 1),
      b AS (SELECT *, CASE case_id % 5 WHEN 0 THEN 1e0 WHEN 1 THEN 28e0 WHEN 2 THEN 58e0 WHEN 3 THEN 74e0 ELSE 80e0 END AS lo, CASE case_id % 5 WHEN 0 THEN 18e0 WHEN 1 THEN 52e0 WHEN 2 THEN 78e0 WHEN 3 THEN 89e0 ELSE 95e0 END AS hi, (case_id % 101) / 100e0 AS p FROM n),
      r AS (SELECT *, lo + (hi - lo) * pow(least(1e0, greatest(0e0, p)), 0.85e0) + least(8e0, c * 2e0 + h * 1e0 + m * 0.4e0) AS v FROM b)
      SELECT case_id, round(least(97.5e0, greatest(0.5e0, CASE WHEN case_id % 5 = 0 THEN lo + (hi - lo) * pow(greatest(0e0, 1 - p), 1.5e0) WHEN case_id % 6 = 0 THEN least(94e0, v + 4.5e0) ELSE v END)), 1) AS risk FROM r""",
    "verdict_assembly": f"""WITH {_DEDUPE}, {_SCORE}, {_CONF}, {_RATIONALE},
      lb AS (SELECT lv.case_id, CASE WHEN confidence < 35 AND lv.risk BETWEEN 20 AND 80 THEN 'indeterminate' WHEN lv.risk >= 80 THEN 'phishing' WHEN lv.risk >= 45 THEN 'suspicious' WHEN lv.risk >= 20 THEN 'likely_benign' ELSE 'benign' END AS label, lv.risk, level, confidence, rationale
        FROM lv JOIN cn ON lv.case_id = cn.case_id LEFT JOIN ra ON ra.case_id = lv.case_id)
      SELECT case_id, label, risk, level, confidence, CASE label WHEN 'phishing' THEN 'quarantine' WHEN 'suspicious' THEN 'hold for analyst' WHEN 'indeterminate' THEN 'manual review' WHEN 'likely_benign' THEN 'release with banner' ELSE 'release' END AS action,
        label <> 'benign' OR confidence < 70 AS needs_review, coalesce(rationale, 'no positive signals fired') AS rationale FROM lb""",
    "evidence_coverage": "SELECT subject, count(*) AS planned, count(*) FILTER (score > 10) AS answered, round(count(*) FILTER (score > 10) / count(*), 6) AS coverage FROM v_intel GROUP BY 1",
    "relay_signals": f"""WITH {_PATH}, mc AS (SELECT case_id, count(DISTINCT country) AS n, list(country ORDER BY hop_index) AS l FROM rp WHERE NOT is_private AND country IS NOT NULL GROUP BY 1)
      SELECT case_id, 'relay.anomaly.' || hop_index AS signal_id, CAST(least(115 + 25 * (len(reasons) - 1), 190) AS BIGINT) AS w100, array_to_string(reasons, '; ') AS result FROM rp WHERE len(reasons) > 0
      UNION ALL SELECT case_id, 'relay.multi_country', 80, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' -> ') FROM mc WHERE n >= 3""",
    "ml_signal": "SELECT doc_id, round(greatest(-2.2e0, least(2.2e0, 0.6e0 * ln(q / (1 - q)))), 6) AS weight FROM (SELECT doc_id, least(greatest((doc_id % 1000) / 999e0, 1e-4), 1 - 1e-4) AS q FROM labels)",
    "case_techniques": f"""SELECT case_id, technique, tactic, tactic_ord, count(DISTINCT signal_id) AS n, array_to_string(list_sort(list(DISTINCT signal_id))[1:6], ',') AS evidence
      FROM (SELECT case_id, signal_id, {_CANON} AS id FROM v_signals WHERE triggered) JOIN {_TECH} USING (id) GROUP BY ALL""",
    "signal_techniques": f"""WITH s AS (SELECT DISTINCT case_id, signal_id, {_CANON} AS id FROM v_signals WHERE triggered), t AS (SELECT *, ord = min(ord) OVER (PARTITION BY id) AS is_primary FROM {_TECH})
      SELECT case_id, signal_id, technique, is_primary FROM s LEFT JOIN t USING (id)""",
    "technique_coverage": f"""WITH s AS (SELECT DISTINCT {_CANON} AS id FROM v_signals WHERE triggered), k AS (SELECT id, count(*) AS n FROM {_TECH} GROUP BY 1) SELECT id, coalesce(n, 0) AS techniques, n IS NULL AS missing FROM s LEFT JOIN k USING (id)""",
    "attribution": f"""WITH lv AS (SELECT case_id, list(DISTINCT {_CANON}) AS ids, sum(greatest(w100, 0)) AS malicious FROM v_signals WHERE triggered GROUP BY 1), cx AS (SELECT * FROM lv LEFT JOIN v_context USING (case_id)), pt AS ({_SUMS}),
      rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pts DESC, o) AS r, sum(pts) OVER (PARTITION BY case_id) AS total FROM pt),
      al AS (SELECT case_id, string_agg(actor || ':' || pts, ';' ORDER BY r) AS alternatives FROM rk WHERE r > 1 AND pts > 0 GROUP BY 1)
      SELECT case_id, CASE WHEN malicious >= 150 AND total > 0 THEN actor ELSE 'unknown' END AS actor_type,
        CASE WHEN malicious >= 150 AND total > 0 THEN least(95e0, round(100e0 * pts / total * (0.55e0 + 0.45e0 * least(1e0, pts / 400e0)), 1)) ELSE 0e0 END AS confidence,
        CASE WHEN malicious >= 150 AND total > 0 THEN coalesce(alternatives, '') ELSE '' END AS alternatives,
        CASE WHEN malicious < 150 OR total = 0 OR confidence < 40 THEN 'low' WHEN confidence < 70 THEN 'moderate' ELSE 'high' END AS band FROM rk LEFT JOIN al USING (case_id) WHERE r = 1""",
    "threat_class": f"""WITH i AS (SELECT case_id, list(DISTINCT {_CANON}) AS ids FROM v_signals WHERE triggered GROUP BY 1), b AS (SELECT case_id, verdict AS v, coalesce(ids, []) AS ids FROM v_cases LEFT JOIN i USING (case_id)),
      x AS (SELECT *, list_has_any(ids, ['nlp.credential_lure', 'url.credential_path', 'sandbox.credential_form']) AS cr, list_has_any(ids, ['nlp.payment_diversion', 'nlp.bec_no_payload', 'nlp.secrecy']) AS fr,
        list_has_any(ids, ['id.brand_impersonation', 'id.lookalike_domain', 'id.confusable_chars', 'id.punycode_sender', 'id.name_contains_other_address', 'auth.spf_unaligned']) AS im FROM b)
      SELECT case_id, CASE WHEN v = 'benign' OR (v = 'likely_benign' AND len(list_filter(ids, lambda z: z <> 'ml.score')) = 0) THEN 'legitimate' WHEN v = 'phishing' AND cr THEN 'phishing' WHEN fr AND NOT cr THEN 'fraud'
        WHEN im AND v IN ('phishing', 'suspicious') THEN 'impersonated' WHEN v = 'phishing' THEN 'phishing' ELSE 'suspicious' END AS threat_class FROM x""",
    "top_rationale": f"WITH {_DEDUPE}, {_RATIONALE} SELECT case_id, rationale FROM ra",
    "exposure_directory": f"WITH {_EXPOSED} SELECT event_id, email, name, department, role, is_high_value FROM ex",
    "blast_radius": f"WITH {_RADIUS} SELECT wave, recipients, opened, clicked, submitted, reported, high_value, departments FROM br",
    "containment_priority": f"WITH {_RADIUS} SELECT wave, recipients, {_PRIORITY} AS priority FROM (SELECT *, wave * 2.5e0 AS risk FROM br)",
    "wave_lookup": """SELECT case_id, CASE WHEN custkey % 200 < 60 THEN custkey % 200 WHEN custkey % 40 < 20 THEN 1000 + custkey % 40 END AS wave, CASE WHEN custkey % 200 < 60 THEN 'fingerprint' WHEN custkey % 40 < 20 THEN 'domain' ELSE 'none' END AS matched_by FROM v_cases""",
    "recipients_complete": "SELECT DISTINCT lower(email) AS email, 'gateway' AS origin FROM v_exposures UNION ALL SELECT DISTINCT lower(email), 'header' FROM v_staff WHERE lower(email) NOT IN (SELECT lower(email) FROM v_exposures)",
    "hop_index": "SELECT case_id, ip, hop_index AS position, row_number() OVER (PARTITION BY case_id ORDER BY hop_index DESC) - 1 AS hop_index FROM v_hops",
    "relay_path": f"WITH {_PATH} SELECT case_id, hop_index, ip, delay_s, array_to_string(reasons, ';') AS reasons FROM rp",
    "earliest_reliable_hop": f"WITH {_RELIABLE} SELECT case_id, hop_index, ip, country, reliable FROM er",
    "origin_summary": f"""WITH {_RELIABLE}, n AS (SELECT case_id, count(*) AS n FROM v_hops GROUP BY 1) SELECT case_id, coalesce(country, 'not established') AS place,
      CASE WHEN ip IS NULL THEN 'none' WHEN NOT reliable THEN 'low' WHEN country IS NULL THEN 'medium' ELSE 'high' END AS confidence, coalesce(n - 1 - hop_index, 0) AS later_hops FROM n LEFT JOIN er USING (case_id)""",
    "case_numbering": """SELECT case_id, 'MT-' || y || '-' || CASE WHEN n > 9999 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 4, '0') END AS case_number
      FROM (SELECT case_id, y, row_number() OVER (PARTITION BY y ORDER BY created_s, case_id) AS n FROM (SELECT *, year(make_timestamp(created_s * 1000000)) AS y FROM v_cases))""",
    "campaign_assign": """WITH f AS (SELECT case_id, fingerprint, first_value(case_id) OVER w AS fid, first_value(created_s) OVER w AS fs FROM v_cases WINDOW w AS (PARTITION BY fingerprint ORDER BY created_s RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)),
      g AS (SELECT a.case_id, a.fingerprint, min(b.created_s) AS fs, arg_min(b.case_id, (b.created_s, b.case_id)) AS fid FROM v_cases AS a JOIN v_cases AS b ON a.fingerprint = b.fingerprint AND b.created_s BETWEEN a.created_s - 604800 AND a.created_s GROUP BY ALL)
      SELECT case_id, 'camp-' || substr(fingerprint, 1, 12) AS campaign_id, fs AS first_seen_s, fid <> case_id AS is_duplicate, CASE WHEN fid <> case_id THEN fid END AS merged_into FROM g""",
    "campaign_siblings": "SELECT a.case_id, count(b.case_id) AS siblings FROM v_cases AS a LEFT JOIN v_cases AS b ON a.fingerprint = b.fingerprint AND b.created_s >= a.created_s - 604800 AND (b.created_s < a.created_s OR (b.created_s = a.created_s AND b.case_id < a.case_id)) GROUP BY 1",
    "custody_append": f"WITH {_CHAIN} SELECT case_id, idx, prev_hash, entry_hash FROM ch",
    "custody_verify": f"""WITH {_CHAIN}, al AS (SELECT *, CASE WHEN (case_id + idx) % 17 = 5 THEN 'altered' ELSE payload_hash END AS ph FROM ch),
      ck AS (SELECT *, prev_hash = coalesce(lag(entry_hash) OVER (PARTITION BY case_id ORDER BY idx), repeat('0', 64)) AND entry_hash = sha256(concat_ws('|', case_id::VARCHAR, idx::VARCHAR, kind, ph, prev_hash)) AS good FROM al)
      SELECT case_id, count(*) AS entries, min(idx) FILTER (NOT good) AS first_broken, arg_max(entry_hash, idx) AS head FROM ck GROUP BY 1""",
    "queue_sorted_page": "SELECT case_id, risk FROM v_cases ORDER BY risk DESC, case_id LIMIT 40 OFFSET 20",
    "relate_cases": f"WITH {_PAIRS} SELECT a, b, w100 FROM rl",
    "case_clusters": f"""WITH {_PAIRS}, bo AS (SELECT a, b, w100 FROM rl UNION ALL SELECT b, a, w100 FROM rl), da AS (SELECT a, b, w100, created_s, verdict, substr(subject, 1, 120) AS subject, row_number() OVER (PARTITION BY a ORDER BY w100 DESC, created_s, b) AS nth FROM bo JOIN v_cases AS c ON c.case_id = bo.b),
      n AS (SELECT a, list(b ORDER BY nth) AS near, string_agg(b || '|' || verdict || '|' || subject, ';' ORDER BY nth) FILTER (nth <= 10) AS summaries FROM da GROUP BY 1),
      ki AS (SELECT da.a, x.kind, x.value, min(nth) AS nth, any_value(list_position(['attachment', 'sender', 'url_host', 'ip', 'domain', 'subject_shape', 'asn'], x.kind)) AS k FROM da JOIN v_links AS x ON x.case_id = da.a JOIN v_links AS y ON y.case_id = da.b AND y.kind = x.kind AND y.value = x.value GROUP BY ALL),
      sh AS (SELECT a, string_agg(kind || ':' || value, ',' ORDER BY r) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY nth, k, value) AS r FROM ki) WHERE r <= 12 GROUP BY 1)
      SELECT a AS case_id, 'cl-' || substr(sha256(array_to_string(list_sort(list_transform(list_append(near, a), lambda x: CAST(x AS VARCHAR))), '|')), 1, 16) AS cluster_id, CAST(len(near) + 1 AS BIGINT) AS cluster_size, array_to_string(near[1:10], ',') AS related, summaries, shared FROM n JOIN sh USING (a)""",
    "artefact_intersect": f"""WITH {_PAIRS} SELECT a, b, kind, array_to_string(list_sort(list(value))[1:3], ',') AS shared FROM (SELECT rl.a, rl.b, x.kind, x.value FROM rl JOIN v_links AS x ON x.case_id = rl.a JOIN v_links AS y ON y.case_id = rl.b AND y.kind = x.kind AND y.value = x.value WHERE w100 >= 80) GROUP BY ALL""",
    "case_upsert": "SELECT case_id, CASE WHEN case_id % 3 = 0 AND case_id % 5 <> 0 THEN 'benign' ELSE verdict END AS verdict, risk, CAST(CASE WHEN case_id % 5 = 0 THEN 3 WHEN case_id % 3 <> 0 THEN 0 WHEN case_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS version FROM v_cases",
    "graph_nodes": "SELECT kind || ':' || value AS id, kind, count(*) AS weight FROM v_links GROUP BY ALL UNION ALL SELECT 'case:' || case_id, 'case', count(*) FROM v_links GROUP BY ALL",
    "graph_edges": "SELECT DISTINCT 'case:' || case_id AS source, kind || ':' || value AS target, kind AS link FROM v_links",
    "new_indicators": "SELECT DISTINCT ioc_type, lower(value) AS value FROM v_iocs WHERE first_seen_s >= 946684800 EXCEPT SELECT ioc_type, lower(value) FROM v_iocs WHERE first_seen_s < 946684800",
    "extract_iocs": """WITH c AS (SELECT *, CAST(floor(greatest(30, least(90, risk))) AS INT) AS base FROM v_cases), r AS (
      SELECT case_id, 'email-addr' AS ioc_type, sender AS value, base AS confidence, 'From address on ' || case_number AS context, 0 AS ord, 0 AS pos FROM c
      UNION ALL SELECT case_id, 'domain-name', from_domain, greatest(30, base - 10), 'sender-side domain', 1, 0 FROM c
      UNION ALL SELECT case_id, 'domain-name', value, CASE kind WHEN 'domain' THEN greatest(30, base - 10) ELSE base END, CASE kind WHEN 'domain' THEN 'sender-side domain' ELSE 'link destination' END, CASE kind WHEN 'domain' THEN 1 ELSE 3 END, 0 FROM v_links JOIN c USING (case_id) WHERE kind IN ('domain', 'url_host')
      UNION ALL SELECT case_id, 'ipv4-addr', ip, CASE WHEN first = 0 THEN base ELSE greatest(30, base - 20) END, CASE WHEN first = 0 THEN 'relay hop (origin)' ELSE 'relay hop' END, 2, first FROM (SELECT case_id, ip, min(hop_index) AS first FROM v_hops WHERE NOT is_private GROUP BY ALL) JOIN c USING (case_id)
      UNION ALL SELECT case_id, 'url', left(value, 400), base, 'embedded link', 4, pos FROM (SELECT case_id, value, pos FROM v_iocs WHERE ioc_type = 'url' QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY pos, value) <= 20) JOIN c USING (case_id)
      UNION ALL SELECT case_id, 'file-hash', md5(value), least(95, base + 10), 'attachment ' || value || '.bin (unknown)', 5, 0 FROM v_links JOIN c USING (case_id) WHERE kind = 'attachment')
      SELECT case_id, ioc_type, value, confidence, context FROM r QUALIFY row_number() OVER (PARTITION BY case_id, ioc_type, lower(value) ORDER BY ord, pos, value) = 1""",
    "case_store": """WITH n AS (SELECT case_id, count(*) AS whole, count(*) FILTER (w100 >= 150) AS heavy FROM v_signals GROUP BY 1)
      SELECT case_id, CASE WHEN case_id % 3 = 0 AND case_id % 5 <> 0 THEN 'benign' ELSE verdict END AS verdict, CAST(CASE WHEN case_id % 5 = 0 THEN 3 WHEN case_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS version,
        coalesce(CASE WHEN case_id % 3 = 0 AND case_id % 5 <> 0 THEN heavy ELSE whole END, 0) AS n_signals FROM v_cases LEFT JOIN n USING (case_id)""",
    "sink_case_upsert": "SELECT ioc_type, lower(value) AS key, max(confidence) AS confidence, arg_min(context, (first_seen_s, case_id, pos, context)) AS context, min(first_seen_s) AS first_seen_s, count(DISTINCT case_id) AS cases FROM v_iocs GROUP BY 1, 2",
    "sla_report": "SELECT case_id, e - created_s AS elapsed_s, created_s + 1200 - e AS remaining_s, created_s + 1200 - e < 0 AS breached FROM (SELECT case_id, created_s, CASE WHEN status = 'closed' THEN created_s + case_id % 3600 ELSE 1041379200 END AS e FROM v_cases)",
    "apply_decisions": """WITH x AS (SELECT event_id, event_id * 3 AS case_id, (epoch_us(ts) // 1000000) AS at_s, CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'override' WHEN 'error' THEN 'escalate' ELSE 'ignore' END AS d, CASE WHEN event_id % 2 = 0 THEN 'benign' ELSE '' END AS nv, event_id % 7 <> 0 AS named FROM events),
      l AS (SELECT * FROM x WHERE d <> 'ignore' AND (d <> 'override' OR nv <> '') AND named QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY at_s DESC, event_id DESC) = 1)
      SELECT c.case_id, CASE d WHEN 'approve' THEN 'approved' WHEN 'escalate' THEN 'escalated' WHEN 'override' THEN 'overridden' ELSE status END AS status, CASE WHEN d = 'override' THEN nv ELSE verdict END AS verdict, needs_review AND d IS NULL AS needs_review, at_s AS closed_s
      FROM v_cases AS c LEFT JOIN l ON l.case_id = c.case_id""",
    "geo_resolve": """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'city of supplier ' || s_suppkey WHEN s_nationkey < 20 THEN n_name END AS place, CASE WHEN s_suppkey % 3 = 0 THEN 'live' WHEN s_nationkey < 20 THEN 'offline-table' ELSE 'unavailable' END AS source
      FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "intel_asof": """WITH r AS (SELECT l.lookup_id, l.provider, l.subject, l.at_s, i.score, i.queried_s FROM v_lookups AS l LEFT JOIN v_intel AS i ON i.provider = l.provider AND i.subject = l.subject AND i.queried_s BETWEEN l.at_s - 604800 AND l.at_s
      QUALIFY row_number() OVER (PARTITION BY l.lookup_id ORDER BY i.queried_s DESC NULLS LAST, i.event_id DESC) = 1)
      SELECT lookup_id, provider, subject, score, at_s - queried_s AS age_s, CASE WHEN queried_s IS NULL THEN 'unavailable' ELSE 'cache' END AS source FROM r""",
    "intel_signals": f"""WITH a AS (SELECT event_id, provider, subject, source, summary, json(data) AS d FROM v_answers WHERE status = 'ok'),
      x AS (SELECT *, CAST(coalesce(CAST(json_extract(d, '$.abuse_confidence_score') AS BIGINT), 0) AS BIGINT) AS score, coalesce(CAST(json_extract(d, '$.malicious') AS BIGINT), 0) + coalesce(CAST(json_extract(d, '$.suspicious') AS BIGINT), 0) AS bad, CAST(json_extract(d, '$.listed_count') AS BIGINT) AS listed,
        CASE WHEN json_type(d, '$.domain_age_days') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(d, '$.domain_age_days') AS BIGINT) END AS age FROM a),
      f AS (
        SELECT event_id, provider, subject, source, 'intel.abuse.' || subject AS signal_id, 'Sending IP has abuse reports' AS title, score || '% confidence, ' || json_extract(d, '$.total_reports') || ' report(s)' AS result, 0.9 + least(1.3, score * 0.013) AS weight, CASE WHEN score >= 60 THEN 'high' ELSE 'medium' END AS severity, summary AS evidence FROM x WHERE provider = 'abuseipdb' AND score >= 25
        UNION ALL SELECT event_id, provider, subject, source, 'intel.tor.' || subject, 'Sending IP is a known Tor node', 'tor exit', 1.5, 'high', 'AbuseIPDB flags this address as Tor infrastructure' FROM x WHERE provider = 'abuseipdb' AND json_extract_string(d, '$.is_tor') = 'true'
        UNION ALL SELECT event_id, provider, subject, source, 'intel.newdomain.' || subject, 'Sender domain registered very recently', age || ' day(s) old', CASE WHEN age <= 7 THEN 2.0 ELSE 1.5 END, CASE WHEN age <= 7 THEN 'critical' ELSE 'high' END,
          'Registered ' || coalesce(json_extract_string(d, '$.created'), '') || '. Phishing domains are typically used within days of registration.' FROM x WHERE provider = 'whois' AND age <= 30
        UNION ALL SELECT event_id, provider, subject, source, 'intel.vt.' || substr(subject, 1, 60), 'URL flagged by URL-reputation engines', bad || ' engine(s)', least(2.3, 0.8 + bad * 0.25), CASE WHEN bad >= 5 THEN 'critical' ELSE 'high' END, summary FROM x WHERE provider = 'virustotal' AND bad > 0
        UNION ALL SELECT event_id, provider, subject, source, 'intel.dnsbl.' || subject, 'Sending IP is on a public blocklist', array_to_string(from_json(json_extract(d, '$.listed_on'), '["VARCHAR"]'), ', '), 0.9 + 0.5 * listed, 'high', summary FROM x WHERE provider = 'dnsbl' AND listed > 0
        UNION ALL SELECT event_id, provider, subject, source, 'intel.rdns.' || subject, 'Reverse DNS does not forward-confirm', array_to_string(from_json(json_extract(d, '$.ptr'), '["VARCHAR"]')[1:2], ', '), 0.8, 'medium', summary FROM x WHERE provider = 'rdns' AND json_array_length(d, '$.ptr') > 0 AND json_extract_string(d, '$.forward_confirmed') = 'false'
        UNION ALL SELECT event_id, provider, subject, source, 'intel.dns.' || subject || '.' || CASE note WHEN 'no SPF record' THEN {crc32(b'no SPF record') % 9999} ELSE {crc32(b'no DMARC record') % 9999} END, 'Sender-domain DNS weakness', note, 0.7, 'medium', 'Structural DNS check on ' || subject FROM (SELECT *, unnest(from_json(json_extract(d, '$.notes'), '["VARCHAR"]')) AS note FROM x WHERE provider = 'dns'))
      SELECT event_id, provider, subject, source, signal_id, title, result, round(CAST(weight AS DOUBLE), 4) AS weight, severity, evidence FROM f""",
    "ip_prefix_join": """WITH n AS (SELECT ord, cidr, split_part(cidr, '/', 1) AS ip, CAST(split_part(cidr, '/', 2) AS INT) AS len FROM v_networks), every AS (SELECT ip FROM n UNION SELECT ip FROM v_addresses),
      g AS (SELECT ip, contains(ip, ':') AS six, CASE WHEN contains(ip, '::') THEN list_filter(string_split(split_part(ip, '::', 1), ':'), lambda x: x <> '') || list_transform(range(8 - len(list_filter(string_split(ip, ':'), lambda x: x <> ''))), lambda x: '0') || list_filter(string_split(split_part(ip, '::', 2), ':'), lambda x: x <> '') ELSE string_split(ip, ':') END AS groups, string_split(ip, '.') AS four FROM every),
      b AS (SELECT ip, six, array_to_string(CASE WHEN six THEN list_transform(groups, lambda x: lpad(bin(CAST('0x' || x AS BIGINT)), 16, '0')) ELSE list_transform(four, lambda x: lpad(bin(CAST(x AS BIGINT)), 8, '0')) END, '') AS bits FROM g),
      p AS (SELECT ord, cidr, len, six, substr(bits, 1, len) AS prefix FROM n JOIN b USING (ip)), a AS (SELECT id, v.ip, six, bits FROM v_addresses AS v JOIN b ON v.ip = b.ip),
      h AS (SELECT a.id, a.ip, arg_min(cidr, ord) AS first, arg_min(cidr, (-len, ord)) AS longest FROM (SELECT DISTINCT id, ip, six, bits FROM a) AS a LEFT JOIN p ON p.six = a.six AND starts_with(a.bits, p.prefix) GROUP BY a.id, a.ip)
      SELECT a.id, a.ip, 'first' AS rule, h.first AS cidr FROM a JOIN h ON a.id = h.id AND a.ip = h.ip UNION ALL SELECT a.id, a.ip, 'longest', h.longest FROM a JOIN h ON a.id = h.id AND a.ip = h.ip""",
    "intel_plan": """WITH u AS (SELECT value, row_number() OVER (PARTITION BY case_id ORDER BY pos, value) AS nth FROM v_iocs WHERE ioc_type = 'url')
      SELECT 'domain' AS kind, from_domain AS subject FROM v_cases UNION SELECT 'domain', value FROM u WHERE nth <= 3 UNION SELECT 'url', value FROM u WHERE nth <= 2 UNION SELECT 'ip', ip FROM v_hops WHERE hop_index < 2 AND NOT is_private""",
    "ip_range_join": """WITH w AS (SELECT s_suppkey + 1000000 AS ord, (20 + s_suppkey % 200) * 16777216 + 458752 AS f, 20479 AS w, 'wide-' || s_suppkey % 200 AS net FROM supplier
        UNION ALL SELECT s_suppkey, (20 + s_suppkey % 200) * 16777216 + 458752 + (s_suppkey % 250) * 256, 255, 'narrow-' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0),
      h AS (SELECT case_id, hop_index, ip, split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT AS n FROM v_hops WHERE NOT is_private),
      d AS (SELECT DISTINCT ip, n FROM h), b AS (SELECT d.ip, arg_min(net, ord) AS net FROM d JOIN w ON n BETWEEN f AND f + w.w GROUP BY 1)
      SELECT case_id, hop_index, h.ip, net FROM h LEFT JOIN b ON h.ip = b.ip""",
    "next_actions": f"""WITH {_RADIUS}, u AS (SELECT case_id, array_to_string(list_slice(list_sort(list(DISTINCT value)), 1, 6), ', ') AS hosts FROM v_links WHERE kind = 'url_host' GROUP BY 1),
      o AS (SELECT case_id, ip FROM v_hops WHERE hop_index = 0),
      k AS (SELECT c.*, clicked, submitted, hosts, ip, sha256(c.case_id::VARCHAR) AS raw FROM v_cases AS c LEFT JOIN br ON wave = c.case_id % 40 LEFT JOIN u ON u.case_id = c.case_id LEFT JOIN o ON o.case_id = c.case_id),
      s AS (SELECT case_id, 1 AS ord, 'Quarantine estate-wide' AS action, 'purge by Message-ID ' || CASE WHEN case_id % 6 = 0 THEN '(absent)' ELSE '<' || case_id || '@' || from_domain || '>' END || ' and by raw SHA-256 ' || left(raw, 16) AS detail, 'immediate' AS urgency FROM k WHERE verdict IN ('phishing', 'suspicious')
        UNION ALL SELECT case_id, 2, 'Force password reset and revoke sessions', submitted || ' recipient(s) submitted credentials', 'immediate' FROM k WHERE submitted > 0
        UNION ALL SELECT case_id, 2, 'Reset credentials for users who clicked', clicked || ' click(s) recorded', 'immediate' FROM k WHERE NOT coalesce(submitted > 0, FALSE) AND clicked > 0
        UNION ALL SELECT case_id, 3, 'Block link domains at the proxy and DNS', hosts, 'today' FROM k WHERE hosts IS NOT NULL
        UNION ALL SELECT case_id, 4, 'Block the origin IP at the mail gateway', ip, 'today' FROM k WHERE ip <> ''
        UNION ALL SELECT case_id, 5, 'Notify the sending organisation of a suspected account compromise', 'authentication aligned for ' || from_domain || ', so the mailbox itself is likely in attacker hands', 'today' FROM k WHERE actor_type = 'compromised-account'
        UNION ALL SELECT case_id, 6, 'Raise DMARC enforcement / add a spoofing rule', 'inbound mail claiming ' || from_domain || ' failed alignment', 'this week' FROM k WHERE actor_type = 'spoofed-domain'
        UNION ALL SELECT case_id, 7, 'Freeze and re-verify the payment instruction out of band', 'call the known-good number on file; do not reply to the thread', 'immediate' FROM k WHERE threat_class = 'fraud'
        UNION ALL SELECT case_id, 8, 'Preserve evidence', 'custody chain head ' || CASE WHEN anchored THEN left(sha256(case_number), 18) || '...' ELSE 'not recorded' END || '; retention 30 days', 'record' FROM k)
      SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS nth, action, detail, urgency FROM s""",
    "campaign_risk_reach": f"""WITH {_DEDUPE}, {_SCORE}, {_RADIUS}, r AS (SELECT fingerprint, custkey % 40 AS wave, count(*) AS cases, max(rk.risk) AS risk FROM v_cases JOIN rk USING (case_id) GROUP BY 1, 2)
      SELECT fingerprint, wave, cases, risk, recipients, clicked, submitted, high_value, {_PRIORITY} AS priority FROM r JOIN br USING (wave)""",
}
