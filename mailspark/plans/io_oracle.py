"""DuckDB twins of the source, sink and stream queries.

A stream in append mode emits a window when the watermark has passed its end;
at the end of the input (availableNow runs a last batch without data) these
are the windows that end at most an hour before the last event.
"""

from __future__ import annotations

from mailspark.plans.case_oracle import _CHAIN
from mailspark.plans.message_oracle import LAB

_RAW = """rw AS (SELECT msg_id AS id, body, 'From: Staff <u' || msg_id || '@' || from_domain || '>' || chr(10) || 'Subject: ' || CASE WHEN msg_id % 4 = 1 THEN '=?utf-8?B?' || base64(encode('Invoice é ' || msg_id)) || '?=' ELSE 'Invoice é ' || msg_id END || chr(10) || 'Message-ID: <m' || msg_id || '@x>' || chr(10)
    || 'Received: ' || replace(received_header, ' by ', chr(10) || chr(9) || 'by ') || chr(10) AS top, chr(10) AS n, 'Content-Type: text/plain; charset=utf-8' || chr(10) || 'Content-Transfer-Encoding: ' AS t,
    'Content-Type: application/pdf; name="a.pdf"' || chr(10) || 'Content-Disposition: attachment; filename="a.pdf"' || chr(10) || 'Content-Transfer-Encoding: base64' || chr(10) || chr(10) || base64(encode('%PDF-' || msg_id)) AS file FROM v_mail),
  rx AS (SELECT id, top || CASE id % 4 WHEN 0 THEN t || '8bit' || n || n || body WHEN 2 THEN t || 'quoted-printable' || n || n || regexp_replace(hex(encode(body)), '(..)', '=\\1', 'g')
    WHEN 1 THEN 'Content-Type: multipart/mixed; boundary="b1"' || n || n || 'preamble' || n || '--b1' || n || t || 'base64' || n || n || base64(encode(body)) || n || '--b1' || n || file || n || '--b1--' || n
    ELSE 'Content-Type: multipart/mixed; boundary="b1"' || n || n || 'preamble' || n || '--b1' || n || 'Content-Type: multipart/alternative; boundary="b2"' || n || n || 'preamble' || n || '--b2' || n || t || '8bit' || n || n || body || n || '--b2' || n
      || 'Content-Type: text/html; charset=utf-8' || n || n || '<p>' || id || '</p>' || n || '--b2--' || n || n || '--b1' || n || file || n || '--b1--' || n END || n AS raw FROM rw)"""
_EV = "ev AS (SELECT *, epoch_us(ts) AS us FROM events), mx AS (SELECT max(us) - 3600000000 AS wm FROM ev)"
_T = {"ipv4-addr": ("ipv4-addr:value", "ip-src"), "domain-name": ("domain-name:value", "domain"), "url": ("url:value", "url"), "email-addr": ("email-addr:value", "email-src"), "file-hash": ("file:hashes.''SHA-256''", "sha256")}
_CASE = lambda k, d: "CASE ioc_type " + " ".join(f"WHEN '{t}' THEN '{v[k]}'" for t, v in _T.items()) + f" {d} END"

SQL = {
    "src_messages_raw": f"WITH {_RAW} SELECT id, strlen(raw) AS size, sha256(raw) AS sha256 FROM rx",
    "src_parse_messages": r"""WITH x AS (SELECT msg_id AS id, from_domain, regexp_replace(body, '^\s+|\s+$', '', 'g') AS b FROM v_mail) SELECT id, 'Invoice é ' || id AS subject, 'Staff' AS from_name, 'u' || id || '@' || from_domain AS from_address, '<m' || id || '@x>' AS message_id, 1 AS n_received, sha256(b) AS body_sha256,
      CASE WHEN id % 4 = 3 THEN '<p>' || id || '</p>' ELSE '' END AS html, CASE WHEN id % 2 = 1 THEN 1 ELSE 0 END AS n_attachments, CASE WHEN id % 2 = 1 THEN 'a.pdf,application/pdf,' || sha256('%PDF-' || id) ELSE '' END AS files,
      CASE WHEN b = '' AND id % 4 <> 3 THEN 'no readable body content' ELSE '' END AS parse_errors FROM x""",
    "src_corpus_jsonl": f"WITH {LAB} SELECT id, CAST(label AS INT) AS label, sha256(body) AS sha256 FROM la WHERE trim(body) <> ''",
    "src_reference_maps": "SELECT event_id, unnest(json_keys(props)) AS map_key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS map_value FROM events",
    "sink_corpus_splits": f"WITH {LAB} SELECT CASE WHEN r <= floor(k * 0.8e0) THEN 'train' ELSE 'test' END AS split, CAST(label AS BIGINT) AS label, count(*) AS n FROM rn GROUP BY ALL",
    "sink_ioc_csv": "SELECT ioc_type, context, count(*) AS n, CAST(sum(confidence) AS BIGINT) AS confidence FROM v_iocs GROUP BY ALL",
    "sink_ioc_misp": f"""SELECT case_id, array_to_string(list_sort(list(DISTINCT {_CASE(1, "ELSE 'other'")} || '|' || value || '|' || CASE WHEN confidence >= 60 THEN '1' ELSE '0' END)), chr(10)) AS attributes, CASE WHEN max(confidence) >= 80 THEN '2' ELSE '3' END AS threat_level FROM v_iocs GROUP BY 1""",
    "sink_custody_append": f"WITH {_CHAIN} SELECT kind, count(*) AS n, max(entry_hash) AS last FROM ch GROUP BY 1",
    "stream_ingest_dedupe": "SELECT DISTINCT sha256(coalesce(text, '')) AS digest FROM documents",
    "stream_tumbling_counts": f"WITH {_EV} SELECT (us // 3600000000) * 3600 AS start_s, event_type, count(*) AS n FROM ev, mx WHERE (us // 3600000000 + 1) * 3600000000 <= wm GROUP BY ALL",
    "stream_campaign_sliding": f"""WITH {_EV}, w AS (SELECT us, user_id, unnest(range((us // 86400000000) - 6, (us // 86400000000) + 1)) AS d FROM ev) SELECT d * 86400 AS start_s, user_id, count(*) AS n FROM w, mx WHERE (d + 7) * 86400000000 <= wm GROUP BY ALL""",
    "stream_wave_session": f"""WITH {_EV}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM ev), s AS (SELECT *, count(*) FILTER (gap IS NULL OR gap >= 1800000000) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g),
      e AS (SELECT user_id, k, min(us) AS a, max(us) AS z, count(*) AS n FROM s GROUP BY ALL) SELECT a // 1000000 AS start_s, user_id, n FROM e, mx WHERE z + 1800000000 <= wm""",
    "stream_replay_since": "SELECT event_id, event_type FROM events WHERE event_id > 300 ORDER BY event_id LIMIT 400",
    "stream_enrich_static": "SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey",
    "stream_exposure_join": """WITH m AS (SELECT a.event_id AS delivery, b.event_id AS click FROM events AS a JOIN events AS b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR),
      wm AS (SELECT least(max(epoch_us(ts)) FILTER (event_type = 'view'), max(epoch_us(ts)) FILTER (event_type = 'click')) // 1000 * 1000 - 3600000000 AS w FROM events)
      SELECT * FROM m UNION ALL SELECT event_id, NULL FROM events, wm WHERE event_type = 'view' AND event_id NOT IN (SELECT delivery FROM m) AND epoch_us(ts) + 86400000000 < w""",
    "stream_ioc_upsert": "SELECT l_partkey % 50 AS key, max(l_quantity) AS confidence FROM lineitem GROUP BY 1",
    "stream_alerts": "SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('error', 'purchase')",
    "stream_sla_timer": """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type IN ('signup', 'purchase')), wm AS (SELECT max(ms) - 3600000 AS w FROM e)
      SELECT a.event_id, NOT coalesce(bool_or(b.event_id IS NOT NULL), FALSE) AS breached FROM e AS a LEFT JOIN e AS b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ms, b.event_id) > (a.ms, a.event_id) AND b.ms <= a.ms + 1200000, wm
      WHERE a.event_type = 'signup' AND a.ms + 1200001 < w GROUP BY 1""",
}
