"""The model's tables as projections of the given ones.

Each view is one SQL text that Spark and DuckDB both read (integer arithmetic,
no engine's own hash), so that a query and its DuckDB twin start from the same
rows.  EPOCH(x) stands for the seconds since 1970 of a timestamp.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: id, weight in hundredths, severity, category, type: the rows of the signal catalogue that the stand-ins use.
CATALOGUE = """(VALUES
  (0, 'auth.dmarc_fail', 230, 'high', 'heuristic', 'authentication'), (1, 'auth.dmarc_pass', -160, 'clean', 'heuristic', 'authentication'),
  (2, 'auth.spf_fail', 120, 'medium', 'heuristic', 'authentication'), (3, 'auth.spf_unaligned', 155, 'high', 'heuristic', 'authentication'),
  (4, 'auth.dkim_fail', 140, 'medium', 'heuristic', 'authentication'), (5, 'auth.no_auth', 110, 'medium', 'heuristic', 'authentication'),
  (6, 'id.brand_impersonation', 190, 'high', 'heuristic', 'identity'), (7, 'id.lookalike_domain', 240, 'critical', 'heuristic', 'identity'),
  (8, 'id.replyto_divergence', 120, 'medium', 'heuristic', 'identity'), (9, 'nlp.urgency', 80, 'medium', 'heuristic', 'language'),
  (10, 'nlp.credential_lure', 150, 'high', 'heuristic', 'language'), (11, 'nlp.payment_diversion', 165, 'high', 'heuristic', 'language'),
  (12, 'url.credential_path.0', 135, 'high', 'heuristic', 'url'), (13, 'url.shortener.1', 85, 'medium', 'heuristic', 'url'),
  (14, 'att.macro.0', 140, 'high', 'heuristic', 'attachment'), (15, 'hdr.no_message_id', 90, 'medium', 'heuristic', 'header'),
  (16, 'relay.anomaly.1', 115, 'medium', 'relay', 'relay'), (17, 'intel.abuse_reports', 130, 'high', 'intel', 'intel'),
  (18, 'intel.tor_exit', 170, 'high', 'intel', 'intel'), (19, 'ml.score', -90, 'clean', 'ml', 'ml_score'),
  (20, 'hdr.mass_recipients', 55, 'low', 'heuristic', 'header'), (21, 'nlp.authority_pressure', 95, 'high', 'heuristic', 'language'),
  (22, 'intel.new_domain', 160, 'high', 'intel', 'intel'), (23, 'url.many', 45, 'low', 'heuristic', 'url'))
  AS c(k, signal_id, w100, severity, category, signal_type)"""

VIEWS = {
    "v_cases": """
      SELECT o_orderkey AS case_id, EPOCH(o_orderdate) + (o_orderkey % 1440) * 60 AS created_s,
             CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'pending' END AS status,
             CASE o_orderkey % 7 WHEN 0 THEN 'phishing' WHEN 1 THEN 'phishing' WHEN 2 THEN 'suspicious' WHEN 3 THEN 'bec' WHEN 4 THEN 'malware' WHEN 5 THEN 'likely_benign' ELSE 'benign' END AS verdict,
             CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'phishing' WHEN '2' THEN 'fraud' WHEN '3' THEN 'impersonated' WHEN '4' THEN 'suspicious' ELSE '' END AS threat_class,
             CASE o_custkey % 5 WHEN 0 THEN 'compromised-account' WHEN 1 THEN 'spoofed-domain' WHEN 2 THEN 'anonymised' WHEN 3 THEN 'direct-actor' ELSE '' END AS actor_type,
             CASE WHEN o_totalprice < 50.0 THEN 0.1e0 WHEN o_totalprice > 499500.0 THEN 99.9e0 ELSE floor(o_totalprice / 500e0) / 10e0 END AS risk,
             CAST(30 + o_orderkey % 70 AS DOUBLE) AS confidence, o_custkey AS custkey,
             'u' || CAST(o_custkey AS STRING) || '@org' || CAST(o_custkey % 40 AS STRING) || '.example.com' AS sender,
             'org' || CAST(o_custkey % 40 AS STRING) || '.example.com' AS from_domain,
             substr(md5('wave' || CAST(o_custkey % 200 AS STRING)), 1, 32) AS fingerprint,
             'Invoice ' || CAST(o_orderkey AS STRING) || ' for wave ' || CAST(o_custkey % 200 AS STRING) AS subject,
             'MT-' || CAST(o_orderkey AS STRING) AS case_number,
             o_orderkey % 3 = 0 AS needs_review, o_orderkey % 11 = 0 AS is_duplicate, o_orderkey % 5 = 0 AS anchored
      FROM orders""",
    "v_signals": f"""
      SELECT l_orderkey AS case_id, c.signal_id, c.w100 + (l_linenumber % 3) * 5 AS w100, c.severity, c.category, c.signal_type,
             (l_linenumber + l_partkey) % 5 <> 0 AS triggered, l_linenumber * 1000000 + l_partkey AS pos
      FROM lineitem JOIN {CATALOGUE} ON c.k = l_partkey % 24""",
    "v_context": """
      SELECT o_orderkey AS case_id, CASE o_orderkey % 9 WHEN 0 THEN 'reverse DNS names this host as a Tor node' WHEN 1 THEN 'reverse DNS suggests hosting or cloud infrastructure' WHEN 2 THEN 'dynamic residential address' ELSE '' END AS indicators,
             CASE o_orderkey % 8 WHEN 0 THEN 'mail.vpn7.example.net' ELSE 'mx.example.com' END AS hop_hosts, o_orderkey % 3 <> 0 AS aligned, o_orderkey % 4 <> 0 AS dmarc_pass, o_orderkey % 10 = 0 AS manipulated, o_orderkey % 6 = 0 AS unplaced,
             CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 900 AS INT) END AS domain_age
      FROM orders""",
    "v_links": """
      SELECT DISTINCT case_id, kind, value FROM (
        SELECT l_orderkey AS case_id, 'attachment' AS kind, 'a' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey % 3 AS STRING) AS value FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL SELECT o_orderkey, 'sender', 's' || CAST(o_custkey AS STRING) FROM orders
        UNION ALL SELECT l_orderkey, 'url_host', 'h' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) FROM lineitem
        UNION ALL SELECT l_orderkey, 'ip', 'i' || CAST(l_suppkey AS STRING) || '-' || CAST(l_partkey % 97 AS STRING) FROM lineitem
        UNION ALL SELECT l_orderkey, 'domain', 'd' || CAST(l_suppkey AS STRING) || '-' || CAST(l_partkey % 31 AS STRING) FROM lineitem WHERE l_linenumber = 1
        UNION ALL SELECT l_orderkey, 'subject_shape', 'j' || CAST(l_partkey % 200 AS STRING) FROM lineitem WHERE l_linenumber = 1
        UNION ALL SELECT l_orderkey, 'asn', 'n' || CAST(l_suppkey % 5 AS STRING) FROM lineitem WHERE l_linenumber = 1) AS x""",
    "v_hops": """
      SELECT case_id, hop_index, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE base_s + hop_index * 300 - CASE WHEN l_partkey % 9 = 0 THEN 900 ELSE 0 END + CASE WHEN l_partkey % 10 = 0 THEN 7200 ELSE 0 END END AS ts_s,
             CASE WHEN l_suppkey % 7 = 0 THEN '10.0.' ELSE CAST(20 + l_suppkey % 200 AS STRING) || '.7.' END || CAST(l_suppkey % 250 AS STRING) || '.' || CAST(l_partkey % 250 AS STRING) AS ip,
             l_suppkey % 7 = 0 AS is_private, l_suppkey % 23 = 0 AS is_documentation, l_partkey % 13 <> 0 AS parse_ok,
             CASE WHEN l_suppkey % 7 = 0 OR l_suppkey % 11 = 0 THEN NULL ELSE 'N' || CAST(s_nationkey AS STRING) END AS country
      FROM (SELECT l_orderkey AS case_id, l_partkey, l_suppkey, EPOCH(l_shipdate) AS base_s,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS hop_index
            FROM lineitem) AS h JOIN supplier ON s_suppkey = l_suppkey""",
    "v_iocs": """
      SELECT l_orderkey AS case_id, l_linenumber * 1000000 + l_partkey AS pos,
             CASE l_partkey % 6 WHEN 0 THEN 'email-addr' WHEN 1 THEN 'domain-name' WHEN 2 THEN 'ipv4-addr' WHEN 3 THEN 'url' WHEN 4 THEN 'file-hash' ELSE 'registry-key' END AS ioc_type,
             CASE l_partkey % 6 WHEN 0 THEN 'U' || CAST(l_suppkey AS STRING) || '@x' || CAST(l_partkey % 50 AS STRING) || '.example.net' WHEN 1 THEN 'D' || CAST(l_partkey AS STRING) || '.example.org'
               WHEN 2 THEN CAST(l_suppkey % 200 + 20 AS STRING) || '.9.8.' || CAST(l_partkey % 250 AS STRING) WHEN 3 THEN 'http://h' || CAST(l_partkey AS STRING) || '.example.com/it''s'
               WHEN 4 THEN md5(CAST(l_partkey AS STRING)) ELSE 'hk' || CAST(l_partkey AS STRING) END AS value,
             CAST(30 + (l_partkey * 7 + l_suppkey) % 66 AS INT) AS confidence, EPOCH(l_shipdate) AS first_seen_s,
             'line ' || CAST(l_linenumber AS STRING) || CASE WHEN l_returnflag = 'R' THEN ', "returned"' ELSE '' END AS context
      FROM lineitem""",
    "v_exposures": """
      SELECT event_id, event_id % 40 AS wave, user_id, 'u' || CAST(user_id AS STRING) || '@corp.example.com' AS email, EPOCH(ts) AS at_s,
             event_type = 'view' AS opened, event_type = 'click' AS clicked, event_type = 'purchase' AS submitted, event_type = 'error' AS reported
      FROM events""",
    "v_staff": """
      SELECT 'U' || CAST(c_custkey AS STRING) || '@corp.example.com' AS email, c_name AS name, c_mktsegment AS department,
             CASE c_custkey % 8 WHEN 0 THEN 'CFO' WHEN 1 THEN 'Payroll manager' WHEN 2 THEN 'Director of sales' ELSE 'Analyst' END AS role
      FROM customer WHERE c_custkey % 10 <> 9""",
    "v_custody": """
      SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_type AS kind,
             sha256(props || CAST(event_id AS STRING)) AS payload_hash, EPOCH(ts) AS at_s, event_id
      FROM events""",
    "v_intel": """
      SELECT CASE event_id % 3 WHEN 0 THEN 'abuseipdb' WHEN 1 THEN 'virustotal' ELSE 'whois' END AS provider, user_id AS subject, EPOCH(ts) AS queried_s, CAST(value AS DOUBLE) AS score, event_id
      FROM events WHERE event_type <> 'click'""",
    "v_answers": """
      SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'abuseipdb' WHEN 1 THEN 'whois' WHEN 2 THEN 'virustotal' WHEN 3 THEN 'dnsbl' WHEN 4 THEN 'dns' WHEN 5 THEN 'rdns' ELSE 'other' END AS provider, 's' || CAST(user_id AS STRING) AS subject, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
             'seen by ' || event_type AS summary, 'cache' AS source, '{' || CASE event_id % 7 WHEN 0 THEN '"abuse_confidence_score": ' || CAST(user_id % 101 AS STRING) || ', "total_reports": ' || CAST(event_id % 13 AS STRING) || CASE event_id % 3 WHEN 0 THEN ', "is_tor": true' WHEN 1 THEN ', "is_tor": false' ELSE '' END
               WHEN 1 THEN CASE event_id % 5 WHEN 0 THEN '"domain_age_days": null' WHEN 1 THEN '"domain_age_days": "3"' ELSE '"created": "2024-01-0' || CAST(event_id % 9 AS STRING) || '", "domain_age_days": ' || CAST(user_id % 60 AS STRING) END
               WHEN 2 THEN '"malicious": ' || CAST(event_id % 9 AS STRING) || CASE WHEN event_id % 2 = 0 THEN ', "suspicious": ' || CAST(user_id % 3 AS STRING) ELSE '' END
               WHEN 3 THEN '"listed_count": ' || CAST(event_id % 3 AS STRING) || ', "listed_on": [' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"a.example"' ELSE '"a.example", "b.example"' END || ']'
               WHEN 4 THEN '"notes": [' || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '"no SPF record"' ELSE '"no SPF record", "no DMARC record"' END || ']'
               WHEN 5 THEN '"ptr": [' || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '"h1.example"' ELSE '"h1.example", "h2.example", "h3.example"' END || '], "forward_confirmed": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END ELSE '"x": 1' END || '}' AS data
      FROM events""",
    "v_networks": """
      SELECT s_suppkey AS ord, CASE s_suppkey % 6 WHEN 0 THEN CAST(20 + s_suppkey % 200 AS STRING) || '.7.0.0/16' WHEN 1 THEN CAST(20 + s_suppkey % 200 AS STRING) || '.7.' || CAST(s_suppkey % 250 AS STRING) || '.0/24' WHEN 2 THEN CAST(20 + s_suppkey % 200 AS STRING) || '.0.0.0/9' WHEN 3 THEN CAST(20 + s_suppkey % 200 AS STRING) || '.7.' || CAST(s_suppkey % 250 AS STRING) || '.' || CAST(s_suppkey % 7 AS STRING) || '/32'
             WHEN 4 THEN '2001:db8:' || CAST(s_suppkey % 90 AS STRING) || '::/48' ELSE CASE WHEN s_suppkey % 5 = 0 THEN '0.0.0.0/0' WHEN s_suppkey % 5 = 1 THEN '::/0' ELSE '2001:db8::/32' END END AS cidr
      FROM supplier""",
    "v_addresses": """
      SELECT l_orderkey AS id, CASE WHEN l_partkey % 9 = 0 THEN '2001:db8:' || CAST(l_suppkey % 99 AS STRING) || '::' || CAST(l_partkey % 50 AS STRING) WHEN l_partkey % 9 = 1 THEN '2A00:1450:4001:81b::200' || CAST(l_suppkey % 9 AS STRING) ELSE CAST(20 + l_suppkey % 200 AS STRING) || '.7.' || CAST(l_suppkey % 250 AS STRING) || '.' || CAST(l_partkey % 7 AS STRING) END AS ip
      FROM lineitem WHERE l_linenumber = 1""",
    "v_lookups": """
      SELECT event_id AS lookup_id, CASE event_id % 3 WHEN 0 THEN 'abuseipdb' WHEN 1 THEN 'virustotal' ELSE 'whois' END AS provider, user_id AS subject, EPOCH(ts) AS at_s
      FROM events WHERE event_type = 'click'""",
    "v_messages": """
      SELECT d.doc_id AS msg_id, coalesce(d.text, '') AS body, split_part(coalesce(d.text, ''), chr(10), 1) AS subject, d.lang, d.source, d.source || '.example.com' AS from_domain,
             1704067200 + d.doc_id * 60 AS received_s, l.quality, l.toxic, CASE WHEN l.quality IS NULL THEN NULL ELSE l.quality + 2 * l.toxic END AS label
      FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id""",
    "v_urls": """
      SELECT page_id, CASE page_id % 11 WHEN 0 THEN 'http://20.1.2.' || CAST(page_id % 250 AS STRING) || '/login?next=/x' WHEN 1 THEN 'https://bit.ly/x' || CAST(page_id AS STRING) || ').' WHEN 2 THEN url || '/secure/login'
               WHEN 3 THEN 'http://user@xn--80ak6aa92e.com:8080/verify?u=a' WHEN 4 THEN 'https://paypa1.com.top/update.exe' WHEN 5 THEN 'www.ThHer' || CAST(page_id % 40 AS STRING) || '.co.uk/a%20b' WHEN 6 THEN 'https://a.b.c.d.blogspot.com/account/pay'
               WHEN 7 THEN 'https://g00gle.com/?q=QWxhZGRpbjpvcGVuIHNlc2FtZQQWxhZGRpbjpv' ELSE url END AS url, html
      FROM pages""",
    "v_mail": """
      SELECT doc_id AS msg_id, coalesce(text, '') AS body, source || '.example.com' AS from_domain, lang, source,
             CASE doc_id % 5 WHEN 0 THEN 'PayPal Support' WHEN 1 THEN 'Micros0ft Team' WHEN 2 THEN 'Jane Doe <jane@other.org>' ELSE 'Staff ' || source END AS from_name,
             CASE doc_id % 3 WHEN 0 THEN 'RE: ' WHEN 1 THEN 'Fwd: ' ELSE '' END || 'Invoice ' || CAST(doc_id AS STRING) || ' ' || substr(split_part(coalesce(text, ''), chr(10), 1), 1, 30) AS subject,
             'mx.corp.example.com; spf=' || CASE doc_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'pass' ELSE 'none' END || ' smtp.mailfrom=bounce@' || CASE doc_id % 6 WHEN 0 THEN 'bulk.example.net' ELSE 'm.' || source || '.example.com' END
               || '; dkim=' || CASE doc_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'none' END || ' header.d=' || source || '.example.com' || CASE doc_id % 7 WHEN 0 THEN '; dmarc=pass' WHEN 1 THEN '; dmarc=fail' ELSE '' END AS auth_header,
             'from mail.' || source || '.example.com (helo [20.7.' || CAST(doc_id % 250 AS STRING) || '.9]) by mx.corp.example.com with ESMTPS id ' || CAST(doc_id AS STRING) || '; Tue, ' || CAST(1 + doc_id % 28 AS STRING) || ' Jan 2024 '
               || lpad(CAST(doc_id % 24 AS STRING), 2, '0') || ':' || lpad(CAST(doc_id % 60 AS STRING), 2, '0') || ':00 +0100' AS received_header,
             CASE doc_id % 8 WHEN 0 THEN 'invoice.pdf' WHEN 1 THEN 'Invoice.PDF.exe' WHEN 2 THEN 'macro.xlsm' WHEN 3 THEN 'a.zip' WHEN 4 THEN 'photo.jpg' WHEN 5 THEN 'report.docx' WHEN 6 THEN 'noextension' ELSE '' END AS attachment,
             CASE doc_id % 5 WHEN 0 THEN '255044462D31' WHEN 1 THEN '4D5A9000' WHEN 2 THEN '504B0304' WHEN 3 THEN 'FFD8FFE0' ELSE '00000000' END AS first_bytes
      FROM documents""",
    "v_parsed": """
      SELECT doc_id AS msg_id, coalesce(text, '') AS body, CASE doc_id % 17 WHEN 0 THEN 'URGENT INVOICE NOTICE' WHEN 1 THEN 'Wire transfer instructions' ELSE 'Invoice ' || CAST(doc_id AS STRING) || ' ' || substr(split_part(coalesce(text, ''), chr(10), 1), 1, 30) END AS subject,
             CASE doc_id % 5 WHEN 0 THEN 'PayPal Support' WHEN 1 THEN 'Microsоft Tëam' WHEN 2 THEN 'Jane Doe <jane@other.org>' ELSE 'Staff' END AS from_name,
             'u' || CAST(doc_id AS STRING) || '@' || CASE doc_id % 13 WHEN 0 THEN 'paypa1.com' WHEN 1 THEN 'microsft.com' WHEN 2 THEN 'xn--80ak6aa92e.com' WHEN 3 THEN 'gmail.com' WHEN 4 THEN 'login7.example.top' ELSE coalesce(source, 'none') || '.example.com' END AS from_address,
             CASE doc_id % 13 WHEN 0 THEN 'paypa1.com' WHEN 1 THEN 'microsft.com' WHEN 2 THEN 'xn--80ak6aa92e.com' WHEN 3 THEN 'gmail.com' WHEN 4 THEN 'login7.example.top' ELSE coalesce(source, 'none') || '.example.com' END AS from_domain,
             CASE doc_id % 7 WHEN 0 THEN 'pay@gmail.com' WHEN 1 THEN 'help@support.example.org' ELSE '' END AS reply_to, CASE doc_id % 6 WHEN 0 THEN 'bounce@bulk.example.net' WHEN 1 THEN 'b@m.example.com' ELSE '' END AS return_path,
             CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN '<m' || CAST(doc_id AS STRING) || '@bulk.example.net>' ELSE '<m' || CAST(doc_id AS STRING) || '@mail.example.com>' END AS message_id, CASE doc_id % 12 WHEN 0 THEN 'PHPMailer 6' WHEN 1 THEN 'Outlook' ELSE '' END AS x_mailer,
             CAST(CASE doc_id % 15 WHEN 0 THEN 0 WHEN 1 THEN 25 ELSE 1 + doc_id % 3 END AS INT) AS n_to, CAST(CASE WHEN doc_id % 15 = 2 THEN 21 ELSE 0 END AS INT) AS n_cc, CAST(doc_id % 6 AS INT) AS n_received, doc_id % 14 = 0 AS has_qr,
             'mx; spf=' || CASE doc_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'pass' ELSE 'none' END || ' smtp.mailfrom=bounce@' || CASE doc_id % 6 WHEN 0 THEN 'bulk.example.net' ELSE 'm.example.com' END || '; dkim=' || CASE doc_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'none' END
               || ' header.d=example.com' || CASE doc_id % 7 WHEN 0 THEN '; dmarc=pass' WHEN 1 THEN '; dmarc=fail' ELSE '' END || CASE doc_id % 8 WHEN 0 THEN '; arc=fail; arc=pass' WHEN 1 THEN '; arc=pass; arc=fail' ELSE '' END AS auth_header,
             CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'http://20.1.2.3/login|Sign in' WHEN 2 THEN 'https://evil.example.top/verify?x=1|https://bank.example.com/verify' || chr(10) || 'https://bit.ly/abc.|here' WHEN 3 THEN 'https://xn--80ak6aa92e.com/a|www.example.org'
               WHEN 4 THEN 'https://g00gle.com/q|' || chr(10) || 'https://googel.com/account|x' WHEN 5 THEN 'https://paypall.com/|Pay' WHEN 6 THEN repeat('https://cdn.example.com/img|x' || chr(10), 16) ELSE '' END AS link_lines,
             CASE doc_id % 8 WHEN 0 THEN 'invoice.pdf|255044462D31' WHEN 1 THEN 'Invoice.PDF.exe|4D5A9000' || chr(10) || 'a.zip|504B0304' WHEN 2 THEN 'macro.xlsm|504B0304' WHEN 3 THEN 'old.doc|255044462D31' WHEN 4 THEN 'photo.jpg|4D5A9000' ELSE '' END AS file_lines,
             CASE doc_id % 10 WHEN 0 THEN '<p style="display:none">x</p><b>' || substr(coalesce(text, ''), 1, 60) || '</b>' WHEN 1 THEN '<img src="cid:1" alt="' || repeat('a', 500) || '">' ELSE '' END AS body_html
      FROM documents""",
    "v_relays": """
      SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'tor-exit' || CAST(p_partkey AS STRING) || '.dyn.example.net' WHEN 2 THEN 'vps.cloud.example.com' WHEN 3 THEN 'tor-relay.example.org' WHEN 4 THEN 'offshorehost.example.com' ELSE replace(p_name, ' ', '-') END AS host,
             CASE p_partkey % 7 WHEN 0 THEN '10.1.2.' WHEN 1 THEN '8.8.8.' WHEN 2 THEN '203.0.113.' WHEN 3 THEN '100.70.1.' ELSE '20.7.9.' END || CAST(p_partkey % 250 AS STRING) AS ip,
             CASE p_partkey % 5 WHEN 0 THEN 'Hetzner Online' WHEN 1 THEN 'Google Cloud' WHEN 2 THEN 'Mullvad VPN' ELSE '' END AS isp, p_partkey % 7 = 1 AS cloud
      FROM part""",
    "v_html": """
      SELECT page_id, replace(coalesce(html, ''), 'href="/', 'href="https://site' || CAST(page_id % 50 AS STRING) || '.example.com/') AS html FROM pages""",
}


def resolve(text: str, duck: bool) -> str:
    """The few names that differ between the engines."""
    text = re.sub(r"EPOCH\((\w+)\)", r"(epoch_us(\1) // 1000000)" if duck else r"unix_timestamp(\1)", text)
    return text if duck else re.sub(r"\bsha256\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"sha2(\1, 256)", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter view over the tables in ``sf_dir``."""
    text = resolve(VIEWS[name], duck=False)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """A DuckDB query with the definitions of the views it names in front."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    defs = ", ".join(f"{n} AS ({resolve(VIEWS[n], duck=True)})" for n in names)
    sql = sql.strip()
    if not names:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {defs}, {sql[15:]}"
    return f"WITH {defs}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {defs} {sql}"
