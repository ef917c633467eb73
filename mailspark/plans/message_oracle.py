"""DuckDB twins of the message queries, over the same adapter views."""

from __future__ import annotations

from mailspark.plans import expected as E


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def tup(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


def reg(h: str) -> str:
    p = f"list_filter(string_split(lower({h}), '.'), lambda z: z <> '')"
    return f"(CASE WHEN len({p}) < 3 THEN array_to_string({p}, '.') WHEN {p}[-2] IN {tup(E.SECOND_LEVEL)} AND length({p}[-1]) <= 3 THEN array_to_string({p}[-3:], '.') ELSE array_to_string({p}[-2:], '.') END)"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\r\n\f]+', ' ', 'g'))"


def strip(x: str) -> str:
    return unescape(rf"regexp_replace({x}, '(?s)<script.*?</script\s*>|<style.*?</style\s*>|<[^>]+>', ' ', 'g')")


def unescape(x: str) -> str:
    for name, char in E.ENTITIES:
        x = f"replace({x}, {q(name)}, {q(char)})"
    return x


def ends_off(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def skeleton(x: str) -> str:
    many, one = E.compatible()
    x = f"translate(lower({x}), {q(many)}, {q(one)})"
    for a, b in E.LIGATURES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"translate(replace(replace({x}, 'rn', 'm'), 'vv', 'w'), {q(E.CONFUSABLE_FROM)}, {q(E.CONFUSABLE_TO)})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9$£€!?'']+'), lambda z: z <> '')"


def grams(n: int) -> str:
    """Over a column w of words."""
    return "w" if n == 1 else "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


U = """u AS (SELECT page_id, CASE WHEN starts_with(lower(t), 'www.') THEN 'http://' || t ELSE t END AS u FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '[.,;:!?)"''\\]]+$', '') AS t FROM v_urls)),
  up AS (SELECT page_id, u, lower(CASE WHEN contains(u, '://') THEN split_part(u, '://', 1) ELSE 'http' END) AS scheme, split_part(regexp_replace(u, '^.*?://', ''), '/', 1) AS netloc, regexp_extract(regexp_replace(u, '^.*?://', ''), '^[^/]*(.*)$', 1) AS path FROM u),
  uh AS (SELECT *, lower(split_part(list_last(string_split(netloc, '@')), ':', 1)) AS host FROM up)"""
IP = r"'^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$'"
FLAGS = {
    "is_ip_literal": f"regexp_matches(host, {IP})", "is_punycode": "contains(host, 'xn--')", "is_shortener": f"{reg('host')} IN {tup(E.SHORTENERS)}", "is_http": "scheme = 'http'", "long_path": "length(path) > 120",
    "credential_path": "regexp_matches(lower(path), 'login|signin|verify|secure|account|update|password|mfa|otp')",
}
REASON = ["host is a raw IP literal, not a domain name", "internationalised (punycode) domain", "URL shortener conceals the destination", "plaintext http", "unusually long path", "credential-collection path keyword"]
def _any(x: str, items) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(i)})" for i in items) + ")"


def _brand(x: str, parts: bool) -> str:
    return "CASE " + " ".join(f"WHEN {_any(x, names)}" + (f" OR list_contains(parts, {q(b)})" if parts else "") + f" THEN {q(b)}" for b, names in E.BRAND_NAMES.items()) + " ELSE '' END"


STATIC = rf"""{U}, s1 AS (SELECT page_id, u AS url, CASE WHEN contains(u, '://') THEN u ELSE 'http://' || u END AS w FROM u),
  s2 AS (SELECT *, regexp_extract(w, '^[^:]*://([^/?#]*)', 1) AS au, regexp_extract(w, '^[^:]*://[^/?#]*([^#]*)', 1) AS rest FROM s1),
  s3 AS (SELECT *, lower(regexp_replace(list_last(string_split(au, '@')), ':\d*$', '')) AS host, regexp_extract(au, ':(\d+)$', 1) AS port, split_part(rest, '?', 1) AS rp, regexp_extract(rest, '\?(.*)$', 1) AS rq FROM s2),
  s4 AS (SELECT *, url_decode(rp) AS p, url_decode(rq) AS qs, lower(url_decode(rp) || '?' || url_decode(rq)) AS low, string_split_regex(host, '[._-]') AS parts, len(string_split(host, '.')) AS labels, CASE WHEN contains(host, '.') THEN list_last(string_split(host, '.')) ELSE '' END AS tld FROM s3),
  s5 AS (SELECT *, list_sort(list_filter({lst(E.LOGIN_WORDS)}, lambda x: contains(low, x))) AS login, list_sort(list_filter({lst(E.REDIRECT_PARAMS)}, lambda x: contains('&' || lower(qs), '&' || x || '='))) AS redirect,
    {_brand('host', True)} AS inhost, {_brand('low', False)} AS inpath, list_filter({lst(E.RISKY_ENDINGS)}, lambda x: ends_with(split_part(low, '?', 1), x))[1] AS ending FROM s4),
  s6 AS (SELECT *, CASE WHEN inhost <> '' THEN inhost ELSE inpath END AS brand, regexp_matches(host, {IP}) AS ipv4 FROM s5)"""
_SAY = {
    "ipv4": "'host is a bare IPv4 address, not a hostname'", "regexp_matches(host, '^(0x[0-9a-f]+|[0-9]+)$')": "'host is written in a non-dotted numeric form (obfuscation)'", "contains(host, 'xn--')": "'punycode host: renders as a non-ASCII lookalike'",
    "contains(au, '@')": "'userinfo before @ hides the real host from the reader'", "port NOT IN ('', '80', '443', '0')": "'non-standard port ' || port", "labels >= 5": "'deep subdomain nesting (' || labels || ' labels) pads the visible host'",
    f"tld IN {tup(E.BAD_TLDS)}": "'high-abuse TLD .' || tld", _any("host", E.FREE_HOSTS): "'hosted on a free/consumer platform rather than corporate infrastructure'", "lower(split_part(w, '://', 1)) = 'http'": "'plain HTTP: any submitted credential travels in clear text'",
    "inhost = '' AND inpath <> ''": "'brand name ' || chr(39) || inpath || chr(39) || ' appears in the path, not the domain'", "len(login) > 0": "'credential-collection keywords in the path: ' || array_to_string(login[1:5], ', ')",
    "brand <> '' AND len(login) > 0": "'brand ' || chr(39) || brand || chr(39) || ' combined with a sign-in style path'", "len(redirect) > 0": "'open-redirect style parameter(s): ' || array_to_string(redirect, ', ')",
    "regexp_matches(qs, '[A-Za-z0-9+/=]{24,}') OR regexp_matches(p, '[A-Za-z0-9+/=]{24,}')": "'long base64-like blob in the URL (often the encoded victim address)'", "contains(rp || rq, '%')": "'percent-encoding used inside the path or query'",
    "ending IS NOT NULL": "'URL ends in ' || ending || ': direct payload download'", "length(url) > 180": "'unusually long URL (' || length(url) || ' characters)'",
}
_SAID = "list_filter([" + ", ".join(f"CASE WHEN {test} THEN {said} END" for test, said in _SAY.items()) + "], lambda z: z IS NOT NULL)"
_CASES = lambda d: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for n, c in d.items()) + "], lambda z: z IS NOT NULL)"
_KV = lambda k: rf"CASE WHEN regexp_extract(auth_header, '(?i)\b{k}\s*=\s*([a-z]+)', 1) = '' THEN 'unknown' ELSE lower(regexp_extract(auth_header, '(?i)\b{k}\s*=\s*([a-z]+)', 1)) END"
def auth(source: str) -> str:
    return AUTH.replace("FROM v_mail", f"FROM {source}")


AUTH = rf"""a0 AS (SELECT *, lower(coalesce(list_last(regexp_extract_all(auth_header, '(?i)\barc\s*=\s*([a-z]+)', 1)), 'unknown')) AS arc, {_KV('spf')} AS spf, {_KV('dkim')} AS dkim, {_KV('dmarc')} AS dm, lower(list_last(string_split(regexp_extract(auth_header, '(?i)smtp\.mailfrom=([^\s;]+)', 1), '@'))) AS spf_domain, lower(regexp_extract(auth_header, '(?i)header\.d=([^\s;]+)', 1)) AS dkim_domain FROM v_mail),
  a1 AS (SELECT *, CASE WHEN spf_domain <> '' THEN {reg('spf_domain')} = {reg('from_domain')} END AS spf_aligned, CASE WHEN dkim_domain <> '' THEN {reg('dkim_domain')} = {reg('from_domain')} END AS dkim_aligned FROM a0),
  au AS (SELECT *, CASE WHEN dm <> 'unknown' THEN dm WHEN (spf = 'pass' AND spf_aligned IS TRUE) OR (dkim = 'pass' AND dkim_aligned IS TRUE) THEN 'pass' WHEN spf <> 'unknown' OR dkim <> 'unknown' THEN 'fail' ELSE 'unknown' END AS dmarc FROM a1)"""
_EXT = "CASE WHEN contains(attachment, '.') THEN lower(list_last(string_split(attachment, '.'))) ELSE '' END"
_MAGIC = "CASE " + " ".join(f"WHEN starts_with(first_bytes, '{m}') THEN '{k}'" for m, k in E.MAGIC) + " ELSE 'unknown' END"
_FILE = rf"""regexp_matches(lower(attachment), '\.(pdf|doc|docx|xls|xlsx|jpg|png|txt|zip)\.[a-z0-9]{{2,4}}$') AS double_extension,
    (extension = 'pdf' AND detected_type NOT IN ('pdf', 'unknown')) OR (extension IN ('doc', 'xls', 'ppt') AND detected_type NOT IN ('ole2-office', 'unknown')) OR (extension IN ('docx', 'xlsx', 'pptx') AND detected_type NOT IN ('zip-container', 'unknown'))
      OR (detected_type IN ('pe-executable', 'elf-executable') AND extension NOT IN {tup(E.EXECUTABLE)}) AS mismatch,
    extension IN {tup(E.ARCHIVE)} OR detected_type IN ('zip-container', 'rar', '7z') AS is_archive, extension IN {tup(E.MACRO)} AS is_macro, extension IN {tup(E.EXECUTABLE)} OR detected_type IN ('pe-executable', 'elf-executable') AS is_executable"""
ATT = f"""t0 AS (SELECT msg_id, attachment, {_EXT} AS extension, {_MAGIC} AS detected_type FROM v_mail), att AS (SELECT *, {_FILE} FROM t0)"""
_CAPS = lambda x: rf"CASE WHEN length(regexp_replace({x}, '\P{{L}}', '', 'g')) >= 8 THEN length(regexp_replace({x}, '\P{{Lu}}', '', 'g')) / length(regexp_replace({x}, '\P{{L}}', '', 'g')) ELSE 0e0 END"
_MASK = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\b([A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]*@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b', '\1***@\2', 'g'),
  '\b\d(?:[ \-]?\d){8,14}([ \-]?\d[ \-]?\d[ \-]?\d[ \-]?\d)\b', 'NUMBER-********\1', 'g'), '\b(\d{2})[A-Z]{5}\d{4}[A-Z]\d[A-Z\d]Z([A-Z\d])\b', 'GSTIN-\1***********\2', 'g'), '\b([A-Z]{2})[A-Z]{3}\d{4}([A-Z])\b', 'PAN-\1******\2', 'g'), '\b([A-Z]{4})0[A-Z0-9]{6}\b', 'IFSC-\1*******', 'g')"""
_COUNT = lambda x, p: f"len(regexp_extract_all({x}, {q(p)}))"
_MARK = lambda x, p: rf"regexp_replace({x}, '(^|\D){p}($|\D)', '\1' || chr(1) || '\2', 'g')"


def pii_count(x: str, kind: str) -> str:
    """Matches; those that no digit may touch are marked in two passes, since two neighbours share the character between them."""
    p = E.PII[kind]
    return f"(length({_MARK(_MARK(x, p), p)}) - length(replace({_MARK(_MARK(x, p), p)}, chr(1), '')))" if kind in E.PII_ALONE else _COUNT(x, p)


_HAS = lambda n: f"regexp_matches(lower(body), {q(E.PATTERNS[n])})"
_STRUCT = {
    "feat_suspicious_attachment_ext": f"{_HAS('risky_extension')} OR {_HAS('payload_context')}", "feat_enable_macro_content": _HAS("enable_macro"), "feat_url_shortener": _HAS("shortener"), "feat_financial_iban_swift_routing": _HAS("financial"),
    "feat_currency_amounts": _HAS("currency"), "feat_time_bound_urgency": _HAS("urgency"), "feat_today_eod_deadline": _HAS("deadline"), "feat_executive_authority_pattern": _HAS("executive"), "feat_secrecy_confidential_pattern": _HAS("secrecy"),
    "feat_malware_file_ext_mentions": _HAS("file_mention"), "feat_malware_execution_instructions": _HAS("execution"), "feat_malware_password_protected_archive": _HAS("archive_password"), "feat_bec_wire_transfer_account_details": _HAS("wire_details"),
    "feat_bec_person_to_person_instruction": _HAS("pay_instruction"), "feat_bec_confidentiality_no_attachment": f"{_HAS('confidential')} AND NOT {_HAS('file_mention')}", "feat_malware_download_link_ext": _HAS("file_link"),
    "feat_malware_urgency_file_lure": f"{_HAS('urgent_word')} AND {_HAS('file_word')} AND {_HAS('dangerous_file')}",
}
_STRUCT = {n: f"CAST(({c}) AS DOUBLE)" for n, c in _STRUCT.items()} | {
    "feat_url_count": r"round(least(len(regexp_extract_all(lower(body), 'https?://|www\.')) / 5e0, 1e0), 6)", "feat_text_length_ratio": "round(least(length(body) / 2500e0, 1e0), 6)", "feat_exclamation_count": "round(least((length(body) - length(replace(body, '!', ''))) / 5e0, 1e0), 6)",
    "feat_all_caps_word_count": r"round(least(len(list_filter(string_split_regex(body, '[ \t\r\n\f]+'), lambda w: length(w) >= 4 AND w = upper(w) AND w <> lower(w))) / 5e0, 1e0), 6)",
}


def tc(source: str, idc: str, x: str, n: int, name: str = "tc") -> str:
    return f"{name} AS (SELECT id, term, count(*) AS c FROM (SELECT id, unnest({grams(n)}) AS term FROM (SELECT {idc} AS id, {words(x)} AS w FROM {source})) GROUP BY ALL)"


FIT = lambda n: f"""{tc('v_mail', 'msg_id', 'body', n)}, nn AS (SELECT count(*) AS n FROM v_mail),
  vo AS (SELECT term, df, ln((1 + n) / (1e0 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tc GROUP BY 1), nn WHERE df >= 2 AND df <= 0.85e0 * n ORDER BY df DESC, term LIMIT 5000)"""  # noqa: E731
VEC = """tw AS (SELECT id, term, (1 + ln(c)) * idf AS w FROM tc JOIN vo USING (term)), tn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM tw GROUP BY 1), tv AS (SELECT id, term, w / norm AS w FROM tw JOIN tn USING (id))"""
_LW = lambda x: f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\\s''\\-]', ' ', 'g'), '\\s+'), lambda z: z <> '')"
LM = f"""lw AS (SELECT {_LW('body')} AS w FROM v_mail WHERE lang = 'en'), lb AS (SELECT w[i] AS w1, w[i + 1] AS w2 FROM (SELECT w, unnest(range(1, len(w))) AS i FROM lw)), lu AS (SELECT w1, count(*) AS u FROM (SELECT unnest(w) AS w1 FROM lw) GROUP BY 1),
  lm AS (SELECT w1, w2, round(ln((c + 1e0) / (u + 800)), 5) AS logp FROM (SELECT w1, w2, count(*) AS c FROM lb GROUP BY ALL) JOIN lu USING (w1))"""
TURN = "tu AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS text FROM conversations)"
PPL = f"""{TURN}, pw AS (SELECT id, {_LW('text')} AS w FROM tu), pb AS (SELECT id, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM pw)), lx AS (SELECT DISTINCT w1, u FROM lu WHERE w1 IN (SELECT w1 FROM lm)),
  pm AS (SELECT id, avg(coalesce(logp, ln(1e0 / (coalesce(u, 0) + 800)))) AS m, count(*) AS k FROM pb LEFT JOIN lm USING (w1, w2) LEFT JOIN lx USING (w1) GROUP BY 1),
  pp AS (SELECT id, CASE WHEN k >= 2 THEN round(exp(-m), 2) ELSE 999e0 END AS perplexity FROM tu LEFT JOIN pm USING (id))"""
BURST = r"""bs AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(10) || '\2', 'g'), '\n+', chr(10), 'g'), chr(10)), lambda s: len(list_filter(string_split_regex(s, '\s+'), lambda z: z <> ''))), lambda n: n >= 2) AS l FROM tu),
  bu AS (SELECT id, CASE WHEN len(l) < 2 THEN 0e0 ELSE round((list_stddev_samp(l) - list_avg(l)) / (list_stddev_samp(l) + list_avg(l)), 4) END AS burstiness FROM bs)"""
LAB = "la AS (SELECT msg_id AS id, label, body, md5('s' || msg_id) AS o FROM v_messages WHERE label IS NOT NULL), rn AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY o, id) AS r, count(*) OVER (PARTITION BY label) AS k FROM la)"
_SP = lambda n: f"regexp_matches(lower(body), {q(E.SPEAR[n])})"
_STY = " + ".join(f"regexp_matches(lower(body), {q(p)})::INT" for p in E.STYLE)
_LEV = "CASE " + " ".join(f"WHEN levenshtein(label, '{b}') BETWEEN 1 AND {max(1, len(b) // 5)} THEN '{b}'" for b in E.BRANDS) + " END"
_BIN = "CASE " + " ".join(f"WHEN contains(n, '{b}') AND NOT contains(d, '{b}') THEN '{b}'" for b in E.BRANDS) + " END"
_INFRA = (
    "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(host, {q(p)}) THEN {q(t)} END" for p, t in E.HOSTNAMES) + ", " + ", ".join(f"CASE WHEN regexp_matches(isp, {q(p)}) THEN {q(t)} END" for p, t in E.PROVIDERS)
    + ", CASE WHEN p_partkey % 7 = 2 THEN 'address is from a reserved documentation range (RFC 5737/3849), so it is either synthetic test traffic or a forged header' WHEN p_partkey % 7 = 3 THEN 'carrier-grade NAT range: the address maps to many subscribers'"
    + " WHEN p_partkey % 7 = 0 THEN 'non-routable address: this hop is inside a private network' END, CASE WHEN cloud THEN 'address belongs to a large cloud provider (' || isp || ')' END, CASE WHEN host = '' AND p_partkey % 7 <> 0 THEN 'no reverse DNS name presented for this hop' END"
    + "], lambda z: z IS NOT NULL)))"
)
_NEAR_BRAND = lambda x: "(" + " OR ".join(f"levenshtein({x}, '{b}') BETWEEN 1 AND {max(1, len(b) // 5)}" for b in E.BRANDS) + ")"
_AW = lambda x: rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda z: length(z) >= 2)"
_NG = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


def near(source: str) -> str:
    """Over a relation (id, text): n5 (id, one column for each anchor)."""
    texts = ", ".join(f"({q(k)}, {q(t)})" for k, t in E.ANCHORS.items())
    return f"""an(anchor, text) AS (VALUES {texts}), ac AS (SELECT anchor, term, count(*) AS c FROM (SELECT anchor, unnest({_NG}) AS term FROM (SELECT anchor, {_AW('text')} AS w FROM an)) GROUP BY ALL),
      ai AS (SELECT term, ln(6e0 / (1 + count(*))) + 1 AS idf FROM ac GROUP BY 1), av AS (SELECT anchor, term, idf, (1 + ln(c)) * idf / sqrt(sum(((1 + ln(c)) * idf) ** 2) OVER (PARTITION BY anchor)) AS w FROM ac JOIN ai USING (term)),
      mt AS (SELECT id, term, (1 + ln(count(*))) * any_value(idf) AS d FROM (SELECT id, unnest({_NG}) AS term FROM (SELECT id, {_AW('text')} AS w FROM {source} WHERE length({ends_off('text')}) >= 5)) JOIN ai USING (term) GROUP BY ALL),
      mn AS (SELECT id, sqrt(sum(d * d)) AS norm FROM mt GROUP BY 1),
      n5 AS (SELECT id, {', '.join(f"round(coalesce(sum(d * w) FILTER (anchor = '{k}'), 0) / any_value(norm), 6) AS {k}" for k in E.ANCHORS)} FROM mt JOIN mn USING (id) LEFT JOIN av USING (term) GROUP BY 1)"""


_LURE = {k: (least, name, factor, low, high) for k, least, name, factor, low, high in E.LURES}
_CLAMP = lambda k: f"CAST(greatest({_LURE[k][3]}, least({_LURE[k][4]}, floor({k} * {_LURE[k][2]} + 0.5e0))) AS INT)"
_CUT = lambda x: rf"""regexp_replace({ends_off(x)}, '[.,;:!?)"''\]]+$', '')"""
_NORM = lambda x: f"(CASE WHEN starts_with(lower({_CUT(x)}), 'www.') THEN 'http://' ELSE '' END || {_CUT(x)})"
_HOST = lambda x: f"lower(split_part(list_last(string_split(split_part(regexp_replace({x}, '^.*?://', ''), '/', 1), '@')), ':', 1))"
_DOM = lambda x: f"CASE WHEN contains({x}, '@') THEN lower(list_last(string_split({x}, '@'))) ELSE '' END"
PARSED = rf"""{auth('v_parsed')},
  p1 AS (SELECT *, list_transform(list_filter(string_split(link_lines, chr(10)), lambda x: x <> ''), lambda x: {{'url': split_part(x, '|', 1), 'anchor': regexp_extract(x, '\|(.*)$', 1)}}) AS links, list_filter(string_split(file_lines, chr(10)), lambda x: x <> '') AS files,
    {reg('from_domain')} AS fr, {reg(_DOM('reply_to'))} AS rr, {reg(_DOM('return_path'))} AS br FROM au),
  l0 AS (SELECT msg_id, from_domain, fr, links[i].url AS raw, links[i].anchor AS anchor, i - 1 AS i FROM (SELECT *, unnest(range(1, len(links) + 1)) AS i FROM p1)),
  l1 AS (SELECT msg_id, from_domain, fr, i, {_NORM('raw')} AS url, anchor FROM l0),
  l2 AS (SELECT *, {_HOST('url')} AS host, regexp_extract(regexp_replace(url, '^.*?://', ''), '^[^/]*(.*)$', 1) AS path, {_NORM('anchor')} AS shown FROM l1),
  l3 AS (SELECT *, {reg('host')} AS hr, {_HOST('shown')} AS sh FROM l2),
  lf AS (SELECT *, regexp_matches(host, {IP}) AS is_ip, regexp_matches({ends_off('anchor')}, '(?i)^(https?://|www\.)') AND sh <> '' AND {reg('sh')} <> hr AS mismatch, contains(host, 'xn--') AS puny, hr IN {tup(E.SHORTENERS)} AS short,
    regexp_matches(lower(path), 'login|signin|verify|secure|account|update|password|mfa|otp') AS cred, CASE WHEN contains(host, '.') THEN list_last(string_split(host, '.')) ELSE '' END AS tld, {skeleton("split_part(hr, '.', 1)")} AS label FROM l3),
  f0 AS (SELECT msg_id, files[i] AS f, i - 1 AS i FROM (SELECT *, unnest(range(1, len(files) + 1)) AS i FROM p1)),
  t0 AS (SELECT msg_id, i, split_part(f, '|', 1) AS attachment, regexp_extract(f, '\|(.*)$', 1) AS first_bytes FROM f0),
  t1 AS (SELECT *, {_EXT} AS extension, {_MAGIC} AS detected_type FROM t0), att AS (SELECT *, {_FILE} FROM t1)"""
_SIMPLE = {
    "auth.dmarc_fail": ("dmarc = 'fail'", 230), "auth.dmarc_pass": ("dmarc = 'pass'", -160), "auth.spf_fail": ("spf IN ('fail', 'softfail')", 120), "auth.spf_unaligned": ("spf = 'pass' AND spf_aligned IS FALSE", 155), "auth.dkim_fail": ("dkim = 'fail'", 140),
    "auth.no_auth": ("dkim = 'none' AND spf IN ('none', 'unknown')", 110), "auth.arc_fail": ("arc = 'fail'", 90), "id.name_contains_other_address": ("other <> '' AND other <> from_address", 210),
    "id.brand_impersonation": (" OR ".join(f"(contains(sn, '{b}') AND NOT contains(so, '{b}'))" for b in E.BRANDS), 190), "id.lookalike_domain": (f"label <> '' AND {_NEAR_BRAND('label')}", 240), "id.confusable_chars": ("from_domain <> '' AND sd <> lower(from_domain)", 220),
    "id.punycode_sender": ("contains(from_domain, 'xn--')", 180), "id.returnpath_mismatch": ("br <> '' AND br <> fr", 80), "id.suspicious_tld": (f"list_last(string_split(fr, '.')) IN {tup(E.ABUSED_TLDS)}", 85),
    "id.replyto_divergence": ("reply_to <> '' AND reply_to <> from_address AND rr <> fr", f"CASE WHEN rr IN {tup(E.FREEMAIL)} THEN 170 ELSE 120 END"),
    **{_LURE[k][1]: (f"coalesce({k}, 0) >= {_LURE[k][0]}", _CLAMP(k)) for k in E.ANCHORS}, "nlp.bec_no_payload": ("coalesce(financial, 0) >= 0.08 AND len(links) = 0 AND len(files) = 0", 125), "nlp.shouting_subject": (f"{_CAPS('subject')} > 0.6e0", 55),
    "nlp.hidden_text": (f"regexp_matches(body_html, {q(E.HIDDEN)})", 115), "nlp.image_only": (f"length(body_html) > 400 AND length({ends_off(strip('body_html'))}) < 40 AND len(links) > 0", 95), "nlp.possible_quishing": ("has_qr AND len(links) = 0", 90),
    "url.many": ("len(links) > 15", 45), "hdr.no_message_id": ("message_id = ''", 90), "hdr.message_id_mismatch": (f"message_id <> '' AND from_domain <> '' AND mid <> '' AND {reg('mid')} <> fr", 75), "hdr.no_received": ("n_received = 0", 130),
    "hdr.undisclosed_recipients": ("n_to + n_cc = 0", 70), "hdr.mass_recipients": ("n_to + n_cc > 20", 55), "hdr.bulk_mailer": ("regexp_matches(x_mailer, '(?i)(phpmailer|sendmail-php|mass|bulk|smtplib)')", 105),
}
_LINKED = {
    "url.ip_literal": ("is_ip", 175), "url.anchor_mismatch": ("mismatch", 185), "url.punycode": ("puny", 160), "url.shortener": ("short", 85), "url.lookalike": (f"label <> '' AND {_NEAR_BRAND('label')}", 220), "url.credential_path": ("cred AND hr <> fr", 135),
    "url.bad_tld": (f"tld IN {tup(E.ABUSED_TLDS)}", 80),
}
_FILED = {"att.executable": ("is_executable", 250), "att.double_ext": ("double_extension", 210), "att.type_mismatch": ("mismatch", 180), "att.macro": ("is_macro", 140), "att.archive": ("is_archive", 70)}
_ROWS = lambda table, rules, suffix, where: " UNION ALL ".join(f"SELECT msg_id, '{n}'{suffix} AS signal_id, CAST({w} AS INT) AS w100 FROM {table} WHERE ({c}){where}" for n, (c, w) in rules.items())
RULES = rf"""WITH {PARSED}, nt AS (SELECT msg_id AS id, {ends_off("subject || chr(10) || body")} AS text FROM v_parsed), {near('nt')},
  p2 AS (SELECT *, lower(regexp_extract(from_name, '[\w.+-]+@[\w.-]+\.\w+')) AS other, {skeleton('from_name')} AS sn, {skeleton('fr')} AS so, {skeleton('from_domain')} AS sd, {skeleton("split_part(fr, '.', 1)")} AS label,
    lower(list_last(string_split(regexp_replace(message_id, '^[<>]+|[<>]+$', '', 'g'), '@'))) AS mid FROM p1 LEFT JOIN n5 ON id = msg_id)
  {_ROWS('p2', _SIMPLE, '', '')} UNION ALL {_ROWS('lf', _LINKED, " || '.' || i", ' AND i < 40')} UNION ALL {_ROWS('att', _FILED, " || '.' || i", ' AND i < 20')}"""
_B = lambda c: f"CAST(coalesce({c}, FALSE) AS DOUBLE)"
META = f"""WITH {PARSED}, lm AS (SELECT msg_id, bool_or(is_ip) AS is_ip, bool_or(short) AS short, bool_or(mismatch) AS mism, bool_or(hr <> '' AND hr <> fr) AS offd FROM lf GROUP BY 1), fm AS (SELECT msg_id, bool_or(is_executable) AS ex, bool_or(is_macro) AS ma, bool_or(double_extension) AS dx FROM att GROUP BY 1),
  b AS (SELECT *, CASE WHEN body <> '' THEN body ELSE {strip('body_html')} END AS bo FROM p1 LEFT JOIN lm USING (msg_id) LEFT JOIN fm USING (msg_id))
  SELECT msg_id, {_B("spf IN ('fail', 'softfail')")} AS spf_fail, {_B("spf = 'pass' AND spf_aligned IS FALSE")} AS spf_unaligned, {_B("dkim = 'fail'")} AS dkim_fail, {_B("dkim IN ('none', 'unknown')")} AS dkim_missing, {_B("dmarc = 'fail'")} AS dmarc_fail,
    {_B("dkim IN ('none', 'unknown') AND spf IN ('none', 'unknown')")} AS no_auth, {_B("rr <> '' AND rr <> fr")} AS reply_to_differs, {_B("br <> '' AND br <> fr")} AS return_path_differs, {_B(f"fr IN {tup(E.SENDERS)}")} AS freemail_sender,
    {_B("contains(from_domain, 'xn--')")} AS punycode_sender, {_B("len(links) > 0")} AS has_urls, round(least(1e0, len(links) / 15e0), 6) AS many_urls, {_B("is_ip")} AS url_ip_literal, {_B("short")} AS url_shortener, {_B("mism")} AS url_anchor_mismatch,
    {_B("offd")} AS url_offdomain, {_B("len(files) > 0")} AS has_attachment, {_B("ex")} AS attach_executable, {_B("ma")} AS attach_macro, {_B("dx")} AS attach_double_ext, {_B("n_received = 0")} AS no_received_chain,
    round(least(1e0, n_received / 8e0), 6) AS long_relay_chain, {_B("message_id = ''")} AS no_message_id, {_B(f"body_html <> '' AND {ends_off('body')} = ''")} AS html_only, round({_CAPS('subject')}, 6) AS subject_caps,
    {_B("length(bo) < 250")} AS short_body, round(least(1e0, length(bo) / 6000e0), 6) AS long_body, round(least(1e0, (n_to + n_cc) / 25e0), 6) AS many_recipients, {_B("n_to + n_cc = 0")} AS no_recipients,
    {_B("regexp_matches(split_part(fr, '.', 1), '[0-9]')")} AS digit_domain FROM b"""
_W = lambda t: f"((('0x' || substr(md5({t}), 1, 4))::INT % 201 - 100) / 50e0)"

SQL = {
    "content_hash": "SELECT msg_id, sha256(body) AS sha256 FROM v_mail",
    "address_split": "SELECT msg_id, CASE WHEN contains(a, '@') THEN lower(list_last(string_split(a, '@'))) ELSE '' END AS domain FROM (SELECT msg_id, regexp_extract(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+') AS a FROM v_mail)",
    "registrable_domain": f"WITH {U} SELECT page_id, {reg('host')} AS registrable FROM uh",
    "url_normalise": f"WITH {U} SELECT page_id, u AS normalised, scheme, host, path FROM uh",
    "url_extract": rf"""WITH w AS (SELECT page_id, unnest(l) AS w, unnest(range(len(l))) AS at_ FROM (SELECT page_id, regexp_extract_all(html, {q(E.ANCHOR)}, 0) AS l FROM v_html)),
      g AS (SELECT page_id, at_, regexp_extract(w, {q(E.ANCHOR)}, 1) AS g1, regexp_extract(w, {q(E.ANCHOR)}, 2) AS g2, regexp_extract(w, {q(E.ANCHOR)}, 3) AS g3, regexp_extract(w, {q(E.ANCHOR)}, 4) AS g4 FROM w),
      a AS (SELECT page_id, {unescape("CASE WHEN g1 <> '' THEN g1 WHEN g2 <> '' THEN g2 ELSE g3 END")} AS url, {ends_off(strip('g4'))} AS anchor, 0 AS kind, at_ FROM g),
      b AS (SELECT page_id, unnest(l) AS url, '' AS anchor, 1 AS kind, unnest(range(len(l))) AS at_ FROM (SELECT page_id, regexp_extract_all({strip('html')}, {q(E.LINK)}, 0) AS l FROM v_html)),
      c AS (SELECT page_id, {_NORM('url')} AS url, anchor, kind, at_ FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
      f AS (SELECT page_id, url, anchor, kind, at_ FROM c WHERE NOT regexp_matches(lower(url), '^(mailto:|tel:|cid:|data:)') AND {_HOST('url')} <> '' QUALIFY row_number() OVER (PARTITION BY page_id, url, anchor ORDER BY kind, at_) = 1)
      SELECT page_id, url, substr(anchor, 1, 200) AS anchor, CASE WHEN kind = 0 THEN 'anchor' ELSE 'body_html' END AS location, CAST(at_ AS INT) AS position FROM f QUALIFY kind = min(kind) OVER (PARTITION BY page_id, url)""",
    "url_flags": f"WITH {U} SELECT page_id, " + ", ".join(f"{c} AS {n}" for n, c in FLAGS.items()) + f", array_to_string({_CASES(dict(zip(REASON, FLAGS.values(), strict=True)))}, ';') AS reasons FROM uh",
    "url_static_verdict": f"""WITH {STATIC}, i AS (SELECT page_id, brand, {_SAID} AS l, ipv4::INT + contains(host, 'xn--')::INT + contains(au, '@')::INT + (ending IS NOT NULL)::INT + (brand <> '' AND len(login) > 0)::INT AS st FROM s6)
      SELECT page_id, array_to_string(l, ';') AS indicators, brand, CASE WHEN st >= 2 THEN 'malicious' WHEN st = 1 OR len(l) >= 3 THEN 'suspicious' WHEN len(l) > 0 THEN 'unknown' ELSE 'clean' END AS verdict FROM i""",
    "html_strip": f"SELECT page_id, sha256({squeeze(strip('html'))}) AS text_sha256 FROM v_html",
    "attachment_flags": f"WITH {ATT} SELECT msg_id, extension, detected_type, double_extension, mismatch, is_archive, is_macro, is_executable FROM att",
    "auth_results": f"WITH {AUTH} SELECT msg_id, spf, dkim, dmarc, arc, spf_domain, dkim_domain, spf_aligned, dkim_aligned FROM au",
    "received_parse": r"""SELECT msg_id, regexp_extract(received_header, '(?i)\bfrom\s+([^\s;()]+)', 1) AS from_host, regexp_extract(received_header, '(?i)\bby\s+([^\s;()]+)', 1) AS by_host, regexp_extract(received_header, '(?i)\bwith\s+([A-Za-z0-9/._-]+)', 1) AS protocol,
      regexp_extract(received_header, '\[(\d+\.\d+\.\d+\.\d+)\]', 1) AS ip, (epoch_us(make_timestamp(2024, 1, 1 + msg_id % 28, msg_id % 24, msg_id % 60, 0)) // 1000000) - 3600 AS ts_s FROM v_mail""",
    "subject_shape": rf"SELECT msg_id, {squeeze(r"regexp_replace(regexp_replace(regexp_replace(lower(subject), '^\s*(re|fw|fwd|aw|sv)\s*:\s*', ''), '[0-9]+', '#', 'g'), '[^a-z#\s]', ' ', 'g')")} AS shape FROM v_mail",
    "campaign_fingerprint": f"""SELECT msg_id, substr(sha256(concat_ws('|', from_domain, lower(trim(from_name)), {squeeze("regexp_replace(lower(subject), '[0-9]+', '#', 'g')")}, 'cdn.example.net,site' || msg_id % 5 || '.example.com', CASE WHEN attachment <> '' THEN sha256(attachment) ELSE '' END)), 1, 32) AS fingerprint FROM v_mail""",
    "confusable_skeleton": f"SELECT msg_id, {skeleton('from_name')} AS skeleton FROM v_mail",
    "lookalike_brand": f"WITH {U}, l AS (SELECT page_id, {skeleton('x')} AS label FROM (SELECT page_id, split_part({reg('host')}, '.', 1) AS x FROM uh)) SELECT page_id, label, CASE WHEN label <> '' THEN {_LEV} END AS brand FROM l",
    "brand_in_name": f"WITH x AS (SELECT msg_id, {skeleton('from_name')} AS n, {skeleton(reg('from_domain'))} AS d FROM v_mail) SELECT msg_id, {_BIN} AS brand FROM x",
    "ip_class": """SELECT s_suppkey, ['10.0', '172.20', '192.168', '127.0', '169.254', '100.70', '192.0', '203.0', '8.8', '300.1'][s_suppkey % 10 + 1] || '.' || CASE s_suppkey % 10 WHEN 6 THEN '2' WHEN 7 THEN '113' ELSE CAST(s_suppkey % 250 AS VARCHAR) END || '.' || s_suppkey % 256 AS ip,
      ['private', 'private', 'private', 'loopback', 'link-local', 'cgnat', 'documentation', 'documentation', 'global', 'invalid'][s_suppkey % 10 + 1] AS class FROM supplier""",
    "infra_indicators": f"SELECT p_partkey, array_to_string({_INFRA}, ';') AS notes FROM v_relays",
    "domain_age": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 6 THEN greatest(0, (1041379200 - (epoch_us(o_orderdate) // 1000000)) // 86400) END AS age_days FROM orders""",
    "pii_inventory": "SELECT msg_id, " + ", ".join(f"{pii_count('body', n)} AS {n}" for n in E.PII) + " FROM v_mail",
    "pii_mask": f"SELECT msg_id, sha256({_MASK}) AS masked_sha256 FROM v_mail",
    "pii_leak_scan": rf"""WITH r AS (SELECT msg_id, regexp_replace({_MASK}, {q(E.MASKED)}, ' ', 'g') AS rest FROM v_mail)
      SELECT msg_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {pii_count('rest', n)} > 0 THEN '{n}' END" for n in sorted(E.PII))}], lambda z: z IS NOT NULL), ';') AS leaks FROM r""",
    "pii_leak_scan_full": "SELECT msg_id, '' AS leaks FROM v_mail",
    "redact_nested": f"SELECT msg_id, '***' AS display_name, sha256({_MASK}) AS text_sha256, sha256(body) AS digest, {_MASK.replace('body', 'subject')} AS line FROM v_mail",
    "text_obfuscation": f"""WITH x AS (SELECT page_id, html, {squeeze(strip('html'))} AS vis, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM v_html)
      SELECT page_id, round({_CAPS('title')}, 6) AS caps_ratio, {_COUNT('html', E.HIDDEN)} AS hidden, length(html) > 400 AND length(vis) < 40 AS image_only FROM x""",
    "mail_text_normalise": f"""WITH x AS (SELECT page_id, {squeeze("concat_ws(' ', url, " + strip("coalesce(html, '')") + ", '[Attachment: ' || page_id || '.pdf]')")} AS t FROM pages) SELECT page_id, sha256(t) AS text_sha256, length(t) AS chars FROM x WHERE length(t) > 30""",
    "ngram_tokens": f"WITH y AS MATERIALIZED (SELECT msg_id, {words('body')} AS w FROM v_mail), x AS (SELECT msg_id, {grams(2)} AS t FROM y) SELECT msg_id, len(t) AS n, sha256(array_to_string(t, '|')) AS tokens_sha256 FROM x",
    "text_document": "SELECT msg_id, sha256(array_to_string(list_filter([subject, from_name, from_domain, body, attachment], lambda z: z <> ''), chr(10))) AS document_sha256 FROM v_mail",
    "meta_features": META,
    "structural_features": "SELECT msg_id, " + ", ".join(f"{c} AS {n}" for n, c in _STRUCT.items()) + " FROM v_mail",
    "tfidf_fit": f"WITH {FIT(2)} SELECT term, df, round(idf, 6) AS idf FROM vo",
    "tfidf_transform": f"WITH {FIT(1)}, {VEC} SELECT id, term, round(w, 6) AS w FROM tv",
    "anchor_similarity": f"""WITH dt AS (SELECT msg_id AS id, body AS text FROM v_mail), {near('dt')} SELECT id, {', '.join(E.ANCHORS)}, {', '.join(f"CASE WHEN {k} >= {_LURE[k][0]} THEN {_CLAMP(k)} END AS {k}_w100" for k in E.ANCHORS)} FROM n5""",
    "bigram_lm_fit": f"WITH {LM} SELECT w1, w2, logp FROM lm",
    "bigram_perplexity": f"WITH {LM}, {PPL} SELECT id, perplexity FROM pp",
    "sentence_burstiness": f"WITH {TURN}, {BURST} SELECT id, burstiness FROM bu",
    "ai_text_score": f"""WITH {LM}, {PPL}, {BURST}, sc AS (SELECT id, CASE WHEN length({ends_off('text')}) < 20 THEN 0.05e0 ELSE greatest(0.01e0, least(0.99e0, round(0.45e0 / (1 + exp((perplexity - 520) / 104e0)) + 0.35e0 / (1 + exp((burstiness + 0.2e0) * 10))
      + 0.2e0 * least(1e0, 0.25e0 * ({' + '.join(f"contains(lower(text), {q(x)})::INT" for x in E.AI_PHRASES)})), 4))) END AS score
      FROM pp JOIN bu USING (id) JOIN tu USING (id)) SELECT id, score, CASE WHEN score >= 0.7e0 THEN 'AI_GENERATED' WHEN score >= 0.45e0 THEN 'LIKELY_AI' ELSE 'HUMAN' END AS verdict FROM sc""",
    "spearphish_score": f"""WITH p AS (SELECT msg_id, CASE WHEN msg_id % 3 IN (0, 1) THEN 35 * ({_SP('framing')} AND {_SP('link')})::INT + 25 * {_SP('authority')}::INT + 20 * {_SP('soft_urgency')}::INT + 30 * ({_SP('internal')} AND ({_SP('credential_ask')} OR {_SP('financial_ask')}))::INT
      + CASE WHEN {_STY} >= 2 THEN 15 * ({_STY}) ELSE 0 END ELSE 0 END AS p FROM v_mail) SELECT msg_id, least(p, 100) / 100e0 AS score, CAST(CASE WHEN p >= 45 THEN 2 ELSE msg_id % 3 END AS INT) AS upgraded_class FROM p""",
    "rule_signals": RULES,
    "message_risk": f"""SELECT msg_id, risk, CASE WHEN risk >= 85 THEN 'critical' WHEN risk >= 65 THEN 'high' WHEN risk >= 40 THEN 'medium' WHEN risk >= 15 THEN 'low' ELSE 'clean' END AS level
      FROM (SELECT msg_id, round(least(99.9e0, greatest(0.1e0, 100 / (1 + exp(-(sum(w100) - 260) / 100e0)))), 1) AS risk FROM ({RULES}) GROUP BY 1)""",
    "takedown_draft": f"""WITH {U}, t AS (SELECT page_id, {reg('host')} AS target FROM uh) SELECT page_id, target, CASE WHEN page_id % 4 = 0 THEN 'registrar' || page_id % 9 || '@abuse.example' ELSE 'abuse@' || target END AS abuse_contact, 'Phishing abuse report - ' || target || ' - case ' || page_id AS subject FROM t""",
    "stratified_split": f"WITH {LAB} SELECT id, label, CASE WHEN r <= floor(k * 0.8e0) THEN 'train' ELSE 'test' END AS split FROM rn",
    "stratified_kfold": f"WITH {LAB} SELECT id, label, CAST((r - 1) % 5 AS INT) AS fold FROM rn",
    "corpus_class_report": f"WITH {LAB}, sp AS (SELECT label, CASE WHEN r <= floor(k * 0.8e0) THEN 'train' ELSE 'test' END AS split FROM rn) SELECT label, split, count(*) AS n, grouping(label, split) AS level FROM sp GROUP BY ROLLUP (label, split)",
    "corpus_stats": """WITH x AS (SELECT count(*) AS rows, round(avg(n), 4) AS mean, round(stddev_samp(n), 4) AS sd, min(n) AS least, max(n) AS most, count(DISTINCT body) AS texts, count(DISTINCT source) AS sources FROM (SELECT *, length(body) AS n FROM v_mail)),
      c AS (SELECT round(max(c) / min(c), 4) AS balance FROM (SELECT count(*) AS c FROM v_messages WHERE label IS NOT NULL GROUP BY label)), s AS (SELECT round(max(c) / sum(c), 6) AS largest_share FROM (SELECT count(*) AS c FROM v_mail GROUP BY source)) SELECT * FROM x, c, s""",
    "corpus_union": "SELECT msg_id, source AS origin FROM v_mail",
    "exact_dedupe": "SELECT msg_id, source FROM v_mail QUALIFY row_number() OVER (PARTITION BY body ORDER BY source, msg_id) = 1",
    "train_test_leakage": "SELECT msg_id AS id FROM v_mail WHERE msg_id % 5 = 0 AND body IN (SELECT body FROM v_mail WHERE msg_id % 5 <> 0)",
    "train_test_containment": """WITH t AS (SELECT msg_id AS id, body AS text FROM v_mail WHERE msg_id % 5 = 0 UNION ALL SELECT -1 - item_id, text FROM benchmark)
      SELECT id FROM t WHERE text <> '' AND EXISTS (SELECT 1 FROM v_mail AS m WHERE m.msg_id % 5 <> 0 AND contains(m.body, t.text))""",
    "near_dup_pairs": f"""WITH {LAB}, {tc('la', 'id', 'body', 1)}, vo AS (SELECT term, ln((1 + (SELECT count(*) FROM la)) / (1e0 + count(*))) + 1 AS idf FROM tc GROUP BY 1), {VEC}, tg AS (SELECT tv.*, label FROM tv JOIN la USING (id))
      SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 4) AS cosine FROM tg AS x JOIN tg AS y ON x.term = y.term AND x.label = y.label AND x.id < y.id GROUP BY ALL HAVING round(sum(x.w * y.w), 6) >= 0.82e0""",
    "feature_means": f"WITH {FIT(1)}, {VEC} SELECT term, round(sum(w) / (SELECT n FROM nn), 6) AS mean FROM tv GROUP BY 1",
    "shap_top_features": f"""WITH {FIT(1)}, {VEC}, mn AS (SELECT term, sum(w) / (SELECT n FROM nn) AS mean FROM tv GROUP BY 1), ph AS (SELECT id, term, round({_W('term')} * (w - mean), 6) AS phi FROM tv JOIN mn USING (term)),
      tp AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(phi) DESC, term) AS INT) AS nth FROM ph) SELECT id, nth, term, phi FROM tp WHERE nth <= 10""",
    "batch_predict": f"""WITH {FIT(1)}, {VEC}, z AS (SELECT id, k, sum(w * {_W("term || k")}) AS z FROM tv, (SELECT unnest(range(5)) AS k) GROUP BY ALL), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z),
      pr AS (SELECT id, CAST(arg_max(k, z) AS INT) AS y, coalesce(max(e) FILTER (k = 0), 0) / sum(e) AS p0, coalesce(max(e) FILTER (k = 2), 0) / sum(e) AS p2 FROM e GROUP BY 1),
      po AS (SELECT id, y, p0, p2, CASE WHEN y IN (0, 1) THEN 35 * ({_SP('framing')} AND {_SP('link')})::INT + 25 * {_SP('authority')}::INT + 20 * {_SP('soft_urgency')}::INT + 30 * ({_SP('internal')} AND ({_SP('credential_ask')} OR {_SP('financial_ask')}))::INT + CASE WHEN {_STY} >= 2 THEN 15 * ({_STY}) ELSE 0 END ELSE 0 END AS pt FROM pr JOIN (SELECT msg_id AS id, body FROM v_mail) USING (id)),
      ov AS (SELECT *, pt >= 45 AS raised, least(pt, 100) / 100e0 AS sc, CASE WHEN pt >= 45 THEN least(p0, round(1 - least(pt, 100) / 100e0, 4)) ELSE p0 END AS b FROM po)
      SELECT id, CASE WHEN raised THEN 2 ELSE y END AS prediction, raised, round(CASE WHEN raised THEN greatest(p2, sc) ELSE p2 END, 5) AS p_phishing, round(CASE WHEN raised THEN greatest(1 - b, 0.85e0) ELSE 1 - b END, 5) AS p_malicious FROM ov""",
    "classification_metrics": """WITH r AS (SELECT CAST(label AS INT) AS y, CAST(CASE WHEN length(body) > 1500 THEN 1 WHEN msg_id % 4 = 0 THEN 3 ELSE msg_id % 3 END AS INT) AS p FROM v_messages WHERE label IS NOT NULL),
      c AS (SELECT y AS k FROM r UNION SELECT p FROM r), a AS (SELECT k, count(*) FILTER (y = k) AS support, count(*) FILTER (y = k AND p = k) AS tp, count(*) FILTER (p = k) AS predicted FROM c, r GROUP BY 1),
      m AS (SELECT CAST(k AS VARCHAR) AS name, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0e0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0e0 END AS recall, CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0e0 END AS f1, support, tp FROM a),
      u AS (SELECT name, precision, recall, f1, support FROM m UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m
        UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM m)
      SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM u""",
    "confusion_matrix": "WITH r AS (SELECT CAST(label AS INT) AS y, CAST(CASE WHEN length(body) > 1500 THEN 1 WHEN msg_id % 4 = 0 THEN 3 ELSE msg_id % 3 END AS INT) AS p FROM v_messages WHERE label IS NOT NULL) SELECT y AS label, p AS prediction, count(*) AS n FROM r GROUP BY ALL",
    "roc_auc_ovr": """WITH l AS (SELECT k AS class, (msg_id * 37 + k * 11) % 100 + (label = k)::INT * 20 AS s, label = k AS pos FROM v_messages, (SELECT unnest(range(4)) AS k) WHERE label IS NOT NULL),
      a AS (SELECT p.class, sum(CASE WHEN p.s > n.s THEN 1e0 WHEN p.s = n.s THEN 0.5e0 ELSE 0e0 END) / count(*) AS auc FROM l AS p JOIN l AS n ON p.class = n.class AND p.pos AND NOT n.pos GROUP BY 1)
      SELECT CAST(class AS VARCHAR) AS name, round(auc, 6) AS auc FROM a UNION ALL SELECT 'macro', round(avg(auc), 6) FROM a""",
}
