"""Fixed values as the DuckDB twins expect them.

They are written here a second time, not imported from the library, so that a value changed on one side only
makes a query differ from its twin.
"""

from __future__ import annotations

import unicodedata

BRANDS = [
    "microsoft", "office365", "outlook", "onedrive", "sharepoint", "google", "gmail", "apple", "icloud", "amazon", "paypal", "netflix", "facebook", "instagram", "linkedin", "dropbox", "docusign",
    "adobe", "zoom", "sbi", "hdfcbank", "icicibank", "axisbank", "paytm", "phonepe", "aadhaar", "uidai", "incometax", "gst", "irctc", "aicte", "nic", "gov",
]
CONFUSABLE_FROM = "аеорсхуіѕјһԁɡⅼαεορτνκıłøǀ013457"
CONFUSABLE_TO = "aeopcxyisjhdglaeoptvkilololeast"
LIGATURES = [
    ("ﬀ", "ff"),
    ("ﬁ", "fi"),
    ("ﬂ", "fl"),
    ("ﬃ", "ffi"),
    ("ﬄ", "ffl"),
    ("ﬅ", "st"),
    ("ﬆ", "st"),
    ("ĳ", "ij"),
    ("ǉ", "lj"),
    ("ǌ", "nj"),
    ("ǆ", "dz"),
    ("ǳ", "dz"),
]
ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", "\""),
    ("&#39;", "'"),
    ("&amp;", "&"),
]
HIDDEN = r"(?i)(?:font-size\s*:\s*0(?:\.0+)?(?:px|pt|em)?|color\s*:\s*#?fff(?:fff)?\b|display\s*:\s*none|visibility\s*:\s*hidden)"
FREEMAIL = [
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "protonmail.com", "aol.com", "yandex.com", "mail.com", "gmx.com", "rediffmail.com", "zoho.com", "icloud.com", "live.com", "proton.me",
]
ANCHORS = {
    "urgency": "urgent immediate action required respond immediately final notice account suspended terminated deactivated failure to comply consequences deadline expires today within 24 hours last warning critical alert time sensitive do not delay act now before too late access revoked unless respond immediately final opportunity to verify information failure to act will result in permanent suspension do not ignore message requires immediate attention",
    "financial": "wire transfer bank electronic funds remittance payment required invoice outstanding balance overdue account number routing number swift code iban bic beneficiary bank details process payment immediately transfer funds urgently direct deposit payroll change bank account update vendor payment gift card purchase amazon apple itunes google play send codes cryptocurrency bitcoin ethereum wallet address transfer financial transaction settlement disbursement closing funds",
    "authority": "chief executive officer ceo president managing director chairman on behalf of executive team board of directors senior management request comes directly from office of ceo instructions from director confidential human resources payroll finance team it security manager requested action completed urgently per company policy directed by senior leadership do not discuss request with colleagues confidential direct order from executive office immediate compliance",
    "credential": "verify account login credentials password reset security alert click link to confirm identity suspicious activity detected account compromised update password immediately enter username and password to verify identity security team requires verification of account details google microsoft apple paypal bank login verification required unusual sign in attempt detected verify immediately two factor authentication required click to proceed session expired login again to continue",
    "malware": "enable macros to view macro execution required to open workbook download and run payload executable installer program password protected zip archive extract and run exe vbs hta wsf enable editing enable content in excel to decrypt ledger mount iso img container file to inspect delivery allow permissions to execute script payload",
}
PATTERNS = {
    "risky_extension": r"\b(?:xlsm|docm|pptm|iso|img|vbs|js|hta|wsf|scr|pif|exe|bat|cmd|apk)\b",
    "payload_context": r"\b(?:attached|enclosed|attachment|archive|zip)\b.{0,35}\b(?:macro|xlsm|docm|vbs|script|executable|installer|iso|img|payload|run)\b",
    "enable_macro": r"\b(?:enable\s+content|enable\s+macro|macros?\s+required|enable\s+editing|run\s+the\s+vbs)\b",
    "shortener": r"\b(?:bit\.ly|tinyurl\.com|t\.co|goo\.gl|is\.gd|cutt\.ly)\b",
    "financial": r"\b(?:wire\s+transfer\s+(?:to|instructions|details|funds|amount|request|payment|[\$£€]|\d)|(?:process|send|initiate|urgent)\s+wire\s+transfer|iban\b|swift\b|bic\b|routing\s+(?:number|no\.?)|account\s+(?:number|no\.?)|update\s+(?:my\s+)?(?:direct\s+deposit|payroll|bank)|redirect\s+(?:my\s+)?payroll|remittance\s+advice|beneficiary\s+bank|w-?2\s+(?:forms|tax))\b",
    "currency": r"[\$£€]\s*\d{1,3}(?:,\d{3})*(?:\.\d{2})?|\b\d{1,3}(?:,\d{3})+\s*(?:usd|eur|gbp|dollars)\b",
    "urgency": r"\b(?:within\s+24\s+hours|immediate\s+action|urgent|act\s+now|action\s+required|final\s+notice|last\s+warning|suspended|confirm\s+identity|verify\s+(?:login|credentials|account))\b",
    "deadline": r"\b(?:today|before\s+end\s+of\s+day|by\s+5\s*pm|asap|right\s+away)\b",
    "executive": r"\b(?:ceo|cfo|chief\s+executive|managing\s+director|board\s+of\s+directors|on\s+behalf\s+of\s+the\s+executive)\b",
    "secrecy": r"\b(?:confidential|do\s+not\s+discuss|keep\s+this\s+quiet|between\s+us|strictly\s+private|handle\s+personally)\b",
    "file_mention": r"\.(xlsm|docm|pptm|xls|doc|vbs|js|exe|zip|rar|iso|img|one|chm|hta|bat|ps1|lnk)\b",
    "execution": "(enable (macro|editing|content)|allow (macro|content|permission)|run the (attached|file|installer)|extract and (run|open|execute)|double.click to (open|run|install))",
    "archive_password": r"password.{0,20}(protected|is|:)\s*[\w\d]+|(open|extract).{0,20}password",
    "wire_details": r"(routing|account|swift|iban|bic).{0,30}(number|no\.?|code|:\s*\d|\d{4,})",
    "pay_instruction": r"(please\s+(?:wire|transfer|send|process|remit)|need\s+you\s+to\s+(?:transfer|wire|send|process)|arrange\s+(?:payment|transfer|wire)|wire\s+[\$£€]?\d+)",
    "confidential": "(confidential|do not (tell|discuss))",
    "file_link": r"https?://[^\s]+\.(exe|zip|rar|iso|doc|xls|pdf|js)\b",
    "urgent_word": "(urgent|immediately|today)",
    "file_word": "(attached|attachment|file|document)",
    "dangerous_file": r"\.(xlsm|docm|zip|exe|vbs)\b",
    "link": r"https?://|www\.",
}
SPEAR = {
    "framing": "(following up|as discussed|as per our|as requested|per your request|wanted to share|thought you might|please find|kindly review|for your review|hope this finds you|revised|comments against|two clauses)",
    "link": "(https?://|click here|open the|download|attached|shared document|google doc|dropbox|onedrive|sharepoint|shared workspace|open it here)",
    "authority": "(on behalf of|as discussed with|per instructions from|requested by|directed by|authorized by|following up on behalf|programme manager|manager,)",
    "soft_urgency": r"(whenever you (get|have) a chance.{0,50}(today|tonight|eod|cob|this afternoon|by \d)|no (rush|hurry|pressure).{0,50}(today|soon|asap|quickly|shortly|this)|at your (earliest|convenience).{0,30}(urgent|important|critical|priority)|when convenient)",
    "internal": "(team|colleague|department|office|our company|the organization|internally|our systems|shared workspace|clauses)",
    "credential_ask": "(login|password|credentials|access|verify|authenticate|sign in|your account|open it here|document in)",
    "financial_ask": "(payment|invoice|transfer|approve|authorize|budget|funds|account)",
}
STYLE = [
    "i hope (this|you are|this email)", "please (do not hesitate|feel free) to", "thank you for your (prompt|continued|kind|time)", "best regards", "i am writing (to|in)",
    "please (find|see) attached", "as per (our|the|your)", "kindly (note|be advised|confirm)", "thanks again for",
]
AI_PHRASES = [
    "thanks again for your time", "when convenient", "there is no rush", "do flag it", "shared workspace", "i hope this email finds you", "please feel free to", "do not hesitate to contact",
]
SECOND_LEVEL = [
    "co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "in", "res",
]
SHORTENERS = [
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "shorturl.at", "rb.gy", "tiny.cc", "lnkd.in", "s.id", "bl.ink", "t.ly", "shorte.st", "adf.ly",
]
LOGIN_WORDS = [
    "login", "signin", "sign-in", "logon", "auth", "authenticate", "verify", "verification", "validate", "secure", "account", "update", "confirm", "session", "recover", "unlock", "password",
    "credential", "billing", "payment", "invoice", "wallet", "kyc", "otp", "netbanking",
]
REDIRECT_PARAMS = [
    "url", "redirect", "redirect_uri", "next", "target", "dest", "destination", "continue", "r", "u", "link", "goto", "out",
]
RISKY_ENDINGS = [
    ".exe", ".scr", ".js", ".vbs", ".hta", ".jar", ".ps1", ".bat", ".cmd", ".msi", ".apk", ".iso", ".img", ".zip", ".rar", ".7z",
]
BAD_TLDS = [
    "zip", "mov", "top", "xyz", "click", "link", "gq", "cf", "tk", "ml", "work", "rest", "quest", "cam", "loan", "monster", "sbs", "cfd",
]
FREE_HOSTS = [
    "blogspot.", "weebly.", "wixsite.", "000webhost", "netlify.app", "vercel.app", "pages.dev", "web.app", "firebaseapp.com", "glitch.me", "repl.co", "github.io", "r2.dev", "workers.dev",
    "herokuapp.com", "sharepoint-", "duckdns.org", "ngrok", "trycloudflare.com",
]
BRAND_NAMES = {
    "microsoft": ('microsoft', 'office', 'office365', 'outlook', 'onedrive', 'sharepoint', 'm365', 'msonline', 'azuread'),
    "google": ('google', 'gmail', 'gsuite', 'googledrive', 'accounts-google'),
    "apple": ('apple', 'icloud', 'appleid', 'itunes'),
    "paypal": ('paypal', 'paypa1', 'pypal'),
    "amazon": ('amazon', 'aws', 'primevideo'),
    "docusign": ('docusign', 'docu-sign', 'esign'),
    "linkedin": ('linkedin', 'linkdin'),
    "netflix": ('netflix',),
    "sbi": ('onlinesbi', 'sbicard', 'statebank'),
    "hdfc": ('hdfcbank', 'hdfc'),
    "incometax": ('incometax', 'itdepartment', 'tin-nsdl'),
    "facebook": ('facebook', 'meta-business', 'fb-security'),
    "dhl": ('dhl', 'dhlexpress'),
    "whatsapp": ('whatsapp',),
}
LINK = r"""(?i)\b(?:https?://|ftp://|www\.)[^\s<>"'`\]\)\},]+"""
ANCHOR = r"""(?is)<a\b[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))[^>]*>(.*?)</a\s*>"""
HOSTNAMES = [
    (r"(?i)\b(?:tor[-._]?(?:exit|relay|node))\b", "reverse DNS names this host as a Tor node"),
    (r"(?i)\bexit[-._]?node\b", "reverse DNS suggests an anonymising exit node"),
    (r"(?i)\b(?:vpn|proxy|socks)\b", "reverse DNS suggests VPN or proxy infrastructure"),
    (r"(?i)\bopen[-._]?(?:smtp|relay|mail)\b", "reverse DNS suggests an open mail relay"),
    (r"(?i)\b(?:dynamic|dyn|dsl|pppoe|broadband|cable|dhcp)\b", "reverse DNS pattern of a dynamic residential address, which is unusual for a legitimate mail server and consistent with a compromised host"),
    (r"(?i)\b(?:vps|server|hosting|cloud|compute|instance|droplet|linode|ovh|colo)\b", "reverse DNS suggests hosting or cloud infrastructure rather than a corporate MTA"),
    (r"(?i)\b(?:bullet|offshore|anon)\w*host", "reverse DNS suggests bulletproof hosting"),
]
PROVIDERS = [
    ("(?i)(?:digitalocean|linode|vultr|hetzner|ovh|contabo|scaleway|choopa)", "budget VPS provider commonly abused for bulk sending"),
    ("(?i)(?:amazon|aws|google cloud|microsoft azure|azure|oracle cloud|alibaba)", "large cloud provider: sending IP is not owned by the purported sender"),
    ("(?i)(?:tor project|nym|mullvad|nordvpn|expressvpn|private internet)", "anonymisation provider"),
]
MAGIC = [
    ("255044462D", "pdf"),
    ("4D5A", "pe-executable"),
    ("7F454C46", "elf-executable"),
    ("504B0304", "zip-container"),
    ("526172211A07", "rar"),
    ("377ABCAF271C", "7z"),
    ("D0CF11E0", "ole2-office"),
    ("1F8B", "gzip"),
    ("FFD8FF", "jpeg"),
    ("89504E47", "png"),
    ("47494638", "gif"),
    ("7B5C727466", "rtf"),
    ("2321", "script"),
]
MACRO = [
    "doc", "docm", "xls", "xlsm", "xlsb", "ppt", "pptm", "dotm", "xlam",
]
EXECUTABLE = [
    "exe", "scr", "com", "pif", "bat", "cmd", "js", "jse", "vbs", "vbe", "wsf", "wsh", "hta", "msi", "msp", "jar", "ps1", "lnk", "cpl", "dll", "iso", "img", "vhd", "apk",
]
ARCHIVE = [
    "zip", "rar", "7z", "tar", "gz", "bz2", "xz", "cab", "ace",
]
PII = {
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "card": r"(?:\d[ \-]?){13,19}",
    "aadhaar": r"\d{4}[\s\-]?\d{4}[\s\-]?\d{4}",
    "gstin": r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z\d]Z[A-Z\d]\b",
    "pan": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "ifsc": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "upi": r"\b[\w.\-]{3,}@(?:okaxis|oksbi|okhdfcbank|okicici|ybl|paytm|upi|axl)\b",
    "phone": r"(?:\+?\d{1,3}[\s\-]?)?(?:\d[\s\-]?){9,13}\d",
}
#: Those of them that no digit may touch on either side.
PII_ALONE = ("card", "aadhaar", "phone")
MASKED = r"(?:[A-Z]+-)?[A-Za-z0-9._%+\-]*\*{2,}[A-Za-z0-9._%+\-]*(?:@[A-Za-z0-9.\-]+)?(?:\s*\[#[0-9a-f]{6}\])?|\[#[0-9a-f]{6}\]"
ABUSED_TLDS = [
    "zip", "mov", "top", "xyz", "gq", "cf", "tk", "ml", "buzz", "click", "link", "work", "support", "review", "country", "kim", "loan", "rest", "cam", "quest",
]
SENDERS = [
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "aol.com", "protonmail.com", "yandex.com", "rediffmail.com", "mail.com",
]
LURES = [
    ("urgency", 0.08, "nlp.urgency", 350, 40, 180),
    ("credential", 0.08, "nlp.credential_lure", 380, 50, 190),
    ("financial", 0.08, "nlp.payment_diversion", 380, 50, 190),
    ("authority", 0.08, "nlp.authority_pressure", 350, 50, 180),
    ("secrecy", 0.08, "nlp.secrecy", 350, 50, 175),
    ("malware", 0.12, "nlp.malware_lure", 380, 60, 190),
]
TECHNIQUE_NAMES = {
    "T1566": ("Phishing", "Initial Access"), "T1566.001": ("Phishing: Spearphishing Attachment", "Initial Access"), "T1566.002": ("Phishing: Spearphishing Link", "Initial Access"), "T1566.003": ("Phishing: Spearphishing via Service", "Initial Access"),
    "T1598": ("Phishing for Information", "Reconnaissance"), "T1598.002": ("Phishing for Information: Spearphishing Attachment", "Reconnaissance"), "T1598.003": ("Phishing for Information: Spearphishing Link", "Reconnaissance"),
    "T1656": ("Impersonation", "Defense Evasion"), "T1585.002": ("Establish Accounts: Email Accounts", "Resource Development"), "T1583.001": ("Acquire Infrastructure: Domains", "Resource Development"),
    "T1583.006": ("Acquire Infrastructure: Web Services", "Resource Development"), "T1584.001": ("Compromise Infrastructure: Domains", "Resource Development"), "T1586.002": ("Compromise Accounts: Email Accounts", "Resource Development"),
    "T1036": ("Masquerading", "Defense Evasion"), "T1036.005": ("Masquerading: Match Legitimate Name or Location", "Defense Evasion"), "T1036.007": ("Masquerading: Double File Extension", "Defense Evasion"),
    "T1027": ("Obfuscated Files or Information", "Defense Evasion"), "T1027.006": ("Obfuscated Files or Information: HTML Smuggling", "Defense Evasion"), "T1204.001": ("User Execution: Malicious Link", "Execution"),
    "T1204.002": ("User Execution: Malicious File", "Execution"), "T1059": ("Command and Scripting Interpreter", "Execution"), "T1137": ("Office Application Startup", "Persistence"), "T1090.003": ("Proxy: Multi-hop Proxy", "Command and Control"),
    "T1102": ("Web Service", "Command and Control"), "T1534": ("Internal Spearphishing", "Lateral Movement"), "T1114": ("Email Collection", "Collection"), "T1056.003": ("Input Capture: Web Portal Capture", "Collection"),
    "T1657": ("Financial Theft", "Impact"), "T1078": ("Valid Accounts", "Defense Evasion"), "T1620": ("Reflective Code Loading", "Defense Evasion"), "T1070": ("Indicator Removal", "Defense Evasion"),
}
TACTICS = [
    "Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
]
SIGNAL_TECHNIQUES = {
    "auth.spf_fail": ("T1566", "T1656"), "auth.spf_unaligned": ("T1656", "T1036.005"), "auth.dkim_fail": ("T1566", "T1656"), "auth.dmarc_fail": ("T1566", "T1656"), "auth.no_auth": ("T1566",), "auth.arc_fail": ("T1566",),
    "id.brand_impersonation": ("T1656", "T1036.005"), "id.lookalike_domain": ("T1583.001", "T1036.005"), "id.confusable_chars": ("T1036", "T1583.001"), "id.punycode_sender": ("T1036", "T1583.001"),
    "id.name_contains_other_address": ("T1656", "T1036"), "id.replyto_divergence": ("T1585.002", "T1656"), "id.returnpath_mismatch": ("T1656",), "id.suspicious_tld": ("T1583.001",),
    "nlp.urgency": ("T1566",), "nlp.credential_lure": ("T1598.003", "T1056.003"), "nlp.payment_diversion": ("T1657", "T1566"), "nlp.authority_pressure": ("T1656", "T1657"), "nlp.secrecy": ("T1657",),
    "nlp.bec_no_payload": ("T1656", "T1657", "T1534"), "nlp.shouting_subject": ("T1566",), "nlp.hidden_text": ("T1027",), "nlp.image_only": ("T1027",), "nlp.possible_quishing": ("T1566.002", "T1204.001"),
    "url.ip_literal": ("T1566.002", "T1583.006"), "url.anchor_mismatch": ("T1566.002", "T1036"), "url.punycode": ("T1566.002", "T1036"), "url.shortener": ("T1566.002", "T1102"), "url.lookalike": ("T1566.002", "T1583.001"),
    "url.credential_path": ("T1566.002", "T1056.003", "T1204.001"), "url.bad_tld": ("T1583.001",), "url.many": ("T1566.002",),
    "att.executable": ("T1566.001", "T1204.002"), "att.double_ext": ("T1036.007", "T1204.002"), "att.type_mismatch": ("T1036", "T1027"), "att.macro": ("T1566.001", "T1137", "T1059"), "att.archive": ("T1027", "T1566.001"),
    "hdr.no_message_id": ("T1566",), "hdr.message_id_mismatch": ("T1036",), "hdr.no_received": ("T1027",), "hdr.undisclosed_recipients": ("T1566",), "hdr.mass_recipients": ("T1566",), "hdr.bulk_mailer": ("T1566",),
    "relay.multi_country": ("T1090.003",), "relay.forged_timestamp": ("T1070", "T1090.003"), "relay.chain_manipulation": ("T1090.003",),
    "intel.tor_exit": ("T1090.003",), "intel.abuse_reports": ("T1583.006",), "intel.new_domain": ("T1583.001",), "intel.blacklisted": ("T1583.006",), "intel.no_mx": ("T1583.001",),
    "sandbox.credential_form": ("T1056.003", "T1204.001"), "sandbox.redirect_chain": ("T1027", "T1204.001"), "sandbox.brand_clone": ("T1656", "T1036.005"),
}


def compatible() -> tuple[str, str]:
    """What compatibility decomposition makes of single characters, and the marks that go."""
    rows = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in range(0x80, 0x20000)]
    single = [(a, b) for a, b in rows if len(b) == 1 and a != b and not unicodedata.combining(a)]
    return "".join(a for a, _ in single) + "".join(a for a, _ in rows if unicodedata.combining(a)), "".join(b for _, b in single)
