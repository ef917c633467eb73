"""The deterministic checks of parsed messages as weighted signals, in a long table.

A message's checks are columns: an array of (id, weight in hundredths) whose
entries are null where a check doesn't fire, exploded once.  Checks of links
and attachments run over the arrays' elements and carry their index.  Only the
similarity to reference texts is an aggregation, over the terms they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.functions import headers, text, urls
from mailspark.operators.features import LURES, anchor_similarity, lure_weight

# Endings of abused domains, mailers of scripts, and how many links and attachments are looked at.
ABUSED_TLDS = ("zip", "mov", "top", "xyz", "gq", "cf", "tk", "ml", "buzz", "click", "link", "work", "support", "review", "country", "kim", "loan", "rest", "cam", "quest")
SCRIPT_MAILERS = r"(?i)(phpmailer|sendmail-php|mass|bulk|smtplib)"
ADDRESS = r"[\w.+-]+@[\w.-]+\.\w+"
LINKS, FILES, MANY_LINKS, MANY_RECIPIENTS = 40, 20, 15, 20
# Weights in hundredths.
WEIGHTS = {
    "auth.dmarc_fail": 230, "auth.dmarc_pass": -160, "auth.spf_fail": 120, "auth.spf_unaligned": 155, "auth.dkim_fail": 140, "auth.no_auth": 110, "auth.arc_fail": 90,
    "id.name_contains_other_address": 210, "id.brand_impersonation": 190, "id.lookalike_domain": 240, "id.confusable_chars": 220, "id.punycode_sender": 180, "id.replyto_divergence": 120, "id.returnpath_mismatch": 80, "id.suspicious_tld": 85,
    "nlp.bec_no_payload": 125, "nlp.shouting_subject": 55, "nlp.hidden_text": 115, "nlp.image_only": 95, "nlp.possible_quishing": 90,
    "url.ip_literal": 175, "url.anchor_mismatch": 185, "url.punycode": 160, "url.shortener": 85, "url.lookalike": 220, "url.credential_path": 135, "url.bad_tld": 80, "url.many": 45,
    "att.executable": 250, "att.double_ext": 210, "att.type_mismatch": 180, "att.macro": 140, "att.archive": 70,
    "hdr.no_message_id": 90, "hdr.message_id_mismatch": 75, "hdr.no_received": 130, "hdr.undisclosed_recipients": 70, "hdr.mass_recipients": 55, "hdr.bulk_mailer": 105,
}
FREEMAIL_REPLY = 170


def signal(test: Column, name: str, weight: Column | int | None = None, index: Column | None = None) -> Column:
    """(id, weight) where ``test`` holds, else null; an index is appended to the id."""
    full = F.lit(name) if index is None else F.concat(F.lit(f"{name}."), index.cast("string"))
    return F.when(test, F.struct(full.alias("signal_id"), (F.lit(WEIGHTS[name]) if weight is None else F.lit(weight)).cast("int").alias("w100")))


def brands() -> Column:
    """The protected names with the edits that still count as close: a fifth of the length, one at least."""
    return F.expr("array(" + ", ".join(f"named_struct('name', '{b}', 'limit', {max(1, len(b) // 5)})" for b in text.BRANDS) + ")")


def close_to_brand(label: Column) -> Column:
    """A protected name is close to the label, but isn't it.  ``label``: a column or field, not an expression."""
    return (label != "") & F.exists(brands(), lambda b: F.levenshtein(label, b["name"]).between(F.lit(1), b["limit"]))


def first_label(registered: Column) -> Column:
    return text.skeleton(F.substring_index(registered, ".", 1))


def prepared(messages: DataFrame) -> DataFrame:
    """Adds what several checks need, each made once: columns of their own, in steps that Spark doesn't merge again."""
    m = messages.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c, kind in messages.dtypes if kind == "string"})
    url = lambda x: urls.normalise(x["url"])
    m = m.withColumns({
        "registered": urls.registrable(F.col("from_domain")), "reply": urls.registrable(headers.address_domain(F.col("reply_to"))), "back": urls.registrable(headers.address_domain(F.col("return_path"))), "name_form": text.skeleton(F.col("from_name")),
        "domain_form": text.skeleton(F.col("from_domain")), "auth": F.struct(*[c.alias(n) for n, c in headers.auth(F.col("auth_header"), F.col("from_domain")).items()]),
        "links": F.transform("links", lambda x: F.struct(url(x).alias("url"), x["anchor"].alias("anchor"), urls.host(url(x)).alias("host"))),
        "files": F.transform("files", lambda f: F.struct(*[c.alias(n) for n, c in headers.attachment(f["name"], f["first_bytes"]).items()])),
    })
    m = m.withColumns({
        "registered_form": text.skeleton(F.col("registered")), "label": first_label(F.col("registered")),
        "links": F.transform("links", lambda x: F.struct(*[x[n].alias(n) for n in ("url", "anchor", "host")], urls.registrable(x["host"]).alias("registered"))),
    })
    return m.withColumn("links", F.transform("links", lambda x: F.struct(
        x["host"].alias("host"), x["registered"].alias("registered"), first_label(x["registered"]).alias("label"), urls.anchor_mismatch(x["url"], x["anchor"]).alias("mismatch"), *[c.alias(n) for n, c in urls.flags(x["url"]).items()]
    )))


def authentication() -> list[Column]:
    a = F.col("auth")
    unaligned = a["spf_aligned"].eqNullSafe(F.lit(False))
    tests = {
        "auth.dmarc_fail": a["dmarc"] == "fail", "auth.dmarc_pass": a["dmarc"] == "pass", "auth.spf_fail": a["spf"].isin("fail", "softfail"), "auth.spf_unaligned": (a["spf"] == "pass") & unaligned,
        "auth.dkim_fail": a["dkim"] == "fail", "auth.no_auth": (a["dkim"] == "none") & a["spf"].isin("none", "unknown"), "auth.arc_fail": a["arc"] == "fail",
    }
    return [signal(test, name) for name, test in tests.items()]


def identity() -> list[Column]:
    domain, name, own, registered = F.col("from_domain"), F.col("name_form"), F.col("registered_form"), F.col("registered")
    other = F.lower(F.regexp_extract("from_name", ADDRESS, 0))
    tests = {
        "id.name_contains_other_address": (other != "") & (other != F.col("from_address")), "id.brand_impersonation": F.exists(brands(), lambda b: name.contains(b["name"]) & ~own.contains(b["name"])),
        "id.lookalike_domain": close_to_brand(F.col("label")), "id.confusable_chars": (domain != "") & (F.col("domain_form") != F.lower(domain)), "id.punycode_sender": domain.contains("xn--"),
        "id.returnpath_mismatch": (F.col("back") != "") & (F.col("back") != registered), "id.suspicious_tld": F.substring_index(registered, ".", -1).isin(*ABUSED_TLDS),
    }
    diverges = (F.col("reply_to") != "") & (F.col("reply_to") != F.col("from_address")) & (F.col("reply") != registered)
    return [signal(test, n) for n, test in tests.items()] + [signal(diverges, "id.replyto_divergence", F.when(F.col("reply").isin(*text.FREEMAIL), FREEMAIL_REPLY).otherwise(WEIGHTS["id.replyto_divergence"]))]


def language(similarity: dict[str, Column]) -> list[Column]:
    out = [signal(similarity[kind] >= least, name, lure_weight(similarity[kind], factor, low, high)) for kind, least, name, factor, low, high in LURES if kind in similarity]
    seen, html, n_links = F.length(text.strip(text.strip_html(F.col("body_html")))), F.col("body_html"), F.size("links")
    tests = {
        "nlp.bec_no_payload": (similarity["financial"] >= dict((k, t) for k, t, *_ in LURES)["financial"]) & (n_links == 0) & (F.size("files") == 0), "nlp.shouting_subject": text.caps_ratio(F.col("subject")) > 0.6,
        "nlp.hidden_text": html.rlike(text.HIDDEN), "nlp.image_only": (F.length(html) > 400) & (seen < 40) & (n_links > 0), "nlp.possible_quishing": F.col("has_qr") & (n_links == 0),
    }
    return out + [signal(test, name) for name, test in tests.items()]


def link_signals(link: Column, i: Column) -> Column:
    """link: a prepared struct."""
    tests = {
        "url.ip_literal": link["is_ip_literal"], "url.anchor_mismatch": link["mismatch"], "url.punycode": link["is_punycode"], "url.shortener": link["is_shortener"], "url.lookalike": close_to_brand(link["label"]),
        "url.credential_path": link["credential_path"] & (link["registered"] != F.col("registered")), "url.bad_tld": urls.tld(link["host"]).isin(*ABUSED_TLDS),
    }
    return F.array(*[signal(test, name, index=i) for name, test in tests.items()])


def file_signals(file: Column, i: Column) -> Column:
    """file: a prepared struct."""
    tests = {"att.executable": "is_executable", "att.double_ext": "double_extension", "att.type_mismatch": "mismatch", "att.macro": "is_macro", "att.archive": "is_archive"}
    return F.array(*[signal(file[field], name, index=i) for name, field in tests.items()])


def header_checks() -> list[Column]:
    given, recipients = F.col("message_id"), F.col("n_to") + F.col("n_cc")
    named = F.lower(F.substring_index(F.regexp_replace(given, "^[<>]+|[<>]+$", ""), "@", -1))
    tests = {
        "hdr.no_message_id": given == "", "hdr.message_id_mismatch": (given != "") & (F.col("from_domain") != "") & (named != "") & (urls.registrable(named) != F.col("registered")),
        "hdr.no_received": F.col("n_received") == 0, "hdr.undisclosed_recipients": recipients == 0, "hdr.mass_recipients": recipients > MANY_RECIPIENTS, "hdr.bulk_mailer": F.col("x_mailer").rlike(SCRIPT_MAILERS),
    }
    return [signal(test, name) for name, test in tests.items()]


def message_signals(messages: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Parsed messages -> (id, signal_id, w100) of every check that fires.

    messages: subject, body, body_html, from_name, from_address, from_domain, reply_to, return_path, message_id,
    x_mailer, n_to, n_cc, n_received, has_qr, auth_header, links (array of url, anchor), files (array of name, first_bytes).
    """
    blob = text.strip(F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))))
    near = anchor_similarity(messages.select(F.col(id_col).alias("id"), blob.alias("text")), text.ANCHORS)
    ready = prepared(messages.drop("body"))
    rows = ready.join(near.withColumnsRenamed({a: f"near_{a}" for a in text.ANCHORS}), F.col(id_col) == F.col("id"), "left")
    similarity = {a: F.coalesce(f"near_{a}", F.lit(0.0)) for a in text.ANCHORS}
    checks = authentication() + identity() + language(similarity) + header_checks() + [signal(F.size("links") > MANY_LINKS, "url.many")]
    found = F.concat(F.array(*checks), F.flatten(F.transform(F.slice("links", 1, LINKS), link_signals)), F.flatten(F.transform(F.slice("files", 1, FILES), file_signals)))
    return rows.select(id_col, F.explode(F.array_compact(found)).alias("s")).select(id_col, "s.signal_id", "s.w100")


def meta_features(messages: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """The 30 engineered indicators of a message, all in [0, 1]."""
    a, registered, reply, back = F.col("auth"), F.col("registered"), F.col("reply"), F.col("back")
    body = F.when(F.col("body") != "", F.col("body")).otherwise(text.strip_html(F.col("body_html")))
    link = lambda name: F.exists("links", lambda u: u[name])
    file = lambda name: F.exists("files", lambda f: f[name])
    recipients = F.col("n_to") + F.col("n_cc")
    share = lambda x, whole: F.least(F.lit(1.0), x / whole)
    unknown = lambda x: x.isin("none", "unknown")
    # The features' names in their order, sizes that make 1, and free-mail senders.
    senders = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "aol.com", "protonmail.com", "yandex.com", "rediffmail.com", "mail.com")
    values = {
        "spf_fail": a["spf"].isin("fail", "softfail"), "spf_unaligned": (a["spf"] == "pass") & a["spf_aligned"].eqNullSafe(F.lit(False)), "dkim_fail": a["dkim"] == "fail", "dkim_missing": unknown(a["dkim"]), "dmarc_fail": a["dmarc"] == "fail",
        "no_auth": unknown(a["dkim"]) & unknown(a["spf"]), "reply_to_differs": (reply != "") & (reply != registered), "return_path_differs": (back != "") & (back != registered), "freemail_sender": registered.isin(*senders),
        "punycode_sender": F.col("from_domain").contains("xn--"), "has_urls": F.size("links") > 0, "many_urls": share(F.size("links"), 15), "url_ip_literal": link("is_ip_literal"), "url_shortener": link("is_shortener"),
        "url_anchor_mismatch": link("mismatch"), "url_offdomain": F.exists("links", lambda u: (u["registered"] != "") & (u["registered"] != registered)), "has_attachment": F.size("files") > 0, "attach_executable": file("is_executable"),
        "attach_macro": file("is_macro"), "attach_double_ext": file("double_extension"), "no_received_chain": F.col("n_received") == 0, "long_relay_chain": share(F.col("n_received"), 8), "no_message_id": F.col("message_id") == "",
        "html_only": (F.col("body_html") != "") & (text.strip(F.col("body")) == ""), "subject_caps": text.caps_ratio(F.col("subject")), "short_body": F.length(body) < 250, "long_body": share(F.length(body), 6000),
        "many_recipients": share(recipients, 25), "no_recipients": recipients == 0, "digit_domain": F.substring_index(registered, ".", 1).rlike("[0-9]"),
    }
    return prepared(messages).select(id_col, *[F.round(F.coalesce(v.cast("double"), F.lit(0.0)), 6).alias(name) for name, v in values.items()])
