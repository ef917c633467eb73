"""Mail parsing against the standard library, raw files, masks and streams with late data."""

import base64
import email
import email.policy
import hashlib
import os
import quopri
import re

from pyspark.sql import functions as F

from mailspark.functions import privacy
from mailspark.operators import corpus, links
from mailspark.plans import message_queries as q
from mailspark.plans import registry
from mailspark.plans.adapters import view
from mailspark.sources import mail, shared, sinks
from mailspark.streaming import streams

FOLDER = "/root/testdata/sf0.001"
B64 = base64.encodebytes("Grüße, ein langer Text mit Umlauten äöü. ".encode() * 5).decode()
QP = quopri.encodestring("Prix: 10 € = très cher\nligne".encode()).decode()
MAILS = [
    b"",
    b"no header here\n\nbody",
    b"From: <@@@>\n\nhi",
    b'From: "Doe, Jane" <Jane@Example.ORG>\r\nSubject: =?utf-8?B?R3LDvMOfZQ==?= =?utf-8?Q?_und_=C3=A9?=\r\nMessage-ID: <1@x>\r\nReceived: a\r\n\tby b\r\nReceived: c\r\n\r\nplain body\r\n',
    f"From: a@b.c\nSubject: two\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n{B64}".encode(),
    f"From: a@b.c\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n{QP}".encode(),
    b"From: a@b.c\nContent-Type: text/plain; charset=iso-8859-1\n\ncaf\xe9",
    b"From: a@b.c\nContent-Type: text/plain; charset=windows-1252\n\n10 \x80",
    b"From: a@b.c\nContent-Type: text/plain; charset=utf-8\n\nbroken \xff end",
    b"From: a@b.c\nContent-Type: text/plain; charset=klingon\n\nqapla",
    b'From: a@b.c\nContent-Type: multipart/mixed; boundary="x.y"\n\npreamble\n--x.y\nContent-Type: multipart/alternative; boundary=z\n\n--z\nContent-Type: text/plain\n\none\n--z\nContent-Type: text/html\n\n<b>two</b>\n--z--\n\n--x.y\nContent-Type: application/octet-stream; name="a.exe"\nContent-Disposition: attachment; filename="a.exe"\nContent-Transfer-Encoding: base64\n\nTVqQAAM=\n--x.y--\nepilogue',
]


def by_library(raw):
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    texts, html, files = [], [], []
    for part in message.walk():
        if part.is_multipart():
            continue
        data, kind = part.get_payload(decode=True) or b"", part.get_content_type()
        if (part.get_content_disposition() or "") == "attachment":
            files.append((part.get_filename(), kind, len(data)))
            continue
        try:
            text = data.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:
            text = data.decode("utf-8", "replace")
        (html if kind == "text/html" else texts).append(text)
    subject = str(email.header.make_header(email.header.decode_header(message.get("Subject", "")))).strip()
    return subject, (message.get("Message-ID") or "").strip(), len(message.get_all("Received") or []), "\n".join(texts).strip(), "\n".join(html).strip(), files


def test_parsing_equals_the_standard_library(spark):
    rows = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(MAILS)], "id long, content binary")
    got = {r.id: r for r in mail.parse_messages(rows).collect()}
    for i, raw in enumerate(MAILS):
        if i == 1:  # the library takes a first line that is no header into the body
            assert got[i].body == "body" and "no readable headers found" in got[i].parse_errors
            continue
        r = got[i]
        assert (r.subject, r.message_id, r.n_received, r.body, r.body_html, [(a.name, a.mime, a["size"]) for a in r.attachments]) == by_library(raw), i
    assert got[3].from_name == "Doe, Jane" and got[3].from_address == "jane@example.org"
    assert "unknown charset 'klingon'" in got[9].parse_errors and got[0].parse_errors.endswith("no readable body content") and got[10].attachments[0].first_bytes == "4D5A900003"
    cut = mail.parse_messages(rows.where("id = 4"), text_cap=10).collect()[0]
    assert len(cut.body) == 10 and "cut" in cut.parse_errors


def test_raw_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.eml").write_bytes(MAILS[3])
    (tmp_path / "sub" / "b.eml").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"other")
    got = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.content)) for r in mail.read_raw(spark, str(tmp_path)).collect()}
    assert got == {"a.eml": (len(MAILS[3]), MAILS[3]), "b.eml": (1, b"x")}


def test_messages_in_archives(spark, tmp_path):
    """As many files as the bound asks for, and every message as it was, the one of no bytes included."""
    rows = spark.createDataFrame([(f"{i}.eml", bytearray(m)) for i, m in enumerate(MAILS)], "name string, content binary").coalesce(1)
    mail.pack(rows, f"{tmp_path}/packed", most=4)
    assert len(list((tmp_path / "packed").glob("*.parquet"))) == -(-len(MAILS) // 4)
    got = {r.path.rsplit("/", 1)[1]: r for r in mail.read_packed(spark, f"{tmp_path}/packed").collect()}
    assert {k: (r.length, bytes(r.content), r.sha256) for k, r in got.items()} == {f"{i}.eml": (len(m), m, hashlib.sha256(m).hexdigest()) for i, m in enumerate(MAILS)}


def test_raw_messages_are_not_a_file_each(spark, monkeypatch):
    paths, keep = [], shared.new_path
    monkeypatch.setattr(shared, "new_path", lambda s, name: paths.append(keep(s, name)) or paths[-1])
    assert registry.queries()["src_messages_raw"](spark, FOLDER).count() == 200
    assert sum(len(names) for _, _, names in os.walk(paths[0].removeprefix("file://"))) < 20


def test_full_masks_equal_ordered_substitution(spark):
    """Every kind in its order, each match by a plain rule, against the vectorised masks of the documents."""
    texts = {r.id: r.text for r in q._docs(spark, FOLDER).collect()}
    texts |= {-1: "a@b.co, 4111 1111 1111 1111 and 1234-5678-9012; 22AAAAA0000A1Z5 ABCDE1234F SBIN0001234 DE89370400440532013000 me@ybl +91 98765 43210", -2: "", -3: "no digits"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r.id: r.m for r in docs.select("id", privacy.mask_full(F.col("text")).alias("m")).collect()}
    digits = lambda v, k: (lambda d: "*" * max(len(d) - k, 0) + d[-k:] if len(d) > k else "*" * len(d))(re.sub(r"\D", "", v))
    plain = {
        "email": lambda v: re.sub(r"^(.)(.*)(.)@", lambda m: m[1] + "*" * len(m[2]) + m[3] + "@", v) + f" [#{privacy.tag(v)}]" if v.index("@") > 2 else "*" * v.index("@") + v[v.index("@"):] + f" [#{privacy.tag(v)}]",
        "card": lambda v: "CARD-" + digits(v, 4), "aadhaar": lambda v: "AADHAAR-" + digits(v, 4), "gstin": lambda v: f"GSTIN-{v[:2]}***********{v[-2:]}", "pan": lambda v: f"PAN-{v[:2]}******{v[-1]}",
        "ifsc": lambda v: f"IFSC-{v[:4]}*******", "iban": lambda v: f"IBAN-{v[:4]}{'*' * (len(v) - 8)}{v[-4:]}", "upi": lambda v: "UPI-" + privacy.tag(v), "phone": lambda v: "PHONE-" + digits(v, 3),
    }
    for i, t in texts.items():
        for kind, pattern in privacy.PATTERNS.items():
            t = re.sub(pattern, lambda m, f=plain[kind]: f(m[0]), t)
        assert got[i] == t, i
    assert got[-1].startswith("*@b.co [#") and "CARD-************1111" in got[-1]
    assert all(r.leaks == "" for r in registry.queries()["pii_leak_scan_full"](spark, FOLDER).collect())


def test_tags_are_keccak():
    assert privacy.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert privacy.keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"


def test_stix_ids_and_patterns(spark):
    import uuid

    space = uuid.UUID(sinks.NAMESPACE)
    want, seen = {}, {}
    for r in view(spark, FOLDER, "v_iocs").collect():
        path = sinks.STIX_PATH.get(r.ioc_type)
        if path:
            key = (r.ioc_type, r.value.lower())
            seen.setdefault(key, []).append((r.value, r.confidence))
    for (kind, key), found in seen.items():
        value = min(v for v, _ in found).replace("'", "\\'")
        want["indicator--" + str(uuid.uuid5(space, f"{kind}:{key}"))] = (f"[{sinks.STIX_PATH[kind]} = '{value}']", max(c for _, c in found))
    assert {r.id: (r.pattern, r.confidence) for r in registry.queries()["sink_ioc_stix"](spark, FOLDER).collect()} == want


def test_near_dup_keep_equals_the_greedy_loop(spark):
    ids, pairs = q._dup_pairs(spark, FOLDER)
    near = {(r.a, r.b) for r in pairs.collect()}
    kept = []
    for i in sorted(r.id for r in ids.collect()):
        if not any((j, i) in near for j in kept):
            kept.append(i)
    assert sorted(r.id for r in corpus.greedy_keep(ids.select("id"), pairs).where("kept").collect()) == kept
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a int, b int")
    alone = spark.createDataFrame([(i,) for i in range(31)], "id int")
    assert sorted(r.id for r in corpus.greedy_keep(alone, chain).where("kept").collect()) == list(range(0, 31, 2))


def test_related_pairs_of_a_hot_value(spark):
    rows = [(i, "sender", "hot") for i in range(60)] + [(i, "asn", f"n{i % 2}") for i in range(60)]
    got = links.relate(spark.createDataFrame(rows, "case_id int, kind string, value string")).collect()
    assert len(got) == 60 * 59 // 2 and {(r.w100, r.a % 2 == r.b % 2) for r in got} == {(105, True), (85, False)}


def _files(spark, path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, at timestamp").coalesce(1).write.parquet(f"{path}/{k:02d}")


def test_ingest_forgets_after_the_watermark(spark, tmp_path):
    import datetime as dt

    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    batches = [[("a", at(0)), ("b", at(1))], [("a", at(30))], [("c", at(300))], [("b", at(10)), ("e", at(301))], [("a", at(302))]]
    _files(spark, tmp_path, batches)
    rows = spark.readStream.schema("k string, at timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = sorted((r.k, r.at.hour * 60 + r.at.minute) for r in streams.drain(streams.dedupe(rows, "k", "at"), "ingest").collect())
    # a comes again at 30 (dropped) and at 302 (its state has gone by then); b at 10 is too late.
    assert got == [("a", 0), ("a", 302), ("b", 1), ("c", 300), ("e", 301)]


def test_upsert_of_a_batch_that_runs_again(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 5.0), (2, 1.0)], "key int, confidence double")
    folder = streams.new_path(spark, "again")
    for number in (0, 0, 1):  # the same number twice: written once
        rows.groupBy("key").agg(F.max("confidence").alias("confidence")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
    assert spark.read.parquet(folder).count() == 4
