"""Mail headers as columns: authentication results, Received lines, dates, attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailspark.functions.urls import registrable

#: File-type marks of first bytes (hex) and extension sets.
MAGIC = [
    ("255044462D", "pdf"), ("4D5A", "pe-executable"), ("7F454C46", "elf-executable"), ("504B0304", "zip-container"), ("526172211A07", "rar"), ("377ABCAF271C", "7z"), ("D0CF11E0", "ole2-office"), ("1F8B", "gzip"),
    ("FFD8FF", "jpeg"), ("89504E47", "png"), ("47494638", "gif"), ("7B5C727466", "rtf"), ("2321", "script"),
]
MACRO = ("doc", "docm", "xls", "xlsm", "xlsb", "ppt", "pptm", "dotm", "xlam")
EXECUTABLE = ("exe", "scr", "com", "pif", "bat", "cmd", "js", "jse", "vbs", "vbe", "wsf", "wsh", "hta", "msi", "msp", "jar", "ps1", "lnk", "cpl", "dll", "iso", "img", "vhd", "apk")
DOUBLE_EXTENSION = r"\.(pdf|doc|docx|xls|xlsx|jpg|png|txt|zip)\.[a-z0-9]{2,4}$"
EXPECTED_TYPES = [(("pdf",), "pdf"), (("doc", "xls", "ppt"), "ole2-office"), (("docx", "xlsx", "pptx"), "zip-container")]
ARCHIVE = ("zip", "rar", "7z", "tar", "gz", "bz2", "xz", "cab", "ace")


def address_domain(address: Column) -> Column:
    """Text after the last @, trimmed, lower; empty without one."""
    return F.when(address.contains("@"), F.lower(F.regexp_replace(F.trim(F.substring_index(address, "@", -1)), ">+$", ""))).otherwise(F.lit(""))


def _first(header: Column, key: str) -> Column:
    found = F.lower(F.regexp_extract(header, rf"(?i)\b{key}\s*=\s*([a-z]+)", 1))
    return F.when(found == "", "unknown").otherwise(found)


def auth(header: Column, from_domain: Column) -> dict[str, Column]:
    """SPF, DKIM and DMARC results, domains and alignment (null where it can't be told); DMARC is derived if absent."""
    spf, dkim, given = _first(header, "spf"), _first(header, "dkim"), _first(header, "dmarc")
    envelope = address_domain(F.regexp_extract(header, r"(?i)smtp\.mailfrom=([^\s;]+)", 1))
    signed = F.lower(F.regexp_extract(header, r"(?i)header\.d=([^\s;]+)", 1))
    aligned = lambda d: F.when((d != "") & (from_domain != ""), registrable(d) == registrable(from_domain))
    passed = ((spf == "pass") & aligned(envelope).eqNullSafe(F.lit(True))) | ((dkim == "pass") & aligned(signed).eqNullSafe(F.lit(True)))
    # Of several ARC results the last counts.
    arcs = F.regexp_extract_all(header, F.lit(r"(?i)\barc\s*=\s*([a-z]+)"), 1)
    arc = F.lower(F.coalesce(F.try_element_at(arcs, F.lit(-1)), F.lit("unknown")))
    dmarc = F.when(given != "unknown", given).when(passed, "pass").when((spf != "unknown") | (dkim != "unknown"), "fail").otherwise("unknown")
    return {"spf": spf, "dkim": dkim, "dmarc": dmarc, "arc": arc, "spf_domain": envelope, "dkim_domain": signed, "spf_aligned": aligned(envelope), "dkim_aligned": aligned(signed)}


def received(header: Column) -> dict[str, Column]:
    """Sending and receiving host, protocol, peer address (bracketed preferred) and time in seconds."""
    flat = F.regexp_replace(header, "\\s+", " ")
    bracketed = F.regexp_extract(flat, r"[\[\(]\s*(?:IPv6:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\s*[\]\)]", 1)
    plain = F.regexp_extract(flat, r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", 1)
    when = F.regexp_replace(F.trim(F.substring_index(flat, ";", -1)), "^[A-Za-z]{3},\\s*", "")
    return {
        "from_host": F.regexp_extract(flat, r"(?i)\bfrom\s+([^\s;()]+)", 1), "by_host": F.regexp_extract(flat, r"(?i)\bby\s+([^\s;()]+)", 1), "protocol": F.regexp_extract(flat, r"(?i)\bwith\s+([A-Za-z0-9/._-]+)", 1),
        "ip": F.when(bracketed != "", bracketed).otherwise(plain), "ts_s": F.unix_timestamp(F.try_to_timestamp(when, F.lit("d MMM yyyy HH:mm:ss Z"))),
    }


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def magic(first_bytes_hex: Column) -> Column:
    out = F.lit("unknown")
    for mark, kind in reversed(MAGIC):
        out = F.when(first_bytes_hex.startswith(mark), kind).otherwise(out)
    return out


def attachment(name: Column, first_bytes_hex: Column) -> dict[str, Column]:
    ext, kind = extension(name), magic(first_bytes_hex)
    binary = kind.isin("pe-executable", "elf-executable")
    mismatch = binary & ~ext.isin(*EXECUTABLE)
    for endings, expected in EXPECTED_TYPES:
        mismatch = mismatch | (ext.isin(*endings) & ~kind.isin(expected, "unknown"))
    return {
        "extension": ext, "detected_type": kind, "double_extension": F.lower(name).rlike(DOUBLE_EXTENSION), "mismatch": mismatch,
        "is_archive": ext.isin(*ARCHIVE) | kind.isin("zip-container", "rar", "7z"), "is_macro": ext.isin(*MACRO), "is_executable": ext.isin(*EXECUTABLE) | binary,
    }


#: Shapes of registry dates, tried in order.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd")


def domain_age_days(created: Column, now_s: int) -> Column:
    raw = F.trim(F.substring_index(F.trim(created), "(", 1))
    at = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in DATE_FORMATS])
    return F.when(at.isNotNull(), F.greatest(F.lit(0), F.floor((F.lit(now_s) - F.unix_timestamp(at)) / 86400)))
