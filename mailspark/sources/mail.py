"""Raw messages and reference files as tables; parsing never fails, it collects errors.

A message is parsed by column expressions in one projection: bytes are read as
Latin-1 characters (one each), headers are cut and unfolded, multipart bodies
are split at their boundaries level by level, and each leaf is decoded by its
transfer encoding and character set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BYTES = "ISO-8859-1"
WORD = r"=\?([^?]+)\?([bBqQ])\?([^?]*)\?="
#: Characters that Windows-1252 has in place of the second control block.
WINDOWS = [(b, bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
LATIN, WESTERN, UNICODE = ("iso-8859-1", "latin-1", "latin1"), ("windows-1252", "cp1252"), ("", "utf-8", "utf8", "us-ascii", "ascii")


def read_raw(spark: SparkSession, folder: str, pattern: str = "*.eml") -> DataFrame:
    """Files below a folder with size and digest; contents stay binary (Spark skips files of no bytes)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"), "content")


def pack(messages: DataFrame, folder: str, most: int = 50_000) -> None:
    """Messages (name, content) put into archives: Parquet files of up to ``most`` messages, as many as their bytes need
    and not one for each, so that writing and listing them doesn't grow with the number of messages."""
    messages.select("name", "content").write.option("maxRecordsPerFile", most).option("compression", "zstd").parquet(folder)


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """All messages of the archives in a folder, as ``read_raw`` has them of files; those of no bytes too."""
    rows = spark.read.schema("name string, content binary").parquet(folder)
    path, changed = F.concat_ws("/", "_metadata.file_path", "name"), F.col("_metadata.file_modification_time")
    return rows.select(path.alias("path"), changed.alias("modificationTime"), F.length("content").cast("bigint").alias("length"), F.sha2("content", 256).alias("sha256"), "content")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _headers(head: Column) -> Column:
    """Unfolded header lines as (name in lower case, value)."""
    lines = F.filter(F.split(F.regexp_replace(head, r"\r?\n[ \t]+", " "), r"\r?\n"), lambda x: x.rlike("^[!-9;-~]+:"))
    return F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("name"), _strip(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value")))


def _values(headers: Column, name: str) -> Column:
    return F.transform(F.filter(headers, lambda h: h["name"] == name), lambda h: h["value"])


def _first(headers: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(_values(headers, name), F.lit(1)), F.lit(""))


def _pair(entity: Column) -> Column:
    """Header text and body of an entity: the first empty line parts them."""
    return F.split(F.concat(F.lit("\n"), entity), r"\r?\n\r?\n", 2)


def _kind(pair: Column) -> Column:
    return _first(_headers(pair[0]), "content-type")


def _open(rows: DataFrame) -> DataFrame:
    """One level of multiparts: each entity of ``parts`` is replaced by its parts; any other is its own only part.

    Made in steps, so that an entity is cut once.
    """
    rows = rows.withColumn("parts", F.transform("parts", lambda e: F.struct(e.alias("entity"), F.when(e.rlike(r"(?i)content-type:\s*multipart/"), _pair(e)).alias("pair"))))
    rows = rows.withColumn("parts", F.transform("parts", lambda p: p.withField("kind", F.when(p["pair"].isNotNull(), _kind(p["pair"])))))
    quoted, bare = lambda k: F.regexp_extract(k, '(?i)boundary="([^"]+)"', 1), lambda k: F.regexp_extract(k, r"(?i)boundary=([^\s;\"]+)", 1)
    mark = lambda k: F.when(F.lower(k).startswith("multipart/"), F.coalesce(F.nullif(quoted(k), F.lit("")), F.nullif(bare(k), F.lit(""))))
    rows = rows.withColumn("parts", F.transform("parts", lambda p: F.struct(p["entity"].alias("entity"), p["pair"].alias("pair"), mark(p["kind"]).alias("mark"))))
    pieces = lambda p: F.split(F.concat(F.lit("\n"), F.coalesce(F.try_element_at(p["pair"], F.lit(2)), F.lit(""))), F.concat(F.lit(r"\r?\n--\Q"), p["mark"], F.lit(r"\E")))
    inner = lambda p: F.transform(F.filter(F.slice(pieces(p), 2, 1 << 20), lambda x: ~x.startswith("--")), lambda x: F.regexp_replace(x, r"^[^\n]*\n", ""))
    return rows.withColumn("parts", F.flatten(F.transform("parts", lambda p: F.when(p["mark"].isNotNull(), inner(p)).otherwise(F.array(p["entity"])))))


def _unquoted(text: Column) -> Column:
    """Quoted-printable text (or, with underscores made blanks before, an encoded word) as bytes."""
    pieces = F.split(F.regexp_replace(text, "=[ \\t]*\\r?\\n", ""), "=")
    plain = lambda x: F.hex(F.encode(x, BYTES))
    coded = lambda x: F.when(x.rlike("^[0-9A-Fa-f]{2}$"), x).when(x.rlike("(?s)^[0-9A-Fa-f]{2}"), F.concat(F.substring(x, 1, 2), plain(F.substring(x, 3, 1 << 30)))).otherwise(F.concat(F.lit("3D"), plain(x)))
    return F.unhex(F.array_join(F.concat(F.array(plain(pieces[0])), F.transform(F.slice(pieces, 2, 1 << 30), coded)), ""))


def _unbase64(text: Column) -> Column:
    return F.try_to_binary(F.regexp_replace(text, "[^A-Za-z0-9+/=]", ""), F.lit("base64"))


def _text(data: Column, charset: Column) -> Column:
    """Bytes as text; what isn't valid becomes a replacement character, an unknown character set counts as UTF-8."""
    latin = F.decode(data, BYTES)
    western = F.translate(latin, "".join(chr(b) for b, _ in WINDOWS), "".join(c for _, c in WINDOWS))
    return F.when(charset.isin(*LATIN), latin).when(charset.isin(*WESTERN), western).otherwise(F.make_valid_utf8(data.cast("string")))


def decoded_header(value: Column) -> Column:
    """Encoded words as text; other bytes are read as UTF-8."""
    joined = F.regexp_replace(value, r"\?=\s+=\?", "?==?")
    tokens = F.regexp_extract_all(joined, F.lit(rf"(?s)({WORD}|(?:(?!=\?).)+|.)"), 1)
    part = lambda t, k: F.regexp_extract(t, f"^{WORD}$", k)
    data = lambda t: F.when(F.upper(part(t, 2)) == "B", _unbase64(part(t, 3))).otherwise(_unquoted(F.replace(part(t, 3), F.lit("_"), F.lit(" "))))
    text = F.transform(tokens, lambda t: F.when(t.rlike(f"^{WORD}$"), F.coalesce(_text(data(t), F.lower(part(t, 1))), t)).otherwise(F.make_valid_utf8(F.encode(t, BYTES).cast("string"))))
    return _strip(F.array_join(text, ""))


def _leaves(rows: DataFrame) -> DataFrame:
    """Each part's type, disposition, file name, decoded bytes and text, and what went wrong; in steps, each from the one before."""
    step = lambda rows, make: rows.withColumn("parts", F.transform("parts", make))
    rows = step(rows, _pair)
    rows = step(rows, lambda p: F.struct(_headers(p[0]).alias("headers"), F.coalesce(F.try_element_at(p, F.lit(2)), F.lit("")).alias("body")))
    rows = step(rows, lambda p: F.struct(p["body"].alias("body"), _first(p["headers"], "content-type").alias("kind"), _first(p["headers"], "content-disposition").alias("disposition"), F.lower(_first(p["headers"], "content-transfer-encoding")).alias("coding")))
    mime = lambda kind: F.coalesce(F.nullif(F.lower(F.regexp_extract(kind, r"^\s*([^\s;]+/[^\s;]+)", 1)), F.lit("")), F.lit("text/plain"))
    data = lambda p: F.when(p["coding"] == "base64", _unbase64(p["body"])).when(p["coding"] == "quoted-printable", _unquoted(p["body"])).otherwise(F.encode(p["body"], BYTES))
    found = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    named = lambda p: F.coalesce(found(p["disposition"], '(?i)filename="([^"]*)"'), found(p["disposition"], r"(?i)filename=([^\s;]+)"), found(p["kind"], '(?i)name="?([^";]*)'), F.lit(""))
    rows = step(rows, lambda p: F.struct(
        p["body"].alias("body"), mime(p["kind"]).alias("mime"), F.lower(F.regexp_extract(p["kind"], r"(?i)charset=\"?([^\s;\"]+)", 1)).alias("charset"), F.lower(p["disposition"]).startswith("attachment").alias("attached"), named(p).alias("name"), data(p).alias("data")
    ))
    known = lambda c: c.isin(*LATIN, *WESTERN, *UNICODE)
    problem = lambda p: F.when(p["data"].isNull(), F.concat(F.lit("undecodable part "), p["mime"])).when(p["mime"].startswith("text/") & ~known(p["charset"]), F.concat(F.lit("unknown charset '"), p["charset"], F.lit("', fell back to utf-8")))
    raw = lambda p: F.coalesce(p["data"], F.encode(p["body"], BYTES))
    rows = step(rows, lambda p: F.struct(p["mime"].alias("mime"), p["charset"].alias("charset"), p["attached"].alias("attached"), F.when(p["name"] != "", decoded_header(p["name"])).otherwise("").alias("name"), raw(p).alias("data"), problem(p).alias("problem")))
    is_file = lambda p: p["attached"] | ((p["name"] != "") & ~p["mime"].isin("text/plain", "text/html"))
    return step(rows, lambda p: F.struct(*[p[n].alias(n) for n in ("mime", "name", "data", "problem")], is_file(p).alias("is_file"), F.when(~is_file(p) & p["mime"].startswith("text/"), _text(p["data"], p["charset"])).alias("text")))


def parse_messages(raw: DataFrame, depth: int = 3, text_cap: int | None = None) -> DataFrame:
    """(id, content) -> headers, sender, bodies, attachments (name, type, size, sha256, first bytes) and parse_errors.

    ``depth``: levels of nested multiparts.  ``text_cap``: bodies are cut there only if it is given, and the cut is an error
    entry.  A null or empty content gives empty fields and "no readable body content".
    """
    whole = raw.select("id", F.decode(F.coalesce("content", F.lit(b"")), BYTES).alias("whole"))
    rows = whole.select("id", _headers(_pair(F.col("whole"))[0]).alias("headers"), F.array("whole").alias("parts"))
    for _ in range(depth):
        rows = _open(rows)
    rows = _leaves(rows)
    texts = lambda test: _strip(F.array_join(F.transform(F.filter("parts", lambda p: p["text"].isNotNull() & test(p["mime"])), lambda p: p["text"]), "\n"))
    files = F.transform(F.filter("parts", lambda p: p["is_file"]), lambda p: F.struct(F.when(p["name"] == "", "unnamed").otherwise(p["name"]).alias("name"), p["mime"].alias("mime"), F.octet_length(p["data"]).alias("size"), F.sha2(p["data"], 256).alias("sha256"), F.hex(F.substring(p["data"], 1, 16)).alias("first_bytes")))
    sender = _first(F.col("headers"), "from")
    address = F.lower(F.regexp_extract(sender, r"<?([^\s<>,\"]+@[^\s<>,\"]+)>?", 1))
    rows = rows.select(
        "id", decoded_header(_first(F.col("headers"), "subject")).alias("subject"), decoded_header(_strip(F.regexp_extract(sender, r'^\s*"?([^"<]*)"?\s*<', 1))).alias("from_name"), address.alias("from_address"), _first(F.col("headers"), "message-id").alias("message_id"),
        F.size(_values(F.col("headers"), "received")).alias("n_received"), texts(lambda m: m.startswith("text/") & (m != "text/html")).alias("body"), texts(lambda m: m == "text/html").alias("body_html"), files.alias("attachments"),
        F.array_compact(F.transform("parts", lambda p: p["problem"])).alias("problems"), (F.size("headers") == 0).alias("bare"),
    )
    over = (F.length("body") > text_cap) | (F.length("body_html") > 2 * text_cap) if text_cap else F.lit(False)
    notes = F.array_compact(F.array(F.when(F.col("bare"), F.lit("no readable headers found")), F.when((F.col("body") == "") & (F.col("body_html") == ""), F.lit("no readable body content")), F.when(over, F.lit("body cut at the limit"))))
    cut = lambda c, n: F.substring(c, 1, n) if text_cap else F.col(c)
    return rows.select("id", "subject", "from_name", "from_address", "message_id", "n_received", cut("body", text_cap).alias("body"), cut("body_html", 2 * (text_cap or 0)).alias("body_html"), "attachments", F.array_join(F.concat("problems", notes), ";").alias("parse_errors"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled JSON lines; blank ones dropped."""
    rows = spark.read.schema("id bigint, text string, label int, source string").json(path)
    return rows.where("text is not null and trim(text) <> ''")


def reference_map(rows: DataFrame, column: str, value_type: str = "bigint") -> DataFrame:
    """A JSON object in a column as (key, value) rows."""
    return rows.select("*", F.explode(F.from_json(column, f"map<string,{value_type}>"))).withColumnsRenamed({"key": "map_key", "value": "map_value"})
