"""WARC derivatives: each response record gives a linked metadata record and a plain-text conversion record.

Records are rows: record_id, warc_type, target_uri, warc_date, headers (the other named fields, in order), block (bytes). Record
ids of derivatives follow from the source id and the type, so a run that is repeated, or a task that is retried, gives the
same records. Digests are `sha256:` and lowercase hex of the bytes, those of a source's payload before any decoding.

Payloads are read as UTF-8, or as ISO-8859-1 where the Content-Type line says so (also for its superset windows-1252); bytes
that are not valid UTF-8 count as U+FFFD in titles and texts, in no digest. Other encodings and compressed payloads are read as
they lie. Named character references are those of HTML5 with their semicolon; a reference is decoded once.

Defined cases: a response without an empty line has only HTTP headers and an empty payload. A null block counts as empty, a
null uri gives a record without that field, a null date likewise. A response without a record id gets one from its uri, date and block,
so that its derivatives refer to it. Only rows of type ``response`` are converted; others are
left out. Repeated rows give repeated derivatives. Texts of any length stay whole.
"""

from __future__ import annotations

import gzip
import html.entities
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, headers array<struct<name:string,value:string>>, block binary"
#: Parts of a page that hold no text, and tags that end a line.
HIDDEN = "(?is)<(?:!--.*?-->" + "".join(rf"|{t}\b.*?</{t}\s*>" for t in ("script", "style", "noscript", "template", "title")) + ")"
#: Runs of white space other than one space.
WIDE = r"[ \t\r\n\f]*[\t\r\n\f][ \t\r\n\f]*|  +"
BREAKS = r"(?i)<(?:br|/?p|/?div|/?li|/?ul|/?ol|/?h[1-6]|/?tr|/?table|/?article|/?section|/?nav|/?footer|/?header|/?blockquote|/?pre)\b[^>]*>"
TAG = r"(?s)</?[a-zA-Z!][^>]*>"
#: Named references by HTML5, without the mark and the semicolon; those for the ampersand give a reference, which goes last.
NAMED = {n[:-1]: "&amp;" if c == "&" else c for n, c in html.entities.html5.items() if n.endswith(";") and n != "amp;"}
#: The names met most, which are replaced without a search.
COMMON = "nbsp copy reg middot hellip ndash mdash laquo raquo euro apos quot lt gt".split()
REFERENCE = r"^([a-zA-Z][a-zA-Z0-9]*);"


def urn(*parts: Column) -> Column:
    """A stable `<urn:uuid:...>` of some values."""
    h = F.md5(F.concat_ws("\u0000", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def _once(x: Column, f) -> Column:
    """f(x) with x computed once, however often f mentions it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def entities(text: Column) -> Column:
    """Decodes named references and decimal or hexadecimal ones, each once."""
    def numbered(part: Column) -> Column:
        code = F.regexp_extract(part, r"^(x[0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
        number = F.when(F.startswith(code, F.lit("x")), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(F.when(code != "", code)).cast("long")
        good = (code != "") & number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, number).otherwise(F.lit(63))), 8, "0")), "UTF-32")
        char = F.when(char == "&", "&amp;").otherwise(char)
        return F.when(good, F.concat(char, F.substr(part, F.length(code) + 2))).otherwise(F.concat(F.lit("&#"), part))

    def named(part: Column) -> Column:
        name = F.regexp_extract(part, REFERENCE, 1)
        known = F.str_to_map(F.lit("\x01".join(f"{n}\x02{c}" for n, c in NAMED.items())), F.lit("\x01"), F.lit("\x02"))  # one constant
        char = F.when(name != "", F.try_element_at(known, name))
        return F.when(char.isNotNull(), F.concat(char, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))

    def each(x: Column, mark: str, of) -> Column:
        parts = F.split(x, mark)
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), of), ""))

    def common(x: Column) -> Column:
        for name in COMMON:
            x = F.replace(x, F.lit(f"&{name};"), F.lit(NAMED[name]))
        return x

    def decoded(x: Column) -> Column:
        out = _once(common(F.when(F.contains(x, F.lit("&#")), each(x, "&#", numbered)).otherwise(x)), rare)
        return F.when(F.contains(x, F.lit("&")), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(x)

    def rare(x: Column) -> Column:
        """What is left but the ampersand's own: few pages have any."""
        return F.when(F.rlike(F.replace(x, F.lit("&amp;"), F.lit("")), F.lit("&[a-zA-Z][a-zA-Z0-9]*;")), each(x, "&", named)).otherwise(x)

    return _once(text, decoded)


def plain_text(html: Column) -> Column:
    """The visible text of a page: hidden parts and tags go, block tags break lines, spaces are folded, empty lines dropped."""
    out = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), WIDE, " ")
    out = entities(F.regexp_replace(F.regexp_replace(out, BREAKS, "\n"), TAG, ""))
    return F.trim(F.regexp_replace(out, r" *\n[ \n]*", "\n"), F.lit(" \n"))


def responses(pages: DataFrame, date: str = "2026-01-01T00:00:00Z", url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """Response records of raw pages, with page_id carried along."""
    body = F.coalesce(F.col(html), F.lit(""))
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2), body)
    named = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    return pages.select(
        F.col(page_id).alias("page_id"),
        urn(F.lit("response"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.sha2(body, 256)).alias("record_id"),
        F.lit("response").alias("warc_type"), F.col(url).alias("target_uri"), F.lit(date).alias("warc_date"),
        F.array(named("WARC-Payload-Digest", digest(body)), named("Content-Type", F.lit("application/http; msgtype=response"))).alias("headers"),
        block.cast("binary").alias("block"),
    )


def _split(block: Column) -> tuple[Column, Column]:
    """HTTP head (text) and payload (bytes) of a response block; the search for the empty line goes by bytes."""
    head = F.substring_index(block.cast("string"), CRLF * 2, 1)
    return F.make_valid_utf8(head), F.substr(block, F.octet_length(head) + 5)


def _text_of(payload: Column, head: Column) -> Column:
    """A payload as text."""
    latin = F.rlike(head, F.lit(r"(?im)^content-type:[^\n]*charset=[\"']?(?:iso-8859-1|latin-?1|windows-1252|cp1252)\b"))
    return F.when(latin, F.decode(payload, "ISO-8859-1")).otherwise(F.make_valid_utf8(payload.cast("string")))


def derivatives(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per response: metadata and conversion, both with refers_to = the source's record id.

    Returns keep, record_id, warc_type, refers_to, target_uri, warc_date, content_type, content_length, block_digest,
    source_digest (of the source's payload as computed), digest_ok (agrees with the source's own field; null without one),
    source_headers (the source's HTTP header lines, unchanged) and block.
    """
    source = records.where(F.col("warc_type") == "response")
    own = urn(F.lit("response"), F.coalesce("target_uri", F.lit("")), F.coalesce("warc_date", F.lit("")), digest(F.coalesce(F.col("block").cast("binary"), F.lit(b""))))
    source = source.withColumn("record_id", F.coalesce("record_id", own)).withColumn("_block", F.coalesce(F.col("block").cast("binary"), F.lit(b"")))
    head, payload = _split(F.col("_block"))
    source = source.select(*keep, "record_id", "target_uri", "warc_date", head.alias("_head"), payload.alias("_bytes"), F.try_element_at(F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == "warc-payload-digest"), lambda h: h["value"]), F.lit(1)).alias("_said"))
    source = source.withColumn("_digest", digest(F.col("_bytes"))).withColumn("_html", _text_of(F.col("_bytes"), F.col("_head"))).drop("_bytes")
    source = source.withColumn("_text", plain_text(F.col("_html")))
    title = entities(F.trim(F.regexp_replace(F.regexp_extract("_html", r"(?is)<title\b[^>]*>(.*?)</title", 1), r"[ \t\r\n\f]+", " ")))
    fields = F.concat(
        F.lit("refers-to: "), F.col("record_id"), F.lit(f"{CRLF}payload-digest: "), F.col("_digest"), F.lit(f"{CRLF}title: "), title,
        F.lit(f"{CRLF}links: "), F.regexp_count("_html", F.lit(r"(?i)<a\s+[^>]*href")).cast("string"),
        F.lit(f"{CRLF}text-characters: "), F.length("_text").cast("string"), F.lit(CRLF),
        F.array_join(F.transform(F.split("_head", "\r?\n"), lambda line: F.concat(F.lit("http-header: "), line, F.lit(CRLF))), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=UTF-8").alias("content_type"), F.col("_text").alias("block")),
    )
    out = source.select(*keep, "record_id", "target_uri", "warc_date", "_head", "_digest", "_said", F.explode(kinds).alias("d"))
    return out.select(
        *keep, urn(F.col("d.warc_type"), F.coalesce("record_id", F.lit(""))).alias("record_id"), F.col("d.warc_type").alias("warc_type"), F.col("record_id").alias("refers_to"),
        "target_uri", "warc_date", F.col("d.content_type").alias("content_type"), F.octet_length("d.block").cast("long").alias("content_length"),
        digest(F.col("d.block")).alias("block_digest"), F.col("_digest").alias("source_digest"), (F.col("_digest") == F.col("_said")).alias("digest_ok"),
        F.col("_head").alias("source_headers"), F.col("d.block").alias("block"),
    )


def serialised(derived: DataFrame) -> DataFrame:
    """The records as WARC/1.1 text without the two closing line ends, one per row, in column `value`."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))
    return derived.select(F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF), F.col("block"),
    ).alias("value"))


#: A gzip member that holds nothing: it stands between records, where Spark's text writer puts its line separator.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def write_warc(derived: DataFrame, path: str) -> None:
    """Archive files, one per partition, written by Spark's own committer. Each record is a gzip member of its own, as archive
    readers need it to seek."""
    def members(batches):
        for batch in batches:
            packed = [gzip.compress(v + b"\r\n\r\n", mtime=0) for v in batch.column("value").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])

    out = serialised(derived).mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def inflated(data: bytes, step: int = 1 << 20):
    """The content of plain or gzip bytes (any number of members) in steps of bounded size."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, engine = 0, zlib.decompressobj(31)
    rest = memoryview(data)
    while at < len(rest):
        out = engine.decompress(rest[at : at + step], step)
        at += min(step, len(rest) - at) - len(engine.unconsumed_tail) - len(engine.unused_data)
        if out:
            yield out
        if engine.eof:
            engine = zlib.decompressobj(31)
            if bytes(rest[at : at + 2]) != b"\x1f\x8b":  # padding after the last member
                return


def parse_archive(parts):
    """The records of an archive as rows of SCHEMA, by Content-Length (bodies may hold anything). parts: its bytes in steps; no
    more than one record and a step is held."""
    held, parts = bytearray(), iter(parts)

    def more() -> bool:
        piece = next(parts, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (start := held.find(b"WARC/1.")) < 0:
            del held[: max(0, len(held) - 6)]
            if not more():
                return
        del held[:start]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split(CRLF)[1:]
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if k.strip()]
        low = {k.lower(): v for k, v in fields}
        said = low.get("content-length", "0")
        n = int(said) if said.isascii() and said.isdigit() else 0
        while len(held) < end + 4 + n and more():
            pass
        known = {"warc-type", "warc-record-id", "warc-target-uri", "warc-date"}
        yield low.get("warc-record-id"), low.get("warc-type"), low.get("warc-target-uri"), low.get("warc-date"), [{"name": k, "value": v} for k, v in fields if k.lower() not in known], bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n]


def read_warc(spark, path: str) -> DataFrame:
    """Archives (plain or gzip) as records. A file is read by one task, which holds its compressed bytes (2 GB at most, by Spark's
    reader; archives are near 1 GB as is usual) and one record at a time, however far it inflates."""
    names = ("record_id", "warc_type", "target_uri", "warc_date", "headers", "block")
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary())

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for row in parse_archive(inflated(content.as_py())):
                    rows.append(row)
                    held += len(row[5])
                    if held > 1 << 24 or len(rows) >= 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=list(names))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=list(names))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, SCHEMA)
