import hashlib

from brevispark.llm import warc as op

HTML = "<html><head><title>A &amp; B</title><script>x<y</script></head><body><!-- no --><p>One  &lt;two&gt;&#33; &#x41;</p><br><ul><li><a href='x'>Link</a></li></ul>tail&nbsp;&copy;</body>"


def test_text_of_a_page(spark):
    many = "<p>&eacute;&Uuml;&szlig; &ngE; &nosuch; &amp;eacute; &#38;lt; &AMP;lt; &lt;p&gt; &#233;&#xE9; & &; &copy no</p>"
    df = spark.createDataFrame([(1, HTML), (2, ""), (3, "<p>&#99999999; &#xD800; a < b</p>"), (4, many)], "i int, html string")
    got = {r.i: r.t for r in df.select("i", op.plain_text(df["html"]).alias("t")).collect()}
    assert got[1] == "One <two>! A\nLink\ntail\u00a0©" and got[2] == "" and got[3] == "&#99999999; &#xD800; a < b"
    assert got[4] == "éÜß ≧̸ &nosuch; &eacute; &lt; &lt; <p> éé & &; &copy no"


def test_the_sql_twin_reads_references_too(spark):
    import duckdb
    import pandas as pd

    from brevispark.llm import queries

    pages = [HTML, "<p>&#8212; &eacute; &#38;lt; &amp;amp; &#xD800; &nosuch; &ngE;</p>", "<title>&#8212;&Auml;</title>x &#x1F600; &#1114112;", None, "", "a & b &#; &#x; &;"]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(pages)), "url": ["http://a/"] * len(pages), "html": pages}))
    want = con.execute(f"SELECT page_id, warc_type, block FROM ({queries.ORACLE_SQL['op10_warc']})").fetchall()
    df = spark.createDataFrame([(i, "http://a/", h) for i, h in enumerate(pages)], "page_id bigint, url string, html string")
    got = op.derivatives(op.responses(df), keep=("page_id",)).select("page_id", "warc_type", "block").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_payloads_of_bytes(spark):
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html"
    bodies = {"latin": (head + b"; charset=ISO-8859-1\r\n\r\n", b"<p>caf\xe9 \r\n\r\n x"), "broken": (head + b"\r\n\r\n", b"<p>a\xff\xe2\x82 b\r\n\r\n c"), "utf8": (head + b"\r\n\r\n", "<p>Р РР – é".encode()), "odd head": (b"H\xe2: \xff\r\n\r\n", b"<p>y")}
    rows = [(k, "response", "u", "d", [("WARC-Payload-Digest", "sha256:" + hashlib.sha256(body).hexdigest())], h + body) for k, (h, body) in bodies.items()]
    got = {r.refers_to: r for r in op.derivatives(spark.createDataFrame(rows, op.SCHEMA)).where("warc_type = 'conversion'").collect()}
    assert all(r.digest_ok for r in got.values())
    assert {k: r.block for k, r in got.items()} == {"latin": "café\nx".replace("\n", " "), "broken": "a\ufffd\ufffd b c", "utf8": "Р РР – é", "odd head": "y"}


def test_archives_are_read_record_by_record(spark, tmp_path):
    import gzip

    record = lambda i, body: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    bodies = [b"plain", b"", b"WARC/1.0 inside \r\n\r\n", b"\xff\x00" * 50_000, b"0" * 30_000_000]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies)) + b"\0" * 9)
    (tmp_path / "b.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(bodies[:4])))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(record(i, b) for i, b in enumerate(bodies[:4])))[:-30])  # cut off
    read = lambda name: {r.record_id: bytes(r.block) for r in op.read_warc(spark, str(tmp_path / name)).collect()}
    assert read("a.warc.gz") == {f"<{i}>": b for i, b in enumerate(bodies)}
    assert read("b.warc") == {f"<{i}>": b for i, b in enumerate(bodies[:4])}
    assert set(read("c.warc.gz")) >= {"<0>", "<1>", "<2>"}
    assert len(list(op.inflated((tmp_path / "a.warc.gz").read_bytes()))) > 25  # in steps of a megabyte


def test_records_are_linked_and_read_back(spark, tmp_path):
    rows = [(1, "http://a/x", HTML), (2, None, None), (None, "http://b", "plain"), (1, "http://a/x", HTML), (5, "http://c", "x " * 100_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, block string")
    records = op.responses(pages)
    derived = op.derivatives(records, keep=("page_id",))
    got = derived.collect()
    assert len(got) == 10 and {r.warc_type for r in got} == {"metadata", "conversion"} and all(r.digest_ok for r in got)
    sources = {r.record_id for r in records.collect()}
    assert {r.refers_to for r in got} == sources
    for r in got:
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.source_headers.startswith("HTTP/1.1 200 OK\r\nContent-Type")
        if r.warc_type == "metadata":
            assert f"refers-to: {r.refers_to}\r\n" in r.block and f"payload-digest: {r.source_digest}\r\n" in r.block
    op.write_warc(derived, str(tmp_path / "out"))
    back = op.read_warc(spark, str(tmp_path / "out") + "/part-*").collect()
    assert sorted((r.record_id, bytes(r.block)) for r in back) == sorted((r.record_id, r.block.encode()) for r in got)
    files = list((tmp_path / "out").glob("part-*"))
    import gzip

    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID") for f in files) == 10
    assert sum(f.read_bytes().count(op.EMPTY_MEMBER) for f in files) >= 10  # each record ends its own member
    links = {r.record_id: dict((h.name, h.value) for h in r.headers)["WARC-Refers-To"] for r in back}
    assert links == {r.record_id: r.refers_to for r in got}


def test_odd_records(spark):
    rows = [("<a>", "response", None, None, None, b"HTTP/1.1 200 OK"), ("<b>", "request", "u", "d", [], b"x"), ("<c>", "response", "u", "d", [("WARC-Payload-Digest", "sha256:no")], None), (None, "response", "u", "d", [], b"H: 1\r\n\r\n<p>x")]
    got = op.derivatives(spark.createDataFrame(rows, op.SCHEMA)).collect()
    by = {(r.refers_to, r.warc_type): r for r in got}
    assert len(got) == 6 and by["<a>", "conversion"].block == "" and by["<a>", "conversion"].digest_ok is None
    assert by["<c>", "metadata"].digest_ok is False and next(r for r in got if r.block == "x").warc_type == "conversion"
    # without an id of its own a response gets one, and both its derivatives tell it; another response gets another
    own = [r for r in got if r.refers_to not in ("<a>", "<c>")]
    assert len(own) == 2 and len({r.refers_to for r in own}) == 1 and own[0].refers_to.startswith("<urn:uuid:") and all(r.block is not None and r.content_length is not None for r in own) and len({r.record_id for r in own}) == 2
    more = op.derivatives(spark.createDataFrame([(None, "response", "u", "d", [], b"H: 1\r\n\r\n<p>y"), (None, "response", None, None, [], None)], op.SCHEMA)).collect()
    assert len({r.refers_to for r in [*own, *more]}) == 3 and len({r.record_id for r in [*own, *more]}) == 6 and all(own[0].refers_to in r.block for r in own if r.warc_type == "metadata")
    assert op.derivatives(spark.createDataFrame([], op.SCHEMA)).count() == 0
