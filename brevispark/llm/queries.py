"""The registered queries of the corpus operators: op1_ ... op13_, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, license_scan, packing, pii, sentencepiece_codec, substring_dedup, topk_search, url_filter, vector_codes, warc, whitening
from .common import table

#: Rules of the URL query, fixed by its contract.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The block list of the URL query: a table of domain names, each with its subdomains, made of these words by rule.
BLOCKED_FIRST = "ads adult best big buy casino cash cheap click crypto daily deal easy fake fast free gold hot instant lucky mega money online pay poker prize quick rich safe spam super top track vip win x".split()
BLOCKED_LAST = "bets bonus cards clicks club coins credit dates deals farm games gifts loans market money news offers pills play prizes profit sale shop slots spins store tickets track traffic win x zone".split()
BLOCKED_ENDS = ("example.com", "example.net", "example.org")


def blocked_names(spark: SparkSession) -> DataFrame:
    """The block list as rows of `key`: first-last.end, for all words and ends."""
    parts = [F.explode(F.array(*map(F.lit, words))) for words in (BLOCKED_FIRST, BLOCKED_LAST, BLOCKED_ENDS)]
    rows = spark.range(1).select(parts[0].alias("a")).select("a", parts[1].alias("b")).select("a", "b", parts[2].alias("c"))
    return rows.select(F.concat("a", F.lit("-"), "b", F.lit("."), "c").alias("key"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), k=50))


_WORDS = r"w AS (SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS ws FROM documents)"
_OP1_SQL = f"""
WITH {_WORDS}, starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w), k AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS seq FROM starts),
firsts AS (SELECT seq, min(doc_id) AS m FROM k GROUP BY 1), hit AS (SELECT doc_id, i FROM k JOIN firsts USING (seq) WHERE m < doc_id), cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w), left_ AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN cov ON words.doc_id = cov.doc_id AND words.p = cov.p GROUP BY 1),
gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY 1)
SELECT w.doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN left_ USING (doc_id)"""

#: The tokenizer of the SentencePiece query; its file is looked up where the tokenizers are installed.
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), piece_model_path(), packed=True))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


_OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS bigint) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def held_out() -> Column:
    """The fold that language models never learn from, fixed by the contract."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.5, least=5)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, width=5)
    return found.select("doc_id", "class_id", "set_id", "n_copies", "n_links", "n_linked")


_OP7_SQL = f"""
WITH RECURSIVE {_WORDS},
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE ['', cast(doc_id AS varchar)] END AS k FROM w),
cls AS (SELECT k, min(doc_id) AS rep, count(*) AS copies, len(k) AS n FROM s GROUP BY k), t AS (SELECT rep, n, copies, unnest(k) AS sh FROM cls WHERE k[1] <> ''),
e AS (SELECT a.rep AS a, b.rep AS b, any_value(b.copies) AS copies FROM t a JOIN t b ON a.sh = b.sh AND a.rep <> b.rep GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
comp(rep, c) AS (SELECT rep, rep FROM cls UNION SELECT e.b, comp.c FROM comp JOIN e ON e.a = comp.rep), least_ AS (SELECT rep, min(c) AS class_id FROM comp GROUP BY 1),
l AS (SELECT a AS rep, count(*) AS n_links, cast(sum(copies) AS bigint) AS n_linked FROM e GROUP BY 1)
SELECT s.doc_id, class_id, cls.rep AS set_id, copies AS n_copies, coalesce(n_links, 0) AS n_links, coalesce(n_linked, 0) AS n_linked FROM s JOIN cls USING (k) JOIN least_ ON least_.rep = cls.rep LEFT JOIN l ON l.rep = cls.rep"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fold = F.coalesce(held_out(), F.lit(False))
    model = language_id.train(documents.where(~fold))
    out = language_id.identify(documents.select("doc_id", "text"), model)
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, blocked_names(spark))


def _op9_sql() -> str:
    rules = ", ".join(f"('{v}', '{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for v, t in URL_RULES)
    first, last, ends = (f"(SELECT unnest({list(w)}) AS w)" for w in (BLOCKED_FIRST, BLOCKED_LAST, BLOCKED_ENDS))
    return f"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES {rules}), listed AS (SELECT a.w || '-' || b.w || '.' || c.w AS d FROM {first} a, {last} b, {ends} c),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM listed WHERE p.host = d OR ends_with(p.host, '.' || d)) THEN 'block' ELSE 'allow' END AS method_verdict,
  (SELECT max({{'n': length(r.rule), 'r': r.rule, 'v': r.verdict}}) FROM rules r WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) AS best FROM parts p)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, method_verdict) AS verdict, method_verdict FROM m"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")), keep=("page_id",))


def _op10_sql() -> str:
    def urn(expr: str) -> str:
        return f"(SELECT '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' FROM (SELECT md5({expr}) AS h))"

    q = lambda s: "'" + s.replace("'", "''") + "'"
    crlf = "chr(13) || chr(10)"

    def entities(text: str) -> str:
        code = "regexp_extract(p, '^(x[0-9a-fA-F]{1,6}|[0-9]{1,7});', 1)"
        number = f"CASE WHEN {code} = '' THEN 0 WHEN starts_with({code}, 'x') THEN cast('0x' || substr({code}, 2) AS integer) ELSE cast({code} AS integer) END"
        char = f"CASE WHEN {number} = 38 THEN '&amp;' ELSE chr({number}) END"
        numbered = f"CASE WHEN {number} BETWEEN 1 AND 1114111 AND NOT {number} BETWEEN 55296 AND 57343 THEN {char} || substr(p, length({code}) + 2) ELSE '&#' || p END"
        name = f"regexp_extract(p, '{warc.REFERENCE}', 1)"
        known = "MAP {" + ", ".join(f"{q(n)}: {q(c)}" for n, c in warc.NAMED.items()) + "}"
        named = f"coalesce(({known})[{name}] || substr(p, length({name}) + 2), '&' || p)"
        each = lambda mark, of: f"(SELECT x[1] || array_to_string(list_transform(x[2:], lambda p: {of}), '') FROM (SELECT string_split(t, '{mark}') AS x))"
        return f"(SELECT replace({each('&', named)}, '&amp;', '&') FROM (SELECT {each('&#', numbered)} AS t FROM (SELECT {text} AS t)))"

    body = f"regexp_replace(regexp_replace(html, {q(warc.HIDDEN)}, ' ', 'g'), {q(warc.WIDE)}, ' ', 'g')"
    body = entities(f"regexp_replace(regexp_replace({body}, {q(warc.BREAKS)}, chr(10), 'g'), {q(warc.TAG)}, '', 'g')")
    body = f"regexp_replace({body}, ' *\\n[ \\n]*', chr(10), 'g')"
    body = f"trim({body}, ' ' || chr(10))"
    title = entities(f"trim(regexp_replace(regexp_extract(html, {q('(?is)<title' + chr(92) + 'b[^>]*>(.*?)</title')}, 1), '[ \\t\\r\\n\\f]+', ' ', 'g'))")
    return f"""
WITH src AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
a AS (SELECT *, {urn("concat_ws(chr(0), 'response', coalesce(cast(page_id AS varchar), ''), coalesce(target_uri, ''), sha256(html))")} AS refers_to, 'sha256:' || sha256(html) AS source_digest,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || cast(n AS varchar) AS source_headers, {body} AS body, {title} AS title FROM src),
b AS (SELECT *, 'refers-to: ' || refers_to || {crlf} || 'payload-digest: ' || source_digest || {crlf} || 'title: ' || title || {crlf} || 'links: ' || cast(len(regexp_extract_all(html, '(?i)<a\\s+[^>]*href')) AS varchar) || {crlf}
  || 'text-characters: ' || cast(length(body) AS varchar) || {crlf} || 'http-header: ' || replace(source_headers, {crlf}, {crlf} || 'http-header: ') || {crlf} AS fields FROM a),
c AS (SELECT page_id, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, fields AS block, refers_to, target_uri, source_digest, source_headers FROM b
  UNION ALL SELECT page_id, 'conversion', 'text/plain; charset=UTF-8', body, refers_to, target_uri, source_digest, source_headers FROM b)
SELECT page_id, {urn("concat_ws(chr(0), warc_type, refers_to)")} AS record_id, warc_type, refers_to, target_uri, '2026-01-01T00:00:00Z' AS warc_date, content_type,
  cast(octet_length(encode(block)) AS bigint) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, true AS digest_ok, source_headers, block FROM c"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def _op11_sql(rounds: int = 4) -> str:
    assigned = lambda r: f"""a{r} AS (SELECT rid, p, min({{'d': cast(n + m - 2 * list_inner_product(v, w) AS bigint), 'e': e}}) AS best FROM
  (SELECT rid, p, v, list_inner_product(v, v) AS n FROM parts) JOIN (SELECT p, e, w, list_inner_product(w, w) AS m FROM b{r}) USING (p) GROUP BY 1, 2)"""  # noqa: E731
    moved = lambda r: f"""m{r} AS (SELECT p, e, list(x ORDER BY j) AS w FROM (SELECT p, a{r}.best.e AS e, j, floor(sum(v[j]) / count(*)) AS x FROM a{r} JOIN parts USING (rid, p), (SELECT unnest(range(1, 1000)) AS j) WHERE j <= len(v) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r + 1} AS (SELECT p, e, coalesce(m{r}.w, b{r}.w) AS w FROM b{r} LEFT JOIN m{r} USING (p, e))"""  # noqa: E731
    steps = ",\n".join(f"{assigned(r)},\n{moved(r)}" for r in range(rounds))
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x AS double))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows_ AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid FROM kept),
parts AS (SELECT rid, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS v FROM rows_, (SELECT unnest(range(4)) AS p)),
b0 AS (SELECT p, rid - 1 AS e, v AS w FROM parts WHERE rid <= 256),
{steps},
{assigned(rounds)},
coded AS (SELECT rid, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, cast(sum(best.d) AS bigint) AS error FROM a{rounds} GROUP BY 1),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x: cast(x AS bigint)), ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, h AS codebooks_sha256 FROM rows_ JOIN coded USING (rid), books"""


#: The tokenizer of the packing query, and what ends a document, fixed by its contract.
BYTE_TOKENIZER, END = "byte_bpe_50k.json", 2


def byte_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path(BYTE_TOKENIZER), encoding="utf-8") as f:
        return f.read()


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_tokenizer(), capacity=1024, end=END)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32, scale=64)


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_sentencepiece": op2_sentencepiece, "op3_topk": op3_topk, "op4_license_scan": op4_license_scan, "op5_pii": op5_pii, "op6_decontaminate": op6_decontaminate, "op7_jaccard_join": op7_jaccard_join, "op8_language_id": op8_language_id, "op9_url_filter": op9_url_filter, "op10_warc": op10_warc, "op11_vector_codes": op11_vector_codes, "op12_packing": op12_packing, "op13_whitening": op13_whitening}
ORACLE_SQL = {"op1_substring_dedup": _OP1_SQL, "op7_jaccard_join": _OP7_SQL, "op3_topk": _OP3_SQL, "op9_url_filter": _op9_sql(), "op10_warc": _op10_sql(), "op11_vector_codes": _op11_sql()}
