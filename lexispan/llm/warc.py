"""WARC records, and the resolution of not-modified revisits.

A revisit says that a server answered 304: the page is as it was. It is resolved to the latest full response of the same
canonical URL that is strictly earlier, if their validators agree (entity tags by weak comparison; modification dates
where not both have a tag), and its permitted headers then replace those of the response.

The as-of join is one range shuffle by (date, revisits first, identifier) and windows within ranges: each range's last response of
a URL is carried to the URL's later ranges, of which there are at most as many as shuffle partitions. So a URL that holds a
third of all records is dealt out over the ranges in which it falls, ties in date included. No pair of records is tried and
no response is joined by its identifier; headers travel with the response through the windows.

Leave payloads out of what is resolved: target_id names the response that holds them, and with_payload attaches them.

Defined cases: a full response gets the verdict "full" and its own headers; other records get "other". A null URL or one without a
host, or a null date, gives "no_earlier_response" for a revisit and never makes a target. Without a tag or date on both
sides the verdict is "unverified": the target is named, headers are not merged. Of responses of one URL and date (ties) the
greatest identifier counts, then the greatest hash of the headers; equal rows are each resolved. Revisits never are targets, so chains of
them lead to one response. Very long URLs and header lists are read whole; null headers count as none. Columns beyond those
named pass through, but for those with the name of an output column, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, filesystem, partitions

HEADERS = "array<struct<name:string,value:string>>"
RECORD = f"record_id string, type string, url string, date timestamp, profile string, status int, headers {HEADERS}, payload binary"
FULL_STATUS = (200,)
#: What a 304 response may change of a stored one (RFC 9110, 15.4.5, and RFC 9111, 3.2); lengths, encodings and cookies are not among them.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Parameters of a query that name a session or a campaign, not a page.
IGNORED = r"(?i)^(?:utm_[a-z]+|gclid|fbclid|sid|sessionid|phpsessid|jsessionid)(?:=|$)"
PAYLOAD_ROWS = 4096
_URL = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def canonical(url: Column) -> Column:
    """host, port unless usual, path without its last slashes, sorted parameters; null for null and for what has no host.

    Scheme, user, leading www, fragment, session and campaign parameters are left out; the host's case is ignored, the path's is not."""
    part = lambda k: F.regexp_extract(F.trim(url), _URL, k)
    host = F.regexp_replace(F.lower(part(1)), r"^www[0-9]*\.|\.$", "")
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.regexp_replace(F.regexp_replace(part(3), r"(?i);jsessionid=[^/]*", ""), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(part(4), "&"), lambda x: (x != "") & ~x.rlike(IGNORED))), "&")
    return F.when(host != "", F.concat(host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def header(headers: Column, name: str) -> Column:
    """The first value of a header; null if there is none."""
    return F.trim(F.get(F.filter(headers, lambda h: F.lower(F.trim(h["name"])) == name), F.lit(0))["value"])


def validated(revisit: Column, response: Column) -> Column:
    """Whether validators agree; null if no kind of validator is on both sides."""
    tag = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")
    return F.coalesce(tag(revisit) == tag(response), header(revisit, "last-modified") == header(response, "last-modified"))


def merged(response: Column, revisit: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """The response's headers, those that the revisit may change and has taken out, then the revisit's permitted ones."""
    name = lambda h: F.lower(F.trim(h["name"]))
    new = F.filter(revisit, lambda h: name(h).isin(*permitted))
    return F.concat(F.filter(response, lambda h: ~F.array_contains(F.transform(new, name), name(h))), new)


def resolve(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """records with canonical_url, verdict, target_id, target_date and merged_headers.

    records: record_id, type, url, date (of any ordered type), status, headers, and perhaps profile (a revisit of another
    profile than server-not-modified is "other"). Verdicts: full, resolved, validator_mismatch, unverified, no_earlier_response, other."""
    made = ("canonical_url", "verdict", "target_id", "target_date", "merged_headers")
    own = [c for c in records.columns if c not in made]
    no_headers = F.array().cast(HEADERS)
    not_modified = F.lit(True) if "profile" not in own else F.coalesce(F.contains(F.lower("profile"), F.lit("server-not-modified")), F.lit(True))
    kind = F.when((F.col("type") == "response") & F.col("status").isin(*FULL_STATUS), "full").when((F.col("type") == "revisit") & not_modified, "revisit").otherwise("other")
    rows = records.select(
        F.struct(*own).alias("r"), canonical(F.col("url")).alias("u"), F.col("date").alias("t"), kind.alias("kind"), F.col("record_id").alias("id"),
        F.coalesce(F.col("headers").cast(HEADERS), no_headers).alias("h"), F.xxhash64("headers").alias("x"),
    )
    placed = F.col("u").isNotNull() & F.col("t").isNotNull() & (F.col("kind") != "other")
    order = [F.col("t"), F.col("kind") == "full", F.col("id"), F.col("x")]
    # the range that a row falls in is fixed by this write, whatever is read again later
    ranged = cut(rows.filter(placed).repartitionByRange(partitions(records.sparkSession), *order).withColumn("part", F.spark_partition_id()), "op2-ranges")
    response = F.when(F.col("kind") == "full", F.struct("t", "id", "x", "h"))
    # a row for each URL and range that it falls in
    lasts = ranged.groupBy("u", "part").agg(F.max(response).alias("last"))
    earlier = Window.partitionBy("u").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut(lasts.select("u", "part", F.last("last", ignorenulls=True).over(earlier).alias("carried")), "op2-carried").filter("carried IS NOT NULL")
    within = Window.partitionBy("u", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumn("inside", F.last(response, ignorenulls=True).over(within)).join(carried, ["u", "part"], "left")
    target = F.when(F.col("kind") == "revisit", F.coalesce("inside", "carried"))
    found = found.select("r", "u", "kind", "h", target.alias("target"))
    unplaced = rows.filter(~placed | placed.isNull())
    found = found.unionByName(unplaced.select("r", "u", "kind", "h", F.lit(None).cast(found.schema["target"].dataType).alias("target")))
    agree = validated(F.col("h"), F.col("target.h"))
    verdict = F.when(F.col("kind") != "revisit", F.col("kind")).when(F.col("target").isNull(), "no_earlier_response").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("validator_mismatch")
    found = found.withColumn("verdict", verdict)
    kept = F.col("verdict").isin("resolved", "unverified")
    headers = F.when(F.col("verdict") == "full", F.col("h")).when(F.col("verdict") == "resolved", merged(F.col("target.h"), F.col("h"), permitted))
    return found.select("r.*", F.col("u").alias("canonical_url"), "verdict", F.when(kept, F.col("target.id")).alias("target_id"), F.when(kept, F.col("target.t")).alias("target_date"), headers.alias("merged_headers"))


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """resolved with the payload of the record itself or, for a resolved revisit, of its target (record_id, payload of records; ids are unique).

    A target of many revisits is copied once for each PAYLOAD_ROWS of them, so that no task takes them all."""
    named = resolved.withColumn("holder", F.when(F.col("verdict") == "resolved", F.col("target_id")).otherwise(F.col("record_id")))
    # a row for each holder that needs copies
    copies = cut(named.groupBy("holder").agg(F.count("*").alias("n")).filter(F.col("n") > PAYLOAD_ROWS).select("holder", F.ceil(F.col("n") / PAYLOAD_ROWS).cast("int").alias("n")), "op2-copies")
    own = records.select(F.col("record_id").alias("holder"), "payload").join(copies, "holder", "left")
    own = own.select("holder", "payload", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("copy"))
    dealt = named.join(copies, "holder", "left").withColumn("copy", F.pmod(F.xxhash64("record_id"), F.coalesce("n", F.lit(1))).cast("int"))
    return dealt.join(own, ["holder", "copy"], "left").select(*resolved.columns, "payload")


# --- files ---


def _lines(stream) -> Iterator[bytes]:
    while (line := stream.readline()) not in (b"", b"\r\n", b"\n"):
        yield line


def _fields(lines) -> list[tuple[str, str]]:
    """Names and values; a line that begins with white space goes on with the value before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse(stream) -> Iterator[dict]:
    """The records of an uncompressed WARC stream. What stands before a version line is passed over; a record that ends early ends the stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {k.lower(): v for k, v in _fields(_lines(stream))}
        size = int(fields.get("content-length", "0"))
        block = stream.read(size)
        if len(block) < size:
            return
        status, headers, payload = None, [], block
        if "application/http" in fields.get("content-type", "") and block.startswith(b"HTTP/"):
            body = io.BytesIO(block)
            first = body.readline().split()
            status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
            headers = _fields(_lines(body))
            payload = body.read()
        yield {"record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "url": (fields.get("warc-target-uri") or "").strip("<>") or None, "date": fields.get("warc-date"), "profile": fields.get("warc-profile"), "status": status, "headers": headers, "payload": payload}


def write(stream, records) -> None:
    """Writes records as parse gives them; those with a status as HTTP messages."""
    for r in records:
        http = r["status"] is not None
        head = f"HTTP/1.1 {r['status']} \r\n{''.join(f'{k}: {v}\r\n' for k, v in r['headers'])}\r\n".encode() if http else b""
        block = head + (r["payload"] or b"")
        named = {"WARC-Type": r["type"], "WARC-Record-ID": r["record_id"], "WARC-Target-URI": r["url"], "WARC-Date": r["date"], "WARC-Profile": r["profile"], "Content-Type": "application/http" if http else "application/octet-stream", "Content-Length": len(block)}
        stream.write(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n")


def read(spark: SparkSession, uris: DataFrame) -> DataFrame:
    """The records of WARC files (uri, a file in each row), gzipped record by record or not; each file is streamed by one task, a few megabytes at a time."""

    def run(batches):
        import gzip

        import pyarrow as pa

        types = [pa.string()] * 5 + [pa.int32(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary()]
        names = ["record_id", "type", "url", "date", "profile", "status", "headers", "payload"]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)
        for b in batches:
            for uri in b.column(0).to_pylist():
                system, path = filesystem(uri)
                with system.open_input_stream(path, compression=None) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)
                    rows: list[dict] = []
                    size = 0
                    for r in parse(stream):
                        rows.append(r | {"headers": [{"name": k, "value": v} for k, v in r["headers"]]})
                        size += len(r["payload"])
                        if size > 1 << 22:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    text = RECORD.replace("date timestamp", "date string")
    return uris.select(F.col("uri").cast("string")).mapInArrow(run, text).withColumn("date", F.to_timestamp("date"))


# --- the query: a crawl of the table of pages ---

#: Second s of the crawl as a date of HTTP.
_DATE = "concat(date_format(date_add(DATE'2023-11-01', CAST(({s}) div 86400 AS INT)), 'EEE, dd MMM yyyy'), ' ', lpad(CAST(({s}) % 86400 div 3600 AS STRING), 2, '0'), ':', lpad(CAST(({s}) % 3600 div 60 AS STRING), 2, '0'), ':', lpad(CAST(({s}) % 60 AS STRING), 2, '0'), ' GMT')"


def crawl(pages: DataFrame) -> DataFrame:
    """Three records for each page: its response; a revisit under another spelling of its URL, of each kind in turn; and a record of its host's
    robots.txt, a response for each eighth page and a revisit else, so that a host of many pages is a URL of many records."""
    p = pages.selectExpr("page_id AS i", "url", "md5(coalesce(html, '')) AS md5", "octet_length(coalesce(html, '')) AS size")
    date = lambda s: _DATE.format(s=s)
    again = "concat(regexp_replace(regexp_replace(url, '#.*$', ''), '^http:', 'HTTPS:'), if(contains(url, '?'), '&', '?'), 'utm_medium=recrawl#again')"
    field = lambda n, v: f"named_struct('name', '{n}', 'value', {v})"
    tag = "CASE WHEN i % 10 = 3 THEN '\"stale\"' WHEN i % 10 IN (7, 9) THEN NULL ELSE concat('W/\"', md5, '\"') END"
    since = f"CASE WHEN i % 10 = 7 THEN {date('i')} END"
    robots = "concat('\"r', CAST(i div 64 AS STRING), '\"')"
    listed = lambda *x: f"filter(array({', '.join(x)}), x -> x.value IS NOT NULL)"
    own = p.selectExpr("concat('p', i) AS record_id", "'response' AS type", "url", "i AS date", "200 AS status", listed(field("Date", date("i")), field("Content-Type", "'text/html'"), field("Content-Length", "CAST(size AS STRING)"), field("ETag", "concat('\"', md5, '\"')"), field("Last-Modified", date("i")), field("Cache-Control", "'max-age=60'")) + " AS headers")
    later = "if(i % 10 = 5, i - 1, i + 1000)"
    revisit = p.selectExpr("concat('q', i) AS record_id", "'revisit' AS type", f"{again} AS url", f"{later} AS date", "304 AS status", listed(field("date", date("i + 1000")), field("ETag", tag), field("Last-Modified", since), field("Cache-Control", "'max-age=120'"), field("Content-Length", "'0'"), field("Set-Cookie", "concat('sid=', i)")) + " AS headers")
    of_host = p.selectExpr("concat('r', i) AS record_id", "if(i % 8 = 0, 'response', 'revisit') AS type", "concat(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*', 0), '/robots.txt') AS url", "i AS date", "if(i % 8 = 0, 200, 304) AS status", listed(field("Date", date("i")), field("ETag", robots), field("Expires", date("i + 60"))) + " AS headers")
    return own.unionByName(revisit).unionByName(of_host)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(crawl(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    text = F.array_join(F.transform("merged_headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return found.select("record_id", "type", "canonical_url", "verdict", "target_id", text.alias("headers"))


def _http(s: str) -> str:
    return f"strftime(TIMESTAMP '2023-11-01' + to_seconds({s}), '%a, %d %b %Y %H:%M:%S GMT')"


_NAMED = lambda n, v: f"{{'n': '{n}', 'v': {v}}}"
_LIST = lambda *x: f"list_filter([{', '.join(x)}], lambda x: x.v IS NOT NULL)"
_TAG = "CASE WHEN i % 10 = 3 THEN '\"stale\"' WHEN i % 10 IN (7, 9) THEN NULL ELSE 'W/\"' || md5 || '\"' END"
_OF = lambda h, n: f"list_filter({h}, lambda x: lower(x.n) = '{n}')[1].v"
_ALLOWED = "('age', 'cache-control', 'content-location', 'date', 'etag', 'expires', 'last-modified', 'vary')"
ORACLE = rf"""
WITH p AS (SELECT page_id AS i, url, md5(coalesce(html, '')) AS md5, strlen(coalesce(html, '')) AS size FROM pages),
rec AS (
  SELECT 'p' || i AS record_id, 'response' AS type, url, i AS t, {_LIST(_NAMED("Date", _http("i")), _NAMED("Content-Type", "'text/html'"), _NAMED("Content-Length", "size::VARCHAR"), _NAMED("ETag", "'\"' || md5 || '\"'"), _NAMED("Last-Modified", _http("i")), _NAMED("Cache-Control", "'max-age=60'"))} AS h FROM p
  UNION ALL SELECT 'q' || i, 'revisit', regexp_replace(regexp_replace(url, '#.*$', ''), '^http:', 'HTTPS:') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=recrawl#again', CASE WHEN i % 10 = 5 THEN i - 1 ELSE i + 1000 END,
    {_LIST(_NAMED("date", _http("i + 1000")), _NAMED("ETag", _TAG), _NAMED("Last-Modified", f"CASE WHEN i % 10 = 7 THEN {_http('i')} END"), _NAMED("Cache-Control", "'max-age=120'"), _NAMED("Content-Length", "'0'"), _NAMED("Set-Cookie", "'sid=' || i"))} FROM p
  UNION ALL SELECT 'r' || i, CASE WHEN i % 8 = 0 THEN 'response' ELSE 'revisit' END, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || '/robots.txt', i, {_LIST(_NAMED("Date", _http("i")), _NAMED("ETag", "'\"r' || (i // 64) || '\"'"), _NAMED("Expires", _http("i + 60")))} FROM p),
cut AS (SELECT *, regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host, regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#:]*:([0-9]*)', 1) AS port, regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)', 1) AS path, regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1) AS q FROM rec),
named AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{IGNORED}'))) AS params FROM cut),
keyed AS (SELECT record_id, type, t, h, CASE WHEN host <> '' THEN regexp_replace(lower(host), '^www[0-9]*\.|\.$', '') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || regexp_replace(path, '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS u FROM named),
full_ AS (SELECT u, t, max_by(record_id, record_id) AS id, max_by(h, record_id) AS h FROM keyed WHERE type = 'response' AND u IS NOT NULL AND t IS NOT NULL GROUP BY u, t),
found AS (SELECT k.*, f.id, f.h AS fh FROM (SELECT * FROM keyed WHERE type = 'revisit') k ASOF LEFT JOIN full_ f ON k.u = f.u AND k.t > f.t),
judged AS (SELECT *, coalesce(regexp_replace({_OF("h", "etag")}, '^W/', '') = regexp_replace({_OF("fh", "etag")}, '^W/', ''), {_OF("h", "last-modified")} = {_OF("fh", "last-modified")}) AS agree, list_filter(h, lambda x: lower(x.n) IN {_ALLOWED}) AS new FROM found),
done AS (SELECT record_id, type, u, CASE WHEN id IS NULL THEN 'no_earlier_response' WHEN agree IS NULL THEN 'unverified' WHEN agree THEN 'resolved' ELSE 'validator_mismatch' END AS verdict, id,
  list_concat(list_filter(fh, lambda x: NOT list_contains(list_transform(new, lambda y: lower(y.n)), lower(x.n))), new) AS m FROM judged)
SELECT record_id, type, u AS canonical_url, verdict, CASE WHEN verdict IN ('resolved', 'unverified') THEN id END AS target_id, CASE WHEN verdict = 'resolved' THEN array_to_string(list_transform(m, lambda x: x.n || ': ' || x.v), chr(10)) END AS headers FROM done
UNION ALL SELECT record_id, type, u, 'full', NULL, array_to_string(list_transform(h, lambda x: x.n || ': ' || x.v), chr(10)) FROM keyed WHERE type = 'response'
"""
