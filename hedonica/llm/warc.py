"""Web archive records, and what their not-modified revisits stand for.

A revisit of status 304 says only that a page had not changed. It is resolved by an as-of
join: the latest earlier full response (type ``response``, status 200) of the same canonical
URL. If their validators agree (entity tags without regard to ``W/``; else the dates of last
modification), the revisit takes over that response's headers, with those replaced that a
304 may update.

The join sorts all records by URL and date over tasks and looks back inside each part, so a
URL with a third of all records is spread over many tasks. A URL that goes on from one part
into the next (there are fewer of those than parts) gets the last response of earlier parts
from a small table. Only URLs, dates and headers are shuffled, never bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedonica.session import settled, written

HEADERS = "array<struct<name:string,value:string>>"
# Headers of a 304 that replace stored ones (fixed values, from the HTTP standard).
PERMITTED = [
    "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary",
]
# Query parameters that do not change the page.
TRACKING = "(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical(url: Column) -> Column:
    """Host in lower case and path, without scheme, ``www.``, default port, fragment, tracking
    parameters and closing slash; other parameters sorted. NULL and blank give NULL."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    plain = F.regexp_replace(plain, "^(?i)[a-z][a-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(plain, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, ":(?:80|443)$", ""), "^www\\.", "")
    path = F.regexp_extract(plain, "^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(plain, "\\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i){TRACKING}(?:=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(whole != "", whole)


def header_list(block: Column) -> Column:
    """Headers of a block after its first line, names in lower case, in their order."""
    lines = F.split(block, "\\r?\\n")
    lines = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.instr(x, ":") > 1)
    return F.transform(lines, lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"),
        F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value"),
    ))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, or NULL."""
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def parsed(raw: DataFrame, record: str = "record") -> DataFrame:
    """``record_id, url, date, type, status, headers, body`` of the text of each record.

    What a record lacks is NULL (headers: none), a NULL record all of it.
    """
    parts = raw.select(F.split(F.col(record), "\\r?\\n\\r?\\n", 3).alias("p"))
    parts = parts.select(
        header_list(F.get("p", F.lit(0))).alias("w"), F.get("p", F.lit(1)).alias("http"),
        F.get("p", F.lit(2)).alias("body"),
    )
    return parts.select(
        header(F.col("w"), "warc-record-id").alias("record_id"),
        header(F.col("w"), "warc-target-uri").alias("url"),
        F.try_to_timestamp(header(F.col("w"), "warc-date")).alias("date"),
        header(F.col("w"), "warc-type").alias("type"),
        F.nullif(F.regexp_extract("http", "^HTTP/[0-9.]+ ([0-9]{3})", 1), F.lit("")).cast("int").alias("status"),
        F.coalesce(header_list(F.col("http")), F.array().cast(HEADERS)).alias("headers"),
        "body",
    )


def tag(headers: Column) -> Column:
    return F.regexp_replace(header(headers, "etag"), "^W/", "")


def agreeing(mine: Column, theirs: Column) -> Column:
    """Whether validators agree; NULL if the two have none in common."""
    modified = header(mine, "last-modified") == header(theirs, "last-modified")
    return F.coalesce(tag(mine) == tag(theirs), modified)


def merged(stored: Column, update: Column) -> Column:
    """Stored headers, those replaced that the update has and may replace."""
    new = F.filter(update, lambda h: h["name"].isin(PERMITTED))
    names = F.transform(new, lambda h: h["name"])
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), new)


def resolved(records: DataFrame) -> DataFrame:
    """``record_id, canonical_url, date, outcome, refers_to, headers`` of every record.

    The outcome is ``full`` for full responses, ``other`` for what is neither one nor a 304
    revisit; for revisits ``resolved``, ``no_earlier`` (also if URL or date is missing),
    ``changed`` (validators differ) or ``unverified`` (none in common). ``refers_to`` is the
    latest earlier response, whatever the outcome. Of responses with one date the greatest
    ``record_id`` is the latest. Repeated records are judged alike; an empty table gives no
    rows; extra columns are left out.
    """
    status = F.coalesce("status", F.lit(0))
    full = (F.col("type") == "response") & (status == 200)
    revisit = (F.col("type") == "revisit") & (status == 304)
    events = records.select(
        "record_id", canonical(F.col("url")).alias("key"), "date", "headers",
        F.when(full, "full").when(revisit, "revisit").otherwise("other").alias("kind"),
    ).withColumn("is_full", F.coalesce(F.col("kind") == "full", F.lit(False)))
    usable = F.col("is_full") & F.col("date").isNotNull() & F.col("key").isNotNull()
    events = events.withColumn("ref", F.when(usable, F.struct("record_id", "headers")))
    order = ["key", "date", "is_full", "record_id"]  # a revisit comes before responses of its date
    parts = events.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = written(parts, "warc-events")

    before = Window.partitionBy("part", "key").orderBy(*order[1:])
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    near = parts.withColumn("near", F.last("ref", ignorenulls=True).over(before))
    carried, small = settled(_carried(parts), "warc-carried")
    joined = near.join(F.broadcast(carried) if small else carried, ["part", "key"], "left")

    found = F.when(F.col("date").isNotNull(), F.coalesce("near", "earlier"))
    joined = joined.withColumn("found", F.when(F.col("kind") == "revisit", found))
    agree = agreeing(F.col("headers"), F.col("found.headers"))
    outcome = (
        F.when(F.col("kind") != "revisit", F.col("kind"))
        .when(F.col("found").isNull(), "no_earlier")
        .when(agree, "resolved")
        .when(~agree, "changed")
        .otherwise("unverified")
    )
    joined = joined.withColumn("outcome", outcome)
    taken = F.col("outcome") == "resolved"
    return joined.select(
        "record_id", F.col("key").alias("canonical_url"), "date", "outcome",
        F.col("found.record_id").alias("refers_to"),
        F.when(taken, merged(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def _carried(parts: DataFrame) -> DataFrame:
    """``part, key, earlier``: for URLs in several parts, the last response of earlier parts.

    Ranges split a URL only at the border of two parts: a part has at most one URL that comes
    from the part before and one that goes on, so there are at most two rows a part.
    """
    spans = parts.where("key is not null").groupBy("key").agg(
        F.min("part").alias("low"), F.max("part").alias("high")
    )
    spans, small = settled(spans.where("low < high").select("key"), "warc-spans")
    split = parts.join(F.broadcast(spans) if small else spans, "key", "left_semi")
    latest = F.when(F.col("ref").isNotNull(), F.struct("date", "record_id"))
    tails = split.groupBy("key", "part").agg(F.max_by("ref", latest).alias("tail"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.last("tail", ignorenulls=True).over(before)
    return tails.select("part", "key", earlier.alias("earlier")).where("earlier is not null")


def with_body(resolved_records: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits and the body they stand for, by one join on the response's id."""
    bodies = records.select(F.col("record_id").alias("refers_to"), "body").where("body is not null")
    return resolved_records.where("outcome = 'resolved'").join(bodies, "refers_to")


# --- records of a crawl --------------------------------------------------------------------


def _text(first: str, headers: dict[str, Column | str]) -> Column:
    """A block of headers; those of NULL value are left out."""
    lines = [F.lit(first)]
    lines += [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in headers.items()]
    return F.concat_ws("\r\n", *lines)


def _record(kind: str, name: Column, minute: Column, http: Column, body: Column) -> Column:
    when = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + 60 * minute), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = _text("WARC/1.1", {
        "WARC-Type": kind, "WARC-Record-ID": F.concat(F.lit(f"urn:{kind}:"), name),
        "WARC-Target-URI": F.coalesce("url", F.lit("")), "WARC-Date": when,
        "Content-Type": "application/http;msgtype=response",
    })
    return F.concat_ws("\r\n\r\n", head, http, body)


def _ok(body: Column, etag: Column, modified: Column | None = None) -> Column:
    dated = {} if modified is None else {"Last-Modified": modified}
    return _text("HTTP/1.1 200 OK", {
        "Content-Type": "text/html", "ETag": etag, **dated, "Cache-Control": "max-age=60",
        "Content-Length": F.octet_length(body).cast("string"),
    })


def _same(etag: Column, modified: Column | None = None) -> Column:
    dated = {} if modified is None else {"Last-Modified": modified}
    return _text("HTTP/1.1 304 Not Modified", {
        "ETag": F.concat(F.lit("W/"), etag), **dated, "Cache-Control": "max-age=120", "Content-Length": "0",
    })


def _quoted(body: Column) -> Column:
    return F.concat(F.lit('"'), F.md5(body), F.lit('"'))


def crawl(pages: DataFrame, again_after: int) -> DataFrame:
    """WARC records, as text, of a crawl of ``page_id, url, html``.

    Page n is fetched at minute n, and asked for again ``again_after`` minutes later, when
    the server answers that it is as before.
    """
    html, name = F.coalesce("html", F.lit("")), F.col("page_id").cast("string")
    records = F.array(
        _record("response", name, F.col("page_id"), _ok(html, _quoted(html)), html),
        _record("revisit", name, F.col("page_id") + again_after, _same(_quoted(html)), F.lit("")),
    )
    return pages.select(F.explode(records).alias("record"))


def crawl_of_versions(pages: DataFrame, between: int) -> DataFrame:
    """WARC records of a crawl that asks for the pages ``page_id, url, html`` up to five times.

    Visit v of page n is at minute ``n + v * between``. Visit 0 is the first full response and
    visit 1 finds it unchanged. Every fourth page has a second version, fetched at visit 2, and
    visit 3 finds that one unchanged; half of these still ask with the first version's
    validators. Some pages are found unchanged before any response (visit -1) and some have an
    error at visit 2. Validators are entity tags, dates of modification alone, or none.
    """
    n, url_of = F.col("page_id"), F.col("page_id").cast("string")
    html = F.coalesce("html", F.lit(""))
    dated, bare = n % 4 == 1, n % 16 == 2

    def body(version: int) -> Column:
        return F.concat(html, F.lit(f"<!-- {version} -->")) if version > 1 else html

    def validators(version: int) -> tuple[Column, Column]:
        day = F.date_add(F.lit("2023-11-14").cast("date"), (n % 1000 + version).cast("int"))
        date = F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT"))
        return F.when(~(dated | bare), _quoted(body(version))), F.when(dated, date)

    def visit(v: int, kind: str, http: Column, text: Column) -> Column:
        return _record(kind, F.concat(url_of, F.lit(f":{v}")), n + v * between, http, text)

    def response(v: int, version: int) -> Column:
        return visit(v, "response", _ok(body(version), *validators(version)), body(version))

    def revisit(v: int, version: int) -> Column:
        return visit(v, "revisit", _same(*validators(version)), F.lit(""))

    error = _text("HTTP/1.1 503 Service Unavailable", {"Retry-After": "60"})
    records = F.array(
        F.when(n % 8 == 3, revisit(-1, 1)),
        response(0, 1),
        revisit(1, 1),
        F.when(n % 4 == 0, response(2, 2)).when(n % 16 == 5, visit(2, "response", error, F.lit(""))),
        F.when(n % 8 == 0, revisit(3, 2)).when(n % 8 == 4, revisit(3, 1)),
    )
    return pages.select(F.explode(F.array_compact(records)).alias("record"))
