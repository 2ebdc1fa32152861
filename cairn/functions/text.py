"""Scalar functions over headers, paths, URLs and names, as Spark columns. Invalid input gives null or the stated default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _word_order(hex64: Column) -> Column:
    """Hex of 32 bytes with each 8 bytes turned round."""
    pairs = [F.substring(hex64, 16 * s + 2 * (7 - k) + 1, 2) for s in range(4) for k in range(8)]
    return F.concat(*pairs)


def hash_to_string(h: Column) -> Column:
    """The string form of a 32-byte hash."""
    return _word_order(F.lower(F.hex(h)))


def string_to_hash(s: Column) -> Column:
    """The 32 bytes of a string form; null for what is none."""
    return F.when(s.rlike("^[0-9a-fA-F]{64}$"), F.unhex(_word_order(s)))


def wire_order(hex64: Column) -> Column:
    """A digest's hex in wire order; its own inverse."""
    return _word_order(hex64)


def blob_id(content: Column) -> Column:
    """SHA-1 over the blob header and the content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.lit(b"\0"), content))


def object_key(kind: Column, name: Column) -> Column:
    """kind/ab/cd/name; short names are flat."""
    return F.when(F.length(name) <= 4, F.concat_ws("/", kind, name)).otherwise(F.concat_ws("/", kind, F.substring(name, 1, 2), F.substring(name, 3, 2), name))


def byte_range(header: Column, size: Column) -> Column:
    """struct(lo, hi) of a Range header: inclusive, cut to the size; the whole file for anything but one valid range.
    lo > hi: nothing of the file is asked for."""
    spec = F.when(header.startswith("bytes=") & header.contains("-"), F.substring(header, 7, 1 << 30))
    first = F.when(F.instr(spec, "-") > 0, F.substring_index(spec, "-", 1))
    last = F.substring(spec, F.length(first) + F.lit(2), F.lit(1 << 30))
    num = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("long"))
    a, b, end = num(first), num(last), size - 1
    whole = F.struct(F.lit(0).cast("long").alias("lo"), end.cast("long").alias("hi"))
    suffix = F.struct(F.greatest(size - b, F.lit(0)).cast("long").alias("lo"), end.cast("long").alias("hi"))
    part = F.struct(a.cast("long").alias("lo"), F.when(last == "", end).otherwise(F.least(b, end)).cast("long").alias("hi"))
    out = F.when((first == "") & b.isNotNull(), suffix).when((first != "") & a.isNotNull() & ((last == "") | (b >= a)), part)
    return F.coalesce(out, whole)


def content_range_total(v: Column) -> Column:
    """The total of a Content-Range header, else -1."""
    return F.coalesce(F.regexp_extract(v, r"/([0-9]+)$", 1).try_cast("long"), F.lit(-1).cast("long"))


def trim_etag(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, "^W/", ""), '^"+|"+$', "")


def is_commit(v: Column) -> Column:
    return v.rlike("^[0-9a-f]{40}$")


def is_digest(v: Column) -> Column:
    return v.rlike("^[0-9a-f]{64}$")


def is_content_hash(v: Column) -> Column:
    return is_commit(v) | is_digest(v)


def pseudo_commit(domain: str, repo: Column, rev: Column) -> Column:
    """40 hex digits that stand for a revision without a commit."""
    raw = F.concat(F.encode(F.lit(domain), "UTF-8"), F.lit(b"\0"), F.encode(repo, "UTF-8"), F.lit(b"\0"), F.encode(rev, "UTF-8"))
    return F.substring(F.sha2(raw, 256), 1, 40)


def resolve_path(path: Column) -> Column:
    """struct(repo, rev, path) of /repo/resolve/rev/path with the shortest repo; nulls for other paths."""
    p = r"^/(.+?)/resolve/([^/]+)/(.+)$"
    get = lambda i: F.when(path.rlike(p), F.regexp_extract(path, p, i))
    return F.struct(get(1).alias("repo"), get(2).alias("rev"), get(3).alias("path"))


def origin(url: Column) -> Column:
    """scheme://host of a URL."""
    p = "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)"
    return F.when(url.rlike(p), F.lower(F.regexp_extract(url, p, 1)))


def repo_kind(kind: Column) -> Column:
    """Plural and empty names of repository kinds to one form; null for unknown ones."""
    k = F.lower(kind)
    return F.when(k.isin("", "model", "models"), "model").when(k.isin("dataset", "datasets"), "dataset").when(k.isin("space", "spaces"), "space")


def resolve_url(base: Column, kind: Column, repo: Column, rev: Column, path: Column) -> Column:
    prefix = F.when(kind == "model", F.lit("")).otherwise(F.concat(kind, F.lit("s/")))
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), prefix, repo, F.lit("/resolve/"), F.coalesce(F.nullif(rev, F.lit("")), F.lit("main")), F.lit("/"), path)


def links(header: Column) -> Column:
    """map of rel -> URL of a Link header; a later rel replaces an earlier one."""
    p = r'<([^>]*)>[^,]*?;\s*[rR][eE][lL]="?([^",;]+)"?'
    urls, rels = F.regexp_extract_all(header, F.lit(p), F.lit(1)), F.regexp_extract_all(header, F.lit(p), F.lit(2))
    pairs = F.zip_with(rels, urls, lambda r, u: F.struct(r.alias("rel"), u.alias("url")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(rels, i + 2, F.greatest(F.size(rels), F.lit(1))), lambda r: r == x["rel"]))
    return F.map_from_entries(last)


def cache_name(name: Column) -> Column:
    """struct(chunk_start, chunk_end, byte_start, byte_end) of "a-b_c-d"; null for other names and for ranges that go down."""
    p = r"^([0-9]{1,10})-([0-9]{1,10})_([0-9]{1,19})-([0-9]{1,19})$"
    get = lambda i: F.regexp_extract(name, p, i).try_cast("long")
    a, b, c, d = (get(i) for i in range(1, 5))
    ok = name.rlike(p) & (a <= b) & (b < 1 << 32) & (c <= d)
    return F.when(ok, F.struct(a.alias("chunk_start"), b.alias("chunk_end"), c.alias("byte_start"), d.alias("byte_end")))


def make_cache_name(a: Column, b: Column, c: Column, d: Column) -> Column:
    s = lambda x: x.cast("string")
    return F.concat(s(a), F.lit("-"), s(b), F.lit("_"), s(c), F.lit("-"), s(d))


def tag(endpoint: Column) -> Column:
    """16 hex digits that name an endpoint."""
    return F.substring(F.sha2(endpoint, 256), 1, 16)


def spool_name(org: Column, content: Column) -> Column:
    return F.concat(F.substring(F.sha2(org, 256), 1, 32), F.lit("-"), F.substring(F.sha2(content, 256), 1, 32))


def retryable(status: Column) -> Column:
    return status.isin(500, 502, 503, 504)


def authoritative(status: Column) -> Column:
    """A client error that will not go away by asking again."""
    return status.between(400, 499) & (status != 429)


def whole_range(status: Column, content_range: Column, lo: Column, hi: Column) -> Column:
    """Whether a response is exactly the range asked for."""
    want = F.concat(F.lit("bytes "), lo.cast("string"), F.lit("-"), hi.cast("string"), F.lit("/"))
    return (status == 206) & content_range.startswith(want)


def valid_chunk_range(start: Column, end: Column) -> Column:
    return (start < end) & (end <= 8192)


def byte_size(n: Column) -> Column:
    """Sizes for people: B below 1024, else one digit after the point, ties to even."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        text = F.concat(F.format_string("%.1f", F.bround(n / float(1024**i), 1)), F.lit(f" {unit}"))
        out = out.when(n < 1024 ** (i + 1), text) if i < 5 else out.otherwise(text)
    return out


def valid_path(path: Column) -> Column:
    """A relative path without empty, . or .. parts and without backslashes."""
    return path.rlike(r"^[^/\\]+(/[^/\\]+)*$") & ~path.rlike(r"(^|/)\.{1,2}(/|$)")


def valid_envelope(body: Column) -> Column:
    """A telemetry document: an RFC 3339 time, an event, and exactly one of user_agent and userAgent."""
    get = lambda p: F.get_json_object(body, p)
    agents = get("$.user_agent").isNotNull().cast("int") + get("$.userAgent").isNotNull().cast("int")
    return (agents == 1) & get("$.event").isNotNull() & F.try_to_timestamp(get("$.timestamp")).isNotNull()
