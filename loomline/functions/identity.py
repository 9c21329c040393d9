"""Where a media item comes from and what it is called: transports, URLs, keys, types, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HTTP = r"^([hH][tT][tT][pP][sS]?)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::0*(\d+))?([^?#]*)(\?[^#]+)?"

# Media types by file extension.
EXTENSIONS = {
    "bmp": "image/bmp", "gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png",
    "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp",
}


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[hH][tT][tT][pP][sS]?:"), F.lit(False))


def is_data_url(url: Column) -> Column:
    return F.coalesce(F.lower(url).startswith("data:image/"), F.lit(False))


def transport(url: Column, path: Column) -> Column:
    """local_path, base64 or http in this order of precedence; null where none fits."""
    local = F.coalesce(F.length(path) > 0, F.lit(False))
    return F.when(local, "local_path").when(is_data_url(url), "base64").when(is_http_url(url), "http")


def canonical_http_url(url: Column) -> Column:
    """Scheme and host in lower case, without user, fragment and empty query; a path at least. Null for others.

    An IPv6 host loses its brackets; what follows a percent sign in a host keeps its case.
    """
    part = lambda i: F.regexp_extract(url, _HTTP, i)
    port = F.when(part(3) != "", F.concat(F.lit(":"), part(3))).otherwise("")
    path = F.when(part(4) != "", part(4)).otherwise("/")
    bare = F.regexp_replace(part(2), r"[\[\]]", "")
    name = F.substring_index(bare, "%", 1)
    host = F.concat(F.lower(name), F.substr(bare, F.char_length(name) + 1))
    return F.when((part(1) != "") & (bare != ""), F.concat(F.lower(part(1)), F.lit("://"), host, port, path, part(5)))


def http_source_key(url: Column) -> Column:
    return F.concat(F.lit("http:"), canonical_http_url(url))


def http_source_error(url: Column) -> Column:
    """INVALID_SOURCE where a URL has no source key, null where it has one."""
    return F.when(canonical_http_url(url).isNull(), "INVALID_SOURCE")


def transport_error(url: Column, path: Column) -> Column:
    """INVALID_TRANSPORT where nothing tells the transport, null where something does."""
    known = F.coalesce(F.length(path) > 0, F.lit(False)) | is_data_url(url) | canonical_http_url(url).isNotNull()
    return F.when(~known, "INVALID_TRANSPORT")


def local_source_key(path: Column, mtime_ns: Column, size: Column) -> Column:
    return F.concat(F.lit("local_path:"), path, F.lit("|"), mtime_ns.cast("string"), F.lit("|"), size.cast("string"))


def base64_source_key(scope: Column, index: Column) -> Column:
    return F.concat(F.lit("base64:"), scope, F.lit(":image:"), index.cast("string"))


def cache_key(identity: Column, signature: Column) -> Column:
    """Null where either part is, unlike concat_ws."""
    return F.concat(identity, F.lit("|"), signature)


def data_url_payload(url: Column) -> Column:
    """What follows the first comma; null where there is none."""
    return F.when(F.instr(url, ",") > 0, F.substr(url, F.instr(url, ",") + 1))


def data_url_mime(url: Column) -> Column:
    """Media type of a ``data:`` URL (this case only) with a comma; null where it is empty."""
    head = F.trim(F.substring_index(F.substring_index(F.substr(url, F.lit(6)), ",", 1), ";", 1))
    return F.when(url.startswith("data:") & (F.instr(url, ",") > 0) & (head != ""), head)


def base64_size(url: Column) -> Column:
    """Decoded bytes of a data URL's payload, from its length and padding."""
    body = F.trim(data_url_payload(url))
    bare = F.length(F.rtrim(body, F.lit("=")))
    return F.when(body == "", F.lit(0)).otherwise(F.floor(F.length(body) * 3 / 4) - (F.length(body) - bare)).cast("long")


def file_path(url: Column) -> Column:
    """Path of a file URL, percent-decoded; a value without a scheme as it is; null for others."""
    rest = F.regexp_extract(url, r"^[fF][iI][lL][eE]:(?://([^/?#]*))?([^?#]*)", 1)
    path = F.regexp_extract(url, r"^[fF][iI][lL][eE]:(?://([^/?#]*))?([^?#]*)", 2)
    decoded = F.try_url_decode(F.replace(F.concat(rest, path), F.lit("+"), F.lit("%2B")))
    return F.when(F.lower(url).startswith("file:"), decoded).when(~url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & (url != ""), url)


def mime(url: Column, decoder: Column, path: Column) -> Column:
    """Media type from the data URL, else the decoder's format, else the file extension, else image/unknown."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    by_name = F.get(F.array(known[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]), F.lit(0))
    return F.coalesce(data_url_mime(url), F.when(decoder != "", F.concat(F.lit("image/"), F.lower(decoder))), by_name, F.lit("image/unknown"))


def ranked_claimer(request: Column, rank: Column) -> Column:
    return F.concat(request, F.lit("::producer_rank="), rank.cast("string"))


def claimer_rank(claimer: Column) -> Column:
    """Rank after the last marker, null where it is no integer from 0."""
    got = F.try_to_number(F.nullif(F.trim(F.regexp_extract(claimer, r"(?s)^.*::producer_rank=\s*\+?(\d{1,9})\s*$", 1)), F.lit("")), F.lit("999999999")).cast("int")
    return F.when(F.coalesce(claimer, F.lit("")) != "", got)


def diagnostic_suffix(text: Column) -> Column:
    """Lower case with underscores for all but letters and digits; none for null, unknown for nothing left."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]", "_"), F.lit("_"))
    return F.when(text.isNull(), "none").when(plain == "", "unknown").otherwise(plain)


def cpu_set(text: Column) -> Column:
    """Sorted distinct ids of a list of numbers and ranges; reversed ranges are turned, junk is skipped, none is null."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d{1,6}(\s*-\s*\d{1,6})?$"))

    def ids(x: Column) -> Column:
        a = F.trim(F.substring_index(x, "-", 1)).cast("int")
        b = F.trim(F.substring_index(x, "-", -1)).cast("int")
        return F.sequence(F.least(a, b), F.greatest(a, b))

    every = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, ids))))
    return F.when(F.size(every) > 0, every)


def bench_identity(transport_: Column, url: Column, name: Column, size: Column, mtime: Column) -> Column:
    body = F.coalesce(data_url_payload(url), url)
    local = F.concat(F.lit("local:"), name, F.lit(":"), size.cast("string"), F.lit(":"), mtime.cast("string"))
    coded = F.concat(F.lit("base64:"), F.length(body).cast("string"), F.lit(":"), F.left(body, F.lit(32)), F.lit(":"), F.right(body, F.lit(32)))
    return F.when(transport_ == "local_path", local).when(transport_ == "http", F.concat(F.lit("http:"), url)).otherwise(coded)
