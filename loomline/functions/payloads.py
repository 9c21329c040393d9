"""Request payloads, descriptors, handles and plans as JSON, and the texts and URLs in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANDLE = "request_id string, request_media_index int, cache_key string, epoch int"
SOURCE = "transport string, source_key string, media_uuid string, request_scope_key string, image_url string, local_path string, mime_type string"
DESCRIPTOR = (
    f"request_id string, request_media_index int, captured_image struct<source_ref: struct<{SOURCE.replace(' string', ': string')}>, mime_type: string, byte_size: bigint, local_materialized_path: string>, "
    "ingress_limits struct<max_image_count: int, max_encoded_bytes: bigint, max_decoded_bytes: bigint, max_pixels_per_image: bigint>, processor_signature_value string, item_identity string, "
    "orig_size_hw array<int>, http_headers array<array<string>>, http_timeout_ms int, allow_redirects boolean"
)
PLANNED = "request_media_index int, item_identity string, transport string, source_key string, orig_size_hw array<int>, preprocessed_size_hw array<int>, image_grid_thw array<int>, placeholder_token_count int, processor_signature string"
PLAN = "version int, request_id string, enabled boolean, reason string, processor_signature string, prepared_image_count int, total_placeholder_token_count int, planned_items array<string>, fallback_descriptors array<string>, handles array<string>"
VERSION = 1


def encode(**fields: Column) -> Column:
    """JSON of the fields, nulls included, in their order."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def decode(text: Column, schema: str) -> Column:
    """A struct of the schema; null where the text is no JSON object."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, schema))


def handle(request: Column, index: Column, key: Column, epoch: Column) -> Column:
    return encode(request_id=request, request_media_index=index, cache_key=key, epoch=epoch)


def descriptor(request: Column, index: Column, captured: Column, limits: Column, signature: Column, identity: Column, size: Column, headers: Column, timeout: Column, redirects: Column) -> Column:
    """A fallback descriptor; what its payload might be isn't written."""
    return encode(request_id=request, request_media_index=index, captured_image=captured, ingress_limits=limits, processor_signature_value=signature, item_identity=identity, orig_size_hw=size, http_headers=headers, http_timeout_ms=timeout, allow_redirects=redirects)


def plan(request: Column, enabled: Column, reason: Column, signature: Column, images: Column, tokens: Column, planned: Column, descriptors: Column, handles: Column) -> Column:
    """A request's payload; the last three are arrays of JSON objects, which are spliced in as they are."""
    head = encode(version=F.lit(VERSION), request_id=request, enabled=enabled, reason=reason, processor_signature=signature, prepared_image_count=images, total_placeholder_token_count=tokens)
    spliced = [F.concat(F.lit(f',"{name}":['), F.array_join(values, ","), F.lit("]")) for name, values in (("planned_items", planned), ("fallback_descriptors", descriptors), ("handles", handles))]
    return F.concat(F.rtrim(head, F.lit("}")), *spliced, F.lit("}"))


def decode_plan(text: Column) -> Column:
    """The plan of a payload with defaults for missing keys; elements that are no objects are dropped. Null where it is no object."""
    raw = F.from_json(text, PLAN)
    objects = lambda c: F.filter(F.coalesce(raw[c], F.array().cast("array<string>")), lambda x: F.coalesce(x.startswith("{"), F.lit(False)))
    made = F.struct(
        F.coalesce(raw["version"], F.lit(VERSION)).alias("version"), raw["request_id"].alias("request_id"), F.coalesce(raw["enabled"], F.lit(False)).alias("enabled"), raw["reason"].alias("reason"),
        raw["processor_signature"].alias("processor_signature"), F.coalesce(raw["prepared_image_count"], F.lit(0)).alias("prepared_image_count"),
        F.coalesce(raw["total_placeholder_token_count"], F.lit(0)).alias("total_placeholder_token_count"),
        *(objects(c).alias(c) for c in ("planned_items", "fallback_descriptors", "handles")),
    )
    return F.when(F.ltrim(text).startswith("{"), made)


def found_payload(params: Column, features: Column, key: str = "request_plan") -> Column:
    """The payload object in a map of extra arguments, else in the first of the features' maps that has one."""
    own = lambda m: F.get(F.filter(F.array(F.try_element_at(m, F.lit(key))), lambda x: F.coalesce(x.startswith("{"), F.lit(False))), F.lit(0))
    return F.coalesce(own(params), F.get(F.filter(F.transform(features, own), lambda x: x.isNotNull()), F.lit(0)))


def mm_hash(handle_key: Column, identity: Column, signature: Column) -> Column:
    """The hash of an image: its handle's cache key, else identity and signature."""
    return F.coalesce(F.nullif(handle_key, F.lit("")), F.concat(identity, F.lit("|"), signature))


def overridden(payload: Column, **values: Column) -> Column:
    """A payload with some top-level values put in place; a null leaves what is there."""
    fields = F.from_json(payload, "map<string,string>")
    new = F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(fields, lambda k, _: ~F.map_contains_key(new, k)), new)


def probe_config(config: Column, preprocessor: Column) -> Column:
    """Integers of a model's configuration: the vision part, then the preprocessor's; edges, then explicit pixels win."""
    whole = lambda text, path: F.when(F.get_json_object(text, path).rlike(r"^-?\d{1,9}$"), F.get_json_object(text, path).cast("int"))
    pick = lambda name, vision, default: F.coalesce(whole(preprocessor, f"$.{name}"), whole(config, f"$.vision_config.{vision}"), F.lit(default))
    pixels = lambda name, edge, default: F.coalesce(whole(preprocessor, f"$.{name}"), whole(preprocessor, f"$.size.{edge}"), F.lit(default))
    return F.struct(
        pick("patch_size", "patch_size", 14).alias("patch"), pick("merge_size", "spatial_merge_size", 2).alias("merge"), pick("temporal_patch_size", "temporal_patch_size", 2).alias("temporal"),
        F.coalesce(whole(config, "$.vision_config.in_channels"), F.lit(3)).alias("channels"),
        pixels("min_pixels", "shortest_edge", 3136).alias("min_pixels"), pixels("max_pixels", "longest_edge", 12_845_056).alias("max_pixels"),
    )


def bench_signature(source: Column, patch: Column, merge: Column, temporal: Column, channels: Column, low: Column, high: Column, backend: Column, resize: Column) -> Column:
    named = {"patch": patch, "merge": merge, "temporal": temporal, "channels": channels, "min_pixels": low, "max_pixels": high, "resize_backend": backend, "do_resize": resize.cast("int")}
    return F.concat_ws(":", source, *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in named.items()))


def base64_part(payload: Column) -> Column:
    """What follows the first comma of a ``data:`` URL; the whole of anything else."""
    return F.when(payload.startswith("data:") & (F.instr(payload, ",") > 0), F.substr(payload, F.instr(payload, ",") + 1)).otherwise(payload)


def relative_path(path: Column, root: Column) -> Column:
    """The path below a folder; the file's name for paths elsewhere."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(base), F.substr(path, F.length(base) + 1)).otherwise(F.substring_index(path, "/", -1))


def rendered_url(transport: Column, path: Column, http_base: Column, root: Column, content: Column, mime: str = "image/jpeg") -> Column:
    """An image's URL over a transport: file, HTTP below a base, or its content inline."""
    plain = F.replace(F.replace(F.base64(content), F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit(""))
    http = F.concat(F.rtrim(http_base, F.lit("/")), F.lit("/"), relative_path(path, root))
    return F.when(transport == "local_path", F.concat(F.lit("file://"), path)).when(transport == "http", http).when(transport == "base64", F.concat(F.lit(f"data:{mime};base64,"), plain))


PART = "struct<type: string, text: string, image_url: struct<url: string>>"


def chat_parts(text: Column, urls: Column) -> Column:
    """A message's content: one text part, then the images."""
    image = lambda u: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(u.alias("url")).alias("image_url"))
    first = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("struct<url: string>").alias("image_url"))
    return F.concat(F.array(first.cast(PART)), F.transform(urls, lambda u: image(u).cast(PART)))


def rewritten_parts(parts: Column, url) -> Column:
    """Content parts with ``url(old)`` in place of images' URLs; other parts stay as they are."""
    new = lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), F.struct(url(p["image_url"]["url"]).alias("url")).alias("image_url")).cast(PART)
    return F.transform(parts, lambda p: F.when((p["type"] == "image_url") & p["image_url"]["url"].isNotNull(), new(p)).otherwise(p))


# The words of generated sentences, and in ``sentence`` the text around them, which token counts of datasets depend on.
ADJECTIVES = ("granular", "deterministic", "cacheless", "multimodal", "latency-aware", "token-precise", "vision-heavy", "nonrepeating")
NOUNS = ("benchmark", "request", "payload", "profile", "timeline", "dataset", "session", "sample")


def sentence(round_: Column, number: Column) -> Column:
    """A sentence of its own for each round and number."""
    pad = lambda c, n: F.when(F.length(c.cast("string")) < n, F.lpad(c.cast("string"), n, "0")).otherwise(c.cast("string"))
    code = F.concat(F.lit("r"), pad(round_, 2), F.lit("_s"), pad(number, 5))
    word = lambda words, at: F.get(F.array(*map(F.lit, words)), F.pmod(at, F.lit(len(words))).cast("int"))
    ids = F.concat_ws("/", round_.cast("string"), number.cast("string"), (round_ * 1000 + number).cast("string"))
    return F.concat(
        F.lit("Segment "), code, F.lit(" records a "), word(ADJECTIVES, number), F.lit(" "), word(NOUNS, number * 3), F.lit(" for service tracing. It includes identifiers "), ids,
        F.lit(" and unique markers "), F.upper(code), F.lit("::"), (number * 17 + round_).cast("string"), F.lit(". This line is intentionally unique within and across rounds.\n"),
    )
