"""What the entities of a request have to fulfil: rules by entity, each with the message of the first one that fails.

A rule is a condition on the entity's columns; a null result of a condition fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.operators.validation import first_error


def _text(c: str) -> str:
    return f"coalesce(length({c}), 0) > 0"


def _each_positive(c: str, n: int) -> str:
    return f"size({c}) = {n} and forall({c}, x -> x > 0)"


RULES = {
    "media_source": {
        "source_key": _text("source_key"), "media_uuid": _text("media_uuid"), "local_path": "transport <> 'local_path' or coalesce(length(local_path), 0) > 0",
        "image_url": "transport not in ('http', 'base64') or coalesce(length(image_url), 0) > 0", "transport": "transport in ('local_path', 'http', 'base64')",
    },
    "normalized_image": {"orig_size_hw": _each_positive("orig_size_hw", 2)},
    "schedule_item": {
        "item_index": "item_index >= 0", "item_identity": _text("item_identity"), "image_grid_thw": _each_positive("image_grid_thw", 3), "placeholder_token_count": "placeholder_token_count > 0",
    },
    "manifest": {"image_count": "image_count > 0", "items": "size(tokens) = image_count", "total": "aggregate(tokens, 0L, (s, x) -> s + x) = total_placeholder_token_count"},
    "artifact": {
        "artifact_id": _text("artifact_id"), "item_identity": _text("item_identity"), "image_grid_thw": _each_positive("image_grid_thw", 3), "payload_shape": _each_positive("payload_shape", 2),
        "dtype": _text("dtype"), "payload_nbytes": "payload_nbytes is null or payload_nbytes > 0",
    },
    "fallback": {
        "request_id": _text("request_id"), "request_media_index": "request_media_index >= 0", "item_identity": _text("item_identity"), "processor_signature": _text("processor_signature"),
        "http_timeout_ms": "http_timeout_ms > 0", "orig_size_hw": f"orig_size_hw is null or {_each_positive('orig_size_hw', 2)}",
    },
}


def violation(entity: str) -> Column:
    """The name of the first rule of the entity that a row breaks, else null."""
    return first_error(*((F.coalesce(F.expr(rule), F.lit(False)), name) for name, rule in RULES[entity].items()))
