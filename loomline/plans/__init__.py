"""The engine's queries, each with SQL where it can express it."""

from loomline.plans import catalog, features, media, more, pictures, requests, texts, timing  # noqa: F401
from loomline.plans.registry import QUERIES, SQL  # noqa: F401
