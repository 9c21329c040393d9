"""Loomline: analytics of multimodal requests on Spark."""
