"""Change-to-change operators (source middleware)."""

from tidegraph.operators.middleware import STAGES, Decoder, Map, ParseJson, Pipeline, Promote, Relabel, Unwind

__all__ = ["STAGES", "Decoder", "Map", "ParseJson", "Pipeline", "Promote", "Relabel", "Unwind"]
