"""Hand-written parser for the two query languages."""

from tidegraph.parser.grammar import ParseError, parse_cypher, parse_gql

__all__ = ["ParseError", "parse_cypher", "parse_gql"]
