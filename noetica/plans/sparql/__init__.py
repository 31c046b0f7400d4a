"""SPARQL 1.1 over quad DataFrames."""

from .engine import Engine, ask, construct, describe, select, update

__all__ = ["Engine", "ask", "construct", "describe", "select", "update"]
