"""Structured Streaming entry points (continuous loan-record import)."""

from loanlens.streaming.ingest import ingest, loan_file_stream

__all__ = ["ingest", "loan_file_stream"]
