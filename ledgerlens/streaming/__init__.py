"""Streaming.

The valuation-control jobs are periodic batch runs; nothing in them needs
event-time windows, watermarks or cross-batch state.  The one place where
files keep arriving is the counterparty feed folder, so ``feed_stream``
offers Structured Streaming's file source as an alternative way to ingest
it: each micro-batch is parsed with the same batch readers and written
idempotently per batch id; aggregation stays in the batch jobs.
"""

from .feed_stream import start_feed_stream

__all__ = ["start_feed_stream"]
