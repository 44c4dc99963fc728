"""Structured Streaming versions of the operational jobs.

Event time columns are cast to TIMESTAMP, because a watermark does not take a timestamp without zone; the
session time zone is UTC.
"""
