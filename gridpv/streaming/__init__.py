"""Structured Streaming forms of the reference's operators.

The reference works on bounded extracts; the only stream-shaped part is
generation arriving half-hour by half-hour.  :mod:`gridpv.streaming.hourly`
keeps the hour means (F1) of landed generation files up to date.
"""
