"""Readers of records, subtitles, speech-to-text results and videos."""
