"""Readers and writers: corpus and submission files, reports, ledger, SQL texts."""
