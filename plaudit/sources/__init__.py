"""Readers: tables, CSV, review text files, API payloads, web pages, SQL views."""
