"""Table layouts of the engine."""

from __future__ import annotations

SPAN = "struct<from: int, to: int>"
PAGE = "title string, ns string, sha1 string, text string"
ARTICLE = f"doc string, title string, tokens_title array<{SPAN}>, text string, tokens array<{SPAN}>, size int, maxf int"
POSTING = "term string, doc string, positions array<int>, tf int"
VOCABULARY = "term string"
QUERY = "query_id long, text string"
