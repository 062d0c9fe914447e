"""The query modules of this package."""

from veldspaat.llm import queries_copies, queries_leaks, queries_listpages, queries_mixture, queries_pieces, queries_spans, queries_truncation

MODULES = [queries_spans, queries_copies, queries_leaks, queries_pieces, queries_mixture, queries_truncation, queries_listpages]
