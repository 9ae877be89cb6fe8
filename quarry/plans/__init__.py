"""Registered queries over the driver tables and their SQL."""

from . import claims, coverage, diffs, documents, folds, layout, outline, projects, records, redaction, retrieval, rubrics, streams, tenders, texts, usage
from .registry import QUERIES, SQL
from .retrieval import retrieve
