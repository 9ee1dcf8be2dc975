"""All registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from memloom.plans import index_queries, recall_queries, retrieval_queries, review_queries, state_queries, stream_queries

QUERIES = {**retrieval_queries.QUERIES, **state_queries.QUERIES, **stream_queries.QUERIES, **review_queries.QUERIES, **recall_queries.QUERIES, **index_queries.QUERIES}
SQL = {**retrieval_queries.SQL, **state_queries.SQL, **stream_queries.SQL, **review_queries.SQL, **recall_queries.SQL, **index_queries.SQL}
