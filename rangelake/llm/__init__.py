"""Operations of a training-data pipeline: search, scans, scoring, tokens, packing, deduplication.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; ``queries`` holds the thin registered queries and their SQL.
"""
