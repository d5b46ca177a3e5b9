"""Operators for building training corpora: quality, language, decontamination,
deduplication, packing, token counts and toxicity over a ``documents`` table.

Nothing else in the library imports this package. ``queries.load()`` returns
the named queries, ``queries.oracles()`` their DuckDB SQL."""
