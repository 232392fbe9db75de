"""Operators for preparing training data: quality rules, deduplication, search, token output, mixing, sharding.

Every operator takes DataFrames and returns DataFrames. Nothing outside this folder imports it; the registered
queries are in ``queries``.

Common rules: a null document id sorts after every other id (and all null ids count as one document where
documents are told apart by id); a null text is treated as the empty text unless an operator says otherwise;
input columns that an operator doesn't name are ignored or carried along unchanged.
"""
