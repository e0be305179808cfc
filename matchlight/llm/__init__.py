"""Training-data operators. Nothing outside this subpackage imports it.

``QUERIES`` and ``ORACLES`` hold the queries ``opN_<name>`` and their DuckDB SQL.
"""
