"""Named connections, introspection and result sinks."""

from plumbline.sources.connections import (
    Connection, catalog_connection, frame_connection, jdbc_connection, open_connections, parquet_connection, static_connection,
)

__all__ = [
    "Connection", "catalog_connection", "frame_connection", "jdbc_connection", "open_connections", "parquet_connection",
    "static_connection",
]
