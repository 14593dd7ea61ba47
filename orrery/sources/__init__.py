"""Tables from outside: Parquet folders and SQLite files."""
