"""Readers and writers: files, partitioned tables, JDBC tables and message topics."""
