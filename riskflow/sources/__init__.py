"""Sources and sinks: parquet tables, XML documents, delimited files, table writes."""
