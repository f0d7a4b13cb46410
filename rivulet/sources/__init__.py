"""Sources and sinks: integer and enum ranges, tables, CSV."""
