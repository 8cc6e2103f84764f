"""Plan-level helpers: lineage cuts, sizing and registered queries."""
