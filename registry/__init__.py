"""The registered queries and, next to each, the SQL that answers the same question."""
