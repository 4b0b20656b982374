"""Where events come from: tables, databases, streams, several stores at once."""
