"""tidemark: session-signal, event-ledger and corpus analytics as plain Spark plans."""
