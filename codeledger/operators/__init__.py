"""DataFrame operators over inquiries, responses, reviews and the ledger."""
