"""The registered queries, their inputs and their SQL counterparts."""
