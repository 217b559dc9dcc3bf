"""End-to-end plans: model building, enrichment and the registered queries."""
