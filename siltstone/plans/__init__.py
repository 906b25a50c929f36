"""Whole plans: the snapshot store with its run ledger, notebooks and metrics, and ingestion."""
