"""Operators for preparing training data: sharding, chat logs, decontamination, packing, filters, duplicates."""
