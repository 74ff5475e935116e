"""Block assignment, sizing, packing, statistics and analytics."""
