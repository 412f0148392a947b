"""Whole plans: report, evaluation, ablation, and the registered queries."""
