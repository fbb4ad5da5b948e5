"""Lineage, influence, co-dependence, perturbation and comparison operators."""
