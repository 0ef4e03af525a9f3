"""lattice.operators"""
