"""lattice.streaming"""
