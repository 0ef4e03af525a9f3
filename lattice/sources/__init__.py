"""lattice.sources"""
