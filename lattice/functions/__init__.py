"""lattice.functions"""
