"""lattice.plans"""
