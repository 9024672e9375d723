"""folioscan.operators"""
