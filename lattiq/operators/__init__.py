"""lattiq.operators"""
