"""lattiq.sources"""
