"""lattiq.streaming"""
