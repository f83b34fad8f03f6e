"""lattiq.functions"""
