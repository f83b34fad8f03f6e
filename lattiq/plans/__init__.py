"""lattiq.plans"""
