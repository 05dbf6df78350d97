"""corpuslane.plans"""
