"""corpuslane.operators"""
