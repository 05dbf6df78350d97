"""corpuslane.streaming"""
