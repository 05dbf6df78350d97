"""corpuslane.sources"""
