"""corpuslane.functions"""
