"""taskloom.sources"""
