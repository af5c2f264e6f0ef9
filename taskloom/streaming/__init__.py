"""taskloom.streaming"""
